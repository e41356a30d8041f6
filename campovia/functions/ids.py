"""Company ids, postcodes, money, flags, phones and reason codes as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from campovia.functions.text import digits

# Postcode ranges by state (BA and AC have none, so their postcodes never fit), check-digit weights, words, labels.
CEP_BOUNDS = {
    "SP": ("01000000", "19999999"), "RJ": ("20000000", "28999999"), "MG": ("30000000", "39999999"), "ES": ("29000000", "29999999"),
    "PR": ("80000000", "87999999"), "SC": ("88000000", "89999999"), "RS": ("90000000", "99999999"), "DF": ("70000000", "73699999"),
    "GO": ("72800000", "76799999"), "MT": ("78000000", "78899999"), "MS": ("79000000", "79999999"), "AL": ("57000000", "57999999"),
    "PE": ("50000000", "56999999"), "PB": ("58000000", "58999999"), "RN": ("59000000", "59999999"), "CE": ("60000000", "63999999"),
    "PI": ("64000000", "64999999"), "MA": ("65000000", "65999999"), "PA": ("66000000", "68899999"), "AP": ("68900000", "68999999"),
    "AM": ("69000000", "69299999"), "RR": ("69300000", "69389999"), "RO": ("76800000", "76999999"), "SE": ("49000000", "49999999"),
    "TO": ("77000000", "77999999"),
}
CNPJ_WEIGHTS = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
MOST_MONEY = 1_000_000_000
TRUE_WORDS = ("true", "verdadeiro", "1", "sim", "s", "yes", "y", "x", "✓", "estrategico", "estrategica")
FALSE_WORDS = ("false", "falso", "0", "nao", "n", "no")
REASON_LABELS = {
    "campo_obrigatorio_cnpj": "CNPJ ausente ou invalido",
    "campo_obrigatorio_logradouro": "Logradouro obrigatorio ausente",
    "campo_obrigatorio_numero": "Numero obrigatorio ausente",
    "campo_obrigatorio_cidade": "Cidade obrigatoria ausente",
    "campo_obrigatorio_uf": "UF obrigatoria ausente",
    "numero_ausente_sem_cep": "Numero ausente e CEP nao informado",
    "cnpj_duplicado_arquivo": "CNPJ duplicado no arquivo",
    "cnpj_duplicado_input_id": "CNPJ duplicado neste processamento",
    "falha_input_geocoding": "Registro barrado antes do envio ao geocoding",
    "falha_integracao_geocoding": "Falha de integracao com o geocoding engine",
    "falha_geocoding": "Geocoding nao retornou coordenadas validas",
    "cidade_invalida": "Cidade ou UF nao encontrada na base de referencia",
    "fora_municipio": "Coordenada fora do municipio informado",
    "fallback_falhou": "Tentativa de recuperacao por fallback falhou",
}
STATUS_REASONS = {
    "falha_input_geocoding": "falha_input_geocoding", "falha_integracao_geocoding": "falha_integracao_geocoding", "falha": "falha_geocoding", "invalid_input": "falha_input_geocoding",
    "cidade_invalida": "cidade_invalida", "fora_municipio": "fora_municipio", "fallback_falhou": "fallback_falhou", "falha_total": "falha_geocoding",
}
SOURCE_RANKS = {"cache": 0, "google": 1, "nominatim": 2, "fallback": 10, "unknown": 50, "falha": 99}


def mapped(c: Column, table: dict, default: Column) -> Column:
    """The value that a fixed table gives, or the default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), default)


def cnpj_from_cell(c: Column) -> Column:
    """Digits of a company id cell; scientific notation (comma or point) is written out first; blank is null."""
    s = F.trim(c)
    dotted = F.when(s.rlike(r"^\d+,\d+E\+\d+$"), F.replace(s, F.lit(","), F.lit("."))).otherwise(s)
    exponent = dotted.rlike(r"(?i)^\d+(\.\d+)?E\+\d+$")
    written = F.when(exponent, dotted.try_cast("double").cast("decimal(38,0)").cast("string")).otherwise(dotted)
    return F.when(s == "", F.lit(None)).otherwise(digits(written))


def cnpj_14(c: Column) -> Column:
    """The digits if there are 14 of them, else null."""
    s = digits(c)
    return F.when(F.length(s) == 14, s)


def check_digit(number: Column, weights: tuple[int, ...]) -> Column:
    """11 less the weighted sum's remainder by 11; 10 and 11 are 0."""
    total = sum((F.substring(number, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    left = 11 - total % 11
    return F.when(left < 10, left).otherwise(0)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used: the element of a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_check_digits(base: Column) -> Column:
    """Twelve digits and their two check digits."""
    one = let(base, lambda b: F.concat(b, check_digit(b, CNPJ_WEIGHTS).cast("string")))
    return let(one, lambda b: F.concat(b, check_digit(b, (6, *CNPJ_WEIGHTS)).cast("string")))


def synthetic_cnpj(number: Column) -> Column:
    """A valid-looking company id made from a row number: eight root digits by arithmetic, branch 0001, check digits."""
    root = (10_000_000 + (number.cast("long") * 7_368_787) % 90_000_000).cast("string")
    return with_check_digits(F.concat(root, F.lit("0001")))


def cnpj_mask(c: Column) -> Column:
    """00.000.000/0000-00; what has not 14 digits stays as it is."""
    s = digits(c)
    part = lambda a, n: F.substring(s, a, n)
    masked = F.concat(part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3), F.lit("/"), part(9, 4), F.lit("-"), part(13, 2))
    return F.when(F.length(s) == 14, masked).otherwise(c)


def registry_cnpj(c: Column) -> Column:
    """Digits; 12 or 13 of them are padded to 14."""
    s = digits(c)
    return F.when(F.length(s).isin(12, 13), F.lpad(s, 14, "0")).otherwise(s)


def cep_strict(c: Column) -> Column:
    """Five or eight digits, padded to eight; else null."""
    s = digits(c)
    return F.when(F.length(s).isin(5, 8), F.lpad(s, 8, "0"))


def cep_loose(c: Column) -> Column:
    """Five to eight digits, padded to eight, after a closing ".0" and scientific notation are resolved; else null."""
    s = F.regexp_replace(F.trim(c), r"\.0$", "")
    exponent = F.lower(s).contains("e")
    number = F.when(exponent, s.try_cast("double").cast("long").cast("string")).otherwise(s)
    d = digits(number)
    return F.when(F.length(d).between(5, 8), F.lpad(d, 8, "0"))


def cep_valid(c: Column) -> Column:
    """Eight digits, hyphens aside, and not all zero."""
    s = F.trim(F.replace(c, F.lit("-"), F.lit("")))
    return F.coalesce(s.rlike("^[0-9]{8}$") & (s != "00000000"), F.lit(False))


def cep_fits_state(cep: Column, uf: Column) -> Column:
    """The postcode lies in the state's range; states without one never fit."""
    low = mapped(F.upper(F.trim(uf)), {k: v[0] for k, v in CEP_BOUNDS.items()}, F.lit(None))
    high = mapped(F.upper(F.trim(uf)), {k: v[1] for k, v in CEP_BOUNDS.items()}, F.lit(None))
    return F.coalesce((cep >= low) & (cep <= high), F.lit(False))


def states_of_cep(c: Column) -> Column:
    """All states whose range holds the postcode, in order of their letters; ranges overlap."""
    s = digits(c)
    hits = [F.when((F.length(s) == 8) & s.between(low, high), F.lit(uf)) for uf, (low, high) in sorted(CEP_BOUNDS.items())]
    return F.array_compact(F.array(*hits))


def money(c: Column) -> Column:
    """R$ 1.234,56 or a plain number as a double; null if unreadable or over a thousand million."""
    s = F.trim(F.regexp_replace(F.trim(c), r"(?i)R\$", ""))
    brazilian = F.regexp_replace(F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")), "[^0-9.]", "")
    value = F.when(s.contains(","), brazilian).otherwise(s).try_cast("double")
    return F.when(value <= MOST_MONEY, value)


def flag(c: Column) -> Column:
    """True, false or null by Portuguese and English words."""
    s = F.lower(F.trim(c))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def number_br(c: Column, places: int = 1) -> Column:
    """1.234,5"""
    return F.translate(F.format_number(c, places), ",.", ".,")


def phone_e164(c: Column) -> Column:
    """Ten digits get a 9 after the area code, eleven the country code; anything but thirteen digits then is null."""
    s = digits(c)
    mobile = F.when(F.length(s) == 10, F.concat(F.substring(s, 1, 2), F.lit("9"), F.substring(s, 3, 20))).otherwise(s)
    full = F.when(F.length(mobile) == 11, F.concat(F.lit("55"), mobile)).otherwise(mobile)
    return F.when(F.length(full) == 13, full)


def reason_labels(c: Column) -> Column:
    """Reason codes joined by | as labels joined by "; "; unknown codes stay, blank is null."""
    parts = F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    label = lambda x: mapped(x, REASON_LABELS, x)
    return F.when(F.trim(c) != "", F.array_join(F.transform(parts, label), "; "))


def geocoding_reason(c: Column) -> Column:
    """The reason that a geocoding status stands for; an unknown status is its own, a blank one is falha_geocoding."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return mapped(s, STATUS_REASONS, F.when(s == "", "falha_geocoding").otherwise(s))


def source_rank(c: Column) -> Column:
    """How far down a coordinate source ranks; unlisted ones count as unknown."""
    return mapped(c, SOURCE_RANKS, F.lit(SOURCE_RANKS["unknown"]))
