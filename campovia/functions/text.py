"""Address, city and name normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and patterns that results depend on.
NULL_WORDS = ("nan", "none", "null", "<na>", "nat")
TRUNCATED = {
    "pereira verguei": "pereira vergueiro",
    "elisio t leite": "elisio teixeira leite",
    "manel l americ": "maria luiza americo",
    "yervant kissaji": "yervant kissajian",
    "fiorelli pecciaca": "fiorelli pecciaccia",
    "arm de a pere": "armando de arruda pereira",
    "jacu pessego": "jacu-pessego",
    "fernando m de alme": "fernando mendes de almeida",
    "nogue": "nogueira",
    "verg": "vergueiro",
    "alm psarg": "alameda passageiro",
}
ABBREVIATIONS = {
    r"\bav\b": "avenida", r"\bav.\b": "avenida", r"\bavd\b": "avenida", r"\bavd.\b": "avenida", r"\bave\b": "avenida", r"\bavda\b": "avenida", r"\bavn\b": "avenida",
    r"\bal\b": "alameda", r"\bal.\b": "alameda", r"\br\b": "rua", r"\br.\b": "rua", r"\btrav\b": "travessa", r"\btv\b": "travessa",
    r"\brod\b": "rodovia", r"\brotv\b": "rodovia", r"\bpc\b": "praca", r"\bpr\b": "praca", r"\bjd\b": "jardim", r"\bjrd\b": "jardim",
    r"\bvil\b": "vila", r"\bvl\b": "vila", r"\bpq\b": "parque", r"\bpk\b": "parque", r"\bdr\b": "doutor", r"\bdra\b": "doutora",
    r"\bprof\b": "professor", r"\bprofa\b": "professora", r"\beng\b": "engenheiro", r"\bara\b": "arquiteto", r"\bdep\b": "deputado", r"\bver\b": "vereador",
    r"\bbl\b": "bloco", r"\bap\b": "apartamento", r"\bsl\b": "sala", r"\bcs\b": "casa", r"\bgalp\b": "galpao", r"\bkm\b": "quilometro",
}
STREET_PREFIXES = {
    "AV": "AVENIDA", "R": "RUA", "ROD": "RODOVIA", "AL": "ALAMEDA", "EST": "ESTRADA", "TRAV": "TRAVESSA", "PCA": "PRACA", "PC": "PRACA",
}
COMPLEMENTS = "Bloco|Bl|Loja|Lj|Sala|Sl|Apto|Apt|Cj|Conj|Andar|Fundos|Casa|Galpao|Quadra"
LOCAL_COMPLEMENTS = "Bloco|Bl|Loja|Lj|Sala|Sl|Apto|Apt|Cj|Conj"
LOCAL_STREET_TYPES = r"Alameda|Avenida|Rua|Travessa|Rodovia|Estrada|Av\.?|R\.?"
CITY_ALIASES = {("SANTANA DE PARNAI", "SP"): "SANTANA DE PARNAIBA", ("SANTANA DE PARNAIBA", "SP"): "SANTANA DE PARNAIBA"}
NO_NUMBER = ("0", "SN", "S/N", "SEM NUMERO", "SEM NÚMERO")
NO_STREET = "Endereco nao informado"
INVISIBLE = "[​-‍﻿]"
ACCENTED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ", "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"
CITY_PATTERNS = (
    (r",\s*([^,]+?)\s*-\s*([A-Za-z]{2})\s*(?:,|$)"),
    (r"([^,]+)\s*-\s*([A-Z]{2})"),
    (r"([^,]+),\s*([A-Z]{2})"),
    (r"([A-Za-zÀ-ÿ\s]+)\s+([A-Z]{2})$"),
)


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def replaced(c: Column, pattern: str, by: str) -> Column:
    """regexp_replace with a literal pattern."""
    return F.regexp_replace(c, pattern, by)


def null_sentinels(c: Column) -> Column:
    """Blank text and the words that other tools write for missing values become null."""
    return F.when((F.trim(c) == "") | F.lower(F.trim(c)).isin(*NULL_WORDS), F.lit(None)).otherwise(c)


@F.pandas_udf(T.StringType())
def fix_encoding(values: pd.Series) -> pd.Series:
    """UTF-8 read as Latin-1 is read again, control characters go, the rest is composed (NFC) and trimmed."""

    def one(s):
        if s is None:
            return None
        try:
            s = s.encode("latin1").decode("utf-8")
        except UnicodeError:
            pass
        return unicodedata.normalize("NFC", "".join(ch for ch in s if ord(ch) >= 32)).strip()

    return values.map(one)


def without_controls(c: Column) -> Column:
    """The JVM-side part of fix_encoding, exact for text that was read right: control characters go, ends are trimmed."""
    return F.trim(replaced(c, r"[\x00-\x1f]", ""))


def unaccented(c: Column) -> Column:
    """Portuguese letters without their accents; other characters stay."""
    return F.translate(c, ACCENTED, PLAIN)


@F.pandas_udf(T.StringType())
def ascii_only(values: pd.Series) -> pd.Series:
    """Compatibility decomposition with everything beyond ASCII dropped."""
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii"))


@F.pandas_udf(T.StringType())
def without_marks(values: pd.Series) -> pd.Series:
    """Compatibility decomposition with combining marks dropped."""
    return values.map(lambda s: None if s is None else "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)))


@F.pandas_udf(T.StringType())
def title_after_any_break(values: pd.Series) -> pd.Series:
    """A capital after every non-letter, small letters elsewhere."""
    return values.map(lambda s: None if s is None else s.title())


def tidied(c: Column) -> Column:
    """Trimmed, spaces and commas single, no comma at either end."""
    return replaced(replaced(replaced(F.trim(c), r"\s{2,}", " "), r",\s*,", ", "), r"^\s*,|\s*,\s*$", "")


def base_address(c: Column, drop_invisible: bool = True) -> Column:
    """White space single, ", " after commas, a closing "Brasil" dropped; null is empty."""
    s = F.trim(_text(c))
    s = replaced(s, INVISIBLE, "") if drop_invisible else s
    s = replaced(replaced(s, r"\s+", " "), r"\s*,\s*", ", ")
    return F.trim(replaced(s, r"(?i),?\s*Brasil$", ""))


def digits(c: Column) -> Column:
    """The decimal digits alone."""
    return replaced(c, "[^0-9]", "")


def cache_address(c: Column, cep: Column | None = None, drop_invisible: bool = True) -> Column:
    """The canonical key of an address: base form, no accents, upper case, A-Z 0-9 space comma hyphen; with a valid postcode appended."""
    s = replaced(F.upper(unaccented(base_address(c, drop_invisible))), r"[^A-Z0-9 ,\-]", "")
    if cep is not None:
        code = digits(_text(cep))
        s = F.when(F.length(code) == 8, F.concat(s, F.lit(" | CEP:"), code)).otherwise(s)
    return F.when(_text(c) == "", F.lit("")).otherwise(tidied(s))


def untruncated(c: Column) -> Column:
    """Lower case, known truncations completed one after another (a completed word may match again)."""
    s = F.lower(c)
    for short, full in TRUNCATED.items():
        s = F.replace(s, F.lit(short), F.lit(full))
    return s


def capitalised(c: Column) -> Column:
    """Each word between single spaces with a capital first and small letters after."""
    return F.initcap(F.lower(F.trim(replaced(c, r"\s+", " "))))


def saints(c: Column) -> Column:
    """Sta and Sto in full."""
    return replaced(replaced(c, r"\bSta\b", "Santa"), r"\bSto\b", "Santo")


def geocoding_address(c: Column) -> Column:
    """The form for geocoders: truncations completed, capitals, saints in full, each complement dropped with its next word."""
    s = saints(capitalised(untruncated(base_address(c))))
    return F.when(_text(c) == "", F.lit("")).otherwise(tidied(replaced(s, rf"(?i)\b({COMPLEMENTS})\s*\w*", "")))


def local_geocoding_address(c: Column) -> Column:
    """The local geocoder's form: a leading street type is dropped, and everything from a complement on."""
    s = saints(title_after_any_break(untruncated(base_address(c, drop_invisible=False))))
    s = replaced(s, r"\bS\b", "São")
    s = replaced(s, rf"(?i)^(?:{LOCAL_STREET_TYPES})\s+", "")
    return F.when(_text(c) == "", F.lit("")).otherwise(tidied(replaced(s, rf"(?i)\b({LOCAL_COMPLEMENTS})\b.*$", "")))


def expanded(c: Column) -> Column:
    """Abbreviations in full, rule after rule (a point in a rule stands for any character)."""
    for pattern, full in ABBREVIATIONS.items():
        c = replaced(c, pattern, full)
    return c


def full_address(c: Column) -> Column:
    """Lower case, no accents, truncations completed, abbreviations in full, single spaces."""
    return F.trim(replaced(expanded(untruncated(unaccented(F.lower(F.trim(_text(c)))))), r"\s+", " "))


def street(c: Column) -> Column:
    """Upper case with a leading abbreviated street type in full."""
    s = F.upper(F.trim(_text(c)))
    for short, full in STREET_PREFIXES.items():
        s = replaced(s, rf"^{short}\.?\s+", f"{full} ")
    return F.trim(replaced(s, r"\s+", " "))


def canonical_address(logradouro: Column, numero: Column, cidade: Column, uf: Column) -> Column:
    """STREET NUMBER, CITY - UF."""
    joined = F.concat(street(logradouro), F.lit(" "), F.trim(_text(numero)), F.lit(", "), F.upper(F.trim(_text(cidade))), F.lit(" - "), F.upper(F.trim(_text(uf))))
    return F.trim(replaced(F.replace(joined, F.lit(" ,"), F.lit(",")), r"\s+", " "))


def cache_key(logradouro: Column, numero: Column, cidade: Column, uf: Column) -> Column:
    """The canonical address as a cache key."""
    return cache_address(canonical_address(logradouro, numero, cidade, uf))


def city_name(c: Column) -> Column:
    """Upper case without accents; anything but letters, digits and spaces is a space."""
    return F.trim(replaced(replaced(F.upper(unaccented(_text(c))), "[^A-Z0-9 ]", " "), r"\s+", " "))


def place_name(c: Column) -> Column:
    """A name for polygon keys: separators are spaces, closing punctuation goes; blank is null."""
    s = unaccented(replaced(F.trim(c), INVISIBLE, ""))
    s = F.replace(F.replace(F.replace(s, F.lit("/"), F.lit(" ")), F.lit(" - "), F.lit(" ")), F.lit("-"), F.lit(" "))
    s = F.trim(F.upper(replaced(replaced(s, r"[.,;:]+$", ""), r"\s+", " ")))
    return F.when(s == "", F.lit(None)).otherwise(s)


def state_key(c: Column) -> Column:
    """The first word of two letters, or null."""
    found = F.regexp_extract(place_name(c), r"\b([A-Z]{2})\b", 1)
    return F.when(found == "", F.lit(None)).otherwise(found)


def city_key(cidade: Column, uf: Column) -> Column:
    """The city's name without its state's letters, aliases resolved; null if nothing is left."""

    def named(cell: Column) -> Column:
        name, state = cell["name"], cell["state"]
        bare = F.trim(F.regexp_replace(name, F.concat(F.lit(r"\b"), state, F.lit(r"\b")), F.lit("")))
        s = F.coalesce(F.trim(replaced(bare, r"\s+", " ")), name)
        return F.struct(s.alias("name"), state.alias("state"))

    def resolved(cell: Column) -> Column:
        s = cell["name"]
        for (alias, of), full in CITY_ALIASES.items():
            s = F.when((cell["name"] == alias) & (cell["state"] == of), full).otherwise(s)
        return F.when(s == "", F.lit(None)).otherwise(s)

    # One-element arrays name the parts once, so that their expressions are not written out again at each use.
    cells = F.array(F.struct(place_name(cidade).alias("name"), state_key(uf).alias("state")))
    return F.get(F.transform(F.transform(cells, named), resolved), F.lit(0))


def street_and_number(c: Column) -> tuple[Column, Column]:
    """A number of one to six digits at the end is parted from its street; else the number is null."""
    s, pattern = F.trim(c), r"^(.*?)(?:\s*,?\s*)(\d{1,6})$"
    hit = s.rlike(pattern)
    return F.when(hit, F.trim(F.regexp_extract(s, pattern, 1))).otherwise(s), F.when(hit, F.regexp_extract(s, pattern, 2))


def house_number(c: Column) -> Column:
    """Empty for the ways of writing "no number"."""
    s = F.upper(F.trim(_text(c)))
    return F.when(s.isin(*NO_NUMBER), "").otherwise(s)


def district(bairro: Column, cidade: Column) -> Column:
    """A district without its city's name after a space at the end."""
    name, city = F.trim(_text(bairro)), F.trim(_text(cidade))
    ends = (city != "") & F.endswith(F.upper(name), F.concat(F.lit(" "), F.upper(city)))
    return F.when(ends, F.trim(F.substring(name, F.lit(1), F.length(name) - F.length(city) - 1))).otherwise(name)


def city_and_state(c: Column) -> tuple[Column, Column]:
    """City and state letters by the first pattern that fits; nulls if none does."""
    found = [F.when(c.rlike(p), F.struct(F.trim(F.regexp_extract(c, p, 1)).alias("city"), F.trim(F.regexp_extract(c, p, 2)).alias("state"))) for p in CITY_PATTERNS]
    best = F.coalesce(*found)
    return best["city"], best["state"]


def contains_all(c: Column, terms: list[str]) -> Column:
    """Case-insensitive: every term is contained; no terms match nothing."""
    hit = F.lit(bool(terms))
    for term in terms:
        hit = hit & c.ilike(f"%{term}%")
    return hit


def display_address(logradouro: Column, numero: Column, bairro: Column, cidade: Column, uf: Column, cep: Column) -> Column:
    """Street and number, district, city and state, postcode joined by " | "; empty parts go, a missing street or number shows its default."""
    part = lambda c: F.trim(_text(c))
    blank = lambda c: F.when(part(c) != "", part(c))
    first = F.concat(F.coalesce(F.trim(logradouro), F.lit(NO_STREET)), F.lit(", "), F.coalesce(blank(numero), F.lit("S/N")))
    return F.concat_ws(" | ", first, blank(bairro), F.concat(_text(cidade), F.lit(" - "), _text(uf)), blank(cep))
