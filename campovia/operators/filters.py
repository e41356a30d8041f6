"""Filters, validation splits and schema checks."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Other names of optional columns, and the columns that a cleaned table keeps.
COLUMN_ALIASES = {
    "janela_atendimento_inicio": ("janela_inicio", "horario_inicio", "janela_ini", "janela_atendimento_ini", "horario_atendimento_inicio", "abertura", "inicio_atendimento"),
    "janela_atendimento_fim": ("janela_fim", "horario_fim", "janela_atendimento_fim", "horario_atendimento_fim", "fechamento", "fim_atendimento"),
    "tempo_atendimento_min": ("tempo_atendimento", "service_min", "tempo_servico", "tempo_visita", "tempo_medio_visita"),
    "is_estrategico": ("estrategico", "pdv_estrategico", "loja_ancora", "estrategica", "is_ancora"),
}
BASE_COLUMNS = ("cnpj", "logradouro", "numero", "bairro", "cidade", "uf", "cep")
OPTIONAL_COLUMNS = ("pdv_vendas", "razao_social", "nome_fantasia", "janela_atendimento_inicio", "janela_atendimento_fim", "tempo_atendimento_min", "is_estrategico")
ZONE = "America/Sao_Paulo"


def all_of(conditions: list[Column | None]) -> Column:
    """All conditions that are given; none of them is no filter."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def equals_ignoring_case(c: Column, value: str | None) -> Column | None:
    """Case-insensitive equality, or no condition without a value."""
    return None if value is None else F.upper(c) == value.upper()


def one_of(c: Column, values: list | str | None) -> Column | None:
    """Membership in a list or equality with one value; no condition without any."""
    return None if values is None else c.isin(*([values] if isinstance(values, str) else values))


def any_contains(columns: list[Column], term: str | None) -> Column | None:
    """The term is in any of the columns, in any case."""
    return None if not term else reduce(lambda a, b: a | b, [c.ilike(f"%{term}%") for c in columns])


def situation(active: Column, review: Column, which: str | None) -> Column | None:
    """ativo: active and not to be reviewed; revisar: active and to be reviewed; inativo: not active. Unknown flags count as false."""
    on, doubt = F.coalesce(active, F.lit(False)), F.coalesce(review, F.lit(False))
    return {None: None, "ativo": on & ~doubt, "revisar": on & doubt, "inativo": ~on}[which]


def on_days(ts: Column, first: str | None, last: str | None) -> Column:
    """The timestamp's date lies between two dates, both included."""
    return all_of([None if first is None else F.to_date(ts) >= F.lit(first).cast("date"), None if last is None else F.to_date(ts) <= F.lit(last).cast("date")])


def in_local_days(ts: Column, first: str | None, last: str | None) -> Column:
    """A UTC timestamp in local days: from the first day's start to before the day after the last."""
    start = None if first is None else ts >= F.to_utc_timestamp(F.lit(f"{first} 00:00:00").cast("timestamp"), ZONE)
    end = None if last is None else ts < F.to_utc_timestamp(F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"), ZONE)
    return all_of([start, end])


def missing_reasons(required: list[str], prefix: str = "campo_obrigatorio_") -> Column:
    """Codes of the required columns that are blank, in their order, joined by |; empty if none is."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    return F.concat_ws("|", *[F.when(blank(c), F.lit(prefix + c)) for c in required])


def split_required(df: DataFrame, required: list[str], reason: str = "motivo_invalidade") -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns filled, and the others with their reasons."""
    judged = df.withColumn(reason, missing_reasons(required))
    return judged.where(F.col(reason) == "").drop(reason), judged.where(F.col(reason) != "")


def assert_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """df, or an error that lists the columns it lacks."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_bad_rows(df: DataFrame, bad: Column, row: str, shown: int = 10, offset: int = 2) -> list[int]:
    """The sheet's row numbers (row counts from 0, the header is line 1) of the first bad rows; at most `shown`."""
    found = df.where(bad).select(row).orderBy(row).limit(shown).collect()
    return [r[0] + offset for r in found]


def canonical_name(name: str) -> str:
    """Small letters without accents, no parentheses, words joined by single underscores."""
    s = "".join(ch for ch in unicodedata.normalize("NFKD", name.strip().lower()) if not unicodedata.combining(ch))
    s = re.sub(r"[\s\-]+", "_", re.sub(r"\([^)]*\)", "", s).strip())
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "", s)).strip("_")


def canonical_columns(df: DataFrame) -> DataFrame:
    """Columns under canonical names; an alias is renamed where the canonical column is absent."""
    named = df.toDF(*[canonical_name(c) for c in df.columns])
    for canonical, others in COLUMN_ALIASES.items():
        alias = next((a for a in others if a in named.columns), None)
        if canonical not in named.columns and alias:
            named = named.withColumnRenamed(alias, canonical)
    return named


def known_columns(df: DataFrame) -> DataFrame:
    """The base and optional columns that are there, in their order."""
    return df.select(*[c for c in (*BASE_COLUMNS, *OPTIONAL_COLUMNS) if c in df.columns])


def guard_size(df: DataFrame, most: int | None) -> DataFrame:
    """df, or an error if it has more rows than the limit; no limit by default at scale."""
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df
