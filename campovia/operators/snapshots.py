"""Snapshots of tables with a log: written whole, listed by what they hold, restored as of any of them.

A snapshot's tables lie under data/<id>/<table>; its entry in the log, written last and as one file that nobody else can have made, is the
commit. What a writer left that died before its entry is never listed. Ids count up by one, so as of an id is a prefix of the log.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campovia.session import _file

LOG = "id long, tenant long, nome string, descricao string, criado_por string, tags map<string,string>, criado_em timestamp, tabelas map<string,long>, pasta string"


def _entries(spark: SparkSession, path: str) -> list[int]:
    fs, log = _file(spark, f"{path}/log")
    return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(log) if f.getPath().getName().endswith(".json")) if fs.exists(log) else []


def _committed(spark: SparkSession, path: str, snapshot_id: int, entry: dict) -> bool:
    """Write the entry under its id, unless another writer has it."""
    fs, own = _file(spark, f"{path}/log/{snapshot_id:020d}.json")
    try:
        out = fs.create(own, False)
    except Exception as error:  # noqa: BLE001 - the store's own class, known by its name alone on this side
        if "FileAlreadyExists" in str(error) or fs.exists(own):
            return False
        raise
    try:
        out.write(bytearray(json.dumps(entry, ensure_ascii=False).encode()))
    finally:
        out.close()
    return True


def save(tables: dict[str, DataFrame], path: str, name: str, tenant: int = 1, description: str | None = None, author: str | None = None, tags: dict[str, str] | None = None) -> int:
    """Freeze tables under the next id, which is returned. Of two writers at once both get an id of their own; a name may come again, the latest counts."""
    if not tables:
        raise ValueError("a snapshot holds at least one table")
    spark = next(iter(tables.values())).sparkSession
    folder = f"{path}/data/{spark._jvm.java.util.UUID.randomUUID()}"
    counts = {}
    for table, df in tables.items():
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/{table}")
        counts[table] = spark.read.schema(df.schema).parquet(f"{folder}/{table}").count()
    entry = {"tenant": tenant, "nome": name, "descricao": description, "criado_por": author, "tags": tags or {}, "tabelas": counts, "pasta": folder}
    while True:
        known = _entries(spark, path)
        number = known[-1] + 1 if known else 1
        if _committed(spark, path, number, {"id": number, "criado_em": datetime.now(timezone.utc).isoformat(), **entry}):
            return number


def listing(spark: SparkSession, path: str, tenant: int | None = None, name: str | None = None, as_of: int | None = None, **tags: str) -> DataFrame:
    """(id, tenant, nome, descricao, criado_por, tags, criado_em, tabelas, pasta), of the log up to as_of; tenant, exact name and tags narrow it. tabelas: rows of each table."""
    if not _entries(spark, path):
        return spark.createDataFrame([], LOG)
    log = spark.read.schema(LOG).json(f"{path}/log")
    for column, value in (("tenant", tenant), ("nome", name)):
        log = log if value is None else log.where(F.col(column) == value)
    for tag, value in tags.items():
        log = log.where(F.col("tags")[tag] == value)
    return log if as_of is None else log.where(F.col("id") <= as_of)


def restore(spark: SparkSession, path: str, table: str, tenant: int | None = None, name: str | None = None, as_of: int | None = None) -> DataFrame:
    """A table as the latest snapshot has it that holds it, of that name and up to as_of; none is an error."""
    found = listing(spark, path, tenant, name, as_of).where(F.map_contains_key("tabelas", table)).agg(F.max_by("pasta", "id").alias("pasta")).first()
    if found.pasta is None:
        raise LookupError(f"no snapshot {'' if name is None else name + ' '}holds {table}")
    return spark.read.parquet(f"{found.pasta}/{table}")


def changes(spark: SparkSession, path: str, table: str, keys: list[str], before: int, after: int) -> DataFrame:
    """(keys, mudanca): rows new, gone or changed between two snapshots of a table with unique keys."""
    old, new = (restore(spark, path, table, as_of=i) for i in (before, after))
    rest = [c for c in new.columns if c not in keys]
    o, n = old.select(*keys, F.struct(F.lit(1), *rest).alias("_o")), new.select(*keys, F.struct(F.lit(1), *rest).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "nova").when(F.col("_n").isNull(), "removida").when(~F.col("_o").eqNullSafe(F.col("_n")), "alterada")
    return o.join(n, keys, "full").select(*keys, kind.alias("mudanca")).where("mudanca IS NOT NULL")
