"""Administration of the shared address cache: create, upsert, update and delete as merges that compare versions and tell conflicts.

The cache is (id, chave, endereco, lat, lon, origem, versao), with one row an id, a key and an address. Each write returns the new cache and
an answer for each request: (pedido, codigo, motivo, id), by the codes of HTTP: 201 created, 200 changed, 204 deleted, 404 no such id, 409 conflict,
422 no place on the globe. pedido numbers the requests and orders them; of two that want the same thing in one batch the lower one wins and the
other is a conflict, to be sent again on what is now there. Nothing is lost silently: every request has exactly one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.functions.geo import sane
from campovia.functions.text import cache_key, canonical_address
from campovia.operators.numbering import numbered
from campovia.session import durable

COLUMNS = ("id", "chave", "endereco", "lat", "lon", "origem", "versao")


def with_address(requests: DataFrame) -> DataFrame:
    """requests with chave and endereco of logradouro, numero, cidade and uf; both null where street, city or state is blank."""
    parts = [F.col(c) for c in ("logradouro", "numero", "cidade", "uf")]
    filled = F.lit(True)
    for c in (parts[0], parts[2], parts[3]):
        filled = filled & F.coalesce(F.trim(c) != "", F.lit(False))
    return requests.withColumns({"chave": F.when(filled, cache_key(*parts)), "endereco": F.when(filled, canonical_address(*parts))})


def _taken(requests: DataFrame, cache: DataFrame, column: str, name: str) -> DataFrame:
    """requests with the id of the cache row that has their value of column, if any. Nulls are told apart by pedido, so that they meet in no one task."""
    held = cache.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.min("id").alias(name))
    return requests.withColumn("_v", F.coalesce(F.col(column), F.concat(F.lit("\0"), F.col("pedido").cast("string")))).join(held, "_v", "left").drop("_v")


def _beaten(value: Column, why: str) -> Column:
    """_why, or why for requests still in the race of which a lower one has the same value; the others stand by themselves."""
    runs = F.col("_why").isNull() & value.isNotNull()
    w = Window.partitionBy(value, runs, F.when(~runs, F.col("pedido"))).orderBy("pedido")
    return F.coalesce("_why", F.when(runs & (F.row_number().over(w) > 1), why))


def _answered(judged: DataFrame) -> DataFrame:
    return judged.select("pedido", F.col("codigo").cast("int").alias("codigo"), "motivo", F.col("id").cast("long").alias("id"))


def create(cache: DataFrame, requests: DataFrame, source: str = "manual_edit") -> tuple[DataFrame, DataFrame]:
    """New rows of requests (pedido, chave, endereco, lat, lon) whose key and address nobody has; they get the ids after the greatest one, by pedido.

    Two requests of one key or one address: the first by pedido is made, the others are conflicts; a request that loses its key does
    not hold its address. motivo: chave, endereco or coordenadas; a blank key is a 422 too.
    """
    asked = _taken(_taken(requests.select("pedido", "chave", "endereco", "lat", "lon"), cache, "chave", "_k"), cache, "endereco", "_e")
    reason = F.when(~sane(F.col("lat"), F.col("lon")), "coordenadas").when(F.col("chave").isNull(), "sem_chave").when(F.col("_k").isNotNull(), "chave").when(F.col("_e").isNotNull(), "endereco")
    judged = asked.withColumn("_why", reason)
    judged = judged.withColumn("_why", _beaten(F.col("chave"), "chave"))
    settled = durable(judged.withColumn("_why", _beaten(F.col("endereco"), "endereco")))
    won = numbered(settled.where("_why IS NULL"), ["pedido"], "_n")
    last = cache.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    made = durable(won.crossJoin(F.broadcast(last)).withColumn("id", (F.col("_last") + F.col("_n") + 1).cast("long")))  # one row on that side
    code = F.when(F.col("_why").isin("coordenadas", "sem_chave"), 422).otherwise(409)
    answers = _answered(made.select("pedido", F.lit(201).alias("codigo"), F.lit(None).cast("string").alias("motivo"), "id")).unionByName(
        _answered(settled.where("_why IS NOT NULL").select("pedido", code.alias("codigo"), F.col("_why").alias("motivo"), F.when(F.col("_why") == "chave", F.col("_k")).when(F.col("_why") == "endereco", F.col("_e")).alias("id")))
    )
    rows = made.select("id", "chave", "endereco", "lat", "lon", F.lit(source).alias("origem"), F.lit(1).cast("long").alias("versao"))
    return cache.select(*COLUMNS).unionByName(rows), answers


def update(cache: DataFrame, requests: DataFrame, source: str = "manual_edit") -> tuple[DataFrame, DataFrame]:
    """Rows changed by requests (pedido, id, versao, chave, endereco, lat, lon), each naming the version that its writer saw.

    A row changes only if its version is still the stated one, and then counts one up: of two writers who saw the same version one wins and the other
    is a 409 versao. A null key leaves key and address alone. A new key or address that another row has, or a lower request
    of the batch takes, is a conflict; keys that the batch itself gives up are free from the next batch on.
    """
    seen = cache.select("id", F.col("versao").alias("_is"))
    asked = requests.select("pedido", "id", F.col("versao").alias("_saw"), "chave", "endereco", "lat", "lon").join(seen, "id", "left")
    asked = _taken(_taken(asked, cache, "chave", "_k"), cache, "endereco", "_e")
    other = lambda c: F.coalesce(F.col(c) != F.col("id"), F.lit(False)) & F.col("chave").isNotNull()
    reason = (
        F.when(~sane(F.col("lat"), F.col("lon")), "coordenadas").when(F.col("_is").isNull(), "id").when(~F.col("_saw").eqNullSafe(F.col("_is")), "versao")
        .when(other("_k"), "chave").when(other("_e"), "endereco")
    )
    judged = asked.withColumn("_why", reason)
    judged = judged.withColumn("_why", _beaten(F.col("id"), "versao"))
    judged = judged.withColumn("_why", _beaten(F.col("chave"), "chave"))
    settled = durable(judged.withColumn("_why", _beaten(F.when(F.col("chave").isNotNull(), F.col("endereco")), "endereco")))
    code = F.when(F.col("_why").isNull(), 200).when(F.col("_why") == "coordenadas", 422).when(F.col("_why") == "id", 404).otherwise(409)
    new = settled.where("_why IS NULL").select("id", F.struct("chave", "endereco", "lat", "lon").alias("_new"))
    both = cache.select(*COLUMNS).join(new, "id", "left")
    hit, renamed = F.col("_new").isNotNull(), F.col("_new.chave").isNotNull()
    pick = lambda c, when: F.when(when, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    after = both.select(
        "id", pick("chave", renamed), pick("endereco", renamed), pick("lat", hit), pick("lon", hit),
        F.when(hit, source).otherwise(F.col("origem")).alias("origem"), (F.col("versao") + hit.cast("int")).cast("long").alias("versao"),
    )
    return after, _answered(settled.select("pedido", code.alias("codigo"), F.col("_why").alias("motivo"), "id"))


def upsert(cache: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places written by key, whatever version is there: requests (pedido, chave, endereco, lat, lon, origem); of several of a key the last by pedido stays.

    Every request of a key that was there is a 200, of a new one a 201; a row counts one version up a batch. Asking again changes nothing but versions.
    """
    ok = sane(F.col("lat"), F.col("lon")) & F.col("chave").isNotNull()
    asked = requests.select("pedido", "chave", "endereco", "lat", "lon", F.coalesce("origem", F.lit("correcao_manual")).alias("origem"), ok.alias("_ok"))
    last = asked.where("_ok").groupBy("chave").agg(F.max(F.struct("pedido", "endereco", "lat", "lon", "origem")).alias("_new"))
    fresh = numbered(last.join(cache.select("chave"), "chave", "left_anti"), ["_new.pedido"], "_n")
    top = cache.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    made = durable(fresh.crossJoin(F.broadcast(top)).select((F.col("_last") + F.col("_n") + 1).cast("long").alias("id"), "chave", "_new.endereco", "_new.lat", "_new.lon", "_new.origem", F.lit(1).cast("long").alias("versao")))
    both = cache.select(*COLUMNS).join(last, "chave", "left")
    hit = F.col("_new").isNotNull()
    kept = both.select("id", "chave", "endereco", *[F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in ("lat", "lon", "origem")], (F.col("versao") + hit.cast("int")).cast("long").alias("versao"))
    told = asked.join(made.select("chave", F.col("id").alias("_made")), "chave", "left").join(cache.select("chave", F.col("id").alias("_had")), "chave", "left")
    code = F.when(~F.col("_ok"), 422).when(F.col("_had").isNotNull(), 200).otherwise(201)
    answers = told.select("pedido", code.alias("codigo"), F.when(F.col("chave").isNull(), "sem_chave").when(~F.col("_ok"), "coordenadas").alias("motivo"), F.when(F.col("_ok"), F.coalesce("_had", "_made")).alias("id"))
    return kept.unionByName(made), _answered(answers)


def delete(cache: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows removed by requests (pedido, id, versao): 404 where no row has the id, 409 where its version is another one; a null version deletes any. Asked twice in a batch, the later is a 404."""
    judged = requests.select("pedido", "id", F.col("versao").alias("_saw")).join(cache.select("id", F.col("versao").alias("_is")), "id", "left")
    reason = F.when(F.col("_is").isNull(), "id").when(F.col("_saw").isNotNull() & (F.col("_saw") != F.col("_is")), "versao")
    judged = judged.withColumn("_why", reason)
    judged = judged.withColumn("_why", _beaten(F.col("id"), "id"))
    gone = judged.where("_why IS NULL").select("id")
    code = F.when(F.col("_why").isNull(), 204).when(F.col("_why") == "id", 404).otherwise(409)
    return cache.select(*COLUMNS).join(gone, "id", "left_anti"), _answered(judged.select("pedido", code.alias("codigo"), F.col("_why").alias("motivo"), "id"))
