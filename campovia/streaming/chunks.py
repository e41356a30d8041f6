"""Jobs whose chunks are sent out and answered later: a stateful stream of timeouts and retries, and the merging of what came back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from campovia.operators.numbering import numbered

#: Times a chunk is sent: once and once more.
ATTEMPTS = 2
#: Chunk numbers of a job that share a state.
STRETCH = 4096
OUTCOME = "job string, chunk long, situacao string, tentativa int, em_us long, resposta long"
STATE = "chunk array<long>, pedido_us array<long>, tentativa array<int>, decidido array<boolean>, resposta_us array<long>, resposta array<long>, acorda_ms array<long>"


def chunk_outcomes(messages: DataFrame, ts: str, timeout_s: float, late: str = "0 seconds", attempts: int = ATTEMPTS) -> DataFrame:
    """(job, chunk, situacao, tentativa, em_us, resposta): what becomes of each chunk of a stream of messages (job, chunk, tipo, ts, id).

    tipo is pedido or resposta. A chunk that is not answered within timeout_s of event time is sent again (repetir, with the number of the new
    attempt and the time it is due), up to `attempts` times, then it has failed (falhou). An answer in time ends it (concluido, with the
    answer's id). Each chunk ends once: further requests and answers change nothing. An answer that no request comes for within all attempts
    is told as sem_pedido. Time is the messages' own: as long as none is later than `late`, the outcome does not depend on how the
    messages are cut into batches, and a restart from the checkpoint goes on where it stopped. Messages without job, chunk or time are left out.

    Chunks of a job whose numbers are in one stretch of STRETCH share a state, one call and one timeout, the earliest of theirs; each leaves it when its own time is over.
    """
    limit = int(timeout_s * 1_000_000)

    def decide(waiting: list, expired: bool, now: int) -> list[tuple]:
        """What is to be told of a chunk now (waiting: pedido_us, tentativa, decidido, resposta_us, resposta), which it then holds."""
        asked, attempt, settled, came, answer = waiting
        told = []
        while not settled and asked is not None:
            due = asked + attempt * limit
            if came is not None and came <= due:
                told.append(("concluido", attempt, came, answer))
                settled = True
            elif came is None and now < due:
                break
            elif attempt < attempts:
                attempt += 1
                told.append(("repetir", attempt, due, None))
            else:
                told.append(("falhou", attempt, due, None))
                settled = True
        if expired and asked is None:
            told.append(("sem_pedido", 0, came, answer))
            settled = True
        waiting[1:3] = attempt, settled
        return told

    def wake(asked: int | None, attempt: int, settled: bool, came: int | None, answer: int | None) -> int:
        """When a chunk is to be looked at again. What is settled is kept for as long again, so that late copies of its messages change nothing."""
        if asked is None:
            return came + attempts * limit * (2 if settled else 1)
        return asked + (attempt if not settled else 2 * attempts) * limit

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = {chunk: [waiting, at] for chunk, *waiting, at in zip(*state.get)} if state.exists else {}
        touched = set()
        for part in [] if state.hasTimedOut else parts:
            for chunk, kind, at, number in zip(part["chunk"].tolist(), part["tipo"].tolist(), part["us"].tolist(), part["id"].tolist()):
                touched.add(chunk)
                waiting = held.setdefault(chunk, [[None, 1, False, None, None], 0])[0]
                if kind == "pedido":
                    waiting[0] = at if waiting[0] is None else min(waiting[0], at)
                elif waiting[3] is None or (at, number) < (waiting[3], waiting[4]):
                    waiting[3:] = at, number
        rows = []
        for chunk in [c for c, (_, at) in held.items() if c in touched or at < mark]:
            waiting, expired = held[chunk][0], chunk not in touched
            if expired and waiting[2]:
                del held[chunk]
                continue
            rows += [(key[0], chunk, *told) for told in decide(waiting, expired, mark * 1000)]
            held[chunk][1] = max(-(-wake(*waiting) // 1000), mark + 1)
        if held:
            state.update(tuple(list(column) for column in zip(*((chunk, *waiting, at) for chunk, (waiting, at) in held.items()))))
            state.setTimeoutTimestamp(max(min(at for _, at in held.values()), mark + 1))
        else:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["job", "chunk", "situacao", "tentativa", "em_us", "resposta"]).astype({"resposta": "Int64"})

    timed = messages.where(F.col("job").isNotNull() & F.col("chunk").isNotNull() & F.col(ts).isNotNull() & F.col("tipo").isin("pedido", "resposta")).withWatermark(ts, late)
    rows = timed.select(F.col("job").cast("string").alias("job"), F.col("chunk").cast("long").alias("chunk"), "tipo", ts, F.unix_micros(ts).alias("us"), F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("id"))
    stretched = rows.withColumn("_stretch", F.floor(F.col("chunk") / STRETCH))
    return stretched.groupBy("job", "_stretch").applyInPandasWithState(step, OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def gathered(results: DataFrame) -> DataFrame:
    """(job, estrutura, campo, posicao, valor): what the chunks of each job left, merged by the kind of their answer.

    results: (job, chunk, ordem, estrutura, campo, valor), a row told again counts once, the least of different ones. list: all values, by
    chunk and order within it, at positions from 0; hash: the last value of each field; set: each different value once. Other kinds are
    left out. Positions are counted by ranges, so that a job may hold any share of all rows.
    """
    once = results.where("estrutura IN ('list', 'hash', 'set')").groupBy("job", "estrutura", "chunk", "ordem").agg(F.min(F.struct("campo", "valor")).alias("_v")).select("job", "estrutura", "chunk", "ordem", "_v.campo", "_v.valor")
    listed = numbered(once.where("estrutura = 'list'"), ["job", "chunk", "ordem"], "_n")
    first = listed.groupBy("job").agg(F.min("_n").alias("_first"))
    no = F.lit(None)
    rows = listed.join(first, "job").select("job", "estrutura", no.cast("string").alias("campo"), (F.col("_n") - F.col("_first")).alias("posicao"), "valor")
    fields = once.where("estrutura = 'hash'").groupBy("job", "estrutura", "campo").agg(F.max_by("valor", F.struct("chunk", "ordem")).alias("valor"))
    values = once.where("estrutura = 'set'").select("job", "estrutura", "valor").distinct()
    return rows.unionByName(fields.select("job", "estrutura", "campo", no.cast("long").alias("posicao"), "valor")).unionByName(values.select("job", "estrutura", no.cast("string").alias("campo"), no.cast("long").alias("posicao"), "valor"))
