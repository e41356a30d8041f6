"""Chunks sent out and answered later: timeouts, one retry, restarts from the checkpoint, and results merged once."""

import datetime as dt

from campovia.streaming import chunks

MESSAGES = "job string, chunk long, tipo string, ts timestamp, id long"
ANSWERS = "job long, chunk long, ordem long, estrutura string, campo string, valor string"
START = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
# Ten minutes' patience. (job, chunk, kind, minute, id)
STORY = [
    ("a", 1, "pedido", 0, 1), ("a", 1, "resposta", 5, 2), ("a", 1, "resposta", 6, 3),  # answered, then again
    ("a", 2, "pedido", 0, 4), ("a", 2, "resposta", 15, 5),  # answered at the second attempt
    ("a", 3, "pedido", 0, 6),  # never answered
    ("a", 4, "pedido", 1, 7), ("a", 4, "resposta", 30, 8),  # answered when all is over
    ("b", 1, "resposta", 3, 9), ("b", 1, "pedido", 2, 10),  # the answer comes first
    ("b", 2, "resposta", 4, 11),  # nobody asked
    ("b", 3, "pedido", 100, 12),  # still waiting at the end
    (None, 1, "pedido", 0, 13), ("b", None, "pedido", 0, 14), ("b", 5, "other", 0, 15), ("b", 6, "pedido", None, 16),  # no messages
    ("z", 1, "pedido", 99, 17), ("z", 1, "resposta", 99, None),
]
WANTED = {
    ("a", 1, "concluido", 1, 5, 2), ("a", 2, "repetir", 2, 10, None), ("a", 2, "concluido", 2, 15, 5), ("a", 3, "repetir", 2, 10, None), ("a", 3, "falhou", 2, 20, None),
    ("a", 4, "repetir", 2, 11, None), ("a", 4, "falhou", 2, 21, None), ("b", 1, "concluido", 1, 3, 9), ("b", 2, "sem_pedido", 0, 4, 11), ("z", 1, "concluido", 1, 99, -1),
}


def run(spark, folder, batches):
    """The outcomes after each batch is a file of its own, read by a query started anew from the same checkpoint."""
    told = []
    for n, batch in enumerate(batches):
        rows = [(j, c, k, None if m is None else START + dt.timedelta(minutes=m), i) for j, c, k, m, i in batch]
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = chunks.chunk_outcomes(spark.readStream.schema(MESSAGES).parquet(f"{folder}/in"), "ts", 600, late="5 minutes")
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        told = spark.read.schema(chunks.OUTCOME).parquet(f"{folder}/out").collect()
    minute = START.timestamp() * 1e6
    rows = [(r.job, r.chunk, r.situacao, r.tentativa, round((r.em_us - minute) / 6e7), r.resposta) for r in told]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_outcomes_in_one_batch(spark, tmp_path):
    assert run(spark, tmp_path, [STORY]) == WANTED


def test_a_restart_goes_on_where_it_stopped(spark, tmp_path):
    """Cut at the fourth, sixth and tenth minute, with copies of old messages at the end."""
    by = lambda low, high: [m for m in STORY if m[3] is not None and low <= m[3] < high]
    last = [("a", 1, "resposta", 97, 40), ("b", 1, "pedido", 98, 41)]
    assert run(spark, tmp_path, [by(0, 4), by(4, 6), by(6, 40), by(40, 200), last]) == WANTED


def test_no_messages(spark, tmp_path):
    assert run(spark, tmp_path, [[(None, None, None, None, None)]]) == set()


def test_answers_of_every_kind_are_merged_once(spark):
    rows = [
        (1, 2, 0, "list", None, "c"), (1, 1, 0, "list", "x", "a"), (1, 1, 1, "list", None, None), (1, 1, 0, "list", "x", "a"), (2, 1, 0, "list", None, "a"),
        (1, 1, 2, "hash", "f", "old"), (1, 2, 1, "hash", "f", "new"), (1, 2, 2, "hash", "g", None), (1, 1, 3, "set", None, "v"), (1, 2, 3, "set", None, "v"), (1, 2, 4, "set", None, "w"), (1, 9, 9, "zset", None, "q"),
    ]
    got = {tuple(r) for r in chunks.gathered(spark.createDataFrame(rows, ANSWERS)).collect()}
    assert got == {(1, "list", None, 0, "a"), (1, "list", None, 1, None), (1, "list", None, 2, "c"), (2, "list", None, 0, "a"), (1, "hash", "f", None, "new"), (1, "hash", "g", None, None), (1, "set", None, None, "v"), (1, "set", None, None, "w")}
    assert chunks.gathered(spark.createDataFrame([], ANSWERS)).count() == 0


def test_chunks_of_a_stretch_share_their_state(spark, tmp_path):
    """3,000 chunks of two jobs are two rows of state; those of one stretch wait, time out and end apart."""
    many = [("m" if c % 2 else "n", c, "pedido", c % 7, c) for c in range(3000)] + [("m" if c % 2 else "n", c, "resposta", c % 7 + (4 if c % 3 == 1 else 14), 5000 + c) for c in range(3000) if c % 3]
    late = [("z", 1, "pedido", 200, 1)]
    got = run(spark, tmp_path, [many, late])
    name = lambda c: "m" if c % 2 else "n"
    wanted = {(name(c), c, "concluido", 1, c % 7 + 4, 5000 + c) for c in range(3000) if c % 3 == 1}
    wanted |= {(name(c), c, "repetir", 2, c % 7 + 10, None) for c in range(3000) if c % 3 != 1}
    wanted |= {(name(c), c, "concluido", 2, c % 7 + 14, 5000 + c) for c in range(3000) if c % 3 == 2}
    wanted |= {(name(c), c, "falhou", 2, c % 7 + 20, None) for c in range(3000) if c % 3 == 0}
    assert got == wanted
    stream = spark.readStream.schema(MESSAGES).parquet(f"{tmp_path}/in")
    query = chunks.chunk_outcomes(stream, "ts", 600, late="5 minutes").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/again").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 3
