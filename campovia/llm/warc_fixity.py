"""WARC records and their fixity: Merkle trees over records and offset ranges, and an audit of replicas."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.session import durable

#: Children of an inner node, records of a file on average, and files for pages without an id.
FANOUT, FILE_RECORDS, UNNUMBERED = 16, 4096, 65_536


def record_bytes(url: Column, payload: Column) -> Column:
    """One WARC response record as bytes: header lines, a blank line, the payload, two line breaks."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def file_of(number: Column, url: Column, file_records: int) -> Column:
    """The file of a page: runs of file_records ids. Pages without an id are dealt by their url to UNNUMBERED files below all others that ids from 0 on have."""
    return F.coalesce(F.floor(number / file_records).cast("long"), -1 - F.pmod(F.xxhash64(url), F.lit(UNNUMBERED)))


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, record, data): each page as a WARC record; a file's records are numbered from 0 in order of id, then of their SHA-256.

    Null urls and pages are empty ones. Repeated rows are records each. Other columns are not read.
    """
    file = file_of(F.col(id_col), F.col(url_col), file_records)
    rows = pages.select(F.col(id_col).alias("id"), file.alias("file"), record_bytes(F.col(url_col), F.col(html_col)).alias("data"))
    order = Window.partitionBy("file").orderBy("id", F.sha2("data", 256))
    numbered = rows.withColumn("record", (F.row_number().over(order) - 1).cast("long"))
    return numbered.select("file", "record", "data")


def laid_out(rows: DataFrame, order: list[str]) -> DataFrame:
    """Leaves of rows (file, size, hash, ...): node numbers and offset ranges in the given order within each file."""
    within = Window.partitionBy("file").orderBy(*order)
    stop = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("node", (F.row_number().over(within) - 1).cast("long")).withColumn("stop", stop)
    return placed.withColumn("start", F.col("stop") - F.col("size")).drop("size")


def leaves_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, node, start, stop, hash, id): the leaves of the records that to_records makes; bytes are hashed in the scan and go no further."""
    data = record_bytes(F.col(url_col), F.col(html_col))
    file = file_of(F.col(id_col), F.col(url_col), file_records)
    rows = pages.select(F.col(id_col).alias("id"), file.alias("file"), F.octet_length(data).cast("long").alias("size"), F.sha2(data, 256).alias("hash"))
    return laid_out(rows, ["id", "hash"])


def leaves_of_records(records: DataFrame) -> DataFrame:
    """(file, node, start, stop, hash) of records (file, record, data); null data is a record of no bytes."""
    data = F.coalesce("data", F.lit(b""))
    rows = records.select("file", "record", F.octet_length(data).cast("long").alias("size"), F.sha2(data, 256).alias("hash"))
    return laid_out(rows, ["record", "hash"]).drop("record")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: FANOUT children by node number; a parent hashes its children's ranges and hashes in order."""
    child = F.struct("node", "start", "stop", "hash")
    grouped = nodes.groupBy("file", F.floor(F.col("node") / FANOUT).alias("parent")).agg(F.array_sort(F.collect_list(child)).alias("kids"))
    line = F.transform("kids", lambda k: F.concat_ws(" ", k["start"].cast("string"), k["stop"].cast("string"), k["hash"]))
    return grouped.select(
        "file", F.col("parent").alias("node"), F.array_min("kids.start").alias("start"), F.array_max("kids.stop").alias("stop"), F.sha2(F.array_join(line, "\n"), 256).alias("hash")
    )


def levels_for(records: int) -> int:
    """Levels above the leaves of a tree of so many records."""
    levels = 1
    while FANOUT**levels < records:
        levels += 1
    return levels


def merkle(leaf_rows: DataFrame, levels: int) -> list[DataFrame]:
    """All levels of every file's tree, leaves first, single roots last. Each level is written once, so that none is made again for the one above or for an audit."""
    tree = [leaf_rows]
    for _ in range(levels):
        tree.append(durable(parents(tree[-1])))
    return tree


def audit(leaves_a: DataFrame, leaves_b: DataFrame, file_records: int = FILE_RECORDS) -> tuple[DataFrame, DataFrame]:
    """Where two replicas' records differ, and the roots of the first.

    Both sides are leaves, with node numbers unique in a file. Each file's records and their ordered offset ranges are hashed into a tree
    of FANOUT children a node; roots are compared first, and only below nodes that differ are the children compared,
    down to the records. Returns (file, node, fault, a_start, a_stop, b_start, b_stop) and (file, root). fault is
    altered (other bytes), moved (the same bytes at other offsets), missing_in_a or missing_in_b; a record whose
    offsets another one's fault shifts is moved. Equal replicas and empty ones give no faults. Every level of the trees, and of the descent,
    is written when this is called; leaves are read once for each use, so they had better be written too.
    """
    most = max(x.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0] for x in (leaves_a, leaves_b)) + 1
    levels = levels_for(max(most, file_records))
    trees = [merkle(x, levels) for x in (leaves_a, leaves_b)]
    wrong: DataFrame | None = None
    for level in range(levels, -1, -1):
        a, b = (t[level] for t in trees)
        if wrong is not None:  # children of the nodes that differ
            up = wrong.select("file", F.col("node").alias("up"))
            a, b = (x.withColumn("up", F.floor(F.col("node") / FANOUT)).join(up, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        left = a.select("file", "node", F.struct("start", "stop", "hash").alias("a"))
        right = b.select("file", "node", F.struct("start", "stop", "hash").alias("b"))
        wrong = durable(left.join(right, ["file", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))))
    fault = (
        F.when(F.col("a").isNull(), "missing_in_a").when(F.col("b").isNull(), "missing_in_b").when(F.col("a.hash") == F.col("b.hash"), "moved").otherwise("altered")
    )
    found = wrong.select(
        "file", "node", fault.alias("fault"),
        F.col("a.start").alias("a_start"), F.col("a.stop").alias("a_stop"), F.col("b.start").alias("b_start"), F.col("b.stop").alias("b_stop"),
    )
    return found, trees[0][levels].select("file", F.col("hash").alias("root"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write (file, record, data) as Parquet rows (file, warc): each file's records, UTF-8 as to_records makes them, joined in order."""
    joined = records.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("record", "data"))).alias("rows"))
    joined.select("file", F.array_join(F.transform("rows.data", lambda d: d.cast("string")), "").cast("binary").alias("warc")).write.parquet(path)


def read_warc(files: DataFrame) -> DataFrame:
    """(file, record, data) of rows (file, warc): records are parted by their Content-Length; bytes that end short are a last, shorter record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, warc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, parts = 0, []
                while warc and at < len(warc):
                    blank = warc.find(b"\r\n\r\n", at)
                    size = re.search(rb"Content-Length: *(\d+)", warc[at : blank if blank >= 0 else len(warc)], re.IGNORECASE)
                    stop = blank + 4 + int(size[1]) + 4 if blank >= 0 and size else len(warc)
                    parts.append(warc[at:stop])
                    at = stop
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), batch.column(0).type), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["file", "record", "data"])

    kind = files.schema["file"].dataType.simpleString()
    return files.select("file", "warc").mapInArrow(run, f"file {kind}, record long, data binary")


ORACLE_SQL = """
WITH pair AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
      || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS data FROM pages),
rows_of AS (
  SELECT page_id, CAST(coalesce(floor(page_id / 4096), -1) AS BIGINT) AS file, strlen(data) AS size, sha256(data) AS sha256 FROM pair),
l0 AS (
  SELECT page_id, file, row_number() OVER w - 1 AS record, CAST(sum(size) OVER w AS BIGINT) AS stop, size, sha256
  FROM rows_of WINDOW w AS (PARTITION BY file ORDER BY page_id, sha256 ROWS UNBOUNDED PRECEDING)),
l1 AS (
  SELECT file, record // 16 AS node, min(stop - size) AS start, max(stop) AS stop,
    sha256(string_agg(CAST(stop - size AS VARCHAR) || ' ' || CAST(stop AS VARCHAR) || ' ' || sha256, chr(10) ORDER BY record)) AS hash FROM l0 GROUP BY ALL),
l2 AS (
  SELECT file, node // 16 AS up, min(start) AS start, max(stop) AS stop,
    sha256(string_agg(CAST(start AS VARCHAR) || ' ' || CAST(stop AS VARCHAR) || ' ' || hash, chr(10) ORDER BY node)) AS hash FROM l1 GROUP BY ALL),
l3 AS (
  SELECT file, sha256(string_agg(CAST(start AS VARCHAR) || ' ' || CAST(stop AS VARCHAR) || ' ' || hash, chr(10) ORDER BY up)) AS root FROM l2 GROUP BY ALL)
SELECT page_id, file, record, CAST(stop - size AS BIGINT) AS start, stop, sha256, root,
  CASE WHEN page_id % 97 = 13 THEN 'altered' END AS fault
FROM l0 JOIN l3 USING (file)
"""
