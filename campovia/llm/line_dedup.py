"""Line deduplication by repeated windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campovia.llm.columns import carried, laid_out
from campovia.session import durable

BREAK = "\n"
#: Anything but ASCII white space.
TEXT = r"[^ \t\n\x0B\f\r]"


def line_windows(docs: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """(doc, print, at, h1, h2): every window of span consecutive lines with its place and a 128-bit hash."""
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("print"), F.split(text_col, BREAK, -1).alias("lines"))
    long_enough = lines.where(F.size("lines") >= span)

    def window(at):
        own = [F.get("lines", at + k) for k in range(span)]
        text = F.concat(*own).rlike(TEXT)
        return F.struct(at.alias("at"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(span), *reversed(own)).alias("h2"), text.alias("text"))

    windows = F.transform(F.sequence(F.lit(0), F.size("lines") - span), window)
    flat = long_enough.select("doc", "print", F.explode(windows).alias("w"))
    return flat.where("w.text").select("doc", "print", "w.at", "w.h1", "w.h2")


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3) -> DataFrame:
    """docs with later occurrences of repeated line windows cut out of text, and a column removed_lines.

    Every run of span consecutive lines (overlapping; lines as they are, parted at line feeds) is hashed; a hash that occurs more
    than once anywhere in the table is a repetition. Its first occurrence, by id and then by place in the text, stays; every later one
    is marked. The lines that marked windows cover together are removed, but for those that the first occurrence of a repeated
    window covers too: of a text of five equal lines three stay, for later windows overlap the first.
    Windows of ASCII white space alone never count: they hold no text, almost every document has the same ones between its
    paragraphs, and to cut them would join paragraphs. Texts of fewer lines than span are left alone, a text of which every line
    is removed becomes empty, and a null text stays null with removed_lines 0.

    Rows with a null id come last in the order. Rows that share an id are told apart by their texts; rows equal in
    both are one document: they keep or lose the same lines. All columns of docs are kept under their
    names, whatever these are; only one called removed_lines is replaced. An empty table gives an empty result. The windows are
    written when this is called.
    """
    windows = durable(line_windows(docs, id_col, text_col, span))
    where = F.struct(F.col("doc").isNull().alias("last"), "doc", "print", "at")
    firsts = windows.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(where).alias("first")).where("times > 1").drop("times")
    repeated = windows.join(firsts, ["h1", "h2"]).select("doc", "print", "at", where.eqNullSafe(F.col("first")).alias("first"))
    starts = repeated.groupBy("doc", "print").agg(F.collect_set(F.when(~F.col("first"), F.col("at"))).alias("later"), F.collect_set(F.when(F.col("first"), F.col("at"))).alias("first"))
    covered = lambda at: F.flatten(F.transform(at, lambda i: F.sequence(i, i + span - 1)))
    marked = starts.select("doc", "print", F.array_except(covered("later"), covered("first")).alias("gone")).where("size(gone) > 0")
    rest = [c for c in docs.columns if c not in (text_col, "removed_lines")]
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("body"), carried(rest).alias("rest"))
    joined = own.join(marked, F.col("id").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("print")), "left")
    lines = F.split("body", BREAK, -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    changed = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), BREAK))
    gone = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    done = joined.select("rest", changed.alias("body"), gone.cast("long").alias("count"))
    back = laid_out("rest", rest) | {text_col: F.col("body").alias(text_col)}
    return done.select(*[back[c] for c in docs.columns if c != "removed_lines"], F.col("count").alias("removed_lines"))


ORACLE_SQL = """
WITH split_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM split_lines),
windows AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3, count(*) OVER (PARTITION BY doc_id) - pos AS ahead
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER v AS nth, count(*) OVER (PARTITION BY line, line2, line3) AS times
  FROM windows WHERE ahead >= 3 AND regexp_matches(line || line2 || line3, '[^ \\t\\n\\x0B\\f\\r]')
  WINDOW v AS (PARTITION BY line, line2, line3 ORDER BY doc_id, pos)),
covered AS (SELECT doc_id, pos + k AS pos, min(nth) AS nth FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY ALL),
gone AS (SELECT doc_id, pos FROM covered WHERE nth > 1),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS removed_lines FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(c.removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id)
"""
