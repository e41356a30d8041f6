"""Chat formatting of preference pairs: one shared prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rendered turn is OPEN, role, MIDDLE, text, CLOSE.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str, out: str) -> DataFrame:
    """(pair, out): each pair's turns in order as one array."""
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    return turns.groupBy(F.col(pair_col).alias("pair")).agg(F.array_sort(F.collect_list(turn)).alias(out))


def common_turns(left: Column, right: Column) -> Column:
    """The number of leading turns that agree in role and text."""
    same = F.zip_with(left, right, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    parting = F.array_position(same, False)
    return F.when(parting == 0, F.size(same)).otherwise(parting - 1).cast("int")


def rendered(turn: Column) -> Column:
    """One turn as text."""
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def completion(turns: Column, trained_role: str, name: str) -> list[Column]:
    """The turns as text, and its loss mask in runs "characters:0" or "characters:1".

    Of a turn of the trained role the text and the closing mark are trained; all else is not.
    """
    lead = lambda t: F.length(t["role"]) + len(OPEN) + len(MIDDLE)
    rest = lambda t: F.length(t["text"]) + len(CLOSE)
    runs = F.transform(
        turns,
        lambda t: F.concat_ws(" ", F.concat(lead(t), F.lit(":0")), F.concat(rest(t), F.when(t["role"] == trained_role, ":1").otherwise(":0"))),
    )
    return [F.array_join(F.transform(turns, rendered), "").alias(name), F.array_join(runs, " ").alias(f"{name}_mask")]


def preference_examples(
    chosen: DataFrame,
    rejected: DataFrame,
    pair_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row for each pair: (pair, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask).

    Both inputs hold turns, keyed by pair. The longest common prefix of turns, equal in role and text, is rendered once as the
    prompt; the rest of either side is its completion, with runs of characters that count for the loss (1) or
    not (0). Turns go by turn number (null first), then role and text; repeated turns all count. Null roles
    and texts are empty. A pair that one side lacks is left out: there is nothing to prefer. Null pairs match
    none. A side that is wholly common has an empty completion. Other columns are not read. Empty inputs give an empty
    result. A conversation is one training example, so its turns meet in one row; no other grouping is made.
    """
    names = pair_col, turn_col, role_col, text_col
    both = conversations(chosen, *names, "c").join(conversations(rejected, *names, "r"), "pair")
    parted = both.withColumn("n", common_turns(F.col("c"), F.col("r")))
    tail = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    return parted.select(
        F.col("pair").alias(pair_col),
        F.col("n").alias("prompt_turns"),
        F.array_join(F.transform(F.slice("c", F.lit(1), F.col("n")), rendered), "").alias("prompt"),
        *completion(tail(F.col("c")), trained_role, "chosen"),
        *completion(tail(F.col("r")), trained_role, "rejected"),
    )


ORACLE_SQL = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
closing AS (SELECT conv_id, text AS last_text FROM nth WHERE i = n),
rejected AS (
  SELECT a.conv_id, a.role, CASE WHEN a.i = a.n THEN coalesce(b.last_text, '') ELSE a.text END AS text, a.i
  FROM nth a LEFT JOIN closing b ON b.conv_id = a.conv_id + 1),
parted AS (
  SELECT a.conv_id, coalesce(min(a.i) FILTER (WHERE a.role <> r.role OR a.text <> r.text) - 1, max(a.i)) AS k
  FROM nth a JOIN rejected r ON a.conv_id = r.conv_id AND a.i = r.i GROUP BY a.conv_id),
sides AS (SELECT 'c' AS side, conv_id, role, text, i FROM nth UNION ALL SELECT 'r', conv_id, role, text, i FROM rejected),
shown AS (
  SELECT side, conv_id, i, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body,
    CAST(length(role) + 5 AS VARCHAR) || ':0 ' || CAST(length(text) + 8 AS VARCHAR) || CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS mask
  FROM sides)
SELECT conv_id, CAST(any_value(k) AS INTEGER) AS prompt_turns,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE side = 'c' AND i <= k), '') AS prompt,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE side = 'c' AND i > k), '') AS chosen,
  coalesce(string_agg(mask, ' ' ORDER BY i) FILTER (WHERE side = 'c' AND i > k), '') AS chosen_mask,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE side = 'r' AND i > k), '') AS rejected,
  coalesce(string_agg(mask, ' ' ORDER BY i) FILTER (WHERE side = 'r' AND i > k), '') AS rejected_mask
FROM shown JOIN parted USING (conv_id) GROUP BY conv_id
"""
