"""The training-data operators' queries over the supplied tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from campovia.llm import (
    ann_adaptive,
    byte_bpe,
    exact_topk,
    feistel_shards,
    gam_quality,
    hard_negatives,
    line_dedup,
    packing,
    preference_format,
    simhash_dedup,
    token_align,
    warc_fixity,
    weak_pii,
)
from campovia.session import durable, table

#: Searches ask with the rows whose vec_id this divides.
QUERY_EVERY = 20


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components: 4-word shingles, fingerprints at most 4 bits apart."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, max_bits=4, words=1)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later occurrences of repeated three-line windows."""
    kept = line_dedup.remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "text", "removed_lines")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of their decoding."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op4_ann_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann_adaptive.nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), k=20)


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record with its offsets, hash and file root, and what an audit finds in a replica of which each 97th page's first byte was lost to a bit fault."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    broken = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("?"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))
    own = durable(warc_fixity.leaves_of_pages(pages))
    replica = durable(warc_fixity.leaves_of_pages(pages.withColumn("html", broken)))
    faults, roots = warc_fixity.audit(own, replica)
    return (
        own.join(roots, "file").join(faults.select("file", "node", "fault"), ["file", "node"], "left")
        .select(F.col("id").alias("page_id"), "file", F.col("node").alias("record"), "start", "stop", F.col("hash").alias("sha256"), "root", "fault")
    )


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer scores for every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.exact_topk(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), k=20, scale=64)


def op7_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score from a model of labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam_quality.learn(docs, table(spark, sf_dir, "labels"))
    return gam_quality.classify(docs, model).select("doc_id", gam_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the chosen side; on the rejected side its last turn says what the next conversation's last turn says."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    order = F.struct(F.col("turn").isNotNull(), "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    last = turns.groupBy("conv_id").agg(F.max(order).alias("last"), F.count("*").alias("n"))
    closing = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.col4").alias("reply"))
    ends = last.select("conv_id", "last").join(closing, "conv_id", "left")
    swapped = turns.join(ends, "conv_id").withColumn("text", F.when(order == F.col("last"), F.coalesce("reply", F.lit(""))).otherwise(F.col("text")))
    return preference_format.preference_examples(turns, swapped)


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 16 shards under the law of equal row counts."""
    digests = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return feistel_shards.shard_rows(digests, ["doc_id", "size", "text_crc32"], shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, length=2048, end_id=1, with_ids=False)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens of every document overlap, and how their linked pairs stand in the whole corpus."""
    byte_level, pieces = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    documents, _ = token_align.align(table(spark, sf_dir, "documents"), byte_level, pieces, with_groups=False)
    return documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its five nearest of the same label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    changed = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(changed, F.col("vec_id") % 100 == 0)


def op13_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, all spans, and how many the method added."""
    found = weak_pii.find(table(spark, sf_dir, "documents"))
    base, added = F.col("base"), F.col("added")
    return found.select(
        "doc_id", *(weak_pii.counted(base, k).alias(f"n_{name}") for k, name in enumerate(weak_pii.KINDS)), F.sha2(weak_pii.written(base), 256).alias("base_sha256"),
        weak_pii.written(F.concat(base, added)).alias("spans"), F.size(added).cast("long").alias("n_added"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each operator's query."""
    return {
        "op1_simhash": op1_simhash,
        "op2_line_dedup": op2_line_dedup,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_ann_adaptive": op4_ann_adaptive,
        "op5_warc_fixity": op5_warc_fixity,
        "op6_exact_topk": op6_exact_topk,
        "op7_gam_quality": op7_gam_quality,
        "op8_preference_format": op8_preference_format,
        "op9_feistel_shards": op9_feistel_shards,
        "op10_packing": op10_packing,
        "op11_token_alignment": op11_token_alignment,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_weak_pii": op13_weak_pii,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {"op2_line_dedup": line_dedup.ORACLE_SQL, "op5_warc_fixity": warc_fixity.ORACLE_SQL, "op6_exact_topk": exact_topk.ORACLE_SQL, "op8_preference_format": preference_format.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL}
