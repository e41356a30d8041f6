"""A training-data pipeline over documents: quality, line dedup, near-dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campovia.llm import gam_quality, line_dedup, packing, simhash_dedup
from campovia.llm.columns import carried, laid_out
from campovia.session import durable, table

TOKENIZER = "word_bpe_49k.json"


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _carried(docs: DataFrame) -> DataFrame:
    """Id, text and all other columns as one, so that columns which operators add meet none of their names."""
    return docs.select("doc_id", "text", carried(_others(docs)).alias("others"))


def _unpacked(found: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs again, some of them changed."""
    back = {"doc_id": F.col("doc_id"), "text": F.col("text"), **laid_out("others", _others(docs)), **changed}
    return found.select(*(back[c] for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones that are not held out, does not reject. Null texts count as empty."""
    model = gam_quality.learn(docs, table(spark, sf_dir, "labels"))
    return _unpacked(gam_quality.classify(_carried(docs), model).where("predicted = 1"), docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated three-line windows; n_chars, where it is a whole number, is brought up to date."""
    cut = line_dedup.remove_repeated_windows(_carried(docs))
    kind = dict(docs.dtypes).get("n_chars")
    if kind not in ("int", "bigint"):
        return _unpacked(cut, docs)
    old = laid_out("others", _others(docs))["n_chars"]
    return _unpacked(cut, docs, n_chars=F.when(F.col("removed_lines") > 0, F.length("text").cast(kind)).otherwise(old).alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a Jaccard similarity of 0.8 or more, candidates by SimHash deletion variants."""
    return _unpacked(simhash_dedup.keep_one(_carried(docs)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), length=2048, end_id=1, with_ids=False)


STAGES = [("quality", quality), ("line_dedup", repeated_lines), ("near_dedup", near_copies), ("packing", packed)]

#: SQL cannot learn the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage leaves is written before the next one reads it.

    Nulls, empty and repeated rows and columns of any names are as the operators define; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
