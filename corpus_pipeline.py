"""The corpus pipeline: five stages, each the work of one training-data operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each result as Parquet in the
shared folder and reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import bpe_lexicon, decontaminate, jaccard_join, quality_nbsvm, substring_dedup
from textveil.llm.common import _WRITTEN, cut, discard, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_nbsvm.rejected_removed(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, the one with the smallest id."""
    return jaccard_join.near_copies_removed(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences that an earlier document has are cut out of the text; n_chars follows."""
    out = substring_dedup.without_repeats(docs, spans_col="__removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.contaminated_removed(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the text they decode to."""
    return bpe_lexicon.encode(docs, digests=True)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeats),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Once a stage's result is written, what was written for
    it and before it by this run is deleted."""
    docs, mine = table(spark, sf_dir, "documents"), len(_WRITTEN)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage")
        discard(spark, _WRITTEN[mine:-1])
    return docs


#: A trained classifier is among the stages, which SQL can't express.
ORACLE_SQL = None
