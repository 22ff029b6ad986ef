"""A corpus pipeline over the documents table: quality, near-dedup, substring dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared
folder and reads it again for the next stage. All stages but the last return the columns of documents.

Stages carry a row's columns in one struct, so further columns of any name pass through. Null texts count as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, near_copies, packing, quality, substring_dedup
from tessera.llm.common import durable


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more. It learns from the labels outside the held-out fold."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the row with the smallest doc_id, once; a
    row without doc_id only if all are."""
    return near_copies.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their words in duplicate spans (n_chars follows); texts without such spans stay as they are, emptied
    ones go."""
    found = substring_dedup.substring_dedup(docs).where("n_removed = 0 or kept_text <> ''")
    cut, row = F.col("n_removed") > 0, F.col("row")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    column = lambda c: F.when(cut, new[c]).otherwise(row[c]).cast(docs.schema[c].dataType) if c in new else row[c]
    return found.select(*(column(c).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, whole, as often as the mix takes them, shard by shard in the order that the local shuffles give."""
    return mixing.mixed_rows(docs).select("row.*")


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of every document."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_lengths),
]
#: The classifier, the fingerprints and the bucket bounds are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
