"""Matrices and graphs over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_part(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """Quantity by supplier and part, of one year's shipments or all."""
    lines = table(spark, sf_dir, "lineitem")
    if year:
        lines = lines.where(F.year("l_shipdate") == year)
    return lines.groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").cast("long").alias("val"))


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").cast("long").alias("val"))


def co_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought in one order, each pair once (row < col)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = lines.alias("a"), lines.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_partkey") < F.col("b.l_partkey")))
    return pairs.select(F.col("a.l_partkey").alias("row"), F.col("b.l_partkey").alias("col")).distinct().withColumn("val", F.lit(1).cast("long"))


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity from the supplier's nation to the customer's."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy(F.col("s_nationkey").alias("row"), F.col("c_nationkey").alias("col")).agg(F.sum("l_quantity").cast("long").alias("val"))


def nation_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from nations to those that they sell more to than they buy from, by the difference."""
    a = nation_trade(spark, sf_dir)
    b = a.select(F.col("row").alias("col"), F.col("col").alias("row"), F.col("val").alias("back"))
    return a.join(b, ["row", "col"], "left").withColumn("val", F.col("val") - F.coalesce("back", F.lit(0))).where("val > 0").select("row", "col", "val")


def document_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lower-cased runs of a-z by document."""
    words = F.explode(F.split(F.lower("text"), "[^a-z]+"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), words.alias("col")).where("col <> ''").groupBy("row", "col").agg(F.count("*").alias("val"))


def user_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions: user, type, time and value in hundredths."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), F.col("event_type").alias("col"), "ts", F.round(F.col("value") * 100).cast("long").alias("val"))
