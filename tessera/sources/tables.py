"""Tables by name in the session's catalogue: create, list, clone, delete, and how their entries are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create(df: DataFrame, name: str, ranges: int | None = None, splits: list | None = None) -> None:
    """A new table; ranges: in so many ranges of rows with about as many entries, splits: cut at these rows."""
    if splits is not None:
        points = F.array(*map(F.lit, sorted(splits))).cast(f"array<{df.schema['row'].dataType.simpleString()}>")
        part = F.size(F.filter(points, lambda p: p < F.col("row")))
        df = df.repartitionById(len(splits) + 1, part).sortWithinPartitions("row")
    elif ranges:
        df = df.repartitionByRange(ranges, "row")
    df.write.saveAsTable(name)


def put(df: DataFrame, name: str) -> None:
    """Entries added to a table; a combiner over it folds what falls together."""
    df.write.mode("append").saveAsTable(name)


def names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def delete(spark: SparkSession, name: str) -> None:
    """Gone if it was there."""
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def clone(spark: SparkSession, name: str, to: str) -> None:
    spark.table(name).write.saveAsTable(to)


def compact(spark: SparkSession, name: str, files: int) -> None:
    """The table's entries in ``files`` files, by ranges of rows."""
    spark.table(name).repartitionByRange(files, "row").write.saveAsTable(f"{name}_compacted")
    delete(spark, name)
    spark.sql(f"ALTER TABLE `{name}_compacted` RENAME TO `{name}`")


def set_property(spark: SparkSession, name: str, key: str, value: str) -> None:
    spark.sql(f"ALTER TABLE `{name}` SET TBLPROPERTIES ('{key}' = '{value}')")


def get_property(spark: SparkSession, name: str, key: str) -> str | None:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES `{name}`").collect()}.get(key)


def entries(spark: SparkSession, tables: list[str]) -> int:
    return sum(spark.table(t).count() for t in tables)


def splits(spark: SparkSession, name: str) -> DataFrame:
    """first_row, last_row and entries of each file of a table."""
    return spark.table(name).groupBy(F.input_file_name().alias("file")).agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("entries")).drop("file")
