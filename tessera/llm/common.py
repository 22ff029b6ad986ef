"""Helpers that the corpus operators share: durable tables, words and rolling hashes."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java and DuckDB character class.
SPACE = r"\x20\x09-\x0D"
#: Bytes of the batches that go to Python workers, unless the session sets its own.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of durable tables between two collections of the driver's JVM.
COLLECT_BYTES = 4 << 20
_written: list[str] = []
_since = [0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def in_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow(), with batches of about BATCH_BYTES: texts may be long, and by default only rows are counted."""
    if int(df.sparkSession.conf.get(_BATCH, str(2**31 - 1))) >= 2**31 - 1:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def durable(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage is cut and lost executors cost nothing.

    The table goes with release() or when the driver ends. The shuffle files of the job that wrote it are no longer
    needed; Spark removes them once the driver's JVM has collected the plan, which is asked for here whenever
    COLLECT_BYTES more have been written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_remove_all, spark)
    _written.append(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    _since[0] += at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    if _since[0] >= COLLECT_BYTES:
        _since[0] = 0
        gc.collect()
        spark._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table.durable_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables of durable() that nothing will read again."""
    for table in tables:
        _remove(table.sparkSession, table.durable_path)
        _written.remove(table.durable_path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all(spark: SparkSession) -> None:
    try:
        for path in _written:
            _remove(spark, path)
    except Exception:  # the JVM may have gone first
        return


def text_keys(text: Column | str) -> tuple[Column, Column]:
    """Two longs k1 and k2, 128 bits in all, that stand for a text; null and empty texts have the same ones."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")


def word_count(text: Column | str) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ as a long; null text has none. JVM only."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() parts at exactly the six characters of SPACE."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of uint64 values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any span of a sequence of uint64 values, from prefix sums of value * base^i modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.back = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.power = self.inverse = np.ones(1, np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if n > len(self.power):
            grown = max(n, 2 * len(self.power))
            self.power, self.inverse = np.full(grown, self.base), np.full(grown, self.back)
            self.power[0] = self.inverse[0] = 1
            np.cumprod(self.power, out=self.power)
            np.cumprod(self.inverse, out=self.inverse)
        sums = np.zeros(n, np.uint64)
        np.cumsum(values * self.power[: n - 1], out=sums[1:])
        return sums

    def span(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.inverse[start])
