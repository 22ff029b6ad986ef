"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table after which the driver's JVM is asked to collect its garbage.
COLLECT_BYTES = 4 << 20
_written: list[str] = []


def _folder(spark: SparkSession) -> str:
    """The folder that the session names, or a temporary one in local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession) -> None:
    try:
        for path in _written:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may have gone first
        return


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage ends there, a lost executor costs nothing,
    and it is computed once however often it is used. The tables go when the driver ends; shuffle files of the jobs that
    wrote them go once the JVM has collected their plans, which is asked for after each large one."""
    spark: SparkSession = df.sparkSession
    path = f"{_folder(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_remove, spark)
    _written.append(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() >= COLLECT_BYTES:
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
