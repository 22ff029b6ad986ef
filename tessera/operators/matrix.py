"""Small dense algebra beside sparse tables: inverse, factorisation, norms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .graph import checkpointed

#: Largest order of a matrix that is brought to the driver.
MOST = 200


def inverse(df: DataFrame, labels: list) -> DataFrame:
    """Inverse (pseudo-inverse if singular) of a K x K matrix whose rows and columns are ``labels``."""
    if len(labels) > MOST:
        raise ValueError(f"order {len(labels)} is above {MOST}")
    dense = np.zeros((len(labels),) * 2)
    at = {x: i for i, x in enumerate(labels)}
    for r in df.where(F.col("row").isin(labels) & F.col("col").isin(labels)).collect():  # at most K * K entries
        dense[at[r["row"]], at[r["col"]]] = r["val"]
    try:
        out = np.linalg.inv(dense)
    except np.linalg.LinAlgError:
        out = np.linalg.pinv(dense)
    rows = [(a, b, float(out[i, j])) for i, a in enumerate(labels) for j, b in enumerate(labels)]
    kind = df.schema["row"].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"row {kind}, col {kind}, val double")


def inverse_newton(df: DataFrame, labels: DataFrame, rounds: int = 100, tolerance: float = 1e-12) -> DataFrame:
    """The same by Newton-Schulz steps X <- X (2 I - A X) from A' / (norm1 * norminf), as products of tables: for orders
    beyond the driver's. labels: one column, node. Ends where a step changes nothing by more than the tolerance."""
    a = checkpointed(df.select("row", "col", F.col("val").cast("double").alias("val")))
    norm = lambda c: a.groupBy(c).agg(F.sum(F.abs("val")).alias("n")).agg(F.max("n")).first()[0] or 1.0
    scale = norm("row") * norm("col")
    two = labels.select(F.col("node").alias("row"), F.col("node").alias("col"), F.lit(2.0).alias("val"))
    x = checkpointed(core.transpose(a).withColumn("val", F.col("val") / scale))
    for _ in range(rounds):
        rest = core.ewise_add(two, _product(a, x), "minus", 0.0)
        new = checkpointed(_product(x, rest))
        change = core.ewise_add(new, x, "minus", 0.0).agg(F.max(F.abs("val"))).first()[0] or 0.0
        x = new
        if change <= tolerance:
            break
    return x


def _product(x: DataFrame, y: DataFrame) -> DataFrame:
    """X Y from X and Y as they are."""
    return core.mxm(core.transpose(x), y)


def initial_topics(a: DataFrame, k: int, kind: str = "uniform") -> DataFrame:
    """W0: for each row of A and topic 1..k a number from digests of both: uniform in [0, 1), or the absolute value of a
    normal one (kind "normal")."""
    key = F.concat_ws("|", F.col("row").cast("string"), F.col("col").cast("string"))
    part = lambda at: F.conv(F.substring(F.md5(key), at, 8), 16, 10).cast("double") / 2.0**32
    val = part(1) if kind == "uniform" else F.abs(F.sqrt(-2 * F.ln(1 - part(1))) * F.cos(2 * F.lit(np.pi) * part(9)))
    return a.select("row").distinct().withColumn("col", F.explode(F.array(*(F.lit(i).cast("long") for i in range(1, k + 1))))).withColumn("val", val)


def nmf_step(a: DataFrame, w: DataFrame, k: int, cutoff: float = 0.0, most_cols: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One round: H = (W'W)^-1 W'A, then W = A H' (HH')^-1; entries not above the cutoff go. H is (topic, col)."""
    topics = list(range(1, k + 1))

    def half(x: DataFrame, m: DataFrame) -> DataFrame:  # (x'x)^-1 x'm, both with the contracted label in row
        inv = inverse(core.mxm(x, x), topics)
        return core.mxm(core.transpose(inv), core.mxm(x, m), keep_zero=True).where(F.col("val") > cutoff)

    h = half(w, a)
    if most_cols is not None:
        h = core.top_k(h, most_cols)
    h = checkpointed(h)
    return checkpointed(core.transpose(half(core.transpose(h), core.transpose(a)))), h


def nmf(a: DataFrame, k: int, rounds: int = 25, cutoff: float = 0.0, most_cols: int | None = None, tolerance: float = 0.01, kind: str = "normal") -> tuple[DataFrame, DataFrame, float]:
    """W, H and the last share of cells in which H changed; ends after three rounds at or below the tolerance."""
    a = checkpointed(a)
    w, before, calm, change = initial_topics(a, k, kind), None, 0, 1.0
    for _ in range(rounds):
        w, h = nmf_step(a, w, k, cutoff, most_cols)
        if before is not None:
            cells = max(1, h.count())
            change = core.symmetric_difference(h, before).count() / cells
            calm = calm + 1 if change <= tolerance else 0
            if calm == 3:
                break
        before = h
    return w, h, change


def frobenius(a: DataFrame, b: DataFrame) -> DataFrame:
    """Norm of A - B."""
    d = core.ewise_add(a.withColumn("val", F.col("val").cast("double")), b.withColumn("val", F.col("val").cast("double")), "minus", fill=0.0)
    return d.agg(F.sqrt(F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0))).alias("norm"))


def project(h: DataFrame, k: int) -> DataFrame:
    """H' (H H')^-1: rows are H's columns."""
    inv = inverse(core.mxm(core.transpose(h), core.transpose(h)), list(range(1, k + 1)))
    return core.mxm(h, inv, keep_zero=True)
