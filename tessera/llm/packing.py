"""Packing into optimal length buckets.

1. Lengths (words of a text) are counted in a global histogram. It has a row for each distinct length: D of them have
   D * (D - 1) / 2 words at least, so the square root of twice the corpus's words bounds it, whatever the documents.
2. Dynamic programming over the distinct lengths chooses the ``buckets`` upper bounds that minimise padding, exactly: the
   best last cut moves up with the length, so each bucket more is found by divide and conquer.
3. Each bucket is cut by hash into groups of about ``group`` documents; in a group documents in permuted order fill
   batches of ``budget // bound`` documents, so a batch padded to its bucket's bound stays in the budget. Documents of a
   bucket whose bound is above the budget are batches of one. Groups bound every window; a bucket has at most one
   unfilled batch a group.

Null and empty texts have length 0 and are packed like others (a bucket's bound is 1 at least). Repeated rows are counted
first, so a hot one is spread, and packed one by one; which of them gets which place is open. An empty table gives no
rows. Very long texts are only counted, no text is cut; further columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_keys, word_count

BUCKETS, BUDGET, GROUP = 16, 16_384, 20_000


def _cheapest(before: np.ndarray, lengths: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least before[i] + lengths[j] * (documents in i + 1..j) over i < j, and the i; j = 0 has none.

    All middles of one depth of the recursion are computed at once; their ranges overlap in single places only."""
    n = len(lengths)
    best, cut = np.full(n, np.iinfo(np.int64).max // 2), np.zeros(n, np.int32)
    low, high, first, last = (np.array([x], np.int64) for x in (1, n - 1, 0, n - 2))
    while len(low):
        mid = (low + high) // 2
        size = np.minimum(mid - 1, last) - first + 1
        of = np.repeat(np.arange(len(mid)), size)
        begin = np.cumsum(size) - size
        i = first[of] + np.arange(len(of)) - begin[of]
        cost = before[i] + lengths[mid[of]] * (total[mid[of] + 1] - total[i + 1])
        least = np.minimum.reduceat(cost, begin)
        at = np.flatnonzero(cost == least[of])
        where = at[np.searchsorted(at, begin)]
        best[mid], cut[mid] = least, i[where]
        low, high, first, last = (np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (first, i[where]), (i[where], last)))
        some = low <= high
        low, high, first, last = low[some], high[some], first[some], last[some]
    return best, cut


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds, from distinct lengths in ascending order, of at most ``buckets`` buckets with the least padded
    length."""
    lengths = lengths.astype(np.int64)
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    cost, cuts = lengths * total[1:], []  # one bucket for lengths 0..j
    for _ in range(min(buckets, len(lengths)) - 1):
        new, cut = _cheapest(cost, lengths, total)
        cuts.append(np.where(new < cost, cut, -1))
        cost = np.minimum(new, cost)
    out, j = [], len(lengths) - 1
    for cut in [*reversed(cuts), None]:
        if cut is None:
            out.append(lengths[j])
        elif cut[j] >= 0:
            out.append(lengths[j])
            j = int(cut[j])
    return np.array(out[::-1])


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, group: int = GROUP, seed: int = 7) -> DataFrame:
    """doc_id, length, bucket (from 0), bucket_length, batch (bucket-group-number), slot (from 0), padding of each row."""
    kinds = durable(docs.select("doc_id", *text_keys("text"), word_count("text").alias("length")).groupBy("doc_id", "k1", "k2", "length").agg(F.count("*").alias("n")))
    histogram = kinds.groupBy("length").agg(F.sum("n").alias("n")).toArrow().sort_by("length")
    lengths, counts = (histogram[c].to_numpy() for c in ("length", "n"))
    bounds = best_bounds(lengths, counts, buckets) if len(lengths) else np.array([1])
    sizes = np.diff(np.concatenate([[0], np.cumsum(counts)[np.searchsorted(lengths, bounds)]])) if len(lengths) else np.array([0])
    array = lambda x: F.array(*(F.lit(int(v)) for v in x)).cast("array<bigint>")
    rows = kinds.withColumn("bucket", F.size(F.filter(array(bounds[:-1]), lambda b: b < F.col("length"))).cast("int"))
    rows = rows.withColumn("bucket_length", F.element_at(array(np.maximum(bounds, 1)), F.col("bucket") + 1))
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    key = ["doc_id", "k1", "k2", "repeat"]
    rows = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), *key), F.element_at(array(-(-sizes // group) + (sizes == 0)), F.col("bucket") + 1)))
    place = F.row_number().over(Window.partitionBy("bucket", "group").orderBy(F.xxhash64(F.lit(seed + 1), *key), *key)) - 1
    rows = rows.withColumn("place", place).withColumn("room", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length"))))
    return rows.select("doc_id", "length", "bucket", "bucket_length", F.concat_ws("-", "bucket", "group", F.floor(F.col("place") / F.col("room"))).alias("batch"), (F.col("place") % F.col("room")).cast("int").alias("slot"), (F.col("bucket_length") - F.col("length")).alias("padding"))


def op9_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
