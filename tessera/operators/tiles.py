"""Work on pairs of rows or nodes that is done block by block, so that the pairs themselves are never shuffled.

Rows have places in the order of their keys, and blocks are runs of places: keys that lie close together tend to share
columns, and then few blocks meet. What a block needs is brought together once, Arrow batches pass through it in order,
and a task holds one block's counters whatever its number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .lineage import checkpointed

#: Rows of a block of a tile; products that are expanded at once; lines of an Arrow batch that leaves; tasks at most.
SIDE, AT_ONCE, LINES, TASKS = 2048, 1 << 16, 1 << 17, 1000
#: Cells that a block of a masked product holds, and the slots of the table that most others miss.
CELLS, SLOTS = 1 << 21, 1 << 25
#: Bytes of the batches that go to Python workers, unless the session sets its own.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def _streamed(df: DataFrame, function, schema: str) -> DataFrame:
    if int(df.sparkSession.conf.get(_BATCH, str(2**31 - 1))) >= 2**31 - 1:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def placed(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """rows (row, ...) with place, their number in the order of row from 0, and upto, the sum of ``weight`` so far."""
    rows = checkpointed(rows.where("row is not null").repartitionByRange("row").withColumn("range_no", F.spark_partition_id()))
    n = F.col(weight) if weight else F.lit(0)
    ranges = rows.groupBy("range_no").agg(F.count("*").alias("before"), F.sum(n).alias("total"))  # one row a range
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range_no", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("before", "total")))
    inside = Window.partitionBy("range_no").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(ranges, "range_no").withColumn("place", F.col("before") + F.count("*").over(inside) - 1).withColumn("upto", F.col("total") + F.sum(n).over(inside))
    return checkpointed(out.drop("range_no", "before", "total"))


def _products(nx: np.ndarray, ny: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of an element of the k-th x list and one of the k-th y list in the lists end to end, some
    AT_ONCE at a time."""
    x0, y0, done = np.cumsum(nx) - nx, np.cumsum(ny) - ny, np.cumsum(nx * ny)
    lo = 0
    while lo < len(nx):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] - nx[lo] * ny[lo] + AT_ONCE, "right")))
        each = np.repeat(ny[lo:hi], nx[lo:hi])  # partners of each x element
        x = np.repeat(np.arange(x0[lo], x0[hi - 1] + nx[hi - 1]), each)
        start = np.repeat(y0[lo:hi], nx[lo:hi]) - (np.cumsum(each) - each)
        yield x, np.repeat(start, each) + np.arange(len(x))
        lo = hi


def pairs(df: DataFrame, every: bool = False, side: int = SIDE, value: Callable | None = None) -> DataFrame:
    """row < col, low, s, t: the sum of the smaller values over the columns that two rows share, and their own sums. every:
    also of pairs that share none. Integral values count as longs, all others as doubles. value: a function of arrays of
    low, s and t, where each entry counts as 1 whatever its value; the result is row, col and its doubles as val, not with
    every.

    Each pair of blocks of ``side`` rows is a tile; a column sends what its rows have in both blocks there, once."""
    whole = bool(value) or isinstance(df.schema["val"].dataType, IntegralType)
    kind, top = ("long", 2**63 - 1) if whole else ("double", float("inf"))
    df = df.where("row is not null").select("row", "col", (F.lit(1) if value else F.col("val")).cast(kind).alias("val"))
    key = df.schema["row"].dataType.simpleString()
    place = placed(df.groupBy("row").agg(F.sum("val").alias("s"))).select("row", "s", F.expr(f"place div {side}").cast("int").alias("block"), F.expr(f"place % {side}").cast("short").alias("at"))
    blocks = -(-place.count() // side)
    entries = df.where("col is not null").join(place, "row").select("col", "block", "at", F.coalesce("val", F.lit(top)).alias("v"))
    sent = {"at": "short"} | ({} if value else {"v": kind})  # by column, lists without nulls, so all in the same order
    parts = entries.repartition("col").groupBy("col", "block").agg(*(F.collect_list(c).alias(c) for c in sent))
    a, b = parts.toDF("col", "i", *(f"x_{c}" for c in sent)), parts.toDF("col", "j", *(f"y_{c}" for c in sent))
    none = lambda c, kind: F.array().cast(f"array<{kind}>").alias(c)
    other = [F.when(F.col("i") < F.col("j"), F.col(f"y_{c}")).otherwise(none(c, k)).alias(f"y_{c}") for c, k in sent.items()]
    met = a.join(b, "col").where("i <= j").select("i", "j", F.lit(2).alias("kind"), *(f"x_{c}" for c in sent), *other)
    # Arrow's lists go over all nulls since the last value again at each further one, so rows without keys have empty lists
    met = met.select("*", none("keys", key), none("sums", kind))
    heads = place.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "row", "s"))).alias("h")).select("block", F.col("h.row").alias("keys"), F.col("h.s").alias("sums"))
    if every:
        of = F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))).alias("other")
        near = heads.select("*", of).where("block <= other").select(F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("kind"), "keys", "sums")
        far = heads.select("*", of).where("block >= other").select(F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("kind"), "keys", "sums")
    else:
        one = entries.select("col", "block").distinct()
        tiles = checkpointed(one.withColumnRenamed("block", "i").join(one.withColumnRenamed("block", "j"), "col").where("i <= j").select("i", "j").distinct())
        near = tiles.join(heads.withColumnRenamed("block", "i"), "i").select("i", "j", F.lit(0).alias("kind"), "keys", "sums")
        far = tiles.join(heads.withColumnRenamed("block", "j"), "j").select("i", "j", F.lit(1).alias("kind"), "keys", "sums")
    number = np.int64 if whole else np.float64

    def tile(low: np.ndarray, seen: np.ndarray | None, same: bool, heads: dict) -> Iterator[pa.RecordBatch]:
        (ki, si), (kj, sj) = heads[0], heads[1]
        n, m = len(ki), len(kj)
        step = max(1, LINES // m)
        for lo in range(0, n, step):
            x, y = np.divmod(np.arange(lo * m, min(n, lo + step) * m), m) if seen is None else np.nonzero(seen[lo : min(n, lo + step), :m])
            x = x if seen is None else x + lo
            if same:
                x, y = x[keep := x < y], y[keep]
            if len(x):
                yield pa.record_batch([ki.take(pa.array(x)), kj.take(pa.array(y)), pa.array(low[x, y]), si.take(pa.array(x)), sj.take(pa.array(y))], ["row", "col", "low", "s", "t"])

    def valued(low: np.ndarray, same: bool, heads: dict) -> Iterator[pa.RecordBatch]:
        (ki, si), (kj, sj) = heads[0], heads[1]
        n, si, sj, step = len(ki), si.to_numpy(), sj.to_numpy(), max(1, LINES // side)
        for lo in range(0, n, step):
            some = low[lo : min(n, lo + step)].reshape(-1)
            at = np.flatnonzero(some != 0)
            x, y = np.divmod(at, side)
            x += lo
            if same:
                at, x, y = at[keep := x < y], x[keep], y[keep]
            if len(x):
                yield pa.record_batch([ki.take(pa.array(x)), kj.take(pa.array(y)), pa.array(value(some[at], si[x], sj[y]))], ["row", "col", "val"])

    def counted(batch: pa.RecordBatch, low: np.ndarray, same: bool, one: np.ndarray) -> None:
        xs, ys = (batch[c] for c in (("x_at", "x_at") if same else ("x_at", "y_at")))
        nx, ny = (np.diff(c.offsets.to_numpy()).astype(np.int64) for c in (xs, ys))
        xs, ys = (c.flatten().to_numpy().astype(np.int64) for c in (xs, ys))
        xs *= side
        for x, y in _products(nx, ny):
            at = xs[x]
            at += ys[y]
            # of the same type and no scalar, which is several times faster
            np.add.at(low.reshape(-1), at, one[: len(at)] if len(at) <= len(one) else np.ones(len(at), np.int64))

    def added(batch: pa.RecordBatch, low: np.ndarray, seen: np.ndarray | None, same: bool) -> None:
        xs, xv, ys, yv = (batch[c] for c in (("x_at", "x_v", "x_at", "x_v") if same else ("x_at", "x_v", "y_at", "y_v")))
        nx, ny = (np.diff(c.offsets.to_numpy()).astype(np.int64) for c in (xs, ys))
        xs, xv, ys, yv = (c.flatten().to_numpy() for c in (xs, xv, ys, yv))
        for x, y in _products(nx, ny):
            if same:
                x, y = x[keep := xs[x] < ys[y]], y[keep]
            at, least = xs[x].astype(np.int64) * side + ys[y], np.fmin(xv[x], yv[y])
            least[least == top] = 0  # neither row has a value
            np.add.at(low.reshape(-1), at, least)
            if seen is not None:
                seen.reshape(-1)[at] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, low, seen = None, {}, np.zeros((side, side), number), None if every or value else np.zeros((side, side), bool)
        one = np.ones(AT_ONCE, np.int64)
        done = lambda: valued(low, now[0] == now[1], heads) if value else tile(low, seen, now[0] == now[1], heads)
        for batch in batches:
            i, j, kinds = (batch[c].to_numpy() for c in ("i", "j", "kind"))
            cuts = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(i)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if now != (at := (int(i[s]), int(j[s]))):
                    if now is not None:
                        yield from done()
                        low.fill(0)
                        if seen is not None:
                            seen.fill(False)
                    now = at
                if kinds[s] < 2:
                    heads[int(kinds[s])] = tuple(batch[c].slice(s, 1).flatten() for c in ("keys", "sums"))
                elif value:
                    counted(batch.slice(s, e - s), low, now[0] == now[1], one)
                else:
                    added(batch.slice(s, e - s), low, seen, now[0] == now[1])
        if now is not None:
            yield from done()

    tasks = max(1, min(TASKS, blocks * (blocks + 1) // 2))
    dealt = near.unionByName(far).unionByName(met, allowMissingColumns=True).repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "kind")
    return _streamed(dealt, run, f"row {key}, col {key}, " + ("val double" if value else f"low {kind}, s {kind}, t {kind}"))


def masked_products(lists: DataFrame) -> DataFrame:
    """lists (node, n): nodes from 0 up, each with the array of those after it in some order, in that order. Gives row,
    col, val for each cell, a node and one of its array: in how many arrays both stand, row before col.

    A block holds the cells of a run of nodes, some CELLS; an array goes, once, to each block that it has a node of."""
    sizes = placed(lists.select(F.col("node").alias("row"), F.size("n").cast("long").alias("size")), "size")
    block = F.expr(f"(upto - size) div {CELLS}").cast("int")
    starts = [r[0] for r in sizes.groupBy(block.alias("block")).agg(F.min("row").alias("first")).orderBy("first").select("first").collect()]
    firsts = F.array(*map(F.lit, starts)).cast("array<long>")
    of = lambda v: F.size(F.filter(firsts, lambda f: f <= v)) - 1
    own = lists.select(of(F.col("node")).alias("block"), F.lit(0).alias("kind"), "node", "n")
    sent = lists.where(F.size("n") > 1).select(F.explode(F.array_distinct(F.transform("n", of))).alias("block"), F.lit(1).alias("kind"), "node", "n")
    bounds = np.array([*starts, 2**62], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells, keys, counts, slots = None, [], None, None, np.zeros(SLOTS, bool)
        slot = lambda row, col: ((row * 0x9E3779B1) ^ (col * 0x85EBCA77)) & (SLOTS - 1)  # noqa: E731  node numbers are below 2^31

        def ready() -> tuple[np.ndarray, np.ndarray]:
            rows, cols = (np.concatenate(c) for c in zip(*cells, strict=True)) if cells else (np.zeros(0, np.int64),) * 2
            found = np.sort((rows << 32) | cols)
            slots.fill(False)
            slots[slot(rows, cols)] = True
            return found, np.zeros(len(found), np.int64)

        def given() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(keys), LINES):
                k = keys[lo : lo + LINES]
                yield pa.record_batch([pa.array(k >> 32), pa.array(k & 0xFFFFFFFF), pa.array(counts[lo : lo + LINES])], ["row", "col", "val"])

        for batch in batches:
            blocks, kinds = batch["block"].to_numpy(), batch["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(blocks)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if now != blocks[s]:
                    if now is not None:
                        keys, counts = ready() if keys is None else (keys, counts)
                        yield from given()
                    now, cells, keys, counts = blocks[s], [], None, None
                some = batch.slice(s, e - s)
                size, flat = np.diff(some["n"].offsets.to_numpy()).astype(np.int64), some["n"].flatten().to_numpy().astype(np.int64)
                if kinds[s] == 0:
                    cells.append((np.repeat(some["node"].to_numpy().astype(np.int64), size), flat))
                    continue
                if keys is None:
                    keys, counts = ready()
                    cells = []
                end = np.repeat(np.cumsum(size), size)
                y = np.flatnonzero((flat >= bounds[now]) & (flat < bounds[now + 1]))
                after = end[y] - y - 1
                done, lo = np.cumsum(after), 0
                while lo < len(y):
                    hi = max(lo + 1, int(np.searchsorted(done, done[lo] - after[lo] + AT_ONCE, "right")))
                    each = after[lo:hi]
                    row = np.repeat(flat[y[lo:hi]], each)
                    col = flat[np.repeat(y[lo:hi] + 1 - (np.cumsum(each) - each), each) + np.arange(len(row))]
                    likely = np.flatnonzero(slots[slot(row, col)])
                    asked = (row[likely] << 32) | col[likely]
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    np.add.at(counts, at[keys[at] == asked], 1)
                    lo = hi
        if now is not None:
            keys, counts = ready() if keys is None else (keys, counts)
            yield from given()

    tasks = max(1, min(TASKS, len(starts)))
    dealt = own.unionByName(sent).repartition(tasks, "block").sortWithinPartitions("block", "kind")
    return _streamed(dealt, run, "row long, col long, val long")
