"""SimHash near-dedup with vantage-point trees.

1. Fingerprints. XXH64 (seed 42) of every 3-word shingle of the lower-cased text; a bit is 1 if it is set in over half
   of them. Equal fingerprints are one point from here on, so exact copies cost one row.
2. Shards. A vantage-point tree over a bounded sample of points halves by Hamming distance: at a node with vantage v
   and radius m a point goes right if d(v, p) > m and left if d(v, p) <= m + ``near``. By the triangle inequality two
   points within ``near`` of each other meet on the left whenever they lie on different sides, so every link is inside
   some shard. All points are routed; the sample only shapes the tree.
3. Links. Inside a shard the same split goes on while it pays; what is left is searched by breadth: a point takes from
   the unvisited ones all within ``near`` of it, which a tight group leaves at once. A shard reports a spanning star of
   each connected group, never its pairs.
4. Components. Shards' groups that share a point are joined by alternating large-star and small-star steps over
   tables; a component is named by the smallest doc_id in it.

A group that no vantage point splits is searched in one task; its points lie within a few bits of each other, so their
number is bounded by the bits (43,745 within 3 of one point), whatever the corpus. Of a shard only the longs are held.

Texts without words (null and empty ones too) have fingerprint 0 and are linked like any other. Rows with a null
doc_id get a component but never name one; a component of such rows only has none. Repeated rows are copies, an empty
table has none. Very long texts are hashed one by one; columns besides doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, in_batches, release

NEAR, SHINGLE, SEED = 3, 3, 42
#: Points the tree is shaped on at least, points of them a leaf, points a shard should hold, and the most levels of the
#: routing tree (each adds about a quarter to the points that are dealt out; a shard of any size is split on inside).
SAMPLE, PER_LEAF, SHARD, LEVELS = 50_000, 12, 4_000, 16
#: Points a search by breadth is begun with at most, where splitting pays.
SMALL = 1_024
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text, repeats included; of all words if they are fewer, of none if
    there are none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: 1 - shingle]
    return np.array([digest(joined[s:e], SEED) for s, e in zip(start.tolist(), end[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if it is set in over half of them; 0 of none."""
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65_536):
        bits += np.unpackbits(hashes[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, a long with the fingerprint's bits, of each row."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch["text"]], np.uint64)
            yield pa.record_batch([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return in_batches(docs.select(F.col("doc_id").cast("long"), "text"), taken, "doc_id long, fp long")


def grow(sample: np.ndarray, levels: int, seed: int = 7) -> list:
    """A tree of [vantage, radius, left, right] and leaf numbers, with at most 2 ** levels leaves."""
    rng, leaves = np.random.default_rng(seed), iter(range(1 << levels))

    def split(points: np.ndarray, depth: int):
        if depth == levels or len(points) < 4:
            return next(leaves)
        best = None
        for vantage in rng.choice(points, min(8, len(points)), replace=False):
            distance = np.bitwise_count(points ^ vantage)
            radius = int(np.median(distance))
            if (distance <= radius).mean() > 0.75 and radius:
                radius -= 1
            left, right = (distance <= radius + NEAR).mean(), (distance > radius).mean()
            if best is None or max(left, right) < best[0]:
                best = max(left, right), vantage, radius, distance
        share, vantage, radius, distance = best
        if share > 0.9:  # a tight group can't be split
            return next(leaves)
        return [np.uint64(vantage), radius, split(points[distance <= radius + NEAR], depth + 1), split(points[distance > radius], depth + 1)]

    return split(sample, 0)


def route(tree, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves and the positions of the points that belong there."""
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, list):
            yield node, at
            continue
        distance = np.bitwise_count(points[at] ^ node[0])
        todo.append((node[2], at[distance <= node[1] + NEAR]))
        todo.append((node[3], at[distance > node[1]]))


def _by_breadth(points: np.ndarray, join) -> None:
    left, queue = np.arange(len(points)), []
    while len(left) or queue:
        if queue:
            at = queue.pop()
        else:
            at, left = int(left[0]), left[1:]
        close = np.bitwise_count(points[left] ^ points[at]) <= NEAR
        if close.any():
            near = left[close].tolist()
            join(at, near)
            queue += near
            left = left[~close]


def groups(points: np.ndarray, seed: int = 7) -> np.ndarray:
    """For each of the distinct points the position of the first one of its connected group."""
    rng, parent = np.random.default_rng(seed), np.arange(len(points))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) > SMALL:
            vantage = points[rng.choice(at)]
            distance = np.bitwise_count(points[at] ^ vantage)
            radius = int(np.median(distance))
            left, right = at[distance <= radius + NEAR], at[distance > radius]
            if len(left) < 0.9 * len(at) and len(right) < 0.9 * len(at):
                todo += [left, right]
                continue

        def join(i: int, others: list[int], at: np.ndarray = at) -> None:
            for j in others:
                a, b = root(at[i]), root(at[j])
                parent[max(a, b)] = min(a, b)

        _by_breadth(points[at], join)
    return np.array([root(i) for i in range(len(points))], np.int64)


def least_reachable(edges: DataFrame) -> DataFrame:
    """u -> smallest node that u reaches, for edges u, v with u <> v."""
    edges, sums = durable(edges.distinct()), (F.count("*"), F.bit_xor(F.xxhash64("u", "v")))
    state = edges.agg(*sums).first()
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        old, edges = edges, durable(small)
        release(old)
        if (now := edges.agg(*sums).first()) == state:
            break
        state = now
    return edges


def components(prints: DataFrame, shard: int = SHARD) -> DataFrame:
    """fp, component_id (smallest doc_id reachable) and fp_group (some fp of the component, the same for all of it) of
    every distinct fp in prints (doc_id, fp)."""
    points = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = points.count()
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, n / shard))))))
    sample = max(SAMPLE, PER_LEAF << levels)
    chosen = np.array([r.fp for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64) if levels else np.zeros(0, np.uint64)
    tree = grow(chosen, levels)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy()
            for leaf, at in route(tree, fps.view(np.uint64)):
                yield pa.record_batch([pa.array(np.full(len(at), leaf, np.int32)), pa.array(fps[at])], ["leaf", "fp"])

    def linked(table: pa.Table) -> pa.Table:
        fps = np.sort(table["fp"].to_numpy())
        first = groups(fps.view(np.uint64))
        member = np.bincount(first, minlength=len(fps))[first] > 1
        return pa.table([pa.array(fps[member]), pa.array(fps[first[member]])], ["fp", "root"])

    # shards are few bytes and much work: a task each, which size-based coalescing would undo
    sharded = in_batches(points.select("fp"), routed, "leaf int, fp long").repartition(1 << levels, "leaf")
    stars = durable(sharded.groupBy("leaf").applyInArrow(linked, "fp long, root long"))
    own = stars.groupBy("fp").agg(F.min("root").alias("root"))
    between = stars.join(own.withColumnRenamed("root", "low"), "fp").where("root <> low").select(F.col("root").alias("u"), F.col("low").alias("v"))
    centre = least_reachable(between)
    named = own.join(centre.select(F.col("u").alias("root"), F.col("v").alias("centre")), "root", "left").select("fp", F.coalesce("centre", "root").alias("centre"))
    named = durable(named.join(points, "fp"))
    lowest = named.groupBy("centre").agg(F.min("least").alias("component_id"))
    return points.join(named.join(lowest, "centre").select("fp", "component_id", "centre"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("centre", "fp").alias("fp_group"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of each row of docs (doc_id, text)."""
    prints = durable(fingerprints(docs))
    return prints.join(components(prints), "fp").select("doc_id", "fp", "component_id")


def op7_vantage_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
