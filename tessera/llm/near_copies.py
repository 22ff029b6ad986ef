"""SimHash near-dedup at a similarity of texts: components of equal or similar sets of word shingles, exactly.

Two texts are near copies if the sets of their ``SHINGLE``-word shingles (XXH64, lower-cased text) have a Jaccard
similarity of ``LEAST`` or more. Texts with equal sets are one point from here on, so exact copies cost one row.

1. SimHash. Every set has a 64-bit fingerprint; vantage-point shards (simhash.py) give the groups of fingerprints that
   hang together within 3 bits, and each point of a group is a candidate with the group's first one.
2. The rest. Similar sets may lie some 10 bits apart, too far for any shard bound to prune, so what fingerprints miss is
   found by prefixes: shingles have an order, common ones last; of two sets that are similar each has one of the other's
   shingles among the first n - ceil(LEAST * n) + 1 of its n, so every such pair meets in the list of some shingle.
   (Which shingles are common is estimated on a bounded sample: it shapes the order, never what is found.) Lists of the
   same points are one list, the first in the order. A list's shingle may be taken as the first one that a pair
   shares, so its places in both sets bound what they share. Lists are cut into blocks of about ``BLOCK`` points, by a hash of point and shingle; in a
   block a point takes all later ones that sizes and parity sketches leave possible, the next point the rest, and so on:
   fewer pairs than points.
3. Check. All these pairs are checked on the whole sets, similar ones are linked, and links joined to components by the
   star steps of simhash.py. Then each point of a list that holds different components meets its nearest one of another
   component, which joins most of what is left of a group in as few pairs as points. At last all pairs of a list that
   are still in different components, the blocks of a list against each other, are checked in the same way, so none is
   missed; each is made in the first list that both share, as far as that is among the ``EARLIER`` ones. Only here work
   can grow with the square of a list, and only as far as it holds different components. Sketches only rule pairs out: a bit in which they differ stands for a
   shingle that only one of both sets has.

Texts without words (null and empty ones) share the empty set. Rows with a null doc_id belong to components but stand
for one only if no other does. Sets are told apart by a 64-bit hash of theirs, texts by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import durable, in_batches, release, text_keys

#: Words of a shingle; the least similarity as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: Bits of a parity sketch and of a finer one; texts that common shingles are counted on, how often they occur there, the most of them.
BITS, FINE, SAMPLE, COMMON, MOST = 512, 2048, 10_000, 8, 100_000
#: Points of a block of a list, on average.
BLOCK = 2048
#: Earlier shingles that a point brings to a list.
EARLIER = 64
DOC = ["doc_id", "k1", "k2"]


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles, sorted."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def set_key(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED)).view(np.int64))) if len(found) else 0


def prefix_length(n: int) -> int:
    return n - -(-LEAST[0] * n // LEAST[1]) + 1 if n else 0


def sketch(found: np.ndarray, bits: int = BITS) -> bytes:
    """Whether an even or odd number of shingles falls on each bit."""
    return np.packbits((np.bincount((found >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_sketch(found: np.ndarray) -> bytes:
    """The same on a power of two of bits, the set's size at least; halves xor to the next smaller one. Empty where
    ``FINE`` are enough."""
    return sketch(found, 1 << (len(found) - 1).bit_length()) if len(found) > FINE else b""


def fine_sketch(found: np.ndarray) -> bytes:
    return sketch(found, FINE)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that many texts have, sorted, the counts in the second row."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).dropDuplicates(["text"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch["text"]:
                yield pa.record_batch([pa.array(shingles(t.as_py()).view(np.int64))], ["token"])

    often = in_batches(some, each, "token long").groupBy("token").count().where(F.col("count") >= COMMON)
    rows = often.orderBy(F.desc("count"), "token").limit(MOST).collect()
    tokens, counts = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.uint64)
    order = np.argsort(tokens)
    return np.stack([tokens[order], counts[order]])


def points(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, k1, k2, fp (names the set), n, sim (the fingerprint), its sketches and the set's prefix, of each row."""
    tokens, counts = common

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                sets = [shingles(t.as_py()) for t in batch["text"]]
                prefixes = []
                for s in sets:
                    at = np.minimum(np.searchsorted(tokens, s), max(0, len(tokens) - 1))
                    rank = np.where(tokens[at] == s, counts[at], 0) if len(tokens) else np.zeros(len(s), np.uint64)
                    prefixes.append(s[np.lexsort((s, rank))[: prefix_length(len(s))]].view(np.int64))
                sims = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
                columns = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sims), *(pa.array(list(map(f, sets)), pa.binary()) for f in (sketch, fine_sketch, wide_sketch)), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.record_batch([*(batch[c] for c in DOC), *columns], [*DOC, "fp", "n", "sim", "sketch", "fine", "wide", "prefix"])

    return in_batches(docs.select(F.col("doc_id").cast("long"), *text_keys("text"), "text"), taken, "doc_id long, k1 long, k2 long, fp long, n int, sim long, sketch binary, fine binary, wide binary, prefix array<long>")


def _possible(n: np.ndarray, at: np.ndarray, bits: np.ndarray, i: int, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``rest`` that sizes, places of the list's shingle and sketches allow to be similar to i, if no earlier
    shingle is in both (else they meet in its list), and how far sketches lie apart there, as a share of both sizes."""
    p, q = LEAST
    most, both = np.minimum(n[rest] - at[rest], n[i] - at[i]), n[rest] + n[i]
    sized = np.flatnonzero(most * (p + q) >= both * p)
    apart = np.bitwise_count(bits[rest[sized]] ^ bits[i]).sum(axis=1, dtype=np.int64)
    close = apart * (q + p) <= both[sized] * (q - p)
    return sized[close], apart[close] / np.maximum(1, both[sized[close]])


def _pairs(lists: DataFrame, cell: Column, crossing: str) -> DataFrame:
    """Pairs a < b of points of one cell of lists (fp, n, at, bits, block, centre, earlier) that may be similar. With
    ``crossing`` they are in different components (and, where a cell has two blocks, in different ones): of each point
    the "nearest" one, or "all" that have not met in the list of an earlier shingle. Without it those that a point takes
    from the points not taken so far."""

    def of_cell(fp: np.ndarray, n: np.ndarray, at: np.ndarray, bits: np.ndarray, centre: np.ndarray, block: np.ndarray, earlier: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, two = np.arange(len(fp)), block.min() < block.max()
        if not crossing:
            while len(left) > 1:
                i, left = left[0], left[1:]
                near, _ = _possible(n, at, bits, i, left)
                yield np.full(len(near), fp[i]), fp[left[near]]
                left = np.delete(left, near)
            return
        had = np.array([len(e) for e in earlier])
        known = np.zeros((len(fp), int(had.max())), np.int64)
        known[np.arange(known.shape[1]) < had[:, None]] = np.concatenate(earlier)
        for i in left:
            met = left if crossing == "nearest" else left[i + 1 :]
            met = met[(centre[met] != centre[i]) & ((block[met] != block[i]) | ~two)]
            near, apart = _possible(n, at, bits, i, met)
            if not len(near):
                continue
            if crossing == "nearest":
                other = fp[met[near[np.argmin(apart)]]]
                yield np.array([min(fp[i], other)]), np.array([max(fp[i], other)])
                continue
            near = met[near]
            if had[i]:
                again = np.isin(known[near], known[i, : had[i]]) & (np.arange(known.shape[1]) < had[near][:, None])
                near = near[~again.any(axis=1)]
            yield np.full(len(near), fp[i]), fp[near]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            cells = rest["cell"].to_numpy()
            whole = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0  # the last cell may go on
            if whole:
                yield from ruled(rest.slice(0, whole))
                rest = rest.slice(whole)
        if rest is not None and len(rest):
            yield from ruled(rest)

    def ruled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cells, fp, n, at, centre, block = (table[c].to_numpy() for c in ("cell", "fp", "n", "at", "centre", "block"))
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(fp), -1)
        earlier = table["earlier"].to_pylist()
        cuts = np.flatnonzero(np.diff(cells)) + 1
        a, b, size = [], [], 0
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
            for x, y in of_cell(fp[s:e], n[s:e].astype(np.int64), at[s:e].astype(np.int64), bits[s:e], centre[s:e], block[s:e], earlier[s:e]):
                a.append(x)
                b.append(y)
                size += len(x)
                if size > 100_000:
                    yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                    a, b, size = [], [], 0
        if a:
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    dealt = lists.withColumn("cell", cell).repartition("cell").sortWithinPartitions("cell", "fp")
    return in_batches(dealt.select("cell", "fp", "n", "at", "bits", "centre", "block", "earlier"), found, "a long, b long").distinct()


def _narrowed(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs that sizes and the widest sketches leave possible: few bytes a point, where whole sets are many."""
    p, q = LEAST

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch[c].to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                apart = np.bitwise_xor.reduce(x.reshape(-1, size)) ^ np.bitwise_xor.reduce(y.reshape(-1, size))
                keep.append(min(n, m) * q >= max(n, m) * p and int(np.bitwise_count(apart).sum(dtype=np.int64)) * (q + p) <= (n + m) * (q - p))
            yield pa.record_batch([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    bits = F.when(F.length("wide") > 0, F.col("wide")).otherwise(F.col("fine"))
    x = pairs.join(heads.select(F.col("fp").alias("a"), "n", bits.alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("n").alias("m"), bits.alias("y")), "b")
    return in_batches(x.select("a", "b", "n", "m", "x", "y"), left, "a long, b long")


def _similar(pairs: DataFrame, docs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs whose sets are similar, as u, v; the sets are made again from one text each."""
    narrow = durable(_narrowed(pairs, heads))
    keys = narrow.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = heads.join(keys, "fp", "left_semi").select("fp", *DOC)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), *(c.alias(f"t{i}") for i, c in enumerate(text_keys("text"))), "text")
    texts = texts.join(wanted, F.expr("t0 = k1 and t1 = k2 and id <=> doc_id")).select("fp", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                yield pa.record_batch([some["fp"], pa.array([shingles(t.as_py()).view(np.int64) for t in some["text"]], pa.list_(pa.int64()))], ["fp", "tokens"])

    sets = durable(in_batches(texts, each, "fp long, tokens array<long>").dropDuplicates(["fp"]))
    x = narrow.join(sets.select(F.col("fp").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("tokens").alias("y")), "b")
    shared = x.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("both"), (F.size("x") + F.size("y")).cast("long").alias("n"))
    out = durable(shared.where(F.col("both") * LEAST[1] >= (F.col("n") - F.col("both")) * LEAST[0]).select(F.col("b").alias("u"), F.col("a").alias("v")))
    release(sets, narrow)
    return out


def _tight(heads: DataFrame) -> DataFrame:
    """Each point with the first one of its group of fingerprints, as pairs a, b."""
    groups = simhash.components(heads.select(F.col("sim").alias("fp"), "doc_id")).select(F.col("fp").alias("sim"), "fp_group")
    members = durable(heads.select("fp", "sim").join(groups, "sim").select("fp", "fp_group"))
    first = members.groupBy("fp_group").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("fp_group", "a")
    return members.join(first, "fp_group").where("fp <> a").select("a", F.col("fp").alias("b"))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _mixed(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The lists that hold different components, with each point's centre."""
    centre = simhash.least_reachable(links).select(F.col("u").alias("fp"), F.col("v").alias("star"))
    named = lists.join(centre, "fp", "left").withColumn("centre", F.coalesce("star", "fp")).drop("star")
    mixed = named.groupBy("token").agg(F.min("centre").alias("lo"), F.max("centre").alias("hi")).where("lo <> hi").select("token")
    return named.join(mixed, "token")


def _with_earlier(mixed: DataFrame) -> DataFrame:
    """Mixed lists with those of a point's first ``EARLIER`` shingles in them that come before the list's. Two points of
    different components that share one of these have met in its list."""
    first = mixed.groupBy("fp").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "token"))), 1, EARLIER).alias("first"))
    before = F.transform(F.filter("first", lambda x: x["at"] < F.col("at")), lambda x: x["token"])
    return mixed.join(first, "fp").withColumn("earlier", before).drop("first")


def kept_texts(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 of one text of each component: the smallest doc_id's, of texts that share it the one with the
    smallest k1 and k2. Only components without any doc_id are stood for by a text that has none."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), *DOC)).alias("best")
    columns = ("n", "sim", "sketch", "fine", "wide", "prefix")
    heads = durable(points(docs, common_shingles(docs)).groupBy("fp").agg(best, *(F.first(c).alias(c) for c in columns)).select("fp", "best.*", *columns))
    postings = heads.select("fp", F.posexplode("prefix").alias("at", "token"))
    hold = [F.count("*").alias("m"), F.sum("at").alias("at"), *(F.bit_xor(F.xxhash64(F.lit(k), "fp")).alias(x) for k, x in enumerate("xy"))]
    held = postings.groupBy("token").agg(*hold).where("m > 1").groupBy("m", "x", "y").agg(F.min_by("token", "at").alias("token"))
    held = durable(held.select("token", F.ceil(F.col("m") / BLOCK).alias("blocks")))
    block = F.pmod(F.xxhash64("fp", "token"), F.col("blocks"))
    lists = durable(postings.join(held, "token").select("token", "blocks", block.alias("block"), "fp", "at"))
    release(held)
    known = F.array().cast("array<long>")
    full = lists.join(heads.select("fp", "n", F.col("sketch").alias("bits")), "fp").select("*", F.col("fp").alias("centre"), known.alias("earlier"))
    taken = [durable(_pairs(full, F.xxhash64("token", "block"), "").unionByName(_tight(heads)).distinct())]
    close = [_similar(taken[0], docs, heads)]
    for crossing in ("nearest", "all"):
        mixed = durable(_mixed(lists, _all(close)))
        grid = _with_earlier(mixed) if crossing == "all" else mixed.withColumn("earlier", known)
        cell = F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        found = _pairs(grid.join(heads.select("fp", "n", F.col("fine").alias("bits")), "fp").withColumn("other", other), cell, crossing)
        taken.append(durable(found.join(_all(taken), ["a", "b"], "left_anti")))
        close.append(_similar(taken[-1], docs, heads))
        release(mixed)
    centre = simhash.least_reachable(_all(close)).select(F.col("u").alias("fp"), F.col("v").alias("star"))
    least = F.min(F.struct("absent", *DOC)).alias("best")
    out = durable(heads.join(centre, "fp", "left").groupBy(F.coalesce("star", "fp").alias("centre")).agg(least).select(*(f"best.{c}" for c in DOC)))
    release(heads, lists, *taken, *close)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that kept_texts() names, with all their columns; of rows with one doc_id and
    text one stays."""
    kept = kept_texts(docs.select("doc_id", "text")).select(F.col("doc_id").alias("s_doc"), F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), *text_keys("text"))
    found = keyed.join(kept, F.expr("doc <=> s_doc and k1 = s1 and k2 = s2"), "left_semi")
    return found.dropDuplicates(["doc", "k1", "k2"]).select("row.*")
