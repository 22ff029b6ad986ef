"""Substring dedup by relative Lempel-Ziv parsing over indexed reference blocks.

Reference. A window is ``window`` consecutive words; its first occurrence is the one with the least (doc_id, start).
Runs of windows that occur first where they stand are the reference blocks: together they hold every window of the
corpus once, so what continues a match inside a block is unique and the longest factor is found by walking on.

1. Anchors. Every text is cut into *phrases*: runs of windows whose least ``gram``-word hash, the anchor, is the same
   occurrence. Equal windows have equal anchors, so all occurrences of a window meet under its anchor, and a document
   is parsed only against blocks that can hold a match. Some ``CHUNK`` phrases on average, up to one that its own hash
   picks, are a *chunk*: copied passages are mostly equal chunks, and each distinct chunk is looked into only once.
2. Index. Each distinct chunk, then each distinct phrase, is kept once, with its first occurrence (grouped minima with
   map-side combine, so hot ones are spread). Anchors of one document only are done with. Under an anchor with one
   phrase that settles all its windows. Phrases under *crowded* anchors are opened, each once, at their first
   occurrence: their windows are indexed one by one, and a phrase learns which of its windows occur first elsewhere. A
   chunk takes over what its phrases know, and all its holders what the chunk knows.
3. Factors. A document walks over its windows; from the first one that occurs first in a smaller document it takes the
   longest factor: as long as the next window is the next one of the same reference block (a window that equals the one
   before it, in a run of one word, stays on its place). A factor of k windows is k + window - 1 words; shorter matches
   are no factors. At its end the windows that straddle the boundary are looked up in the same way, and the next factor
   begins at the first of them that is in the reference. The words in factors are the duplicate spans.

Rows are as the input's, with all their columns; a null or empty text has no words. A null doc_id counts as neither
smaller nor larger than any other: such a row keeps all its words and removes none. Rows with one doc_id judge each other
as one document; they are told apart by 128 bits of their texts, and repeats of one text are looked up once. A very long
text is held whole by the task that parses it.

Words are compared by 128-bit hashes, phrases and windows by two rolling hashes modulo 2^64, one of either half of the
words' hashes: two given windows that differ are taken as equal with a chance of about 2^-100, unless texts are made to
collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Rolling, durable, in_batches, release, text_keys, words_of

WINDOW, GRAM = 50, 16
#: Phrases of a chunk, on average and at most.
CHUNK, LONGEST = 8, 64
#: Odd bases of the rolling hashes: of anchors, and of the two halves of fingerprints.
BASES = 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Texts that are looked at together.
BATCH = 256
DOC, NAME, PHRASE = ["doc_id", "k1", "k2"], ["c1", "c2"], ["fp1", "fp2"]


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def cut(halves: tuple[np.ndarray, np.ndarray], window: int, gram: int, rolls: list[Rolling]) -> tuple[np.ndarray, ...]:
    """Phrases of one text: anchor, two fingerprints, first window, windows, repeats (a phrase of one window that
    repeats at the next places counts as one row)."""
    sums = [r.prefix(h) for r, h in zip(rolls, (halves[0], *halves), strict=True)]
    at = np.arange(len(halves[0]) - gram + 1)
    grams = rolls[0].span(sums[0], at, at + gram)
    starts = np.arange(len(halves[0]) - window + 1)
    anchor_at = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1) + starts
    first = np.flatnonzero(np.diff(anchor_at, prepend=-1))
    count = np.diff(first, append=len(starts))
    prints = [rolls[k].span(sums[k], first, first + count + window - 1) for k in (1, 2)]
    anchors = grams[anchor_at[first]]
    new = np.ones(len(first), bool)
    new[1:] = (prints[0][1:] != prints[0][:-1]) | (prints[1][1:] != prints[1][:-1]) | (count[1:] > 1) | (count[:-1] > 1)
    lead = np.flatnonzero(new)
    return anchors[lead], prints[0][lead], prints[1][lead], first[lead], count[lead], np.diff(lead, append=len(first))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), *text_keys("text"), "text")


def chunks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each chunk of each text with a doc_id: a fingerprint, its first window, and its phrases (off: windows
    from the chunk's first one)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = [Rolling(b) for b in BASES]
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                some = batch.slice(lo, BATCH)
                found, rows, names, firsts, sizes = [], [], [], [], []
                for k, text in enumerate(some["text"]):
                    words = words_of(text.as_py())
                    if len(words) < window:
                        continue
                    a, f, g, first, count, repeats = cut(_hashes(words), window, gram, rolls)
                    ends = np.flatnonzero(f % np.uint64(CHUNK) == 0) + 1
                    starts = np.unique(np.append(0, ends[ends < len(f)]))
                    starts = np.concatenate([np.arange(s, e, LONGEST) for s, e in zip(starts, np.append(starts[1:], len(f)), strict=True)])
                    size = np.diff(starts, append=len(f))
                    packed = np.stack([f, g, count.astype(np.uint64), repeats.astype(np.uint64)], 1)
                    names.append(b"".join(xxhash.xxh3_128_digest(packed[s:e].tobytes()) for s, e in zip(starts, starts + size, strict=True)))
                    found.append((a, f, g, first - np.repeat(first[starts], size), count, repeats))
                    rows += [k] * len(starts)
                    firsts.append(first[starts])
                    sizes.append(size)
                if found:
                    a, f, g, off, count, repeats = (np.concatenate(x) for x in zip(*found, strict=True))
                    ints = [pa.array(x.astype(np.int32)) for x in (off, count, repeats)]
                    parts = pa.StructArray.from_arrays([_signed(a), _signed(f), _signed(g), *ints], ["anchor", *PHRASE, "off", "windows", "repeats"])
                    parts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32)), parts)
                    halves = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                    yield pa.record_batch([*(some[c].take(pa.array(rows)) for c in DOC), *(pa.array(halves[:, k].copy()) for k in (0, 1)), pa.array(np.concatenate(firsts).astype(np.int32)), parts], [*DOC, *NAME, "first", "parts"])

    return in_batches(_keyed(docs), parse, "doc_id long, k1 long, k2 long, c1 long, c2 long, first int, parts array<struct<anchor:long,fp1:long,fp2:long,off:int,windows:int,repeats:int>>")


def _opened(lists: DataFrame, window: int) -> DataFrame:
    """The windows of the listed phrases of each text: two fingerprints, the phrase, where in it, and where they start."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = [Rolling(b) for b in BASES[1:]]
        for batch in batches:
            for doc, text, listed in zip(batch["doc_id"], batch["text"], batch["listed"], strict=True):
                sums = [r.prefix(h) for r, h in zip(rolls, _hashes(words_of(text.as_py())), strict=True)]
                first, windows = (listed.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                off = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                start = np.repeat(first, windows) + off
                of = pa.array(np.repeat(np.arange(len(first)), windows))
                prints = (_signed(r.span(s, start, start + window)) for r, s in zip(rolls, sums, strict=True))
                yield pa.record_batch([*prints, *(listed.values.field(k).take(of) for k in (2, 3)), pa.array(off.astype(np.int32)), pa.array(np.full(len(off), doc.as_py())), pa.array(start.astype(np.int32))], ["w1", "w2", *PHRASE, "off", "doc_id", "start"])

    return in_batches(lists, open_, "w1 long, w2 long, fp1 long, fp2 long, off int, doc_id long, start int")


def references(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, k1, k2 and ``held``: the text's chunks that have phrases that occur first, or of which windows occur first,
    elsewhere.

    held: first (the chunk's) and pieces: off, windows, repeats (where a phrase stands), at_doc, at_first (its first
    occurrence), and others: its windows that occur first in none of its own occurrences (off, at_doc, at_start).
    """
    # Aggregates are written before they are joined: then either side of a join is a shuffle of its own, and a hot
    # anchor, chunk, phrase or window is split among tasks.
    cut_up = durable(chunks(docs, window, gram))
    distinct = durable(cut_up.groupBy(*NAME).agg(F.min(F.struct("doc_id", "first", "k1", "k2")).alias("at"), F.max("doc_id").alias("last"), F.first("parts").alias("parts")))
    phrases = distinct.select(*NAME, "at", "last", F.explode("parts").alias("p")).select(*NAME, "at.doc_id", "at.k1", "at.k2", "last", "p.*", (F.col("at.first") + F.col("p.off")).alias("start"))
    anchors = durable(
        phrases.groupBy("anchor")
        .agg(F.min("doc_id").alias("lo"), F.max("last").alias("hi"), F.min("fp1").alias("f"), F.max("fp1").alias("g"), F.min("fp2").alias("p"), F.max("fp2").alias("q"))
        .where("lo < hi")
        .select("anchor", F.expr("f < g or p < q").alias("crowded"))
    )
    shared = durable(phrases.join(anchors, "anchor").drop("anchor"))
    release(distinct, anchors)
    index = durable(shared.groupBy(*PHRASE).agg(F.min(F.struct("doc_id", "start", "k1", "k2")).alias("at"), F.first("windows").alias("windows"), F.first("crowded").alias("crowded")))
    lists = index.where("crowded").groupBy("at.doc_id", "at.k1", "at.k2").agg(F.collect_list(F.struct(F.col("at.start").alias("first"), "windows", *PHRASE)).alias("listed"))
    texts = _keyed(docs).where(F.length("text") >= 2 * window - 1)
    windows = durable(_opened(texts.join(lists, DOC).select("doc_id", "text", "listed"), window))
    place = F.struct("doc_id", "start")
    least = durable(windows.groupBy("w1", "w2").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most").drop("most"))
    other = F.struct("off", F.col("least.doc_id").alias("at_doc"), F.col("least.start").alias("at_start"))
    others = durable(windows.join(least, ["w1", "w2"]).where(F.col("least") < place).groupBy(*PHRASE).agg(F.collect_set(other).alias("others")))
    release(windows, least)
    known = durable(index.select(*PHRASE, F.col("at.doc_id").alias("at_doc"), F.col("at.start").alias("at_first")).join(others, PHRASE, "left"))
    release(index, others)
    piece = F.struct("off", "windows", "repeats", "at_doc", "at_first", "others")
    parsed = durable(shared.join(known, PHRASE).where("at_doc < last or others is not null").groupBy(*NAME).agg(F.collect_list(piece).alias("pieces")))
    release(shared, known)
    out = durable(cut_up.select(*DOC, *NAME, "first").join(parsed, NAME).groupBy(*DOC).agg(F.collect_set(F.struct("first", "pieces")).alias("held")))
    release(cut_up, parsed)
    return out


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[k], first[k] + 1, ... (count[k] of them) for all k, and each one's k."""
    of = np.repeat(np.arange(len(count)), count)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count), of


def factors(doc: int, held: pa.StructArray, window: int) -> list[dict]:
    """The factors of a document: start and length in words, and the document and start that they are copies of."""
    pieces = held.field(1)
    base = np.repeat(held.field(0).to_numpy().astype(np.int64), np.diff(pieces.offsets.to_numpy()))
    pieces = pieces.flatten()
    off, windows, repeats, at_doc, at_first = (pieces.field(k).to_numpy().astype(np.int64) for k in range(5))
    first = base + off
    stands = windows + repeats - 1  # either is 1
    at, of = _spread(first, stands)
    size = int(at.max(initial=-1)) + 1
    ref_doc, ref_start = np.full(size, doc), np.zeros(size, np.int64)
    ref_doc[at], ref_start[at] = at_doc[of], at_first[of] + np.where(repeats[of] > 1, 0, at - first[of])
    others = pieces.field(5)
    n = others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if n.sum():
        of = np.repeat(np.arange(len(n)), n)
        listed = others.flatten()
        off, to_doc, to_start = (listed.field(k).to_numpy().astype(np.int64) for k in range(3))
        at, which = _spread(first[of] + off, repeats[of])
        ref_doc[at], ref_start[at] = to_doc[which], to_start[which]
    at = np.flatnonzero(ref_doc < doc)
    if not len(at):
        return []
    step = np.diff(ref_start[at])
    goes_on = (np.diff(at) == 1) & (np.diff(ref_doc[at]) == 0) & ((step == 0) | (step == 1))
    lead = np.flatnonzero(np.append(True, ~goes_on))
    last = np.append(lead[1:], len(at)) - 1
    return [{"start": s, "length": e - s + window, "ref_doc": d, "ref_start": r} for s, e, d, r in zip(at[lead].tolist(), at[last].tolist(), ref_doc[at[lead]].tolist(), ref_start[at[lead]].tolist(), strict=True)]


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``row`` (a struct of all columns of docs), n_words, n_removed, kept_text and factors of each row of docs
    (doc_id, text, ...). kept_text: the words outside factors, joined by one space."""
    column = docs.columns.index("text")
    fields = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
    out = [("n_words", "long"), ("n_removed", "long"), ("kept_text", "string"), ("factors", "array<struct<start:int,length:int,ref_doc:bigint,ref_start:int>>")]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):  # bounds what is held at once
                batch = whole.slice(lo, BATCH)
                found: list[list] = [[], [], [], []]
                rows = batch["row"]
                for doc, text, held in zip(batch["doc"], rows.field(column), batch["held"], strict=True):
                    words = words_of(text.as_py())
                    parsed = factors(doc.as_py(), held.values, window) if held.is_valid else []
                    kept, at = [], 0
                    for f in parsed:
                        kept += words[at : f["start"]]
                        at = max(at, f["start"] + f["length"])
                    kept += words[at:]
                    for x, y in zip(found, (len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), parsed), strict=True):
                        x.append(y)
                yield pa.record_batch([rows, *map(pa.array, found, (pa.int64(), pa.int64(), pa.string(), fields))], ["row", *(n for n, _ in out)])

    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), *text_keys("text"))
    spans = references(docs.select("doc_id", "text"), window, gram).select(F.col("doc_id").alias("s_doc"), F.col("k1").alias("s1"), F.col("k2").alias("s2"), "held")
    joined = keyed.join(spans, F.expr("doc <=> s_doc and k1 = s1 and k2 = s2"), "left").select("row", "doc", "held")
    schema = StructType([StructField("row", docs.select(F.struct("*").alias("row")).schema[0].dataType), *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in out)).fields])
    return in_batches(joined, remove, schema)


def op1_rlz_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"), F.size("factors").alias("n_factors"))


SQL = {
    "op1_rlz_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min((doc_id, i)) AS lo FROM k GROUP BY h),
m AS (SELECT k.doc_id, i, lo FROM k JOIN f USING (h) WHERE lo[1] < k.doc_id),
b AS (SELECT *, lag(i) OVER o AS before, lag(lo) OVER o AS lo_before FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, count(*) AS n FROM b WHERE before IS NULL OR before + 1 < i OR lo_before[1] <> lo[1] OR lo[2] - lo_before[2] NOT IN (0, 1) GROUP BY doc_id),
r AS (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM m),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM r GROUP BY doc_id),
o AS (SELECT d.doc_id, d.w, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
u AS (SELECT doc_id, w[j] AS word, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM o) x ANTI JOIN r USING (doc_id, j)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM u GROUP BY doc_id)
SELECT o.doc_id, CAST(len(o.w) AS BIGINT) AS n_words, CAST(len(o.gone) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256, CAST(coalesce(c.n, 0) AS INTEGER) AS n_factors
FROM o LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""
}
