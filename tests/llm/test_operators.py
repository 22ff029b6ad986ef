"""Corpus operators against plain versions, on small tables with every odd case."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import licenses, media, mixing, packing, quality, simhash, substring_dedup, tokens, topk

SPLIT = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, quality_score int, spans int"  # two names that operators use themselves


def words(text):
    return SPLIT.findall(text or "")


def base(n, k):
    rng = np.random.default_rng(k)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


PASSAGE = base(70, 99)
TEXTS = [
    (0, base(120, 0)), (1, base(30, 1) + "  " + PASSAGE + "\n" + base(40, 2)), (2, PASSAGE), (3, base(20, 3) + " " + PASSAGE[:-3] + " " + base(20, 4)),
    (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "it " * 300), (9, "x " + "it " * 120), (10, base(120, 0)), (10, base(120, 0)),
    (None, base(120, 0)), (11, base(4000, 5) + " " + base(60, 0)), (12, "É " * 60 + base(60, 6)), (13, base(100, 7).replace(" ", "  ")),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else f"s{k % 3}", 1, 2) for k, (i, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_factors(texts, window=50):
    """Kept words and factors of each (doc_id, text), by a greedy parse against first occurrences."""
    first = {}
    for i, t in texts:
        w = words(t)
        for p in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for i, t in texts:
        w, found = words(t), []
        for p in range(len(w) - window + 1):
            if i is None or (ref := first[tuple(w[p : p + window])])[0] >= i:
                continue
            last = found[-1] if found else None
            if last and last[-1] == p - 1 and last[2] == ref[0] and ref[1] - last[4] in (0, 1):
                last[1], last[4], last[5] = last[1] + 1, ref[1], p
            else:
                found.append([p, window, *ref, ref[1], p])
        gone = {j for f in found for j in range(f[0], f[0] + f[1])}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone), tuple(tuple(f[:4]) for f in found)))
    return sorted(out, key=repr)


def parsed(df, **options):
    found = substring_dedup.substring_dedup(df, **options)
    return sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept_text, tuple(map(tuple, r.factors))) for r in found.collect()), key=repr)


def test_substring_dedup(docs, empty):
    expected = plain_factors(TEXTS)
    assert parsed(docs) == expected and any(r[2] for r in expected)
    found = substring_dedup.substring_dedup(docs)
    assert found.select("row.*").columns == docs.columns and substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_factors(spark):
    """Texts made of pieces of each other, over few words, so factors begin and end everywhere and runs repeat."""
    rng = np.random.default_rng(11)
    pool, texts = [base(30, k) for k in range(6)] + ["a b", "it it it it"], []
    for i in range(60):
        parts = [pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 5))]
        if texts and rng.random() < 0.7:
            w = words(texts[rng.integers(len(texts))][1])
            lo = int(rng.integers(0, max(1, len(w) - 5)))
            parts.insert(int(rng.integers(len(parts) + 1)), " ".join(w[lo : lo + int(rng.integers(3, 60))]))
        texts.append((int(rng.integers(0, 40)), " ".join(parts)))
    texts += [(90, "it " * 80), (91, "x " + "it " * 100 + "y"), (92, "a b " * 60), (93, "c " + "a b " * 50)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    expected = plain_factors(texts, 12)
    assert parsed(df, window=12, gram=4) == expected and sum(len(r[4]) for r in expected) > 100


def test_substring_dedup_tells_texts_of_one_id_apart(spark):
    long, other, third = base(60, 1), base(60, 2), base(81, 3)
    texts = [(1, long), (2, long), (2, third), (2, other), (3, other + " " + third)]
    assert parsed(spark.createDataFrame(texts, "doc_id long, text string")) == plain_factors(texts)


def test_substring_dedup_is_linear_in_repeats(spark):
    df = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string").unionByName(spark.range(20_000).selectExpr("7L as doc_id", f"'x {PASSAGE} y' as text"))
    found = substring_dedup.substring_dedup(df).groupBy("row.doc_id", "n_removed", "kept_text").count().collect()
    assert sorted(map(tuple, found)) == [(1, 0, PASSAGE, 1), (7, 70, "x y", 20_000)]


def test_quality(spark, docs, empty):
    good = [(i, base(80, i) + ".") for i in range(200)]
    bad = [(i, " ".join(w + "###" for w in base(80, i).split())) for i in range(200, 260)]
    many = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 260, 2)] + [(0, 1), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.fit(many, labels)
    found = {r.doc_id: r.quality_score for r in quality.score(many, model).collect()}
    assert np.mean([(found[i] >= 0.5) == (i < 200) for i in found]) > 0.97
    positives_only = quality.fit(many, labels.where("quality = 1"))
    assert np.allclose(positives_only.weights, model.weights)  # no label 0 is looked at
    odd = quality.score(docs, model)
    assert "quality_score_" in odd.columns and odd.count() == len(TEXTS) and quality.score(empty, model).count() == 0
    for blank in (quality.fit(many, labels.where("false")), quality.fit(empty, labels), quality.fit(many.where("false"), labels)):
        assert quality.score(many.limit(3), blank).first().quality_score == 0.5


def test_moments_are_of_all_texts(spark):
    texts = [(None if k % 3 == 0 else k % 2, base(20 + k, k) if k else None) for k in range(40)]
    x = np.array([[*quality.features(t).astype(float), 1.0] for _, t in texts])
    halves = np.array([-1 if h is None else h for h, _ in texts])
    for found, some in zip(quality._moments(spark.createDataFrame(texts, "half int, text string")), (x, x[halves == 0], x[halves == 1]), strict=True):
        assert np.allclose(found, some.T @ some)


def test_non_negative_risk():
    """The risk from moments is that of the rows, and no nearby weights have a lower one."""
    rng = np.random.default_rng(2)
    p, n = rng.normal(0.4, 1, (3000, quality.WIDTH)), rng.normal(-0.4, 1, (2000, quality.WIDTH))
    u = np.vstack([rng.normal(0.4, 1, (6000, quality.WIDTH)), n])
    one = lambda a: np.hstack([a, np.ones((len(a), 1))])
    moments = [one(a).T @ one(a) for a in (p, u)]
    loss = lambda z: (1 - z) ** 2 / 4
    scale = np.maximum(u.std(0), 0.02)

    def risk(w, b, prior):
        gp, gu = p @ w + b, u @ w + b
        return prior * loss(gp).mean() + max(0, loss(-gu).mean() - prior * loss(-gp).mean()) + quality.DECAY * ((w * scale) ** 2).sum()

    for prior in (0.5, 0.75, 0.95):
        model = quality.train(*moments, prior)
        least = risk(model.weights, model.bias, prior)
        for _ in range(20):
            step = rng.normal(0, 0.02, quality.WIDTH)
            assert risk(model.weights + step, model.bias + rng.normal(0, 0.05), prior) > least - 1e-3
        if prior == 0.75:  # the true one
            assert np.mean([*(p @ model.weights + model.bias > 0), *(n @ model.weights + model.bias < 0)]) > 0.85


def test_class_prior():
    rng = np.random.default_rng(4)
    for prior in (0.2, 0.5, 0.85):
        scores = lambda share, n: np.where(rng.random(n) < share, rng.normal(1, 0.5, n), rng.normal(-1, 0.5, n))
        hist = lambda x: np.histogram(x, quality.BINS, (-4, 4))[0]
        assert abs(quality.class_prior(hist(scores(1, 5000)), hist(scores(prior, 50_000))) - prior) < 0.04


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [(r.predicted, truth[r.doc_id]) for r in quality.op2_pu_quality(spark, sf).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert len(found) > 50 and np.mean([a == b for a, b in found]) > 0.95


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(120)] + [(200, [0.5] * 8), (201, [0.5] * 8), (202, None), (203, [float("nan")] * 8), (204, [float("inf")] + [0.0] * 7), (205, [None] + [0.1] * 7), (None, [0.1] * 8), (206, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 9) for i, v in vectors], "vec_id long, embedding array<float>, score int")
    q = topk.quantized(df)
    ok = {i: [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for a in (i for i in ok if i % 50 == 0):
        best = sorted((-sum(x * y for x, y in zip(ok[a], ok[b])), b) for b in ok if b != a)[:5]
        expected += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    assert rows(topk.top_k(q.where("vec_id % 50 = 0"), q, block=16, query_block=2)) == sorted(expected, key=repr)
    more = q.unionByName(q.where("vec_id = 3")).unionByName(spark.createDataFrame([(50, [9] * 8), (50, [-9] * 8)], "vec_id long, q array<long>"))
    for _ in range(3):
        more = more.unionByName(more.where("vec_id = 7"))  # eight equal rows
    vecs = [(r.vec_id, r.q) for r in more.collect()]
    best = {a: sorted((-sum(x * y for x, y in zip(v, w)), b) for v in {tuple(v) for i, v in vecs if i == a} for b, w in vecs if b != a)[:5] for a in {i for i, _ in vecs if i % 50 == 0}}
    assert rows(topk.top_k(more.where("vec_id % 50 = 0"), more, block=16)) == sorted(((a, k + 1, b, -s) for a, x in best.items() for k, (s, b) in enumerate(x)), key=repr)
    assert topk.top_k(q.where("false"), q).count() == 0 and topk.top_k(q, q.where("vec_id = 0")).where("query_id = 0").count() == 0


def test_tokens(docs, empty):
    vocabulary = [b" a", b"a", b"ab", b"abc", b"bc", b" abcd", b"cd", b"w1", b" w", b"it", b" it", b"x y"]
    pieces = {*(v for v in vocabulary if v != b"x y"), *(bytes([b]) for b in range(256))}

    def plain(word):
        n = at = 0
        while at < len(word):
            at += next(k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces)
            n += 1
        return n

    machine = tokens.automaton(vocabulary)
    rng = np.random.default_rng(0)
    for _ in range(500):
        word = bytes(rng.choice(list(b" abcdxw1it"), rng.integers(0, 12)).tolist())
        assert tokens.longest_match_count(word, *machine) == plain(word)
    assert tokens.longest_match_count(b"abcw" * 50_000, *machine) == plain(b"abcw") * 50_000
    expected = [(i, len(words(t)), sum(plain(b" " + w.encode()) for w in words(t)), len((t or "").encode())) for i, t in TEXTS]
    assert rows(tokens.token_counts(docs, vocabulary)) == sorted(expected, key=repr)
    assert tokens.token_counts(empty, vocabulary).count() == 0


def test_licenses(spark):
    texts = ["SPDX-License-Identifier: MIT cc by cc by-nc. The MIT License", None, "", "K cc BY İ", "licensed under the Apache License, Version 2.0. " * 500, "GNU General Public License, version 3. All rights reserved", "mit freundlichen", "cc,by CC-BY cc by"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0)], "doc_id long, text string, labels int")
    for r in licenses.scan(df).collect():
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if r.doc_id == 4:
            assert r.labels == "apache-2.0"
        if r.doc_id == 6:
            assert r.labels == ""
    assert 200 < len(licenses.rules()) and licenses.scan(df.where("false")).count() == 0


def plain_fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(w)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    for i, fp, _ in rows(simhash.near_duplicates(docs)):
        assert np.int64(fp).view(np.uint64) in {plain_fingerprint(t) for j, t in TEXTS if j == i}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("shard", [30, 10_000])
def test_components(spark, shard):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = [int(c) for c in centres] + [int(centres[k % 7]) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for k in range(300)] + [int(centres[0]) ^ ((1 << n) - 1) for n in range(0, 40, 3)]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    prints = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    of = {r.fp: r.component_id for r in simhash.components(prints, shard=shard).collect()}
    assert all(of[int(np.uint64(f).view(np.int64))] == root(i) for i, f in enumerate(fps))


def test_mixing(spark, docs, empty):
    known = mixing.identified(docs.select("doc_id", "text", "source")).drop("text")
    mixed = mixing.mix(known, block=200)
    found = mixed.collect()
    assert len(found) == len(TEXTS) and all(r.mix_taken <= 3 * r.mix_size for r in found) and rows(mixed) == rows(mixing.mix(known, block=200))
    size, taken = {}, {}
    for r in found:
        size[r.source] = size.get(r.source, 0) + r.mix_size
        taken[r.source] = taken.get(r.source, 0) + r.mix_taken
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    capped, total = set(), sum(size.values())
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / max(1, sum(weight[s] for s in size if s not in capped))
        more = {s for s in size if s not in capped and level * weight[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    for r in found:
        target = 3 * size[r.source] if r.source in capped else level * weight[r.source]
        assert r.mix_source_size == size[r.source] and abs(r.mix_target - target) < 1e-6 and abs(taken[r.source] - target) < 1
    dealt = mixing.deal(mixed, levels=2).collect()
    assert sum(r.mix_words for r in dealt) == sum(taken.values())
    slots = {}
    for r in dealt:
        slots.setdefault((r.mix_rank, r.mix_block, r.mix_copy), set()).add(r.mix_shard)
    assert all(len(s) == 1 for s in slots.values())
    per = [sum(s == {k} for s in slots.values()) for k in range(4)]
    assert max(per) - min(per) <= 1
    counts = {r: sum(k[0] == r for k in slots) for r in {k[0] for k in slots}}
    drawn = mixing.quotas(spark.createDataFrame(list(counts.items()), "mix_rank long, n long"), levels=2).collect()
    assert {(r.node, r.mix_rank): r.n for r in drawn} == {(k, s): sum(b[0] == s and x == {k} for b, x in slots.items()) for s in counts for k in range(4)}
    none = mixing.identified(empty.select("doc_id", "text", "source")).drop("text")
    assert mixing.mix(none).count() == 0 and mixing.deal(mixing.mix(none)).count() == 0


def test_hypergeometric_draws(spark):
    from math import comb

    for total, good, draws in ((20, 8, 10), (50, 3, 25), (7, 7, 3), (9, 0, 4), (300, 120, 150), (1, 1, 0)):
        at = [F.lit(x).cast("long") for x in (total, good, draws)]
        drawn = spark.range(8000).select(mixing.hypergeometric(*at, mixing._uniform(1, "x", "id")).alias("k")).groupBy("k").count().collect()
        seen = {r.k: r["count"] for r in drawn}
        expected = {k: 8000 * comb(good, k) * comb(total - good, draws - k) / comb(total, draws) for k in range(max(0, draws - total + good), min(draws, good) + 1)}
        assert set(seen) <= set(expected)
        large = [k for k in expected if expected[k] >= 5]
        assert sum((seen.get(k, 0) - expected[k]) ** 2 / expected[k] for k in large) < 3 * len(large) + 10


def test_quotas_of_many_sources(spark):
    counts = spark.range(700).selectExpr("id as mix_rank", "id % 5 + if(id = 0, 900, 1) as n")
    drawn = mixing.quotas(counts, levels=3).collect()
    by_source, by_shard = {}, {}
    for r in drawn:
        assert r.n >= 0
        by_source[r.mix_rank] = by_source.get(r.mix_rank, 0) + r.n
        by_shard[r.node] = by_shard.get(r.node, 0) + r.n
    assert by_source == {r.mix_rank: r.n for r in counts.collect()} and max(by_shard.values()) - min(by_shard.values()) <= 1
    assert all(70 < r.n < 155 for r in drawn if r.mix_rank == 0)


def test_mixed_rows_keep_their_columns(spark):
    names = "mix_size mix_r1 mix_block mix_shard n turn part rest".split()
    texts = [(1, "a b c", "s", None, "u1"), (1, "a b c", "s", "u1", None), (1, "a b c", "s", "u2", "u2"), (2, "d " * 50, "t", "u", "u"), (3, None, None, "u", "u")]
    rows = [(*t, *range(len(names) - 4)) for t in texts] + [(4, "e", "s", "v", "v", 0, 1, 2, 3)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, url string, URL2 string, " + ", ".join(f"{n} int" for n in names[4:]))
    found = mixing.mixed_rows(df).select("row.*")
    taken = [tuple(r) for r in found.collect()]
    assert found.schema == df.schema and set(taken) <= set(rows)
    assert all(taken.count(r) <= 3 * rows.count(r) for r in rows) and all(taken.count(r) >= rows.count(r) for r in rows if r[2] == "s") and len(taken) > len(rows) - 2


def test_best_bounds():
    from itertools import combinations

    rng = np.random.default_rng(1)
    for _ in range(60):
        n, most = int(rng.integers(1, 11)), int(rng.integers(1, 6))
        bins, counts = np.sort(rng.choice(30, n, replace=False)), rng.integers(1, 9, n)
        cost = lambda bounds: sum(c * min(b for b in bounds if b >= x) for x, c in zip(bins, counts))  # noqa: B023, E731
        best = min(cost([*c, bins[-1]]) for r in range(min(most, n)) for c in combinations(bins[:-1], r))
        bounds = packing.best_bounds(bins, counts, most)
        assert len(bounds) <= most and cost(bounds) == best
    lengths, counts = np.unique(rng.integers(0, 50_000, 3000), return_counts=True)
    bounds = packing.best_bounds(lengths, counts, 8)

    def padded(k):  # plain dynamic programming over all distinct lengths
        total, cost = np.concatenate([[0], np.cumsum(counts)]), None
        for _ in range(k):
            once = lengths * total[1:]
            cost = once if cost is None else np.array([min([once[j], *(cost[:j] + lengths[j] * (total[j + 1] - total[1 : j + 1]))]) for j in range(len(lengths))])
        return cost[-1]

    assert sum(c * bounds[np.searchsorted(bounds, x)] for x, c in zip(lengths, counts, strict=True)) == padded(8)


def test_packing(spark, docs, empty):
    found = packing.pack(docs, buckets=4, budget=500, group=5).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.length) for r in found) == sorted((i is None, i, len(words(t))) for i, t in TEXTS)
    lengths, counts = np.unique([len(words(t)) for _, t in TEXTS], return_counts=True)
    assert {r.bucket_length for r in found} == set(np.maximum(1, packing.best_bounds(lengths, counts, 4)))
    batches = {}
    for r in found:
        assert r.padding == r.bucket_length - r.length >= 0
        batches.setdefault(r.batch, []).append(r)
    for rs in batches.values():
        assert len(rs) == 1 or len(rs) * rs[0].bucket_length <= 500
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    assert packing.pack(empty).count() == 0
    same = packing.pack(spark.range(3000).selectExpr("1L as doc_id", "'a b c' as text"), budget=30, group=100).collect()
    assert len(same) == 3000 and len({(r.batch, r.slot) for r in same}) == 3000 and len({r.batch.split("-")[1] for r in same}) == 30


def test_media(docs, empty):
    texts = dict((i, t) for i, t in TEXTS)
    assert media.digest(media.encode(empty)).count() == 0 and media.clips(media.encode(empty)).count() == 0
    for r in media.digest(media.encode(docs)).collect():
        payload = media.payload_of(texts[r.doc_id] if r.doc_id is not None else base(120, 0))
        assert r.n_bytes == len((texts.get(r.doc_id, base(120, 0)) or "").encode()) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(media.write_avi(payload)).hexdigest()
        assert (r.feature, r.clips) == plain_feature(payload)
    found = {}
    for c in media.clips(media.encode(docs.where("doc_id <> 10"))).collect():
        found.setdefault(c.doc_id, []).append((c.clip, c.start_ms, c.end_ms, c.first_frame, c.n_frames))
    for i, rows_ in found.items():
        times = plain_feature(media.payload_of(texts[i]))[1].split(",")
        assert [(f"{a}-{b}", k, 40 * f, 40 * (f + n)) for k, a, b, f, n in sorted(rows_)] == [(t, k, *map(int, t.split("-"))) for k, t in enumerate(times)]


def plain_samples(unit):
    """The 576 samples of a frame, block by block, from its bytes, by the definition of the inverse transform."""
    zigzag = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    out = []
    for b in range(9):
        values = [v if v >= 128 else v - 255 for v in unit[64 * b : 64 * b + 64]]
        dc = values[0] if b % 3 == 0 else dc + values[0]  # noqa: F821
        values[0] = dc
        for y in range(8):
            for x in range(8):
                s = 0.0
                for (u, v), c in zip(zigzag, values, strict=True):
                    s += (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * c * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16)
                out.append(min(255, max(0, round(s) + 128)))
    return out


KNOWN = {}


def plain_feature(payload):
    frames = [payload[k : k + 576] for k in range(0, len(payload), 576)]
    for f in frames:
        if f not in KNOWN:
            KNOWN[f] = plain_samples(f)
    counts = [[sum(x >> 4 == b for x in KNOWN[f]) for b in range(16)] for f in frames]
    change = [0.0] + [sum(abs(x - y) for x, y in zip(a, b)) / (2 * 576) for a, b in zip(counts, counts[1:])]
    starts = [0]
    for k in range(1, len(frames)):
        before = change[max(1, k - 8) : k] or [0.0]
        if change[k] > 0.12 and change[k] > np.mean(before) + 3 * np.std(before) + 1e-9:
            starts.append(k)
    ends = [*starts[1:], len(frames)]
    light = sum(sum(KNOWN[f]) for f in frames) / (576 * len(frames))
    feature = f"frames={len(frames)};shots={len(starts)};longest={max(b - a for a, b in zip(starts, ends))};peak={max(change):.4f};brightness={light:.3f}"
    return feature, ",".join(f"{40 * a}-{40 * b}" for a, b in zip(starts, ends))


def test_media_round_trip(monkeypatch):
    monkeypatch.setattr(media, "CHUNK", 20)
    for n in (1, 2, 7, 50):
        payload = os.urandom(576 * n)
        avi = media.write_avi(payload)
        assert media.decode_frames(avi).tobytes() == payload
        # the bitwise decoder reads the same bytes: a header that differs keeps the fast way out
        k = int(media.read_index(avi)[0, 0]) + 6
        other = bytearray(avi)
        other[k] = 2  # a quantisation step, which coefficients do not depend on, but samples do
        if n > 1:
            assert media.decode_frames(bytes(other)).tobytes() == payload


def test_pictures_and_shots():
    unit = os.urandom(576)
    (_, samples), = media.decode(media.write_avi(unit))
    blocks = [samples[0, 8 * r : 8 * r + 8, 8 * c : 8 * c + 8].ravel().tolist() for r in range(3) for c in range(3)]
    assert sum(blocks, []) == plain_samples(unit)
    frames = np.concatenate([np.zeros((20, 24, 24), np.uint8), np.full((20, 24, 24), 200, np.uint8)])
    assert media.shots(media.histograms(frames))[0].tolist() == [0, 20]
    avi = media.write_avi(bytes(576) * 20 + bytes([200]) * 576 * 20)
    assert media.shots(np.concatenate([media.histograms(s) for _, s in media.decode(avi)]))[0].tolist() == [0, 20]
