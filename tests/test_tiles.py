"""Pairs by tiles and masked products against plain Python, and how many rows they shuffle."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F
from tessera.operators import bio, graph, tiles
from tessera.plans.catalogue import QUERIES


def shuffled(spark, run):
    """Rows that the stages of run() wrote for shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def rows():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = rows()
    run()
    return sum(n for k, n in rows().items() if k not in before)


@pytest.mark.parametrize("kind", ["long", "double"])
@pytest.mark.parametrize("every", [True, False])
def test_pairs(spark, monkeypatch, kind, every):
    monkeypatch.setattr(tiles, "AT_ONCE", 7)
    monkeypatch.setattr(tiles, "LINES", 10)
    rng, number = random.Random(5), int if kind == "long" else float
    rows = [(f"r{rng.randrange(23):02d}", rng.randrange(9), number(rng.randrange(-3, 9))) for _ in range(90)]
    rows += [("r03", 4, None), ("r05", None, number(3)), (None, 4, number(3)), ("r99", 100, number(1))]
    sums, entries, low = defaultdict(int), defaultdict(list), Counter()
    for r, c, v in rows:
        if r is not None:
            sums[r] += v or 0
            entries[c].append((r, v))
    for c, of in entries.items():
        for (r, x), (q, y) in itertools.product(of, of):
            if c is not None and r < q:
                low[r, q] += min((v for v in (x, y) if v is not None), default=0)
    want = {(a, b): low[a, b] for a, b in (itertools.combinations(sorted(sums), 2) if every else low)}
    found = tiles.pairs(spark.createDataFrame(rows, f"row string, col int, val {kind}"), every, 4).collect()
    assert {(r.row, r.col): r.low for r in found} == want and len(found) == len(want)
    assert [r for r in found if (r.s or 0) != sums[r.row] or (r.t or 0) != sums[r.col]] == []


def test_masked_products(spark, monkeypatch):
    monkeypatch.setattr(tiles, "AT_ONCE", 9)
    monkeypatch.setattr(tiles, "CELLS", 11)
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(260)}
    triples = sum(a < b < c and (a, c) in edges and (b, c) in edges for a, b in edges for c in range(40))
    df = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", 1) for a, b in edges], "row string, col string, val long")
    assert graph.count_triangles_parity(df).first().triangles == graph.count_triangles_by_edges(df).first().triangles == triples
    alone = spark.createDataFrame([("a", "b", 1), ("c", "c", 1)], "row string, col string, val long")
    for count in (graph.count_triangles_parity, graph.count_triangles_by_edges):
        assert count(alone).first().triangles == count(alone.limit(0)).first().triangles == 0


@pytest.mark.parametrize("count", [graph.count_triangles_parity, graph.count_triangles_by_edges])
def test_wedges_are_not_shuffled(spark, count):
    """1,500 nodes of about 100 neighbours: 75,000 edges, and some 1.8 million wedges."""
    df = spark.range(1500 * 50).selectExpr("id % 1500 as row", "pmod(xxhash64(id), 1500) as col", "1L as val")
    assert shuffled(spark, lambda: count(df).collect()) < 700_000


@pytest.mark.parametrize("pairs", [bio.bray_curtis, bio.weighted_jaccard, graph.jaccard])
def test_pairs_are_not_shuffled(spark, pairs):
    """Some 600 rows share columns: 180,000 pairs."""
    df = spark.range(1800).selectExpr("id % 600 as row", "1000 + id % 7 as col", "1 + id % 5 as val")
    assert shuffled(spark, lambda: pairs(df).collect()) < 60_000


@pytest.mark.parametrize("digits", [None, 4])
def test_jaccard_values(spark, monkeypatch, digits):
    """Against plain sets, with loops and edges given twice; tiles of 4 rows. d and e have 64 neighbours, one in common."""
    for name, least in (("AT_ONCE", 7), ("LINES", 10)):
        monkeypatch.setattr(tiles, name, least)
    monkeypatch.setattr(tiles.pairs, "__defaults__", (False, 4, None))
    rng = random.Random(7)
    edges = [tuple(rng.choices([f"n{k:02d}" for k in range(21)], k=2)) for _ in range(70)]
    edges += [(n, "both") for n in "de"] + [(n, f"{n}{k:02d}") for n in "de" for k in range(63)] + [("x", "x"), ("d", "d00")]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    part = {(a, b): len(near[a] & near[b]) / len(near[a] | near[b]) for a, b in itertools.combinations(sorted(near), 2) if near[a] & near[b]}
    want = part if digits is None else {k: int(v * 10**digits + 0.5) / 10**digits for k, v in part.items()}
    df = spark.createDataFrame([(a, b, 9) for a, b in edges], "row string, col string, val long")
    found = graph.jaccard(df, digits=digits).collect()
    assert {(r.row, r.col): r.val for r in found} == want and len(found) == len(want) and want["d", "e"] > 0
    assert graph.jaccard(df.limit(0), digits=digits).collect() == []


def test_jaccard_is_finished_in_blocks(spark, monkeypatch):
    """Pairs reach the JVM with three columns and rounded; rows for blocks are lists without nulls or values."""
    sent, streamed = [], tiles._streamed
    monkeypatch.setattr(tiles, "_streamed", lambda df, *a: sent.append((df, *a)) or streamed(df, *a))
    plan = QUERIES["jaccard"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    (df, _, schema), = sent
    assert "round(" not in plan and schema == "row bigint, col bigint, val double"
    lists = [c for c, kind in df.dtypes if kind.startswith("array")]
    assert sorted(lists) == ["keys", "sums", "x_at", "y_at"] and df.where("kind = 2").where(F.concat(*(F.col(c).isNull().cast("string") for c in lists)).contains("true")).isEmpty()
