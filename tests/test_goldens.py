"""Small results known by hand."""

import inspect
import random

import pytest

from tessera.operators import bio, core, graph, matrix
from tessera.sources import io


@pytest.fixture
def make(spark):
    return lambda rows, kind="row string, col string, val long": spark.createDataFrame(rows, kind)


def got(df):
    return {(r.row, r.col): round(r.val, 4) if isinstance(r.val, float) else r.val for r in df.collect()}


def nodes(df):
    return {r.node for r in df.collect()}


G5 = [("v1", "v2"), ("v1", "v3"), ("v1", "v4"), ("v2", "v3"), ("v3", "v4"), ("v2", "v5")]


def test_product(make):
    at = core.transpose(make([("A1", "C1", 5), ("A1", "C2", 2), ("A2", "C1", 4)]))
    b = core.transpose(make([("B1", "C2", 3), ("B1", "C3", 3), ("B2", "C1", 3), ("B2", "C2", 3)]))
    assert got(core.mxm(at, b)) == {("A1", "B1"): 6, ("A1", "B2"): 21, ("A2", "B2"): 12}
    assert core.partial_products(at, b).count() == 4


def test_element_wise(make):
    a = make([("A1", "C1", 5), ("A1", "C2", 2), ("A2", "C1", 4)])
    b = make([("A1", "C2", 3), ("A1", "C3", 3), ("A2", "C1", 3), ("A2", "C2", 3)])
    assert got(core.ewise_mult(a, b)) == {("A1", "C2"): 6, ("A2", "C1"): 12}
    assert got(core.ewise_add(a, b)) == {("A1", "C1"): 5, ("A1", "C2"): 5, ("A1", "C3"): 3, ("A2", "C1"): 7, ("A2", "C2"): 3}
    assert got(core.ewise_add(a, b, "minus"))["A1", "C3"] == 3  # a missing side passes the other through
    assert got(core.ewise_add(a, b, "minus", 0))["A1", "C3"] == -3


def test_filters(make):
    rows = make([("r", f"c{i}", i) for i in range(4)] + [("g", "x", 1), ("h", "x", 1), ("h", "y", 1), ("a", "x", 1)])
    assert {r for r, _ in got(core.row_size(rows, 2, 3))} == {"h"}
    top = make([("r1", "c1", 4.5), ("r1", "c2", 6.0), ("r1", "c3", 5.0), ("r1", "c4", 1.1), ("r1", "c5", 8.0), ("r2", "c1", 1.0)], "row string, col string, val double")
    assert set(got(core.top_k(top, 3))) == {("r1", "c2"), ("r1", "c3"), ("r1", "c5"), ("r2", "c1")}
    same = make([("a", "x", 1), ("b", "x", 1), ("c", "x", 2), ("d", "x", 1)])
    assert {r for r, _ in got(core.drop_repeated_rows(same))} == {"a", "c", "d"}


def test_triangles_and_jaccard(make):
    e = make([(a, b, 1) for a, b in G5])
    for f in (graph.count_triangles, graph.count_triangles_parity, graph.count_triangles_by_edges):
        assert f(e).first().triangles == 2
    assert got(graph.jaccard(e)) == {("v1", "v2"): 0.2, ("v1", "v3"): 0.5, ("v1", "v4"): 0.25, ("v1", "v5"): 0.3333, ("v2", "v3"): 0.2, ("v2", "v4"): 0.6667, ("v3", "v4"): 0.25, ("v3", "v5"): 0.3333}


def test_k_truss(make):
    e = make([(a, b, 1) for a, b in G5])
    assert graph.k_truss(e, 3).count() == 10 and graph.k_truss(e, 2).count() == 12
    more = make([(a, b, 1) for a, b in [*G5, ("v2", "v4")]])
    assert graph.k_truss(more, 4).count() == 12 and graph.k_truss(more, 4, only="v1,:,v4,").count() == 12
    assert graph.k_truss_incidence(io.incidence(e).select("edge", "node"), 3).count() == 10


def test_k_truss_goes_on_until_it_settles(make):
    e = make([(a, b, 1) for a, b in G5])
    for truss, x in ((graph.k_truss, e), (graph.k_truss_incidence, io.incidence(e).select("edge", "node"))):
        assert inspect.signature(truss).parameters["rounds"].default is None
        with pytest.raises(RuntimeError, match="not settled"):
            truss(x, 3, rounds=1)
        assert truss(x, 3, rounds=2).count() == 10


def test_tfidf(make):
    counts = {"e1": {"v1": 7, "v2": 6}, "e2": {"v1": 2, "v3": 6}, "e3": {"v1": 3, "v5": 1}, "e4": {"v2": 2}, "e5": {"v4": 9, "v5": 1}, "e6": {"v1": 2, "v3": 1, "v4": 4}}
    x = got(graph.tfidf(make([(d, w, n) for d, ws in counts.items() for w, n in ws.items()])))
    assert (x["e1", "v1"], x["e2", "v3"], x["e4", "v2"], x["e6", "v4"]) == (0.4246, 0.8240, 1.0986, 0.6278) and len(x) == 12


def test_bfs(make, spark):
    e = make([("v0", "v1", 5), ("v1", "v2", 2), ("v2", "v0", 4), ("v0", "vBig", 7), ("v1", "vBig", 7), ("v2", "vBig", 7), ("vBig", "v0", 9), ("vBig", "v1", 9), ("vBig", "v2", 9)])
    start = spark.createDataFrame([("v0",)], "node string")
    deg = spark.createDataFrame([("v0", 2), ("v1", 2), ("v2", 2), ("vBig", 3)], "node string, deg long")
    for degrees in (None, deg):
        walk = graph.bfs(e, start, 3, 1, 2, degrees=degrees)
        assert nodes(walk.reached) == {"v0", "vBig"} and got(walk.walked) == {(a, b): v for (a, b), v in got(e).items() if a != "vBig"}
    assert nodes(graph.bfs(e, "v0,", 3, 1, 2).reached) == {"v0", "vBig"} and nodes(graph.bfs(e, "v0,:,v1,", 1).reached) == {"v1", "v2", "vBig"}
    assert got(graph.bfs(e, None, 1).walked) == got(e) and got(graph.bfs(e, None, 2).walked) == {k: 2 * v for k, v in got(e).items()}
    assert graph.bfs(e, start, 0).walked.count() == 0 and graph.bfs(e, start, 0).reached.count() == 0
    line = make([("a", "b", 1), ("b", "c", 1)])
    ended = graph.bfs(line, "a,", 9)
    assert ended.reached.count() == 0 and len(got(ended.walked)) == 2 and nodes(graph.bfs(line, "a,", 9, union=True).reached) == {"b", "c"}
    assert {r.node for r in graph.bfs(e, start, 3, 1, 2, True)[1].collect()} == {"v0", "v1", "v2", "vBig"}


def test_bfs_incidence(make, spark):
    e = [("v0", "v1", 5), ("v1", "v2", 2), ("v2", "v0", 4), ("v0", "vBig", 7), ("v1", "vBig", 7), ("v2", "vBig", 7), ("vBig", "v0", 9), ("vBig", "v1", 9), ("vBig", "v2", 9)]
    rows = [x for k, (a, b, v) in enumerate(e) for x in ((f"e{k}", "out", a, v), (f"e{k}", "in", b, v))]
    table = make(rows, "edge string, role string, node string, val long")
    deg = spark.createDataFrame([("v0", 2), ("v1", 2), ("v2", 2), ("vBig", 3)], "node string, deg long")
    walk = graph.bfs_incidence(table, "v0,", 3, low=1, high=2, degrees=deg, visibility="a")
    assert walk.steps.count() == 12 and nodes(walk.reached) == {"v0", "vBig"} and walk.walked.select("vis").distinct().first().vis == "a"
    assert {(r.edge, r.role, r.node): r.val for r in walk.walked.collect()} == {x[:3]: x[3] for x in rows if x[0] in {f"e{k}" for k in range(6)}}
    assert nodes(graph.bfs_incidence(table, "v0,", 3, low=1, high=2, degrees=deg, union=True).reached) == {"v0", "v1", "v2", "vBig"}
    with pytest.raises(ValueError):
        graph.bfs_incidence(table, "v0,", 3, low=1, high=2)
    multi = make([*rows, ("e1", "HEYHEY", "v0", 3)], "edge string, role string, node string, val long")
    two = {(r.edge, r.role, r.node): r.val for r in graph.bfs_incidence(multi, "v1,", 1, ends=("in", "HEYHEY")).walked.collect()}
    assert two["e1", "out", "v1"] == 4 and two["e1", "HEYHEY", "v0"] == 3


def test_bfs_single_table(make, spark):
    both = make([("v0", "v1", 5), ("v1", "v0", 5), ("v1", "v2", 2), ("v2", "v1", 2), ("v0", "vBig", 6), ("vBig", "v0", 6), ("v1", "vBig", 7), ("vBig", "v1", 7), ("v2", "vBig", 8), ("vBig", "v2", 8), ("v9", "vBig", 9), ("vBig", "v9", 9)])
    deg = spark.createDataFrame([("v0", 2), ("v1", 3), ("v2", 2), ("v9", 1), ("vBig", 4)], "node string, deg long")
    for degrees in (None, deg):
        walk = graph.bfs_single_table(both, "v0,", 3, 1, 3, degrees=degrees, copy_degrees=True, in_degrees="count")
        assert nodes(walk.reached) == {"v1", "vBig"} and walk.steps.count() == 18
        one_way = {("v0", "v1"): 15, ("v1", "v2"): 4, ("v0", "vBig"): 12, ("v1", "vBig"): 7, ("v2", "vBig"): 8}
        assert got(walk.walked) == one_way | {(b, a): v for (a, b), v in one_way.items()}
        assert {r.node: r.deg for r in walk.degrees.collect()} == {"v0": 4, "v1": 3, "v2": 2, "vBig": 3}  # v0 is copied twice
    summed = graph.bfs_single_table(both, "v0,", 3, 1, 3, in_degrees="sum", union=True)
    assert {r.node: r.deg for r in summed.degrees.collect()} == {"vBig": 27} and nodes(summed.reached) == {"v0", "v1", "v2", "vBig"}


def test_line_graph_and_scc(make):
    e = make([("a", "b", 2), ("b", "c", 4)])
    assert got(graph.line_graph(e)) == {("a|b", "b|c"): 2.0}
    both = graph.undirected(e)
    assert got(graph.line_graph(both, False))["a|b", "b|c"] == 3.0
    e = make([(a, b, 1) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"), ("vBig", "v0"), ("vBig", "v1"), ("vBig", "v2"))])
    assert {(r.row, r.col) for r in graph.scc_pairs(e).collect()} == {(a, b) for a in ("v0", "v1", "v2") for b in ("v0", "v1", "v2")}
    assert {r.component for r in graph.scc(e).collect()} == {"v0"}
    for start, found in (("v0", {"v0", "v1", "v2"}), ("vBig", set())):
        assert nodes(graph.scc_of(e, make([(start,)], "node string"))) == found


@pytest.mark.parametrize("seed", range(4))
def test_scc_and_truss_on_random_graphs(make, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(rng.choice((20, 40, 70)))}
    e = make([(a, b, 1) for a, b in pairs], "row long, col long, val long")
    reach = {a: {a2 for a2, _ in ()} for a in range(25)}
    for a in range(25):
        todo = [a]
        while todo:
            for x, y in pairs:
                if x == todo[-1] and y not in reach[a]:
                    reach[a].add(y)
                    todo.insert(0, y)
            todo.pop()
    expected = {(a, min(b for b in reach[a] if a in reach[b])) for a in range(25) if a in reach[a]}
    assert {(r.node, r.component) for r in graph.scc(e).collect()} == expected
    plain = {(min(p), max(p)) for p in pairs if p[0] != p[1]} | {(a, b) for a in range(5) for b in range(a + 1, 6)}
    near = lambda left, x: {b if a == x else a for a, b in left if x in (a, b)}
    left = plain
    while True:
        kept = {(a, b) for a, b in left if len(near(left, a) & near(left, b)) >= 2}
        if kept == left:
            break
        left = kept
    truss = graph.k_truss(make([(a, b, 1) for a, b in plain], "row long, col long, val long"), 4)
    assert {(r.row, r.col) for r in truss.collect()} == {p for a, b in left for p in ((a, b), (b, a))}
    e = make([(b, a, 1) for a, b in plain], "row long, col long, val long")
    count = sum(len(near(plain, a) & near(plain, b)) for a, b in plain) // 3
    for f in (graph.count_triangles, graph.count_triangles_parity, graph.count_triangles_by_edges):
        assert f(e).first().triangles == count


def test_matrix(make):
    m = make([(1, 1, 4.0), (1, 2, 7.0), (2, 1, 2.0), (2, 2, 6.0)], "row long, col long, val double")
    assert got(matrix.inverse(m, [1, 2])) == {(1, 1): 0.6, (1, 2): -0.7, (2, 1): -0.2, (2, 2): 0.4}
    assert matrix.frobenius(m, m).first().norm == 0


def test_kmers_and_distances(make):
    s = make([("f", "ACGTAC", 1)])
    assert got(bio.kmers(s, 4)) == {("f", "ACGT"): 1, ("f", "CGTA"): 1, ("f", "GTAC"): 1}
    assert set(got(bio.kmers(s, 4, drop_last=True))) == {("f", "ACGT"), ("f", "CGTA")}
    x = make([("a", "k", 2), ("a", "l", 2), ("b", "k", 4), ("c", "z", 1)])
    assert got(bio.bray_curtis(x)) == {("a", "b"): 0.5, ("a", "c"): 1.0, ("b", "c"): 1.0}
    assert got(bio.sample_distance(x)) == {("a", "b"): 0.5}


def test_visibility(make):
    df = make([("a", "1", ""), ("a", "2", "A"), ("a", "3", "A&B"), ("a", "4", "A|C"), ("a", "5", "B")], "row string, col string, vis string").selectExpr("*", "1 as val")
    assert {c for _, c in got(core.visible(df, {"A"}))} == {"1", "2", "4"}


def test_nested_visibility(make):
    shown = ["", "a&b", "c|(a&b)", "(a|c)&(b|d)", "((a))", "a&(b|(c&d))", '"x y"|c', "a & b"]
    hidden = ["a&c", "(a|c)&d", "a&b|c", "a)", ")(a", "a b", "a&", "a&&b", "()", "a)(b", "a&(c|(a&d))"]
    df = make([("r", v, v) for v in shown + hidden] + [("r", "none", None)], "row string, col string, vis string").selectExpr("*", "1 as val")
    assert {c for _, c in got(core.visible(df, {"a", "b", "x y"}))} == {*shown, "none"}


def test_two_version_gate(make):
    df = make([("a", "x", 5, 1), ("a", "x", 2, 2), ("a", "y", 1, 1), ("a", "y", 3, 2), ("b", "x", 9, 1), *(("b", "y", 9, t) for t in range(3))], "row string, col string, val long, ts long")
    assert got(core.two_version_gate(df, 3)) == {("a", "y"): 1}


def test_exploded_schema(make):
    df = make([("t|1", "w|a", 2, "e1"), ("t|2", "w|a", 3, "e2"), ("plain", "w|b", 4, "e3")], "row string, col string, val long, edge string")
    t = io.exploded_schema(df)
    assert got(t["degree_t"]) == {("w|a", "in"): 2, ("w|b", "in"): 1}
    assert got(t["field"]) == {("t", "out"): 2} and got(t["field_t"]) == {("w", "in"): 3}
    assert got(t["edge_t"])[("in|w|a", "e2")] == 3 and got(t["edge_degree_t"])[("in|w|a", "deg")] == 2
    assert got(io.exploded_schema(df, weights=True)["degree_t"])[("w|a", "in")] == 5


def test_stream(make, spark, tmp_path):
    from tessera.streaming import tables

    make([("a", "x", 1), ("a", "x", 2), ("b", "y", 3)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row string, col string, val long").parquet(str(tmp_path / "in"))
    q = tables.running_combine(stream).writeStream.outputMode("complete").format("memory").queryName("combined").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got(spark.table("combined")) == {("a", "x"): 3, ("b", "y"): 3}


def test_every_nth_line_of_each_file(spark, tmp_path):
    for name, n in (("a", 500), ("b", 7)):
        (tmp_path / f"{name}.csv").write_text("seqid,seq\n" + "".join(f"{k},{name}{k}\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = io.read_sequences(spark, str(tmp_path), 3, 1)
        assert found.rdd.getNumPartitions() > 1
        assert sorted(r.col for r in found.collect()) == sorted(f"{name}{k}" for name, n in (("a", 500), ("b", 7)) for k in range(1, n, 3))
        assert io.read_sequences(spark, str(tmp_path)).count() == 507
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_orders_over_many_ranges(spark):
    rows = [(r, c, 1 + (r // 3) % 2) for r in range(300) for c in range(1 + r // 100)]
    df = spark.createDataFrame(rows, "row long, col long, val long").repartition(7)
    content = {}
    for r, c, v in rows:
        content.setdefault(r, set()).add((c, v))
    assert sorted({r.row for r in core.drop_repeated_rows(df).collect()}) == [r for r in sorted(content) if content[r] != content.get(r - 1)]
    parts = {r.part: (r.last_row, r.entries) for r in core.even_splits(df, 4).collect()}
    expected, seen = {}, 0
    for r in sorted(content):
        seen += len(content[r])
        part = (seen - 1) * 4 // len(rows)
        expected[part] = (r, expected.get(part, (0, 0))[1] + len(content[r]))
    assert parts == expected


def test_long_walk_is_checkpointed(spark):
    ring = spark.createDataFrame([(k, (k + 1) % 9, 1) for k in range(9)], "row long, col long, val long")
    walked, reached, *_ = graph.bfs(ring, spark.createDataFrame([(0,)], "node long"), 20)
    assert [r.node for r in reached.collect()] == [20 % 9] and walked.agg({"val": "sum"}).first()[0] == 20
