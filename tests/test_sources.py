"""Readers, writers and tables against small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from tessera.operators import bio, core, graph, matrix
from tessera.sources import io, tables


def triples(df):
    return sorted((r.row, r.col, r.val) for r in df.collect())


def arcs_graph():
    """An undirected test graph given as arcs in both directions, with loops and repeats: three cliques in a ring."""
    edges = set()
    for c in range(3):
        edges |= {(5 * c + a, 5 * c + b) for a in range(5) for b in range(a)}
    edges |= {(0, 5), (5, 10), (10, 0)}
    arcs = sorted(edges) + [(b, a) for a, b in sorted(edges)][:9] + [(4, 4)]
    return arcs, 3 * 10 + 1


def test_arcs(spark, tmp_path):
    arcs, count = arcs_graph()
    (tmp_path / "in").mkdir()
    half = len(arcs) // 2
    for name, part in (("a", arcs[:half]), ("b", arcs[half:])):
        (tmp_path / "in" / name).write_text("".join(f"{a}\t{b}\n" for a, b in part))
    whole = tmp_path / "arcs"
    whole.write_text("".join(f"{a}\t{b}\n" for a, b in arcs))
    expected = sorted({(min(a, b), max(a, b), 1) for a, b in arcs if a != b})
    (tmp_path / "starts").write_text(",".join(str(a) for a, _ in arcs))
    (tmp_path / "ends").write_text(",".join(str(b) for _, b in arcs) + ",\n")
    for found in (io.read_arcs(spark, str(whole)), io.read_arcs(spark, str(tmp_path / "in")), io.read_arc_files(spark, str(tmp_path / "starts"), str(tmp_path / "ends"))):
        assert triples(found) == expected
        for f in (graph.count_triangles, graph.count_triangles_parity, graph.count_triangles_by_edges):
            assert f(found).first().triangles == count
    assert triples(io.read_arcs(spark, str(whole), reverse=True)) == sorted((b, a, v) for a, b, v in expected)


def test_triples(spark, tmp_path):
    (tmp_path / "t").write_text("a\tx\t2\nb\ty\n\n")
    assert triples(io.read_triples(spark, str(tmp_path / "t"))) == [("a", "x", 2.0), ("b", "y", 1.0)]
    rows = [f"r{k % 97}" for k in range(3000)]
    with gzip.open(tmp_path / "rows.gz", "wt") as f:
        f.write(",".join(rows) + ",")
    (tmp_path / "cols").write_text("\n".join(f"c{k}" for k in range(3000)))
    (tmp_path / "vals").write_text(",".join(map(str, range(3000))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = io.read_triple_files(spark, str(tmp_path / "rows.gz"), str(tmp_path / "cols"), str(tmp_path / "vals"))
        assert triples(found) == sorted((rows[k], f"c{k}", float(k)) for k in range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plain = io.read_triple_files(spark, str(tmp_path / "rows.gz"), str(tmp_path / "cols"))
    schema = io.adjacency_schema(plain)
    assert plain.agg(F.sum("val")).first()[0] == 3000 and schema["degree"].where("col = 'out'").agg(F.sum("val")).first()[0] == 3000


def test_grid(spark, tmp_path):
    (tmp_path / "g.csv").write_text("longitude,latitude,ndsi,ndsi_count,land_sea_mask\n1,52,0.25,3,1\n")
    assert sorted(map(tuple, io.read_grid(spark, str(tmp_path / "g.csv")).collect())) == [("00001", "lsm", "00052", 1.0), ("00001", "ndsi", "00052", 0.25)]


def test_strings(spark):
    df = io.insert_strings(spark, "a,b,", "x;y;", "1 2 ", family="f", visibility="A&B")
    assert sorted(map(tuple, df.collect())) == [("a", "x", "1", "f", "A&B"), ("b", "y", "2", "f", "A&B")]
    assert tuple(io.to_strings(df).first()) == ("a,b,", "x,y,", "1,2,")
    with pytest.raises(ValueError):
        io.insert_strings(spark, "a,b,", "x,", "1,")
    assert triples(io.insert_strings(spark, "1,2,4,", "2;9;3;", "5 7 8 ", integers=True)) == [(1, 2, 5), (2, 9, 7)]


def test_jdbc(spark, monkeypatch):
    rows = spark.createDataFrame([(7, "a\nb", None), (8, "", 2)], "id long, name string, n int")

    class Reader:
        def format(self, kind):
            assert kind == "jdbc"
            return self

        def options(self, **options):
            assert options == {"url": "jdbc:x", "query": "select 1", "user": "u"}
            return self

        def load(self):
            return rows

    monkeypatch.setattr(type(spark), "read", property(lambda self: Reader()))
    assert triples(io.read_jdbc(spark, "jdbc:x", "select 1", "id", user="u")) == [(7, "n", "NULL"), (7, "name", "ab"), (8, "n", "2"), (8, "name", "NULL")]
    assert triples(io.read_jdbc(spark, "jdbc:x", "select 1", user="u")) == [(1, "id", "7"), (1, "n", "NULL"), (1, "name", "ab"), (2, "id", "8"), (2, "n", "2"), (2, "name", "NULL")]


def test_write(spark, tmp_path):
    df = spark.createDataFrame([(k % 7, k, k) for k in range(50)], "row long, col long, val long")
    seen = io.write(df, str(tmp_path / "t"), transposed_path=str(tmp_path / "back"), ranges=3, reduce=F.sum("val"))
    assert seen == {"entries": 50, "reduced": 1225}
    assert triples(spark.read.parquet(str(tmp_path / "t"))) == triples(df) and triples(spark.read.parquet(str(tmp_path / "back"))) == triples(core.transpose(df))


def test_tables(spark):
    df = spark.createDataFrame([(k, 0, 1) for k in range(100)], "row long, col long, val long")
    try:
        tables.create(df, "t_a", splits=[9, 59])
        assert tables.exists(spark, "t_a") and "t_a" in tables.names(spark) and tables.entries(spark, ["t_a"]) == 100
        assert sorted(tuple(r) for r in tables.splits(spark, "t_a").collect()) == [(0, 9, 10), (10, 59, 50), (60, 99, 40)]
        tables.put(df.where("row < 5"), "t_a")
        tables.clone(spark, "t_a", "t_b")
        tables.compact(spark, "t_b", 2)
        assert tables.entries(spark, ["t_a", "t_b"]) == 210 and tables.splits(spark, "t_b").count() == 2
        tables.set_property(spark, "t_b", "wedges", "12")
        assert tables.get_property(spark, "t_b", "wedges") == "12" and tables.get_property(spark, "t_b", "none") is None
    finally:
        for t in ("t_a", "t_b"):
            tables.delete(spark, t)
    assert not tables.exists(spark, "t_a")


def test_kmer_pipe_and_tables(spark):
    lines = spark.createDataFrame([("AACGT,12",), ("TTTGC,3",)], "value string")
    value = lambda **options: sorted(r.value for r in bio.pipe(lines, 5, **options).collect())
    assert value() == ["AACGT,12", "TTTGC,3"] and value(mode="reverse") == ["ACGTT,12", "GCAAA,3"] and value(mode="canonical") == ["AACGT,12", "GCAAA,3"]
    assert value(mode="canonical", binary=True)[0] == bytearray(b"\x00\x05AACGT" + (12).to_bytes(8, "big"))
    some = bio.generate(spark, 2000, 8, gc=0.7)
    assert 0.66 < some.select(F.avg(bio.gc_content(F.col("col")))).first()[0] < 0.74 and some.count() == 2000
    assert sorted(r.col for r in some.where("row < 5").collect()) == sorted(r.col for r in bio.generate(spark, 5, 8, gc=0.7).collect())
    packed = some.select("col", bio.unpack(bio.pack(F.col("col")), 8).alias("back"))
    assert packed.where("col <> back").count() == 0 and bio.all_kmers(spark, 4).count() == 256


def test_relative_abundance_identity(spark):
    """The sample distance is the Bray-Curtis distance of rows that sum to one."""
    df = spark.createDataFrame([(r, c, float(1 + (r * 7 + c * c) % 5)) for r in range(8) for c in range(12) if (r + c) % 3], "row long, col long, val double")
    total = df.groupBy("row").agg(F.sum("val").alias("s"))
    shares = df.join(total, "row").select("row", "col", (F.col("val") / F.col("s")).alias("val"))
    near = lambda d: {(r.row, r.col): round(r.val, 9) for r in d.collect()}
    assert near(bio.sample_distance(df)) == near(bio.bray_curtis(shares)) and len(near(bio.bray_curtis(df))) == 28
    assert near(bio.sharing_pairs(df)) == near(bio.bray_curtis(df)) and near(bio.sharing_pairs(df, "jaccard")) == near(bio.weighted_jaccard(df))


def test_pairs_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bio, "BLOCK", 3)
    df = spark.createDataFrame([(r, 0, r + 1) for r in range(20)], "row long, col long, val long")
    assert sorted((r.row, r.col) for r in bio.bray_curtis(df).collect()) == [(a, b) for a in range(20) for b in range(a + 1, 20)]


def test_newton_inverse(spark):
    m = spark.createDataFrame([(i, j, float((i == j) * 5 + (i * 3 + j) % 4)) for i in range(6) for j in range(6)], "row long, col long, val double")
    labels = spark.range(6).withColumnRenamed("id", "node")
    near = lambda d: {(r.row, r.col): round(r.val, 6) for r in d.collect() if round(r.val, 6)}
    assert near(matrix.inverse_newton(m, labels)) == near(matrix.inverse(m, list(range(6))))


def test_normal_topics(spark):
    a = spark.range(4000).selectExpr("id as row", "id as col", "1L as val")
    mean = matrix.initial_topics(a, 2, "normal").agg(F.avg("val"), F.min("val")).first()
    assert 0.77 < mean[0] < 0.83 and mean[1] >= 0  # sqrt(2 / pi)


def test_column_combiners():
    folds = core.designate(core.designate({}, "a,b,", "SUM"), "c;", "max")
    assert core.list_combining(folds) == {"SUM": ["a", "b"], "max": ["c"]} and core.revoke(folds, "a,c,") == {"b": "SUM"}
    with pytest.raises(ValueError):
        core.designate(folds, "a,", "min")
    with pytest.raises(ValueError):
        core.designate(folds, "d,", "median")


def test_scalars_of_each_type(spark):
    at = lambda kind, rows: spark.createDataFrame([(str(k), "c", v) for k, v in enumerate(rows)], "row string, col string, val string").withColumn("val", F.col("val").cast(kind))
    vals = lambda df: [r.val for r in df.orderBy("row").collect()]
    assert vals(core.apply_scalar(at("long", ["9007199254740993", "-7", "1"]), "divide", 2)) == [4503599627370496, -3]
    assert list(map(str, vals(core.apply_scalar(at("decimal(10,2)", ["7.50", "0.05"]), "divide", 2)))) == ["3.75", "0.03"]
    assert vals(core.apply_scalar(at("double", ["7", "1"]), "divide", 2)) == [3.5, 0.5]
    assert vals(core.apply_scalar(at("long", ["3", "-2"]), "power", 3)) == [27, -8]
    assert list(map(str, vals(core.apply_scalar(at("decimal(10,1)", ["1.5"]), "power", 2)))) == ["2.3"]
    big = at("long", ["94906267", "94906267", "1"]).withColumn("row", F.lit("r"))
    assert vals(core.combine(big, "times")) == [94906267**2]
    assert vals(core.apply_scalar(at("long", ["0", "4"]), "left", 9)) == [0, 4] and vals(core.ewise(at("long", ["0"]), at("long", ["3"]), "left")) == [0]


def test_observed_products(spark):
    from pyspark.sql import Observation

    a = spark.createDataFrame([("x", "a", 2), ("x", "b", 3), ("y", "a", 1)], "row string, col string, val long")
    seen = Observation()
    core.mxm(a, a, observed=seen).collect()
    assert seen.get == {"partial_products": 5}


def test_streams(spark, tmp_path):
    from tessera.streaming import tables as streams

    rows = [("a", "x", 1, "2024-01-01 00:01:00"), ("a", "x", 2, "2024-01-01 00:04:00"), ("a", "x", 2, "2024-01-01 00:04:00"), ("a", "y", 5, "2024-01-01 01:30:00"), ("b", "x", 7, "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "row string, col string, val long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def ran(found, name, mode="append"):
        streams.write(found, str(tmp_path / name), str(tmp_path / f"{name}_state"), mode).awaitTermination(120)
        return spark.read.parquet(str(tmp_path / name)).collect()

    tumbling = {(r.window.start.minute + 60 * r.window.start.hour, r.row, r.col): (r.n, r.val) for r in ran(streams.windowed(stream(), "10 minutes"), "w")}
    assert tumbling == {(0, "a", "x"): (3, 5), (90, "a", "y"): (1, 5)}  # the last window is open still
    assert sorted((r.row, r.n, r.val) for r in ran(streams.sessions(stream(), "30 minutes"), "s")) == [("a", 1, 5), ("a", 3, 5)]
    assert sorted((r.row, r.col) for r in ran(streams.first_copies(stream()), "f")) == [("a", "x"), ("a", "y"), ("b", "x")]


