"""Every registered query of the engine's own operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bio, core, graph, matrix
from tessera.sources import io, matrices as m

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the oracle, by the name of the matrix.
TABLES = {
    "sp": "sp AS (SELECT l_suppkey r, l_partkey c, CAST(sum(l_quantity) AS BIGINT) v FROM lineitem GROUP BY 1, 2)",
    "s96": "s96 AS (SELECT l_suppkey r, l_partkey c, CAST(sum(l_quantity) AS BIGINT) v FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1, 2)",
    "s97": "s97 AS (SELECT l_suppkey r, l_partkey c, CAST(sum(l_quantity) AS BIGINT) v FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1, 2)",
    "op": "op AS (SELECT l_orderkey r, l_partkey c, CAST(sum(l_quantity) AS BIGINT) v FROM lineitem GROUP BY 1, 2)",
    "co": "co AS MATERIALIZED (SELECT DISTINCT a.l_partkey r, b.l_partkey c FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)",
    "un": "un AS MATERIALIZED (SELECT r, c FROM co UNION ALL SELECT c, r FROM co)",
    "nt": "nt AS MATERIALIZED (SELECT s_nationkey r, c_nationkey c, CAST(sum(l_quantity) AS BIGINT) v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
    "ns": "ns AS MATERIALIZED (SELECT a.r, a.c, a.v - coalesce(b.v, 0) v FROM nt a LEFT JOIN nt b ON a.r = b.c AND a.c = b.r WHERE a.v > coalesce(b.v, 0))",
    "dt": "dt AS MATERIALIZED (SELECT doc_id r, w c, count(*) v FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) w FROM documents) WHERE w <> '' GROUP BY 1, 2)",
    "ue": "ue AS (SELECT user_id r, event_type c, ts, CAST(round(value * 100) AS BIGINT) v FROM events)",
}
_NEEDS = {"un": ("co",), "ns": ("nt",)}


def _with(tables: str, *more: str) -> str:
    names: list[str] = []
    for t in tables.split():
        names += [x for x in (*_NEEDS.get(t, ()), t) if x not in names]
    return "WITH " + ", ".join([*(TABLES[t] for t in names), *more]) + " "


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def matrix_query(name: str, sql: str | None, source: Callable, f: Callable[[DataFrame], DataFrame], columns: str | None = "r c v"):
    """A query over one matrix; triples are given as r, c, v."""
    query(name, sql)(lambda spark, d: f(source(spark, d)).select("row", "col", "val").toDF(*columns.split()) if columns else f(source(spark, d)))


SP, CO, NT, NS = m.supplier_part, m.co_purchase, m.nation_trade, m.nation_surplus
texts = lambda df: df.select(F.format_string("s%06d", "row").alias("row"), F.format_string("p%06d", "col").alias("col"), "val")
SPX = lambda s, d: texts(SP(s, d))  # noqa: E731  labels as text, for range strings
TEXT = "x AS (SELECT format('s{:06d}', r) r, format('p{:06d}', c) c, v FROM sp)"

# --- products
_AAT = "SELECT x.r r, y.r c, CAST({agg} AS BIGINT) v FROM sp x JOIN sp y ON x.c = y.c GROUP BY 1, 2"
for _name, _mult, _plus, _agg in (("mxm_plus_times", "times", "plus", "sum(x.v * y.v)"), ("mxm_min_plus", "plus", "min", "min(x.v + y.v)"), ("mxm_max_times",
        "times", "max", "max(x.v * y.v)"), ("mxm_any_pair", "pair", "any", "1"), ("mxm_max_min", "min", "max", "max(least(x.v, y.v))")):
    matrix_query(_name, _with("sp") + _AAT.format(agg=_agg), SP, lambda a, p=_mult, q=_plus: core.mxm(core.transpose(a), core.transpose(a), p, q))
matrix_query("mxm_partial_products", _with("sp") + "SELECT count(*) n FROM sp x JOIN sp y ON x.c = y.c", SP, lambda a: core.partial_products(core.transpose(a),
        core.transpose(a)).agg(F.count("*").alias("n")), None)


def _years(f):
    return lambda s, d: f(SP(s, d, 1996), SP(s, d, 1997)).select("row", "col", "val").toDF("r", "c", "v")


_P = "SELECT x.c r, y.c c, x.v * y.v v FROM {} x JOIN {} y ON x.r = y.r"
query("mxm_two_years", _with("s96 s97") + "SELECT r, c, CAST(sum(v) AS BIGINT) v FROM (" + "SELECT x.r r, y.r c, x.v * y.v v FROM s96 x JOIN s97 y ON x.c = y.c"
    + ") GROUP BY 1, 2")(_years(lambda a, b: core.mxm(core.transpose(a), core.transpose(b))))
_T = "SELECT x.r r, y.r c, x.v * y.v v FROM {} x JOIN {} y ON x.c = y.c"
query("mxm_also_aa_bb", _with("s96 s97") + f"SELECT r, c, CAST(sum(v) AS BIGINT) v FROM ({_T.format('s96', 's97')} UNION ALL {_T.format('s96', 's96')} UNION ALL {_T.format('s97', 's97')}) GROUP BY 1, 2")(
    _years(lambda a, b: core.mxm(core.transpose(a), core.transpose(b), also_aa=True, also_bb=True)))
query("mxm_emit_a", _with("s96 s97") + f"SELECT r, c, CAST(sum(v) AS BIGINT) v FROM ({_T.format('s96', 's97')} UNION ALL SELECT c, r, v FROM s96) GROUP BY 1, 2")(
    _years(lambda a, b: core.mxm(core.transpose(a), core.transpose(b), emit_a=True)))
matrix_query("mxm_row_col_filter", _with("sp", TEXT) + "SELECT a.r r, b.r c, CAST(sum(a.v * b.v) AS BIGINT) v FROM x a JOIN x b ON a.c = b.c WHERE a.c BETWEEN 'p000010' AND 'p000900' AND (a.r <= "
    "'s000040' OR a.r = 's000077') AND b.r >= 's000020' GROUP BY 1, 2", SPX, lambda a: core.mxm(core.transpose(a), core.transpose(a), row_filter="p000010,:,p000900,",
        col_filter_a=":,s000040,s000077,", col_filter_b="s000020,:,"))

# --- element-wise
_KEYS = "coalesce(a.r, b.r) r, coalesce(a.c, b.c) c"
_ON = "ON a.r = b.r AND a.c = b.c"
for _name, _sql, _f in (
    ("ewise_mult", f"SELECT a.r, a.c, a.v * b.v v FROM s96 a JOIN s97 b {_ON}", lambda a, b: core.ewise_mult(a, b)),
    ("ewise_add", f"SELECT {_KEYS}, coalesce(a.v, 0) + coalesce(b.v, 0) v FROM s96 a FULL JOIN s97 b {_ON}", lambda a, b: core.ewise_add(a, b)),
    ("ewise_minus_passthrough", f"SELECT * FROM (SELECT {_KEYS}, CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE a.v - b.v END v FROM s96 a FULL JOIN s97 b {_ON}) WHERE v <> 0",
        lambda a, b: core.ewise_add(a, b, "minus")),
    ("ewise_minus_outer", f"SELECT * FROM (SELECT {_KEYS}, coalesce(a.v, 0) - coalesce(b.v, 0) v FROM s96 a FULL JOIN s97 b {_ON}) WHERE v <> 0", lambda a, b: core.ewise_add(a, b, "minus", 0)),
    ("ewise_left", f"SELECT a.r, a.c, CASE WHEN b.v IS NULL THEN a.v ELSE greatest(a.v, b.v) END v FROM s96 a LEFT JOIN s97 b {_ON}", lambda a, b: core.ewise(a, b, "max", "left")),
    ("ewise_right", f"SELECT b.r, b.c, CASE WHEN a.v IS NULL THEN b.v ELSE least(a.v, b.v) END v FROM s96 a RIGHT JOIN s97 b {_ON}", lambda a, b: core.ewise(a, b, "min", "right")),
    ("ewise_symdiff", f"SELECT * FROM s96 a WHERE NOT EXISTS (SELECT 1 FROM s97 b WHERE a.r = b.r AND a.c = b.c) UNION ALL SELECT * FROM s97 a WHERE NOT EXISTS (SELECT 1 FROM s96 b WHERE a.r = b.r AND a.c = b.c)",
        lambda a, b: core.symmetric_difference(a, b)),
    ("row_select_semi", "SELECT * FROM s96 a WHERE EXISTS (SELECT 1 FROM s97 b WHERE a.c = b.c)", lambda a, b: core.transpose(core.select_rows_of(core.transpose(a), core.transpose(b)))),
    ("row_select_anti", "SELECT * FROM s96 a WHERE NOT EXISTS (SELECT 1 FROM s97 b WHERE a.c = b.c)", lambda a, b: core.transpose(core.select_rows_of(core.transpose(a), core.transpose(b), True))),
    ("delete_keys", "SELECT * FROM s96 a WHERE NOT EXISTS (SELECT 1 FROM s97 b WHERE a.r = b.r AND a.c = b.c)", core.delete_cells),
):
    query(_name, _with("s96 s97") + _sql)(_years(_f))

# --- selection
for _name, _where, _f in (
    ("range_rows", "r BETWEEN 's000003' AND 's000020' OR r = 's000050'", lambda a: core.select_range(a, "s000003,:,s000020,s000050,")),
    ("range_cols", "c >= 'p000100'", lambda a: core.select_range(a, "p000100,:,", "col")),
    ("range_negated", "NOT (r <= 's000030')", lambda a: core.select_range(a, ":,s000030,", negate=True)),
    ("prefix_rows", "starts_with(r, 's00001')", lambda a: core.find(a, "s00001*,")),
    ("row_and_col_search", "r IN ('s000001', 's000007') AND c BETWEEN 'p000000' AND 'p000500'", lambda a: core.find(a, "s000001,s000007,", "p000000,:,p000500,")),
    ("find_page", "true ORDER BY r, c LIMIT 40", lambda a: core.page(a, 40)),
    ("find_next_page", "r > 's000004' OR (r = 's000004' AND c > 'p000017') ORDER BY r, c LIMIT 40", lambda a: core.page(a, 40, ("s000004", "p000017"))),
    ("minmax_filter", "v BETWEEN 20 AND 60", lambda a: core.min_max(a, 20, 60)),
):
    matrix_query(_name, _with("sp", TEXT) + f"SELECT r, c, v FROM x WHERE {_where}", SPX, _f)
for _which, _test in core.TRIANGLES.items():
    matrix_query(f"triangular_{_which}", _with("nt") + f"SELECT r, c, v FROM nt WHERE {_test.replace('row', 'r').replace('col', 'c')}", NT, lambda a, w=_which: core.triangle(a, w))
matrix_query("row_size_filter", _with("op") + "SELECT r, c, v FROM op WHERE r IN (SELECT r FROM op GROUP BY r HAVING count(*) BETWEEN 2 AND 3)", m.order_part, lambda a: core.row_size(a, 2, 3))
matrix_query("top_k_per_row", _with("sp") + "SELECT r, c, v FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) k FROM sp) WHERE k <= 10", SP, lambda a: core.top_k(a, 10))
matrix_query("dedup_rows", _with("op", "g AS (SELECT c r, 1 c, count(*) v FROM op GROUP BY 1), q AS (SELECT *, lag(v) OVER (ORDER BY r) p FROM g)") + "SELECT r, c, v FROM q WHERE p IS NULL OR p <> v",
    m.order_part, lambda a: core.drop_repeated_rows(a.groupBy(F.col("col").alias("row")).agg(F.count("*").alias("val")).withColumn("col", F.lit(1))))
matrix_query("sample_hash", _with("sp") + "SELECT r, c, v FROM sp WHERE CAST('0x' || substr(md5(r || '|' || c), 1, 8) AS UBIGINT) < 429496729", SP, lambda a: core.sample(a, 0.1))
matrix_query("even_splits", _with("sp",
        "g AS (SELECT r, count(*) n FROM sp GROUP BY r), q AS (SELECT r, n, CAST(floor((sum(n) OVER (ORDER BY r) - 1) * 8 / sum(n) OVER ()) AS "
        "INTEGER) part FROM g)") + "SELECT part, max(r) last_row, CAST(sum(n) AS BIGINT) entries FROM q GROUP BY part", SP, lambda a: core.even_splits(a, 8),
    None)

# --- maps
for _name, _sql, _f in (
    ("apply_scalar_left", "SELECT r, c, 100 - v v FROM sp WHERE v <> 100", lambda a: core.apply_scalar(a, "minus", 100, False)),
    ("apply_scalar_right", "SELECT r, c, v * 3 v FROM sp", lambda a: core.apply_scalar(a, "times", 3)),
    ("apply_constant", "SELECT r, c, CAST(1 AS BIGINT) v FROM sp", lambda a: core.constant(a, 1).withColumn("val", F.col("val").cast("long"))),
    ("retain_row", "SELECT r, '' c, CAST(sum(v) AS BIGINT) v FROM sp GROUP BY r", core.retain_row),
    ("constant_col", "SELECT r, 'all' c, CAST(sum(v) AS BIGINT) v FROM sp GROUP BY r", lambda a: core.constant_col(a, "all")),
    ("row_to_diagonal", "SELECT r, r c, CAST(sum(v) AS BIGINT) v FROM sp GROUP BY r", core.row_to_diagonal),
    ("val_to_col", "SELECT r, CAST(v AS VARCHAR) c, CAST(1 AS BIGINT) v FROM sp", core.val_to_col),
    ("transpose", "SELECT c r, r c, v FROM sp", core.transpose),
    ("scalar_divide_long", "SELECT r, c, v // 7 v FROM sp WHERE v >= 7", lambda a: core.apply_scalar(a, "divide", 7)),
    ("scalar_power", "SELECT r, c, v * v v FROM sp", lambda a: core.apply_scalar(a, "power", 2)),
    ("scalar_set_left", "SELECT r, c, v FROM sp", lambda a: core.apply_scalar(a, "left", 5)),
    ("scalar_max", "SELECT r, c, greatest(v, 40) v FROM sp", lambda a: core.apply_scalar(a, "max", 40)),
):
    matrix_query(_name, _with("sp") + _sql, SP, _f)

# --- reductions
for _name, _sql, _f in (
    ("degree_count", "SELECT r node, count(*) deg FROM sp GROUP BY r", core.degrees),
    ("degree_weight", "SELECT r node, CAST(sum(v) AS BIGINT) deg FROM sp GROUP BY r", lambda a: core.degrees(a, True)),
    ("count_entries", "SELECT count(*) entries FROM sp", core.count_entries),
    ("count_rows", 'SELECT count(DISTINCT r) "rows" FROM sp', core.count_rows),
    ("gather_cols", "SELECT DISTINCT c col FROM sp", core.gather),
    ("stats_by_row", "SELECT r, min(v) min, max(v) max, CAST(sum(v) AS BIGINT) sum, count(v) count FROM sp GROUP BY r", lambda a: core.stats(a, "row").withColumnRenamed("row", "r")),
    ("stats_merged", "SELECT c, min(v) min, max(v) max, CAST(sum(v) AS BIGINT) sum, count(v) count FROM sp GROUP BY c", lambda a: core.merge_stats(core.stats(a), "col").withColumnRenamed("col", "c")),
):
    matrix_query(_name, _with("sp") + _sql, SP, _f, None)
matrix_query("wedge_total", _with("un", "g AS (SELECT r, count(*) n FROM un GROUP BY r)") + "SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) wedges FROM g", CO,
    lambda a: core.wedge_total(graph.undirected(a)), None)
_first = lambda s, d: m.user_event(s, d).groupBy("row", "col", "ts").agg(F.max("val").alias("val"))  # noqa: E731  one version a time
_UE = "u AS (SELECT r, c, ts, max(v) v FROM ue GROUP BY 1, 2, 3)"
matrix_query("stats_combiner", _with("ue", _UE) + "SELECT r, c, min(v) min, max(v) max, CAST(sum(v) AS BIGINT) sum, count(v) count FROM u GROUP BY 1, 2", _first,
    lambda a: core.stats(a).withColumnRenamed("row", "r").withColumnRenamed("col", "c"), None)
matrix_query("combining_columns", _with("ue", _UE) + "SELECT r, c, CAST(CASE c WHEN 'click' THEN sum(v) WHEN 'error' THEN max(v) WHEN 'view' THEN min(v) ELSE arg_max(v, ts) END AS BIGINT) v "
    "FROM u GROUP BY 1, 2", _first, lambda a: core.combining_columns(a, {"click": "plus", "error": "max", "view": "min"}))
matrix_query("latest_version", _with("ue", _UE) + "SELECT r, c, arg_max(v, ts) v FROM u GROUP BY 1, 2", _first, core.latest_version)
matrix_query("sum_after_threshold", _with("ue", _UE) + "SELECT r, c, CAST(sum(v) FILTER (ts >= TIMESTAMP '2024-01-10') AS BIGINT) v, arg_max(v, ts) FILTER (ts < TIMESTAMP '2024-01-10') before "
    "FROM u GROUP BY 1, 2", _first, lambda a: core.sum_after(a, F.lit("2024-01-10").cast("timestamp")).toDF("r", "c", "v", "before"), None)
_orders = lambda s, d: m.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_orderkey").alias("ts")).agg(
    F.sum("l_quantity").cast("long").alias("val"))
matrix_query("two_version_gate",
    "WITH z AS (SELECT l_suppkey r, l_partkey c, l_orderkey ts, CAST(sum(l_quantity) AS BIGINT) v FROM lineitem GROUP BY 1, 2, 3) SELECT r, c, "
    "CAST(1 AS BIGINT) v FROM z GROUP BY 1, 2 HAVING count(*) = 2 AND arg_max(v, ts) >= 20", _orders, lambda a: core.two_version_gate(a, 20))
_keyed = lambda a: io.exploded_schema(a.select(F.concat_ws("|", "col", "row").alias("row"), F.concat(F.lit("day|"), F.to_date("ts").cast("string")).alias("col"), "val"))
matrix_query("exploded_schema_fields", _with("ue", _UE) + "SELECT c r, 'out' c, count(*) v FROM u GROUP BY 1 UNION ALL SELECT 'day', 'in', count(*) FROM u",
    _first, lambda a: (t := _keyed(a))["field"].unionByName(t["field_t"]))
matrix_query("exploded_schema_degrees", _with("ue", _UE) + "SELECT 'day|' || CAST(ts AS DATE) r, 'in' c, count(*) v FROM u GROUP BY 1", _first, lambda a: _keyed(a)["degree_t"])
_labels = lambda: F.element_at(F.array(*map(F.lit, ("", "a&(b|(c&d))", "(a|c)&d", "b|(c&d)"))), (F.col("row") % 4 + 1).cast("int"))
matrix_query("visible_labels", _with("sp") + "SELECT r, c, v FROM sp WHERE r % 4 <> 2", SP, lambda a: core.visible(a.withColumn("vis", _labels()), {"a", "b"}))

# --- graphs
_node = lambda s, n, kind="long": s.createDataFrame([(n,)], f"node {kind}")
_walk = lambda walked: walked.select("row", "col", "val").toDF("r", "c", "v")
_UV = "SELECT r, c, CAST(1 AS BIGINT) v FROM un WHERE r = 5"
_F1 = "f1 AS MATERIALIZED (SELECT DISTINCT c FROM un WHERE r = 5)"
query("bfs_adjacency_k2", _with("un", _F1) + f"SELECT r, c, CAST(sum(v) AS BIGINT) v FROM ({_UV} UNION ALL SELECT r, c, 1 FROM un WHERE r IN (SELECT c FROM f1)) GROUP BY 1, 2")(
    lambda s, d: _walk(graph.bfs(graph.undirected(CO(s, d)), _node(s, 5), 2)[0]))
query("bfs_union", _with("un", _F1) + "SELECT c node FROM f1 UNION SELECT c FROM un WHERE r IN (SELECT c FROM f1)")(lambda s, d: graph.bfs(graph.undirected(CO(s, d)), _node(s, 5), 2, union=True)[1])
query("bfs_degree_filtered", _with("un", _F1, "g AS (SELECT r FROM un GROUP BY r HAVING count(*) BETWEEN 1 AND 110)") + "SELECT r, c, CAST(sum(v) AS BIGINT) v FROM (SELECT r, c, 1 v FROM un WHERE r = 5 AND r IN (SELECT r FROM g) UNION ALL SELECT r, c, 1 FROM "
    "un WHERE r IN (SELECT c FROM f1 WHERE 5 IN (SELECT r FROM g)) AND r IN (SELECT r FROM g)) GROUP BY 1, 2")(lambda s, d: _walk(graph.bfs(graph.undirected(CO(s, d)), _node(s, 5), 2, 1, 110)[0]))
query("bfs_incidence_k2", _with("nt", "f1 AS (SELECT DISTINCT c FROM nt WHERE r = 3)",
        "w AS (SELECT r, c, v FROM nt WHERE r = 3 UNION ALL SELECT r, c, v FROM nt WHERE r IN (SELECT c FROM f1))") + "SELECT r || '|' || c AS edge, role, node, CAST(sum(v) AS BIGINT) val FROM (SELECT r, c, 'out' AS role, r AS node, v FROM w UNION ALL SELECT "
    "r, c, 'in', c, v FROM w) GROUP BY r, c, role, node")(lambda s, d: graph.bfs_incidence(io.incidence(NT(s, d)), _node(s, 3, "int"), 2)[0])
query("bfs_single_table_k2", _with("un", _F1, "s1 AS (SELECT r, c FROM un WHERE r = 5)", "s2 AS (SELECT r, c FROM un WHERE r IN (SELECT c FROM f1))") + "SELECT r, c, count(*) v FROM (SELECT r, c FROM s1 UNION ALL SELECT c, r FROM s1 WHERE c <> 5 UNION ALL SELECT r, c FROM s2 UNION ALL SELECT "
    "c, r FROM s2 WHERE c NOT IN (SELECT c FROM f1)) GROUP BY 1, 2")(lambda s, d: _walk(graph.bfs_single_table(graph.undirected(CO(s, d)), _node(s, 5), 2)[0]))
_rounds, _last = [], "un"
for _i in range(1, 8):
    _rounds.append(f"t{_i} AS MATERIALIZED (SELECT e.r, e.c FROM {_last} e JOIN (SELECT a.c r, b.c c FROM {_last} a JOIN {_last} b ON a.r = b.r AND a.c <> b.c GROUP BY 1, 2 HAVING count(*) >= 10) s ON e.r = s.r AND e.c = s.c)")
    _last = f"t{_i}"
query("ktruss_adj", _with("un", *_rounds) + "SELECT r, c, CAST(1 AS BIGINT) v FROM t7")(lambda s, d: _walk(graph.k_truss(CO(s, d), 12)))
query("ktruss_edge", _with("un", *_rounds) + "SELECT r || '|' || c AS edge, unnest([r, c]) AS node FROM t7 WHERE r < c")(lambda s, d: graph.k_truss_incidence(io.incidence(CO(s, d)).select("edge", "node"),
        12))
_TRI = "SELECT count(*) triangles FROM co a JOIN co b ON a.c = b.r JOIN co z ON z.r = a.r AND z.c = b.c"
for _name, _f in (("triangles_join", graph.count_triangles), ("triangles_parity", graph.count_triangles_parity), ("triangles_adj_edge", graph.count_triangles_by_edges)):
    matrix_query(_name, _with("co") + _TRI, CO, _f, None)
_round9 = lambda df: df.withColumn("val", F.when(F.col("val") == 1, F.col("val")).otherwise(F.round("val", 9)))  # noqa: E731  most pairs that share nothing are at 1
matrix_query("jaccard", _with("un", "g AS (SELECT r, count(*) n FROM un GROUP BY r)",
        "p AS (SELECT a.c r, b.c c, count(*) k FROM un a JOIN un b ON a.r = b.r AND a.c < b.c GROUP BY 1, 2)") + "SELECT p.r, p.c, round(k / (x.n + y.n - k), 9) v FROM p JOIN g x ON p.r = x.r JOIN g y ON p.c = y.r",
    CO, lambda a: graph.jaccard(a, digits=9))
matrix_query("tfidf", _with("dt", "t AS (SELECT r, sum(v) s FROM dt GROUP BY r)", "f AS (SELECT c, count(*) n FROM dt GROUP BY c)") + "SELECT r, c, round(v / s * ln(1 + (SELECT count(*) FROM t) / (1 + n)), 9) v FROM dt JOIN t USING (r) JOIN f USING (c)",
    m.document_term, lambda a: _round9(graph.tfidf(a)))
_LINE = "i AS (SELECT c m, CAST(sum(v) AS DOUBLE) w, count(*) p FROM ns GROUP BY c), o AS (SELECT r m, count(*) q FROM ns GROUP BY r)"
matrix_query("line_graph_directed", _with("ns", _LINE) + "SELECT a.r || '|' || a.c r, b.r || '|' || b.c c, round(w / (p * q), 9) v FROM ns a JOIN ns b ON a.c = b.r JOIN i ON i.m = a.c JOIN o ON o.m "
    "= a.c", NS, lambda a: _round9(graph.line_graph(a)))
matrix_query("line_graph_cycles", _with("ns", _LINE,
        "d AS (SELECT i.m, w / (p * coalesce(q, 0) + p * (p - 1)) x FROM i LEFT JOIN o ON i.m = o.m WHERE p * coalesce(q, 0) + p * (p - 1) > 0)") + "SELECT r, c, round(sum(v), 9) v FROM (SELECT a.r || '|' || a.c r, b.r || '|' || b.c c, x v FROM ns a JOIN ns b ON a.c = b.r JOIN d ON d.m = "
    "a.c UNION ALL SELECT a.r || '|' || a.c, b.r || '|' || b.c, x FROM ns a JOIN ns b ON a.c = b.c AND a.r <> b.r JOIN d ON d.m = a.c) GROUP BY " "1, 2", NS,
    lambda a: _round9(graph.line_graph(a, extra_cycles=True)))
matrix_query("line_graph_undirected", _with("nt", "i AS (SELECT c m, CAST(sum(v) AS DOUBLE) w, count(*) p FROM nt GROUP BY c)",
        "n AS (SELECT least(CAST(a.r AS VARCHAR), CAST(a.c AS VARCHAR)) || '|' || greatest(CAST(a.r AS VARCHAR), CAST(a.c AS VARCHAR)) r, "
        "least(CAST(b.r AS VARCHAR), CAST(b.c AS VARCHAR)) || '|' || greatest(CAST(b.r AS VARCHAR), CAST(b.c AS VARCHAR)) c, w / (p * (p - 1)) v "
        "FROM nt a JOIN nt b ON a.c = b.c AND a.r <> b.r JOIN i ON i.m = a.c AND p > 1)") + "SELECT r, c, round(sum(v), 6) v FROM n WHERE r <> c GROUP BY 1, 2",
    NT, lambda a: graph.line_graph(a, directed=False).withColumn("val", F.round("val", 6)))
_REACH = "WITH RECURSIVE " + ", ".join((TABLES["nt"], TABLES["ns"])) + ", h(r, c) AS (SELECT r, c FROM ns UNION SELECT h.r, ns.c FROM h JOIN ns ON h.c = ns.r), s AS (SELECT a.r, a.c FROM h a JOIN h b ON a.r = b.c AND a.c = b.r) "
matrix_query("scc_pairs", _REACH + "SELECT r, c FROM s", NS, lambda a: graph.scc_pairs(a).select(F.col("row").alias("r"), F.col("col").alias("c")), None)
matrix_query("scc_components", _REACH + "SELECT r node, min(c) component FROM s GROUP BY r", NS, graph.scc, None)

# --- matrices
_NMF = (
    "w AS (SELECT r, k, CAST('0x' || substr(md5(r || '|' || k), 1, 8) AS UBIGINT) / 4294967296.0 v FROM (SELECT DISTINCT r FROM sp), (SELECT unnest([1, 2]) k))",
    "g AS (SELECT sum(CASE WHEN a.k = 1 AND b.k = 1 THEN a.v * b.v END) p, sum(CASE WHEN a.k = 1 AND b.k = 2 THEN a.v * b.v END) q, sum(CASE WHEN a.k = 2 AND b.k = 2 THEN a.v * b.v END) s FROM w a JOIN w b ON a.r = b.r)",
    "y AS (SELECT c, sum(CASE WHEN k = 1 THEN w.v * sp.v END) y1, sum(CASE WHEN k = 2 THEN w.v * sp.v END) y2 FROM sp JOIN w ON sp.r = w.r GROUP BY c)",
    "h AS MATERIALIZED (SELECT * FROM (SELECT 1 k, c, (s * y1 - q * y2) / (p * s - q * q) v FROM y, g UNION ALL SELECT 2, c, (p * y2 - q * y1) / (p * s - q * q) FROM y, g) WHERE v > 0)",
)


def _one_round(s, d):
    a = SP(s, d)
    return a, *matrix.nmf_step(a, matrix.initial_topics(a, 2), 2)


query("nmf_one_round", _with("sp", *_NMF) + "SELECT CAST(k AS BIGINT) r, c, round(v, 6) v FROM h")(lambda s, d: _one_round(s, d)[2].select(F.col("row").alias("r"),
        F.col("col").alias("c"), F.round("val", 6).alias("v")))
_GRAM = "g{0} AS (SELECT sum(CASE WHEN a.k = 1 AND b.k = 1 THEN a.v * b.v END) p, coalesce(sum(CASE WHEN a.k = 1 AND b.k = 2 THEN a.v * b.v END), 0) q, sum(CASE WHEN a.k = 2 AND b.k = 2 THEN a.v * b.v END) s FROM {1} a JOIN {1} b ON a.{2} = b.{2})"
_SIDE = "y{0} AS (SELECT sp.{3} AS e, coalesce(sum(CASE WHEN k = 1 THEN x.v * sp.v END), 0) y1, coalesce(sum(CASE WHEN k = 2 THEN x.v * sp.v END), 0) y2 FROM sp JOIN {1} x ON sp.{2} = x.{2} GROUP BY 1)"
_HALF = "{4} AS MATERIALIZED (SELECT * FROM (SELECT 1 k, e AS {3}, (s * y1 - q * y2) / (p * s - q * q) v FROM y{0}, g{0} UNION ALL SELECT 2, e, (p * y2 - q * y1) / (p * s - q * q) FROM y{0}, g{0}) WHERE v > 0)"
_ALL_ROUNDS, _from = [_NMF[0].replace("w AS", "w0 AS MATERIALIZED", 1)], "w0"
for _i in range(5):
    for _tag, _on, _out, _to in ((f"a{_i}", "r", "c", f"h{_i}"), (f"b{_i}", "c", "r", f"w{_i + 1}")):
        _ALL_ROUNDS += [x.format(_tag, _from, _on, _out, _to) for x in (_GRAM, _SIDE, _HALF)]
        _from = _to
query("nmf_converged", _with("sp", *_ALL_ROUNDS[:-3]) + "SELECT CAST(k AS BIGINT) r, c, round(v, 4) v FROM h4")(
    lambda s, d: matrix.nmf(SP(s, d), 2, 5, tolerance=-1.0, kind="uniform")[1].select(F.col("row").alias("r"), F.col("col").alias("c"), F.round("val", 4).alias("v"))
)
query("matrix_inverse", _with("sp", *_NMF[:2]) + "SELECT CAST(r AS BIGINT) r, CAST(c AS BIGINT) c, round(v, 9) v FROM (SELECT 1 r, 1 c, s / (p * s - q * q) v FROM g UNION ALL SELECT 1, 2, "
    "-q / (p * s - q * q) FROM g UNION ALL SELECT 2, 1, -q / (p * s - q * q) FROM g UNION ALL SELECT 2, 2, p / (p * s - q * q) FROM g)")(lambda s, d: (lambda w: matrix.inverse(core.mxm(w, w), [1, 2]))(matrix.initial_topics(SP(s, d), 2)).select(F.col("row").alias("r"),
        F.col("col").alias("c"), F.round("val", 9).alias("v")))
query("project_rows", _with("sp", *_NMF,
        "n AS (SELECT sum(CASE WHEN a.k = 1 AND b.k = 1 THEN a.v * b.v END) p, sum(CASE WHEN a.k = 1 AND b.k = 2 THEN a.v * b.v END) q, sum(CASE "
        "WHEN a.k = 2 AND b.k = 2 THEN a.v * b.v END) s FROM h a JOIN h b ON a.c = b.c)",
        "t AS (SELECT c, coalesce(sum(v) FILTER (k = 1), 0) y1, coalesce(sum(v) FILTER (k = 2), 0) y2 FROM h GROUP BY c)") + "SELECT c r, 1 c, round((s * y1 - q * y2) / (p * s - q * q), 9) v FROM t, n UNION ALL SELECT c, 2, round((p * y2 - q * y1) / (p * s - q * "
    "q), 9) FROM t, n")(lambda s, d: matrix.project(_one_round(s, d)[2], 2).select(F.col("row").alias("r"), F.col("col").cast("int").alias("c"), F.round("val", 9).alias("v")))
query("frobenius", _with("s96 s97") + f"SELECT round(sqrt(sum(power(coalesce(a.v, 0) - coalesce(b.v, 0), 2))), 6) norm FROM s96 a FULL JOIN s97 b {_ON}")(lambda s,
    d: matrix.frobenius(SP(s, d, 1996), SP(s, d, 1997)).select(F.round("norm", 6).alias("norm")))

# --- dissimilarities, k-mers, grids
_LOW = ("t AS MATERIALIZED (SELECT r, sum(v) s FROM sp GROUP BY r)",
    "l AS MATERIALIZED (SELECT a.r r, b.r c, sum(least(a.v, b.v)) k FROM sp a JOIN sp b ON a.c = b.c AND a.r < b.r GROUP BY 1, 2)",
    "p AS (SELECT x.r, y.r c, x.s s, y.s t, coalesce(k, 0) k FROM t x JOIN t y ON x.r < y.r LEFT JOIN l ON l.r = x.r AND l.c = y.r)")
matrix_query("braycurtis_pairs", _with("sp", *_LOW) + "SELECT r, c, round(1 - 2 * k / (s + t), 9) v FROM p", SP, lambda a: _round9(bio.bray_curtis(a)))
matrix_query("jaccard_weighted_pairs", _with("sp", *_LOW) + "SELECT r, c, round(1 - k / (s + t - k), 9) v FROM p", SP, lambda a: _round9(bio.weighted_jaccard(a)))
matrix_query("sample_distance", _with("sp", "t AS (SELECT r, sum(v) s FROM sp GROUP BY r)", "q AS MATERIALIZED (SELECT r, c, v / s v FROM sp JOIN t USING (r))")
    + "SELECT a.r r, b.r c, round(1 - sum(least(a.v, b.v)), 9) v FROM q a JOIN q b ON a.c = b.c AND a.r < b.r GROUP BY 1, 2", SP, lambda a: _round9(bio.sample_distance(a)))
_DNA = lambda s, d: m.table(s, d, "documents").select(F.col("doc_id").alias("row"), F.translate(F.regexp_replace(F.lower("text"), "[^acgtenos]", ""), "acgtenos",
        "ACGTACGT").alias("col"))
_DNAS = "x AS (SELECT doc_id r, translate(regexp_replace(lower(text), '[^acgtenos]', '', 'g'), 'acgtenos', 'ACGTACGT') s FROM documents), k AS (SELECT r, substr(s, i, 5) c FROM (SELECT r, s, unnest(range(1, len(s) - 3)) i FROM x WHERE len(s) >= 5))"
_RC = "translate(reverse(c), 'ACGT', 'TGCA')"
for _name, _col, _form in (("kmers", "c", "forward"), ("kmers_reverse", _RC, "reverse"), ("kmers_canonical", f"least(c, {_RC})", "canonical")):
    matrix_query(_name, f"WITH {_DNAS} SELECT r, {_col} c, count(*) v FROM k GROUP BY 1, 2", _DNA, lambda a, f=_form: bio.kmers(a, 5, form=f))
query("bin2d_stats", "SELECT c_nationkey // 5 bin_x, c_mktsegment segment, CAST(floor((c_acctbal + 1000) / 500) AS BIGINT) bin_y, min(c_acctbal) min, max(c_acctbal) max, round(sum(c_acctbal), 2) sum, count(c_acctbal) count FROM customer WHERE c_nationkey BETWEEN 0 AND 20 AND c_acctbal BETWEEN -1000 AND 8000 GROUP BY 1, 2, 3")(
    lambda s, d: bio.bin2d(m.table(s, d, "customer").withColumnRenamed("c_mktsegment", "segment"), F.col("c_nationkey"), F.col("c_acctbal"), F.col("c_acctbal"),
        (0, -1000), (20, 8000), (5, 500), "segment").withColumn("bin_x", F.col("bin_x").cast("int")).withColumn("sum", F.round("sum", 2))
)

# --- schemas and sources
matrix_query("schema_incidence", _with("nt") + "SELECT r || '|' || c AS edge, 'out' AS role, r AS node, v val FROM nt UNION ALL SELECT r || '|' || c, 'in', c, v FROM nt", NT, io.incidence, None)
matrix_query("schema_degree_tables", _with("sp") + "SELECT r, 'out' c, count(*) v FROM sp GROUP BY r UNION ALL SELECT c, 'in', count(*) FROM sp GROUP BY c", SP,
    lambda a: io.adjacency_schema(a)["degree"])
matrix_query("schema_single_table", _with("nt", "b AS (SELECT r, c, v FROM nt UNION ALL SELECT c, r, v FROM nt)") + "SELECT r || '|' || c r, 'edge' c, v FROM b UNION ALL SELECT CAST(r AS VARCHAR), 'deg', count(*) FROM b GROUP BY r",
    NT, io.single_table)
query("melt_rows", "SELECT n_nationkey r, unnest(['n_name', 'n_regionkey']) c, unnest([coalesce(nullif(n_name, ''), 'NULL'), coalesce(CAST(n_regionkey AS "
    "VARCHAR), 'NULL')]) v FROM nation")(lambda s, d: io.melt(m.table(s, d, "nation"), "n_nationkey", ["n_name", "n_regionkey"]).toDF("r", "c", "v"))
query("insert_strings", "SELECT * FROM (VALUES ('a', 'x', '1'), ('b', 'y', '2'), ('c', 'z', '3')) t(r, c, v)")(lambda s, d: io.insert_strings(s, "a,b,c,", "x;y;z;", "1 2 3 ").toDF("r", "c", "v"))

# --- typed scalars, lookups, retained keys
_BIG = 2**53 + 1
for _name, _sql, _f in (
    ("scalar_divide_beyond_doubles", f"SELECT r, c, (v + {_BIG}) // 3 v FROM sp", lambda a: core.apply_scalar(a.withColumn("val", F.col("val") + _BIG), "divide", 3)),
    ("scalar_divide_decimal", "SELECT r, c, round(v / 7, 2) v FROM sp", lambda a: core.apply_scalar(a.withColumn("val", F.col("val").cast("decimal(12,2)")),
            "divide", 7).withColumn("val", F.col("val").cast("double"))),
    ("scalar_set_left_keeps_zeros", "SELECT r, c, v // 30 v FROM sp", lambda a: core.apply_scalar(a.withColumn("val", F.expr("val div 30")), "left", 5)),
    ("retain_col", "SELECT '' r, c, CAST(sum(v) AS BIGINT) v FROM sp GROUP BY c", lambda a: core.retain(a, ("col",))),
    ("retain_nothing", "SELECT '' r, '' c, CAST(max(v) AS BIGINT) v FROM sp", lambda a: core.retain(a, (), "max")),
):
    matrix_query(_name, _with("sp") + _sql, SP, _f)
_factor = lambda: F.when(F.col("col") % 500 == 3, F.lit(3)).when(F.col("col") % 1000 == 7, F.lit(100_000_007)).otherwise(F.lit(1)).cast("long")
matrix_query(
    "combine_times", _with("sp") + "SELECT r, '' c, list_reduce(list(CASE WHEN c % 500 = 3 THEN 3 WHEN c % 1000 = 7 THEN 100000007 ELSE 1 END :: BIGINT), lambda x, y: x * y) v FROM sp GROUP BY r",
    SP, lambda a: core.combine(a.select("row", F.lit("").alias("col"), _factor().alias("val")), "times"),
)
for _name, _where, _f in (
    ("find_open_above", "r >= 's000003'", lambda a: core.find(a, "s000003,:,end,")),
    ("find_open_below", "r <= 's000040'", lambda a: core.find(a, ",:,s000040,")),
    ("find_mixed_list", "starts_with(r, 's00001') OR r BETWEEN 's000003' AND 's000005' OR r = 's000077'", lambda a: core.find(a, "s00001*,s000003,:,s000005,s000077,")),
    ("find_mixed_cols", "c >= 'p000900' OR starts_with(c, 'p00000') OR c = 'p000123'", lambda a: core.find(a, ":", "p000123,p00000*,p000900,:,")),
):
    matrix_query(_name, _with("sp", TEXT) + f"SELECT r, c, v FROM x WHERE {_where}", SPX, _f)

# --- contracts of products and combiners
_entry = lambda row, col, val: F.struct(row.alias("row"), col.alias("col"), val.alias("val"))
matrix_query(
    "multiply_many", _with("s96") + "SELECT r, c, CAST(sum(v) AS BIGINT) v FROM (SELECT x.r r, y.r c, x.v * y.v v FROM s96 x JOIN s96 y ON x.c = y.c UNION ALL SELECT y.r, x.r, x.v + y.v FROM s96 x JOIN s96 y ON x.c = y.c WHERE x.v > 30) GROUP BY 1, 2",
    lambda s, d: SP(s, d, 1996),
    lambda a: core.combine(core.multiply_many(core.transpose(a), core.transpose(a), lambda k, i, j, x, y: F.filter(F.array(_entry(i, j, x * y), F.when(x > 30, _entry(j, i, x
            + y))), lambda e: e.isNotNull()))),
)
matrix_query(
    "row_multiply", _with("s96 s97") + "SELECT coalesce(a.r, b.r) r, coalesce(m, 0) c, coalesce(n, 0) v FROM (SELECT r, max(v) m FROM s96 GROUP BY r) a FULL JOIN (SELECT r, count(*) n FROM s97 GROUP BY r) b ON a.r = b.r",
    lambda s, d: (SP(s, d, 1996), SP(s, d, 1997)), lambda ab: core.row_multiply(*ab, lambda row, x, y: [(row, max((v for _, v in x), default=0), len(y))]),
)
matrix_query(
    "combine_many", _with("ue", _UE) + "SELECT r, c || '|' || k c, v FROM (SELECT r, c, unnest(['max', 'min']) k, unnest([max(v), min(v)]) v FROM u GROUP BY 1, 2 HAVING count(*) > 1)",
    _first, lambda a: core.combine_many(a, lambda r, c, v: F.when(F.size(v) > 1, F.array(_entry(r, F.concat(c, F.lit("|max")), F.element_at(v, -1)), _entry(r, F.concat(c, F.lit("|min")), F.element_at(v, 1))))),
)
matrix_query(
    "combining_columns_lossy", _with("ue", _UE) + "SELECT r, c, CAST(CASE c WHEN 'click' THEN CAST(sum(v) FILTER (v % 7 <> 0) AS BIGINT) WHEN 'error' THEN max(v) FILTER (v % 7 <> 0) ELSE min(v) FILTER (v % 7 <> 0) END AS VARCHAR) v FROM u GROUP BY 1, 2",
    _first, lambda a: core.combining_columns(a.withColumn("val", F.when(F.col("val") % 7 == 0, "bad").otherwise(F.col("val").cast("string"))), {"click": "SUM",
            "error": "Max", ":": "min"}, lossy=True),
)
matrix_query(
    "splits_skewed", _with("sp", "g AS (SELECT r, count(*) n FROM sp GROUP BY r), q AS (SELECT r, n, sum(n) OVER (ORDER BY r) - 1 u, sum(n) OVER () t FROM g)") + "SELECT CAST((u >= t / 15) AS INTEGER) + CAST((u >= t * 3 / 15) AS INTEGER) + CAST((u >= t * 7 / 15) AS INTEGER) part, max(r) last_row, CAST(sum(n) AS BIGINT) entries FROM q GROUP BY 1",
    SP, lambda a: core.even_splits(a, 4, exponential=2.0), None,
)
matrix_query(
    "splits_by_wedges", _with("un",
        "g AS (SELECT r, count(*) n FROM un GROUP BY r), q AS (SELECT r, n * (n - 1) // 2 n, sum(n * (n - 1) // 2) OVER (ORDER BY r) - 1 u, sum(n * "
        "(n - 1) // 2) OVER () t FROM g)") + "SELECT CAST((u >= t / 4) AS INTEGER) + CAST((u >= t / 2) AS INTEGER) + CAST((u >= t * 3 / 4) AS INTEGER) part, max(r) last_row, CAST(sum(n) AS BIGINT) wedges FROM q GROUP BY 1",
    CO, lambda a: core.wedge_splits(core.degrees(graph.undirected(a)), 4), None,
)

# --- walks from all nodes, ranges, with degrees; components of one node; filtered trusses
query("bfs_all_nodes", _with("nt", "f1 AS (SELECT DISTINCT c FROM nt)") + "SELECT r, c, CAST(sum(v) AS BIGINT) v FROM (SELECT r, c, v FROM nt UNION ALL SELECT r, c, v FROM nt WHERE r IN (SELECT c FROM f1)) GROUP BY "
    "1, 2")(lambda s, d: _walk(graph.bfs(NT(s, d), None, 2).walked))
_XN = "x AS (SELECT format('n{:03d}', r) r, format('n{:03d}', c) c, v FROM ns)"
_named = lambda df: df.select(F.format_string("n%03d", "row").alias("row"), F.format_string("n%03d", "col").alias("col"), "val")
query("bfs_range_start", _with("ns", _XN, "f1 AS (SELECT DISTINCT c FROM x WHERE r BETWEEN 'n002' AND 'n004' OR r >= 'n020')") + "SELECT c node FROM f1 UNION SELECT c FROM x WHERE r IN (SELECT c FROM f1)")(
    lambda s, d: graph.bfs(_named(NS(s, d)), "n002,:,n004,n020,:,", 2, union=True).reached
)
query(
    "bfs_incidence_by_degree",
    _with("ns", "g AS (SELECT r FROM ns GROUP BY r HAVING count(*) BETWEEN 1 AND 14)", "f1 AS (SELECT DISTINCT c FROM ns WHERE r IN (SELECT r FROM g))",
        "w AS (SELECT r, c, v FROM ns WHERE r IN (SELECT r FROM g) UNION ALL SELECT r, c, v FROM ns WHERE r IN (SELECT c FROM f1) AND r IN (SELECT r "
        "FROM g))")
    + "SELECT r || '|' || c AS edge, role, node, CAST(sum(v) AS BIGINT) val FROM (SELECT r, c, 'out' AS role, r AS node, v FROM w UNION ALL SELECT r, c, 'in', c, v FROM w) GROUP BY r, c, role, node",
)(lambda s, d: graph.bfs_incidence(io.incidence(NS(s, d)), None, 2, low=1, high=14, degrees=core.degrees(NS(s, d))).walked)
query(
    "bfs_single_table_degrees",
    _with("un", _F1, "g AS (SELECT r, count(*) n FROM un GROUP BY r)", "s1 AS (SELECT r, c FROM un WHERE r = 5)", "s2 AS (SELECT r, c FROM un WHERE r IN (SELECT c FROM f1))")
    + "SELECT r node, CAST(sum(n) AS BIGINT) deg FROM (SELECT 5 AS x UNION ALL SELECT c FROM f1) JOIN g ON g.r = x GROUP BY 1 UNION ALL SELECT c, count(DISTINCT r) FROM (SELECT c, r FROM s1 WHERE c <> 5 UNION SELECT c, r FROM s2 WHERE c NOT IN (SELECT c FROM f1)) WHERE c <> 5 AND c NOT IN (SELECT c FROM f1) GROUP BY 1",
)(lambda s, d: graph.bfs_single_table(graph.undirected(CO(s, d)), _node(s, 5), 2, copy_degrees=True, in_degrees="count").degrees)
query("scc_of_node", _REACH + "SELECT c node FROM s WHERE r = 7")(lambda s, d: graph.scc_of(NS(s, d), _node(s, 7, NS(s, d).schema["row"].dataType.simpleString())))
query(
    "jaccard_filtered",
    _with("nt", _XN.replace("FROM ns", "FROM nt"), "f AS (SELECT DISTINCT least(r, c) a, greatest(r, c) b FROM x WHERE r <> c AND r <= 'n011' AND c <= 'n011')",
        "u AS (SELECT a r, b c FROM f UNION ALL SELECT b, a FROM f)", "g AS (SELECT r, count(*) n FROM u GROUP BY r)",
        "p AS (SELECT a.c r, b.c c, count(*) k FROM u a JOIN u b ON a.r = b.r AND a.c < b.c GROUP BY 1, 2)")
    + "SELECT p.r, p.c, round(k / (x.n + y.n - k), 9) v FROM p JOIN g x ON p.r = x.r JOIN g y ON p.c = y.r",
)(lambda s, d: _walk(_round9(graph.jaccard(_named(NT(s, d)), ":,n011,"))))

# --- k-mers, pairs that share, rows by number
matrix_query("kmer_degrees", f"WITH {_DNAS} SELECT r node, count(*) deg FROM k GROUP BY 1", _DNA, lambda a: bio.kmer_degrees(bio.kmers(a, 5)), None)
matrix_query("kmers_packed", f"WITH {_DNAS}, q AS (SELECT r, translate(c, 'ACGT', '0123') c FROM k) SELECT r, CAST(substr(c, 1, 1) AS BIGINT) * 256 + CAST(substr(c, 2, 1) AS BIGINT) * 64 + CAST(substr(c, 3, 1) AS BIGINT) * 16 + CAST(substr(c, 4, 1) AS BIGINT) * 4 + CAST(substr(c, 5, 1) AS BIGINT) c, count(*) v FROM q GROUP BY 1, 2",
    _DNA, lambda a: bio.kmers(a, 5).withColumn("col", bio.pack(F.col("col"))))
_LETTERS = "(SELECT unnest(['A', 'C', 'G', 'T']) {0})"
query("all_kmers_gc",
    "SELECT x || y || z r, 'gc' c, (CAST(x IN ('C', 'G') AS INTEGER) + CAST(y IN ('C', 'G') AS INTEGER) + CAST(z IN ('C', 'G') AS INTEGER)) / 3 " "v FROM " + ", ".join(map(_LETTERS.format, "xyz")))(
    lambda s, d: _walk(bio.all_kmers(s, 3)))
matrix_query("braycurtis_sharing", _with("sp", "t AS (SELECT r, sum(v) s FROM sp GROUP BY r)",
        "l AS (SELECT a.r r, b.r c, sum(least(a.v, b.v)) k FROM sp a JOIN sp b ON a.c = b.c AND a.r < b.r GROUP BY 1, 2)") + "SELECT l.r, l.c, round(1 - 2 * k / (x.s + y.s), 9) v FROM l JOIN t x ON x.r = l.r JOIN t y ON y.r = l.c",
    SP, lambda a: _round9(bio.sharing_pairs(a)))
query("melt_numbered",
    "SELECT row_number() OVER (ORDER BY n_nationkey) r, unnest(['n_nationkey', 'n_name']) c, unnest([CAST(n_nationkey AS VARCHAR), n_name]) v " "FROM nation")(
    lambda s, d: io.melt(m.table(s, d, "nation"), None, ["n_nationkey", "n_name"]).toDF("r", "c", "v"))
query("insert_integers", "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, 5::BIGINT), (2, 9, 7)) t(r, c, v)")(lambda s, d: _walk(io.insert_strings(s, "1,2,4,", "2;9;3;", "5 7 8 ", integers=True)))
matrix_query("incidence_first_edges", _with("nt") + "SELECT r || '|' || c AS edge, unnest(['out', 'in']) AS role, unnest([r, c]) AS node, v val FROM (SELECT * FROM nt ORDER BY r, c LIMIT 25)",
    NT, lambda a: io.incidence(a, 25), None)
