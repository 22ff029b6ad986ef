"""Graph algorithms over edge triples (row, col, val)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core, tiles
from .lineage import checkpointed


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once; one pass over the edges."""
    there, back = F.struct("row", "col", "val"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"), "val")
    return edges.select(F.explode(F.array(there, back)).alias("e")).select("e.*").distinct()


class Walk(NamedTuple):
    """walked: the edges with their values times the rounds they were walked in; reached: the nodes of the last round or,
    with union, of any; steps: the entries of all rounds before they are combined (their number is what the walk writes);
    degrees: node, deg, where asked for."""

    walked: DataFrame
    reached: DataFrame
    steps: DataFrame
    degrees: DataFrame | None = None


Start = DataFrame | str | None


def _first(nodes: DataFrame, start: Start) -> DataFrame:
    """The start nodes: a table of them, a range string over all nodes, or all (None, or an empty string)."""
    if isinstance(start, DataFrame):
        return start.select("node").distinct()
    return core.select_range(nodes.select("node").distinct(), start or None, "node")


def _allowed(degrees: DataFrame, low: int | None, high: int | None) -> DataFrame | None:
    return core.min_max(degrees, low, high, "deg").select("node") if low is not None or high is not None else None


def _rounds(frontier: DataFrame, steps: int, allowed: DataFrame | None, walk: Callable[[DataFrame], tuple[DataFrame, DataFrame]], none: DataFrame, union: bool) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Steps, reached nodes and the frontiers walked from. From the third round on the frontier is checkpointed, so plans
    do not grow with the rounds, and the walk ends where it is empty."""
    taken, fronts, reached = none, [], frontier.limit(0)
    for k in range(steps):
        if k > 1:
            frontier = checkpointed(frontier)
            if frontier.isEmpty():
                return taken, reached if union else frontier, fronts
        if allowed is not None:
            frontier = frontier.join(allowed, "node", "left_semi")
        fronts.append(frontier)
        step, frontier = walk(frontier)
        taken = step if k == 0 else taken.unionByName(step)
        reached = reached.unionByName(frontier).distinct() if union and k else frontier
    return taken, reached, fronts


def bfs(edges: DataFrame, start: Start, steps: int, low: int | None = None, high: int | None = None, union: bool = False, degrees: DataFrame | None = None) -> Walk:
    """Edges walked in ``steps`` rounds and the nodes reached. low, high: out-degrees of nodes that are walked from, by a
    table of degrees (node, deg), or by their entries if none is given. Nodes may be visited again."""
    if steps > 1:
        edges = checkpointed(edges.select("row", "col", "val"))
    frontier = _first(edges.select(F.col("row").alias("node")), start)
    allowed = _allowed(core.degrees(edges) if degrees is None else degrees, low, high)

    def walk(frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
        step = edges.join(frontier.withColumnRenamed("node", "row"), "row", "left_semi").select("row", "col", "val")
        return step, step.select(F.col("col").alias("node")).distinct()

    taken, reached, _ = _rounds(frontier, steps, allowed, walk, edges.select("row", "col", "val").limit(0), union)
    return Walk(core.combine(taken), reached, taken)


def bfs_incidence(
    incidence: DataFrame, start: Start, steps: int, starts: tuple[str, ...] = ("out",), ends: tuple[str, ...] = ("in",), low: int | None = None, high: int | None = None,
    union: bool = False, degrees: DataFrame | None = None, visibility: str | None = None,
) -> Walk:
    """The same over (edge, role, node, val). A start entry is given once for each end of its edge. Degrees must be given
    where low or high are. visibility: a column vis with that label, in place of what was there."""
    if any(a != b and a.startswith(b) for a in ends for b in ends):
        raise ValueError(f"an end role is the beginning of another: {ends}")
    if degrees is None and (low is not None or high is not None):
        raise ValueError("a degree filter needs a table of degrees")
    if steps > 1:
        incidence = checkpointed(incidence.select("edge", "role", "node", "val"))
    sources = incidence.where(F.col("role").isin(*starts))
    frontier = _first(sources, start)

    def walk(frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
        e = incidence.where(F.col("role").isin(*ends)).select("edge", *(F.col(c).alias(f"e_{c}") for c in ("role", "node", "val")))
        end = F.struct(F.col("e_role").alias("role"), F.col("e_node").alias("node"), F.col("e_val").alias("val"))
        both = sources.join(frontier, "node", "left_semi").join(e, "edge").select("edge", F.explode(F.array(F.struct("role", "node", "val"), end)).alias("x"), "e_node")
        return both.select("edge", "x.*"), both.select(F.col("e_node").alias("node")).distinct()

    taken, reached, _ = _rounds(frontier, steps, _allowed(degrees, low, high), walk, incidence.select("edge", "role", "node", "val").limit(0), union)
    walked = taken.groupBy("edge", "role", "node").agg(F.sum("val").alias("val"))
    return Walk(walked if visibility is None else walked.withColumn("vis", F.lit(visibility)), reached, taken)


def bfs_single_table(
    edges: DataFrame, start: Start, steps: int, low: int | None = None, high: int | None = None, union: bool = False, degrees: DataFrame | None = None,
    copy_degrees: bool = False, in_degrees: str | None = None,
) -> Walk:
    """Over a single table of edges in both directions: every edge walked is also given reversed, unless its end is in
    the frontier itself and so gives it of its own.

    degrees: a table of node and deg (the nodes' entries if none is given). copy_degrees: the degrees of the nodes walked
    from, once for each round. in_degrees: also those of nodes reached that were never walked from, as the "count" of
    their walked edges or the "sum" of their values."""
    if steps > 1:
        edges = checkpointed(edges.select("row", "col", "val"))
    degrees = core.degrees(edges) if degrees is None else degrees
    frontier = _first(edges.select(F.col("row").alias("node")), start)

    def walk(frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
        step = edges.join(frontier.withColumnRenamed("node", "row"), "row", "left_semi").select("row", "col", "val")
        back = core.transpose(step.join(frontier.withColumnRenamed("node", "col"), "col", "left_anti"))
        return step.unionByName(back), step.select(F.col("col").alias("node")).distinct()

    taken, reached, fronts = _rounds(frontier, steps, _allowed(degrees, low, high), walk, edges.select("row", "col", "val").limit(0), union)
    walked, known = core.combine(taken), None
    from_ = reduce(DataFrame.unionByName, fronts) if fronts else frontier.limit(0)
    if copy_degrees:
        known = from_.join(degrees.select("node", "deg"), "node").groupBy("node").agg(F.sum("deg").alias("deg"))
    if in_degrees:
        size = F.count("*") if in_degrees == "count" else F.sum("val")
        asked = walked.join(from_.withColumnRenamed("node", "row"), "row", "left_anti").groupBy(F.col("row").alias("node")).agg(size.alias("deg"))
        known = asked if known is None else known.unionByName(asked)
    return Walk(walked, reached, taken, known)


def _plain(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, as row < col, without loops."""
    return edges.where("row <> col").select(F.least("row", "col").alias("row"), F.greatest("row", "col").alias("col")).distinct()


def _both_ways(plain: DataFrame) -> DataFrame:
    return plain.select(F.explode(F.array(F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col")))).alias("e")).select("e.*")


def _ranked(plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain edges (a table, as they are read three times) between ranks of nodes, row < col, and the nodes' ranks (node,
    rank). Ranks rise with the degree, so hubs come last and make few wedges."""
    deg = plain.select(F.explode(F.array("row", "col")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    ordered = deg.repartitionByRange("deg", "node").sortWithinPartitions("deg", "node")
    ranks = checkpointed(ordered.select("node", F.monotonically_increasing_id().alias("rank")))
    end = lambda c: ranks.select(F.col("node").alias(c), F.col("rank").alias(f"{c}_rank"))
    x = plain.join(end("row"), "row").join(end("col"), "col")
    return checkpointed(x.select(F.least("row_rank", "col_rank").alias("row"), F.greatest("row_rank", "col_rank").alias("col"))), ranks


def _named(df: DataFrame, ranks: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumnRenamed(c, "rank").join(ranks.withColumnRenamed("node", c), "rank").drop("rank")
    return df


def _closed(up: DataFrame) -> DataFrame:
    """x, y and the array zs of the nodes that close x -> y to triangles.

    A node's later neighbours are one array: by rank no node has more than the square root of twice the edges. Each edge
    takes what follows its end in its start's array to the end's array; wedges are never rows."""
    later = checkpointed(up.groupBy("row").agg(F.sort_array(F.collect_list("col")).alias("n")))
    pairs = later.select(F.col("row").alias("x"), F.posexplode("n").alias("k", "y"), "n").where(F.col("k") + 1 < F.size("n"))
    pairs = pairs.select("x", "y", F.slice("n", F.col("k") + 2, F.size("n")).alias("rest"))
    return pairs.join(later.select(F.col("row").alias("y"), F.col("n").alias("m")), "y").select("x", "y", F.array_intersect("rest", "m").alias("zs")).where(F.size("zs") > 0)


def triangles(edges: DataFrame) -> DataFrame:
    """The triangles of an undirected graph, one row each; x has the lowest degree."""
    up, ranks = _ranked(checkpointed(_plain(edges)))
    return _named(_closed(up).select("x", "y", F.explode("zs").alias("z")), ranks, "x", "y", "z").select("x", "y", "z")


def count_triangles(edges: DataFrame) -> DataFrame:
    up, _ = _ranked(checkpointed(_plain(edges)))
    return _closed(up).agg(F.coalesce(F.sum(F.size("zs").cast("long")), F.lit(0)).alias("triangles"))


def _oriented(plain: DataFrame) -> DataFrame:
    """node, n: nodes as numbers in the order of their keys (close keys stay close), each with those of its neighbours
    that have a higher degree (ties: number), by rising degree."""
    deg = plain.select(F.explode(F.array("row", "col")).alias("row")).groupBy("row").agg(F.count("*").alias("deg"))
    places = tiles.placed(deg)
    end = lambda c: places.select(F.col("row").alias(c), F.struct("deg", "place").alias(f"{c}_end"))
    x = plain.join(end("row"), "row").join(end("col"), "col").select(F.least("row_end", "col_end").alias("a"), F.greatest("row_end", "col_end").alias("b"))
    after = F.sort_array(F.collect_list(F.struct("b.deg", "b.place"))).alias("n")
    return checkpointed(x.groupBy(F.col("a.place").alias("node")).agg(after).select("node", F.col("n.place").alias("n")))


def count_triangles_parity(edges: DataFrame) -> DataFrame:
    """By parity: an edge counts 1, a wedge over it 2, so odd cells are edges and (v - 1) / 2 their triangles. Even cells,
    wedges over no edge, count nothing and are not kept."""
    wedges = tiles.masked_products(_oriented(checkpointed(_plain(edges))))
    cells = wedges.withColumn("val", 1 + 2 * F.col("val"))
    return cells.where("val % 2 = 1").agg(F.coalesce(F.sum(F.expr("(val - 1) div 2")), F.lit(0)).alias("triangles"))


def count_triangles_by_edges(edges: DataFrame) -> DataFrame:
    """Adjacency joined to edges: a node and an edge that meet at both of the edge's ends make a triangle. Every node
    brings the edges to the nodes after it; hubs come last, so these are few."""
    met = tiles.masked_products(_oriented(checkpointed(_plain(edges))))
    return met.agg(F.coalesce(F.sum("val"), F.lit(0)).alias("triangles"))


def k_truss(edges: DataFrame, k: int, rounds: int | None = None, only: str | None = None) -> DataFrame:
    """Both directions of the edges that lie in k - 2 triangles or more of what remains; only: a range string that both
    ends must be in. The edges' triangles are enumerated from their ends of lowest degree, so hubs make few wedges.

    Goes on until nothing changes; where that takes more than ``rounds``, if given, it raises."""
    left = _plain(core.select_range(core.select_range(edges, only), only, "col"))
    if k > 2:
        left, ranks = _ranked(checkpointed(left))
        size, done = left.count(), 0
        while True:
            if done == rounds:
                raise RuntimeError(f"the {k}-truss has not settled within {rounds} rounds")
            done += 1
            side = lambda a, b: F.struct(F.col(a).alias("row"), F.col(b).alias("col"))
            sides = _closed(left).select("x", "y", F.explode("zs").alias("z")).select(F.explode(F.array(side("x", "y"), side("x", "z"), side("y", "z"))).alias("e"))
            support = sides.groupBy("e.row", "e.col").count().where(F.col("count") >= k - 2)
            left = checkpointed(left.join(support, ["row", "col"], "left_semi"))
            size, before = left.count(), size
            if size == before:
                break
        left = checkpointed(_named(left, ranks, "row", "col").select("row", "col"))
    return _both_ways(left).withColumn("val", F.lit(1).cast("long"))


def k_truss_incidence(incidence: DataFrame, k: int, rounds: int | None = None) -> DataFrame:
    """Rows of an incidence table (edge, node) of plain edges that are in the k-truss."""
    pairs = incidence.groupBy("edge").agg(F.min("node").alias("row"), F.max("node").alias("col"))
    kept = k_truss(pairs.select("row", "col"), k, rounds)
    return incidence.join(pairs.join(kept.where("row < col"), ["row", "col"], "left_semi").select("edge"), "edge", "left_semi")


def jaccard(edges: DataFrame, only: str | None = None, digits: int | None = None) -> DataFrame:
    """Jaccard coefficients of the neighbourhoods of node pairs row < col that share a neighbour; only: a range string
    that both ends of an edge must be in; digits: decimals to round to, halves up. The result has a row for each pair, so
    its size bounds the work from below, and values are finished before they reach the JVM, where a round is slow."""
    plain = _plain(core.select_range(core.select_range(edges, only), only, "col"))

    def value(low: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        part = low / (s + t - low)
        if digits is None:
            return part
        up = part * 10.0**digits
        whole = np.floor(up)
        return (whole + (up - whole >= 0.5)) / 10.0**digits

    return tiles.pairs(checkpointed(_both_ways(plain).withColumn("val", F.lit(1).cast("long"))), value=value)


def line_graph(edges: DataFrame, directed: bool = True, extra_cycles: bool = False, separator: str = "|") -> DataFrame:
    """Edges of the line graph. At node m with in-weight w, in-count p and out-count q a directed edge weighs w/(p q),
    with extra cycles w/(p q + p (p - 1)); undirected ones w/(p (p - 1))."""
    name = lambda x, y: F.concat(x.cast("string"), F.lit(separator), y.cast("string"))
    into = edges.groupBy(F.col("col").alias("m")).agg(F.sum("val").cast("double").alias("w"), F.count("*").alias("p"))
    if not directed:
        a, b = edges.alias("a"), edges.alias("b")
        pairs = a.join(b, (F.col("a.col") == F.col("b.col")) & (F.col("a.row") != F.col("b.row"))).select(F.col("a.row").alias("x"), F.col("b.row").alias("y"), F.col("a.col").alias("m"))
        sided = lambda c: name(F.least(F.col(c).cast("string"), F.col("m").cast("string")), F.greatest(F.col(c).cast("string"), F.col("m").cast("string")))
        out = pairs.join(into, "m").where("w <> 0 and p > 1").select(sided("x").alias("row"), sided("y").alias("col"), (F.col("w") / (F.col("p") * (F.col("p") - 1))).alias("val"))
        return core.combine(out.where("row <> col"))
    out_of = edges.groupBy(F.col("row").alias("m")).agg(F.count("*").alias("q"))
    per = into.join(out_of, "m", "left" if extra_cycles else "inner").withColumn("q", F.coalesce("q", F.lit(0)))
    divisor = F.col("p") * F.col("q") + (F.col("p") * (F.col("p") - 1) if extra_cycles else F.lit(0))
    per = per.withColumn("weight", F.try_divide(F.col("w"), divisor)).where("weight <> 0").select("m", "weight")
    first = edges.select(F.col("row").alias("x"), F.col("col").alias("m"))
    steps = first.join(edges.select(F.col("row").alias("m"), F.col("col").alias("y")), "m").select(name(F.col("x"), F.col("m")).alias("row"), name(F.col("m"), F.col("y")).alias("col"), "m")
    if extra_cycles:
        cycles = first.join(first.withColumnRenamed("x", "y"), "m").where("x <> y")
        steps = steps.unionByName(cycles.select(name(F.col("x"), F.col("m")).alias("row"), name(F.col("y"), F.col("m")).alias("col"), "m"))
    return core.combine(steps.join(per, "m").select("row", "col", F.col("weight").alias("val")))


def reachability(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Pairs (row, col) with a path of one edge or more, by squaring what is known until nothing is new."""
    known = checkpointed(edges.select("row", "col").distinct())
    size, done = known.count(), 0
    while True:
        if done == rounds:
            raise RuntimeError(f"paths are still being found after {rounds} rounds")
        done += 1
        a, b = known.alias("a"), known.alias("b")
        step = a.join(b, F.col("a.col") == F.col("b.row")).select(F.col("a.row").alias("row"), F.col("b.col").alias("col"))
        known = checkpointed(known.unionByName(step).distinct())
        size, before = known.count(), size
        if size == before:
            return known


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that a path of one edge or more leads to from a start node; every node is walked from once."""
    found = front = checkpointed(edges.join(start.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("col").alias("node")).distinct())
    while not front.isEmpty():
        step = edges.join(front.withColumnRenamed("node", "row"), "row", "left_semi").select(F.col("col").alias("node")).distinct()
        front = checkpointed(step.join(found, "node", "left_anti"))
        found = checkpointed(found.unionByName(front))
    return found


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that no edge leads to, or from, again and again."""
    size = edges.count()
    while True:
        inner = edges.join(edges.select(F.col("col").alias("row")).distinct(), "row", "left_semi")
        edges = checkpointed(inner.join(inner.select(F.col("row").alias("col")).distinct(), "col", "left_semi").select("row", "col"))
        size, before = edges.count(), size
        if size == before:
            return edges


def scc(edges: DataFrame) -> DataFrame:
    """node and component, named by its smallest node, of the nodes on cycles.

    By colours: after trimming, every node takes the smallest node that reaches it; inside a colour the nodes that reach
    the one it is named after are its component. They leave, and the rest goes on. Work is in edges, not in paths."""
    left, found = _trimmed(checkpointed(edges.select("row", "col").distinct())), None
    while not left.isEmpty():
        colours = checkpointed(left.select(F.explode(F.array("row", "col")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            offered = left.join(colours.withColumnRenamed("node", "row"), "row").groupBy(F.col("col").alias("node")).agg(F.min("colour").alias("offer"))
            new = checkpointed(colours.join(offered, "node", "left").select("node", "colour", "offer"))
            colours = new.select("node", F.least("colour", F.coalesce("offer", "colour")).alias("colour"))
            if new.where("offer < colour").isEmpty():
                break
        of = colours.select(F.col("node").alias("row"), "colour").join(left, "row")
        inside = checkpointed(of.join(colours.select(F.col("node").alias("col"), F.col("colour").alias("c2")), "col").where("colour = c2").select(F.col("col").alias("row"), F.col("row").alias("col"), "colour"))
        roots = inside.where("row = colour").select(F.col("row").alias("node")).distinct()
        component = checkpointed(colours.join(reach(inside.select("row", "col"), roots), "node", "left_semi").withColumnRenamed("colour", "component"))
        done = component.select("node").unionByName(colours.where("node = colour").select("node")).distinct()
        found = component if found is None else found.unionByName(component)
        gone = lambda c, done=done: done.withColumnRenamed("node", c)
        left = _trimmed(left.join(gone("row"), "row", "left_anti").join(gone("col"), "col", "left_anti").select("row", "col"))
    return found if found is not None else edges.select(F.col("row").alias("node"), F.col("row").alias("component")).limit(0)


def scc_pairs(edges: DataFrame) -> DataFrame:
    """Pairs of nodes that reach each other; nodes on no cycle are in none."""
    found = scc(edges)
    return found.select(F.col("node").alias("row"), "component").join(found.select(F.col("node").alias("col"), "component"), "component").select("row", "col")


def scc_of(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The nodes of one node's component: what it reaches and is reached from; none if it is on no cycle."""
    back = edges.select(F.col("col").alias("row"), F.col("row").alias("col"))
    return reach(edges, start).join(reach(back, start), "node", "left_semi")


def tfidf(counts: DataFrame, n_docs: int | None = None) -> DataFrame:
    """count / words of the document * ln(1 + N / (1 + documents with the word)) for (row=document, col=word, val)."""
    counts = checkpointed(counts.select("row", "col", "val"))
    totals = counts.groupBy("row").agg(F.sum("val").alias("total"))
    spread = counts.groupBy("col").agg(F.count("*").alias("df"))
    n = totals.agg(F.count("*").alias("n_docs")).scalar() if n_docs is None else F.lit(n_docs)
    x = counts.join(totals, "row").join(spread, "col")
    return x.select("row", "col", (F.col("val") / F.col("total") * F.ln(1 + n / (1 + F.col("df")))).alias("val"))
