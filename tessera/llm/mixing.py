"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Targets. Sources in order of code points (null last) weigh 1, 2, 3, 1, ...; they share the size of all documents by
   weight, but none gets more than ``most`` times its own size; the excess is shared again by weight until none is above.
2. Blocks. Each source's documents are dealt by hash to blocks of about ``block`` words. A source takes every block
   whole as often as its target allows, then, in an order permuted by hash, blocks once more until the target is met;
   in the last one documents are taken in permuted order, and the last document only as far as its target reaches (with
   ``whole``: whole or not at all, whichever ends nearer).
3. Quotas. The block copies that each source gives are the root of a tree with ``2 ** levels`` output shards as leaves.
   At each node the left child's quota of every source is drawn from the multivariate hypergeometric distribution: the
   node's counts, source by source, in half of all its copies without replacement. The univariate draws are inversions
   of hashed uniform numbers (weights go outward from the mode, 10 standard deviations and 10 more to either side).
   Many sources are drawn in a tree of their own, ``FAN`` at a time. Quotas add up exactly, by source and by shard.
4. Shards. A source's block copies stand in permuted order; each shard takes as many of the next ones as its quota says,
   so shards are disjoint. Inside its shard every taking has a random place (``mix_place``), which shuffles it locally.

Windows are over documents of one block, over the square root of a source's blocks, or over ranges of sources, never
over a source. Rows that are equal are counted first and dealt out one by one, so a hot one is spread. Draws are hashes of
rows and ``seed``: reruns agree. Null texts have size 0 and are never taken; sources with size 0 have target 0. An empty
table gives an empty mix. Further columns of any name that does not begin with ``mix_`` pass through; a very long text
may fill several blocks' worth by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import durable, release, word_count

WEIGHTS, MOST = (1, 2, 3), 3
BLOCK, LEVELS, FAN = 65_536, 4, 256


def _draw(seed: int, what: str, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(what), *columns)


def _uniform(seed: int, what: str, *columns: Column | str) -> Column:
    return (F.shiftrightunsigned(_draw(seed, what, *columns), 11).cast("double") + 0.5) / F.lit(2.0**53)


def _ranked(rows: DataFrame, *by: str) -> DataFrame:
    """rows with mix_rank, from 0 in the order of ``by``: ranges of rows are numbered apart, then moved up."""
    dealt = durable(rows.repartitionByRange(*by).withColumn("range_no", F.spark_partition_id()))
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    sizes = dealt.groupBy("range_no").count().select("range_no", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("below"))
    place = F.row_number().over(Window.partitionBy("range_no").orderBy(*by)) - 1
    return dealt.join(sizes, "range_no").withColumn("mix_rank", (F.col("below") + place).cast("long")).drop("range_no", "below")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The columns of sizes (source, source_size, ...: one row a source) with mix_rank and target."""
    rows = durable(_ranked(sizes.withColumn("absent", F.col("source").isNull()), "absent", "source").drop("absent"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("mix_rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    total, free = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(weight), F.lit(1))).first()
    level, held = total / free, -1
    while True:  # sources that reach their cap stay there, so this ends
        at_cap = cap <= weight * F.lit(level)
        now, capped, free = rows.agg(F.count(F.when(at_cap, 1)), F.coalesce(F.sum(F.when(at_cap, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~at_cap, weight)), F.lit(0))).first()
        if now == held or not free:
            break
        held, level = now, (total - capped) / free
    return rows.withColumn("target", F.when(cap <= weight * F.lit(level), cap.cast("double")).otherwise(weight * F.lit(level)))


def _identity(docs: DataFrame) -> list[Column]:
    """mix_size, the words of the text, and mix_r1 and mix_r2, 128 bits that stand for all columns of the row."""
    plain = [F.map_entries(f"`{f.name}`") if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    parts = [x for c in plain for x in (c.isNull(), c)]  # a hash passes over nulls
    return [word_count("text").alias("mix_size"), F.xxhash64(F.lit(1), *parts).alias("mix_r1"), F.xxhash64(F.lit(2), *parts).alias("mix_r2")]


def identified(docs: DataFrame) -> DataFrame:
    """docs with the columns of _identity()."""
    return docs.select("*", *_identity(docs))


ROW = ["mix_r1", "mix_r2", "mix_repeat"]


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 7, whole: bool = False) -> DataFrame:
    """The columns of identified() rows (source, mix_size, mix_r1, mix_r2, ...; best without the texts) and mix_repeat
    (numbers equal rows), mix_source_size, mix_target, mix_rank, mix_block, mix_slot (where the row stands in its
    source), mix_passes (whole takings), mix_extra (words of a last taking) and mix_taken."""
    kinds = durable(rows.groupBy(*rows.columns).agg(F.count("*").alias("mix_n")))
    sizes = kinds.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_n")).alias("source_size"), F.sum("mix_n").alias("source_rows"))
    goal = durable(
        source_targets(sizes, weights, most)
        .withColumn("n_blocks", F.ceil((F.col("source_size") + F.col("source_rows")) / block))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0))
        .withColumn("extra", F.floor("target") - F.col("passes") * F.col("source_size"))
        .select(F.col("source").alias("g_source"), "mix_rank", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("passes").alias("mix_passes"), "n_blocks", "extra")
    )
    single = kinds.withColumn("mix_repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_n")))).drop("mix_n")
    keyed = single.join(goal, single["source"].eqNullSafe(goal["g_source"])).withColumn("mix_block", F.pmod(_draw(seed, "block", *ROW), F.col("n_blocks")))
    blocks = durable(
        keyed.groupBy("mix_rank", "mix_block", "extra", "n_blocks").agg(F.sum("mix_size").alias("size"))
        .withColumn("turn", _draw(seed, "order", "mix_rank", "mix_block"))
        .withColumn("part", F.pmod("turn", F.ceil(F.sqrt("n_blocks"))))
    )
    earlier = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("mix_rank", "part").agg(F.sum("size").alias("size")).select("mix_rank", "part", earlier(Window.partitionBy("mix_rank").orderBy("part")).alias("below"))
    before = F.col("below") + earlier(Window.partitionBy("mix_rank", "part").orderBy("turn", "mix_block"))
    rest = blocks.join(parts, ["mix_rank", "part"]).withColumn("rest", F.col("extra") - before).select("mix_rank", "mix_block", F.greatest(F.lit(0), F.least("rest", "size")).alias("rest"))
    found = keyed.join(rest, ["mix_rank", "mix_block"])
    permuted = Window.partitionBy("mix_rank", "mix_block").orderBy(_draw(seed, "document", *ROW), *ROW)
    done = F.coalesce(F.sum("mix_size").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least("mix_size", F.col("rest") - done))
    if whole:
        extra = F.when(extra * 2 >= F.col("mix_size"), F.col("mix_size")).otherwise(0)
    found = found.withColumn("mix_slot", F.row_number().over(permuted)).withColumn("mix_extra", extra)
    taken = (F.col("mix_passes") * F.col("mix_size") + F.col("mix_extra")).alias("mix_taken")
    return found.select(*rows.columns, "mix_repeat", "mix_source_size", "mix_target", "mix_rank", "mix_block", "mix_slot", "mix_passes", "mix_extra", taken)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(total: Column, good: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``draws`` from ``total`` things, ``good`` of them good, are good: a long by inversion of ``uniform``."""
    double = lambda c: c.cast("double")
    low = F.greatest(F.lit(0.0), double(draws) - (double(total) - double(good)))
    given = F.struct(double(total).alias("t"), double(good).alias("g"), double(draws).alias("n"), uniform.alias("u"), low.alias("low"), F.least(double(draws), double(good)).alias("high"))

    def weigh(v: Column) -> Column:
        share = v["g"] / F.greatest(v["t"], F.lit(1.0))
        spread = F.sqrt(v["n"] * share * (1 - share) * (v["t"] - v["n"]) / F.greatest(v["t"] - 1, F.lit(1.0)))
        mode = F.least(F.greatest(F.floor((v["n"] + 1) * (v["g"] + 1) / (v["t"] + 2)).cast("double"), v["low"]), v["high"])
        return F.struct(*(v[x].alias(x) for x in ("t", "g", "n", "u", "low", "high")), mode.alias("mode"), (F.ceil(spread * 10) + 10).alias("reach"))

    def invert(v: Column) -> Column:
        def ratio(k: Column, up: bool) -> Column:
            a, b = (v["g"] - k) * (v["n"] - k), (k + 1) * (v["t"] - v["g"] - v["n"] + k + 1)
            c, d = k * (v["t"] - v["g"] - v["n"] + k), (v["g"] - k + 1) * (v["n"] - k + 1)
            return a / b if up else c / d

        steps = {up: F.sequence(F.lit(1).cast("long"), F.least(v["reach"], ((v["high"] - v["mode"]) if up else (v["mode"] - v["low"])).cast("long")) + 1) for up in (True, False)}
        last = {up: F.least(v["reach"], ((v["high"] - v["mode"]) if up else (v["mode"] - v["low"])).cast("long")) for up in (True, False)}

        def whole(up: bool) -> Column:  # the weights on one side, the mode's own (1) among those above
            start = F.struct((F.lit(1.0) if up else F.lit(0.0)).alias("sum"), F.lit(1.0).alias("w"), v["mode"].alias("k"))
            def step(a: Column, i: Column) -> Column:
                w = F.when(i <= last[up], a["w"] * ratio(a["k"], up)).otherwise(0.0)
                return _let(w, lambda x: F.struct((a["sum"] + x).alias("sum"), x.alias("w"), (a["k"] + (1 if up else -1)).alias("k")))
            return F.aggregate(steps[up], start, step, lambda a: a["sum"])

        def find(up: bool, rest: Column) -> Column:
            first = v["mode"] if up else v["mode"] - 1
            start = F.struct(rest.alias("rest"), (F.lit(1.0) if up else ratio(v["mode"], False)).alias("w"), first.alias("k"))
            def step(a: Column, i: Column) -> Column:
                on = (a["rest"] >= a["w"]) & (i < last[up] + (1 if up else 0))
                return F.struct((a["rest"] - F.when(on, a["w"]).otherwise(0.0)).alias("rest"), F.when(on, a["w"] * ratio(a["k"], up)).otherwise(a["w"]).alias("w"), F.when(on, a["k"] + (1 if up else -1)).otherwise(a["k"]).alias("k"))
            return F.aggregate(steps[up], start, step, lambda a: a["k"])

        sides = F.struct(whole(True).alias("above"), F.when(last[False] > 0, whole(False)).otherwise(0.0).alias("below"))

        def choose(s: Column) -> Column:
            at = v["u"] * (s["above"] + s["below"])
            return F.when((at < s["above"]) | (last[False] <= 0), find(True, at)).otherwise(find(False, at - s["above"]))

        return _let(sides, choose).cast("long")

    return _let(given, lambda v: _let(weigh(v), invert))


def split(counts: DataFrame, n_sources: int, seed: int, level: int) -> DataFrame:
    """node, mix_rank and n of the next level, from those of this one: half of each node's copies go to its left child
    (2 * node), source by source as a multivariate hypergeometric draw."""
    wanted = counts.groupBy("node").agg(F.sum("n").alias("n")).select("node", F.lit(0).cast("long").alias("part"), F.ceil(F.col("n") / 2).alias("left"))
    depth = 1
    while FAN**depth < n_sources:
        depth += 1
    for digit in reversed(range(depth)):
        part = F.floor(F.col("mix_rank") / FAN**digit)
        parts = counts.groupBy("node", part.alias("part")).agg(F.sum("n").alias("n"))
        one = F.struct("part", "n", _uniform(seed, f"split {level} {digit}", "node", "part").alias("u"))
        family = parts.groupBy("node", F.floor(F.col("part") / FAN).alias("above")).agg(F.sort_array(F.collect_list(one)).alias("parts"), F.sum("n").alias("total"))
        family = family.join(wanted.withColumnRenamed("part", "above"), ["node", "above"])
        start = F.struct(F.col("total").alias("total"), F.col("left").alias("left"), F.expr("cast(array() as array<struct<part:bigint,left:bigint>>)").alias("out"))

        def step(a: Column, p: Column) -> Column:
            drawn = hypergeometric(a["total"], p["n"], a["left"], p["u"])
            return _let(drawn, lambda k: F.struct((a["total"] - p["n"]).alias("total"), (a["left"] - k).alias("left"), F.array_append(a["out"], F.struct(p["part"].alias("part"), k.alias("left"))).alias("out")))

        wanted = family.select("node", F.explode(F.aggregate("parts", start, step, lambda a: a["out"])).alias("x")).select("node", "x.part", "x.left")
    both = counts.join(wanted.withColumnRenamed("part", "mix_rank"), ["node", "mix_rank"])
    sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("left")).alias("n")))
    return both.select("mix_rank", F.explode(sides).alias("x")).select("x.node", "mix_rank", "x.n")


def quotas(counts: DataFrame, levels: int = LEVELS, seed: int = 7) -> DataFrame:
    """node (the shard), mix_rank and n, from each source's number of block copies (mix_rank, n)."""
    sources = counts.count()
    counts = counts.withColumn("node", F.lit(0).cast("long"))
    for level in range(levels):
        counts = durable(split(counts, sources, seed, level))
    return counts


def deal(mixed: DataFrame, levels: int = LEVELS, seed: int = 7) -> DataFrame:
    """One row for each taking of a row of mix(): its columns, mix_copy (from 0), mix_words, mix_shard, mix_place. The
    rows of a shard in order of mix_place are shuffled."""
    key = ["mix_rank", "mix_block"]
    blocks = mixed.groupBy(*key).agg(F.max("mix_passes").alias("passes"), F.max(F.when(F.col("mix_extra") > 0, 1).otherwise(0)).alias("more"), F.max("mix_size").alias("most"))
    last = (F.col("passes") + F.col("more") - 1).cast("int")
    slots = durable(blocks.where((F.col("most") > 0) & (last >= 0)).select(*key, F.explode(F.sequence(F.lit(0), last)).alias("mix_copy")))
    counts = durable(slots.groupBy("mix_rank").agg(F.count("*").alias("n")))
    shares = quotas(counts, levels, seed).groupBy("mix_rank").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("shares"))  # a row a shard
    upto = F.aggregate("shares", F.expr("cast(array(0) as array<bigint>)"), lambda a, s: F.array_append(a, F.element_at(a, -1) + s["n"]))
    shares = shares.select("mix_rank", F.slice(upto, 2, 2**levels - 1).alias("bounds")) if levels else shares.select("mix_rank", F.expr("cast(array() as array<bigint>)").alias("bounds"))
    turn = _draw(seed, "slot", *key, "mix_copy")
    ordered = slots.join(counts, "mix_rank").join(shares, "mix_rank").withColumn("turn", turn).withColumn("part", F.pmod("turn", F.ceil(F.sqrt("n"))))
    earlier = Window.partitionBy("mix_rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("mix_rank", "part").agg(F.count("*").alias("k")).select("mix_rank", "part", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("below"))
    place = F.col("below") + F.row_number().over(Window.partitionBy("mix_rank", "part").orderBy("turn", "mix_block", "mix_copy")) - 1
    placed = ordered.join(parts, ["mix_rank", "part"]).withColumn("place", place)
    placed = durable(placed.select(*key, "mix_copy", F.size(F.filter("bounds", lambda b: b <= F.col("place"))).alias("mix_shard")))
    copies = mixed.where("mix_taken > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), (F.col("mix_passes") - F.when(F.col("mix_extra") > 0, 0).otherwise(1)).cast("int"))))
    copies = copies.withColumn("mix_words", F.when(F.col("mix_copy") < F.col("mix_passes"), F.col("mix_size")).otherwise(F.col("mix_extra")))
    return copies.join(placed, [*key, "mix_copy"]).withColumn("mix_place", _draw(seed, "place", *ROW, "mix_copy"))


def mixed_rows(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The rows of docs (text, source, ...) with all their columns, as often as the mix takes them, shard by shard (in
    ranges of mix_shard and mix_place, sorted), documents taken whole."""
    known = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source", *_identity(docs))
    rows = durable(mix(known.select("source", "mix_size", "mix_r1", "mix_r2"), seed=seed, whole=True, **options))
    takings = durable(deal(rows, seed=seed).select(F.col("mix_r1").alias("t1"), F.col("mix_r2").alias("t2"), "mix_shard", "mix_place"))
    release(rows)
    texts = known.select("row", "mix_r1", "mix_r2").dropDuplicates(["mix_r1", "mix_r2"])
    found = texts.join(takings, F.expr("mix_r1 = t1 and mix_r2 = t2"))
    return found.select("row", "mix_shard", "mix_place").repartitionByRange("mix_shard", "mix_place").sortWithinPartitions("mix_shard", "mix_place")


def op8_hypergeometric_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = durable(mix(identified(docs).drop("text")))
    one = F.struct("mix_copy", "mix_shard", F.hex("mix_place").alias("place"))
    key = ["mix_rank", "mix_block", "mix_slot"]
    taken = deal(mixed).groupBy(*key).agg(F.sum("mix_words").alias("taken"), F.sort_array(F.collect_list(one)).alias("takings"))  # 3 at most
    rows = mixed.join(taken, key, "left")
    listed = lambda x: F.coalesce(F.array_join(F.transform("takings", lambda t: t[x].cast("string")), ","), F.lit("")).alias(x)
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), listed("mix_shard").alias("shards"), listed("place").alias("places"))
