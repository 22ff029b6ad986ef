"""Reading and writing triples: files, delimited strings, wide rows, graph schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import core


def read_triples(spark: SparkSession, path: str, separator: str = "\t", value: str = "double") -> DataFrame:
    """Lines of row, col and perhaps a value (1 if there is none)."""
    lines = F.split(F.col("value"), F.lit(separator))
    return spark.read.text(path).where("value <> ''").select(lines[0].alias("row"), lines[1].alias("col"), F.coalesce(F.try_element_at(lines, F.lit(3)).cast(value), F.lit(1).cast(value)).alias("val"))


def _numbered(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """df with ``number``, from 0 in the order of its rows, apart for each value of ``by``.

    Rows are numbered block by block: a block's rows have consecutive ids, and blocks of one value are few."""
    block = F.shiftright(F.monotonically_increasing_id(), 33).alias("block")
    lines = df.select(*columns, block, F.monotonically_increasing_id().alias("id"))
    earlier = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(by, "block").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return lines.join(blocks, [by, "block"]).withColumn("number", F.col("id") - F.col("first") + F.col("before")).select(*columns, "number")


def _items(spark: SparkSession, path: str, separator: str, name: str) -> DataFrame:
    """The items of a file of one long list, numbered; line breaks part items too."""
    items = spark.read.option("lineSep", separator).text(path)
    split = items.select(F.posexplode(F.split("value", "\r?\n")).alias("part", name), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("start"))
    ranked = split.where(F.col(name) != "").withColumn("one", F.lit(0))
    # parts of a file that were split between tasks stand in the order of their starts
    earlier = Window.partitionBy("one").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy("one", "start").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("start").orderBy("at", "part")) - 1
    return ranked.withColumn("place", place).join(sizes.select("start", "before"), "start").select((F.col("place") + F.col("before")).alias("number"), name)


def read_triple_files(spark: SparkSession, rows: str, cols: str, vals: str | None = None, separator: str = ",", value: str = "double") -> DataFrame:
    """Triples from a file of rows, one of columns and perhaps one of values (1 if there is none), item by item; .gz files
    are read too. Blocks are windows of their own, as large as the session's splits."""
    found = _items(spark, rows, separator, "row").join(_items(spark, cols, separator, "col"), "number")
    if vals is not None:
        found = found.join(_items(spark, vals, separator, "text"), "number").withColumn("val", F.col("text").cast(value))
    else:
        found = found.withColumn("val", F.lit(1).cast(value))
    return found.select("row", "col", "val")


def _arcs(pairs: DataFrame, reverse: bool) -> DataFrame:
    low, high = F.least("a", "b").alias("row"), F.greatest("a", "b").alias("col")
    found = pairs.where("a <> b").select(low, high).distinct().withColumn("val", F.lit(1).cast("long"))
    return core.transpose(found) if reverse else found


def read_arcs(spark: SparkSession, path: str, separator: str = "\t", reverse: bool = False) -> DataFrame:
    """Integer arcs of a file, or all files of a folder, as undirected edges, each once with row < col (reverse: row >
    col), no loops."""
    return _arcs(spark.read.csv(path, sep=separator, schema="a long, b long"), reverse)


def read_arc_files(spark: SparkSession, starts: str, ends: str, separator: str = ",", reverse: bool = False) -> DataFrame:
    """The same from a file of starts and one of ends."""
    pairs = read_triple_files(spark, starts, ends, None, separator)
    return _arcs(pairs.select(F.col("row").cast("long").alias("a"), F.col("col").cast("long").alias("b")), reverse)


def read_sequences(spark: SparkSession, path: str, every: int = 1, offset: int = 0) -> DataFrame:
    """CSV of seqid, seq with a header: row is the file, col the sequence; every n-th line of each file from an offset."""
    read = spark.read.csv(path, header=True, schema="seqid string, seq string")
    named = read.select(F.col("_metadata.file_path").alias("row"), F.col("seq").alias("col"), F.col("_metadata.file_block_start").alias("start"))
    if every == 1 and offset == 0:
        return named.select("row", "col", F.lit(1).cast("long").alias("val"))
    block = ["row", "start"]
    lines = named.select("*", F.monotonically_increasing_id().alias("id"))
    earlier = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(*block).agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    at = F.col("id") - F.col("first") + F.col("before") - offset
    return lines.join(blocks, block).where((at >= 0) & (at % every == 0)).select("row", "col", F.lit(1).cast("long").alias("val"))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Grid CSV (longitude, latitude, ndsi, ndsi_count, land_sea_mask) as row, colf, col, val; labels padded to 5."""
    grid = spark.read.csv(path, header=True, schema="longitude int, latitude int, ndsi double, ndsi_count int, land_sea_mask int")
    label = lambda c: F.lpad(F.col(c).cast("string"), 5, "0")
    return grid.select(label("longitude").alias("row"), label("latitude").alias("col"), F.expr("stack(2, 'ndsi', ndsi, 'lsm', cast(land_sea_mask as double)) as (colf, val)")).select("row", "colf", "col", "val")


def insert_strings(spark: SparkSession, rows: str, cols: str, vals: str, family: str | None = None, visibility: str | None = None, integers: bool = False) -> DataFrame:
    """Triples from three strings whose last characters separate their items, with columns colf and vis where family and
    visibility are given. integers: keys and values are integers, and only entries with row < col stay."""
    parts = [x[:-1].split(x[-1]) if x else [] for x in (rows, cols, vals)]
    if len({len(p) for p in parts}) != 1:
        raise ValueError("rows, cols and vals differ in length")
    df = spark.createDataFrame(list(zip(*parts, strict=True)), "row string, col string, val string")
    if integers:
        df = df.select(*(F.col(c).cast("long").alias(c) for c in df.columns)).where("row < col")
    for name, label in (("colf", family), ("vis", visibility)):
        if label is not None:
            df = df.withColumn(name, F.lit(label))
    return df


def to_strings(df: DataFrame, separator: str = ",") -> DataFrame:
    """The three strings of a small result, as one row in key order."""
    entries = F.sort_array(F.collect_list(F.struct("row", "col", "val")))
    joined = lambda c: F.concat(F.array_join(F.transform("x", lambda e: e[c].cast("string")), separator), F.lit(separator)).alias(c)
    return df.agg(entries.alias("x")).select(*map(joined, ("row", "col", "val")))


def melt(df: DataFrame, key: str | None, columns: list[str]) -> DataFrame:
    """Wide rows as triples: key (or the row's number from 1), column name, value as text without line breaks; null and
    empty values are "NULL"."""
    if key is None:
        one = df.select(F.struct(*columns).alias("cells"), F.lit(0).alias("one"))
        df = _numbered(one, "one", ["one", "cells"]).select((F.col("number") + 1).alias("number"), "cells.*")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in columns)))
    clean = F.regexp_replace(F.col("x.val"), "[\r\n]", "")
    return df.select(F.col(key or "number").alias("row"), cells.alias("x")).select("row", "x.col", F.when(F.coalesce(clean, F.lit("")) == "", "NULL").otherwise(clean).alias("val"))


def read_jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, **options: str) -> DataFrame:
    """A query's result as triples, by a key column or by row numbers."""
    df = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return melt(df, key, [c for c in df.columns if c != key])


def incidence(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edge, role (out, in), node, val; an edge's id is its two ends. most: the first so many edges in key order."""
    if most is not None:
        edges = core.page(edges, most)
    edge = F.concat_ws("|", F.col("row").cast("string"), F.col("col").cast("string"))
    ends = F.array(F.struct(F.lit("out").alias("role"), F.col("row").alias("node")), F.struct(F.lit("in").alias("role"), F.col("col").alias("node")))
    return edges.select(edge.alias("edge"), F.explode(ends).alias("x"), "val").select("edge", "x.role", "x.node", "val")


def single_table(edges: DataFrame) -> DataFrame:
    """Edges in both directions under "a|b" in column edge, out-degrees under "a" in column deg."""
    both = edges.unionByName(core.transpose(edges))
    name = F.concat_ws("|", F.col("row").cast("string"), F.col("col").cast("string"))
    rows = both.select(name.alias("row"), F.lit("edge").alias("col"), F.col("val").cast("long").alias("val"))
    return rows.unionByName(core.degrees(both).select(F.col("node").cast("string").alias("row"), F.lit("deg").alias("col"), F.col("deg").alias("val")))


def adjacency_schema(edges: DataFrame, weights: bool = False) -> dict[str, DataFrame]:
    """The adjacency tables: edges, transpose, degrees by row (out) and column (in) in one table, fields."""
    edges = core.combine(edges)
    out, into = core.degrees(edges, weights), core.degrees(core.transpose(edges), weights)
    deg = out.select(F.col("node").alias("row"), F.lit("out").alias("col"), F.col("deg").alias("val")).unionByName(into.select(F.col("node").alias("row"), F.lit("in").alias("col"), F.col("deg").alias("val")))
    return {"main": edges, "transpose": core.transpose(edges), "degree": deg, "incidence": incidence(edges), "single": single_table(edges)}


def exploded_schema(entries: DataFrame, weights: bool = False, combined: bool = False, separator: str = "|", out: str = "out", into: str = "in") -> dict[str, DataFrame]:
    """The tables of an exploded schema over entries (row, col, val; text keys such as "field|value").

    main and transpose hold the entries (combined: summed by key); degree and degree_t count the entries of each row and
    column, field and field_t those of each part before the separator (keys without one have no field). weights: sums of
    val instead of counts. With a column edge there are edge, edge_t (its ends "out|row" and "in|col") and edge_degree_t.
    """
    size = F.sum("val" if weights else F.lit(1))

    def counted(df: DataFrame, key: Column, name: str) -> DataFrame:
        return df.groupBy(key.alias("row")).agg(size.alias("val")).where("row is not null").select("row", F.lit(name).alias("col"), "val")

    def field(key: str) -> Column:
        return F.when(F.contains(F.col(key), F.lit(separator)), F.substring_index(key, separator, 1))

    main = core.combine(entries.select("row", "col", "val")) if combined else entries.select("row", "col", "val")
    row, col = F.col("row"), F.col("col")
    tables = {
        "main": main,
        "transpose": core.transpose(main),
        "degree": counted(entries, row, out),
        "degree_t": counted(entries, col, into),
        "field": counted(entries, field("row"), out),
        "field_t": counted(entries, field("col"), into),
    }
    if "edge" in entries.columns:
        ends = F.array(F.concat(F.lit(out + separator), row), F.concat(F.lit(into + separator), col))
        edge = entries.select(F.col("edge").alias("row"), F.explode(ends).alias("col"), "val")
        tables |= {"edge": edge, "edge_t": core.transpose(edge), "edge_degree_t": counted(edge, col, "deg")}
    return tables


def write(df: DataFrame, path: str, mode: str = "errorifexists", transposed_path: str | None = None, ranges: int | None = None, reduce: Column | None = None) -> dict:
    """A table, and perhaps its transpose, in key ranges. Gives back the number of entries and what ``reduce``, an
    aggregate over them, came to; both are gathered while the table is written."""
    seen = Observation()
    dealt = df.repartitionByRange(ranges, "row") if ranges else df  # ranges are sampled first, so count behind them
    dealt.observe(seen, F.count(F.lit(1)).alias("entries"), *([reduce.alias("reduced")] if reduce is not None else [])).write.mode(mode).parquet(path)
    if transposed_path:
        back = core.transpose(df.sparkSession.read.parquet(path))
        (back.repartitionByRange(ranges, "row") if ranges else back).write.mode(mode).parquet(transposed_path)
    return seen.get
