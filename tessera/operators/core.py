"""Operators on triples (row, col, val): selection, maps, products, element-wise operations, reductions.

All are lazy functions of DataFrames. val may have any numeric type; columns besides the three are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FractionalType, IntegralType

from tessera.functions import ranges
from tessera.functions.semiring import VERBATIM, Binary, Fold, binary, fold

from .lineage import checkpointed

KEY = ["row", "col"]


# --- selection -------------------------------------------------------------------------------------------------------


def select_range(df: DataFrame, text: str | None, part: str = "row", negate: bool = False) -> DataFrame:
    """Entries whose row, col or val is in a range string."""
    test = ranges.matches(F.col(part), text)
    return df.where(~test if negate else test)


def select_prefix(df: DataFrame, prefix: str, part: str = "row") -> DataFrame:
    return df.where(F.startswith(F.col(part), F.lit(prefix)))


def min_max(df: DataFrame, low=None, high=None, part: Column | str = "val") -> DataFrame:
    """Entries with low <= value <= high; None leaves a side open."""
    value = F.col(part) if isinstance(part, str) else part
    for test in [*([value >= low] if low is not None else []), *([value <= high] if high is not None else [])]:
        df = df.where(test)
    return df


TRIANGLES = {"upper": "row < col", "upper_diagonal": "row <= col", "lower": "row > col", "lower_diagonal": "row >= col", "diagonal": "row = col", "no_diagonal": "row <> col"}


def triangle(df: DataFrame, which: str) -> DataFrame:
    return df.where(TRIANGLES[which])


def parity_support(df: DataFrame, k: int) -> DataFrame:
    """Entries of a parity product (edges 1, wedges 2 each) that are edges in k - 2 triangles or more."""
    return df.where((F.col("val") % 2 == 1) & (F.expr("(val - 1) div 2") >= k - 2))


def nodes_by_degree(nodes: DataFrame, degrees_: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Nodes whose degree, in a table of node and deg, is from low to high; those without a degree go."""
    return nodes.join(min_max(degrees_, low, high, "deg").select("node"), "node", "left_semi")


def row_size(df: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """Entries of rows with low to high entries: a grouped count and a semi join, so long rows stay spread."""
    return df.join(min_max(df.groupBy("row").count(), low, high, "count").select("row"), "row", "left_semi")


def top_k(df: DataFrame, k: int) -> DataFrame:
    """The k largest entries of each row, ties to smaller columns."""
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("val").desc(), "col"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _ordered(df: DataFrame, by: str) -> DataFrame:
    """df dealt out by ranges of ``by`` in ascending order, numbered by range_no. Range bounds come from samples, so the
    result is checkpointed: later reads see the same ranges."""
    return checkpointed(df.repartitionByRange(by).withColumn("range_no", F.spark_partition_id()))


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    """Entries of rows whose contents (all columns and values) differ from the row before in key order.

    A row's contents are compared by its size and two sums of hashes, which combine before the shuffle, so a row of any
    length is spread. The order over all rows is kept range by range; only the ranges' last rows are looked at together.
    """
    digest = lambda seed: F.sum(F.xxhash64(F.lit(seed), "col", "val").cast("decimal(20,0)"))
    rows = _ordered(df.groupBy("row").agg(F.struct(F.count("*").alias("n"), digest(1).alias("a"), digest(2).alias("b")).alias("content")), "row")
    ends = rows.groupBy("range_no").agg(F.max_by("content", "row").alias("end"))  # one row a range
    ends = ends.select("range_no", F.lag("end").over(Window.orderBy("range_no")).alias("end"))
    before = F.coalesce(F.lag("content").over(Window.partitionBy("range_no").orderBy("row")), F.col("end"))
    changed = rows.join(ends, "range_no").withColumn("before", before).where("before is null or before <> content")
    return df.join(changed.select("row"), "row", "left_semi")


def sample(df: DataFrame, share: float) -> DataFrame:
    """Entries whose key hashes into the share: the same ones whenever it is asked."""
    if share <= 0:
        raise ValueError("share must be above 0")
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("row").cast("string"), F.col("col").cast("string"))), 1, 8), 16, 10).cast("long")
    return df if share >= 1 else df.where(digest < int(share * 2**32))


def _parts(sizes: DataFrame, bounds: list[float]) -> DataFrame:
    """sizes (row, n) with part: how many of the rising ``bounds`` (shares of the total) lie below the row's end."""
    sizes = _ordered(sizes, "row")
    ranges_ = sizes.groupBy("range_no").agg(F.sum("n").alias("size"))  # one row a range
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges_ = ranges_.select("range_no", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy()).alias("total"))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("range_no").orderBy("row"))
    share = F.array(*map(F.lit, bounds)).cast("array<double>")
    return sizes.join(ranges_, "range_no").withColumn("part", F.size(F.filter(share, lambda b: b * F.col("total") <= upto - 1)).cast("int"))


def even_splits(df: DataFrame, parts: int, linear: float = 1.0, exponential: float = 1.0) -> DataFrame:
    """part and the largest row of each of ``parts`` parts with equally many entries, by exact ranks of the rows.

    linear: all parts but the last have that many times fewer entries; exponential: each part has that many times the
    entries of the one before."""
    weights = [exponential**k for k in range(parts)]
    total, bounds, at = sum(weights), [], 0.0
    for w in weights[:-1]:
        at += w / total * linear
        bounds.append(at)
    ranked = _parts(df.groupBy("row").agg(F.count("*").alias("n")), bounds)
    return ranked.groupBy("part").agg(F.max("row").alias("last_row"), F.sum("n").alias("entries"))


def wedge_splits(degrees_: DataFrame, parts: int) -> DataFrame:
    """The same for nodes (node, deg), by the wedges deg * (deg - 1) / 2 that a self product makes of them."""
    sizes = degrees_.select(F.col("node").alias("row"), F.expr("deg * (deg - 1) div 2").alias("n"))
    ranked = _parts(sizes, [k / parts for k in range(1, parts)])
    return ranked.groupBy("part").agg(F.max("row").alias("last_row"), F.sum("n").alias("wedges"))


def uniform_splits(points: int) -> list[str]:
    """Evenly spaced first bytes, as characters (255 at most; those beyond ASCII as code points)."""
    if not 0 <= points <= 255:
        raise ValueError(f"{points} split points")
    return [chr(k * (256 // (points + 1))) for k in range(1, points + 1)]


# --- maps ------------------------------------------------------------------------------------------------------------


def transpose(df: DataFrame) -> DataFrame:
    return df.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def _kind(df: DataFrame) -> DataType:
    return df.schema["val"].dataType


def _both(a: DataType, b: DataType) -> DataType:
    """The type that decides how a scalar operation goes on: a long meets a fraction as a double."""
    return b if isinstance(a, IntegralType) and isinstance(b, FractionalType) else a


def apply_scalar(df: DataFrame, op: str | Binary, scalar, scalar_on_right: bool = True, keep_zero: bool = False) -> DataFrame:
    """op(val, scalar) or op(scalar, val); zeros go unless kept, or the operation gives its left value as it is."""
    x, kind = F.lit(scalar), DoubleType() if isinstance(scalar, float) and isinstance(_kind(df), IntegralType) else _kind(df)
    f = binary(op, kind)
    out = df.withColumn("val", f(F.col("val"), x) if scalar_on_right else f(x, F.col("val")))
    return out if keep_zero or op in VERBATIM else out.where("val <> 0")


def constant(df: DataFrame, value) -> DataFrame:
    return df.withColumn("val", F.lit(value))


def retain(df: DataFrame, parts: Iterable[str] = ("row",), plus: str | Fold = "plus") -> DataFrame:
    """Entries keep only some parts of their key, the others become empty; a combiner folds what falls together."""
    parts, f = list(parts), fold(plus, _kind(df))
    out = df.groupBy(*parts).agg(f(F.col("val")).alias("val"))
    return out.select(*(F.col(k) if k in parts else F.lit("").alias(k) for k in KEY), "val")


def retain_row(df: DataFrame, plus: str | Fold = "plus") -> DataFrame:
    return retain(df, ("row",), plus)


def constant_col(df: DataFrame, name, plus: str | Fold = "plus") -> DataFrame:
    return combine(df.withColumn("col", F.lit(name)), plus)


def row_to_diagonal(df: DataFrame, plus: str | Fold = "plus") -> DataFrame:
    return combine(df.withColumn("col", F.col("row")), plus)


def val_to_col(df: DataFrame) -> DataFrame:
    return df.select("row", F.col("val").cast("string").alias("col"), F.lit(1).cast("long").alias("val"))


# --- products --------------------------------------------------------------------------------------------------------


def partial_products(at: DataFrame, b: DataFrame, mult: str | Binary = "times") -> DataFrame:
    """Every product of an entry of A' and one of B in the same row."""
    a, c = at.alias("a"), b.alias("b")
    value = binary(mult, _both(_kind(at), _kind(b)))(F.col("a.val"), F.col("b.val"))
    return a.join(c, F.col("a.row") == F.col("b.row")).select(F.col("a.col").alias("row"), F.col("b.col").alias("col"), value.alias("val"))


def mxm(
    at: DataFrame, b: DataFrame, mult: str | Binary = "times", plus: str | Fold | None = "plus", row_filter: str | None = None, col_filter_a: str | None = None,
    col_filter_b: str | None = None, also_aa: bool = False, also_bb: bool = False, emit_a: bool = False, emit_b: bool = False, keep_zero: bool = False,
    observed: Observation | None = None,
) -> DataFrame:
    """A * B from A' and B over a semiring; plus=None keeps all partial products. also_aa adds A * A' (and so on),
    emit_a adds the entries of A' themselves before the fold. observed: gets the number of entries before the fold as
    ``partial_products`` when the result is computed."""
    at = select_range(select_range(at, row_filter), col_filter_a, "col")
    b = select_range(select_range(b, row_filter), col_filter_b, "col")
    out = partial_products(at, b, mult)
    for wanted, more in ((also_aa, lambda: partial_products(at, at, mult)), (also_bb, lambda: partial_products(b, b, mult)), (emit_a, lambda: at.select(*KEY, "val")), (emit_b, lambda: b.select(*KEY, "val"))):
        if wanted:
            out = out.unionByName(more())
    if observed is not None:
        out = out.observe(observed, F.count(F.lit(1)).alias("partial_products"))
    return out if plus is None else combine(out, plus, keep_zero)


def multiply_many(at: DataFrame, b: DataFrame, mult: Callable[[Column, Column, Column, Column, Column], Column]) -> DataFrame:
    """Products that give any number of entries: mult(row, A' col, B col, A' val, B val) is an array of structs of row,
    col, val."""
    a, c = at.alias("a"), b.alias("b")
    out = mult(*(F.col(x) for x in ("a.row", "a.col", "b.col", "a.val", "b.val")))
    return a.join(c, F.col("a.row") == F.col("b.row")).select(F.explode(out).alias("x")).select("x.row", "x.col", "x.val")


def row_multiply(at: DataFrame, b: DataFrame, f: Callable[[str, list, list], Iterable[tuple]], schema: str | None = None) -> DataFrame:
    """An arbitrary function of two matching rows: f(row, A' entries, B entries), each a list of (col, val), gives entries
    (row, col, val). Rows that one side lacks have an empty list. A row of either side must fit into a task."""
    kind = at.schema
    schema = schema or f"row {kind['row'].dataType.simpleString()}, col {kind['col'].dataType.simpleString()}, val {kind['val'].dataType.simpleString()}"

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [list(zip(t["col"].to_pylist(), t["val"].to_pylist(), strict=True)) for t in (left, right)]
        row = (left if left.num_rows else right)["row"][0].as_py()
        found = list(f(row, *sides))
        names = ("row", "col", "val")
        types = [left.schema.field(n).type for n in names]
        return pa.table([pa.array([x[k] for x in found], types[k]) for k in range(3)], names)

    pick = lambda df: df.select(*KEY, "val").groupBy("row")
    return pick(at).cogroup(pick(b)).applyInArrow(both, schema)


def combine(df: DataFrame, plus: str | Fold = "plus", keep_zero: bool = False) -> DataFrame:
    """One entry for each (row, col); zeros go unless kept."""
    out = df.groupBy(*KEY).agg(fold(plus, _kind(df))(F.col("val")).alias("val"))
    return out if keep_zero else out.where("val <> 0")


def combine_many(df: DataFrame, f: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """A combiner that gives any number of entries for a key: f(row, col, sorted array of the values) is an array of
    structs of row, col, val. The values of one key must fit into a task."""
    found = df.groupBy(*KEY).agg(F.sort_array(F.collect_list("val")).alias("vals"))
    return found.select(F.explode(f(F.col("row"), F.col("col"), F.col("vals"))).alias("x")).select("x.row", "x.col", "x.val")


# --- element-wise ----------------------------------------------------------------------------------------------------


def ewise(a: DataFrame, b: DataFrame, op: str | Binary, how: str = "inner", fill=None, keep_zero: bool = False) -> DataFrame:
    """op over cells of A and B. how: inner (multiply), full (add), left, right. A cell that one side lacks passes the
    other's value through unchanged, or takes ``fill`` for the missing one."""
    l, r = a.select(*KEY, F.col("val").alias("l")), b.select(*KEY, F.col("val").alias("r"))
    both, f = l.join(r, KEY, how), binary(op, _both(_kind(a), _kind(b)))
    if fill is None:
        value = F.when(F.col("l").isNull(), F.col("r")).when(F.col("r").isNull(), F.col("l")).otherwise(f(F.col("l"), F.col("r")))
    else:
        value = f(F.coalesce("l", F.lit(fill)), F.coalesce("r", F.lit(fill)))
    out = both.select(*KEY, value.alias("val"))
    return out if keep_zero or op in VERBATIM else out.where("val <> 0")


def ewise_mult(a: DataFrame, b: DataFrame, op: str | Binary = "times") -> DataFrame:
    return ewise(a, b, op)


def ewise_add(a: DataFrame, b: DataFrame, op: str | Binary = "plus", fill=None) -> DataFrame:
    return ewise(a, b, op, "full", fill)


def symmetric_difference(a: DataFrame, b: DataFrame, emit_a: bool = True, emit_b: bool = True) -> DataFrame:
    """Cells that only one of the two has."""
    parts = [x.join(y.select(*KEY), KEY, "left_anti").select(*KEY, "val") for x, y, wanted in ((a, b, emit_a), (b, a, emit_b)) if wanted]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def select_rows_of(b: DataFrame, a: DataFrame, anti: bool = False) -> DataFrame:
    """Entries of B whose row A has (or lacks)."""
    return b.join(a.select("row"), "row", "left_anti" if anti else "left_semi")


def delete_cells(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select(*KEY), KEY, "left_anti")


# --- reductions ------------------------------------------------------------------------------------------------------


def degrees(df: DataFrame, weights: bool = False) -> DataFrame:
    """node and its number of entries, or the sum of their values."""
    return df.groupBy(F.col("row").alias("node")).agg((F.sum("val") if weights else F.count("*")).alias("deg"))


def count_entries(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("entries"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("row").alias("rows"))


def gather(df: DataFrame, part: str = "col") -> DataFrame:
    """Distinct values of one part of the key, as rows."""
    return df.select(part).distinct()


def wedge_total(df: DataFrame) -> DataFrame:
    """Pairs of entries that share a row: what a self product will make."""
    return degrees(df).agg(F.expr("cast(sum(deg * (deg - 1) div 2) as bigint)").alias("wedges"))


def stats(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*(by or KEY)).agg(F.min("val").alias("min"), F.max("val").alias("max"), F.sum("val").alias("sum"), F.count("val").alias("count"))


def merge_stats(df: DataFrame, *by: str) -> DataFrame:
    """Stats of parts to stats of the whole."""
    return df.groupBy(*by).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count"))


def combining_columns(df: DataFrame, folds: dict[str, str], version: str = "ts", lossy: bool = False) -> DataFrame:
    """Each column of the matrix with its own fold (sum, max, min in any case, or a name of the semiring's; ":" is all
    others); without one the newest counts. lossy: val is text, and what is no number in a folded column is passed over;
    the result is text then."""
    number = F.col("val").try_cast("decimal(38,9)") if lossy else F.col("val")
    kind = DecimalType(38, 9) if lossy else _kind(df)
    text = lambda c: F.rtrim(F.rtrim(c.cast("string"), F.lit("0")), F.lit(".")) if lossy else c
    folded = lambda op: text(fold(COMBINING.get(op.lower(), op.lower()), kind)(number))
    value = folded(folds[":"]) if ":" in folds else F.max_by("val", version)
    for name, op in folds.items():
        if name != ":":
            value = F.when(F.col("col") == name, folded(op)).otherwise(value)
    return df.groupBy(*KEY).agg(value.alias("val"))


#: Names of column combiners beside the semiring's own.
COMBINING = {"sum": "plus", "sum_decimal": "plus", "min_decimal": "min", "max_decimal": "max"}


def designate(folds: dict[str, str], columns: str, op: str) -> dict[str, str]:
    """folds with a delimited list of columns (or ":") under op; a column that has another fold is an error."""
    if COMBINING.get(op.lower(), op.lower()) not in ("plus", "min", "max"):
        raise ValueError(f"not sum, min or max: {op!r}")
    names = columns[:-1].split(columns[-1]) if columns != ":" else [":"]
    for name in names:
        if folds.get(name, op).lower() != op.lower():
            raise ValueError(f"column {name!r} is combined by {folds[name]!r}")
    return folds | dict.fromkeys(names, op)


def revoke(folds: dict[str, str], columns: str) -> dict[str, str]:
    names = columns[:-1].split(columns[-1]) if columns != ":" else [":"]
    return {k: v for k, v in folds.items() if k not in names}


def list_combining(folds: dict[str, str]) -> dict[str, list[str]]:
    """Columns by their fold."""
    return {op: sorted(k for k, v in folds.items() if v == op) for op in sorted(set(folds.values()))}


def latest_version(df: DataFrame, version: str = "ts") -> DataFrame:
    return df.groupBy(*KEY).agg(F.max_by("val", version).alias("val"))


def two_version_gate(df: DataFrame, least, version: str = "ts") -> DataFrame:
    """Cells of exactly two versions whose newer value is at least ``least``; what stays has value 1."""
    cells = df.groupBy("row", "col").agg(F.count("*").alias("n"), F.max_by("val", version).alias("newest"))
    return cells.where((F.col("n") == 2) & (F.col("newest") >= least)).select("row", "col", F.lit(1).cast("long").alias("val"))


def sum_after(df: DataFrame, threshold: Column, version: str = "ts") -> DataFrame:
    """Sum of the versions from the threshold on, and the newest version before it."""
    at = F.col(version)
    return df.groupBy(*KEY).agg(F.sum(F.when(at >= threshold, F.col("val"))).alias("val"), F.max_by("val", F.when(at < threshold, at)).alias("before"))


def page(df: DataFrame, limit: int, after: tuple | None = None, key: Iterable[str] = ("row", "col")) -> DataFrame:
    """The next entries in key order, after the key that the last page ended with."""
    key = list(key)
    if after is not None:
        test = F.lit(False)
        for k in reversed(range(len(key))):
            test = (F.col(key[k]) > after[k]) | ((F.col(key[k]) == after[k]) & test)
        df = df.where(test)
    return df.orderBy(*key).limit(limit)


def find(df: DataFrame, rows: str = ":", cols: str = ":", family: str | None = None) -> DataFrame:
    """Associative-array lookup: each of rows and cols is a lookup list of keys, prefixes ``a*`` and ranges.

    Both tests hold for an entry, so two lists also find crosswise pairs. family restricts column colf.
    """
    if family is not None:
        df = df.where(F.col("colf") == family)
    return df.where(ranges.lookup(F.col("row"), rows) & ranges.lookup(F.col("col"), cols))


#: A word of a label, bare or quoted, and what labels are malformed: missing or doubled operators, empty brackets.
_LABEL_WORD = r'"(?:[^"\\]|\\.)+"|[A-Za-z0-9_:./-]+'
_MALFORMED = r"[^w&|()\s]|[w)]\s*[w(]|[&|(]\s*(?:[&|)]|$)|^\s*[&|)]"


def visible(df: DataFrame, authorizations: set[str]) -> DataFrame:
    """Entries whose label (column vis) the reader meets: words joined by ``&`` or ``|``, nested in brackets to any
    depth. An empty or null label is met by all, a malformed one (``&`` and ``|`` mixed in one level too) by none."""
    label = F.coalesce("vis", F.lit(""))
    have = F.array(*map(F.lit, sorted(authorizations))).cast("array<string>")
    frame = "struct<met:boolean,op:string>"
    below = lambda stack: F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
    last = lambda stack: F.try_element_at(stack, F.lit(-1))

    def joined(rest: Column, top: Column, value: Column) -> Column:
        met = F.when(top["op"] == "&", top["met"] & value).when(top["op"] == "|", top["met"] | value).when(top["op"] == "", value).otherwise(F.lit(False))
        return F.array_append(rest, F.struct(met.alias("met"), top["op"].alias("op")).cast(frame))

    def step(stack: Column, token: Column) -> Column:
        top, rest = last(stack), below(stack)
        op = F.when(top["op"].isin("", token), token).otherwise("mixed")
        word = F.regexp_replace(F.regexp_replace(token, '^"|"$', ""), r"\\\\(.)", "$1")
        return (
            F.when(token.isin("&", "|"), F.array_append(rest, F.struct(F.when(op == "mixed", False).otherwise(top["met"]).alias("met"), op.alias("op")).cast(frame)))
            .when(token == "(", F.array_append(stack, F.struct(F.lit(None).alias("met"), F.lit("").alias("op")).cast(frame)))
            .when(token == ")", joined(below(rest), last(rest), top["met"]))
            .otherwise(joined(rest, top, F.array_contains(have, word)))
        )

    tokens = F.regexp_extract_all(label, F.lit(f"{_LABEL_WORD}|[&|()]"), F.lit(0))
    stack = F.aggregate(tokens, F.expr(f"cast(array(struct(null, '')) as array<{frame}>)"), step)
    shape = F.regexp_replace(label, _LABEL_WORD, "w")
    balanced = F.regexp_count(shape, F.lit(r"\(")) == F.regexp_count(shape, F.lit(r"\)"))
    met = ~F.rlike(shape, F.lit(_MALFORMED)) & balanced & (F.size(stack) == 1) & last(stack)["met"]
    return df.where((label == "") | F.coalesce(met, F.lit(False)))
