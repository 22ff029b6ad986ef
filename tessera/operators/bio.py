"""K-mers and dissimilarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tiles
from .lineage import checkpointed

#: Starts of k-mers in one piece of a sequence.
PIECE = 128


def reverse_complement(kmer: Column) -> Column:
    return F.translate(F.reverse(kmer), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def kmers(df: DataFrame, k: int = 11, drop_last: bool = False, form: str = "forward") -> DataFrame:
    """Counts by row of the k-mers of the sequence in col. form: forward, reverse (complements) or canonical."""
    # substr() walks to its start, so sequences are cut into overlapping pieces of PIECE starts first
    x = df.select("row", F.expr("left(col, length(col) - 1)").alias("col") if drop_last else "col").where(F.length("col") >= k)
    x = x.select("row", F.explode(F.expr(f"transform(sequence(1, length(col) - {k - 1}, {PIECE}), i -> substr(col, i, {PIECE + k - 1}))")).alias("piece"))
    x = x.select("row", F.explode(F.expr(f"transform(sequence(1, length(piece) - {k - 1}), i -> substr(piece, i, {k}))")).alias("col"))
    if form != "forward":
        x = x.withColumn("col", (reverse_complement if form == "reverse" else canonical)(F.col("col")))
    return x.groupBy("row", "col").agg(F.count("*").alias("val"))


def kmer_degrees(counts: DataFrame) -> DataFrame:
    """node and deg: the k-mers of each sample, repeats included."""
    return counts.groupBy(F.col("row").alias("node")).agg(F.sum("val").alias("deg"))


def pack(kmer: Column) -> Column:
    """Two bits a letter (A 0, C 1, G 2, T 3) in a long; as many letters as 31, in the order of the text."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(packed: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(packed.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def pipe(lines: DataFrame, k: int = 11, mode: str = "forward", binary: bool = False) -> DataFrame:
    """Lines "k-mer,count" (column value) with the k-mer as it is (forward), its reverse complement (reverse) or the
    lesser of both (canonical); binary: the k-mer with its length in two bytes before it, then the count in eight."""
    kmer, rest = F.left("value", F.lit(k)), F.substr("value", F.lit(k + 1))
    kmer = {"forward": lambda x: x, "reverse": reverse_complement, "canonical": canonical}[mode](kmer)
    if not binary:
        return lines.select(F.concat(kmer, rest).alias("value"))
    count = F.unhex(F.lpad(F.hex(F.substr("value", F.lit(k + 2)).cast("long")), 16, "0"))
    return lines.select(F.concat(F.unhex(F.lpad(F.hex(F.lit(k)), 4, "0")), F.encode(kmer, "UTF-8"), count).alias("value"))


def all_kmers(spark: SparkSession, k: int) -> DataFrame:
    """Every k-mer with its share of G and C."""
    kmer = unpack(F.col("id"), k)
    return spark.range(4**k).select(kmer.alias("row"), F.lit("gc").alias("col"), gc_content(kmer).alias("val"))


def generate(df_or_spark, n: int, k: int = 11, seed: int = 7, gc: float = 0.5) -> DataFrame:
    """n seeded random k-mers whose letters are G or C with probability gc. A letter is a hash of seed, number and place,
    so any part of them can be made again from where one left off."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    share = lambda i, what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id", F.lit(i)), F.lit(1 << 30)) / (1 << 30)
    half = lambda i: share(i, 2) < 0.5
    letter = lambda i: F.when(share(i, 1) < gc, F.when(half(i), "G").otherwise("C")).otherwise(F.when(half(i), "A").otherwise("T"))
    return spark.range(n).select(F.col("id").alias("row"), F.concat(*map(letter, range(k))).alias("col"))


def gc_content(kmer: Column) -> Column:
    return F.length(F.regexp_replace(kmer, "[^GC]", "")) / F.length(kmer)


def _shared(df: DataFrame, value: str = "val") -> DataFrame:
    a, b = df.alias("a"), df.alias("b")
    return (
        a.join(b, (F.col("a.col") == F.col("b.col")) & (F.col("a.row") < F.col("b.row")))
        .groupBy(F.col("a.row").alias("row"), F.col("b.row").alias("col"))
        .agg(F.sum(F.least(F.col(f"a.{value}"), F.col(f"b.{value}"))).alias("low"))
    )


#: Rows of a block: pairs of blocks are dealt to tasks, so no side is held whole.
BLOCK = 2000


def sharing_pairs(df: DataFrame, distance: str = "bray_curtis") -> DataFrame:
    """bray_curtis() or weighted_jaccard() of the pairs of rows that share a column: all others are at distance 1."""
    sums = df.groupBy("row").agg(F.sum("val").alias("s"))
    x = _shared(df).join(sums, "row").join(sums.select(F.col("row").alias("col"), F.col("s").alias("t")), "col")
    both = F.col("s") + F.col("t")
    return x.select("row", "col", (1 - (2 * F.col("low") / both if distance == "bray_curtis" else F.col("low") / (both - F.col("low")))).alias("val"))


def bray_curtis(df: DataFrame) -> DataFrame:
    """1 - 2 sum(min) / (sum + sum) for every pair of rows, 1 for pairs that share nothing."""
    x = tiles.pairs(checkpointed(df.select("row", "col", "val")), True, BLOCK)
    return x.select("row", "col", (1 - 2 * F.col("low") / (F.col("s") + F.col("t"))).alias("val"))


def weighted_jaccard(df: DataFrame) -> DataFrame:
    """1 - sum(min) / sum(max) for every pair of rows."""
    x = tiles.pairs(checkpointed(df.select("row", "col", "val")), True, BLOCK)
    return x.select("row", "col", (1 - F.col("low") / (F.col("s") + F.col("t") - F.col("low"))).alias("val"))


def sample_distance(df: DataFrame) -> DataFrame:
    """1 - sum(min(share, share)) for pairs of rows that share a column; shares are of the row's sum."""
    total = df.groupBy("row").agg(F.sum("val").alias("s"))
    x = df.join(total, "row").select("row", "col", (F.col("val") / F.col("s")).alias("share"))
    return _shared(x, "share").select("row", "col", (1 - F.col("low")).alias("val"))


def bin2d(df: DataFrame, x: Column, y: Column, value: Column, low: tuple[float, float], high: tuple[float, float], size: tuple[float, float], *by: str) -> DataFrame:
    """Minimum, maximum, sum and count in bins of a closed window; bins are counted from its corner."""
    inside = df.where(x.between(low[0], high[0]) & y.between(low[1], high[1]))
    cell = lambda c, k: F.floor((c - low[k]) / size[k]).cast("long")
    return inside.groupBy(cell(x, 0).alias("bin_x"), *by, cell(y, 1).alias("bin_y")).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.count(value).alias("count"))
