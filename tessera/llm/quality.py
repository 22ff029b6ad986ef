"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

A linear model g over word shapes and repetition measures minimises the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the squared loss (1 - z)^2 / 4. Trusted positives are texts
labelled 1 outside the held-out fold, ``sample`` of them at most (those with the least hash of doc_id); unlabelled is
every text of the table. No label 0 is ever looked at.

1. Moments. With the squared loss all risks are functions of first and second moments of the features, so one pass over
   all texts (a matrix a task, added up line by line) gives the whole risk, the features' means and deviations too.
2. Class prior. A model of positives against unlabelled is fitted to half of the positives. For every threshold the share
   of unlabelled texts above it over the share of the other half of the positives above it bounds the prior from above;
   the estimate is that ratio at the threshold where it is least with both shares' margins of error added (best bin
   estimation, Garg et al. 2021). The shares come from histograms of the scores of all texts.
3. Risk. The unbiased risk has a closed form; where the risk of negatives is below 0 there, gradient steps go on from it
   as the non-negative estimator prescribes, and the best of the points passed is taken.

The score is the logistic function of 2 g: 0.5 at g = 0, where both labels are equally likely. Null texts score as empty
ones; a null doc_id is never in the held-out fold. Rows in, rows out: repeats are scored alike, very long texts one by
one. With no trusted positives at all every score is 0.5. Columns of any name pass through score().
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import in_batches

SAMPLE, SHAPES = 20_000, 256
MEASURES = 10
WIDTH = SHAPES + MEASURES
#: Weight of the penalty on scaled weights; bins of a histogram of scores from -REACH to REACH.
DECAY, BINS, REACH = 1e-2, 4096, 4.0
#: Letters to a or A, digits to 0, bytes of other alphabets to a; all else stays.
_SHAPE = bytes(97 if 97 <= b < 123 or b >= 128 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256))


def features(text: str | None) -> np.ndarray:
    """Square roots of the relative frequencies of hashed word shapes, then MEASURES numbers on form and repetition."""
    x = np.zeros(WIDTH, np.float32)
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return x
    n, shaped = len(words), np.frombuffer(raw.translate(_SHAPE), np.uint8)
    keep = np.ones(len(shaped), bool)
    np.not_equal(shaped[1:], shaped[:-1], out=keep[1:])
    for shape, count in Counter(shaped[keep].tobytes().split()).items():
        x[zlib.crc32(shape) % SHAPES] += count
    x[:SHAPES] = np.sqrt(x[:SHAPES] / n)
    kinds = np.bincount(shaped, minlength=256)
    letters, spaces = kinds[97] + kinds[65], kinds[9:14].sum() + kinds[32]
    visible = max(1, len(shaped) - spaces)
    distinct = len(set(words))
    x[SHAPES:] = (
        np.log1p(n),
        distinct / n,
        np.log(distinct) / np.log1p(n),
        np.sqrt(sum(map(eq, words, words[1:])) / n),
        visible / n / 10,
        kinds[65] / max(1, letters),
        kinds[48] / visible,
        np.sqrt((visible - letters - kinds[48]) / visible),
        kinds[10] / n,
        max(Counter(words).values()) / n,
    )
    return x


def _stacked(texts: list[str | None]) -> np.ndarray:
    return np.stack([features(t) for t in texts]).astype(np.float64) if texts else np.zeros((0, WIDTH))


class Model:
    """Scores of texts: the logistic function of a linear one of their features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, float(bias)

    def values(self, texts: list[str | None]) -> np.ndarray:
        return _stacked(texts) @ self.weights + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * np.clip(self.values(texts), -15, 15)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float = DECAY, steps: int = 500, rate: float = 0.002) -> Model:
    """The model of least non-negative risk, from sums of products of (features, 1) over positives and unlabelled."""
    if not positive[-1, -1] or not unlabelled[-1, -1]:
        return Model(np.zeros(WIDTH), 0.0)
    u, p = unlabelled / unlabelled[-1, -1], positive / positive[-1, -1]
    centre = u[-1, :-1]
    scale = np.maximum(np.sqrt(np.maximum(0, np.diag(u)[:-1] - centre**2)), 0.02)
    to = np.diag(np.append(1 / scale, 1.0))
    to[:-1, -1] = -centre / scale
    u, p = to @ u @ to.T, to @ p @ to.T
    penalty = np.diag(np.append(np.full(WIDTH, decay), 0.0))
    quadratic = lambda m, sign, w: (1 - 2 * sign * (w @ m[-1]) + w @ m @ w) / 4
    slope = lambda m, sign, w: (m @ w - sign * m[-1]) / 2
    negative = lambda w: quadratic(u, -1, w) - prior * quadratic(p, -1, w)
    risk = lambda w: prior * quadratic(p, 1, w) + max(0.0, negative(w)) + w @ penalty @ w
    w = np.linalg.solve(u + 4 * penalty, 2 * prior * p[-1] - u[-1])
    best, m, v = (risk(w), w), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1 if negative(w) < 0 else 1):
        below = slope(u, -1, w) - prior * slope(p, -1, w)
        g = prior * slope(p, 1, w) + below + 2 * penalty @ w if negative(w) >= 0 else -below
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        best = min(best, (risk(w), w), key=lambda x: x[0])
    weights = best[1][:-1] / scale
    return Model(weights, best[1][-1] - centre @ weights)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled texts, from histograms of scores."""
    if not positive.sum() or not unlabelled.sum():
        return 0.5
    p, u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (positive, unlabelled))
    margin = sum(np.sqrt(np.log(4 / doubt) / (2 * x.sum())) for x in (positive, unlabelled))
    some = p > 0.01
    at = int(np.argmin((u[some] + margin) / p[some]))
    return float(np.clip(u[some][at] / p[some][at], 0.01, 0.99))


def held_out(doc_id: Column | str) -> Column:
    """Rows whose labels are kept for testing: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def _moments(rows: DataFrame) -> list[np.ndarray]:
    """Sums of products of (features, 1) over all texts, and over the positives of either half, of rows (half, text)."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, WIDTH + 1, WIDTH + 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = np.hstack([_stacked(part["text"].to_pylist()), np.ones((part.num_rows, 1))])
                half = part["half"].fill_null(-1).to_numpy(zero_copy_only=False)
                for k, some in enumerate((x, x[half == 0], x[half == 1])):
                    sums[k] += some.T @ some
        for k in range(3):
            if sums[k, -1, -1]:
                yield pa.record_batch([pa.array(np.full(WIDTH + 1, k, np.int32)), pa.array(np.arange(WIDTH + 1, dtype=np.int32)), pa.array(list(sums[k]), pa.list_(pa.float64()))], ["kind", "line", "v"])

    lines = in_batches(rows, added, "kind int, line int, v array<double>").groupBy("kind", "line")
    out = [np.zeros((WIDTH + 1, WIDTH + 1)) for _ in range(3)]
    for r in lines.agg(*(F.sum(F.get("v", F.lit(j))).alias(f"c{j}") for j in range(WIDTH + 1))).collect():  # 3 matrices
        out[r[0]][r[1]] = r[2:]
    return out


def _histograms(rows: DataFrame, model: Model) -> np.ndarray:
    """Of the model's values: of all texts, and of the positives in the second half."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                bins = np.clip((model.values(part["text"].to_pylist()) + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64)
                half = part["half"].fill_null(-1).to_numpy(zero_copy_only=False)
                counts += np.stack([np.bincount(x, minlength=BINS) for x in (bins, bins[half == 1])])
        kind, at = np.nonzero(counts)
        yield pa.record_batch([pa.array(kind.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[kind, at])], ["kind", "bin", "n"])

    out = np.zeros((2, BINS), np.int64)
    for r in in_batches(rows, counted, "kind int, bin int, n long").groupBy("kind", "bin").agg(F.sum("n")).collect():
        out[r[0], r[1]] = r[2]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    trusted = labels.where((F.col("quality") == 1) & ~held_out("doc_id") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    chosen = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("half", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select("half", "text")  # ``sample`` ids
    every, first, second = _moments(rows)
    if not first[-1, -1] + second[-1, -1]:
        return Model(np.zeros(WIDTH), 0.0)
    counts = _histograms(rows, train(first, every, 0.5))
    return train(first + second, every, class_prior(counts[1], counts[0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs and, as the last, ``quality_score`` (with as many underlines after it as a clash asks for)."""
    names = docs.columns
    column, taken = "quality_score", {n.lower() for n in names}
    while column in taken:
        column += "_"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            scores = [model.score(batch[at].slice(lo, 256).to_pylist()) for lo in range(0, batch.num_rows, 256)]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate([np.zeros(0), *scores]))], [*names, column])

    return in_batches(docs, scored, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def op2_pu_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
