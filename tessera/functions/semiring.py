"""Scalar operations and folds: pairs of them make semirings for products, element-wise operations and combiners.

Some depend on the type of the values: longs are divided with truncation and raised to powers by truncating the double
result, decimals keep the scale of the left value (half up), products of longs and decimals are exact. ``binary`` and
``fold`` take the type; without one values are doubles. Longs that overflow are an error, as everywhere in Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType

Binary = Callable[[Column, Column], Column]
Fold = Callable[[Column], Column]


def _wide(kind: DecimalType) -> DecimalType:
    return DecimalType(38, kind.scale)


def _divide(kind: DataType | None) -> Binary:
    if isinstance(kind, IntegralType):
        return lambda a, b: F.when(b != 0, F.call_function("div", a, b))
    if isinstance(kind, DecimalType):
        return lambda a, b: F.round(F.try_divide(a, b), kind.scale).cast(_wide(kind))
    return F.try_divide


def _power(kind: DataType | None) -> Binary:
    if isinstance(kind, IntegralType):
        return lambda a, b: F.pow(a, b).cast("long")
    if isinstance(kind, DecimalType):
        wide = _wide(kind)
        return lambda a, b: F.aggregate(F.array_repeat(a, b.cast("int")), F.lit(1).cast(wide), lambda x, y: (x * y).cast(wide))
    return F.pow


def _product(kind: DataType | None) -> Fold:
    if isinstance(kind, IntegralType | DecimalType):
        exact = _wide(kind) if isinstance(kind, DecimalType) else "long"
        # ones change nothing and need not be gathered; of longs beyond them 63 are an overflow at the latest
        some = lambda v: F.collect_list(F.when(v != 1, v))
        return lambda v: F.aggregate(some(v), F.lit(1).cast(exact), lambda x, y: (x * y).cast(exact))
    return F.product


#: Two values to one. divide is the quotient of the values' type, divide_real the real one.
BINARY: dict[str, Binary] = {
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "times": lambda a, b: a * b,
    "divide_real": F.try_divide,
    "min": F.least,
    "max": F.greatest,
    "left": lambda a, b: a,
    "right": lambda a, b: b,
    "pair": lambda a, b: F.lit(1).cast("long"),
}
TYPED: dict[str, Callable[[DataType | None], Binary]] = {"divide": _divide, "power": _power}
#: Operations whose results are not dropped where they are zero.
VERBATIM = {"left"}
#: Many values to one.
FOLD: dict[str, Fold] = {"plus": F.sum, "min": F.min, "max": F.max, "any": F.max, "count": lambda v: F.count(F.lit(1))}


def binary(op: str | Binary, kind: DataType | None = None) -> Binary:
    """The operation on a left value of a type; integral ``kind`` with a fractional right value counts as double."""
    if not isinstance(op, str):
        return op
    return TYPED[op](kind) if op in TYPED else BINARY[op]


def fold(op: str | Fold, kind: DataType | None = None) -> Fold:
    if not isinstance(op, str):
        return op
    return _product(kind) if op == "times" else FOLD[op]
