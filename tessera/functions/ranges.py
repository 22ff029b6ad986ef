"""Range strings: sets of key ranges in one string whose last character separates its items.

``a,:,b,`` is the closed range from a to b, ``:,b,`` and ``a,:,`` are open to one side, a lone item is itself, ``:,`` is
everything and an empty string nothing.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Range(NamedTuple):
    low: str | None
    high: str | None


def parse(text: str | None) -> list[Range]:
    """Sorted ranges; None means everything."""
    if text is None:
        return [Range(None, None)]
    if not text:
        return []
    items = text[:-1].split(text[-1])
    out, k = [], 0
    while k < len(items):
        if items[k] == ":":
            if k + 1 < len(items) and items[k + 1] == ":":
                raise ValueError(f"two colons in a row: {text!r}")
            out.append(Range(None, items[k + 1] if k + 1 < len(items) else None))
            k += 2
        elif k + 1 < len(items) and items[k + 1] == ":":
            if k + 2 < len(items) and items[k + 2] == ":":
                raise ValueError(f"two colons in a row: {text!r}")
            out.append(Range(items[k], items[k + 2] if k + 2 < len(items) else None))
            k += 3
        else:
            out.append(Range(items[k], items[k]))
            k += 1
    for low, high in out:
        if low is not None and high is not None and low > high:
            raise ValueError(f"range from {low!r} to {high!r}")
    return sorted(set(out), key=lambda r: (r.low is not None, r.low or "", r.high is None, r.high or ""))


def merge(ranges: list[Range]) -> list[Range]:
    """The same keys in ranges that don't overlap."""
    out: list[Range] = []
    for low, high in ranges:
        if out and (out[-1].high is None or low is None or low <= out[-1].high):
            last = out.pop()
            out.append(Range(last.low, None if last.high is None or high is None else max(last.high, high)))
        else:
            out.append(Range(low, high))
    return out


def unparse(ranges: list[Range], separator: str = ",") -> str:
    items: list[str] = []
    for low, high in ranges:
        items += [low] if low is not None and low == high else [x for x in (low, ":", high) if x is not None]
    return "".join(x + separator for x in items)


def matches(column: Column, text: str | None) -> Column:
    """Predicate of plain comparisons, so that scans can take it over. None and '' let everything pass."""
    if not text:
        return F.lit(True)
    exact, tests = [], []
    for low, high in merge(parse(text)):
        if low is not None and low == high:
            exact.append(low)
        else:
            tests.append(reduce(Column.__and__, [*([column >= low] if low is not None else []), *([column <= high] if high is not None else [])] or [F.lit(True)]))
    return reduce(Column.__or__, [*([column.isin(exact)] if exact else []), *tests])


def lookup(column: Column, text: str | None) -> Column:
    """Predicate of a lookup list: keys, prefixes ``a*`` and ranges ``a,:,b,`` in any mixture.

    In a list of three items ``a,:,b,`` a last one that contains "end" leaves the range open above, an empty first one
    open below. ``:``, an empty string and None are everything.
    """
    items = text[:-1].split(text[-1]) if text and text != ":" else [":"]
    if items == [":"]:
        return F.lit(True)
    if len(items) == 3 and items[1] == ":" and "end" in items[2]:
        items = items[:2]
    tests, exact, k = [], [], 0
    while k < len(items):
        if items[k] != ":" and items[k + 1 : k + 2] != [":"]:
            if items[k].endswith("*"):
                tests.append(F.startswith(column, F.lit(items[k][:-1])))
            else:
                exact.append(items[k])
            k += 1
            continue
        low, k = ("", k + 1) if items[k] == ":" else (items[k], k + 2)
        high, k = items[k] if k < len(items) else "", k + 1
        if high == ":" or low and high and low > high:
            raise ValueError(f"malformed range in {text!r}")
        sides = [*([column >= low] if low else []), *([column <= high] if high else [])]
        tests.append(reduce(Column.__and__, sides or [F.lit(True)]))
    return reduce(Column.__or__, [*([column.isin(exact)] if exact else []), *tests])


def prefixed(text: str, prefix: str) -> str:
    """The range string with a prefix before every key."""
    if not text:
        return text
    return "".join(x + text[-1] for x in (i if i == ":" else prefix + i for i in text[:-1].split(text[-1])))


def prefix_range(prefix: str) -> Range:
    """All keys that begin with the prefix, up to the last code point."""
    return Range(prefix, prefix + "\U0010ffff")


def count_items(text: str) -> int:
    return len(text[:-1].split(text[-1])) if text else 0


def has_range(text: str) -> bool:
    return bool(text) and ":" in text[:-1].split(text[-1])


def after_prefix(column: Column, prefix: str) -> Column:
    """What follows the prefix; null where it isn't there."""
    return F.when(F.startswith(column, F.lit(prefix)), F.substr(column, F.lit(len(prefix) + 1)))
