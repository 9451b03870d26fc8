"""Column functions of the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def high16(v: Column | str) -> Column:
    return F.shiftright(_c(v), 16)


def low16(v: Column | str) -> Column:
    return _c(v).bitwiseAND(F.lit(65535).cast("bigint"))


def join16(high: Column | str, low: Column | str) -> Column:
    return F.shiftleft(_c(high), 16).bitwiseOR(_c(low))


def bucket_low(high: Column | str) -> Column:
    """The smallest value with this high half."""
    return F.shiftleft(_c(high), 16)


def bucket_high(high: Column | str) -> Column:
    return F.shiftleft(_c(high), 16).bitwiseOR(F.lit(65535).cast("bigint"))


def floor_div(a: Column, b: Column) -> Column:
    """Whole quotient, rounded down; b above 0. Exact, unlike a double's."""
    return F.call_function("div", a - F.pmod(a, b), b)


def ceil_div(a: Column, b: Column) -> Column:
    return -floor_div(-a, b)


def weighted_score(x: Column | str, y: Column | str, w: Column | str, scale: int = 200) -> Column:
    """w x + (scale - w) y for a whole weight of 0..scale; lower is better."""
    return _c(w) * _c(x) + (F.lit(scale) - _c(w)) * _c(y)


def payload_ms(rows: Column | str, row_bytes: Column | str, gbit: Column | str) -> Column:
    """Milliseconds that the payload takes at a bandwidth."""
    return _c(rows) * _c(row_bytes) * 8 / (_c(gbit) * 1e9) * 1000


def nearest_rank(values: Column | str, p: float) -> Column:
    """The value at rank round((n - 1) p) of a collected array; null if it is empty."""
    values = _c(values)
    at = F.floor((F.size(values) - 1) * F.lit(p) + F.lit(0.5)).cast("int")
    return F.when(F.size(values) > 0, F.get(F.sort_array(values), at))


def ns_per_op(ns: Column | str, ops: Column | str) -> Column:
    return F.when(_c(ops) > 0, _c(ns).cast("double") / _c(ops))


def format_ns(ns: Column | str) -> Column:
    x = _c(ns).cast("double")
    said = lambda scale, unit: F.concat(F.format_string("%.3f", x / scale), F.lit(unit))
    return F.when(x >= 1e9, said(1e9, " s")).when(x >= 1e6, said(1e6, " ms")).when(x >= 1e3, said(1e3, " µs")).otherwise(F.concat(F.format_string("%.0f", x), F.lit(" ns")))


def ratio_text(a: Column | str, b: Column | str) -> Column:
    """How a compares with b."""
    r = _c(a).cast("double") / _c(b)
    return F.when(_c(b) == 0, "n/a").when(r >= 1, F.concat(F.format_string("%.2f", r), F.lit(" times slower"))).otherwise(F.concat(F.format_string("%.2f", 1 / r), F.lit(" times faster")))
