"""Violation predicates as column expressions.

Arithmetic is that of fixed-width two's-complement integers. Widths and signs are those of the operand, never of the
result. A predicate over a null operand is null: a value that can't be modelled raises nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wide(x: Column) -> Column:
    """Exact for every 64-bit pattern, signed or unsigned."""
    return x.cast("decimal(38,0)")


def _lit(v: int) -> Column:
    return F.lit(str(v)).cast("decimal(38,0)")


def index_violation(index: Column, length: Column) -> Column:
    return (index < 0) | (index >= length)


def slice_violation(low: Column | None, high: Column | None, top: Column | None, length: Column, cap: Column) -> Column:
    """x[low:high:top]; an absent low is 0, an absent high the length."""
    lo = F.coalesce(low, F.lit(0)) if low is not None else F.lit(0)
    hi = F.coalesce(high, length) if high is not None else length
    bad = (lo < 0) | (hi < lo) | (hi > cap)
    return bad if top is None else bad | F.coalesce(top > cap, F.lit(False))


def div_zero(divisor: Column) -> Column:
    return divisor == 0


def div_overflow(dividend: Column, divisor: Column, bits: int, op: str = "Div", signed: bool = True) -> Column:
    """The one quotient that doesn't fit: MIN / -1. A remainder never overflows, nor does unsigned division."""
    if op != "Div" or not signed:
        return F.lit(False)
    return (_wide(dividend) == _lit(-(1 << (bits - 1)))) & (divisor == -1)


def converts(ws: int, ss: bool, wd: int, sd: bool) -> bool:
    """Whether a conversion can lose anything: it narrows, or changes the sign at the same width."""
    return wd < ws or (wd == ws and sd != ss)


def convert_violation(x: Column, ws: int, ss: bool, wd: int, sd: bool) -> Column:
    """Conversion from (ws bits, signed ss) to (wd, sd). x holds the value in its own sign."""
    if not converts(ws, ss, wd, sd):
        return F.lit(False)
    v = _wide(x)
    least = -(1 << (wd - 1)) if sd else 0
    most = (1 << (wd - 1)) - 1 if sd else (1 << wd) - 1
    over = v > _lit(most)
    if not ss:
        return over
    under = v < _lit(least)
    return under if not sd and wd == ws else under | over


#: Family and width of the numeric basic types.
NUMERIC = {
    "int8": ("signed", 8), "int16": ("signed", 16), "int32": ("signed", 32), "rune": ("signed", 32), "int": ("signed", 64), "int64": ("signed", 64),
    "uint8": ("unsigned", 8), "byte": ("unsigned", 8), "uint16": ("unsigned", 16), "uint32": ("unsigned", 32), "uint": ("unsigned", 64), "uint64": ("unsigned", 64),
    "uintptr": ("unsigned", 64), "float32": ("float", 32), "float64": ("float", 64),
}


def numeric(name: Column, part: int) -> Column:
    """Family (part 0) or width (part 1) of a basic type's name; null for any other."""
    table = F.create_map(*[F.lit(x) for k, v in NUMERIC.items() for x in (k, v[part])])
    return F.try_element_at(table, name)


def dirty_convert(source: Column, target: Column) -> Column:
    """Whether a conversion between basic types counts against a clean function: another family, fewer bits, or unknown."""
    return F.coalesce((numeric(source, 0) != numeric(target, 0)) | (numeric(target, 1) < numeric(source, 1)), F.lit(True))
