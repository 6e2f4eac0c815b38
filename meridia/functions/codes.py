"""Numbers as stored: rounding, codes, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.functions.cal import col

#: Heights under SHELF metres are coded in steps of DEEP metres.
SHELF, DEEP = -200, 4


def away(x: Column | str) -> Column:
    """Nearest whole number, halves away from zero."""
    a = F.abs(col(x))
    whole = F.floor(a)
    return (F.when(a - whole >= 0.5, whole + 1).otherwise(whole) * F.signum(col(x))).cast("long")


def height_code(h: Column | str) -> Column:
    """Whole metres down to SHELF, then steps of DEEP metres."""
    h = col(h)
    return F.when(h >= SHELF, away(h)).otherwise(SHELF + away((h - SHELF) / DEEP))


def code_height(code: Column | str) -> Column:
    c = col(code)
    return F.when(c >= SHELF, c.cast("double")).otherwise(SHELF + (c - SHELF) * float(DEEP))


def distance_byte(d: Column | str, per: int = 4) -> Column:
    """A signed distance in quarters, 128 at zero, within a byte."""
    return F.least(F.lit(255), F.greatest(F.lit(0), 128 + away(col(d) * per))).cast("int")


def fixed_point(x: Column | str, places: int) -> Column:
    """A number times ten to the places, halves to even."""
    return F.rint(col(x) * float(10**places)).cast("long")


def digits(x: Column | str, n: int) -> Column:
    """A positive number to n significant digits; 0 for others."""
    x = col(x)
    scale = F.pow(F.lit(10.0), F.floor(F.log10(x)) - (n - 1))
    return F.when(x > 0, F.rint(x / scale) * scale).otherwise(0.0)


def flags(*conditions: Column) -> Column:
    """Bit i is set where condition i holds."""
    out = F.lit(0)
    for i, c in enumerate(conditions):
        out = out.bitwiseOR(F.when(c, 1 << i).otherwise(0))
    return out


def coastal(h: Column | str, shore: Column | str, least: float = 1.0) -> Column:
    """Heights clear of the shore kept on their side of the sea: land (distance >= 1) above, water below."""
    h, d = col(h), col(shore)
    return F.when(d >= 1, F.greatest(h, F.lit(least))).when(d <= -1, F.least(h, F.lit(-least))).otherwise(h)
