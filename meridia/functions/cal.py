"""Calendars as Column expressions.

A day number counts whole days since 0001-01-01 of the proleptic Gregorian calendar;
years are astronomical (0 is 1 BCE). All are BIGINT, as dates reach far beyond DATE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First day of the Gregorian calendar, 1582-10-15, and the last Julian day before it.
REFORM = 577735
YEAR, MONTH, DAY = 9, 10, 11
MONTHS = "January February March April May June July August September October November December".split()


def col(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def floor_div(a: Column, b: int) -> Column:
    """Whole quotient toward minus infinity."""
    return F.floor(a / F.lit(b)).cast("long")


def _month(y: Column, m: Column, base: int, cycle: int) -> Column:
    """The first of a month as a DATE in the years from `base` that repeat as `cycle` years do."""
    return F.make_date((F.lit(base) + F.pmod(y, F.lit(cycle))).cast("int"), m.cast("int"), F.lit(1))


def gregorian_day(y: Column | str, m: Column | str, d: Column | str) -> Column:
    """Day number of a Gregorian date of any year."""
    y, m, d = col(y).cast("long"), col(m), col(d)
    return F.unix_date(_month(y, m, 2000, 400)) + d - 1 + 719162 + 146097 * (floor_div(y, 400) - 5)


def gregorian_month_end(y: Column | str, m: Column | str) -> Column:
    """Day number of the last day of a Gregorian month."""
    y = col(y).cast("long")
    return F.unix_date(F.last_day(_month(y, col(m), 2000, 400))) + 719162 + 146097 * (floor_div(y, 400) - 5)


def julian_day(y: Column | str, m: Column | str, d: Column | str) -> Column:
    """Day number of a Julian date of any year; 1901 to 1904 have its months."""
    y, m, d = col(y).cast("long") - 1, col(m), col(d)
    return F.datediff(_month(y, m, 1901, 4), F.lit("1901-01-01").cast("date")) + d - 1 - 2 + 1461 * floor_div(y, 4)


def gregorian_civil(day: Column | str) -> Column:
    """struct(y, m, d) of a day number in the Gregorian calendar, which repeats every 146,097 days."""
    n = col(day).cast("long")
    t = F.date_add(F.lit("0001-01-01").cast("date"), F.pmod(n, F.lit(146097)).cast("int"))
    return F.struct((F.year(t) + 400 * floor_div(n, 146097)).cast("long").alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("d"))


def julian_civil(day: Column | str) -> Column:
    """struct(y, m, d) of a day number in the Julian calendar, which repeats every 1,461 days as 1901 to 1904 do."""
    n = col(day).cast("long") + 2
    t = F.date_add(F.lit("1901-01-01").cast("date"), F.pmod(n, F.lit(1461)).cast("int"))
    return F.struct((F.year(t) - 1900 + 4 * floor_div(n, 1461)).cast("long").alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("d"))


def historical_day(y: Column | str, m: Column | str, d: Column | str) -> Column:
    """Day number of a date as written then: Julian before 1582-10-15, Gregorian from it; null in the ten days left out."""
    written = (col(y).cast("long") * 100 + col(m)) * 100 + col(d)
    return F.when(written >= 15821015, gregorian_day(y, m, d)).when(written <= 15821004, julian_day(y, m, d))


def historical_civil(day: Column | str) -> Column:
    """struct(y, m, d) of a day number as written then."""
    return F.when(col(day) >= REFORM, gregorian_civil(day)).otherwise(julian_civil(day))


def month_length(y: Column | str, m: Column | str) -> Column:
    """Days of a Gregorian month."""
    y, m = col(y), col(m)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def first_day(y: Column | str, m: Column | str, d: Column | str, precision: Column | str) -> Column:
    """First day that a date as written then names at a precision (9 year, 10 month, 11 day); null in the days that the reform left out."""
    p = col(precision)
    return historical_day(y, F.when(p <= YEAR, 1).otherwise(col(m)), F.when(p <= MONTH, 1).otherwise(col(d)))


def last_day(y: Column | str, m: Column | str, d: Column | str, precision: Column | str) -> Column:
    """Last day that a date as written then names at a precision: the day before the next year or month begins."""
    p, y, m = col(precision), col(y).cast("long"), col(m)
    after = historical_day(y + F.when((p <= YEAR) | (m == 12), 1).otherwise(0), F.when((p <= YEAR) | (m == 12), 1).otherwise(m + 1), F.lit(1)) - 1
    return F.when(p > MONTH, historical_day(y, m, d)).otherwise(after)


def with_period(df: DataFrame, y: str, m: str, d: str, precision: str, first: str, last: str, exact: Callable[..., Column] = historical_day) -> DataFrame:
    """df with first and last, the days that a date names: a day by `exact`, a month or a year as written then.

    Where the period and the one after it begin is worked out in a projection of its own, so that what is generated for the days stays small.
    """
    p, year = F.col(precision), F.col(precision) <= YEAR
    turn = year | (F.col(m) == 12)
    begins = df.select("*", F.when(year, 1).otherwise(F.col(m)).alias("_m0"), (F.col(y).cast("long") + F.when(turn, 1).otherwise(0)).alias("_y1"), F.when(turn, 1).otherwise(F.col(m) + 1).alias("_m1"))
    days = begins.select("*", F.when(p > MONTH, exact(y, m, d)).alias("_day"), F.when(p <= MONTH, historical_day(y, "_m0", 1)).alias("_first"), F.when(p <= MONTH, historical_day("_y1", "_m1", 1)).alias("_next"))
    return days.select(*df.columns, F.coalesce("_day", "_first").alias(first), F.coalesce("_day", F.col("_next") - 1).alias(last))


def astronomical(y: Column | str) -> Column:
    """A source's year without a year zero."""
    return F.when(col(y) < 0, col(y) + 1).otherwise(col(y))


def iso(date: Column) -> Column:
    """Signed ISO form of struct(y, m, d)."""
    y = F.abs(date["y"]).cast("string")
    return F.concat(F.when(date["y"] < 0, "-").otherwise(""), F.when(F.length(y) < 4, F.lpad(y, 4, "0")).otherwise(y), F.lit("-"), F.lpad(date["m"].cast("string"), 2, "0"), F.lit("-"), F.lpad(date["d"].cast("string"), 2, "0"))


def spoken(date: Column, precision: Column | str) -> Column:
    """'15 March 44 BCE', 'March 44 BCE' or '44 BCE'."""
    year = F.when(date["y"] <= 0, F.concat((1 - date["y"]).cast("string"), F.lit(" BCE"))).otherwise(date["y"].cast("string"))
    month = F.element_at(F.array(*map(F.lit, MONTHS)), date["m"])
    p = col(precision)
    return F.when(p <= YEAR, year).when(p == MONTH, F.concat_ws(" ", month, year)).otherwise(F.concat_ws(" ", date["d"].cast("string"), month, year))


def spoken_span(first: Column, last: Column, precision: Column | str) -> Column:
    """One date where both read alike, else both joined by a dash."""
    a, b = spoken(first, precision), spoken(last, precision)
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(" – "), b))


def parse_iso(text: Column | str) -> Column:
    """struct(y, m, d) of a signed ISO date, null for any other text."""
    pattern = r"^([+-]?\d{4,})-(\d{2})-(\d{2})(T.*)?$"
    part = lambda i: F.regexp_extract(col(text), pattern, i)
    made = F.struct(part(1).try_cast("long").alias("y"), part(2).try_cast("int").alias("m"), part(3).try_cast("int").alias("d"))
    return F.when(col(text).rlike(pattern) & made["m"].between(1, 12) & made["d"].between(1, 31), made)


def months_of(first: Column | str, last: Column | str) -> Column:
    """First days of the months that a span of days touches, as an array."""
    a, b = gregorian_civil(first), gregorian_civil(last)
    number = F.sequence(a["y"] * 12 + a["m"] - 1, b["y"] * 12 + b["m"] - 1)
    return F.transform(number, lambda k: gregorian_day(floor_div(k, 12), F.pmod(k, F.lit(12)) + 1, F.lit(1)))


def years_of(first: Column | str, last: Column | str, step: int = 1) -> Column:
    """The years of a span that are multiples of `step`."""
    a, b = gregorian_civil(first)["y"], gregorian_civil(last)["y"]
    low = -floor_div(-a, step)
    return F.when(low <= floor_div(b, step), F.transform(F.sequence(low, floor_div(b, step)), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))


def month_blend(day: Column | str) -> Column:
    """struct(before, after, weight): the months whose middles lie on both sides of a day, numbered y * 12 + m - 1, and how far the day is to the second."""
    d = col(day)
    date = gregorian_civil(d)
    k = date["y"] * 12 + date["m"] - 1
    middle = lambda n: gregorian_day(floor_div(n, 12), F.pmod(n, F.lit(12)) + 1, F.lit(1)) + month_length(floor_div(n, 12), F.pmod(n, F.lit(12)) + 1) / 2
    around = F.transform(F.array(k - 1, k, k + 1), lambda n: F.struct(n.alias("n"), middle(n).alias("mid")))
    pair = F.filter(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.struct(F.get(around, i).alias("a"), F.get(around, i + 1).alias("b"))), lambda p: (p["a"]["mid"] <= d) & (d < p["b"]["mid"]))
    return F.element_at(F.transform(pair, lambda p: F.struct(p["a"]["n"].alias("before"), p["b"]["n"].alias("after"), ((d - p["a"]["mid"]) / (p["b"]["mid"] - p["a"]["mid"])).alias("weight"))), 1)


def year_marks(first: Column | str, last: Column | str, step: int, civil: Callable[..., Column] = gregorian_civil, day: Callable[..., Column] = gregorian_day) -> Column:
    """Array of struct(year, start, end) of the marks of every `step` years that a span of days touches; `end` is the day on which the next begins.

    Marks align with historical multiples: before the era's seam they lie `step` apart from 1 CE on (1000 BCE is -999), then come
    1 CE and the multiples of `step`. Null days give null.
    """
    a, b = civil(first)["y"], civil(last)["y"]
    if step == 1:
        number, year = (lambda y: y), (lambda k: k)
    else:
        number = lambda y: F.when(y <= 0, floor_div(y - 1, step)).otherwise(floor_div(y, step))
        year = lambda k: F.when(k <= 0, 1 + k * step).otherwise(k * step)
    mark = lambda k: F.struct(year(k).cast("long").alias("year"), day(year(k), F.lit(1), F.lit(1)).cast("long").alias("start"), day(year(k + 1), F.lit(1), F.lit(1)).cast("long").alias("end"))
    return F.transform(F.sequence(number(a).cast("long"), number(b).cast("long")), mark)


def month_marks(first: Column | str, last: Column | str, step: int, civil: Callable[..., Column] = gregorian_civil, day: Callable[..., Column] = gregorian_day) -> Column:
    """Array of struct(year, month, start, end) of every `step` months, aligned to January, that begin before the day `last` and end after `first`."""
    at = lambda d: floor_div(civil(d)["y"] * 12 + civil(d)["m"] - 1, step) * step
    a, b = at(first), at(col(last) - 1)
    part = lambda n: (floor_div(n, 12), F.pmod(n, F.lit(12)) + 1)
    start = lambda n: day(part(n)[0], part(n)[1], F.lit(1)).cast("long")
    mark = lambda n: F.struct(part(n)[0].cast("long").alias("year"), part(n)[1].cast("int").alias("month"), start(n).alias("start"), start(n + step).alias("end"))
    none = F.array().cast("array<struct<year:bigint,month:int,start:bigint,end:bigint>>")
    return F.when(b < a, none).otherwise(F.transform(F.sequence(a, F.greatest(a, b), F.lit(step).cast("long")), mark))
