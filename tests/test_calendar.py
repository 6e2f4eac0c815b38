"""Day numbers and dates."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from meridia.functions import cal, codes, text

CASES = [(1, 1, 1, 0), (1582, 10, 15, 577735), (-15_000_000, 1, 1, -5478637866), (2000, 2, 29, 730178), (0, 12, 31, -1)]


@pytest.mark.parametrize(("y", "m", "d", "day"), CASES)
def test_gregorian_both_ways(spark, y, m, d, day):
    row = spark.createDataFrame([(y, m, d, day)], "y long, m int, d int, day long").select(cal.gregorian_day("y", "m", "d").alias("n"), cal.gregorian_civil("day").alias("c")).first()
    assert row["n"] == day
    assert tuple(row["c"]) == (y, m, d)


def test_historical_dates_leave_ten_days_out(spark):
    rows = spark.createDataFrame([(1582, 10, d) for d in (4, 5, 14, 15)], "y long, m int, d int").select("d", cal.historical_day("y", "m", "d").alias("n")).collect()
    assert [(r["d"], r["n"]) for r in rows] == [(4, 577734), (5, None), (14, None), (15, 577735)]


def test_julian_round_trip(spark):
    rows = spark.range(-800_000, 800_000, 997).select("id", cal.julian_civil("id").alias("c"))
    bad = rows.where(cal.julian_day("c.y", "c.m", "c.d") != F.col("id")).count()
    assert bad == 0
    assert tuple(spark.range(1).select(cal.julian_civil(F.lit(-2)).alias("c")).first()["c"]) == (1, 1, 1)


def test_spans_follow_precision(spark):
    day = lambda *x: (datetime.date(*x) - datetime.date(1, 1, 1)).days
    rows = spark.createDataFrame([(1900, 2, 5, p) for p in (9, 10, 11)], "y long, m int, d int, p int").select(cal.first_day("y", "m", "d", "p").alias("a"), cal.last_day("y", "m", "d", "p").alias("b")).collect()
    assert [tuple(r) for r in rows] == [(day(1900, 1, 1), day(1900, 12, 31)), (day(1900, 2, 1), day(1900, 2, 28)), (day(1900, 2, 5), day(1900, 2, 5))]


def test_spoken_dates(spark):
    row = spark.createDataFrame([(-43, 3, 15)], "y long, m int, d int").select(cal.spoken(F.struct("y", "m", "d"), F.lit(11)).alias("s"), cal.iso(F.struct("y", "m", "d")).alias("i")).first()
    assert tuple(row) == ("15 March 44 BCE", "-0043-03-15")


def test_rounding_away_from_zero_and_terms(spark):
    xs = [2.5, -2.5, 0.49999999999999994, -0.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(codes.away("x")).collect()]
    assert got == [3, -3, 0, -1]
    row = spark.createDataFrame([('"a\\u00e9 \\"b\\""@fr', "<http://x/Q5>")], "a string, b string").select(text.decode_term("a").alias("a"), text.decode_term("b").alias("b")).first()
    assert tuple(row) == ('aé "b"', "Q5")


def marks_in_order(first, last, step):
    """The same by walking from mark to mark."""
    day = lambda y, m: 365 * (y - 1) + (y - 1) // 4 - (y - 1) // 100 + (y - 1) // 400 + sum((31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[: m - 1])
    y = first // 366
    while day(y + 1, 1) <= first:
        y += 1
    m = max(k for k in range(1, 13) if day(y, k) <= first)
    at = y if step == 1 else 1 - -(-(1 - y) // step) * step if y <= 0 else max(1, y // step * step)
    years = []
    while day(at, 1) <= last:
        after = at + 1 if step == 1 else min(1, at + step) if at <= 0 else step if at == 1 else at + step
        years.append((at, day(at, 1), day(after, 1)))
        at = after
    n, months = (y * 12 + m - 1) // step * step, []
    while day(n // 12, n % 12 + 1) < last:
        months.append((n // 12, n % 12 + 1, day(n // 12, n % 12 + 1), day((n + step) // 12, (n + step) % 12 + 1)))
        n += step
    return years, months


def test_marks_over_the_seam_of_the_era(spark):
    import random

    r = random.Random(22)
    spans = [(k, a, a + r.choice([0, 1, 40, 400, 4000])) for k, a in enumerate([0, -1, -366, 365, -367, *[r.randint(-9000, 9000) for _ in range(60)]])]
    df = spark.createDataFrame(spans, "k int, a long, b long")
    for step in (1, 2, 3, 5, 12, 100):
        got = df.select("k", cal.year_marks("a", "b", step).alias("y"), cal.month_marks("a", "b", step).alias("m")).collect()
        for x in got:
            _, a, b = spans[x["k"]]
            assert ([tuple(t) for t in x["y"]], [tuple(t) for t in x["m"]]) == marks_in_order(a, b, step), (a, b, step)
