"""Calendar functions on the dates of orders, lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import cal
from meridia.plans import bind
from meridia.plans.event_queries import month_start
from meridia.registry import query

#: Day numbers from 600 BCE to 2300, one per order.
DAYS = "SELECT o_orderkey AS k, CAST(o_orderkey * 7919 % 1060000 - 219000 AS BIGINT) AS day, CAST(9 + o_orderkey % 3 AS INT) AS prec, o_orderkey * 31 % 900 AS more FROM {orders}"
_CIVIL = "CAST(year(DATE '0001-01-01' + CAST({0} AS INT)) AS BIGINT) AS {1}y, CAST(month(DATE '0001-01-01' + CAST({0} AS INT)) AS INT) AS {1}m, CAST(day(DATE '0001-01-01' + CAST({0} AS INT)) AS INT) AS {1}d"
# Julian dates by years and months: a year's number is sought next to the mean, a month is the last that begins by the day.
_JANUARY = "(365 * ({0} - 1) + CAST(floor(({0} - 1) / 4.0) AS BIGINT) - 2)"
_JULIAN = f"""j AS (SELECT *, CAST(floor((day + 2) / 365.25) AS BIGINT) AS near FROM days_),
j2 AS (SELECT * EXCLUDE (near), list_max(list_filter([near, near + 1, near + 2], lambda y: {_JANUARY.format("y")} <= day)) AS jy FROM j),
j3 AS (SELECT *, CAST(day - {_JANUARY.format("jy")} AS INT) AS r, CASE WHEN jy % 4 = 0 THEN [0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335] ELSE [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334] END AS starts FROM j2),
jul AS (SELECT *, CAST(len(list_filter(starts, lambda x: x <= r)) AS INT) AS jm, CAST(r - list_max(list_filter(starts, lambda x: x <= r)) + 1 AS INT) AS jd FROM j3)"""


@query(
    "SC4 SC5 SC6",
    f"""WITH days_ AS ({bind.duck(DAYS)}), g AS (SELECT k, {_CIVIL.format("day", "g")} FROM days_), {_JULIAN}
SELECT k, gy, gm, gd, jy, jm, jd, CASE WHEN day >= 577735 THEN gy ELSE jy END AS hy, CASE WHEN day >= 577735 THEN gm ELSE jm END AS hm, CASE WHEN day >= 577735 THEN gd ELSE jd END AS hd,
  day AS g_back, day AS j_back, day AS h_back FROM g JOIN jul USING (k)""",
)
def sc_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day numbers to Gregorian, Julian and historical dates, and back."""
    rows = bind.frame(spark, sf_dir, DAYS)
    of = rows.select("k", cal.gregorian_civil("day").alias("g"), cal.julian_civil("day").alias("j"), cal.historical_civil("day").alias("h"))
    parts = [of[c][p].alias(c + p) for c in "gjh" for p in "ymd"]
    back = [f(*(of[c][p] for p in "ymd")).alias(f"{c}_back") for c, f in (("g", cal.gregorian_day), ("j", cal.julian_day), ("h", cal.historical_day))]
    return of.select("k", *parts, *back)


@query(
    "SC7 SC8 SC29",
    f"""WITH days_ AS ({bind.duck(DAYS)}), g AS (SELECT k, {_CIVIL.format("day", "g")} FROM days_), {_JULIAN},
h AS (SELECT jul.k, day, prec, gy, gm, CASE WHEN day >= 577735 THEN gy ELSE jy END AS y, CASE WHEN day >= 577735 THEN gm ELSE jm END AS m FROM jul JOIN g USING (k))
SELECT k, CASE prec WHEN 9 THEN {month_start("y", "1")} WHEN 10 THEN {month_start("y", "m")} ELSE day END AS first_day,
  CASE prec WHEN 9 THEN ({month_start("(y + 1)", "1")}) - 1 WHEN 10 THEN ({month_start("(y + m // 12)", "(m % 12 + 1)")}) - 1 ELSE day END AS last_day,
  CAST(day(last_day(make_date(gy, gm, 1))) AS INT) AS month_days, prec < 11 AS soft FROM h""",
)
def sc_precision_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that a date as written then names at its precision, its Gregorian month's length, and whether it is soft."""
    of = bind.frame(spark, sf_dir, DAYS).withColumn("h", cal.historical_civil("day")).withColumn("g", cal.gregorian_civil("day"))
    date = (of["h"]["y"], of["h"]["m"], of["h"]["d"])
    return of.select("k", cal.first_day(*date, "prec").alias("first_day"), cal.last_day(*date, "prec").alias("last_day"), cal.month_length(of["g"]["y"], of["g"]["m"]).alias("month_days"), (F.col("prec") < cal.DAY).alias("soft"))


_SPOKEN = "CASE {p} WHEN 9 THEN {y} WHEN 10 THEN monthname({t}) || ' ' || {y} ELSE day({t}) || ' ' || monthname({t}) || ' ' || {y} END"
_YEAR = "CASE WHEN year({t}) <= 0 THEN (1 - year({t})) || ' BCE' ELSE CAST(year({t}) AS VARCHAR) END"


def _said(t: str) -> str:
    return _SPOKEN.format(p="prec", t=t, y=_YEAR.format(t=t))


@query(
    "SC9 SC3 SC10",
    f"""WITH days_ AS ({bind.duck(DAYS)}), g AS (SELECT *, DATE '0001-01-01' + CAST(day AS INT) AS t, DATE '0001-01-01' + CAST(day + more AS INT) AS u FROM days_)
SELECT k, CASE WHEN year(t) < 0 THEN '-' ELSE '' END || lpad(CAST(abs(year(t)) AS VARCHAR), 4, '0') || '-' || lpad(CAST(month(t) AS VARCHAR), 2, '0') || '-' || lpad(CAST(day(t) AS VARCHAR), 2, '0') AS iso,
  {_said("t")} AS said, CASE WHEN {_said("t")} = {_said("u")} THEN {_said("t")} ELSE {_said("t")} || ' – ' || {_said("u")} END AS span,
  CAST(year(t) AS BIGINT) AS back_year, CAST(CASE WHEN year(t) < 0 THEN year(t) + 1 ELSE year(t) END AS BIGINT) AS astronomical FROM g""",
)
def sc_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO and spoken forms of dates and spans; ISO read back; years without a year zero."""
    of = bind.frame(spark, sf_dir, DAYS).withColumn("g", cal.gregorian_civil("day")).withColumn("h", cal.gregorian_civil(F.col("day") + F.col("more")))
    of = of.withColumn("iso", cal.iso(F.col("g")))
    return of.select("k", "iso", cal.spoken(F.col("g"), "prec").alias("said"), cal.spoken_span(F.col("g"), F.col("h"), "prec").alias("span"), cal.parse_iso("iso")["y"].alias("back_year"), cal.astronomical(of["g"]["y"]).alias("astronomical"))


@query(
    "SC22",
    f"""WITH days_ AS ({bind.duck(DAYS)}), g AS (SELECT k, DATE '0001-01-01' + CAST(day AS INT) AS t, DATE '0001-01-01' + CAST(day + more AS INT) AS u FROM days_)
SELECT k, 'month' AS kind, CAST(date_diff('day', DATE '0001-01-01', CAST(m AS DATE)) AS BIGINT) AS mark FROM (SELECT k, unnest(generate_series(CAST(date_trunc('month', t) AS TIMESTAMP), CAST(u AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM g)
UNION ALL SELECT k, 'year' AS kind, y * 2 AS mark FROM (SELECT k, unnest(generate_series(CAST(ceil(year(t) / 2.0) AS BIGINT), CAST(floor(year(u) / 2.0) AS BIGINT))) AS y FROM g)""",
)
def sc_spines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months and even years that a span touches."""
    rows = bind.frame(spark, sf_dir, DAYS).select("k", "day", (F.col("day") + F.col("more")).alias("last"))
    months = rows.select("k", F.lit("month").alias("kind"), F.explode(cal.months_of("day", "last")).alias("mark"))
    return months.unionByName(rows.select("k", F.lit("year").alias("kind"), F.explode(cal.years_of("day", "last", 2)).alias("mark")))


# Spans of up to some centuries around the era's seam.
_SEAM = "SELECT o_orderkey AS k, CAST(o_orderkey * 7919 % 900000 - 500000 AS BIGINT) AS first, CAST(o_orderkey * 7919 % 900000 - 500000 + o_orderkey * 31 % 90000 AS BIGINT) AS last FROM {orders}"


@query("SC22", f"""{bind.ctes(s=_SEAM)}, y AS (SELECT *, CAST(year(DATE '0001-01-01' + CAST(first AS INT)) AS BIGINT) AS a, CAST(year(DATE '0001-01-01' + CAST(last AS INT)) AS BIGINT) AS b FROM s),
n AS (SELECT unnest(range(-3000, 3000)) AS year), g AS (SELECT year, lead(year) OVER (ORDER BY year) AS next FROM n WHERE (year <= 1 AND (1 - year) % 100 = 0) OR (year > 1 AND year % 100 = 0))
SELECT k, year, CAST(date_diff('day', DATE '0001-01-01', make_date(year, 1, 1)) AS BIGINT) AS start, CAST(date_diff('day', DATE '0001-01-01', make_date(next, 1, 1)) AS BIGINT) AS "end" FROM y JOIN g ON year <= b AND next > a""")
def sc_year_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centuries that spans touch, over the era's seam."""
    rows = bind.frame(spark, sf_dir, _SEAM)
    return rows.select("k", F.explode(cal.year_marks("first", "last", 100)).alias("m")).select("k", "m.*")


@query(
    "SC23",
    f"""WITH days_ AS ({bind.duck(DAYS)}), g AS (SELECT k, day, CAST(date_trunc('month', DATE '0001-01-01' + CAST(day AS INT)) AS DATE) AS t FROM days_),
m AS (SELECT k, day, unnest([t - INTERVAL 1 MONTH, t, t + INTERVAL 1 MONTH]) AS s FROM g),
n AS (SELECT k, day, year(s) * 12 + month(s) - 1 AS month, date_diff('day', DATE '0001-01-01', CAST(s AS DATE)) + day(last_day(s)) / 2 AS mid FROM m),
p AS (SELECT k, day, month, mid, lead(mid) OVER (PARTITION BY k ORDER BY month) AS next FROM n)
SELECT k, CAST(month AS BIGINT) AS before, CAST(month + 1 AS BIGINT) AS after, round((day - mid) / (next - mid), 9) AS weight FROM p WHERE day >= mid AND day < next""",
)
def sc_month_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two months around a day and the weight of the second."""
    of = bind.frame(spark, sf_dir, DAYS).select("k", cal.month_blend("day").alias("b"))
    return of.select("k", "b.before", "b.after", F.round("b.weight", 9).alias("weight"))
