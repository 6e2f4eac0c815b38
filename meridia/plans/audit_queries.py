"""Audits with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import audits
from meridia.operators.joins import closure
from meridia.plans import bind
from meridia.plans.route_queries import _V, _vertices
from meridia.registry import query

_E = f"{bind.ctes(e=bind.EVENT_ROW)}"


@query("VQ1", f"""{_E}, r AS (SELECT cls AS page, qid, CASE WHEN qid % 50 = 0 THEN lon + 400 ELSE lon END AS lon, lat, t0, CASE WHEN qid % 31 = 0 THEN t0 - 1 ELSE t1 END AS t1, CASE WHEN qid % 77 = 5 THEN qid ELSE parent END AS parent, 5000 - qid + CASE WHEN qid % 100 = 7 THEN 300 ELSE 0 END AS score FROM e), w AS (SELECT *, lag(score) OVER (PARTITION BY page ORDER BY qid) AS b FROM r),
f AS (SELECT qid, CASE WHEN NOT (lon BETWEEN -180 AND 180) THEN 'place' WHEN t0 > t1 THEN 'span' WHEN parent = qid THEN 'own parent' WHEN score > b THEN 'order' END AS fault FROM w) SELECT * FROM f WHERE fault IS NOT NULL""")
def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted faults of the rows of pages, one for each class."""
    e = bind.frame(spark, sf_dir, bind.EVENT_ROW)
    rows = e.select("qid", F.col("cls").alias("page"), F.col("qid").alias("row"), F.when(F.col("qid") % 50 == 0, F.col("lon") + 400).otherwise(F.col("lon")).alias("lon"), "lat", "t0", F.when(F.col("qid") % 31 == 0, F.col("t0") - 1).otherwise(F.col("t1")).alias("t1"), F.when(F.col("qid") % 77 == 5, F.col("qid")).otherwise(F.col("parent")).alias("parent"), (5000 - F.col("qid") + F.when(F.col("qid") % 100 == 7, 300).otherwise(0)).alias("score"))
    return audits.page_faults(rows)


_LAST_DAY = 725000


@query("VQ3", f"""WITH RECURSIVE e AS ({bind.duck(bind.EVENT_ROW)}), o AS (SELECT qid * 3 AS id, 700000 + qid * 111 % 36500 AS day, qid % 13 = 0 AS placed, 'On ' || (1 + qid % 28) || ' March and May ' || (1 + qid % 9) AS line, qid % 17 AS k FROM e),
r AS (SELECT qid AS node, parent AS anc FROM e WHERE parent IS NOT NULL UNION SELECT r.node, e.parent FROM r JOIN e ON e.qid = r.anc WHERE e.parent IS NOT NULL),
d AS (SELECT *, DATE '0001-01-01' + CAST(day AS INT) AS t FROM o), l AS (SELECT *, CASE k WHEN 0 THEN 'in ' || day(t) || ' ' || monthname(t) WHEN 1 THEN line ELSE 'no date' END AS said FROM d),
f AS (SELECT l.id, CASE WHEN e.qid IS NULL THEN 'absent' WHEN NOT (l.day BETWEEN t0 AND t1 + 3000) THEN 'day' WHEN placed THEN 'place' WHEN EXISTS (SELECT 1 FROM r JOIN o x ON x.id = r.anc WHERE r.node = l.id) THEN 'part of another' WHEN t0 > {_LAST_DAY} THEN 'too late' WHEN k = 1 THEN 'line' END AS fault FROM l LEFT JOIN e ON e.qid = l.id) SELECT * FROM f WHERE fault IS NOT NULL""")
def audit_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of listed openings."""
    from meridia.functions import cal

    e = bind.frame(spark, sf_dir, bind.EVENT_ROW)
    o = e.select("qid", (F.col("qid") * 3).alias("id"), (700000 + F.col("qid") * 111 % 36500).alias("day"), (F.col("qid") % 13 == 0).alias("placed")).withColumn("c", cal.gregorian_civil("day"))
    month = F.element_at(F.array(*map(F.lit, cal.MONTHS)), F.col("c.m"))
    two = F.concat(F.lit("On "), (1 + F.col("qid") % 28).cast("string"), F.lit(" March and May "), (1 + F.col("qid") % 9).cast("string"))
    line = F.when(F.col("qid") % 17 == 0, F.concat(F.lit("in "), F.col("c.d").cast("string"), F.lit(" "), month)).when(F.col("qid") % 17 == 1, two).otherwise("no date")
    return audits.opening_faults(o.select("id", "day", "placed", line.alias("line")), e.select(F.col("qid").alias("id"), "t0", (F.col("t1") + 3000).alias("t1")), closure(bind.frame(spark, sf_dir, bind.PARENT)), _LAST_DAY)


@query("VQ4", "WITH v AS (SELECT s_suppkey % 15 AS step, count(*) AS n FROM supplier GROUP BY 1), d AS (SELECT s_suppkey % 15 AS step, count(*) AS n FROM supplier WHERE s_suppkey % 9 <> 0 GROUP BY 1), a AS (SELECT s_suppkey % 15 AS step, count(*) AS n FROM supplier WHERE s_suppkey % 27 = 0 GROUP BY 1) SELECT step, CAST(coalesce(d.n, 0) - v.n + coalesce(a.n, 0) AS BIGINT) AS off FROM v LEFT JOIN d USING (step) LEFT JOIN a USING (step) WHERE coalesce(d.n, 0) - v.n + coalesce(a.n, 0) <> 0")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose drawn names don't add up; some removals are recorded."""
    s = bind.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 15).alias("step"), "s_name", "s_suppkey")
    return audits.count_faults(s.where("s_suppkey % 9 <> 0"), s, s.where("false"), s.where("s_suppkey % 27 = 0"))


@query("VQ5 VQ7", f"""{bind.ctes(g=bind.GRID)}, b AS (SELECT j // 4 AS j, i // 4 AS i, min(sign(value - 500)) AS a, max(sign(value - 500)) AS z FROM g GROUP BY 1, 2), c AS (SELECT j // 4 AS j, i // 4 AS i, max(value) - 500 AS v FROM g GROUP BY 1, 2) SELECT count(*) AS checked, count(*) FILTER (sign(v) = a) AS agreeing FROM c JOIN b USING (j, i) WHERE a = z""")
def audit_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement in sign of a coarse with a fine layer."""
    fine = bind.frame(spark, sf_dir, bind.GRID).withColumn("value", F.col("value") - 500)
    coarse = fine.groupBy(F.floor(F.col("j") / 4).alias("j"), F.floor(F.col("i") / 4).alias("i")).agg(F.max("value").alias("value"))
    return audits.sign_agreement(coarse, fine, 4)


@query("VQ7", f"""{bind.ctes(g=bind.GRID)} SELECT a.i // 16 AS tile, a.i // 16 + 1 AS other, a.j AS at FROM g a WHERE a.i % 16 = 0 AND a.i > 0 AND a.j % 10 = 3""".replace("a.i // 16 AS tile, a.i // 16 + 1 AS other", "a.i // 16 - 1 AS tile, a.i // 16 AS other"))
def audit_tile_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour tiles that differ on the column they share; every tenth row is altered."""
    g = bind.frame(spark, sf_dir, bind.GRID)
    own = g.select(F.floor(F.col("i") / 16).alias("tile"), F.lit(0).alias("row"), F.floor(F.col("i") / 16).alias("col"), "j", (F.col("i") % 16).alias("i"), "value")
    edge = g.where("i % 16 = 0 and i > 0").select((F.floor(F.col("i") / 16) - 1).alias("tile"), F.lit(0).alias("row"), (F.floor(F.col("i") / 16) - 1).alias("col"), "j", F.lit(16).alias("i"), (F.col("value") + F.when(F.col("j") % 10 == 3, 1).otherwise(0)).alias("value"))
    return audits.border_mismatches(own.unionByName(edge), 17)


@query("VQ8", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'owed' ELSE 'lapsed' END AS state FROM (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 400000) a FULL JOIN (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 = 0) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def audit_owed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items not acknowledged, and acknowledgements of none."""
    items = bind.table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return audits.owed(items, bind.table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id")))


@query("VQ9", "SELECT o_custkey AS item, count(DISTINCT o_orderpriority) AS versions FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def audit_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which products hold different versions."""
    return audits.consistency(bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("product"), F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("version")))


@query("VQ10", "WITH c AS (SELECT DISTINCT p_name AS name, unnest(string_split(p_name, '')) AS ch FROM part) SELECT name, string_agg(ch, '' ORDER BY ch) AS missing FROM (SELECT DISTINCT name, ch FROM c WHERE ch NOT IN (SELECT DISTINCT unnest(string_split(p_type, '')) FROM part)) GROUP BY name")
def audit_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of names that types' letters lack."""
    part = bind.table(spark, sf_dir, "part")
    font = part.select(F.explode(F.split("p_type", "")).alias("ch")).distinct()
    return audits.missing_characters(part.select(F.col("p_name").alias("name")).distinct(), font)


@query("VQ11", f"""{_V}, w AS (SELECT route, idx, CASE WHEN idx % 20 = 19 THEN lon + 500 ELSE lon END AS lon, CASE WHEN idx % 25 = 24 THEN day - 40 ELSE day END AS day FROM v), b AS (SELECT *, lag(day) OVER (PARTITION BY route ORDER BY idx) AS bd FROM w)
SELECT route, CAST(idx AS INT) AS idx, CASE WHEN NOT (lon BETWEEN -180 AND 180) THEN 'place' ELSE 'backward' END AS fault FROM b WHERE NOT (lon BETWEEN -180 AND 180) OR day < bd""")
def audit_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted faults of routes."""
    v = _vertices(spark, sf_dir).withColumn("lon", F.when(F.col("idx") % 20 == 19, F.col("lon") + 500).otherwise(F.col("lon"))).withColumn("day", F.when(F.col("idx") % 25 == 24, F.col("day") - 40).otherwise(F.col("day")))
    return audits.route_faults(v)


@query("VQ13", "WITH u AS (SELECT DISTINCT o_custkey % 40 AS unit, CAST(o_orderkey % 25 AS INT) AS step FROM orders), m AS (SELECT * FROM u WHERE (unit, step) NOT IN (SELECT (c_custkey % 40, CAST(c_custkey % 23 AS INT)) FROM customer WHERE c_custkey % 3 = 0)), g AS (SELECT *, step - row_number() OVER (PARTITION BY unit ORDER BY step) AS g FROM m) SELECT unit, min(step) AS first, max(step) AS last FROM g GROUP BY unit, g")
def audit_unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of steps in which a unit bears no name."""
    units = bind.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("unit"), (F.col("o_orderkey") % 25).cast("int").alias("step")).distinct()
    placed = bind.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") % 40).alias("unit"), (F.col("c_custkey") % 23).cast("int").alias("step"))
    return audits.unnamed(units, placed)


@query("VQ14", f"""{bind.ctes(g=bind.GRID)}, x AS (SELECT s_suppkey AS id, CAST(s_suppkey * 7 % 70 AS INT) AS j, CAST(s_suppkey * 11 % 128 AS INT) AS i FROM supplier) SELECT id, CASE WHEN value IS NULL THEN 'absent' ELSE 'outside' END AS fault FROM x LEFT JOIN g USING (j, i) WHERE value IS NULL OR NOT (value BETWEEN -500 AND 2000)""")
def audit_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known places against the grid."""
    x = bind.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 70).cast("int").alias("j"), (F.col("s_suppkey") * 11 % 128).cast("int").alias("i"), F.lit(-500).alias("low"), F.lit(2000).alias("high"))
    return audits.expectations(x, bind.frame(spark, sf_dir, bind.GRID))


@query("AG29", "WITH q AS (SELECT event_type AS kind, value AS ms, ntile(4) OVER (PARTITION BY event_type ORDER BY value) AS q FROM events) SELECT kind, count(*) AS samples, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, round(avg(ms) FILTER (q = 1), 6) AS interval_ms, count(*) FILTER (ms > 80) AS missed FROM q GROUP BY kind")
def audit_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles, fastest quarter and missed budgets of events' values."""
    s = bind.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("ms"))
    return audits.timings(s, ["kind"], 80.0).withColumn("interval_ms", F.round("interval_ms", 6))


_BOX = "SELECT s_suppkey AS id, s_suppkey * 31 % 40 AS x0, s_suppkey * 17 % 40 AS y0, s_suppkey * 31 % 40 + 1 + s_suppkey % 5 AS x1, s_suppkey * 17 % 40 + 1 + s_suppkey % 7 AS y1 FROM {supplier}"


@query("ST6", f"{bind.ctes(b=_BOX)}, d AS (SELECT DISTINCT x0, y0, x1, y1 FROM b) SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.x0 <= d.x0 AND o.y0 <= d.y0 AND o.x1 >= d.x1 AND o.y1 >= d.y1 AND (o.x0, o.y0, o.x1, o.y1) <> (d.x0, d.y0, d.x1, d.y1))")
def set_outer_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that lie in no other, found by an equi-join on the tiles of corners."""
    b = bind.frame(spark, sf_dir, _BOX).select("x0", "y0", "x1", "y1").distinct()
    wide = b.select(*[F.col(c).alias("o" + c) for c in b.columns]).withColumn("tx", F.explode(F.sequence(F.floor(F.col("ox0") / 8), F.floor(F.col("ox1") / 8)))).withColumn("ty", F.explode(F.sequence(F.floor(F.col("oy0") / 8), F.floor(F.col("oy1") / 8))))
    other = (F.col("ox0") != F.col("x0")) | (F.col("oy0") != F.col("y0")) | (F.col("ox1") != F.col("x1")) | (F.col("oy1") != F.col("y1"))
    corners = b.withColumn("tx", F.floor(F.col("x0") / 8)).withColumn("ty", F.floor(F.col("y0") / 8))
    inside = corners.join(wide, ["tx", "ty"]).where((F.col("ox0") <= F.col("x0")) & (F.col("oy0") <= F.col("y0")) & (F.col("ox1") >= F.col("x1")) & (F.col("oy1") >= F.col("y1")) & other)
    return b.join(inside.select("x0", "y0", "x1", "y1").distinct(), ["x0", "y0", "x1", "y1"], "left_anti")


@query("ST7", f"""{bind.ctes(g=bind.GRID)} SELECT CASE WHEN j BETWEEN 10 AND 20 AND i BETWEEN 10 AND 30 THEN 'detail' WHEN j BETWEEN 5 AND 30 AND i BETWEEN 0 AND 60 THEN 'near' ELSE 'world' END AS tier, count(*) AS cells, CAST(sum(value) AS BIGINT) AS total FROM g GROUP BY 1""")
def set_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by the finest zone that holds them."""
    tier = F.when(F.col("j").between(10, 20) & F.col("i").between(10, 30), "detail").when(F.col("j").between(5, 30) & F.col("i").between(0, 60), "near").otherwise("world")
    return bind.frame(spark, sf_dir, bind.GRID).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))


@query("FL3", "SELECT l_returnflag AS kind, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') AND (l_linenumber <= 3 OR l_orderkey % 100 = 0) AND l_quantity > 0 GROUP BY 1")
def filter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of listed classes, of a rank within the limit or on the allow-list."""
    rows = bind.table(spark, sf_dir, "lineitem")
    kept = rows.where(F.col("l_returnflag").isin("A", "R") & ((F.col("l_linenumber") <= 3) | (F.col("l_orderkey") % 100 == 0)) & (F.col("l_quantity") > 0))
    return kept.groupBy(F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# The files of corrections by era, with the years that they begin in, and the kinds of corrections.
_ERAS = [("bce", None, 0), ("0001-0999", 1, 999), ("1000-1499", 1000, 1499), ("1500-1799", 1500, 1799), ("1800-1913", 1800, 1913), ("1914-2000", 1914, 2000)]
_KINDS = ("give", "carry", "add", "drop", "member", "rename", "pocket", "overlap")
_CORRECTIONS = """SELECT CASE WHEN s_suppkey % 23 = 22 THEN '2001' WHEN y < 1 THEN 'bce' WHEN y < 1000 THEN '0001-0999' WHEN y < 1500 THEN '1000-1499' WHEN y < 1800 OR s_suppkey % 11 = 4 THEN '1500-1799' WHEN y < 1914 THEN '1800-1913' ELSE '1914-2000' END AS era,
CASE WHEN s_suppkey % 37 = 36 THEN s_suppkey - 37 ELSE s_suppkey END AS number, CASE s_suppkey % 9 WHEN 0 THEN 'give' WHEN 1 THEN 'carry' WHEN 2 THEN 'add' WHEN 3 THEN 'drop' WHEN 4 THEN 'member' WHEN 5 THEN 'rename' WHEN 6 THEN 'pocket' WHEN 7 THEN 'overlap' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'merge' ELSE 'overlap' END END AS kind,
y AS y0, CASE WHEN s_suppkey % 29 = 3 THEN NULL ELSE y + s_suppkey % 41 - 2 END AS y1, CASE WHEN s_suppkey % 31 = 5 THEN ' ' ELSE 'said' END AS why, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'book' END AS source FROM (SELECT s_suppkey, CAST(s_suppkey * 7919 % 3000 - 990 AS INT) AS y FROM {supplier}) q"""


@query("VQ12", f"""{bind.ctes(c=_CORRECTIONS)}, er AS (SELECT * FROM (VALUES {", ".join(f"('{e}', {'NULL' if a is None else a}, {b})" for e, a, b in _ERAS)}) AS t(era, low, high)),
f AS (SELECT c.era, number, count(*) OVER (PARTITION BY c.era, number) AS n, CASE WHEN kind NOT IN {_KINDS} THEN 'operation' WHEN y0 IS NULL OR y1 IS NULL OR y0 > y1 THEN 'years' WHEN er.era IS NULL THEN 'era'
  WHEN y0 < coalesce(low, y0) OR y0 > coalesce(high, y0) THEN 'outside its era' WHEN y1 > 2000 THEN 'past the last year' WHEN trim(why) = '' THEN 'no reason' WHEN coalesce(source, '') = '' AND kind <> 'overlap' THEN 'no source' END AS fault FROM c LEFT JOIN er ON er.era = c.era)
SELECT era, number, coalesce(fault, 'repeated') AS fault FROM f WHERE fault IS NOT NULL OR n > 1""")
def audit_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of dated corrections: kinds, years, eras, reasons, sources."""
    eras = spark.createDataFrame(_ERAS, "era string, low int, high int")
    return audits.correction_faults(bind.frame(spark, sf_dir, _CORRECTIONS), eras, 2000, _KINDS)
