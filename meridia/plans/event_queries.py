"""The event index and what is selected from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions.geo import great_circle_km
from meridia.operators import events
from meridia.plans import bind
from meridia.plans.join_queries import KM
from meridia.registry import query

_EDGES = [700000 + 1500 * i for i in range(25)]
_DAY0 = "CAST(date_diff('day', DATE '0001-01-01', {0}) AS BIGINT)"
# Days up to a Julian January: 365 a year and one each fourth; then the months' lengths. October 1582 is the last Julian month.
_JANUARY = "(365 * ({0} - 1) + CAST(floor(({0} - 1) / 4.0) AS BIGINT) - 2)"
_JULIAN = "(" + _JANUARY.format("{0}") + " + ([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334])[{1}] + CASE WHEN {1} > 2 AND {0} % 4 = 0 THEN 1 ELSE 0 END)"


def month_start(y: str, m: str) -> str:
    """DuckDB SQL of the day number on which a month as written then begins."""
    return f"CASE WHEN {y} * 100 + {m} > 158210 THEN {_DAY0.format(f'make_date(CAST({y} AS BIGINT), CAST({m} AS BIGINT), 1)')} ELSE {_JULIAN.format(y, m)} END"


_FIRST = f"CASE prec WHEN 9 THEN {month_start('y', '1')} WHEN 10 THEN {month_start('y', 'm')} ELSE {_DAY0.format('make_date(y, m, d)')} END"
_LAST = f"CASE prec WHEN 9 THEN ({month_start('(y + 1)', '1')}) - 1 WHEN 10 THEN ({month_start('(y + m // 12)', '(m % 12 + 1)')}) - 1 ELSE {_DAY0.format('make_date(y, m, d)')} END"
_INDEX = f"""{bind.ctes(st=bind.STATEMENT, cl=bind.EVENT_CLASS, cu=bind.CURATED)},
u AS (SELECT st.*, weight, {_FIRST} AS s0, {_LAST} AS s1, CASE prop WHEN 'point' THEN 0 WHEN 'start' THEN 1 ELSE 2 END AS pr FROM st JOIN cl USING (cls) WHERE prec >= 9),
c AS (SELECT qid, max(n) > 1 AS conflict FROM (SELECT qid, prop, count(DISTINCT (y, m, d, prec)) AS n FROM u GROUP BY ALL) GROUP BY qid),
dt AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pr, prec DESC, y, m, d, line_no) = 1),
sp AS (SELECT u.qid, min(u.s0) FILTER (u.prop = 'start') AS b0, max(u.s1) FILTER (u.prop = 'end') AS b1 FROM u JOIN dt USING (qid) LEFT JOIN cu USING (qid)
  WHERE NOT (cu.day IS NOT NULL AND (u.prop, u.y, u.m, u.d, u.prec) = (dt.prop, dt.y, dt.m, dt.d, dt.prec)) AND NOT (cu.until IS NOT NULL AND u.prop = 'end') GROUP BY u.qid),
g AS (SELECT qid, arg_min(label, line_no) FILTER (label <> '') AS label, arg_min(enwiki, line_no) FILTER (enwiki IS NOT NULL) AS enwiki, arg_min(lon, line_no) FILTER (lon IS NOT NULL) AS plon, arg_min(lat, line_no) FILTER (lon IS NOT NULL) AS plat,
  arg_max(cls, (weight, -line_no)) AS cls, max(weight) AS weight, max(editions) AS editions, list_sort(list(DISTINCT parent) FILTER (parent IS NOT NULL)) AS parents FROM u GROUP BY qid),
j AS (SELECT g.*, b0, b1, c.conflict, cu.boost, cu.day, cu.until, coalesce(cu.lon, plon) AS lon, coalesce(cu.lat, plat) AS lat, dt.s0 AS c0, CASE WHEN day IS NULL AND NOT (until IS NOT NULL AND dt.prop = 'end') THEN dt.s1 END AS c1, dt.prec AS cp FROM g JOIN c USING (qid) JOIN dt USING (qid) LEFT JOIN sp USING (qid) LEFT JOIN cu USING (qid)),
ix AS (SELECT qid, label, enwiki, cls, lon, lat, coalesce(day, c0) AS date, CAST(CASE WHEN day IS NOT NULL THEN 11 ELSE cp END AS INT) AS prec, least(coalesce(day, c0), b0) AS t0, greatest(coalesce(day, c0), until, c1, b1) AS t1, editions,
  round(log2(1 + editions) * weight + coalesce(boost, 0.0), 6) AS score, conflict, coalesce(parents, []) AS parents FROM j WHERE label <> '' AND editions > 0 AND lon IS NOT NULL)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.index(bind.frame(spark, sf_dir, bind.STATEMENT), bind.frame(spark, sf_dir, bind.EVENT_CLASS), bind.frame(spark, sf_dir, bind.CURATED))


@query("AG1 AG2 AG5 AG6 AG7 AG13 FL1 FL2 JN1 JN3", f"{_INDEX} SELECT * FROM ix")
def event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements to scored events: the flagship."""
    return _index(spark, sf_dir)


_LISTED = "SELECT c_custkey AS qid FROM {customer} WHERE c_custkey % 25 = 3 UNION ALL SELECT CAST(-c_custkey AS BIGINT) FROM {customer} WHERE c_custkey % 100 = 50"


@query("JN5", f"{_INDEX}, li AS ({bind.duck(_LISTED)}) SELECT DISTINCT li.qid, ix.qid IS NOT NULL AS there, ix.label, ix.score FROM li LEFT JOIN ix ON ix.qid = li.qid")
def event_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed events, those that the index lacks reported."""
    rows, missing = events.forced(_index(spark, sf_dir), bind.frame(spark, sf_dir, _LISTED))
    return rows.select("qid", F.lit(True).alias("there"), "label", "score").unionByName(missing.select("qid", F.lit(False).alias("there")), allowMissingColumns=True)


@query("TK1", f"{_INDEX} SELECT qid, label, score, date FROM ix ORDER BY score DESC, qid LIMIT 100")
def event_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best events."""
    return _index(spark, sf_dir).select("qid", "label", "score", "date").orderBy(F.col("score").desc(), "qid").limit(100)


_MEMBER = "SELECT DISTINCT o_custkey AS event, CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS cls FROM {orders} UNION SELECT DISTINCT o_custkey, '3-MEDIUM' FROM {orders} WHERE o_orderpriority = '9-ABSENT' UNION SELECT DISTINCT o_custkey, '9-ABSENT' FROM {orders} WHERE o_orderkey % 40 = 0 UNION SELECT DISTINCT o_custkey, '3-MEDIUM' FROM {orders} WHERE o_orderkey % 40 = 0 UNION SELECT DISTINCT o_custkey, '1-URGENT' FROM {orders}"
_CONTAIN = f"""{bind.ctes(mb=_MEMBER, cl=bind.EVENT_CLASS)}, n AS (SELECT cls, count(*) AS n FROM mb GROUP BY cls),
ct AS (SELECT a.cls AS i, b.cls AS o FROM mb a JOIN mb b USING (event) JOIN n ON n.cls = a.cls WHERE a.cls <> b.cls GROUP BY a.cls, b.cls, n.n HAVING count(*) = n.n)"""


@query("AG3", f"{_CONTAIN} SELECT i AS inner_cls, o AS outer_cls FROM ct")
def event_class_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes whose events all belong to another."""
    return events.containment(bind.frame(spark, sf_dir, _MEMBER)).select(F.col("inner").alias("inner_cls"), F.col("outer").alias("outer_cls"))


@query(
    "AG4",
    f"""{_CONTAIN}, w AS (SELECT event, cls, weight, ord FROM mb JOIN cl USING (cls)), t AS (SELECT event, arg_max(cls, (weight, -ord)) AS top FROM w GROUP BY event),
near AS (SELECT w.* FROM w JOIN t USING (event) WHERE w.cls = top OR (w.cls, top) IN (SELECT (i, o) FROM ct)),
x AS (SELECT * FROM near a WHERE NOT EXISTS (SELECT 1 FROM near b JOIN ct ON ct.i = b.cls AND ct.o = a.cls WHERE b.event = a.event AND (a.cls, b.cls) NOT IN (SELECT (i, o) FROM ct)))
SELECT event, arg_min(cls, (-weight, ord)) AS display FROM x GROUP BY event""",
)
def event_display_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific class within an event's heaviest."""
    return events.displayed_class(bind.frame(spark, sf_dir, _MEMBER), bind.frame(spark, sf_dir, bind.EVENT_CLASS))


_ROWS = f"""{bind.ctes(e=bind.EVENT_ROW)}, r AS (SELECT *, (t0 - 700000) // 1500 AS era, (qid % 5) / 50e0 AS boost, CASE cls WHEN 'Brand#11' THEN 3e0 ELSE 2e0 END AS weight FROM e),
up AS (SELECT *, cume_dist() OVER (PARTITION BY era ORDER BY editions) AS upper FROM r),
pt AS (SELECT *, CAST(round_even(1000 * least(1, greatest(0, upper + boost)) * weight / max(weight) OVER (), 0) AS INT) AS points FROM up),
rw AS (SELECT *, row_number() OVER (ORDER BY points DESC, qid) - 1 AS "row" FROM pt)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.frame(spark, sf_dir, bind.EVENT_ROW)
    weight = F.when(F.col("cls") == "Brand#11", 3.0).otherwise(2.0)
    rows = rows.select("*", events.era(F.col("t0"), _EDGES).alias("era"), ((F.col("qid") % 5) / 50).alias("boost"), weight.alias("weight"))
    return events.row_ids(events.percentile_score(rows))


@query("WN1 WN2 WN3 WN4", f'{_ROWS} SELECT qid, CAST(era AS INT) AS era, round(upper, 9) AS upper, points, "row" FROM rw')
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Era, percentile, points and row number of events."""
    return _rows(spark, sf_dir).select("qid", "era", F.round("upper", 9).alias("upper"), "points", "row")


_REGION = "CASE WHEN lon < 0 THEN 'west' ELSE 'east' END"


@query(
    "WN5 ST1 ST2",
    f"""{_ROWS}, g AS (SELECT *, {_REGION} AS region FROM rw), n AS (SELECT *, row_number() OVER (PARTITION BY era, region ORDER BY "row") AS n FROM g),
q AS (SELECT qid, "row", false AS filled FROM n WHERE n <= 3), f AS (SELECT qid, "row", true AS filled FROM n WHERE n > 3 ORDER BY "row" LIMIT greatest(0, 300 - (SELECT count(*) FROM q)))
SELECT qid, "row", 'overview' AS page, filled FROM (SELECT * FROM q UNION ALL SELECT * FROM f) UNION ALL
SELECT qid, "row", 'rest', false FROM n WHERE qid NOT IN (SELECT qid FROM q UNION ALL SELECT qid FROM f)""",
)
def event_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota for each era and region, filled up by row number; the rest apart."""
    from meridia.shared import stored

    rows = stored(_rows(spark, sf_dir).select("qid", "era", "row", F.when(F.col("lon") < 0, "west").otherwise("east").alias("region")), "rows")
    chosen = stored(events.overview(rows, 3, 300), "overview")
    rest = rows.join(chosen.select("qid"), "qid", "left_anti")
    return chosen.select("qid", "row", F.lit("overview").alias("page"), "filled").unionByName(rest.select("qid", "row", F.lit("rest").alias("page"), F.lit(False).alias("filled")))


_PAGES = f"""{_ROWS}, lh AS (SELECT *, era AS lo, (t1 + CASE WHEN qid % 30 = 0 THEN 6000 WHEN qid % 7 = 0 THEN 1600 ELSE 0 END - 700000) // 1500 AS hi0 FROM rw),
lh2 AS (SELECT *, least(24, hi0) AS hi FROM lh),
pg AS (SELECT *, unnest(CASE WHEN hi - lo >= 3 THEN ['long'] ELSE list_transform(generate_series(lo, hi), lambda x: printf('p%02d', CAST(x AS INT))) END) AS page FROM lh2)"""


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.when(F.col("qid") % 30 == 0, 6000).when(F.col("qid") % 7 == 0, 1600).otherwise(0)
    return events.pages(_rows(spark, sf_dir).withColumn("t1", F.col("t1") + long), _EDGES)


@query("EX6 AG14", f"{_PAGES} SELECT page, count(*) AS row_count, min(t0) AS first, max(t1 + CASE WHEN qid % 30 = 0 THEN 6000 WHEN qid % 7 = 0 THEN 1600 ELSE 0 END) AS last, CAST(sum(40 + length(label)) AS BIGINT) AS bytes FROM pg GROUP BY page")
def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, first and last day, and decoded bytes of each page."""
    return _paged(spark, sf_dir).groupBy("page").agg(F.count(F.lit(1)).alias("row_count"), F.min("t0").alias("first"), F.max("t1").alias("last"), F.sum(40 + F.length("label")).alias("bytes"))


@query("ST4", f'{_PAGES} SELECT DISTINCT qid, "row" FROM pg WHERE page IN (\'p03\', \'p04\', \'long\')')
def event_merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several pages, each once."""
    return _paged(spark, sf_dir).where("page in ('p03', 'p04', 'long')").dropDuplicates(["row"]).select("qid", "row")


_MIXED = bind.EVENT_ROW.replace("p_partkey % 5 <> 0 AS located", "p_partkey % 3 = 1 AND p_partkey > 60 AS located")


@query(
    "AG9 AG11",
    f"""WITH RECURSIVE e AS ({bind.duck(_MIXED)}), r AS (SELECT c.parent AS qid, c.qid AS child, c.lon, c.lat FROM e c JOIN e p ON p.qid = c.parent WHERE c.located AND NOT p.located
  UNION SELECT p.parent, r.child, r.lon, r.lat FROM r JOIN e p ON p.qid = r.qid JOIN e g ON g.qid = p.parent WHERE NOT g.located),
s AS (SELECT qid, sum(cos(radians(lat)) * cos(radians(lon))) AS x, sum(cos(radians(lat)) * sin(radians(lon))) AS y, sum(sin(radians(lat))) AS z FROM r GROUP BY qid)
SELECT qid, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat FROM s""",
)
def event_place_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of unlocated parents from located descendants."""
    return events.place_parents(bind.frame(spark, sf_dir, _MIXED)).select("qid", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(
    "AG10 AG12",
    f"""WITH RECURSIVE e AS ({bind.duck(bind.EVENT_ROW)}), r AS (SELECT parent AS qid, qid AS child FROM e WHERE parent IS NOT NULL UNION SELECT e.parent, r.child FROM r JOIN e ON e.qid = r.qid WHERE e.parent IS NOT NULL),
u AS (SELECT r.qid, lon, lat FROM r JOIN e ON e.qid = child WHERE located), l AS (SELECT DISTINCT qid, lon FROM u),
n AS (SELECT qid, lon, coalesce(lead(lon) OVER w, min(lon) OVER (PARTITION BY qid)) AS nx FROM l WINDOW w AS (PARTITION BY qid ORDER BY lon)),
a AS (SELECT qid, arg_max((nx, lon), (CASE WHEN nx > lon THEN nx - lon ELSE nx - lon + 360 END, -lon)) AS a FROM n GROUP BY qid),
d AS (SELECT u.qid, CAST(least(65535, ceil(max({KM.format("e.lon", "e.lat", "u.lon", "u.lat")}))) AS INT) AS radius FROM u JOIN e ON e.qid = u.qid AND e.located GROUP BY u.qid)
SELECT qid, a[1] AS west, min(lat) AS south, a[2] AS east, max(lat) AS north, any_value(radius) AS radius FROM u JOIN a USING (qid) LEFT JOIN d USING (qid) GROUP BY qid, a""",
)
def event_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents and radii over all located descendants."""
    return events.roll_up(bind.frame(spark, sf_dir, bind.EVENT_ROW), great_circle_km)


@query("WN6")
def event_display_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display parents among three candidates of each part; no circle may close."""
    rows = bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"), F.explode(F.array(F.expr("struct(if(p_partkey % 20 = 0, (p_partkey * 31 + 7) % 200, p_partkey div 7) as parent, 1 as rank)"), F.expr("struct((p_partkey * 17 + 3) % 200 as parent, 2 as rank)"))).alias("c"))
    return events.display_parents(rows.select("child", "c.parent", "c.rank"))


@query("AG8 FL5", f"""{bind.ctes(e=bind.EVENT_ROW)} SELECT cls, count(*) AS events, count(*) FILTER (located) AS located, count(*) FILTER (score > 500 AND parent IS NOT NULL) AS candidates FROM e GROUP BY cls""")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, located events and candidates of each class."""
    pool = (F.col("score") > 500) & F.col("parent").isNotNull()
    return bind.frame(spark, sf_dir, bind.EVENT_ROW).groupBy("cls").agg(F.count(F.lit(1)).alias("events"), F.count_if("located").alias("located"), F.count_if(pool).alias("candidates"))

