"""Joins on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators import joins
from meridia.plans import bind
from meridia.registry import SQL, query

KM = "2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({3}) - radians({1})) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - {0}) / 2), 2)))))"
_HOUSES = f"SELECT s_suppkey AS a, {bind.geo('s_suppkey')} FROM {{supplier}}"
_GUESTS = f"SELECT c_custkey AS b, {bind.geo('(c_custkey + 5)')} FROM {{customer}}"


@query(
    "SC16",
    f"""{bind.ctes(h=_HOUSES, g=_GUESTS)}, z AS (SELECT count(*) AS z FROM h), p AS (SELECT b, g.lon AS lon1, g.lat AS lat1, h.lon AS lon2, h.lat AS lat2 FROM g, z JOIN h ON h.a = g.b % z + (SELECT min(a) FROM h)),
q AS (SELECT *, ((degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360) % 360) AS deg FROM p)
SELECT b, round({KM.format("lon1", "lat1", "lon2", "lat2")}, 5) AS km, round(deg, 5) AS degrees, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor(deg / 45 + 0.5) AS INT) % 8 + 1] AS compass FROM q""",
)
def sc_great_circle_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, bearing and compass point from every customer to a supplier, every supplier in turn."""
    h, g = bind.frame(spark, sf_dir, _HOUSES), bind.frame(spark, sf_dir, _GUESTS)
    first, n = h.agg(F.min("a"), F.count(F.lit(1))).first()
    pairs = g.join(h.select("a", F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), F.col("a") == F.col("b") % max(n, 1) + F.lit(first))
    deg = geo.bearing("lon", "lat", "lon2", "lat2")
    return pairs.select("b", F.round(geo.great_circle_km("lon", "lat", "lon2", "lat2"), 5).alias("km"), F.round(deg, 5).alias("degrees"), geo.compass(deg).alias("compass"))


@query("SC16", SQL["sc_great_circle_whole"])
def sc_great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of sc_great_circle_whole."""
    return sc_great_circle_whole(spark, sf_dir)


_EDGE = """SELECT DISTINCT p_partkey AS child, p_partkey DIV 7 AS parent FROM {part} WHERE p_partkey > 0
UNION SELECT p_partkey, p_partkey + 1 FROM {part} WHERE p_partkey % 100 = 50 UNION SELECT p_partkey, p_partkey - 1 FROM {part} WHERE p_partkey % 100 = 51"""


@query(
    "JN7 JN2",
    f"""WITH RECURSIVE e AS ({bind.duck(_EDGE)}), r(node, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION SELECT node, parent, depth + 1 FROM r JOIN e ON child = ancestor WHERE depth < 20)
SELECT node, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY ALL""",
)
def jn_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors with their least depth, over a tree with circles."""
    return joins.closure(bind.frame(spark, sf_dir, _EDGE))


_SPANS = "SELECT o_orderkey AS k, DAYNO(o_orderdate) AS d0, DAYNO(o_orderdate) + o_orderkey % 11 AS d1 FROM {orders}"
_ALL_WINDOWS = "SELECT c_custkey AS f, 727900 + c_custkey * 37 % 2400 AS w0, 727900 + c_custkey * 37 % 2400 + c_custkey % 5 AS w1 FROM {customer}"


@query("JN9", f"""{bind.ctes(s=_SPANS, w=_ALL_WINDOWS)} SELECT f, k FROM s JOIN w ON d0 <= w1 AND w0 <= d1""")
def jn_interval_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose span of days overlaps the window of any customer."""
    return joins.interval_pairs(bind.frame(spark, sf_dir, _SPANS), bind.frame(spark, sf_dir, _ALL_WINDOWS), "d0", "d1", "w0", "w1", 8, "k", "f").select("f", "k")


@query("JN9", SQL["jn_interval_whole"])
def jn_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of jn_interval_whole."""
    return jn_interval_whole(spark, sf_dir)


@query("JN10 JN16", f"""{bind.ctes(h=_HOUSES, g=_GUESTS)} SELECT a, b, round({KM.format("h.lon", "h.lat", "g.lon", "g.lat")}, 5) AS km FROM h, g WHERE {KM.format("h.lon", "h.lat", "g.lon", "g.lat")} <= 1500""")
def jn_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within 1500 km of a supplier."""
    pairs = joins.near_join(bind.frame(spark, sf_dir, _HOUSES), bind.frame(spark, sf_dir, _GUESTS), 1500.0)
    return pairs.select("a", "b", geo.half_up("km", 5).alias("km"))


_DEEDS = "SELECT user_id AS u, ts AS at, event_id AS k FROM {events} WHERE event_type IN ('purchase', 'error')"
_OTHERS = "SELECT user_id AS u, ts AS at, event_id AS last_id, event_type AS last_type FROM {events} WHERE event_type IS NULL OR event_type NOT IN ('purchase', 'error')"


@query("JN12", f"""{bind.ctes(s=_DEEDS, t=_OTHERS)} SELECT k, last_id, last_type FROM (SELECT k, last_id, last_type, row_number() OVER (PARTITION BY k ORDER BY t.at DESC, last_id DESC, last_type DESC) AS n FROM s LEFT JOIN t ON s.u = t.u AND t.at <= s.at) WHERE n = 1""")
def jn_asof_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase and error the user's last other event before it; each event is on one side."""
    return joins.asof_join(bind.frame(spark, sf_dir, _DEEDS), bind.frame(spark, sf_dir, _OTHERS), ["u"], "at", ["last_id", "last_type"]).select("k", "last_id", "last_type")


@query("JN12", SQL["jn_asof_whole"])
def jn_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of jn_asof_whole."""
    return jn_asof_whole(spark, sf_dir)


_DAYS = "SELECT o_orderkey AS k, DAYNO(o_orderdate) AS day FROM {orders}"
_STEPS = "SELECT DISTINCT 727900 + s_suppkey * 7919 % 2500 AS step FROM {supplier}"


@query("SC24", f"""{bind.ctes(d=_DAYS, s=_STEPS)}, n AS (SELECT step, lead(step) OVER (ORDER BY step) AS next FROM s)
SELECT k, step, CASE WHEN next IS NULL THEN step * 1.0 ELSE round(step % 97 + (next % 97 - step % 97) * (day - step) / (next - step), 6) END AS value FROM d LEFT JOIN n ON day >= step AND (next IS NULL OR day < next)""".replace("CASE WHEN next IS NULL THEN step * 1.0", "CASE WHEN next IS NULL THEN (step % 97) * 1.0"))
def jn_step_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step that holds a day, and a line between the keys around it, flat beyond the last; steps are few and broadcast as one array."""
    steps = bind.frame(spark, sf_dir, _STEPS).agg(F.array_sort(F.collect_list("step")).alias("steps"))  # one row per map step
    rows = bind.frame(spark, sf_dir, _DAYS).crossJoin(F.broadcast(steps))  # of a single row
    rows = rows.select("k", "day", joins.last_before(F.col("steps"), F.col("day")).alias("step"), F.get(F.filter("steps", lambda s: s > F.col("day")), 0).alias("next"))
    a, b = F.col("step") % 97, F.col("next") % 97
    return rows.select("k", "step", F.when(F.col("step").isNull(), None).when(F.col("next").isNull(), a.cast("double")).otherwise(F.round(a + (b - a) * (F.col("day") - F.col("step")) / (F.col("next") - F.col("step")), 6)).alias("value"))


@query("JN11", f"""{bind.ctes(d=_DAYS, s=_STEPS)}, n AS (SELECT day, arg_min(step, (abs(day - step), step)) AS nearest FROM (SELECT DISTINCT day FROM d), s GROUP BY day) SELECT k, nearest FROM d JOIN n USING (day)""")
def jn_nearest_in_time_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step fewest days from the day of every order, the earlier of equals."""
    steps = bind.frame(spark, sf_dir, _STEPS).agg(F.array_sort(F.collect_list("step")).alias("steps"))
    rows = bind.frame(spark, sf_dir, _DAYS).crossJoin(F.broadcast(steps))  # of a single row
    near = rows.select("k", "day", joins.last_before(F.col("steps"), F.col("day")).alias("a"), F.get(F.filter("steps", lambda s: s > F.col("day")), 0).alias("b"))
    return near.select("k", F.when(F.col("a").isNull() | (F.col("b") - F.col("day") < F.col("day") - F.col("a")), F.col("b")).otherwise(F.col("a")).alias("nearest"))


@query("JN11", SQL["jn_nearest_in_time_whole"])
def jn_nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of jn_nearest_in_time_whole."""
    return jn_nearest_in_time_whole(spark, sf_dir)


_BOX = """SELECT * FROM (VALUES (0, 'west', -180e0, -90e0, -30e0, 90e0), (1, 'north', -180e0, 30e0, 180e0, 90e0), (2, 'east', 60e0, -90e0, 180e0, 90e0), (3, 'middle', -30e0, -60e0, 60e0, 40e0)) AS t(ord, name, west, south, east, north)"""


@query("JN14", f"""{bind.ctes(g=_GUESTS, x=_BOX)} SELECT b, arg_min(name, ord) AS region, count(name) = 0 AS gap FROM g LEFT JOIN x ON lon >= west AND lon <= east AND lat >= south AND lat <= north GROUP BY b""")
def jn_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a few boxes that holds a point; points in none are gaps. The boxes are a fixed list of the configuration."""
    from meridia.operators.events import region_of

    boxes = bind.frame(spark, sf_dir, _BOX).orderBy("ord").collect()
    region = region_of(boxes, F.col("lon"), F.col("lat"))
    return bind.frame(spark, sf_dir, _GUESTS).select("b", region.alias("region"), region.isNull().alias("gap"))


@query("JN13", f"""{bind.ctes(p=bind.POLITY)}, y AS (SELECT unnest(generate_series(1795, 1895, 5)) AS year) SELECT CAST(year AS INT) AS year, row_id, name FROM p JOIN y ON first <= year AND year <= last""")
def jn_valid_in_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows valid in each map year."""
    years = spark.range(1795, 1896, 5).select(F.col("id").cast("int").alias("year"))
    return joins.interval_join(bind.frame(spark, sf_dir, bind.POLITY), years.withColumn("until", F.col("year")), "first", "last", "year", "until", 10).select("year", "row_id", "name")


@query("JN25 JN3", f"""{bind.ctes(e=bind.EVENT_ROW, c=bind.CURATED)} SELECT e.qid, e.label, p.label AS parent_label, e.parent IS NOT NULL AND (p.qid IS NULL OR NOT p.located) AS partial,
  coalesce(c.lon, e.lon) AS lon, CASE WHEN coalesce(c.boost, 0) <> 0 THEN e.score + c.boost ELSE e.score END AS score, c.qid IS NOT NULL AS curated FROM e LEFT JOIN (SELECT * FROM e WHERE located) p ON p.qid = e.parent LEFT JOIN c ON c.qid = e.qid""")
def jn_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents' labels (partial where the parent isn't among the located), curated values over source values."""
    e, c = bind.frame(spark, sf_dir, bind.EVENT_ROW), bind.frame(spark, sf_dir, bind.CURATED)
    parents = e.where("located").select(F.col("qid").alias("parent"), F.col("label").alias("parent_label"))
    rows = e.join(parents, "parent", "left").join(c.select("qid", "boost", F.col("lon").alias("clon"), F.lit(True).alias("curated")), "qid", "left")
    score = F.when(F.coalesce("boost", F.lit(0.0)) != 0, F.col("score") + F.col("boost")).otherwise(F.col("score").cast("double"))
    return rows.select("qid", "label", "parent_label", (F.col("parent").isNotNull() & F.col("parent_label").isNull()).alias("partial"), F.coalesce("clon", "lon").alias("lon"), score.alias("score"), F.coalesce("curated", F.lit(False)).alias("curated"))


@query("JN4", f"""{bind.ctes(e=bind.EVENT_ROW, c=bind.CURATED)} SELECT c.qid, CASE WHEN e.qid IS NULL THEN 'absent' ELSE 'unlocated' END AS fault FROM c LEFT JOIN e USING (qid) WHERE e.qid IS NULL OR NOT e.located""")
def jn_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated ids that the index lacks or leaves without a place."""
    e, c = bind.frame(spark, sf_dir, bind.EVENT_ROW).select("qid", "located"), bind.frame(spark, sf_dir, bind.CURATED)
    return c.join(e, "qid", "left").where("located is null or not located").select("qid", F.when(F.col("located").isNull(), "absent").otherwise("unlocated").alias("fault"))


@query("JN6 FL4", f"""WITH RECURSIVE e AS ({bind.duck(bind.EVENT_ROW)}), kept AS (SELECT qid, parent FROM e WHERE score > 900),
r AS (SELECT qid, parent FROM kept UNION SELECT e.qid, e.parent FROM r JOIN e ON e.qid = r.parent) SELECT DISTINCT e.qid, e.score <= 900 AS recovered FROM r JOIN e USING (qid)""")
def jn_recover_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows and all their ancestors."""
    from meridia.operators.events import with_ancestors

    e = bind.frame(spark, sf_dir, bind.EVENT_ROW)
    return with_ancestors(e, e.where("score > 900").select("qid")).select("qid", (F.col("score") <= 900).alias("recovered"))


@query("JN8", f"""WITH RECURSIVE e AS ({bind.duck(bind.PARENT)}), u AS (SELECT unnest([3, 100, 17])::BIGINT AS id), up AS (SELECT id FROM u UNION SELECT parent FROM up JOIN e ON child = id),
down AS (SELECT id FROM u UNION SELECT child FROM down JOIN e ON parent = id) SELECT DISTINCT id FROM (SELECT id FROM up UNION ALL SELECT id FROM down)""")
def jn_kin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of items with all ancestors and all descendants."""
    from meridia.operators.events import kin

    focal = bind.table(spark, sf_dir, "part").where("p_partkey in (3, 100, 17)").select(F.col("p_partkey").alias("id"))
    return kin(bind.frame(spark, sf_dir, bind.PARENT), focal)


@query("JN27 JN1", f"""{bind.ctes(g=_GUESTS)} SELECT g.b, grp, lat < 0 AS mirrored FROM g JOIN customer ON c_custkey = b LEFT JOIN (VALUES ('BUILDING', 'works'), ('MACHINERY', 'works'), ('HOUSEHOLD', 'home')) AS m(seg, grp) ON seg = c_mktsegment""")
def jn_class_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of a class, null for a class that isn't listed, and whether the glyph is mirrored."""
    groups = spark.createDataFrame([("BUILDING", "works"), ("MACHINERY", "works"), ("HOUSEHOLD", "home")], "c_mktsegment string, grp string")  # a fixed list
    seg = bind.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b"), "c_mktsegment")
    return bind.frame(spark, sf_dir, _GUESTS).join(seg, "b").join(F.broadcast(groups), "c_mktsegment", "left").select("b", "grp", (F.col("lat") < 0).alias("mirrored"))

