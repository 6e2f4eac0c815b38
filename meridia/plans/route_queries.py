"""Users' events as dated routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.operators import routes
from meridia.plans import bind
from meridia.plans.join_queries import KM
from meridia.registry import query

_R = bind.ROUTE
_V = f"{bind.ctes(r=_R)}, v AS (SELECT route, row_number() OVER (PARTITION BY route ORDER BY ts, event_id) - 1 AS idx, lon, lat, day FROM r), lg AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(day) OVER w AS day2 FROM v WINDOW w AS (PARTITION BY route ORDER BY idx)), k AS (SELECT *, {KM.format('lon', 'lat', 'lon2', 'lat2')} AS km FROM lg)"


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("route").orderBy("ts", "event_id")) - 1
    return bind.frame(spark, sf_dir, _R).select("route", idx.alias("idx"), "lon", "lat", "day")


@query("WN19", f"""{_V}, d AS (SELECT *, coalesce(greatest(1, ceil(round(km / 400.0, 9))), 1) AS parts FROM k), e AS (SELECT *, unnest(range(CAST(parts AS INT))) AS part FROM d),
a AS (SELECT *, part / parts AS t, acos(least(1, greatest(-1, sin(radians(lat)) * sin(radians(lat2)) + cos(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon))))) AS g FROM e),
b AS (SELECT *, sin((1 - t) * g) / sin(g) AS p, sin(t * g) / sin(g) AS q FROM a WHERE part > 0), c AS (SELECT route, idx, part, t, day, day2, p * cos(radians(lat)) * cos(radians(lon)) + q * cos(radians(lat2)) * cos(radians(lon2)) AS x, p * cos(radians(lat)) * sin(radians(lon)) + q * cos(radians(lat2)) * sin(radians(lon2)) AS y, p * sin(radians(lat)) + q * sin(radians(lat2)) AS z FROM b)
SELECT route, CAST(idx AS INT) AS idx, part, round(degrees(atan2(y, x)), 5) AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) AS lat, round(day + (day2 - day) * t, 6) AS day FROM c UNION ALL SELECT route, CAST(idx AS INT), 0, round(lon, 5), round(lat, 5), round(day * 1.0, 6) FROM v""")
def route_densified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with a point at least every 400 km."""
    d = routes.densified(_vertices(spark, sf_dir), 400.0)
    return d.select("route", "idx", "part", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), F.round("day", 6).alias("day"))


@query("WN21", f"{_V} SELECT route, CAST(idx AS INT) AS idx, round(coalesce(sum(km) OVER (PARTITION BY route ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS km FROM k")
def route_sailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres sailed up to each vertex."""
    return routes.sailed(_vertices(spark, sf_dir)).select("route", "idx", F.round("km", 3).alias("km"))


@query("WN20", f"""{_V}, q AS (SELECT DISTINCT route, day + 0.5 AS day FROM v), m AS (SELECT q.route, q.day, max(idx) AS idx FROM q LEFT JOIN v ON v.route = q.route AND v.day <= q.day GROUP BY ALL)
SELECT m.route, CAST(m.day AS DOUBLE) AS day, CAST(m.idx AS INT) AS idx, CASE WHEN lon2 IS NULL THEN round(lon, 5) END AS last_lon FROM m JOIN lg ON lg.route = m.route AND lg.idx = m.idx""")
def route_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertex that each route has passed at each half day."""
    from meridia.operators.joins import asof_join

    v = routes.legs(_vertices(spark, sf_dir)).withColumn("day", F.col("day").cast("double"))
    q = v.select("route", (F.col("day") + 0.5).alias("day")).distinct()
    got = asof_join(q, v.select("route", "day", "idx", "lon", "lon2"), ["route"], "day", ["idx", "lon", "lon2"])
    return got.select("route", "day", "idx", F.when(F.col("lon2").isNull(), F.round("lon", 5)).alias("last_lon"))


@query("WN20", f"""{_V}, q AS (SELECT DISTINCT route, day + 0.5 AS qd FROM v), m AS (SELECT q.route, q.qd, max(idx) AS idx FROM q JOIN v ON v.route = q.route AND v.day <= q.qd GROUP BY ALL),
a AS (SELECT m.route, m.qd, lon, lat, lon2, lat2, CASE WHEN day2 > day THEN (qd - day) / (day2 - day) ELSE 0.0 END AS t, acos(least(1, greatest(-1, sin(radians(lat)) * sin(radians(lat2)) + cos(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon))))) AS g FROM m JOIN lg ON lg.route = m.route AND lg.idx = m.idx),
b AS (SELECT *, sin((1 - t) * g) / sin(g) AS p, sin(t * g) / sin(g) AS q FROM a), c AS (SELECT *, p * cos(radians(lat)) * cos(radians(lon)) + q * cos(radians(lat2)) * cos(radians(lon2)) AS x, p * cos(radians(lat)) * sin(radians(lon)) + q * cos(radians(lat2)) * sin(radians(lon2)) AS y, p * sin(radians(lat)) + q * sin(radians(lat2)) AS z FROM b)
SELECT route, CAST(qd AS DOUBLE) AS day, round(CASE WHEN lon2 IS NULL OR t = 0 THEN lon ELSE degrees(atan2(y, x)) END, 5) AS lon, round(CASE WHEN lon2 IS NULL OR t = 0 THEN lat ELSE degrees(atan2(z, sqrt(x * x + y * y))) END, 5) AS lat FROM c""")
def route_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of routes at each half day."""
    v = _vertices(spark, sf_dir).withColumn("day", F.col("day").cast("double"))
    q = v.select("route", (F.col("day") + 0.5).alias("day")).distinct().withColumn("q", F.col("day"))
    return routes.positions(q, v).select("route", "day", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


@query("AG27 WN10", f"""{_V}, s AS (SELECT route, lat, idx, CASE WHEN idx = 0 THEN lon ELSE (((lon - lag(lon) OVER (PARTITION BY route ORDER BY idx) + 180) % 360) + 360) % 360 - 180 END AS st FROM v),
x AS (SELECT route, lat, sum(st) OVER (PARTITION BY route ORDER BY idx ROWS UNBOUNDED PRECEDING) AS x FROM s) SELECT route, CASE WHEN max(x) - min(x) >= 360 THEN -180.0 ELSE round(min(x), 4) END AS west, CASE WHEN max(x) - min(x) >= 360 THEN 180.0 ELSE round(max(x), 4) END AS east, min(lat) AS south, max(lat) AS north FROM x GROUP BY route""")
def route_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unwrapped boxes of routes."""
    return routes.box(_vertices(spark, sf_dir)).select("route", F.round("west", 4).alias("west"), F.round("east", 4).alias("east"), "south", "north")
