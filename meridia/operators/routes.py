"""Dated routes: densified legs, positions at a time, distances on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import cal
from meridia.functions.geo import along_arc, great_circle_km, with_arc
from meridia.operators.joins import asof_join


def legs(vertices: DataFrame) -> DataFrame:
    """vertices(route, idx, lon, lat, day) with the next vertex: lon2, lat2, day2, and km to it; a route's last vertex has none."""
    w = Window.partitionBy("route").orderBy("idx")
    out = vertices
    for c in ("lon", "lat", "day"):
        out = out.withColumn(f"{c}2", F.lead(c).over(w))
    return out.withColumn("km", great_circle_km("lon", "lat", "lon2", "lat2"))


def densified(vertices: DataFrame, most_km: float) -> DataFrame:
    """route, idx, part, n, lon, lat, day: points at most `most_km` apart along great circles, dates in proportion; n numbers a route's points.

    Great circles are worked out per leg, before its points are made.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.round(F.col("km") / most_km, 9))).cast("int")
    before = F.sum("parts").over(Window.partitionBy("route").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    steps = with_arc(legs(vertices).withColumn("parts", F.coalesce(parts, F.lit(1))).withColumn("before", F.coalesce(before, F.lit(0))), "lon", "lat", "lon2", "lat2")
    points = steps.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("share", F.col("part") / F.col("parts"))
    day = F.when(F.col("part") == 0, F.col("day").cast("double")).otherwise(F.col("day") + (F.col("day2") - F.col("day")) * F.col("share"))
    return along_arc(points, "share", "lon", "lat").select("route", "idx", "part", (F.col("before") + F.col("part")).cast("int").alias("n"), "lon", "lat", day.alias("day"))


def positions(queries: DataFrame, vertices: DataFrame) -> DataFrame:
    """queries(q, route, day) with lon, lat: between the last vertex at or before the day (the last of equal days) and the next; null before the first, held after the last."""
    v = legs(vertices).select("route", "idx", "lon", "lat", "lon2", "lat2", "day", F.col("day").alias("day0"), "day2")
    got = asof_join(queries, v, ["route"], "day", ["idx", "lon", "lat", "lon2", "lat2", "day0", "day2"])
    share = F.when(F.col("day2") > F.col("day0"), (F.col("day") - F.col("day0")) / (F.col("day2") - F.col("day0"))).otherwise(0.0)
    return along_arc(with_arc(got.withColumn("share", share), "lon", "lat", "lon2", "lat2"), "share", "lon", "lat").select("q", "route", "day", "lon", "lat")


def route_rows(features: DataFrame) -> DataFrame:
    """A row for each vertex of sources.tables.read_routes() features (one without a vertex, with idx null, where there is none).

    fid, kind, type, epoch and day (day numbers, null for no ISO date), idx, coordinates (how many), lon, lat, leg, name, and the numbers of
    points, dates, legs and names.
    """
    day = lambda d: F.when(d["d"] <= cal.month_length(d["y"], d["m"]), cal.gregorian_day(d["y"], d["m"], d["d"]))
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    counts = [size("points").alias("n"), size("dates").alias("dates_n"), size("legs").alias("legs_n"), size("names").alias("names_n")]
    rows = features.select("fid", "kind", "type", "epoch", "dates", "legs", "names", *counts, F.posexplode_outer("points").alias("idx", "p"))
    at = F.col("idx")
    rows = rows.select("fid", "kind", "type", "epoch", "n", "dates_n", "legs_n", "names_n", "idx", size("p").alias("coordinates"), F.get("p", 0).alias("lon"), F.get("p", 1).alias("lat"), F.get("dates", at).alias("date"), F.get("legs", at).alias("leg"), F.get("legs", F.col("n") - 2).alias("last_leg"), F.get("names", at).alias("name"))
    rows = rows.withColumn("_e", cal.parse_iso("epoch")).withColumn("_d", cal.parse_iso("date"))
    return rows.withColumn("epoch", day(F.col("_e"))).withColumn("day", day(F.col("_d"))).drop("_e", "_d", "date")


#: What a route may not be, in the order in which faults count.
ROUTE_FAULTS = ("no route", "too few vertices", "place", "dates", "no date", "backward", "legs", "leg", "names")


def route_faults(rows: DataFrame) -> DataFrame:
    """fid, fault (the first of ROUTE_FAULTS that holds) of route_rows()."""
    before = F.lag("day").over(Window.partitionBy("fid").orderBy("idx"))
    leg, idx, n = F.col("leg"), F.col("idx"), F.col("n")
    sound = F.coalesce((leg["from"] == idx) & (leg["to"] == idx + 1) & leg["sea"].isNotNull() & leg["uncertain"].isNotNull(), F.lit(False))
    faulty = (
        ~F.coalesce((F.col("kind") == "route") & (F.col("type") == "LineString"), F.lit(False)),
        n < 2,
        (F.col("coordinates") != 2) | F.col("lon").isNull() | F.col("lat").isNull() | ~F.col("lon").between(-180, 180) | ~F.col("lat").between(-90, 90),
        F.col("dates_n") != n,
        F.col("day").isNull() | F.col("epoch").isNull(),
        F.coalesce(F.col("day") < F.col("before"), F.lit(False)),
        F.col("legs_n") != n - 1,
        (idx < n - 1) & ~sound,
        (F.col("names_n") >= 0) & (F.col("names_n") != n),
    )
    code = F.coalesce(*[F.when(f, k) for k, f in enumerate(faulty)])
    first = rows.withColumn("before", before).select("fid", code.alias("code")).groupBy("fid").agg(F.min("code").alias("code")).where("code is not null")
    return first.select("fid", F.element_at(F.array(*map(F.lit, ROUTE_FAULTS)), F.col("code") + 1).alias("fault"))


def route_vertices(rows: DataFrame) -> DataFrame:
    """route, idx, lon, lat, day (from the route's epoch), name, flags (1 uncertain, 2 at sea; of the leg that leaves, at the end of the one that arrives) of faultless route_rows()."""
    leg = F.coalesce("leg", "last_leg")
    flags = leg["uncertain"].cast("int") + 2 * leg["sea"].cast("int")
    return rows.select(F.col("fid").alias("route"), "idx", "lon", "lat", (F.col("day") - F.col("epoch")).alias("day"), F.when(F.col("name") != "", F.col("name")).alias("name"), flags.alias("flags"))


def sailed(vertices: DataFrame) -> DataFrame:
    """route, idx, day, km sailed up to each vertex."""
    before = F.coalesce(F.lag("km").over(Window.partitionBy("route").orderBy("idx")), F.lit(0.0))
    w = Window.partitionBy("route").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return legs(vertices).withColumn("b", before).select("route", "idx", "day", F.sum("b").over(w).alias("km"))


def box(vertices: DataFrame) -> DataFrame:
    """route, west, east, south, north of a track: longitudes are unwrapped along it; a span of 360 degrees or more is the whole circle."""
    w = Window.partitionBy("route").orderBy("idx")
    turn = F.pmod(F.col("lon") - F.lag("lon").over(w) + 180, F.lit(360.0)) - 180
    rows = vertices.withColumn("step", F.coalesce(turn, F.col("lon"))).withColumn("x", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("route").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("lat").alias("south"), F.max("lat").alias("north"))
    whole = F.col("b") - F.col("a") >= 360
    return out.select("route", F.when(whole, -180.0).otherwise(F.col("a")).alias("west"), F.when(whole, 180.0).otherwise(F.col("b")).alias("east"), "south", "north")
