"""Grids made of orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators import coverage, grid
from meridia.plans import bind
from meridia.plans.join_queries import KM
from meridia.registry import SQL, query

_G = bind.GRID
_PTS = "SELECT c_custkey AS id, (c_custkey * 7919 % 12800) / 1e2 AS x, (c_custkey * 104729 % 6400) / 1e2 AS y FROM {customer}"
#: A full grid: every order's key modulo the cells, the sums of quantities.
_FULL = "SELECT CAST(o_orderkey % 1024 DIV 32 AS INT) AS j, CAST(o_orderkey % 32 AS INT) AS i, CAST(sum(floor(o_totalprice)) AS BIGINT) % 3000 - 500 AS value FROM {orders} GROUP BY 1, 2"
_MONTHS = "SELECT o_custkey % 50 AS cell, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, max(o_totalprice) AS value FROM {orders} GROUP BY 1, 2, 3"
_LAYERS = "SELECT user_id AS cell, event_id AS step, event_id * 37 % 256 AS value FROM {events}"


@query("IO5", f"{bind.ctes(g=_G)} SELECT j, i, value, ((i - 120) % 128 + 128) % 128 AS wi FROM g WHERE ((i - 120) % 128 + 128) % 128 < 20 AND j >= 10 AND j < 40")
def grid_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window across the seam of a grid."""
    return grid.window(bind.frame(spark, sf_dir, _G), 120, 10, 20, 30, 128).select("j", "i", "value", "wi")


@query("JN22", f"""{bind.ctes(g=_G, p=_PTS)}, q AS (SELECT id, floor(x - 0.5) AS fx, floor(y - 0.5) AS fy, x, y FROM p),
c AS (SELECT id, ((fx + a) % 128 + 128) % 128 AS i, least(63, greatest(0, fy + b)) AS j, (CASE a WHEN 1 THEN x - 0.5 - fx ELSE 1 - (x - 0.5 - fx) END) * (CASE b WHEN 1 THEN y - 0.5 - fy ELSE 1 - (y - 0.5 - fy) END) AS s FROM q, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
SELECT id, CASE WHEN count(value) = 4 THEN round(sum(value * s), 6) END AS value FROM c LEFT JOIN g USING (i, j) GROUP BY id""")
def grid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values between cells at points."""
    return grid.bilinear(bind.frame(spark, sf_dir, _PTS), bind.frame(spark, sf_dir, _G), 128, 64).select("id", F.round("value", 6).alias("value"))


@query("AG15 AG22", f"""{bind.ctes(f=_FULL)} SELECT j // 2 AS j, i // 2 AS i, sum(value) / 4 AS mean, (CAST(sum(value) AS BIGINT) + 2) >> 2 AS mip FROM f GROUP BY 1, 2 HAVING count(*) = 4""".replace("(CAST(sum(value) AS BIGINT) + 2) >> 2", "CAST(floor((sum(value) + 2) / 4) AS BIGINT)"))
def grid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and whole-number halves of 2 x 2 blocks."""
    cells = bind.frame(spark, sf_dir, _FULL)
    return grid.block_means(cells, 2).select("j", "i", "mean").join(grid.halved(cells).withColumnRenamed("value", "mip"), ["j", "i"])


@query("AG16", f"""{bind.ctes(g=_FULL)}, t AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 30 + 1) * 1.0 AS x, (s_suppkey * 11 % 30 + 1) * 1.0 AS y FROM supplier),
p AS (SELECT id, k, l, x + (k + 0.5) / 4 AS x, y + (l + 0.5) / 4 AS y FROM t, (SELECT unnest(range(4)) AS k), (SELECT unnest(range(4)) AS l)), q AS (SELECT *, floor(x - 0.5) AS fx, floor(y - 0.5) AS fy FROM p),
c AS (SELECT id, (fx + a) % 32 AS i, least(31, greatest(0, fy + b)) AS j, (CASE a WHEN 1 THEN x - 0.5 - fx ELSE 1 - (x - 0.5 - fx) END) * (CASE b WHEN 1 THEN y - 0.5 - fy ELSE 1 - (y - 0.5 - fy) END) AS s FROM q, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
SELECT id, round(sum(value * s) / 16, 6) AS mean FROM c JOIN g USING (i, j) GROUP BY id""")
def grid_texels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of sixteen samples within texels."""
    t = bind.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 30 + 1).cast("double").alias("x"), (F.col("s_suppkey") * 11 % 30 + 1).cast("double").alias("y"), F.lit(1.0).alias("size"))
    return grid.texel_means(t, bind.frame(spark, sf_dir, _FULL), 32, 32).select("id", F.round("mean", 6).alias("mean"))


@query("AG19 JN24", f"""{bind.ctes(m=_MONTHS)}, f AS (SELECT year * 100 + month AS frame, cell, CASE WHEN cell % 9 <> 0 THEN value END AS value FROM m), o AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM f WINDOW w AS (PARTITION BY frame)),
s AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 254 ELSE 1.0 END AS scale FROM o) SELECT frame, cell, CAST(CASE WHEN value IS NULL THEN 255 ELSE round_even((value - lo) / scale, 0) END AS INT) AS code, CASE WHEN value IS NOT NULL THEN round(lo + round_even((value - lo) / scale, 0) * scale, 4) END AS decoded FROM s""")
def grid_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly frames as codes of their own range, and decoded."""
    frames = bind.frame(spark, sf_dir, _MONTHS).select((F.col("year") * 100 + F.col("month")).alias("frame"), "cell", F.when(F.col("cell") % 9 != 0, F.col("value")).alias("value"))
    return grid.quantise(frames).select("frame", "cell", "code", F.round("decoded", 4).alias("decoded"))


@query("JN24", f"""{bind.ctes(m=_MONTHS)}, k AS (SELECT year * 12 + month - 1 AS frame, cell, value FROM m), a AS (SELECT frame, cell, value FROM k WHERE (cell + frame) % 5 <> 0), b AS (SELECT frame - 1 AS frame, cell, value FROM k WHERE (cell + frame) % 7 <> 0)
SELECT frame, cell, round(coalesce(a.value + (b.value - a.value) * 0.25, a.value, b.value), 6) AS value FROM a FULL JOIN b USING (frame, cell)""")
def grid_month_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames a quarter of the way from each month to the next; cells that one month lacks keep the other's value."""
    m = bind.frame(spark, sf_dir, _MONTHS).select((F.col("year") * 12 + F.col("month") - 1).alias("frame"), "cell", "value")
    here, there = m.where((F.col("cell") + F.col("frame")) % 5 != 0), m.where((F.col("cell") + F.col("frame")) % 7 != 0).withColumn("frame", F.col("frame") - 1)
    return grid.blend(here, there, 0.25, ("frame", "cell")).select("frame", "cell", F.round("value", 6).alias("value"))


@query("AG19", f"{bind.ctes(m=_MONTHS)} SELECT cell, year, round(avg(value), 6) AS mean FROM m GROUP BY cell, year HAVING count(*) = 12")
def grid_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of complete years."""
    return grid.annual_means(bind.frame(spark, sf_dir, _MONTHS)).select("cell", "year", F.round("mean", 6).alias("mean"))


@query("WN16", f"{bind.ctes(f=_FULL)}, r AS (SELECT f.j, f.i, f.value, f.value - (coalesce(l.value, 0) + coalesce(u.value, 0) - coalesce(d.value, 0)) AS r FROM f LEFT JOIN f l ON l.j = f.j AND l.i = f.i - 1 LEFT JOIN f u ON u.j = f.j - 1 AND u.i = f.i LEFT JOIN f d ON d.j = f.j - 1 AND d.i = f.i - 1) SELECT j, i, CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END AS residual, CAST(value AS BIGINT) AS back FROM r")
def grid_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zigzag residuals of the plane predictor, and values restored from them."""
    r = grid.predicted(bind.frame(spark, sf_dir, _FULL)).select("j", "i", "residual")
    return r.join(grid.restored(r).withColumnRenamed("value", "back"), ["j", "i"])


@query("WN15", f"{bind.ctes(l=_LAYERS)} SELECT cell, step, ((value - lag(value, 1, 0) OVER (PARTITION BY cell ORDER BY step)) % 256 + 256) % 256 AS delta, value AS back FROM l")
def grid_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between layers modulo 256, and layers restored from them."""
    return grid.undeltas(grid.deltas(bind.frame(spark, sf_dir, _LAYERS)).drop("value")).select("cell", "step", "delta", F.col("value").alias("back"))


@query("AG17", f"{bind.ctes(f=_FULL)}, t AS (SELECT j // 8 * 4 + i // 8 AS tile, value / 7.0 AS height FROM f) SELECT tile, round(min(height), 6) AS low, CAST(floor(min(height)) AS BIGINT) AS floor_m, CAST(ceil(max(height)) AS BIGINT) AS ceil_m, round(least(min(height), 0), 6) AS low0 FROM t GROUP BY tile")
def grid_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of tiles' heights in whole metres, and with the sea level."""
    t = bind.frame(spark, sf_dir, _FULL).select((F.floor(F.col("j") / 8) * 4 + F.floor(F.col("i") / 8)).alias("tile"), (F.col("value") / 7).alias("height"))
    return grid.bounds(t).select("tile", F.round("low", 6).alias("low"), "floor_m", "ceil_m", F.round("low0", 6).alias("low0"))


@query("AG18", f"{bind.ctes(f=_FULL)}, t AS (SELECT max(hi - lo) AS span FROM (SELECT min(value) AS lo, max(value) AS hi FROM f GROUP BY j // 8, i // 8)) SELECT min(s) AS step FROM t, (SELECT unnest([1, 2, 5, 10, 20, 50]) AS s) WHERE ceil(span / s) < 256")
def grid_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest step at which all tiles fit the codes."""
    groups = bind.frame(spark, sf_dir, _FULL).groupBy(F.floor(F.col("j") / 8), F.floor(F.col("i") / 8)).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return grid.smallest_step(groups, 256, [1, 2, 5, 10, 20, 50])


@query("TK14 JN28", f"""{bind.ctes(g=_G)}, w AS (SELECT i AS x, j AS y FROM g WHERE value > 2500), l AS (SELECT DISTINCT lv AS level, x // (1 << (7 - lv)) AS x, y // (1 << (7 - lv)) AS y FROM w, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS lv)) SELECT CAST(level AS INT) AS level, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM l UNION ALL SELECT 0, 0, 0""")
def grid_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles kept level by level where a high cell lies in them."""
    wanted = bind.frame(spark, sf_dir, _G).where("value > 2500").select(F.col("i").alias("x"), F.col("j").alias("y"))
    return grid.grown(spark.range(1).select(F.lit(0).alias("x"), F.lit(0).alias("y")), wanted, 7)


@query("AG28", "SELECT CAST(CASE WHEN o_orderkey > 0 THEN (o_orderkey - 1) // 32768 + 1 ELSE o_orderkey // 32768 END AS BIGINT) AS bucket, count(DISTINCT o_orderkey) AS bits FROM orders GROUP BY 1")
def grid_presence_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed presence of all order keys."""
    ids = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return grid.presence(ids).select("bucket", F.col("bits").cast("long").alias("bits"))


@query("AG28", SQL["grid_presence_whole"])
def grid_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of grid_presence_whole."""
    return grid_presence_whole(spark, sf_dir)


_SAMPLES = "SELECT s_nationkey AS tile, CAST(s_suppkey * 7 % 64 AS INT) AS j, CAST((s_suppkey * 3 % 20 + 118) % 128 AS INT) AS i FROM {supplier}"


@query("AG30", f"""{bind.ctes(s=_SAMPLES)}, d AS (SELECT DISTINCT tile, i FROM s), n AS (SELECT tile, i, coalesce(lead(i) OVER (PARTITION BY tile ORDER BY i), min(i) OVER (PARTITION BY tile)) AS nx FROM d),
a AS (SELECT tile, arg_max((nx, i), (CASE WHEN nx > i THEN nx - i ELSE nx - i + 128 END, -i)) AS a FROM n GROUP BY tile) SELECT tile, min(j) - 2 AS j0, max(j) + 2 AS j1, CAST((any_value(a[1]) + 126) % 128 AS INT) AS i0, CAST((any_value(a[2]) + 2) % 128 AS INT) AS i1 FROM s JOIN a USING (tile) GROUP BY tile""")
def grid_source_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of source cells that tiles need, across the seam."""
    return grid.source_window(bind.frame(spark, sf_dir, _SAMPLES), 128, 2)


@query("AG23 AG31", f"""{bind.ctes(f=_FULL)} SELECT a.j, a.i, CAST(CASE WHEN abs(s / 4.0) - floor(abs(s / 4.0)) >= 0.5 THEN floor(abs(s / 4.0)) + 1 ELSE floor(abs(s / 4.0)) END * sign(s) AS BIGINT) AS value, p >= 3 AS chosen FROM
(SELECT x.j, x.i, x.value + l.value + u.value + d.value AS s, (x.value > 0)::INT + (l.value > 0)::INT + (u.value > 0)::INT + (d.value > 0)::INT AS p FROM f x JOIN f l ON l.j = x.j AND l.i = x.i - 1 JOIN f u ON u.j = x.j - 1 AND u.i = x.i JOIN f d ON d.j = x.j - 1 AND d.i = x.i - 1) a""")
def grid_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of corners that four texels share, and a vote of three of the four."""
    cells = bind.frame(spark, sf_dir, _FULL)
    around = cells.select(F.explode(F.array(*[F.struct((F.col("j") + a).alias("j"), (F.col("i") + b).alias("i")) for a in (0, 1) for b in (0, 1)])).alias("tile"), (F.col("value") > 0).alias("flag"))
    chosen = grid.votes(around, 3).select("tile.j", "tile.i", "chosen")
    return grid.corner_means(cells, 32).join(chosen, ["j", "i"])


# Corners of texels as whole-numbered points of a cube, on which all faces agree; nothing here knows of face sides.
_CUBE = "fv(face, ox, oy, oz, sx, sy, sz, tx, ty, tz) AS (VALUES " + ", ".join(str((f, *o, *s, *t)) for f, (o, s, t) in enumerate(geo.FACES)) + ")"


def _point(n: int, i: str, j: str) -> str:
    return "(" + ", ".join(f"{n} * o{c} + (2 * ({i}) - {n}) * s{c} + (2 * ({j}) - {n}) * t{c}" for c in "xyz") + ")"


_FACE_TEXELS = "SELECT CAST(o_orderkey % 6 AS INT) AS face, CAST(o_orderkey DIV 6 % 16 AS INT) AS j, CAST(o_orderkey DIV 96 % 16 AS INT) AS i, CAST(sum(CASE WHEN o_orderkey % 7 < 3 THEN -o_custkey ELSE o_custkey END) AS BIGINT) AS value FROM {orders} GROUP BY 1, 2, 3"


@query("AG23", f"""{bind.ctes(x=_FACE_TEXELS)}, {_CUBE}, o AS (SELECT face, j + dj AS j, i + di AS i, value FROM x, (SELECT unnest([0, 1]) AS dj), (SELECT unnest([0, 1]) AS di)),
v AS (SELECT {_point(16, "i", "j")} AS p, value FROM o JOIN fv USING (face)),
s AS (SELECT p, sum(value) AS s, count(*) AS texels FROM v GROUP BY p),
a AS (SELECT face, j, i, {_point(16, "i", "j")} AS p FROM fv, (SELECT unnest(range(17)) AS j), (SELECT unnest(range(17)) AS i) WHERE j IN (0, 16) OR i IN (0, 16)),
w AS (SELECT *, min(face) OVER (PARTITION BY p) AS owner_face FROM a)
SELECT CAST(face AS INT) AS face, CAST(j AS INT) AS j, CAST(i AS INT) AS i, CAST(owner_face AS INT) AS owner_face, texels, CAST(CASE WHEN abs(s / texels) - floor(abs(s / texels)) >= 0.5 THEN floor(abs(s / texels)) + 1 ELSE floor(abs(s / texels)) END * sign(s) AS BIGINT) AS value FROM w JOIN s USING (p)""")
def grid_face_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of corners on the edges of six faces, one for all faces that share them."""
    got = grid.face_corner_values(bind.frame(spark, sf_dir, _FACE_TEXELS), 16)
    return got.select("face", "j", "i", F.col("owner.face").alias("owner_face"), "texels", "value")


_TILES = "SELECT o_orderkey AS k, CAST(o_orderkey % 6 AS INT) AS face, CAST(o_orderkey DIV 6 % 16 AS INT) AS x, CAST(o_orderkey DIV 96 % 16 AS INT) AS y FROM {orders}"


@query("SC18", f"""{bind.ctes(k=_TILES)}, {_CUBE}, t AS (SELECT face, x, y, side FROM (SELECT unnest(range(6)) AS face), (SELECT unnest(range(16)) AS x), (SELECT unnest(range(16)) AS y), (SELECT unnest(range(4)) AS side)),
e AS (SELECT t.*, CASE side WHEN 0 THEN {_point(16, "x", "y")} WHEN 1 THEN {_point(16, "x + 1", "y")} WHEN 2 THEN {_point(16, "x", "y")} ELSE {_point(16, "x", "y + 1")} END AS p,
  CASE side WHEN 0 THEN {_point(16, "x", "y + 1")} WHEN 1 THEN {_point(16, "x + 1", "y + 1")} WHEN 2 THEN {_point(16, "x + 1", "y")} ELSE {_point(16, "x + 1", "y + 1")} END AS q FROM t JOIN fv USING (face)),
n AS (SELECT a.face, a.x, a.y, a.side, b.face AS face2, b.x AS x2, b.y AS y2, b.side AS side2, a.p <> b.p AS turned FROM e a JOIN e b ON least(a.p, a.q) = least(b.p, b.q) AND greatest(a.p, a.q) = greatest(b.p, b.q) AND (a.face, a.x, a.y) <> (b.face, b.x, b.y))
SELECT k.k, CAST(n.side AS INT) AS side, CAST(face2 AS INT) AS face2, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2, CAST(side2 AS INT) AS side2, turned FROM k JOIN n USING (face, x, y)""")
def sc_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles across each side, over the faces' edges too."""
    return grid.neighbours(bind.frame(spark, sf_dir, _TILES), 4).drop("face", "x", "y")


_DISCS = """SELECT s_suppkey AS id, (s_suppkey * 7919 % 36000) / 1e2 - 180 AS lon, (s_suppkey * 104729 % 17800) / 1e2 - 89 AS lat,
  CAST(200 + s_suppkey % 13 * 60 AS DOUBLE) AS r3, CASE WHEN s_suppkey % 4 > 0 THEN CAST(30 + s_suppkey % 7 * 25 AS DOUBLE) END AS r4, CAST(20 + s_suppkey % 5 AS DOUBLE) AS r5 FROM {supplier} WHERE s_suppkey % 5 > 0"""
#: A texel more than the border on each side, of a tile of 256 texels.
_REACH = 5 / 256
# Tiles by brute force: each tile of the levels against each disc's and each cell's position.
_ALL_TILES = f"""{_CUBE}, tl AS (SELECT face, level, x, y, CAST(1 << level AS DOUBLE) AS n FROM (SELECT unnest(range(6)) AS face), (SELECT unnest(range(6)) AS level), (SELECT unnest(range(1 << level)) AS x), (SELECT unnest(range(1 << level)) AS y))"""
_BY_DISCS = f"""ms AS (SELECT tl.*, tan((((x + a / 4.0) / n) - 0.5) * pi() / 2) AS u, tan((((y + b / 4.0) / n) - 0.5) * pi() / 2) AS v FROM tl, (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b) WHERE level >= 3),
mp AS (SELECT ms.face, level, x, y, ox + u * sx + v * tx AS px, oy + u * sy + v * ty AS py, oz + u * sz + v * tz AS pz FROM ms JOIN fv USING (face)),
ml AS (SELECT face, level, x, y, degrees(atan2(py, px)) AS plon, degrees(atan2(pz, sqrt(px * px + py * py))) AS plat FROM mp),
dr AS (SELECT id, lon, lat, 3 AS level, r3 AS r FROM d UNION ALL SELECT id, lon, lat, 4, r4 FROM d WHERE r4 IS NOT NULL UNION ALL SELECT id, lon, lat, 5, r5 FROM d),
dn AS (SELECT DISTINCT ml.face, ml.level, x, y FROM ml JOIN dr ON ml.level = dr.level AND abs(plat - lat) <= 10 WHERE {KM.format("lon", "lat", "plon", "plat")} <= r),
du AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS dx, cos(radians(lat)) * sin(radians(lon)) AS dy, sin(radians(lat)) AS dz FROM dr),
df AS (SELECT du.*, face, dx * ox + dy * oy + dz * oz AS w, 0.5 + 2 / pi() * atan((dx * sx + dy * sy + dz * sz) / (dx * ox + dy * oy + dz * oz)) AS s, 0.5 + 2 / pi() * atan((dx * tx + dy * ty + dz * tz) / (dx * ox + dy * oy + dz * oz)) AS t FROM du, fv WHERE dx * ox + dy * oy + dz * oz > 0),
dc AS (SELECT DISTINCT face, level, floor(s * (1 << level)) AS x, floor(t * (1 << level)) AS y FROM df WHERE s BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1),
wi AS (SELECT * FROM dn UNION SELECT * FROM dc)"""
_BY_CELLS = f"""cu AS (SELECT cos(radians(lat)) * cos(radians(lon)) AS dx, cos(radians(lat)) * sin(radians(lon)) AS dy, sin(radians(lat)) AS dz FROM c),
cf AS (SELECT face, 0.5 + 2 / pi() * atan((dx * sx + dy * sy + dz * sz) / (dx * ox + dy * oy + dz * oz)) AS s, 0.5 + 2 / pi() * atan((dx * tx + dy * ty + dz * tz) / (dx * ox + dy * oy + dz * oz)) AS t FROM cu, fv WHERE dx * ox + dy * oy + dz * oz > 0),
wa AS (SELECT DISTINCT tl.face, level, x, y FROM tl JOIN cf ON cf.face = tl.face AND s >= (x - {_REACH}) / n AND s <= (x + 1 + {_REACH}) / n AND t >= (y - {_REACH}) / n AND t <= (y + 1 + {_REACH}) / n)"""
_HIGH = f"SELECT -180 + (i + 0.5) * 360 / 128 AS lon, -90 + (j + 0.5) * 180 / 64 AS lat FROM ({_G}) AS g WHERE value > 2600"


def _discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    return bind.frame(spark, sf_dir, _DISCS).select("lon", "lat", F.array(none, none, none, "r3", "r4", "r5").alias("radii"))


@query("JN16", f"""{bind.ctes(d=_DISCS)}, {_ALL_TILES}, {_BY_DISCS} SELECT CAST(face AS INT) AS face, CAST(level AS INT) AS level, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM wi""")
def grid_disc_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of three levels that discs reach, or whose centre lies in them, each level with radii of its own."""
    return coverage.by_discs(_discs(spark, sf_dir), 5, 5)


@query("JN28", f"""{bind.ctes(c=_HIGH)}, {_ALL_TILES}, {_BY_CELLS} SELECT CAST(face AS INT) AS face, CAST(level AS INT) AS level, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM wa""")
def grid_cell_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of six levels that, widened by their border and a texel, hold the centre of a high cell."""
    return coverage.by_cells(bind.frame(spark, sf_dir, _HIGH), 5, _REACH)


@query("TK14 JN16 JN28", f"""{bind.ctes(c=_HIGH, d=_DISCS)}, {_ALL_TILES}, {_BY_CELLS}, {_BY_DISCS},
g3 AS (SELECT face, level, x, y FROM wa WHERE level = 3), g4 AS (SELECT wa.* FROM wa JOIN wi USING (face, level, x, y) WHERE level = 4 AND (face, x // 2, y // 2) IN (SELECT (face, x, y) FROM g3)),
g5 AS (SELECT wa.* FROM wa JOIN wi USING (face, level, x, y) WHERE level = 5 AND (face, x // 2, y // 2) IN (SELECT (face, x, y) FROM g4)),
o AS (SELECT face, level, x, y FROM tl WHERE level < 3 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4 UNION ALL SELECT * FROM g5) SELECT CAST(face AS INT) AS face, CAST(level AS INT) AS level, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM o""")
def grid_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile of three levels, then the children of kept tiles near high cells, and from level 4 on in the discs too."""
    high = coverage.by_cells(bind.frame(spark, sf_dir, _HIGH), 5, _REACH)
    return coverage.grow(spark, 5, 3, high, coverage.by_discs(_discs(spark, sf_dir), 5, 5), 4)


# Heights of tiles, with their bounds as a file would bear them: some absent, wrong, twice there, of no tile, or wider than the parent's.
_TILE_HEIGHTS = "SELECT CAST(p_partkey % 6 AS INT) AS face, CAST(3 + p_partkey % 2 AS INT) AS level, CAST(p_partkey DIV 12 % 8 AS INT) AS x, CAST(p_partkey DIV 96 % 8 AS INT) AS y, min(p_retailprice) AS low, max(p_retailprice) AS high, min(p_partkey) AS k FROM {part} GROUP BY 1, 2, 3, 4"
_BOUNDS = f"""SELECT face, level, x, y, CAST(floor(low) AS BIGINT) - CASE WHEN level = 3 THEN 400 WHEN k % 17 = 0 THEN 1 ELSE 0 END AS low, CAST(ceil(high) AS BIGINT) + CASE WHEN level = 3 THEN 400 WHEN k % 19 = 0 THEN 3000 ELSE 0 END AS high FROM ({_TILE_HEIGHTS}) AS h WHERE k % 11 <> 0
UNION ALL SELECT face, level, x, y, CAST(floor(low) AS BIGINT), CAST(ceil(high) AS BIGINT) FROM ({_TILE_HEIGHTS}) AS h WHERE k % 13 = 0"""


@query("VQ7 AG17", f"""{bind.ctes(h=_TILE_HEIGHTS, b=_BOUNDS)}, av AS (SELECT face, level, x, y FROM h WHERE k % 23 <> 0), q AS (SELECT face, level, x, y, count(*) AS n, min(low) AS low, max(high) AS high, bool_or(low > high) AS bad FROM b GROUP BY ALL),
o AS (SELECT face, level, x, y, 'absent' AS fault FROM av WHERE NOT EXISTS (SELECT 1 FROM q WHERE (q.face, q.level, q.x, q.y) = (av.face, av.level, av.x, av.y))
UNION ALL SELECT face, level, x, y, 'unavailable' FROM q WHERE NOT EXISTS (SELECT 1 FROM av WHERE (q.face, q.level, q.x, q.y) = (av.face, av.level, av.x, av.y))
UNION ALL SELECT face, level, x, y, 'repeated' FROM q WHERE n > 1 UNION ALL SELECT face, level, x, y, 'empty' FROM q WHERE bad
UNION ALL SELECT face, level, x, y, 'range' FROM q JOIN h USING (face, level, x, y) WHERE n = 1 AND level = 4 AND (q.low <> floor(h.low) OR q.high <> ceil(h.high))
UNION ALL SELECT c.face, c.level, c.x, c.y, 'parent' FROM q c JOIN q p ON p.face = c.face AND p.level = c.level - 1 AND p.x = c.x // 2 AND p.y = c.y // 2 WHERE c.low < p.low OR c.high > p.high) SELECT * FROM o""")
def audit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted faults of tiles' bounds; ranges are held against the heights of the deepest level, whose bounds are of the tile alone."""
    heights = bind.frame(spark, sf_dir, _TILE_HEIGHTS)
    return coverage.bound_faults(bind.frame(spark, sf_dir, _BOUNDS), heights.where("k % 23 <> 0"), heights.where("level = 4"))


@query("AG21", f"{bind.ctes(g=_G)} SELECT j % 4 AS grp, round(sum(6371.0088 * 6371.0088 * (2 * pi() / 128) * (sin(radians(-90 + (j + 1) * 180.0 / 64)) - sin(radians(-90 + j * 180.0 / 64)))), 3) AS km2 FROM g WHERE value > 0 GROUP BY 1")
def grid_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of cells above zero by group."""
    cells = bind.frame(spark, sf_dir, _G).where("value > 0")
    return cells.groupBy((F.col("j") % 4).alias("grp")).agg(F.round(F.sum(grid.km2(F.col("j"), 64, 128)), 3).alias("km2"))
