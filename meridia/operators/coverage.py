"""Which tiles of the cube sphere are kept: those that discs or cells reach, grown level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.shared import stored

TILE = ["face", "level", "x", "y"]
#: Kilometres by which a bound may be off by rounding.
SLACK_KM = 1e-6


def faces(spark: SparkSession) -> DataFrame:
    """The six tiles of level 0."""
    return spark.range(6).select(F.col("id").cast("int").alias("face"), F.lit(0).alias("level"), F.lit(0).alias("x"), F.lit(0).alias("y"))


def halves(tiles: DataFrame) -> DataFrame:
    """The rows of tiles(face, level, x, y, ...), one for each of the four tiles of the next level."""
    four = F.array(*[F.struct((2 * F.col("x") + i).cast("int").alias("x"), (2 * F.col("y") + j).cast("int").alias("y")) for j in (0, 1) for i in (0, 1)])
    return tiles.withColumn("_t", F.explode(four)).withColumns({"level": F.col("level") + 1, "x": F.col("_t.x"), "y": F.col("_t.y")}).drop("_t")


def by_discs(discs: DataFrame, levels: int, mesh: int = 33) -> DataFrame:
    """face, level, x, y of the tiles, down to `levels`, that lie in one of discs(lon, lat, radii): of the tile's mesh x mesh points one is within
    the disc's radius, or the disc's centre is in the tile.

    radii is an array of kilometres by level from 0; null, or past its end, is a level of which the disc says nothing. A disc follows those
    tiles alone that a circle around the tile shows to be in reach, so what it looks at is bounded by what it covers, and
    nothing is joined. Discs without a place or a radius reach nothing.
    """
    rows = discs.where("lon is not null and lat is not null").select("radii", geo.unit("lon", "lat").alias("u")).withColumn("at", geo.cube(F.col("u.x"), F.col("u.y"), F.col("u.z")))
    # The disc's direction along the face's three axes, in which a tile's points are (1, tan, tan): all distances come from these.
    of = F.array(*[F.struct(F.lit(f).alias("face"), *[geo.along(F.col("u"), f, k).alias(c) for k, c in enumerate("wab")]) for f in range(6)])
    rows = rows.withColumn("_f", F.explode(of)).select("radii", "at", "_f.*", F.lit(0).alias("level"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    out = None
    for level in range(levels + 1):
        n = 1 << level
        rows = rows if not level else halves(rows)
        tan = lambda c, share: F.tan(((F.col(c) + share) / n - 0.5) * 1.5707963267948966)  # noqa: B023, E731
        # Along s and t alike a face of equal angles is nowhere wider than at its middle, so no point of a tile is further from its own middle.
        wide = geo.EARTH_KM * 1.5707963267948966 / n
        disc = F.struct("w", "a", "b")
        away = _km(_chord2(_unit(tan("x", 0.5), tan("y", 0.5)), disc))
        rows = rows.withColumns({"_away": away, "_far": F.array_max(F.slice("radii", level + 1, levels + 1)), "_r": F.get("radii", F.lit(level))})
        rows = rows.where(F.col("_away") <= F.greatest("_far", F.lit(0.0)) + wide + SLACK_KM)
        inside = (F.col("at.face") == F.col("face")) & (geo.tile_index(F.col("at.s"), level) == F.col("x")) & (geo.tile_index(F.col("at.t"), level) == F.col("y"))
        limit = F.pow(2 * F.sin(F.least(F.col("_r") / (2 * geo.EARTH_KM), F.lit(1.5707963267948966))), F.lit(2.0))
        points = F.sequence(F.lit(0), F.lit(mesh * mesh - 1))
        near = F.exists(points, lambda k: _chord2(_unit(tan("x", F.pmod(k, F.lit(mesh)) / (mesh - 1)), tan("y", F.floor(k / mesh) / (mesh - 1))), disc) <= F.col("_limit"))  # noqa: B023
        rows = rows.withColumn("_limit", limit)
        none = F.col("_r").isNull() | (F.col("_away") > F.col("_r") + wide + SLACK_KM)
        whole = F.col("_away") + wide + SLACK_KM <= F.col("_r")
        hit = F.when(inside, F.col("_r").isNotNull()).when(none, False).when(whole, True).otherwise(near)
        rows = stored(rows.withColumn("hit", hit).select("radii", "at", "w", "a", "b", *TILE, "hit"), "frontier")
        hits = rows.where("hit").select(*TILE).distinct()
        out = hits if out is None else out.unionByName(hits)
    return out


def _unit(a: Column, b: Column) -> Column:
    """The direction of (1, a, b)."""
    q = F.sqrt(1 + a * a + b * b)
    return F.struct((1 / q).alias("w"), (a / q).alias("a"), (b / q).alias("b"))


def _chord2(p: Column, q: Column) -> Column:
    """The squared chord between two directions."""
    return sum(((p[c] - q[c]) * (p[c] - q[c]) for c in "ab"), (p["w"] - q["w"]) * (p["w"] - q["w"]))


def _km(chord2: Column) -> Column:
    return 2 * geo.EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(chord2) / 2))


def by_cells(cells: DataFrame, levels: int, reach: float) -> DataFrame:
    """face, level, x, y of the tiles, down to `levels`, that hold one of the points of cells(lon, lat), or have one within `reach` of a tile's side, its
    own plane of face positions being carried on beyond its sides, and beyond the face's.

    One pass: a point is sent to its few tiles of each level, and these are made distinct before they are shuffled. Points with a null are left out.
    """
    u = F.col("u")
    placed = cells.where("lon is not null and lat is not null").select(geo.unit("lon", "lat").alias("u"))
    on = F.array(*[F.struct(F.lit(f).alias("face"), geo.along(u, f, 0).alias("w"), geo.along(u, f, 1).alias("a"), geo.along(u, f, 2).alias("b")) for f in range(6)])
    rows = placed.select(F.explode(F.filter(on, lambda p: p["w"] > 0)).alias("p"))
    at = lambda c: 0.5 + 2 / 3.141592653589793 * F.atan(F.col(f"p.{c}") / F.col("p.w"))
    rows = rows.select(F.col("p.face").alias("face"), at("a").alias("s"), at("b").alias("t")).where(F.col("s").between(-reach, 1 + reach) & F.col("t").between(-reach, 1 + reach))
    each = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(1 << k).alias("n")) for k in range(levels + 1)])
    rows = rows.withColumn("_l", F.explode(each)).select("face", "s", "t", "_l.level", F.col("_l.n").alias("_n"))
    first = lambda c: F.greatest(F.lit(0), F.ceil(F.col(c) * F.col("_n") - 1 - reach).cast("int"))
    last = lambda c: F.least(F.col("_n") - 1, F.floor(F.col(c) * F.col("_n") + reach).cast("int"))
    rows = rows.withColumns({"_x0": first("s"), "_x1": last("s"), "_y0": first("t"), "_y1": last("t")}).where("_x0 <= _x1 and _y0 <= _y1")
    rows = rows.withColumn("x", F.explode(F.sequence("_x0", "_x1"))).withColumn("y", F.explode(F.sequence("_y0", "_y1")))
    return rows.select(*TILE).distinct()


def grow(spark: SparkSession, levels: int, everywhere: int, wanted: DataFrame, within: DataFrame | None = None, bounded: int = 0) -> DataFrame:
    """face, level, x, y: every tile above level `everywhere`, then level by level the children of tiles kept that are among wanted(face, level, x, y), and, from
    level `bounded` on, among those of `within` too, where it is given."""
    kept = faces(spark)
    out = kept
    wanted = stored(wanted.select(*TILE).distinct(), "wanted")
    within = None if within is None else stored(within.select(*TILE).distinct(), "within")
    for level in range(1, levels + 1):
        kids = halves(kept)
        if level >= everywhere:
            kids = kids.join(wanted, TILE, "left_semi")
            if within is not None and level >= bounded:
                kids = kids.join(within, TILE, "left_semi")
        kept = stored(kids.select(*TILE), "kept")
        out = out.unionByName(kept)
    return out


def without_parent(tiles: DataFrame) -> DataFrame:
    """Tiles below level 0 whose parent is not among the tiles: there are none in what grow() gives."""
    up = tiles.select("face", (F.col("level") + 1).alias("level"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    rows = tiles.where("level > 0").withColumns({"_x": F.shiftright("x", 1), "_y": F.shiftright("y", 1)})
    return rows.join(up, ["face", "level", "_x", "_y"], "left_anti").select(*TILE)


def bound_faults(bounds: DataFrame, available: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """face, level, x, y, fault of bounds(face, level, x, y, low, high), one for each tile that is available(face, level, x, y).

    'absent': an available tile without a bound; 'unavailable': a bound of none; 'repeated': several bounds; 'empty': a null, or low above high; 'range': not the
    whole metres around the tile's heights(face, level, x, y, low, high), where it has some; 'parent': a child's bound goes beyond its parent's. A tile may have
    several faults. Rows with a null in a tile's numbers are taken as bounds of none.
    """
    said = bounds.groupBy(*TILE).agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or(F.col("low").isNull() | F.col("high").isNull() | (F.col("low") > F.col("high"))).alias("empty"))
    rows = stored(said.withColumn("said", F.lit(True)).join(available.select(*TILE).distinct().withColumn("there", F.lit(True)), TILE, "full"), "bounds")
    told = rows
    range_ = F.lit(False)
    if heights is not None:
        told = rows.join(heights.select(*TILE, F.floor("low").alias("_low"), F.ceil("high").alias("_high")), TILE, "left")
        range_ = F.coalesce((F.col("low") != F.col("_low")) | (F.col("high") != F.col("_high")), F.lit(False)) & (F.col("n") == 1)
    up = rows.select("face", (F.col("level") + 1).alias("level"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("low").alias("p_low"), F.col("high").alias("p_high"))
    told = told.withColumns({"_x": F.shiftright("x", 1), "_y": F.shiftright("y", 1)}).join(up, ["face", "level", "_x", "_y"], "left")
    beyond = F.coalesce((F.col("low") < F.col("p_low")) | (F.col("high") > F.col("p_high")), F.lit(False))
    faults = {"absent": F.col("said").isNull(), "unavailable": F.col("there").isNull(), "repeated": F.coalesce(F.col("n") > 1, F.lit(False)), "empty": F.coalesce("empty", F.lit(False)), "range": range_, "parent": beyond}
    each = F.filter(F.array(*[F.when(when, F.lit(name)) for name, when in faults.items()]), lambda f: f.isNotNull())
    return told.select(*TILE, F.explode(each).alias("fault"))
