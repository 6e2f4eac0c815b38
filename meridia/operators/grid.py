"""Grids of cells: samples, means, tiles, climate frames, predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def window(cells: DataFrame, i0: int, j0: int, w: int, h: int, columns: int) -> DataFrame:
    """Cells of a window whose columns wrap; `wi` and `wj` are positions in it."""
    wi, wj = F.pmod(F.col("i") - i0, F.lit(columns)), F.col("j") - j0
    return cells.where((wi < w) & wj.between(0, h - 1)).withColumn("wi", wi).withColumn("wj", wj)


def bilinear(points: DataFrame, cells: DataFrame, columns: int, rows: int) -> DataFrame:
    """points(id, x, y in cells, centres at .5) with value: the four cells around, columns wrapping, rows held at the edges. Absent cells leave the value null."""
    fx, fy = F.floor(F.col("x") - 0.5), F.floor(F.col("y") - 0.5)
    tx, ty = F.col("x") - 0.5 - fx, F.col("y") - 0.5 - fy
    corner = lambda a, b: F.struct(F.pmod(fx + a, F.lit(columns)).cast("int").alias("i"), F.least(F.lit(rows - 1), F.greatest(F.lit(0), fy + b)).cast("int").alias("j"), ((tx if a else 1 - tx) * (ty if b else 1 - ty)).alias("share"))
    corners = points.select("id", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select("id", "c.*")
    got = corners.join(cells.select("i", "j", "value"), ["i", "j"], "left")
    return got.groupBy("id").agg(F.when(F.count("value") == 4, F.sum(F.col("value") * F.col("share"))).alias("value"))


def block_means(cells: DataFrame, k: int) -> DataFrame:
    """Exact means of k x k blocks that are whole: j, i, total, mean."""
    block = cells.groupBy(F.floor(F.col("j") / k).cast("int").alias("j"), F.floor(F.col("i") / k).cast("int").alias("i"))
    return block.agg(F.sum("value").alias("total"), F.count("value").alias("n")).where(F.col("n") == k * k).select("j", "i", "total", (F.col("total") / (k * k)).alias("mean"))


def halved(cells: DataFrame) -> DataFrame:
    """(a + b + c + d + 2) >> 2 of each 2 x 2 block of whole numbers."""
    block = cells.groupBy(F.floor(F.col("j") / 2).cast("int").alias("j"), F.floor(F.col("i") / 2).cast("int").alias("i"))
    return block.agg(F.sum("value").alias("s"), F.count("value").alias("n")).where("n = 4").select("j", "i", F.shiftright(F.col("s") + 2, 2).alias("value"))


def texel_means(texels: DataFrame, cells: DataFrame, columns: int, rows: int, n: int = 4) -> DataFrame:
    """texels(id, x, y, size) with the mean of n x n bilinear samples inside each."""
    part = (F.col("k") + 0.5) / n * F.col("size")
    samples = texels.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("sx", F.col("x") + part)
    samples = samples.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("sy", F.col("y") + (F.col("l") + 0.5) / n * F.col("size"))
    points = samples.select(F.struct("id", "k", "l").alias("id"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    return bilinear(points, cells, columns, rows).groupBy(F.col("id.id").alias("id")).agg(F.avg("value").alias("mean"))


def quantise(frames: DataFrame) -> DataFrame:
    """frames(frame, cell, value) with the frame's offset and scale, a code 0 to 254 (255: missing) and the value decoded."""
    by = Window.partitionBy("frame")
    low, high = F.min("value").over(by), F.max("value").over(by)
    scaled = frames.withColumn("offset", low).withColumn("scale", F.when(high > low, (high - low) / 254).otherwise(1.0))
    code = F.when(F.col("value").isNull(), 255).otherwise(F.rint((F.col("value") - F.col("offset")) / F.col("scale"))).cast("int")
    return scaled.withColumn("code", code).withColumn("decoded", F.when(F.col("code") < 255, F.col("offset") + F.col("code") * F.col("scale")))


def annual_means(months: DataFrame) -> DataFrame:
    """cell, year, mean of the years with all twelve months of months(cell, year, month, value)."""
    return months.where("value is not null").groupBy("cell", "year").agg(F.avg("value").alias("mean"), F.count_distinct("month").alias("n")).where("n = 12").select("cell", "year", "mean")


def blend(a: DataFrame, b: DataFrame, weight: float, by: tuple[str, ...] = ("cell",)) -> DataFrame:
    """by, value between two frames(by, value); where one side is missing the other's value."""
    x, y = F.col("x"), F.col("y")
    both = a.select(*by, F.col("value").alias("x")).join(b.select(*by, F.col("value").alias("y")), list(by), "full")
    return both.select(*by, F.coalesce(x + (y - x) * weight, x, y).alias("value"))


def predicted(cells: DataFrame) -> DataFrame:
    """cells(j, i, value) with the zigzag residual of left + up - upper left; absent neighbours are 0."""
    shift = lambda dj, di, name: cells.select((F.col("j") + dj).alias("j"), (F.col("i") + di).alias("i"), F.col("value").alias(name))
    rows = cells.join(shift(0, 1, "l"), ["j", "i"], "left").join(shift(1, 0, "u"), ["j", "i"], "left").join(shift(1, 1, "ul"), ["j", "i"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    r = F.col("value") - (zero("l") + zero("u") - zero("ul"))
    return rows.withColumn("residual", F.shiftleft(r, 1).bitwiseXOR(F.shiftright(r, 63))).select("j", "i", "value", "residual")


def restored(residuals: DataFrame) -> DataFrame:
    """j, i, value from zigzag residuals(j, i, residual) of a full grid: running sums along rows, then along columns."""
    z = F.col("residual")
    r = F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))
    rows = residuals.withColumn("r", F.sum(r).over(Window.partitionBy("j").orderBy("i")))
    return rows.select("j", "i", F.sum("r").over(Window.partitionBy("i").orderBy("j")).alias("value"))


def deltas(layers: DataFrame) -> DataFrame:
    """layers(cell, step, value) with delta, the change from the step before modulo 256."""
    before = F.lag("value", 1, 0).over(Window.partitionBy("cell").orderBy("step"))
    return layers.withColumn("delta", F.pmod(F.col("value") - before, F.lit(256)))


def undeltas(layers: DataFrame) -> DataFrame:
    """layers(cell, step, delta) with value, the running sum modulo 256."""
    return layers.withColumn("value", F.pmod(F.sum("delta").over(Window.partitionBy("cell").orderBy("step")), F.lit(256)))


def bounds(texels: DataFrame) -> DataFrame:
    """tile, low, high, floor and ceil of heights(tile, height), and bounds that include 0."""
    return texels.groupBy("tile").agg(F.min("height").alias("low"), F.max("height").alias("high")).select("tile", "low", "high", F.floor("low").alias("floor_m"), F.ceil("high").alias("ceil_m"), F.least("low", F.lit(0)).alias("low0"), F.greatest("high", F.lit(0)).alias("high0"))


def smallest_step(groups: DataFrame, codes: int, candidates: list[int]) -> DataFrame:
    """step: the smallest candidate at which every group(low, high) spans at most `codes` codes."""
    worst = groups.agg(F.max(F.col("high") - F.col("low")).alias("span"))
    fits = worst.select(F.explode(F.array(*map(F.lit, candidates))).alias("step"), "span").where(F.ceil(F.col("span") / F.col("step")) < codes)
    return fits.agg(F.min("step").alias("step"))


def grown(roots: DataFrame, wanted: DataFrame, levels: int) -> DataFrame:
    """level, x, y of tiles kept level by level: children of kept tiles that hold a wanted cell(x, y at the deepest level)."""
    kept = roots.select(F.lit(0).alias("level"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    out = kept
    for level in range(1, levels + 1):
        kids = kept.select(F.lit(level).alias("level"), F.explode(F.array(*[F.struct((2 * F.col("x") + a).alias("x"), (2 * F.col("y") + b).alias("y")) for a in (0, 1) for b in (0, 1)])).alias("t")).select("level", "t.*")
        size = 1 << (levels - level)
        holds = wanted.select(F.floor(F.col("x") / size).alias("x"), F.floor(F.col("y") / size).alias("y")).distinct()
        kept = kids.join(holds, ["x", "y"], "left_semi").select("level", "x", "y")
        out = out.union(kept)
    return out


def presence(ids: DataFrame) -> DataFrame:
    """bucket, bits (how many), bitmap of ids(id) packed as Spark's bitmaps are."""
    return ids.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap")).select("bucket", F.bitmap_count("bitmap").alias("bits"), "bitmap")


def source_window(samples: DataFrame, columns: int, halo: int) -> DataFrame:
    """tile, j0, j1, i0, i1 of samples(tile, j, i): rows and the smallest wrapping arc of columns, with a halo."""
    by = Window.partitionBy("tile").orderBy("i")
    first = F.first("i").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cols = samples.select("tile", "i").distinct().withColumn("next", F.coalesce(F.lead("i").over(by), first))
    cols = cols.withColumn("gap", F.when(F.col("next") > F.col("i"), F.col("next") - F.col("i")).otherwise(F.col("next") - F.col("i") + columns))
    arc = cols.groupBy("tile").agg(F.max_by(F.struct(F.col("next").alias("i0"), F.col("i").alias("i1")), F.struct("gap", -F.col("i"))).alias("a"))
    rows = samples.groupBy("tile").agg(F.min("j").alias("j0"), F.max("j").alias("j1"))
    wrap = lambda c: F.pmod(c, F.lit(columns)).cast("int")
    return arc.join(rows, "tile").select("tile", (F.col("j0") - halo).alias("j0"), (F.col("j1") + halo).alias("j1"), wrap(F.col("a.i0") - halo).alias("i0"), wrap(F.col("a.i1") + halo).alias("i1"))


def corner_means(texels: DataFrame, side: int) -> DataFrame:
    """j, i (of corners), value: the mean, rounded half away from zero, of the four texels around each inner corner."""
    from meridia.functions.codes import away

    around = texels.select(F.explode(F.array(*[F.struct((F.col("j") + a).alias("j"), (F.col("i") + b).alias("i")) for a in (0, 1) for b in (0, 1)])).alias("c"), "value").select("c.*", "value")
    return around.where(F.col("j").between(1, side - 1)).groupBy("j", "i").agg(F.sum("value").alias("s"), F.count("value").alias("n")).where("n = 4").select("j", "i", away(F.col("s") / 4).alias("value"))


def face_sides(spark: SparkSession) -> DataFrame:
    """face, side, other, other_side, turned of the 24 face sides (sides 0 and 1 have s = 0 and 1, sides 2 and 3 t = 0 and 1)."""
    from meridia.functions.geo import face_edges

    return spark.createDataFrame([(*e[:4], bool(e[4])) for e in face_edges()], "face int, side int, other int, other_side int, turned boolean")


def neighbours(tiles: DataFrame, level: int) -> DataFrame:
    """Four rows of each row of tiles(face, x, y, ...): side, face2, x2, y2, side2 (the neighbour's side that meets it) and turned (it runs the other way).

    Inside a face the neighbour is the next tile; across a face edge it is found among the 24 face sides, sent to every task.
    """
    last = (1 << level) - 1
    rows = tiles.withColumn("side", F.explode(F.array(*map(F.lit, range(4)))))
    dx, dy = (F.when(F.col("side") == k, -1).when(F.col("side") == k + 1, 1).otherwise(0) for k in (0, 2))
    rows = rows.withColumn("_x", F.col("x") + dx).withColumn("_y", F.col("y") + dy)
    inside = F.col("_x").between(0, last) & F.col("_y").between(0, last)
    rows = rows.join(F.broadcast(face_sides(tiles.sparkSession)), ["face", "side"])
    along = F.when(F.col("side") < 2, F.col("y")).otherwise(F.col("x"))
    along = F.when(F.col("turned"), last - along).otherwise(along)
    across = F.when(F.col("other_side") % 2 == 1, last).otherwise(0)
    upright = F.col("other_side") < 2
    opposite = F.col("side").bitwiseXOR(F.lit(1))
    out = {
        "face2": F.when(inside, F.col("face")).otherwise(F.col("other")),
        "x2": F.when(inside, F.col("_x")).when(upright, across).otherwise(along),
        "y2": F.when(inside, F.col("_y")).when(upright, along).otherwise(across),
        "side2": F.when(inside, opposite).otherwise(F.col("other_side")),
        "turned": ~inside & F.col("turned"),
    }
    return rows.select(*tiles.columns, "side", *[v.alias(k) for k, v in out.items()])


def corner_owners(spark: SparkSession, side: int) -> DataFrame:
    """face, j, i, owner: the address of each corner on an edge of a face of `side` texels a side, and that of the same point on the lowest face that has it.

    At an edge two faces meet, at a corner of the cube three. As many rows as the faces have corners on their edges.
    """
    points = face_sides(spark).withColumn("along", F.explode(F.sequence(F.lit(0), F.lit(side))))
    image = F.when(F.col("turned"), side - F.col("along")).otherwise(F.col("along"))

    def address(face: str, at: str, along: Column) -> Column:
        across = F.when(F.col(at) % 2 == 1, side).otherwise(0)
        upright = F.col(at) < 2
        return F.struct(F.col(face).alias("face"), F.when(upright, along).otherwise(across).alias("j"), F.when(upright, across).otherwise(along).alias("i"))

    pairs = points.select(address("face", "side", F.col("along")).alias("own"), address("other", "other_side", image).alias("image"))
    return pairs.groupBy("own").agg(F.least(F.col("own"), F.min("image")).alias("owner")).select("own.*", "owner")


def face_corner_values(texels: DataFrame, side: int) -> DataFrame:
    """face, j, i, owner, texels, value of every corner on a face's edge: the mean, rounded half away from zero, of the texels(face, j, i, value) around the point.

    Corners are known by the lowest face that has the point, so all faces get one value: of four texels along an
    edge, of three at a corner of the cube, of fewer where texels lack or are null. A corner without any has no row.
    """
    from meridia.functions.codes import away

    owners = corner_owners(texels.sparkSession, side)
    around = texels.select("face", F.explode(F.array(*[F.struct((F.col("j") + a).alias("j"), (F.col("i") + b).alias("i")) for a in (0, 1) for b in (0, 1)])).alias("c"), "value").select("face", "c.*", "value")
    edge = around.where(F.col("j").isin(0, side) | F.col("i").isin(0, side))
    sums = edge.join(owners, ["face", "j", "i"]).groupBy("owner").agg(F.sum("value").alias("s"), F.count("value").alias("texels")).where("texels > 0")
    return owners.join(sums, "owner").select("face", "j", "i", "owner", "texels", away(F.col("s") / F.col("texels")).alias("value"))


def votes(flags: DataFrame, k: int) -> DataFrame:
    """tile, chosen (at least k of its flags), any_set, all_set."""
    return flags.groupBy("tile").agg((F.sum(F.col("flag").cast("int")) >= k).alias("chosen"), F.bool_or("flag").alias("any_set"), F.bool_and("flag").alias("all_set"))


def km2(j: Column, rows: int, columns: int) -> Column:
    """Area of a cell of row j, by the sine of its borders."""
    from meridia.functions.geo import EARTH_KM

    lat = lambda k: F.radians(F.lit(-90.0) + k * (180.0 / rows))
    return EARTH_KM * EARTH_KM * (2 * 3.141592653589793 / columns) * (F.sin(lat(j + 1)) - F.sin(lat(j)))
