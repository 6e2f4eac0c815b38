"""Shapes as sets of grid cells: rasters, neighbours, regions, distances, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.graph import components
from meridia.operators.joins import asof_join, global_rank
from meridia.shared import join_bounded, stored


def rasterise(edges: DataFrame) -> DataFrame:
    """shape, j, i of the cells whose centre lies in the rings of edges(shape, x0, y0, x1, y1), in cells, by the even-odd rule.

    An edge toggles each row of centres that it crosses, from the crossing on; between an
    odd crossing of a row and the next the row is inside.
    """
    e = edges.where("y0 <> y1").select("shape", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil(low - 0.5), F.ceil(high - 0.5) - 1
    rows = e.where(first <= last).withColumn("j", F.explode(F.sequence(first, last)))
    x = F.col("x0") + (F.col("j") + 0.5 - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    w = Window.partitionBy("shape", "j").orderBy("x")
    spans = rows.select("shape", "j", x.alias("x")).withColumn("n", F.row_number().over(w)).withColumn("to", F.lead("x").over(w)).where("n % 2 = 1")
    a, b = F.ceil(F.col("x") - 0.5), F.ceil(F.col("to") - 0.5) - 1
    return spans.where(a <= b).select("shape", F.col("j").cast("int").alias("j"), F.explode(F.sequence(a, b)).alias("i")).withColumn("i", F.col("i").cast("int")).distinct()


def boxes(rows: DataFrame, columns: int) -> DataFrame:
    """rows(j0, i0, h, w, ...) with a row per cell; columns wrap."""
    out = rows.withColumn("j", F.explode(F.expr("sequence(j0, j0 + h - 1)"))).withColumn("i", F.explode(F.expr("sequence(i0, i0 + w - 1)")))
    return out.withColumn("i", F.pmod("i", F.lit(columns))).drop("j0", "i0", "h", "w")


def around(cells: DataFrame, reach: int, columns: int, square: bool = True, keep: str = "c") -> DataFrame:
    """cells with `dj`, `di` and the neighbours' j and i within a reach (4 neighbours if not square, and reach 1); the cell itself is one."""
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if square or abs(a) + abs(b) <= reach]
    near = F.array(*[F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in steps])
    out = cells.withColumn(keep, F.explode(near))
    return out.withColumn("dj", F.col(f"{keep}.dj")).withColumn("di", F.col(f"{keep}.di")).withColumn("j", F.col("j") + F.col("dj")).withColumn("i", F.pmod(F.col("i") + F.col("di"), F.lit(columns))).drop(keep)


def by_priority(cells: DataFrame, of: str = "id") -> DataFrame:
    """j, i and of the shapes there the one of the smallest area, then the smallest id; cells(id, area, j, i)."""
    return cells.groupBy("j", "i").agg(F.min_by(of, F.struct("area", of)).alias(of))


def overlaps(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b, shared: how many cells two names hold both, cells(by, name, j, i)."""
    left = cells.select(*by, F.col("name").alias("a"), "j", "i").distinct()
    right = cells.select(*by, F.col("name").alias("b"), "j", "i").distinct()
    return left.join(right, [*by, "j", "i"]).where("a < b").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("shared"))


def settle(cells: DataFrame, by: list[str], winners: DataFrame) -> DataFrame:
    """cells(by, name, j, i) without those that a name loses: of two names the one that `winners`(a, b, winner) names keeps shared cells, else that of fewer cells, else the lesser name."""
    cells = cells.select(*by, "name", "j", "i").distinct()
    sizes = cells.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("size"))
    size = lambda x: sizes.select(*by, F.col("name").alias(x), F.col("size").alias(f"size_{x}"))
    pairs = overlaps(cells, by).join(size("a"), [*by, "a"]).join(size("b"), [*by, "b"]).join(winners, ["a", "b"], "left")
    wins = F.coalesce("winner", F.when(F.col("size_b") < F.col("size_a"), F.col("b")).otherwise(F.col("a")))
    beats = pairs.withColumn("w", wins).select(*by, F.col("w").alias("by_name"), F.when(F.col("w") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("name"))
    held = cells.select(*by, F.col("name").alias("by_name"), "j", "i")
    lost = cells.join(beats, [*by, "name"]).join(held, [*by, "by_name", "j", "i"], "left_semi").select(*by, "name", "j", "i")
    return cells.join(lost, [*by, "name", "j", "i"], "left_anti")


def regions(cells: DataFrame, by: list[str], columns: int, eight: bool = False) -> DataFrame:
    """cells(by, j, i) with region, the smallest cell number (j * columns + i) of the connected cells of the same `by`."""
    number = F.col("j") * columns + F.col("i")
    nodes = stored(cells.select(*by, "j", "i").distinct().withColumn("node", F.concat_ws("/", *by, F.lpad(number.cast("string"), 12, "0"))), "cells")
    near = around(nodes.withColumnRenamed("node", "a"), 1, columns, eight)
    edges = near.where("dj > 0 or (dj = 0 and di > 0) or (dj >= 0 and di < 0)").join(nodes.withColumnRenamed("node", "b"), [*by, "j", "i"]).where("a <> b").select("a", "b")
    labels = components(edges)
    return nodes.join(labels, "node", "left").select(*by, "j", "i", F.element_at(F.split(F.coalesce("component", "node"), "/"), -1).cast("long").alias("region"))


def touching(pieces: DataFrame, others: DataFrame, by: list[str], columns: int) -> DataFrame:
    """by, piece, other: pieces(by, piece, j, i) next to, in eight directions, others(by, other, j, i)."""
    return around(pieces, 1, columns).join(others, [*by, "j", "i"]).select(*by, "piece", "other").distinct()


def opened(cells: DataFrame, by: list[str], columns: int, reach: int = 1) -> DataFrame:
    """The cells of parts that are 2 * reach + 1 wide: erosion, then dilation within the cells."""
    cells = cells.select(*by, "j", "i").distinct()
    full = (2 * reach + 1) ** 2
    kept = around(cells, reach, columns).groupBy(*by, "j", "i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == full).select(*by, "j", "i")
    return around(kept, reach, columns).select(*by, "j", "i").distinct().join(cells, [*by, "j", "i"], "left_semi")


#: Up to this square reach an empty cell looks at the cells around it; further off by columns.
NEAR = 4


def nearest_fill_all(cells: DataFrame, empty: DataFrame, columns: int, by: tuple[str, ...] = ()) -> DataFrame:
    """empty(by, j, i) with the id of the nearest of cells(by, j, i, id) of the same `by`, at any distance; of equally near ones the smallest id.

    What lies within NEAR is found by neighbours. The rest goes by columns: in each column the holders next above and below a row are
    the only ones that can be nearest to a cell of that row, so a cell looks at two holders for each column. Ids are ranked, so that a
    distance and an id are one number to take the least of. A cell has no row only where its `by` has no id at all.
    """
    keys = [*by, "j", "i"]
    ids = stored(global_rank(cells.select("id").distinct(), [F.col("id")], "_r"), "ids")
    held = stored(join_bounded(cells.select(*keys, "id"), ids, ["id"], "inner").groupBy(*keys).agg(F.min("_r").alias("_r")), "held")
    rest = empty.select(*keys).distinct()
    if by:
        rest = rest.join(held.select(*by).distinct(), list(by), "left_semi")
    rest = stored(rest, "rest")
    best = F.min(F.col("d2") * (1 << 31) + F.col("_r")).alias("_b")
    of = lambda got: got.groupBy(*by, F.col("oj").alias("j"), F.col("oi").alias("i")).agg(best)
    around_ = around(rest.withColumn("oj", F.col("j")).withColumn("oi", F.col("i")), min(NEAR, columns // 2), columns).withColumn("d2", (F.col("dj") * F.col("dj") + F.col("di") * F.col("di")).cast("long"))
    done = stored(of(around_.where(F.col("d2") <= NEAR * NEAR).join(held, keys)), "filled")
    rest = stored(rest.join(done, keys, "left_anti"), "rest")
    if not rest.isEmpty():
        rows = rest.select(*by, F.col("j").cast("long").alias("j")).distinct()
        lines = held.select(*by, "i").distinct()
        rows = rows.join(lines, list(by)) if by else rows.crossJoin(lines)  # a grid's rows by its columns
        right = held.select(*by, "i", F.col("j").cast("long").alias("j"), F.col("j").cast("long").alias("_hj"), "_r")
        turned = lambda df: df.withColumn("j", -F.col("j"))
        above = asof_join(rows, right, [*by, "i"], "j", ["_hj", "_r"])
        below = turned(asof_join(turned(rows), turned(right), [*by, "i"], "j", ["_hj", "_r"]))
        lines = stored(above.unionByName(below).where("_hj is not null").select(*by, "j", F.col("i").alias("_hi"), (F.abs(F.col("_hj") - F.col("j"))).alias("_dj"), "_r").distinct(), "columns")
        turn = F.abs(F.col("i") - F.col("_hi"))
        di = F.least(turn, columns - turn).cast("long")
        far = rest.select(*by, F.col("j").alias("oj"), F.col("i").alias("oi"), F.col("j").cast("long").alias("j"), "i").join(lines, [*by, "j"]).withColumn("d2", F.col("_dj") * F.col("_dj") + di * di)
        done = done.unionByName(of(far.drop("j", "i")))
    return join_bounded(done.withColumn("_r", F.pmod("_b", F.lit(1 << 31))), ids, ["_r"], "inner").select(*keys, "id")


def fill_pockets(cells: DataFrame, empty: DataFrame, columns: int, by: tuple[str, ...] = ()) -> DataFrame:
    """empty(by, j, i, unit, hole) with the id that fills each: a hole takes the nearest of cells(by, j, i, id, unit) of its own unit, a
    pocket, and a hole whose unit holds nothing, the nearest of all."""
    keys = [*by, "j", "i"]
    own = stored(nearest_fill_all(cells, empty.where("hole"), columns, (*by, "unit")).select(*keys, "id"), "holes")
    rest = empty.select(*keys).join(own, keys, "left_anti")
    return own.unionByName(nearest_fill_all(cells, rest, columns, by).select(*keys, "id"))


def signed_distance(cells: DataFrame, columns: int, reach: int, by: tuple[str, ...] = ()) -> DataFrame:
    """cells(by, j, i, flag) with the distance, at most `reach`, to the nearest cell of the other flag of the same `by`, positive where flag holds."""
    near = around(cells.withColumn("oj", F.col("j")).withColumn("oi", F.col("i")).withColumn("own", F.col("flag")).drop("flag"), reach, columns)
    got = near.join(cells, [*by, "j", "i"]).where("flag <> own").groupBy(*by, "oj", "oi").agg(F.min(F.col("dj") * F.col("dj") + F.col("di") * F.col("di")).alias("d2"))
    d = F.least(F.lit(float(reach)), F.sqrt(F.coalesce("d2", F.lit(reach * reach))))
    return cells.join(got.select(*by, F.col("oj").alias("j"), F.col("oi").alias("i"), "d2"), [*by, "j", "i"], "left").select(*by, "j", "i", "flag", F.when(F.col("flag"), d).otherwise(-d).alias("distance"))


def texel_distance(cells: DataFrame, columns: int, reach: int, k: int = 2) -> DataFrame:
    """j, i, distance of texels of k x k cells(j, i, flag): the mean of their cells' signed_distance()."""
    of = signed_distance(cells, columns, reach)
    return of.groupBy(F.floor(F.col("j") / k).alias("j"), F.floor(F.col("i") / k).alias("i")).agg(F.avg("distance").alias("distance"))


def border_distance(cells: DataFrame, pairs: DataFrame, columns: int, reach: int) -> DataFrame:
    """j, i, distance to the nearest border between two ids of pairs(lower, upper, soft); negative on the lower side; soft as the nearest pair says.

    A border cell is one of the lower or upper id with the other among its four neighbours.
    """
    both = pairs.select(F.col("lower").alias("id"), F.col("upper").alias("other"), F.lit(-1).alias("side"), "soft").union(pairs.select("upper", "lower", F.lit(1), "soft"))
    near = around(cells.withColumnRenamed("id", "own").withColumn("oj", F.col("j")).withColumn("oi", F.col("i")), 1, columns, False)
    border = near.join(cells.withColumnRenamed("id", "other"), ["j", "i"]).where("own <> other").select(F.col("oj").alias("j"), F.col("oi").alias("i"), F.col("own").alias("id"), "other").join(both, ["id", "other"]).select("j", "i", "side", "soft").distinct()
    spread = around(border.withColumn("bj", F.col("j")), reach, columns).withColumn("d2", F.col("dj") * F.col("dj") + F.col("di") * F.col("di"))
    best = spread.join(cells.select("j", "i"), ["j", "i"]).groupBy("j", "i").agg(F.min(F.struct("d2", "side", "soft")).alias("b"))
    return best.select("j", "i", (F.col("b.side") * (F.sqrt("b.d2") + 0.5)).alias("distance"), F.col("b.soft").alias("soft"))


def both_near(empty: DataFrame, lakes: DataFrame, ids: DataFrame, columns: int, reach: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells of empty(by, j, i) with a lake(j, i) and an id(by, j, i) of the same `by` within a square reach."""
    near = lambda other, keys: around(other.select(*keys), reach, columns).select(*keys).distinct()
    keys = [*by, "j", "i"]
    return empty.select(*keys).join(near(lakes, ["j", "i"]), ["j", "i"], "left_semi").join(near(ids, keys), keys, "left_semi").select(*keys)


def across_seam(unclaimed: DataFrame, held: DataFrame, columns: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, j, i, name of unclaimed(by, j, i) cells at the first or last column whose neighbours over the seam have one holder alone, held(by, name, j, i)."""
    edge = unclaimed.where((F.col("i") == 0) | (F.col("i") == columns - 1))
    over = around(edge.withColumn("oj", F.col("j")).withColumn("oi", F.col("i")), 1, columns).where((F.col("oi") == 0) & (F.col("i") == columns - 1) | (F.col("oi") == columns - 1) & (F.col("i") == 0))
    got = over.join(held, [*by, "j", "i"]).groupBy(*by, F.col("oj").alias("j"), F.col("oi").alias("i")).agg(F.count_distinct("name").alias("n"), F.min("name").alias("name"))
    return got.where("n = 1").select(*by, "j", "i", "name")


def near_segments(points: DataFrame, segments: DataFrame, columns: int) -> DataFrame:
    """id, km-free distance in cells of points(id, x, y) to the nearest of segments(seg, x0, y0, x1, y1, half) that is within its half width."""
    half, dx, dy = F.col("half"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = segments.withColumn("j", F.explode(F.sequence(F.floor(F.least("y0", "y1") - half), F.floor(F.greatest("y0", "y1") + half))))
    # In each row only the columns that the segment passes there, and half a width on both sides.
    unit = lambda y: F.when(dy != 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (y - F.col("y0")) / dy)))
    ends = [F.coalesce(F.col("x0") + unit(F.col("j") - half) * dx, F.col("x0")), F.coalesce(F.col("x0") + unit(F.col("j") + 1 + half) * dx, F.col("x1"))]
    s = rows.withColumn("i", F.explode(F.sequence(F.floor(F.least(*ends) - half), F.floor(F.greatest(*ends) + half))))
    p = points.withColumn("i", F.floor("x")).withColumn("j", F.floor("y"))
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / n))).otherwise(0.0)
    d = F.sqrt(F.pow(F.col("x") - F.col("x0") - t * dx, 2) + F.pow(F.col("y") - F.col("y0") - t * dy, 2))
    return p.join(s, ["i", "j"]).withColumn("d", d).where("d <= half").groupBy("id").agg(F.min("d").alias("distance"))


def straight_bands(cells: DataFrame, by: list[str], h: int, prefer: str | float, rows: int, near: float = 0.97) -> DataFrame:
    """by, length, row, first, end of the longest straight band `h` rows high within each shape of cells(by, j, i): `row` is its lowest row, `end` the column behind it.

    Of the rows whose longest band has `near` of the greatest length or more, that whose middle is nearest to `prefer`, a number or a
    column of the shape; of equals the lowest; in a row the first of the longest. Runs of a column give the rows that a band can begin in, runs of
    these along a row the bands, so rows grow with the shape's cells. Shapes without a band, and all where `h` reaches `rows`, have no row. Columns don't wrap.
    """
    if h >= rows:
        return cells.select(*by, *[F.lit(None).cast("long").alias(c) for c in ("length", "row", "first", "end")]).limit(0)
    own = cells.select(*by, "j", "i").distinct()
    tall = runs(own, [*by, "i"], "j").where(F.col("last") - F.col("first") >= h - 1)
    starts = tall.select(*by, "i", F.explode(F.sequence("first", F.col("last") - (h - 1))).alias("row"))
    bands = runs(starts, [*by, "row"], "i").select(*by, F.col("row").cast("long").alias("row"), F.col("first").cast("long").alias("first"), (F.col("last") + 1).cast("long").alias("end"), (F.col("last") + 1 - F.col("first")).cast("long").alias("length"))
    longest = bands.groupBy(*by, "row").agg(F.max_by(F.struct("length", "first", "end"), F.struct("length", -F.col("first"))).alias("b")).select(*by, "row", "b.*")
    most = longest.groupBy(*by).agg(F.max("length").alias("most"))
    middle = F.col(prefer) if isinstance(prefer, str) else F.lit(float(prefer))
    wanted = cells.groupBy(*by).agg(F.first(middle).alias("prefer"))
    fit = longest.join(most, by).where(F.col("length") >= F.col("most") * near).join(wanted, by)
    best = F.min_by(F.struct("length", "row", "first", "end"), F.struct(F.abs(F.col("row") + h / 2 - F.col("prefer")), "row")).alias("b")
    return fit.groupBy(*by).agg(best).select(*by, "b.*")


def runs(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """by, first, last of runs of consecutive whole numbers `at`."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return rows.select(*by, at).distinct().withColumn("_g", island).groupBy(*by, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("_g")


def shore_band(lakes: DataFrame, by: list[str], columns: int, reach: int = 3) -> DataFrame:
    """by, j, i of cells off the lakes(by, j, i) that touch one where it is wide: a lake cell with none but lake cells around it lies within a square reach."""
    lakes = lakes.select(*by, "j", "i").distinct()
    near = lambda of, r: around(of, r, columns).select(*by, "j", "i").distinct()
    wide = around(lakes, 1, columns).groupBy(*by, "j", "i").agg(F.count(F.lit(1)).alias("n")).where("n = 9").select(*by, "j", "i").join(lakes, [*by, "j", "i"], "left_semi")
    return near(lakes, 1).join(lakes, [*by, "j", "i"], "left_anti").join(near(wide, reach), [*by, "j", "i"], "left_semi")


def border_cells(cells: DataFrame, by: list[str], columns: int) -> DataFrame:
    """by, j, i of cells(by, name, j, i) with another name among their four neighbours."""
    near = around(cells.select(*by, F.col("name").alias("own"), "j", "i", F.col("j").alias("oj"), F.col("i").alias("oi")), 1, columns, False)
    return near.join(cells.select(*by, "name", "j", "i"), [*by, "j", "i"]).where("own <> name").select(*by, F.col("oj").alias("j"), F.col("oi").alias("i")).distinct()


def shore_runs(borders: DataFrame, band: DataFrame, by: list[str], columns: int, cell_km: float) -> DataFrame:
    """by, region, cells, km, j0, i0, j1, i1 of runs (connected in eight directions) of border cells in a shore band: km is the diagonal of a run's box."""
    hit = borders.select(*by, "j", "i").join(band.select(*by, "j", "i").distinct(), [*by, "j", "i"], "left_semi")
    box = regions(hit, by, columns, True).groupBy(*by, "region").agg(F.count(F.lit(1)).alias("cells"), F.min("j").alias("j0"), F.min("i").alias("i0"), F.max("j").alias("j1"), F.max("i").alias("i1"))
    high, wide = F.col("j1") - F.col("j0") + 1, F.col("i1") - F.col("i0") + 1
    return box.withColumn("km", F.sqrt((high * high + wide * wide).cast("double")) * cell_km)
