"""Selections from the index: spaced, tiered, per view."""

from __future__ import annotations

from math import asin, cos, radians, sin, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import cal, geo
from meridia.operators.joins import asof_join, interval_join
from meridia.shared import bounded, join_bounded, shuffled, stored

#: Rows that a greedy pick looks at together; what they do not settle is looked at in another batch.
BATCH = 512


def spaced(rows: DataFrame, km: float, k: int) -> DataFrame:
    """The first k of rows(id, score, lon, lat), best first, that are each at least `km` from those taken. Ties go to the smaller id.

    The best BATCH rows that are far enough from those taken are picked from in order; what is left of the table is
    filtered by the k rows taken at most, and so on until k are taken or no row is left.
    """
    points = rows.select("id", "score", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    taken: list = []
    while len(taken) < k:
        far = points
        if taken:
            there = F.array(*[F.struct(F.lit(t["lon"]).alias("lon"), F.lit(t["lat"]).alias("lat"), F.lit(t["id"]).alias("id")) for t in taken])
            far = points.where(~F.exists(there, lambda t: (F.col("id") == t["id"]) | (geo.great_circle_km("lon", "lat", t["lon"], t["lat"]) < km)))
        top = far.orderBy(F.col("score").desc(), "id").limit(BATCH).collect()  # BATCH rows at most
        for r in top:
            if len(taken) < k and all(_km(r["lon"], r["lat"], t["lon"], t["lat"]) >= km for t in taken):
                taken.append(r)
        if len(top) < BATCH:
            break
    return rows.sparkSession.createDataFrame(taken, points.schema).orderBy(F.col("score").desc(), "id")  # k rows at most


def near_in_time(frames: DataFrame, rows: DataFrame, width: int, longest: int) -> DataFrame:
    """Candidates of frames(frame, w0, w1): rows(id, t0, t1) whose span, no longer than `longest` days, meets the window."""
    return interval_join(bounded(stored(frames, "frames")), rows.where(F.col("t1") - F.col("t0") <= longest), "w0", "w1", "t0", "t1", width)


def month_frames(beats: DataFrame, pad: int) -> DataFrame:
    """story, month (y * 12 + m - 1), day, n0, n1, w0, w1, lon, lat: a frame for each month of a story, from January of the
    year in which the windows of its beats(story, ord, day, w0, w1, lon, lat) begin to December of that in which they end.

    A month looks from its middle day, first at its own days (n0 to n1), within `pad` days of the middle at least, away
    from the place of the beat nearest to the middle; of equally near ones the first by ord.
    """
    span = beats.groupBy("story").agg(F.min("w0").alias("a"), F.max("w1").alias("b"))
    first, last = cal.gregorian_civil("a")["y"] * 12, cal.gregorian_civil("b")["y"] * 12 + 11
    months = span.select("story", F.explode(F.sequence(first, last)).alias("month")).withColumn("y", cal.floor_div(F.col("month"), 12)).withColumn("m", (F.pmod("month", F.lit(12)) + 1).cast("int"))
    months = months.select("story", "month", cal.gregorian_day("y", "m", F.lit(1)).alias("n0"), cal.gregorian_month_end("y", "m").alias("n1"))
    months = months.withColumn("day", cal.floor_div(F.col("n0") + F.col("n1"), 2))
    # The beat before and the beat after, of equal days the first: each an as-of join.
    days = beats.groupBy("story", "day").agg(F.min_by(F.struct("ord", "lon", "lat"), "ord").alias("at"))
    before = asof_join(months, days.withColumn("was", F.col("day")), ["story"], "day", ["was", "at"]).withColumnRenamed("at", "at_a")
    back = lambda df: df.withColumn("day", -F.col("day"))
    both = back(asof_join(back(before), back(days.withColumn("will", F.col("day"))), ["story"], "day", ["will", "at"]).withColumnRenamed("at", "at_b"))
    a, b = F.col("day") - F.col("was"), F.col("will") - F.col("day")
    earlier = a.isNotNull() & (b.isNull() | (a < b) | ((a == b) & (F.col("at_a.ord") <= F.col("at_b.ord"))))
    at = F.when(earlier, F.col("at_a")).otherwise(F.col("at_b"))
    return both.select("story", "month", "day", "n0", "n1", F.least("n0", F.col("day") - pad).alias("w0"), F.greatest("n1", F.col("day") + pad).alias("w1"), at["lon"].alias("lon"), at["lat"].alias("lat"))


def with_kin(candidates: DataFrame, lineage: DataFrame) -> DataFrame:
    """candidates(frame, id) with kin: which of their ancestors in lineage(node, ancestor) are candidates of the same frame."""
    candidates = stored(candidates, "candidates")
    ids = candidates.select("frame", "id").distinct()
    pairs = ids.join(shuffled(lineage.select(F.col("node").alias("id"), "ancestor")), "id").join(shuffled(ids.withColumnRenamed("id", "ancestor")), ["frame", "ancestor"], "left_semi")
    kin = pairs.groupBy("frame", "id").agg(F.array_sort(F.collect_set("ancestor")).alias("kin"))  # as many as the forest is deep
    return candidates.join(shuffled(kin), ["frame", "id"], "left").withColumn("kin", F.coalesce("kin", F.array().cast("array<bigint>")))


def choose(candidates: DataFrame, n: int, apart_km: float, reach: int, taken: DataFrame | None = None) -> DataFrame:
    """frame, place (0 first), id, lon, lat, kin, near of up to n picks of each frame.

    candidates(frame, id, score, pinned, near, nearness, used, kin, lon, lat): all pinned ones first, or those `taken`
    before. Then of the near ones (dated in the frame's own days) and those within `reach` days the least used, near
    ones by score and then the nearest in time; then the others, the least used and nearest first. Each is at least `apart_km` from
    those taken and neither an ancestor nor a descendant of one. Ties go by score, then by id. Null ids are left out.

    Every frame takes its next pick at once, and its candidates that clash with it go: n rounds of an aggregation and
    a join by frame, whatever the frames' sizes.
    """
    keep = ["id", "lon", "lat", "kin", "near"]
    left = stored(candidates.where("id is not null").withColumn("_late", (~F.col("near") & (F.col("nearness") > reach)).cast("int")), "candidates")
    if taken is None:
        w = Window.partitionBy("frame").orderBy(F.col("score").desc(), "id")
        taken = left.where("pinned").withColumn("place", F.row_number().over(w) - 1).select("frame", "place", *keep)
    taken = stored(taken.select("frame", "place", *keep), "taken")
    order = F.struct("_late", "used", (~F.col("near")).cast("int"), F.when(F.col("near"), 0).otherwise(F.col("nearness")), -F.col("score"), "id")
    new = taken
    while True:
        left = stored(_clear_of(left, new, apart_km), "candidates")
        counts = taken.groupBy("frame").agg(F.max("place").alias("_last"))
        best = left.groupBy("frame").agg(F.min_by(F.struct(*keep), order).alias("b"))
        best = best.join(shuffled(counts), "frame", "left").withColumn("place", F.coalesce(F.col("_last") + 1, F.lit(0))).where(F.col("place") < n)
        new = stored(best.select("frame", "place", "b.*"), "picked")
        if new.isEmpty():
            return taken
        taken = stored(taken.unionByName(new), "taken")


def _clear_of(left: DataFrame, new: DataFrame, apart_km: float) -> DataFrame:
    """Candidates that clash with none of their frame's new picks."""
    of = new.groupBy("frame").agg(F.collect_list(F.struct("id", "lon", "lat", "kin")).alias("_new"))  # picks and pins, few
    clash = F.exists("_new", lambda t: (t["id"] == F.col("id")) | F.array_contains(t["kin"], F.col("id")) | F.array_contains("kin", t["id"]) | (geo.great_circle_km("lon", "lat", t["lon"], t["lat"]) < apart_km))
    return left.join(bounded(of, new), ["frame"], "left").where(F.col("_new").isNull() | ~clash).drop("_new")


def in_turn(candidates: DataFrame, n: int, apart_km: float, reach: int, sparse: tuple[tuple[float, int], ...] = ()) -> DataFrame:
    """series, frame, place, id: choose() for the frames of each series in turn.

    candidates(series, turn, frame, id, score, pinned, near, nearness, day, first, last, w0, w1, kin, lon, lat), turns from 0 without gaps, with all rows
    that the widest reach of `sparse` admits. A frame shuns what frames before took from their own days, and what the next frame
    pins or would take by itself and is nearer to: each counts as a use. A frame short of n relaxes by the steps of
    `sparse`, each a spacing and a reach in days on both sides, and keeps what it has. All series take the same turn at once.
    """
    rows = stored(candidates.withColumn("_inside", (F.col("first") <= F.col("w1")) & (F.col("last") >= F.col("w0"))), "series")
    turns = rows.agg(F.max("turn").alias("t")).first()["t"]
    if turns is None:
        return rows.select("series", "frame", F.lit(0).alias("place"), "id").limit(0)
    of = stored(rows.select("series", "turn", "frame").distinct(), "turns")
    alone = stored(choose(rows.where("_inside").withColumn("used", F.lit(0)), n, apart_km, reach), "alone").join(of, "frame").select("series", (F.col("turn") - 1).alias("turn"), "id", "frame")
    own = rows.select("series", "turn", "frame", "id", "nearness", "pinned")
    # What the next frame would take, as uses by this one: where it is pinned there or nearer to that day.
    there = own.select("series", "frame", "id", F.col("nearness").alias("then"), F.col("pinned").alias("_pin"))
    lent = alone.join(shuffled(there), ["series", "frame", "id"]).select("series", "turn", "id", "then", "_pin").join(shuffled(own.select("series", "turn", "id", "nearness")), ["series", "turn", "id"]).where("_pin or then < nearness")
    lent = stored(lent.select("series", "turn", "id").distinct(), "lent")
    done, shown = None, None
    for turn in range(turns + 1):
        here = rows.where(F.col("turn") == turn)
        uses = lent.where(F.col("turn") == turn).select("series", "id", F.lit(1).cast("long").alias("used"))
        if shown is not None:
            uses = uses.unionByName(shown)
        uses = uses.groupBy("series", "id").agg(F.sum("used").alias("used"))
        here = stored(here.join(shuffled(uses), ["series", "id"], "left").withColumn("used", F.coalesce("used", F.lit(0))), "turn")
        got = choose(here.where("_inside"), n, apart_km, reach)
        for spacing, wide in sparse:
            full = got.groupBy("frame").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= n)
            short = join_bounded(here, stored(full, "full"), ["frame"], "left_anti")
            reached = (F.col("first") <= F.greatest(F.col("w1"), F.col("day") + wide)) & (F.col("last") >= F.least(F.col("w0"), F.col("day") - wide))
            got = choose(short.where(reached), n, spacing, reach, taken=got)
        picked = stored(got.join(of.where(F.col("turn") == turn).select("series", "frame"), "frame").select("series", "frame", "place", "id", "near"), "picked")
        # Each turn reads one table of what turns before took, however many they are.
        done = picked if done is None else stored(done.unionByName(picked), "done")
        near = picked.where("near").select("series", "id", F.lit(1).cast("long").alias("used"))
        near = near if shown is None else near.unionByName(shown)
        shown = stored(near.groupBy("series", "id").agg(F.sum("used").alias("used")), "shown")
    return done.select("series", "frame", "place", "id")


def _km(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    a, b = radians(lat1), radians(lat2)
    h = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_KM * asin(sqrt(min(1.0, h)))


def viewport(rows: DataFrame, cell: int, cap: int, limit: int, kept: int = 20) -> DataFrame:
    """view, id of the rows(view, id, score, px, py, incumbent, focal) that a view shows.

    In the order of score (incumbents get `kept` more), at most `cap` to a screen cell and
    `limit` in all; focal rows are shown besides. A row that its cell leaves out never
    counts against the limit, so two rankings give what a scan would.
    """
    boosted = rows.withColumn("s", F.col("score") + F.when(F.col("incumbent"), kept).otherwise(0)).withColumn("ci", F.floor(F.col("px") / cell)).withColumn("cj", F.floor(F.col("py") / cell))
    plain = boosted.where("not focal").withColumn("n", F.row_number().over(Window.partitionBy("view", "ci", "cj").orderBy(F.col("s").desc(), "id"))).where(F.col("n") <= cap)
    shown = plain.withColumn("n", F.row_number().over(Window.partitionBy("view").orderBy(F.col("s").desc(), "id"))).where(F.col("n") <= limit)
    return shown.select("view", "id").union(boosted.where("focal").select("view", "id"))


def changes(shown: DataFrame, order: str = "view") -> DataFrame:
    """view, id, change (enter, stay, exit) between each view and the one before, numbered without gaps."""
    now = shown.select(order, "id", F.lit(True).alias("now"))
    before = shown.select((F.col(order) + 1).alias(order), "id", F.lit(True).alias("was"))
    last = shown.agg(F.max(order).alias("last"))
    both = now.join(before, [order, "id"], "full").crossJoin(F.broadcast(last)).where(F.col(order) <= F.col("last"))
    return both.select(order, "id", F.when(F.col("was").isNull(), "enter").when(F.col("now").isNull(), "exit").otherwise("stay").alias("change"))


def extent_pixels(rows: DataFrame, matrix: list[float | Column], width: float, height: float, least: float = 0.0, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """by, px, seen of rows(by, west, south, east, north): the larger side in pixels of the box around those of an extent's 5 x 5 points that are
    before the horizon of a view (w over `least`), and how many are; extents behind it have no row."""
    n = 5
    at = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    lon = F.col("west") + F.pmod(F.col("east") - F.col("west"), F.lit(360.0)) * F.pmod("_k", F.lit(n)) / (n - 1)
    lat = F.col("south") + (F.col("north") - F.col("south")) * F.floor(F.col("_k") / n) / (n - 1)
    at = at.withColumns({"_a": F.radians(lon), "_b": F.radians(lat)}).withColumns({"_x": F.cos("_b") * F.cos("_a"), "_y": F.cos("_b") * F.sin("_a"), "_z": F.sin("_b")})
    row = lambda r: matrix[4 * r] * F.col("_x") + matrix[4 * r + 1] * F.col("_y") + matrix[4 * r + 2] * F.col("_z") + matrix[4 * r + 3]
    at = at.withColumn("_w", row(3)).where(F.col("_w") > least)
    at = at.withColumns({"_px": (row(0) / F.col("_w") + 1) / 2 * width, "_py": (1 - row(1) / F.col("_w")) / 2 * height})
    side = lambda c: F.max(c) - F.min(c)
    return at.groupBy(*by).agg(F.greatest(side("_px"), side("_py")).alias("px"), F.count(F.lit(1)).alias("seen"))


def expansion(rows: DataFrame, split: float, merge: float) -> DataFrame:
    """rows(view, id, px) with expanded: a parent opens where its extent has `split` pixels, closes below `merge`, and between the two
    stays as it was in the view before (closed at first)."""
    told = F.when(F.col("px") >= split, True).when(F.col("px") < merge, False)
    w = Window.partitionBy("id").orderBy("view").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("expanded", F.coalesce(F.last(told, ignorenulls=True).over(w), F.lit(False)))


def collapse(visible: DataFrame, lineage: DataFrame) -> DataFrame:
    """visible(view, id, expanded) without rows that a visible, not expanded ancestor of lineage(node, ancestor) stands for; with `hidden`."""
    standing = visible.where("not expanded").select("view", F.col("id").alias("ancestor"))
    blocked = lineage.join(standing, "ancestor").select("view", F.col("node").alias("id"), F.lit(True).alias("blocked")).distinct()
    return visible.join(blocked, ["view", "id"], "left").withColumn("hidden", F.coalesce("blocked", F.lit(False))).drop("blocked")


def families(rows: DataFrame, lineage: DataFrame, split: float, merge: float, cell: int, markers: tuple[int, int], labelled: tuple[int, int]) -> DataFrame:
    """view, id, role ('marker' or 'context'), label: what each view shows of rows that stand for one another, and which of it bears a label.

    rows(view, id, score, px, py, size, seen, incumbent, focal) are those in the view's time, views being numbered in order; seen: on screen; size: the
    extent's pixels, null without one. A row is a parent in a view where it is an ancestor in lineage(node, ancestor) of a row seen there; it stands
    open as expansion() says. Rows seen that are neither open nor below a closed parent on screen, and the focal ones, are budgeted by
    viewport() with `markers`, (most to a cell, most in all), into markers; their open ancestors are context, on screen or not. Markers and the context on screen
    are budgeted again, with `labelled`. Lineage steps across rows out of the view's time count.
    """
    rows = stored(rows, "views")
    held = rows.select("view", F.col("id").alias("ancestor"), "size", "seen")
    above = rows.where("seen").select("view", "id").join(lineage.select(F.col("node").alias("id"), "ancestor"), "id")
    pairs = stored(above.join(held, ["view", "ancestor"]).select("view", "id", "ancestor", F.col("seen").alias("above_seen")), "pairs")
    parents = pairs.select("view", F.col("ancestor").alias("id")).distinct().withColumn("parent", F.lit(True))
    marked = rows.join(parents, ["view", "id"], "left").withColumn("parent", F.coalesce("parent", F.lit(False)) & F.col("size").isNotNull())
    told = expansion(marked.select("view", "id", "parent", F.when(F.col("parent"), F.col("size")).alias("px")), split, merge)
    open_ = stored(told.where("parent and expanded").select("view", "id"), "open")
    up = open_.select("view", F.col("id").alias("ancestor"))
    blocked = pairs.where("above_seen").join(up, ["view", "ancestor"], "left_anti").select("view", "id").distinct()
    hidden = open_.unionByName(blocked).distinct().withColumn("hidden", F.lit(True))
    eligible = rows.where("seen").join(hidden, ["view", "id"], "left").where(F.col("focal") | F.col("hidden").isNull())
    shown = stored(viewport(eligible, cell, *markers).distinct(), "shown")
    context = pairs.join(shown, ["view", "id"]).join(up, ["view", "ancestor"]).select("view", F.col("ancestor").alias("id")).distinct().join(shown, ["view", "id"], "left_anti")
    both = stored(shown.withColumn("role", F.lit("marker")).unionByName(context.withColumn("role", F.lit("context"))), "roles")
    named = viewport(rows.join(both, ["view", "id"]).where("seen").withColumn("focal", F.col("focal") & (F.col("role") == "marker")), cell, *labelled)
    return both.join(named.distinct().withColumn("label", F.lit(True)), ["view", "id"], "left").select("view", "id", "role", F.coalesce("label", F.lit(False)).alias("label"))


def unseen(rows: DataFrame, seen: DataFrame, last: int, seed: int) -> DataFrame:
    """user, id: for every user of seen(user, at, id) an id of rows(id) that is not among the last `last` seen; null if all are.

    Every user tries ids in an order of their own; the first last + 1 of them are enough.
    """
    recent = seen.withColumn("n", F.row_number().over(Window.partitionBy("user").orderBy(F.col("at").desc(), F.col("id").desc()))).where(F.col("n") <= last).select("user", "id").distinct()
    n = rows.count()
    numbered = rows.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("k"))  # openings are a short, curated list
    tries = seen.select("user").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(min(n, last + 1) - 1))))
    tries = tries.withColumn("k", F.pmod(F.col("user") * 31 + seed + F.col("t") * 1, F.lit(n)).cast("int")).join(numbered, "k")
    left = tries.join(recent, ["user", "id"], "left_anti")
    return seen.select("user").distinct().join(left.groupBy("user").agg(F.min_by("id", "t").alias("id")), "user", "left")


def largest_first(pieces: DataFrame, least: float, share: float) -> DataFrame:
    """pieces(group, piece, area) with rank: the largest always, others of at least `least` and `share` of the largest."""
    w = Window.partitionBy("group").orderBy(F.col("area").desc(), "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(w)).withColumn("most", F.first("area").over(w))
    return ranked.where((F.col("rank") == 1) | ((F.col("area") >= least) & (F.col("area") >= share * F.col("most")))).drop("most")


def strongest(rows: DataFrame, n: int) -> DataFrame:
    """The n rows(view, id, size, fade) of each view that are largest after fading."""
    w = Window.partitionBy("view").orderBy(F.col("faded").desc(), "id")
    return rows.withColumn("faded", F.round(F.col("size") * F.col("fade"), 6)).where("faded > 0").withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def labels(boxes: DataFrame, cap: int, room: float = 0.0) -> DataFrame:
    """view, id of boxes(view, id, rank, kept, x0, y0, x1, y1) placed in order of rank, then id, none over one placed, at most `cap` to a view.

    Boxes shown before (`kept`) need their own place, new ones `room` more on each side. The first BATCH boxes of each view are
    placed as far as they go; the view's other boxes that are clear of those placed come in further batches, until it is full.
    """
    keep = ["view", "id", "x0", "y0", "x1", "y1"]
    pad = F.when(F.col("kept"), F.lit(0.0)).otherwise(F.lit(float(room)))
    left = boxes.select("view", "id", "rank", *[F.col(c).cast("double").alias(c) for c in keep[2:]], pad.alias("pad"))
    schema = left.select(*keep).schema
    taken: DataFrame | None = None

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        placed = pdf[pdf.old]
        held = list(placed[keep[2:]].itertuples(index=False))
        out = []
        for r in pdf[~pdf.old].sort_values(["rank", "id"]).itertuples():
            if len(held) < cap and all(r.x1 + r.pad <= t.x0 or t.x1 <= r.x0 - r.pad or r.y1 + r.pad <= t.y0 or t.y1 <= r.y0 - r.pad for t in held):
                held.append(r)
                out.append((r.view, r.id, r.x0, r.y0, r.x1, r.y1))
        return pd.DataFrame(out, columns=keep)

    clear = lambda t: (F.col("x1") + F.col("pad") <= t["x0"]) | (t["x1"] <= F.col("x0") - F.col("pad")) | (F.col("y1") + F.col("pad") <= t["y0"]) | (t["y1"] <= F.col("y0") - F.col("pad"))
    while True:
        left = stored(left, "boxes")
        top = left.withColumn("_n", F.row_number().over(Window.partitionBy("view").orderBy("rank", "id"))).where(F.col("_n") <= BATCH).drop("_n").withColumn("old", F.lit(False))
        if taken is not None:
            top = top.unionByName(taken.select(*keep, F.lit(True).alias("old")), allowMissingColumns=True)
        got = stored(top.groupBy("view").applyInPandas(place, schema), "placed")  # BATCH + cap rows to a group at most
        taken = got if taken is None else stored(taken.unionByName(got), "placed")
        of = taken.groupBy("view").agg(F.collect_list(F.struct(*keep[1:])).alias("_t"))  # cap at most
        more = join_bounded(left, of, ["view"]).where((F.size("_t") < cap) & F.forall("_t", clear))
        left = more.drop("_t")
        if got.isEmpty() or left.isEmpty():
            return taken.select("view", "id")


def capped(names: DataFrame, tile_px: int, across: int, down: int, cap: int, slots: int, grow: float = 1.0) -> DataFrame:
    """view, id, tiles of names(view, id, rank, discs) that go into every tile of a view's across x down grid that one of their discs, `grow` times as wide, reaches.

    In order of rank, then id: a name with a tile that holds `cap` names already, or with more tiles than the view has slots left, goes into none. discs is an
    array of struct(x, y, r). The first BATCH names of each view are admitted or refused together; refusals are for good, so of the others
    only those clear of full tiles come again. Names that reach no tile, or have nulls, are left out.
    """
    d = names.where("id is not null and view is not null and rank is not null").select("view", "id", "rank", F.explode("discs").alias("d"))
    d = d.select("view", "id", "rank", F.col("d.x").cast("double").alias("_x"), F.col("d.y").cast("double").alias("_y"), (F.col("d.r") * grow).alias("_r")).dropna()
    low = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - F.col("_r")) / tile_px).cast("int"))
    high = lambda c, n: F.least(F.lit(n - 1), F.floor((F.col(c) + F.col("_r")) / tile_px).cast("int"))
    d = d.withColumns({"_x0": low("_x"), "_x1": high("_x", across), "_y0": low("_y"), "_y1": high("_y", down)}).where("_x0 <= _x1 and _y0 <= _y1")
    d = d.withColumn("_tx", F.explode(F.sequence("_x0", "_x1"))).withColumn("_ty", F.explode(F.sequence("_y0", "_y1")))
    off = lambda c, t: F.col(c) - F.greatest(F.col(t) * tile_px, F.least(F.col(c), (F.col(t) + 1) * tile_px))
    d = d.where(off("_x", "_tx") * off("_x", "_tx") + off("_y", "_ty") * off("_y", "_ty") <= F.col("_r") * F.col("_r"))
    left = d.groupBy("view", "id", "rank").agg(F.array_sort(F.collect_set(F.col("_ty") * across + F.col("_tx"))).alias("tiles"))  # across * down at most
    schema = left.select("view", "id", "tiles").schema
    taken: DataFrame | None = None

    def admit(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: dict[int, int] = {}
        used, out = 0, []
        for tiles in pdf[pdf.old].tiles:
            used += len(tiles)
            for t in tiles:
                counts[t] = counts.get(t, 0) + 1
        for r in pdf[~pdf.old].sort_values(["rank", "id"]).itertuples():
            if used + len(r.tiles) <= slots and all(counts.get(t, 0) < cap for t in r.tiles):
                used += len(r.tiles)
                for t in r.tiles:
                    counts[t] = counts.get(t, 0) + 1
                out.append((r.view, r.id, r.tiles))
        return pd.DataFrame(out, columns=["view", "id", "tiles"])

    while True:
        left = stored(left.withColumn("_n", F.row_number().over(Window.partitionBy("view").orderBy("rank", "id"))), "names")
        top = left.where(F.col("_n") <= BATCH).drop("_n").withColumn("old", F.lit(False))
        if taken is not None:
            top = top.unionByName(taken.withColumn("old", F.lit(True)), allowMissingColumns=True)
        got = stored(top.groupBy("view").applyInPandas(admit, schema), "admitted")  # BATCH names and the view's slots at most
        taken = got if taken is None else stored(taken.unionByName(got), "admitted")
        held = taken.select("view", F.explode("tiles").alias("t")).groupBy("view", "t").agg(F.count(F.lit(1)).alias("c"))
        state = held.groupBy("view").agg(F.sum("c").alias("used"), F.collect_list(F.when(F.col("c") >= cap, F.col("t"))).alias("full"))  # a view's tiles
        rest = join_bounded(left.where(F.col("_n") > BATCH).drop("_n"), stored(state, "tiles"), ["view"])
        left = rest.where((F.coalesce("used", F.lit(0)) + F.size("tiles") <= slots) & (F.col("full").isNull() | ~F.arrays_overlap("tiles", "full"))).drop("used", "full")
        if left.isEmpty():
            return taken


def level_of(entries: DataFrame, full: float, keep: float) -> DataFrame:
    """region, level: the level at which each region of entries(region, level, reveal, before) shows its names, none where nothing is revealed.

    The lowest level with a reveal of `full`, else the lowest that is shown; the level shown before stays while it is revealed
    by `keep` and no lower one is full.
    """
    by = entries.where("reveal > 0").groupBy("region", "level").agg(F.max("reveal").alias("r"), F.first("before").alias("before"))
    got = by.groupBy("region").agg(
        F.min(F.when(F.col("r") >= full, F.col("level"))).alias("full"),
        F.min("level").alias("lowest"),
        F.max(F.when((F.col("level") == F.col("before")) & (F.col("r") >= keep), F.col("level"))).alias("stays"),
    )
    held = F.col("stays").isNotNull() & (F.col("full").isNull() | (F.col("full") >= F.col("stays")))
    return got.select("region", F.when(held, F.col("stays")).otherwise(F.coalesce("full", "lowest")).alias("level"))
