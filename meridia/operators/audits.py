"""Audits: each gives a table of faults, empty when all is well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import cal
from meridia.functions.text import day_mentions
from meridia.shared import join_bounded


def config_faults(classes: DataFrame) -> DataFrame:
    """cls, fault: listed twice, a weight that isn't positive, within itself, within an unlisted class."""
    n = F.count(F.lit(1)).over(Window.partitionBy("cls"))
    known = classes.select(F.col("cls").alias("within"), F.lit(True).alias("known")).distinct()
    rows = classes.withColumn("n", n).join(known, "within", "left")
    fault = F.when(F.col("n") > 1, "listed twice").when(F.col("weight") <= 0, "weight").when(F.col("within") == F.col("cls"), "within itself").when(F.col("within").isNotNull() & F.col("known").isNull(), "unlisted")
    return rows.select("cls", fault.alias("fault")).where("fault is not null")


def page_faults(rows: DataFrame, block: int = 1 << 16) -> DataFrame:
    """qid, fault of rows(page, row, qid, t0, t1, parent, score, lon, lat): each row bears the first fault that holds.

    A row's score is held against that of the row before it on its page. Pages are looked at in blocks of `block` row numbers, and a block's
    first row against the last of the block before, so no task orders a page. Ids that occur twice on a page are counted, not gathered. Nulls make no fault.
    """
    rows = rows.withColumn("_block", F.floor(F.col("row") / block))
    ends = rows.groupBy("page", "_block").agg(F.max_by("score", "row").alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy("page").orderBy("_block"))).select(F.col("page").alias("_page"), F.col("_block").alias("_of"), "_before")  # a row per block
    before = before.where("_before is not null")
    twice = rows.groupBy("page", "qid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("page").alias("_page"), F.col("qid").alias("_qid"), F.lit(True).alias("_twice"))
    last = F.lag(F.struct("score")).over(Window.partitionBy("page", "_block").orderBy("row"))
    checked = rows.withColumn("_last", last).join(before, F.col("page").eqNullSafe(F.col("_page")) & (F.col("_block") == F.col("_of")), "left").drop("_page")
    checked = checked.join(twice, F.col("page").eqNullSafe(F.col("_page")) & F.col("qid").eqNullSafe(F.col("_qid")), "left")
    fault = (
        F.when(~F.col("lon").between(-180, 180) | ~F.col("lat").between(-90, 90), "place")
        .when(F.col("t0") > F.col("t1"), "span")
        .when(F.col("parent") == F.col("qid"), "own parent")
        .when(F.col("score") > F.when(F.col("_last").isNotNull(), F.col("_last.score")).otherwise(F.col("_before")), "order")
        .when(F.col("_twice"), "id twice")
    )
    return checked.select("qid", fault.alias("fault")).where("fault is not null")


def opening_faults(openings: DataFrame, index: DataFrame, lineage: DataFrame, last_day: int) -> DataFrame:
    """id, fault of openings(id, day, placed, line) against index(id, t0, t1): absent, day outside the span, a written place, part of another
    opening, begun after `last_day`, a line that names a day and month other than those of its day as written then."""
    inside = join_bounded(lineage, openings.select(F.col("id").alias("ancestor")).distinct(), ["ancestor"], "left_semi").select(F.col("node").alias("id"), F.lit(True).alias("part")).distinct()
    rows = openings.join(index, "id", "left").join(inside, "id", "left").withColumn("_d", cal.historical_civil("day"))
    month = F.element_at(F.array(*map(F.lit, cal.MONTHS)), F.col("_d.m"))
    own = F.concat(F.col("_d.d").cast("string"), F.lit(" "), month)
    other = F.exists(day_mentions("line"), lambda m: m != own)
    fault = F.when(F.col("t0").isNull(), "absent").when(~F.col("day").between(F.col("t0"), F.col("t1")), "day").when(F.col("placed"), "place").when(F.col("part"), "part of another").when(F.col("t0") > last_day, "too late").when(other, "line")
    return rows.select("id", fault.alias("fault")).where("fault is not null")


def count_faults(drawn: DataFrame, valid: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """step, off: steps where drawn differs from valid + added - removed; all are (step, name)."""
    signed = drawn.select("step", F.lit(1).alias("n")).union(valid.select("step", F.lit(-1))).union(added.select("step", F.lit(-1))).union(removed.select("step", F.lit(1)))
    return signed.groupBy("step").agg(F.sum("n").alias("off")).where("off <> 0")


def shore_faults(runs: DataFrame, excuses: DataFrame, by: list[str], most_km: float) -> DataFrame:
    """Runs (cells.shore_runs) longer than `most_km` that no excuse names: excuses(by, j0, i0, j1, i1) hold for runs whose boxes they meet."""
    long = runs.where(F.col("km") > most_km)
    boxes = excuses.select(*by, *[F.col(c).alias(f"e_{c}") for c in ("j0", "i0", "j1", "i1")])
    meets = (F.col("e_j0") <= F.col("j1")) & (F.col("e_j1") >= F.col("j0")) & (F.col("e_i0") <= F.col("i1")) & (F.col("e_i1") >= F.col("i0"))
    excused = long.join(boxes, by).where(meets).select(*by, "region").distinct()
    return long.join(excused, [*by, "region"], "left_anti")


def sign_agreement(coarse: DataFrame, fine: DataFrame, k: int) -> DataFrame:
    """checked, agreeing: coarse(j, i, value) cells whose k x k fine cells all have one sign, and those that have it too."""
    block = fine.groupBy(F.floor(F.col("j") / k).alias("j"), F.floor(F.col("i") / k).alias("i")).agg(F.min(F.signum("value")).alias("a"), F.max(F.signum("value")).alias("b"))
    both = coarse.join(block.where("a = b"), ["j", "i"])
    return both.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.signum("value") == F.col("a")).alias("agreeing"))


def border_mismatches(texels: DataFrame, side: int) -> DataFrame:
    """tile, other, at: texels(tile, row, col, j, i, value) where neighbour tiles of the next col or the next row differ on the column or row that both bear; `at` is the j or the i there."""
    east = texels.where(F.col("i") == side - 1).select("tile", "row", "col", "j", "value")
    west = texels.where(F.col("i") == 0).select(F.col("tile").alias("other"), "row", (F.col("col") - 1).alias("col"), "j", F.col("value").alias("theirs"))
    beside = east.join(west, ["row", "col", "j"]).where("value <> theirs").select("tile", "other", F.col("j").alias("at"))
    north = texels.where(F.col("j") == side - 1).select("tile", "row", "col", "i", "value")
    south = texels.where(F.col("j") == 0).select(F.col("tile").alias("other"), (F.col("row") - 1).alias("row"), "col", "i", F.col("value").alias("theirs"))
    return beside.union(north.join(south, ["row", "col", "i"]).where("value <> theirs").select("tile", "other", F.col("i").alias("at")))


def owed(items: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """id, state: items(id) without an acknowledgement, and acknowledgements of items that are gone."""
    both = items.select("id", F.lit(True).alias("here")).distinct().join(acknowledged.select("id", F.lit(True).alias("said")).distinct(), "id", "full")
    return both.select("id", F.when(F.col("said").isNull(), "owed").when(F.col("here").isNull(), "lapsed").alias("state")).where("state is not null")


def missing_characters(names: DataFrame, font: DataFrame) -> DataFrame:
    """name, missing: characters of names(name) that font(ch) lacks, sorted."""
    chars = names.select("name", F.explode(F.array_distinct(F.split("name", ""))).alias("ch"))
    return chars.join(font, "ch", "left_anti").groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("ch")), "").alias("missing"))


def route_faults(vertices: DataFrame) -> DataFrame:
    """route, idx, fault of vertices(route, idx, lon, lat, day): coordinates, no date, a date before the last, a gap in idx, opposite points."""
    w = Window.partitionBy("route").orderBy("idx")
    rows = vertices
    for c in ("lon", "lat", "day", "idx"):
        rows = rows.withColumn(f"b_{c}", F.lag(c).over(w))
    opposite = (F.abs(F.col("lat") + F.col("b_lat")) < 1e-9) & (F.abs(F.abs(F.col("lon") - F.col("b_lon")) - 180) < 1e-9)
    fault = (
        F.when(~F.col("lon").between(-180, 180) | ~F.col("lat").between(-90, 90), "place")
        .when(F.col("day").isNull(), "no date")
        .when(F.col("day") < F.col("b_day"), "backward")
        .when(F.col("idx") != F.coalesce(F.col("b_idx") + 1, F.lit(0)), "gap")
        .when(opposite, "opposite")
    )
    return rows.select("route", "idx", fault.alias("fault")).where("fault is not null")


def consistency(manifest: DataFrame) -> DataFrame:
    """item, versions of manifest(product, item, version) where products give an item different versions."""
    return manifest.groupBy("item").agg(F.count_distinct("version").alias("versions")).where("versions > 1")


def unnamed(units: DataFrame, placed: DataFrame) -> DataFrame:
    """unit, first, last: runs of steps in which units(unit, step) have no place among placed(unit, step)."""
    from meridia.operators.cells import runs

    return runs(units.join(placed, ["unit", "step"], "left_anti"), ["unit"], "step")


def expectations(expected: DataFrame, texels: DataFrame) -> DataFrame:
    """id, fault of expected(id, j, i, low, high) against texels(j, i, value): absent or outside the range."""
    rows = expected.join(texels, ["j", "i"], "left")
    fault = F.when(F.col("value").isNull(), "absent").when(~F.col("value").between(F.col("low"), F.col("high")), "outside")
    return rows.select("id", fault.alias("fault")).where("fault is not null")


def timings(samples: DataFrame, by: list[str], budget: float) -> DataFrame:
    """by, samples, p50, p95 (nearest rank), interval (mean of the fastest quarter), missed (over the budget)."""
    counts = samples.where("ms is not null").groupBy(*by, "ms").agg(F.count(F.lit(1)).alias("c"))  # one row per value
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    # The fastest quarter has the first n / 4 samples, rounded up: of a value that it ends in, some.
    first = F.ceil(F.col("n") / 4)
    inside = F.greatest(F.lit(0), F.least("c", first - (F.col("upto") - F.col("c"))))
    nearest = lambda p: F.min(F.when(F.col("upto") >= F.col("n") * p, F.col("ms")))
    return ranked.groupBy(*by).agg(F.sum("c").alias("samples"), nearest(0.5).alias("p50"), nearest(0.95).alias("p95"), (F.sum(F.col("ms") * inside) / F.sum(inside)).alias("interval_ms"), F.sum(F.when(F.col("ms") > budget, F.col("c")).otherwise(0)).alias("missed"))


def correction_faults(corrections: DataFrame, eras: DataFrame, last_year: int, kinds: Sequence[str], unsourced: Sequence[str] = ("overlap",)) -> DataFrame:
    """era, number, fault of corrections(era, number, kind, y0, y1, why, source): the first that holds, none for those in order.

    A kind that isn't known, years that lack or run backward, an era that eras(era, low, high) lacks, a start outside its era (a null side is open), an
    end past the last year, no reason, and no source where the kind needs one. Nulls count as lacking. Of rows that share era and number all are
    'repeated', unless they have a fault of their own.
    """
    known = join_bounded(corrections.select("era", "number", "kind", "y0", "y1", "why", "source"), eras.select("era", "low", "high").withColumn("there", F.lit(True)), ["era"])
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    fault = (
        F.when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "operation")
        .when(F.col("y0").isNull() | F.col("y1").isNull() | (F.col("y0") > F.col("y1")), "years")
        .when(F.col("there").isNull(), "era")
        .when((F.col("y0") < F.col("low")) | (F.col("y0") > F.col("high")), "outside its era")
        .when(F.col("y1") > last_year, "past the last year")
        .when(empty("why"), "no reason")
        .when(empty("source") & ~F.col("kind").isin(*unsourced), "no source")
    )
    twice = corrections.groupBy("era", "number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("era", "number", F.lit(True).alias("twice"))
    told = known.withColumn("fault", fault).join(twice, ["era", "number"], "left")
    return told.select("era", "number", F.coalesce("fault", F.when(F.col("twice"), "repeated")).alias("fault")).where("fault is not null")
