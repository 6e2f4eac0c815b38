"""Pieces of a map that changes, kept over runs of steps instead of worked out anew at each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.cells import around, opened, regions
from meridia.operators.graph import components
from meridia.operators.grid import km2
from meridia.shared import stored

#: Cells on a side of a block, cells around it that its facts depend on, and steps to a bucket of linked parts.
BLOCK, HALO, BUCKET = 8, 2, 16
_EPOCH = ["bj", "bi", "e0"]


def _block(j: Column, i: Column, columns: int) -> list[Column]:
    return [F.floor(j / BLOCK).cast("int").alias("bj"), F.floor(F.pmod(i, F.lit(columns)) / BLOCK).cast("int").alias("bi")]


def in_blocks(df: DataFrame, columns: int) -> DataFrame:
    """df(j, i) once for each block (bj, bi) that a cell lies in or within HALO of."""
    reach = range(-HALO, HALO + 1)
    at = F.array_distinct(F.array(*[F.struct(*_block(F.col("j") + a, F.col("i") + b, columns)) for a in reach for b in reach]))
    return df.withColumn("_b", F.explode(at)).select(*df.columns, "_b.bj", "_b.bi")


def epochs(changes: DataFrame, by: list[str], steps: int) -> DataFrame:
    """by, e0, e1: the runs of steps between changes(by, step), the last of which ends with step `steps` - 1."""
    w = Window.partitionBy(*by).orderBy("step")  # the steps of one key: `steps` rows at most
    runs = changes.where(F.col("step") < steps).select(*by, F.col("step").cast("int").alias("step")).distinct()
    return runs.select(*by, F.col("step").alias("e0"), F.coalesce(F.lead("step").over(w) - 1, F.lit(steps - 1)).alias("e1"))


def _meetings(blocks: DataFrame, runs: DataFrame, columns: int) -> DataFrame:
    """side, bj, bi, e0, nj, ni, n0: the epochs of a block and of its next one to the right or below that share a step, one row for each step at which either begins."""
    pair = F.explode(F.array(F.struct(F.lit("below").alias("side"), (F.col("bj") + 1).alias("nj"), F.col("bi").alias("ni")), F.struct(F.lit("right").alias("side"), F.col("bj").alias("nj"), _block(F.col("bj"), F.least((F.col("bi") + 1) * BLOCK, F.lit(columns)), columns)[1].alias("ni"))))
    pairs = blocks.withColumn("p", pair).select("bj", "bi", "p.*").where("nj <> bj or ni <> bi")
    pairs = pairs.join(blocks.select(F.col("bj").alias("nj"), F.col("bi").alias("ni")), ["nj", "ni"], "left_semi")
    key = ["side", "bj", "bi", "nj", "ni"]
    none = F.lit(None).cast("int")
    own = pairs.join(runs, ["bj", "bi"]).select(*key, F.col("e0").alias("s"), F.col("e0").alias("x"), none.alias("y"))
    next_ = pairs.join(runs.select(F.col("bj").alias("nj"), F.col("bi").alias("ni"), "e0"), ["nj", "ni"]).select(*key, F.col("e0").alias("s"), none.alias("x"), F.col("e0").alias("y"))
    both = own.unionByName(next_).groupBy(*key, "s").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    w = Window.partitionBy(*key).orderBy("s")  # the steps of two blocks
    return both.select(*key, F.last("x", ignorenulls=True).over(w).alias("e0"), F.last("y", ignorenulls=True).over(w).alias("n0"))


def unclaimed(dry: DataFrame, spans: DataFrame, lakes: DataFrame, outer: DataFrame, steps: int, rows: int, columns: int) -> DataFrame:
    """first, last, region, cells, km2, wide, core (cells), lake, coast, states, state of the connected pieces of dry land that none holds, over runs of steps 0 to `steps` - 1.

    dry(j, i) and lakes(j, i) are the same at all steps; spans(name, j, i, first, last) are the steps over which a name holds a cell;
    outer(name, outer). A piece is wide where it is three cells wide somewhere, its core being those parts; coast: it touches what is
    neither dry nor lake; states: how many outer units touch it, state the first of them.

    The grid is cut into blocks, and a block's steps into epochs in which nothing in it or next to it changes; parts of pieces and their facts are
    worked out once for each epoch. Parts of blocks side by side whose epochs meet are linked; what is ever linked is looked at anew only where one
    of its parts begins or ends. So rows grow with blocks' cells times the changes near them, then with linked parts times the changes among them. A run
    may end though its piece goes on unchanged. Spans with a null, of negative length, or outside of the steps hold nothing; without
    dry land, or steps, there are no rows; repeated rows count once.
    """
    dry, lakes = dry.select("j", "i").dropna().distinct(), lakes.select("j", "i").dropna().distinct()
    units = spans.dropna(subset=["name", "j", "i", "first", "last"]).join(outer.dropDuplicates(["name"]), "name", "left").select("j", "i", F.greatest(F.col("first"), F.lit(0)).cast("int").alias("first"), F.least(F.col("last"), F.lit(steps - 1)).cast("int").alias("last"), F.coalesce("outer", "name").alias("unit"))
    units = units.where("first <= last").distinct()
    blocks = stored(dry.select(*_block(F.col("j"), F.col("i"), columns)).distinct(), "blocks")
    claims = stored(in_blocks(units, columns).join(blocks, ["bj", "bi"], "left_semi"), "claims")
    changes = claims.select("bj", "bi", F.explode(F.array(F.col("first"), F.col("last") + 1)).alias("step"))
    runs = stored(epochs(changes.unionByName(blocks.withColumn("step", F.lit(0))), ["bj", "bi"], steps), "epochs")
    taken = stored(claims.join(runs, ["bj", "bi"]).where("first <= e0 and e0 <= last").select(*_EPOCH, "j", "i", "unit").distinct(), "taken")
    land = in_blocks(dry, columns).join(runs, ["bj", "bi"]).select(*_EPOCH, "j", "i")
    free = stored(land.join(taken, [*_EPOCH, "j", "i"], "left_anti"), "free")
    bj, bi = _block(F.col("j"), F.col("i"), columns)
    pieces = stored(regions(free.where((bj == F.col("bj")) & (bi == F.col("bi"))), _EPOCH, columns), "pieces")

    key = [*_EPOCH, "region"]
    size = pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("cells"), F.sum(km2(F.col("j"), rows, columns)).alias("km2"))
    core = opened(free, _EPOCH, columns).join(pieces, [*_EPOCH, "j", "i"]).groupBy(*key).agg(F.count(F.lit(1)).alias("core"))
    beside = stored(around(pieces, 1, columns).select(*key, "j", "i").distinct().where(F.col("j").between(0, rows - 1)), "beside")
    by_lake = beside.join(lakes, ["j", "i"], "left_semi").select(*key).distinct().withColumn("lake", F.lit(True))
    by_sea = beside.join(dry, ["j", "i"], "left_anti").join(lakes, ["j", "i"], "left_anti").select(*key).distinct().withColumn("coast", F.lit(True))
    node = F.concat_ws("/", *key).alias("node")
    parts = size.join(core, key, "left").join(by_lake, key, "left").join(by_sea, key, "left").join(runs, _EPOCH)
    parts = stored(parts.select(node, "e0", "e1", "region", "cells", "km2", "core", "lake", "coast"), "parts")
    touch = stored(beside.join(taken, [*_EPOCH, "j", "i"]).select(node, "unit").distinct(), "touch")

    named = pieces.select(*_EPOCH, "j", "i", node)
    last_row, last_column = F.pmod("j", F.lit(BLOCK)) == BLOCK - 1, (F.pmod("i", F.lit(BLOCK)) == BLOCK - 1) | (F.col("i") == columns - 1)
    edge = named.where(last_row).withColumn("side", F.lit("below")).withColumn("j", F.col("j") + 1).unionByName(named.where(last_column).withColumn("side", F.lit("right")).withColumn("i", F.pmod(F.col("i") + 1, F.lit(columns))))
    over = edge.join(_meetings(blocks, runs, columns), ["side", *_EPOCH]).select("nj", "ni", "n0", "j", "i", F.col("node").alias("a"))
    links = over.join(named.select(F.col("bj").alias("nj"), F.col("bi").alias("ni"), F.col("e0").alias("n0"), "j", "i", F.col("node").alias("b")), ["nj", "ni", "n0", "j", "i"])
    links = stored(links.select("a", "b").distinct(), "links")
    return _joined(parts, links, touch, steps)


def _joined(parts: DataFrame, links: DataFrame, touch: DataFrame, steps: int) -> DataFrame:
    """Whole pieces over runs of steps, of parts(node, e0, e1, ...) and links(a, b) between parts that share steps."""
    ever = stored(parts.select("node", "e0", "e1").join(components(links), "node", "left").select("node", "e0", "e1", F.coalesce("component", "node").alias("group")), "groups")
    runs = epochs(ever.select("group", F.explode(F.array(F.col("e0"), F.col("e1") + 1)).alias("step")), ["group"], steps).select("group", F.col("e0").alias("s0"), F.col("e1").alias("s1"))
    runs = stored(runs.withColumn("k", F.floor(F.col("s0") / BUCKET)), "runs")

    def at(df: DataFrame, first: str, last: str) -> DataFrame:
        """df(group, first, last) with each run of its group that begins in its steps, by buckets of steps, so that a group is no single key."""
        return df.withColumn("k", F.explode(F.sequence(F.floor(F.col(first) / BUCKET), F.floor(F.col(last) / BUCKET)))).join(runs, ["group", "k"]).where(F.col("s0").between(F.col(first), F.col(last))).drop("k")

    mark = lambda x: F.concat_ws("/", F.lpad(F.col("s0").cast("string"), 9, "0"), x)
    there = stored(at(ever, "e0", "e1").select("node", "s0", "s1", mark("node").alias("id")), "there")
    side = lambda x: ever.select(F.col("node").alias(x), F.col("e0").alias(f"{x}0"), F.col("e1").alias(f"{x}1"), *([F.col("group")] if x == "a" else []))
    spans = links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "group", F.greatest("a0", "b0").alias("f"), F.least("a1", "b1").alias("t"))
    piece = components(at(spans.where("f <= t"), "f", "t").select(mark("a").alias("a"), mark("b").alias("b")))
    owned = stored(there.join(piece.withColumnRenamed("node", "id"), "id", "left").select("node", "s0", "s1", F.coalesce("component", "id").alias("piece")), "owned")
    facts = owned.join(parts, "node").groupBy("piece").agg(
        F.min("s0").alias("first"), F.min("s1").alias("last"), F.min("region").alias("region"), F.sum("cells").alias("cells"), F.sum("km2").alias("km2"),
        F.coalesce(F.sum("core"), F.lit(0)).alias("core"), F.coalesce(F.bool_or("lake"), F.lit(False)).alias("lake"), F.coalesce(F.bool_or("coast"), F.lit(False)).alias("coast"),
    )
    states = owned.join(touch, "node").groupBy("piece").agg(F.count_distinct("unit").alias("states"), F.min("unit").alias("state"))
    out = facts.join(states, "piece", "left")
    return out.select("first", "last", "region", "cells", "km2", (F.col("core") > 0).alias("wide"), "core", "lake", "coast", F.coalesce("states", F.lit(0)).alias("states"), F.when(F.col("states") == 1, F.col("state")).alias("state"))


def step_spans(rows: DataFrame, years: DataFrame) -> DataFrame:
    """rows(first, last, ...), in years, with the first and the last of years(step, year) in them instead; rows without one are left out.

    Steps are sought in the sorted years, one row per change year, which every task gets.
    """
    steps = years.agg(F.array_sort(F.collect_list(F.struct(F.col("year").cast("int").alias("year"), F.col("step").cast("int").alias("step")))).alias("_y"))
    inside = F.filter("_y", lambda y: y["year"].between(F.col("first"), F.col("last")))
    found = rows.crossJoin(F.broadcast(steps)).withColumn("_in", inside).where(F.size("_in") > 0)  # one row of years
    return found.withColumn("first", F.element_at("_in", 1)["step"]).withColumn("last", F.element_at("_in", -1)["step"]).drop("_y", "_in")
