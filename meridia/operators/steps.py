"""Polity records to one consistent map per change year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.cells import opened, overlaps, regions, runs
from meridia.operators.grid import km2
from meridia.operators.joins import closure, interval_join
from meridia.shared import bounded, join_bounded, shuffled, stored


def change_years(rows: DataFrame) -> DataFrame:
    """step, year of rows(row_id, first, last): the years in which the set of valid rows may change, whose set differs from that of the year before.

    The sign of a set is a hash of its sorted row ids.
    """
    years = rows.select(F.explode(F.array(F.col("first"), F.col("last") + 1)).alias("year")).distinct().withColumn("until", F.col("year"))
    valid = interval_join(rows, years, "first", "last", "year", "until", 10)
    signs = valid.groupBy("year").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("row_id").cast("string"))), ","), 256).alias("sign"))
    signs = years.select("year").join(signs, "year", "left").withColumn("sign", F.coalesce("sign", F.lit("")))
    w = Window.orderBy("year")  # one row per change year
    changed = signs.withColumn("before", F.lag("sign").over(w)).where("before is null or before <> sign").drop("before")
    return changed.withColumn("step", F.row_number().over(w) - 1).select("step", "year", "sign")


def merged(placements: DataFrame, by: list[str]) -> DataFrame:
    """Equal rows of consecutive steps as one: by, first, last."""
    return runs(placements, by, "step")


def gaps(spans: DataFrame) -> DataFrame:
    """name, gone (first year), back of spans(name, first, last) that end before the next begins."""
    w = Window.partitionBy("name").orderBy("first", "last")
    seen = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("seen", seen).where(F.col("first") > F.col("seen") + 1).select("name", (F.col("seen") + 1).alias("gone"), F.col("first").alias("back"))


def gap_runs(holders: DataFrame) -> DataFrame:
    """j, i, before, after, first, last: the runs of steps in which a cell of holders(step, j, i, name) is unclaimed between two holders.

    Only rows with a name count, so that no cell has to be there at every step.
    """
    w = Window.partitionBy("j", "i").orderBy("step")
    held = holders.where("name is not null").select("step", "j", "i", F.col("name").alias("before"), F.lead("step").over(w).alias("back"), F.lead("name").over(w).alias("after"))
    return held.where(F.col("back") > F.col("step") + 1).select("j", "i", "before", "after", (F.col("step") + 1).alias("first"), (F.col("back") - 1).alias("last"))


def carried(holders: DataFrame, years: DataFrame, most: int) -> DataFrame:
    """step, j, i, name of unclaimed cells between the same holder on both sides, where no more than `most` years lie from the run's first step to the step itself.

    holders(step, j, i, name) has one holder to a cell, null or no row where unclaimed; years(step, year), steps without gaps.
    """
    year = lambda x, y: years.select(F.col("step").alias(x), F.col("year").alias(y))
    runs_ = join_bounded(gap_runs(holders).where("before = after"), year("first", "_from"), ["first"], "inner")
    rows = join_bounded(runs_.withColumn("step", F.explode(F.sequence("first", "last"))), year("step", "_at"), ["step"], "inner")
    return rows.where(F.col("_at") - F.col("_from") <= most).select("step", "j", "i", F.col("before").alias("name"))


def wide_only(carry: DataFrame, columns: int, reach: int = 1) -> DataFrame:
    """carried()'s cells without parts that are nowhere 2 * reach + 1 wide, step by step and name by name: slivers are left to the rules."""
    return opened(carry, ["step", "name"], columns, reach).select("step", "j", "i", "name")


def carried_units(carry: DataFrame, units: DataFrame) -> DataFrame:
    """step, name, outer, cells of carried cells(step, j, i, name): the outer unit is that of the largest part of what the name
    held in units(name, outer, cells), of equal parts the first; a name without one is its own."""
    largest = units.groupBy("name").agg(F.max_by("outer", F.struct("cells", F.struct("outer"))).alias("outer"))
    return carry.groupBy("step", "name").agg(F.count(F.lit(1)).alias("cells")).join(largest, "name", "left").select("step", "name", F.coalesce("outer", "name").alias("outer"), "cells")


def unresolved(holders: DataFrame, years: DataFrame, most: int, least_km2: float, rows: int, columns: int, acknowledged: DataFrame | None = None) -> DataFrame:
    """a, b, first, last, region, cells, km2: regions of cells that are unclaimed over the same run of steps, `most` years at most, between two
    holders, of `least_km2` at least. acknowledged(a, b, first, last) leaves out the runs between its names that lie in its steps."""
    year = lambda x, y: years.select(F.col("step").alias(x), F.col("year").alias(y))
    spans = join_bounded(join_bounded(gap_runs(holders), year("first", "y0"), ["first"], "inner"), year("last", "y1"), ["last"], "inner").where(F.col("y1") - F.col("y0") <= most)
    by = ["before", "after", "first", "last"]
    found = regions(spans, by, columns).groupBy(*by, "region").agg(F.count(F.lit(1)).alias("cells"), F.sum(km2(F.col("j"), rows, columns)).alias("km2"))
    found = found.where(F.col("km2") >= least_km2).withColumnsRenamed({"before": "a", "after": "b"})
    if acknowledged is not None:
        known = acknowledged.select("a", "b", F.col("first").alias("_f"), F.col("last").alias("_l"))
        named = found.join(known, ["a", "b"]).where((F.col("_f") <= F.col("first")) & (F.col("last") <= F.col("_l"))).select("a", "b", "first", "last", "region").distinct()
        found = found.join(named, ["a", "b", "first", "last", "region"], "left_anti")
    return found


def review(pairs: DataFrame, acknowledged: DataFrame, least_share: float) -> DataFrame:
    """a, b, first, steps, cells, share, winners, duplicate, unacknowledged: what overlaps(step, a, b, shared, share, winner) come to over all steps.

    cells and share are the largest; a step is a duplicate where the share is `least_share` at least, and unacknowledged where
    acknowledged(a, b, first, last) does not hold its step besides.
    """
    said = acknowledged.select("a", "b", F.col("first").alias("_f"), F.col("last").alias("_l"))
    dup = pairs.where(F.col("share") >= least_share).select("step", "a", "b")
    known = dup.join(said, ["a", "b"]).where((F.col("_f") <= F.col("step")) & (F.col("step") <= F.col("_l"))).select("step", "a", "b").distinct().withColumn("known", F.lit(True))
    marked = pairs.withColumn("dup", F.col("share") >= least_share).join(known, ["step", "a", "b"], "left")
    return marked.groupBy("a", "b").agg(
        F.min("step").alias("first"), F.count(F.lit(1)).alias("steps"), F.max("shared").alias("cells"), F.max("share").alias("share"), F.array_sort(F.collect_set("winner")).alias("winners"),
        F.count_if("dup").alias("duplicate"), F.count_if(F.col("dup") & F.col("known").isNull()).alias("unacknowledged"),
    )


def overlap_pairs(cells: DataFrame) -> DataFrame:
    """step, a, b, shared, share (of the smaller), winner (the smaller, of equals a) of cells(step, name, j, i)."""
    sizes = cells.select("step", "name", "j", "i").distinct().groupBy("step", "name").agg(F.count(F.lit(1)).alias("size"))
    of = lambda x: sizes.select("step", F.col("name").alias(x), F.col("size").alias(f"n{x}"))
    both = overlaps(cells, ["step"]).join(of("a"), ["step", "a"]).join(of("b"), ["step", "b"])
    return both.select("step", "a", "b", "shared", (F.col("shared") / F.least("na", "nb")).alias("share"), F.when(F.col("nb") < F.col("na"), F.col("b")).otherwise(F.col("a")).alias("winner"))


def outer_units(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, outer, roots: the one root above each of nodes(name) by edges(child, parent, kind) of membership; roots > 1 is an error, of which the least is given."""
    above = closure(edges.where(F.col("kind").isin("member", "component", "vassal")).select("child", "parent"))
    tops = above.join(edges.select(F.col("child").alias("ancestor")), "ancestor", "left_anti")
    found = tops.groupBy(F.col("node").alias("name")).agg(F.min("ancestor").alias("outer"), F.count_distinct("ancestor").alias("roots"))
    return nodes.join(found, "name", "left").select("name", F.coalesce("outer", "name").alias("outer"), F.coalesce("roots", F.lit(1)).alias("roots"))


def memberships(rows: DataFrame, kinds: DataFrame, relations: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """step, child, parent: who stands under whom at each step, from rows(step, name, polity, components, member_of) valid then.

    In order of precedence: a composite's components; for a polity that no valid composite lists, the composites that it says it is a member
    of; the vassal of a relation under its paramount, where relations(name, counts) says that it counts, either party being the composite of its
    name where one is valid; and members(step, child, parent), told outright, where both are there. Steps upward that lead to a composite not classed as
    an 'empire' by kinds(name, kind) are left out. Rows that share a name at a step count together.
    """
    from meridia.functions.text import composite, relation

    named = stored(rows.where("polity").groupBy("step", "name").agg(F.flatten(F.collect_list("components")).alias("components"), F.flatten(F.collect_list("member_of")).alias("member_of")).withColumn("composite", composite("name")), "polities")
    listed = named.where("composite").select("step", F.explode("components").alias("child"), F.col("name").alias("parent"))
    said = named.select("step", F.col("name").alias("child"), F.explode("member_of").alias("parent")).join(listed.select("step", "child").distinct(), ["step", "child"], "left_anti")
    valid = named.select("step", F.col("name").alias("parent"), "composite")
    said = said.join(valid.where("composite").select("step", "parent"), ["step", "parent"], "left_semi").select("step", "child", "parent")
    told = join_bounded(rows.where("not polity").select("step", "name"), relations.where("counts").select("name"), ["name"], "inner").withColumn("r", relation("name")).where("r.kind = 'Vassalage'")

    def party(df: DataFrame, side: str) -> DataFrame:
        """The party's composite where one is valid, else the polity of its name; rows without either go."""
        there = named.select("step", F.col("name").alias("found"))
        both = df.join(there.withColumn(side, F.regexp_replace("found", r"^\((.*)\)$", "$1")), ["step", side])
        return both.groupBy("step", "name", *[c for c in ("vassal", "paramount") if c in df.columns and c != side]).agg(F.min_by("found", F.struct(~composite("found"), "found")).alias(side))

    parties = told.select("step", "name", F.col("r.of").alias("vassal"), F.col("r.to").alias("paramount"))
    under = party(party(parties, "vassal"), "paramount").select("step", F.col("vassal").alias("child"), F.col("paramount").alias("parent"))
    edges = listed.unionByName(said).unionByName(under)
    if members is not None:
        there = named.select("step", "name")
        edges = edges.unionByName(members.select("step", "child", "parent").join(there.withColumnRenamed("name", "child"), ["step", "child"], "left_semi").join(there.withColumnRenamed("name", "parent"), ["step", "parent"], "left_semi").select("step", "child", "parent"))
    edges = join_bounded(edges.where("child <> parent").distinct().join(valid, ["step", "parent"], "left"), kinds.select(F.col("name").alias("parent"), "kind"), ["parent"])
    return edges.where(~F.coalesce("composite", F.lit(False)) | F.coalesce(F.col("kind") == "empire", F.lit(False))).select("step", "child", "parent")


def membership_review(rows: DataFrame, kinds: DataFrame, relations: DataFrame) -> DataFrame:
    """step, what, name: composites and relations that no table classes ('composite', 'relation'), and polities whose memberships name no valid composite ('unsettled')."""
    from meridia.functions.text import composite, relation

    polities = rows.where("polity")
    known = polities.select("step", "name", composite("name").alias("composite"), "components", "member_of")
    listed = known.where("composite").select("step", F.col("name").alias("parent"), F.explode("components").alias("name")).where("name <> parent").select("step", "name").distinct()
    claims = known.where(F.size("member_of") > 0).join(listed, ["step", "name"], "left_anti").select("step", "name", F.explode("member_of").alias("of"))
    there = known.where("composite").select("step", F.col("name").alias("of"), F.lit(True).alias("there")).distinct()
    settled = claims.join(there, ["step", "of"], "left").groupBy("step", "name").agg(F.bool_or(F.coalesce("there", F.lit(False)) & (F.col("of") != F.col("name"))).alias("settled"))
    lone = join_bounded(known.where("composite").select("step", "name").distinct(), kinds.select("name"), ["name"], "left_anti").select("step", F.lit("composite").alias("what"), "name")
    loose = join_bounded(rows.where("not polity").where(relation("name")["kind"] == "Vassalage").select("step", "name").distinct(), relations.select("name"), ["name"], "left_anti").select("step", F.lit("relation").alias("what"), "name")
    return lone.unionByName(loose).unionByName(settled.where("not settled").select("step", F.lit("unsettled").alias("what"), "name"))


def outer_units_by_step(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """step, name, outer, roots of each of nodes(step, name): what outer_units() says at each step, by edges(step, child, parent). Of a circle without a way out each node is its own."""
    at = lambda c: F.struct("step", F.col(c).alias("name"))
    found = outer_units(edges.select(at("child").alias("child"), at("parent").alias("parent"), F.lit("member").alias("kind")), nodes.select(at("name").alias("name")))
    return found.select("name.step", "name.name", F.col("outer.name").alias("outer"), "roots")


def parts_of_units(cells: DataFrame, outer: DataFrame, minor_km2: float, rows: int, columns: int) -> DataFrame:
    """step, name, outer, minor, j, i: each name's cells(step, name, j, i), as they lie in a piece of its outer unit's land (outer(step, name, outer); else its own) that is smaller than `minor_km2` or not."""
    owned = cells.join(outer.select("step", "name", "outer"), ["step", "name"], "left").withColumn("outer", F.coalesce("outer", "name"))
    owned = stored(owned, "owned")
    pieces = stored(regions(owned.select("step", "outer", "j", "i").distinct(), ["step", "outer"], columns), "pieces")
    size = pieces.groupBy("step", "outer", "region").agg((F.sum(km2(F.col("j"), rows, columns)) < minor_km2).alias("minor"))
    return owned.join(pieces.join(size, ["step", "outer", "region"]).select("step", "outer", "j", "i", "minor"), ["step", "outer", "j", "i"]).select("step", "name", "outer", "minor", "j", "i")


def shape_at(rows: DataFrame, name: str, year: int) -> DataFrame:
    """j, i of what rows(name, first, last, j, i) give a name in a year."""
    return rows.where((F.col("name") == name) & (F.col("first") <= year) & (F.col("last") >= year)).select("j", "i").distinct()


def corrected(cells: DataFrame, corrections: list[dict], columns: int, rows: DataFrame | None = None) -> DataFrame:
    """cells(step, name, j, i) after each correction in order: a short, curated list of
    {kind: rename | drop | add | carry | give | pocket, name, to, y0, y1, within, inside, at, year} for steps y0 to y1.

    Each is a set operation over all steps at once. A place is `within`: (j0, i0, j1, i1), or `inside`: (name, year), the shape that
    rows(name, first, last, j, i) give that name in that year. carry draws a name, at steps that lack it, as it is in `year`. drop takes
    all of a name, or its pieces that lie in the place wholly. give hands over a name's cells in the place (all, where none is
    named), or, with `at`, the connected piece that holds a cell. A name or a year that rows lack is an error.
    """

    def place(c: dict) -> DataFrame | None:
        if "within" in c:
            j0, i0, j1, i1 = c["within"]
            return cells.sparkSession.range(1).select(F.explode(F.sequence(F.lit(j0), F.lit(j1))).alias("j"), F.lit(i0).alias("i0"), F.lit(i1).alias("i1")).select("j", F.explode(F.sequence("i0", "i1")).alias("i"))
        if "inside" in c or c["kind"] == "carry":
            name, year = c.get("inside", (c["name"], c.get("year")))
            shape = shape_at(rows, name, year)
            if shape.isEmpty():
                raise ValueError(f"{c['kind']}: the source has no {name} in {year}")
            return shape
        return None

    for c in corrections:
        here = F.col("step").between(c["y0"], c["y1"])
        own = here & (F.col("name") == c["name"])
        where = place(c)
        if c["kind"] == "rename":
            cells = cells.withColumn("name", F.when(own, c["to"]).otherwise(F.col("name")))
        elif c["kind"] == "drop" and where is None:
            cells = cells.where(~own)
        elif c["kind"] == "drop":
            pieces = stored(regions(cells.where(own), ["step", "name"], columns), "pieces")
            stay = pieces.join(where, ["j", "i"], "left_anti").select("step", "name", "region").distinct()
            gone = pieces.join(stay, ["step", "name", "region"], "left_anti").select("step", "name", "j", "i")
            cells = cells.join(gone, ["step", "name", "j", "i"], "left_anti")
        elif c["kind"] in ("add", "carry"):
            steps = cells.where(here).select("step").distinct()
            if c["kind"] == "carry":
                steps = steps.join(cells.where(own).select("step").distinct(), "step", "left_anti")
            more = steps.withColumn("name", F.lit(c["name"])).crossJoin(where)  # curated steps by one shape's cells
            cells = cells.unionByName(more.select("step", "name", *[F.col(k).cast(cells.schema[k].dataType) for k in ("j", "i")])).distinct()
        elif "at" in c:
            pieces = regions(cells.where(own), ["step", "name"], columns)
            chosen = pieces.where((F.col("j") == c["at"][0]) & (F.col("i") == c["at"][1])).select("step", "name", "region")
            moved = pieces.join(chosen, ["step", "name", "region"], "left_semi").select("step", "name", "j", "i", F.lit(c["to"]).alias("new"))
            if where is not None:
                moved = moved.join(where, ["j", "i"], "left_semi").select("step", "name", "j", "i", "new")
            cells = cells.join(moved, ["step", "name", "j", "i"], "left").select("step", F.coalesce("new", "name").alias("name"), "j", "i").distinct()
        else:
            named = cells if where is None else cells.join(where.withColumn("_in", F.lit(True)), ["j", "i"], "left")
            inside = own if where is None else own & F.col("_in").isNotNull()
            cells = named.select("step", F.when(inside, c["to"]).otherwise(F.col("name")).alias("name"), "j", "i").distinct()
    return cells


def classify(pieces: DataFrame, pocket_km2: float, corrections: DataFrame | None = None) -> DataFrame:
    """unclaimed() pieces with `rule`: what becomes of each by the first rule that holds.

    On a coast a piece is 'kept' as far as it is wide, a 'sliver' where it is nowhere; inside one state it goes to that 'state'; by a 'lake',
    if less than `pocket_km2`, to the lake; what is nowhere wide is 'narrow'; else it is 'kept'. corrections(step, region,
    stateless) come before: kept, or given away by 'correction'; one past `pocket_km2` is an error.
    """
    rule = F.when(F.col("coast"), F.when(F.col("wide"), "kept").otherwise("sliver")).when(F.col("states") == 1, "state").when(F.col("lake") & (F.col("km2") < pocket_km2), "lake").when(~F.col("wide"), "narrow").otherwise("kept")
    if corrections is None:
        return pieces.withColumn("rule", rule)
    told = pieces.join(corrections.select("step", "region", "stateless"), ["step", "region"], "left")
    if not told.where(~F.col("stateless") & (F.col("km2") >= pocket_km2) & (rule == "kept")).isEmpty():
        raise ValueError("a correction gives away a piece past the size of a pocket")
    said = F.when(F.col("stateless"), "kept").when(F.col("stateless").isNotNull() & ((rule == "kept") | F.col("coast")), "correction").otherwise(rule)
    return told.withColumn("rule", said).drop("stateless")


def linked(holes: DataFrame, reach: float) -> DataFrame:
    """hole, up of holes(hole, step, ord, lon, lat): the first hole, by `ord`, of the step before that lies within `reach` degrees both ways. Holes without one are left out."""
    bucket = lambda x: F.floor(F.col(x) / reach)
    a = holes.select(F.col("hole").alias("up"), F.col("ord").alias("up_ord"), (F.col("step") + 1).alias("step"), F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    around = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    a = a.withColumn("c", F.explode(around)).select("*", (bucket("lon0") + F.col("c.x")).alias("bx"), (bucket("lat0") + F.col("c.y")).alias("by")).drop("c")
    b = holes.select("hole", "step", "lon", "lat", bucket("lon").alias("bx"), bucket("lat").alias("by"))
    near = a.join(shuffled(b), ["step", "bx", "by"]).where((F.abs(F.col("lon") - F.col("lon0")) <= reach) & (F.abs(F.col("lat") - F.col("lat0")) <= reach))
    return near.groupBy("hole").agg(F.min_by("up", F.struct("up_ord", "up")).alias("up"))


def tracked(holes: DataFrame, reach: float) -> DataFrame:
    """hole, track of holes(hole, step, ord, lon, lat): a hole goes on the track of the first hole of the step before within reach; others begin one, which bears their number.

    `step` counts the steps. A hole has one hole before it at most, so tracks are trees whose roots are found by doubling:
    as many rounds as the logarithm of the number of steps. Nulls in lon or lat are near nothing; an empty table gives no rows.
    """
    at = stored(holes.select("hole").join(shuffled(linked(holes, reach)), "hole", "left").select("hole", F.coalesce("up", "hole").alias("track")), "tracks")
    while True:
        far = at.select(F.col("hole").alias("track"), F.col("track").alias("next"))
        after = stored(at.join(shuffled(far), "track").select("hole", F.col("next").alias("track"), (F.col("next") != F.col("track")).alias("moved")), "tracks")
        if after.where("moved").isEmpty():
            return after.select("hole", "track")
        at = after.select("hole", "track")


def owed_holes(holes: DataFrame, ends: DataFrame, reach: float, known: DataFrame | None = None) -> DataFrame:
    """One row per track of holes(hole, step, ord, lon, lat, clon, clat, km2, states, lake): id, first, last, lon, lat, km2, states, lake, holes, acknowledged.

    ends(step, year, until) gives each step its first year and its last. A track's place is that of its largest hole (of equals
    the first met), its states those of all holes, sorted. The id names the years and the largest hole's centroid to the
    whole degree; tracks that would share one are told apart by numbers in the order in which they begin. known(id) are acknowledged.
    """
    rows = tracked(holes, reach).join(shuffled(holes), "hole").join(bounded(ends), "step")
    best = F.max_by(F.struct("lon", "lat", "clon", "clat", "km2"), F.struct("km2", -F.col("step"), -F.col("ord"))).alias("best")
    told = rows.select("*", F.explode_outer("states").alias("state"))
    states = told.groupBy("track").agg(F.array_sort(F.collect_set("state")).alias("states"))  # of one place
    begun = F.min(F.struct("step", "ord", "hole")).alias("begun")
    places = rows.groupBy("track").agg(best, F.min("year").alias("first"), F.max("until").alias("last"), F.bool_or("lake").alias("lake"), F.count(F.lit(1)).alias("holes"), begun).join(shuffled(states), "track")
    degree = lambda x: F.floor(F.col(f"best.{x}") + 0.5)
    side = lambda x, plus, minus: F.concat(F.abs(degree(x)).cast("string"), F.when(degree(x) < 0, minus).otherwise(plus))
    base = F.concat(F.lit("hole "), F.col("first").cast("string"), F.lit(".."), F.col("last").cast("string"), F.lit(" "), side("clon", "E", "W"), F.lit(" "), side("clat", "N", "S"))
    places = places.withColumn("base", base)
    same = Window.partitionBy("base")  # tracks of the same years within one degree
    number = F.row_number().over(same.orderBy("begun"))
    named = places.withColumn("id", F.when(F.count(F.lit(1)).over(same) > 1, F.concat("base", F.lit(" #"), number.cast("string"))).otherwise(F.col("base")))
    out = named.select("track", "id", "first", "last", "best.lon", "best.lat", "best.km2", "states", "lake", "holes")
    if known is None:
        return out.withColumn("acknowledged", F.lit(False))
    return join_bounded(out, known.select("id").distinct().withColumn("acknowledged", F.lit(True)), ["id"]).withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False))).select(*out.columns, "acknowledged")
