"""The event index: statements to scored, classed, located rows with parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from meridia.functions import cal
from meridia.operators.joins import closure, global_rank
from meridia.shared import join_bounded, stored

PROPERTIES = ("point", "start", "end")


def usable(statements: DataFrame, classes: DataFrame) -> DataFrame:
    """Statements of listed classes that are dated to the year or finer, with the days they name and their class's weight.

    A day is Gregorian, as sources convert it; a year or a month is as written then, Julian before the reform.
    """
    listed = classes.select("cls", "weight")
    dated = join_bounded(statements.where(F.col("prec") >= cal.YEAR), listed, ["cls"], "inner")
    return cal.with_period(dated, "y", "m", "d", "prec", "s0", "s1", cal.gregorian_day)


def index(statements: DataFrame, classes: DataFrame, curated: DataFrame) -> DataFrame:
    """One row per event: qid, label, enwiki, cls, lon, lat, date, prec, t0, t1, editions, score, conflict, parents.

    First non-empty label, title and place in source order; the heaviest class; the date
    of the first property, most precise, earliest; curated(qid, boost, day, until, lon, lat) over them. The span
    begins with the date or the earliest start statement and ends with the date's last day or the latest end
    statement. A curated day corrects all statements equal to the one that dates the event, a curated end
    (`until`) all end statements: these leave the span. Events without label, without editions or without place are left out.
    """
    rows = usable(statements, classes)
    line = F.col("line_no")
    first = lambda x, good: F.min_by(F.col(x), F.when(good, line)).alias(x)
    rank = F.coalesce(*[F.when(F.col("prop") == p, i) for i, p in enumerate(PROPERTIES)], F.lit(len(PROPERTIES)))
    order = F.struct(rank, -F.col("prec"), "y", "m", "d", "line_no")
    said = F.struct("prop", "y", "m", "d", "prec")
    # Curated days are few: what each corrects is found in its event's statements alone, then told to all.
    dayed = curated.where("day is not null").select("qid")
    wrong = join_bounded(rows, dayed, ["qid"], "left_semi").groupBy("qid").agg(F.min_by(said, order).alias("wrong"))
    marks = stored(curated.where("day is not null or until is not null").select("qid", F.col("until").isNotNull().alias("ended")).join(wrong, "qid", "left"), "corrections")
    spans = ~F.coalesce(said == F.col("wrong"), F.lit(False)) & ~(F.coalesce("ended", F.lit(False)) & (F.col("prop") == "end"))
    rows = join_bounded(rows, marks, ["qid"])
    clash = [(F.min(F.when(F.col("prop") == p, F.struct("y", "m", "d", "prec"))) != F.max(F.when(F.col("prop") == p, F.struct("y", "m", "d", "prec")))) for p in PROPERTIES]
    conflict = F.coalesce(clash[0], F.lit(False))
    for c in clash[1:]:
        conflict = conflict | F.coalesce(c, F.lit(False))
    grouped = rows.groupBy("qid").agg(
        first("label", F.col("label") != ""),
        first("enwiki", F.col("enwiki").isNotNull()),
        F.min_by(F.struct("lon", "lat"), F.when(F.col("lon").isNotNull(), line)).alias("place"),
        F.max_by("cls", F.struct("weight", -line)).alias("cls"),
        F.max("weight").alias("weight"),
        F.min_by(F.struct("s0", "s1", "prec", "prop"), order).alias("date"),
        F.min(F.when(spans & (F.col("prop") == "start"), F.col("s0"))).alias("b0"),
        F.max(F.when(spans & (F.col("prop") == "end"), F.col("s1"))).alias("b1"),
        F.max("editions").alias("editions"),
        conflict.alias("conflict"),
        F.array_sort(F.collect_set("parent")).alias("parents"),
    )
    over = curated.select("qid", "boost", "day", "until", F.when(F.col("lon").isNotNull(), F.struct("lon", "lat")).alias("given"))
    joined = join_bounded(grouped, over, ["qid"])
    place = F.coalesce("given", "place")
    own = F.coalesce(F.col("day"), F.col("date.s0"))
    stays = F.col("day").isNull() & ~(F.col("until").isNotNull() & (F.col("date.prop") == "end"))
    joined = joined.withColumn("at", place).where((F.col("label") != "") & (F.col("editions") > 0) & F.col("at").isNotNull())
    return joined.select(
        "qid", "label", "enwiki", "cls", F.col("at.lon").alias("lon"), F.col("at.lat").alias("lat"), own.alias("date"), F.when(F.col("day").isNotNull(), cal.DAY).otherwise(F.col("date.prec")).alias("prec"),
        F.least(own, F.col("b0")).alias("t0"), F.greatest(own, F.col("until"), F.when(stays, F.col("date.s1")), F.col("b1")).alias("t1"), "editions",
        F.round(F.log2(1 + F.col("editions")) * F.col("weight") + F.coalesce("boost", F.lit(0.0)), 6).alias("score"), "conflict", "parents",
    )


def forced(index: DataFrame, listed: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of index(qid, ...) that listed(qid) names, and the ids that it lacks; strict: lacking ids are an error."""
    ids = listed.select("qid").distinct()
    missing = ids.join(index, "qid", "left_anti")
    if strict and not missing.isEmpty():
        raise ValueError("the index lacks " + ", ".join(str(r["qid"]) for r in missing.orderBy("qid").limit(20).collect()))
    return join_bounded(index, ids, ["qid"], "left_semi"), missing


def containment(members: DataFrame) -> DataFrame:
    """inner, outer of members(event, cls): every event of `inner` is one of `outer` too. Joined by event, whose classes are few."""
    members = members.select("event", "cls").distinct()
    own = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    pairs = members.select("event", F.col("cls").alias("inner")).join(members.select("event", F.col("cls").alias("outer")), "event").where("inner <> outer")
    both = pairs.groupBy("inner", "outer").agg(F.count(F.lit(1)).alias("both"))
    return both.join(own.withColumnRenamed("cls", "inner"), "inner").where("both = n").select("inner", "outer")


def displayed_class(members: DataFrame, classes: DataFrame) -> DataFrame:
    """event, display: of an event's classes within its heaviest, one that has no deeper one among them; of equals the heavier, then the first listed."""
    weighed = members.select("event", "cls").distinct().transform(join_bounded, classes.select("cls", "weight", "ord"), ["cls"], "inner")
    heaviest = weighed.groupBy("event").agg(F.max_by("cls", F.struct("weight", -F.col("ord"))).alias("top"))
    inside = containment(members)
    own = weighed.join(heaviest, "event")
    near = own.join(inside.select(F.col("inner").alias("cls"), F.col("outer").alias("top"), F.lit(True).alias("within")), ["cls", "top"], "left").where("within or cls = top")
    deeper = near.select("event", F.col("cls").alias("inner")).join(inside, "inner").select("event", F.col("outer").alias("cls"), F.col("inner"))
    # Two classes of the same events contain each other: neither is deeper.
    back = inside.select(F.col("inner").alias("cls"), F.col("outer").alias("inner"))
    deeper = deeper.join(back, ["cls", "inner"], "left_anti").select("event", "cls").distinct()
    return near.join(deeper, ["event", "cls"], "left_anti").groupBy("event").agg(F.min_by("cls", F.struct(-F.col("weight"), "ord")).alias("display"))


def era(day: Column, edges: Sequence[int]) -> Column:
    """Number of the half-open bin that holds a day: how many edges are not above it, less one."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= day)) - 1


def percentile_score(rows: DataFrame) -> DataFrame:
    """rows(era, editions, boost, weight) with upper (cumulative rank in the era) and points (0 to 1000)."""
    counts = stored(rows.groupBy("era", "editions").agg(F.count(F.lit(1)).alias("_n")), "edition-counts")  # one row per number of editions
    w = Window.partitionBy("era")
    up_to = F.sum("_n").over(w.orderBy("editions").rowsBetween(Window.unboundedPreceding, 0))
    upper = counts.select("era", "editions", (up_to / F.sum("_n").over(w)).alias("upper"))
    most = rows.agg(F.max("weight").alias("most"))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("upper") + F.col("boost")))
    scored = join_bounded(rows, upper, ["era", "editions"], "inner").crossJoin(F.broadcast(most))  # one row
    return scored.withColumn("points", F.rint(1000 * part * F.col("weight") / F.col("most")).cast("int")).drop("most")


def row_ids(rows: DataFrame) -> DataFrame:
    """rows(points, qid) with row, the number in the order of falling points, then qid."""
    return global_rank(rows, [F.col("points").desc(), F.col("qid")], "row")


def region_of(boxes: Sequence[Row], lon: Column, lat: Column) -> Column:
    """Name of the first box that holds a point, null in a gap. Boxes are the configuration's."""
    inside = [F.when(lon.between(b["west"], b["east"]) & lat.between(b["south"], b["north"]), b["name"]) for b in boxes]
    return F.coalesce(*inside)


def overview(rows: DataFrame, quota: int, total: int) -> DataFrame:
    """rows(era, region, row): the first `quota` of each era and region, then others by row up to `total`, with `filled`."""
    n = F.row_number().over(Window.partitionBy("era", "region").orderBy("row"))
    chosen = stored(rows.withColumn("_n", n).where(F.col("_n") <= quota).drop("_n"), "quota")  # Spark cuts each group before it is dealt out
    left = max(0, total - chosen.count())
    rest = join_bounded(rows, chosen.select("row"), ["row"], "left_anti").orderBy("row").limit(left).withColumn("filled", F.lit(True))
    return chosen.withColumn("filled", F.lit(False)).unionByName(rest)


def pages(rows: DataFrame, edges: Sequence[int], apart: int = 3) -> DataFrame:
    """rows(t0, t1) once per page: each era bin of the span, or 'long' where it reaches over `apart` bins or more."""
    low, high = era(F.col("t0"), edges), era(F.col("t1"), edges)
    names = F.transform(F.sequence(low, high), lambda n: F.format_string("p%02d", n))
    return rows.withColumn("page", F.explode(F.when(high - low >= apart, F.array(F.lit("long"))).otherwise(names)))


def spherical_centroid(lon: str, lat: str) -> tuple[Column, Column]:
    """Aggregates lon and lat of the mean direction of points; of opposite points the smallest."""
    x = F.sum(F.cos(F.radians(lat)) * F.cos(F.radians(lon)))
    y = F.sum(F.cos(F.radians(lat)) * F.sin(F.radians(lon)))
    z = F.sum(F.sin(F.radians(lat)))
    none = F.sqrt(x * x + y * y + z * z) < 1e-9
    least = F.min(F.struct(lon, lat))
    return F.when(none, least[lon]).otherwise(F.degrees(F.atan2(y, x))), F.when(none, least[lat]).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))))


def smallest_extent(points: DataFrame, by: list[str], widths: Sequence[float] = (1.0, 1 / 1024)) -> DataFrame:
    """by, west, south, east, north of points(by, lon, lat): the shortest arc of longitudes (west > east across 180 degrees) and the range of latitudes.

    The arc is what the widest gap between longitudes leaves over; of equal gaps that which begins first. A group's longitudes are first
    merged to the least and greatest of each bucket of `widths[0]` degrees, before the shuffle. A gap between buckets that is as wide as a bucket
    is wider than any gap within one, so most groups are done with at most 360 rows each. Groups without
    such a gap lie all around the globe: they go on with the next width, and at last with all gaps of each of its
    buckets. No task orders the longitudes of a whole group. Nulls are left out.
    """
    points = points.where("lon is not null and lat is not null")
    lat = points.groupBy(*by).agg(F.min("lat").alias("south"), F.max("lat").alias("north"))
    gap = F.when(F.col("next") > F.col("lon"), F.col("next") - F.col("lon")).otherwise(F.col("next") - F.col("lon") + 360)
    best = F.max(F.struct(gap.alias("gap"), (-F.col("lon")).alias("order"), F.col("next").alias("west"), F.col("lon").alias("east"))).alias("a")
    rest, found = points.select(*by, "lon"), []
    for width in widths:
        buckets = stored(rest.groupBy(*by, F.floor((F.col("lon") + 180) / width).alias("bucket")).agg(F.min("lon").alias("low"), F.max("lon").alias("lon")), "buckets")
        w = Window.partitionBy(*by).orderBy("bucket")  # as many rows as there are buckets
        first = F.first("low").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        between = stored(buckets.withColumn("next", F.coalesce(F.lead("low").over(w), first)).groupBy(*by).agg(best), "gaps")
        found.append(between.where(F.col("a.gap") >= width))
        left = between.where(F.col("a.gap") < width)
        if left.isEmpty():
            break
        rest = rest.join(left.select(*by), by, "left_semi")
    else:
        bucket = F.floor((F.col("lon") + 180) / widths[-1])
        within = Window.partitionBy(*by, "bucket").orderBy("lon")
        gaps = rest.distinct().withColumn("bucket", bucket).withColumn("next", F.lead("lon").over(within)).where("next is not null")
        found.append(gaps.groupBy(*by).agg(best).unionByName(left).groupBy(*by).agg(F.max("a").alias("a")))
    arc = found[0]
    for more in found[1:]:
        arc = arc.unionByName(more)
    return arc.join(lat, by).select(*by, "a.west", "south", "a.east", "north")


def with_ancestors(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows(qid, parent, ...) of the accepted ids and of all their ancestors."""
    above = closure(rows.where("parent is not null").select(F.col("qid").alias("child"), "parent"))
    ids = accepted.select("qid").union(above.join(accepted, F.col("node") == F.col("qid"), "left_semi").select("ancestor")).distinct()
    return rows.join(ids, "qid", "left_semi")


def kin(edges: DataFrame, focal: DataFrame) -> DataFrame:
    """id of a set's items, their ancestors and their descendants."""
    own = focal.select("id").distinct()
    edges = edges.select("child", "parent").where("child is not null and parent is not null")
    return own.union(walk(edges, own, "child", "parent")).union(walk(edges, own, "parent", "child")).distinct()


def walk(edges: DataFrame, start: DataFrame, of: str, to: str) -> DataFrame:
    """id of all that start(id) reaches over edges from `of` to `to`, in rounds of the ids reached last; circles are safe."""
    seen, front = None, start
    while True:
        new = join_bounded(edges, front.withColumnRenamed("id", of), [of], "left_semi").select(F.col(to).alias("id")).distinct()
        front = stored(new if seen is None else new.join(seen, "id", "left_anti"), "front")
        if front.isEmpty():
            return start.limit(0) if seen is None else seen
        seen = front if seen is None else seen.union(front)


def place_parents(rows: DataFrame) -> DataFrame:
    """qid, lon, lat of unlocated rows(qid, parent, located, lon, lat) that stand above located ones, through unlocated ones only: the centroid."""
    lone = rows.where("not located").select("qid")
    up = rows.where("parent is not null").select(F.col("qid").alias("child"), "parent").join(lone.select(F.col("qid").alias("parent")), "parent", "left_semi")
    chains = closure(up.join(lone.select(F.col("qid").alias("child")), "child", "left_semi").select("child", "parent"))
    own = up.join(rows.where("located").select(F.col("qid").alias("child"), "lon", "lat"), "child").select("parent", "lon", "lat", "child")
    reach = own.select(F.col("parent").alias("qid"), "lon", "lat", "child").union(own.join(chains, F.col("node") == F.col("parent")).select("ancestor", "lon", "lat", "child")).distinct()
    lon, lat = spherical_centroid("lon", "lat")
    return reach.groupBy("qid").agg(lon.alias("lon"), lat.alias("lat"))


def roll_up(rows: DataFrame, km) -> DataFrame:
    """qid, west, south, east, north, radius (whole km, at most 65535) over the located descendants of rows(qid, parent, located, lon, lat)."""
    below = closure(rows.where("parent is not null").select(F.col("qid").alias("child"), "parent"))
    points = rows.where("located").select(F.col("qid").alias("node"), "lon", "lat")
    under = below.join(points, "node").select(F.col("ancestor").alias("qid"), "lon", "lat")
    centre = rows.where("located").select("qid", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    radius = under.join(centre, "qid").groupBy("qid").agg(F.least(F.lit(65535), F.ceil(F.max(km("lon0", "lat0", "lon", "lat")))).cast("int").alias("radius"))
    return smallest_extent(under, ["qid"]).join(radius, "qid", "left")


def display_parents(candidates: DataFrame) -> DataFrame:
    """child, parent: each child's best candidate that closes no circle, candidates(child, parent, rank) tried by rank, children in id order.

    All start at their first candidate; in every circle of the choices the largest child
    goes on to its next; until there is none. Choices are a function, so circles are apart
    from each other and found by doubling.
    """
    w = Window.partitionBy("child").orderBy("rank", "parent")
    ranked = stored(candidates.where("child <> parent").withColumn("n", F.row_number().over(w)).select("child", "parent", "n"), "candidates")
    at = stored(ranked.select("child").distinct().withColumn("n", F.lit(1)), "choice")
    while True:
        chosen = stored(at.join(ranked, ["child", "n"]).select("child", "parent"), "chosen")
        most = circle_heads(chosen)
        if most.isEmpty():
            return chosen
        at = stored(at.join(most.select("child", F.lit(1).alias("step")), "child", "left").select("child", (F.col("n") + F.coalesce("step", F.lit(0))).alias("n")), "choice")


def circle_heads(choice: DataFrame) -> DataFrame:
    """child: the largest of each circle of choice(child, parent), one parent to a child.

    Pointers are doubled until they reach over all children; what they then point to are
    the children in circles, and the largest seen on the way is their circle's.
    """
    inner = choice.join(choice.select(F.col("child").alias("parent")), "parent", "left_semi")
    n = inner.count()
    jump = inner.select("child", F.col("parent").alias("to"), F.col("parent").alias("most"))
    for _ in range(n.bit_length()):
        jump = stored(jump, "jumps")
        far = jump.select(F.col("child").alias("to"), F.col("to").alias("to2"), F.col("most").alias("most2"))
        jump = jump.join(far, "to").select("child", F.col("to2").alias("to"), F.greatest("most", "most2").alias("most"))
    ends = jump.select(F.col("to").alias("child")).distinct()
    return jump.join(ends, "child", "left_semi").select(F.col("most").alias("child")).distinct()
