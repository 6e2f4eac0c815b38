"""Joins that Spark has no operator for, as equi-joins on buckets."""

from __future__ import annotations

from math import cos, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.shared import bounded, shuffled, stored


#: Buckets that a short span touches at most, and by which those of long spans are wider.
LONG = 64


def interval_join(left: DataFrame, right: DataFrame, l0: str, l1: str, r0: str, r1: str, width: int) -> DataFrame:
    """Pairs whose inclusive integer spans overlap, by an equi-join on buckets of `width`.

    A span is put once in each bucket it touches; one longer than LONG buckets in buckets LONG times as wide, in which long
    spans meet all others but short ones never meet each other. A pair is put out in the first bucket
    that both touch, so none comes twice. Spans with a null end, or of negative length, have no partner.
    """

    def buckets(a: str, b: str, kind: int, wide: int) -> Column:
        return F.transform(F.sequence(F.floor(F.col(a) / wide), F.floor(F.col(b) / wide)), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("k")))

    def spread(df: DataFrame, a: str, b: str, name: str, alone: list[int], both: list[int]) -> DataFrame:
        # Kinds: 0 short with short, 1 a long left one with any, 2 a short left one with a long right one.
        coarse = [buckets(a, b, kind, width * LONG) for kind in both]
        long = coarse[0] if len(coarse) == 1 else F.concat(*coarse)
        short = F.concat(buckets(a, b, 0, width), *[buckets(a, b, kind, width * LONG) for kind in alone])
        return df.where(F.col(a) <= F.col(b)).withColumn(name, F.explode(F.when(F.col(b) - F.col(a) > width * LONG, long).otherwise(short)))

    kind, k = F.col("_lb.kind"), F.col("_lb.k")
    own = k == F.floor(F.greatest(l0, r0) / F.when(kind == 0, width).otherwise(width * LONG))
    pairs = spread(left, l0, l1, "_lb", [2], [1]).join(spread(right, r0, r1, "_rb", [1], [1, 2]), (F.col("_lb") == F.col("_rb")) & (F.col(l0) <= F.col(r1)) & (F.col(r0) <= F.col(l1)) & own)
    return pairs.drop("_lb", "_rb")


def interval_pairs(left: DataFrame, right: DataFrame, l0: str, l1: str, r0: str, r1: str, width: int, lkey: str, rkey: str, lot: int = 512) -> DataFrame:
    """lkey, rkey of the pairs of interval_join(), where many rows share a span.

    Rows of one span are put into lots of some `lot` keys, dealt by the keys' hash, which should seldom be equal. Lots are joined, and a pair of lots
    is spread where it is put out, with the right lot's keys in one order for each left key: repetitions that files store in little room.
    """

    def lots(df: DataFrame, a: str, b: str, key: str, name: str) -> DataFrame:
        rows = df.select(a, b, key).join(shuffled(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"))), [a, b])
        return rows.groupBy(a, b, F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / lot)).alias("_lot")).agg(F.collect_list(F.struct(key)).alias(name)).drop("_lot")  # structs, as lists leave nulls out

    pairs = interval_join(lots(left, l0, l1, lkey, "_ls"), bounded(lots(right, r0, r1, rkey, "_rs"), right), l0, l1, r0, r1, width)
    return pairs.select(F.explode("_ls").alias("_l"), "_rs").select("_l", F.explode("_rs").alias("_r")).select(f"_l.{lkey}", f"_r.{rkey}")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """left with, of right's rows of the same `by`, the values of the last at or before `at` (null: none).

    Both sides are put together and the last right row is carried on in windows by key,
    so no pairs are formed. Of right rows at one time the last by its values counts.
    """
    tagged = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType))
    rights = right.select(*by, at, F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    both = tagged.unionByName(rights, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    return last.select(*[c for c in left.columns], *[F.col(f"_last.{v}").alias(v) for v in values])


def last_before(steps: Column, x: Column) -> Column:
    """The largest of a sorted array that is not above x: the as-of join with a small array of steps."""
    return F.element_at(F.filter(steps, lambda s: s <= x), -1)


def cells_of(lon: Column, lat: Column, size: float) -> tuple[Column, Column]:
    return F.floor((lon + 180) / size).cast("int"), F.floor((lat + 90) / size).cast("int")


def near_join(left: DataFrame, right: DataFrame, km: float, size: float = 10.0) -> DataFrame:
    """Pairs of left(a, lon, lat) and right(b, lon, lat) within a distance: a, b, km. Equi-join on cells of `size` degrees.

    A left point is put in the cells that its distance reaches; near a pole, and with any
    span of 180 degrees or more, in a whole row of cells. A pair in a cell costs a dot product of unit vectors, which
    settles all but those within a hair of the distance; kilometres are worked out for the pairs put out alone, from
    sines and cosines worked out once per point.
    """
    from meridia.functions.geo import EARTH_KM, km_between, unit

    reach = km / EARTH_KM * 180 / 3.141592653589793
    columns = round(360 / size)
    j0, j1 = F.floor((F.greatest(F.col("lat") - reach, F.lit(-90.0)) + 90) / size), F.floor((F.least(F.col("lat") + reach, F.lit(90.0)) + 90) / size)
    edge = F.abs(F.col("lat")) + reach
    wide = F.when(edge >= 89, F.lit(180.0)).otherwise(F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(reach))) / F.cos(F.radians(F.col("lat"))))))))
    first, count = F.floor((F.col("lon") - wide + 180) / size), F.least(F.lit(columns), F.floor((F.col("lon") + wide + 180) / size) - F.floor((F.col("lon") - wide + 180) / size) + 1)
    fixed = lambda df, n: df.withColumn("_u", unit("lon", "lat")).select("*", *[F.col(f"_u.{k}").alias(f"_{k}{n}") for k in "xyz"], F.radians("lat").alias(f"_r{n}"), F.cos(F.radians("lat")).alias(f"_c{n}")).drop("_u")
    spread = fixed(left, 1).withColumn("_j", F.explode(F.sequence(j0, j1))).withColumn("_i", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), lambda n: F.pmod(first + n, F.lit(columns)))))
    other = fixed(right, 2).select("b", F.col("lon").alias("lon2"), *[f"_{k}2" for k in "xyzrc"], F.floor((F.col("lat") + 90) / size).alias("_j"), F.pmod(F.floor((F.col("lon") + 180) / size), F.lit(columns)).alias("_i"))
    between = km_between("_r1", "_c1", "lon", "_r2", "_c2", "lon2")
    dot = F.col("_x1") * F.col("_x2") + F.col("_y1") * F.col("_y2") + F.col("_z1") * F.col("_z2")
    least, hair = cos(min(km / EARTH_KM, pi)), 1e-9  # dot products are right to some 1e-15
    pairs = bounded(spread.drop("lat")).join(other, ["_j", "_i"]).where((dot >= least - hair) & ((dot >= least + hair) | (between <= km)))
    return pairs.select("a", "b", between.alias("km"))


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """node, ancestor, depth (least number of steps, from 1) over edges(child, parent), by doubling paths.

    Circles are safe: a pair is kept once with its least depth, and a node may come out as
    its own ancestor. Rounds are the logarithm of the longest chain.
    """
    reach = stored(edges.where("child is not null and parent is not null").groupBy(F.col("child").alias("node"), F.col("parent").alias("ancestor")).agg(F.lit(1).cast("long").alias("depth")), "closure")
    before = (-1, -1)
    for _ in range(most):
        now = tuple(reach.agg(F.count(F.lit(1)), F.sum("depth")).first())
        if now == before:
            break
        before = now
        up = reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("depth").alias("more"))
        longer = reach.join(shuffled(up), "ancestor").select("node", F.col("above").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        reach = stored(reach.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "closure")
    return reach


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`, its row number from 0 in a total order, without a task that orders all rows.

    Rows are range-partitioned and numbered in their partition; partitions' first numbers
    follow from their counts, one row per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    counts = sorted_.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return sorted_.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_n")).drop("_p", "_n", "_s")
