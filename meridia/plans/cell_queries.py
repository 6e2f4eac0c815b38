"""Cell sets of suppliers taken as polities, one map for each year in which the set of valid ones changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import cells, steps
from meridia.operators.joins import interval_join
from meridia.plans import bind
from meridia.registry import SQL, query
from meridia.shared import stored

W, H = 80, 50
_P = bind.POLITY
_BOXES = f"pc AS (SELECT row_id, name, first, last, h * w AS area, j, i % {W} AS i FROM (SELECT *, unnest(range(j0, j0 + h)) AS j FROM p) q, LATERAL (SELECT unnest(range(i0, i0 + w)) AS i) r)"
CELLS = f"{bind.ctes(p=_P)}, {_BOXES}"
#: The change years, as steps.
YEARS = f"""{bind.ctes(p=_P)}, y AS (SELECT DISTINCT unnest([first, last + 1]) AS year FROM p), g AS (SELECT y.year, coalesce(string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY CAST(row_id AS VARCHAR)), '') AS s FROM y LEFT JOIN p ON first <= year AND year <= last GROUP BY y.year),
c AS (SELECT year, s, lag(s) OVER (ORDER BY year) AS b FROM g), st AS (SELECT row_number() OVER (ORDER BY year) - 1 AS step, year, s FROM c WHERE b IS NULL OR b <> s)"""

_MAPS = f"""{YEARS}, {_BOXES}, n AS (SELECT DISTINCT CAST(step AS INT) AS step, name, CAST(j AS INT) AS j, CAST(i AS INT) AS i FROM pc, st WHERE first <= year AND year <= last), ms AS (SELECT CAST(step AS INT) AS step FROM st)"""
LAKES = f"lk AS (SELECT DISTINCT CAST(n_nationkey * 7 % 45 + y AS INT) AS j, CAST((n_nationkey * 13 % {W} + x) % {W} AS INT) AS i FROM nation, (SELECT unnest(range(5)) AS y), (SELECT unnest(range(6)) AS x))"


def all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.frame(spark, sf_dir, _P).withColumn("area", F.col("h") * F.col("w"))
    return cells.boxes(rows, W)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, year of all change years of the polity table."""
    return stored(steps.change_years(bind.frame(spark, sf_dir, _P)).select(F.col("step").cast("int").alias("step"), F.col("year").cast("int").alias("year")), "changes")


def drawn(spark: SparkSession, sf_dir: str, years: DataFrame | None = None) -> DataFrame:
    """step, name, j, i of all rows valid at each change year, overlaps and all."""
    years = (changes(spark, sf_dir) if years is None else years).withColumn("until", F.col("year"))
    return interval_join(all_cells(spark, sf_dir), years, "first", "last", "year", "until", 10).select("step", "name", "j", "i").distinct()


def lake_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """j, i of lakes: one of five rows and six columns for each nation."""
    n = bind.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    cell = n.select((F.col("n") * 7 % 45).alias("j0"), (F.col("n") * 13 % W).alias("i0")).select(F.explode(F.sequence("j0", F.col("j0") + 4)).alias("j"), "i0")
    return cell.select(F.col("j").cast("int").alias("j"), F.explode(F.sequence("i0", F.col("i0") + 5)).alias("i")).select("j", F.pmod("i", F.lit(W)).cast("int").alias("i")).distinct()


@query("JN15 IO4", f"""{bind.ctes(p=_P)}, t AS (SELECT row_id AS shape, i0 + 0.2 AS x0, j0 + 0.1 AS y0, w + 0.3 AS w, h + 0.4 AS h FROM p)
SELECT shape, j, count(*) AS n, min(i) AS first_i FROM t, (SELECT unnest(range(0, 60)) AS j), (SELECT unnest(range(0, 100)) AS i) WHERE j + 0.5 >= y0 AND j + 0.5 < y0 + h AND i + 0.5 >= x0 AND i + 0.5 < x0 + w * (1 - (j + 0.5 - y0) / h) GROUP BY shape, j""")
def cell_rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles to cells by edge crossings, per row."""
    t = bind.frame(spark, sf_dir, _P).select(F.col("row_id").alias("shape"), (F.col("i0") + 0.2).alias("x"), (F.col("j0") + 0.1).alias("y"), (F.col("w") + 0.3).alias("w"), (F.col("h") + 0.4).alias("h"))
    edge = lambda a, b, c, d: F.struct((F.col("x") + a).alias("x0"), (F.col("y") + b).alias("y0"), (F.col("x") + c).alias("x1"), (F.col("y") + d).alias("y1"))
    zero = F.lit(0.0)
    edges = t.select("shape", F.explode(F.array(edge(zero, zero, F.col("w"), zero), edge(F.col("w"), zero, zero, F.col("h")), edge(zero, F.col("h"), zero, zero))).alias("e")).select("shape", "e.*")
    return cells.rasterise(edges).groupBy("shape", "j").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first_i"))


@query("GE1", f"{CELLS} SELECT j, i, arg_min(row_id, (area, row_id)) AS id FROM pc GROUP BY j, i")
def cell_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest shape at each cell."""
    return cells.by_priority(all_cells(spark, sf_dir).withColumnRenamed("row_id", "id"))


@query("JN17", f"{_MAPS} SELECT step, a.name AS a, b.name AS b, count(*) AS shared FROM n a JOIN n b USING (step, j, i) WHERE a.name < b.name GROUP BY 1, 2, 3")
def cell_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names that share cells of a map."""
    return cells.overlaps(drawn(spark, sf_dir), ["step"])


@query("GE10", f"""{_MAPS}, z AS (SELECT step, name, count(*) AS size FROM n GROUP BY ALL), w AS (SELECT DISTINCT a.step, a.name AS a, b.name AS b, CASE WHEN a.name = 'P1' THEN 'P1' WHEN y.size < x.size THEN b.name ELSE a.name END AS win FROM n a JOIN n b USING (step, j, i) JOIN z x ON x.step = a.step AND x.name = a.name JOIN z y ON y.step = a.step AND y.name = b.name WHERE a.name < b.name),
l AS (SELECT w.step, CASE WHEN win = a THEN b ELSE a END AS name, o.j, o.i FROM w JOIN n o ON o.step = w.step AND o.name = w.win) SELECT step, name, count(*) AS kept FROM n ANTI JOIN l USING (step, name, j, i) GROUP BY step, name""")
def cell_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells each name keeps after overlaps are settled; P1 wins by a correction over later names."""
    names = [f"P{k}" for k in range(40)]
    winners = spark.createDataFrame([("P1", b, "P1") for b in names if b > "P1"], "a string, b string, winner string")  # curated
    return cells.settle(stored(drawn(spark, sf_dir), "drawn"), ["step"], winners).groupBy("step", "name").agg(F.count(F.lit(1)).alias("kept"))


_NUMBER = "CAST(substr(name, 2) AS INT)"


@query("JN18 JN19 ST3", f"""{_MAPS}, d AS (SELECT CAST(o_orderkey % 50 AS INT) AS j, CAST(o_orderkey // 50 % {W} AS INT) AS i FROM orders GROUP BY 1, 2), k AS (SELECT *, {_NUMBER} // 4 AS family, {_NUMBER} % 4 = 0 AS whole FROM n)
SELECT 'unclaimed' AS kind, step, CAST(NULL AS VARCHAR) AS name, j, i FROM (SELECT step, j, i FROM ms, d) e ANTI JOIN n USING (step, j, i) UNION ALL
SELECT 'composite', step, name, j, i FROM (SELECT * FROM k WHERE whole) c ANTI JOIN (SELECT * FROM k WHERE NOT whole) m USING (step, family, j, i) UNION ALL SELECT DISTINCT 'undrawn', step, NULL, j, i FROM n ANTI JOIN d USING (j, i)""")
def cell_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dry cells that none holds, land of a composite (every fourth name, of the three after it) that no member holds, held cells off the land."""
    years = changes(spark, sf_dir)
    held = stored(drawn(spark, sf_dir, years).withColumn("number", F.substring("name", 2, 9).cast("int")).withColumn("family", F.floor(F.col("number") / 4)), "drawn")
    dry = bind.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).cast("int").alias("j"), F.expr(f"cast(o_orderkey div 50 % {W} as int)").alias("i")).distinct()
    kind = lambda k, df, name=F.lit(None).cast("string"): df.select(F.lit(k).alias("kind"), "step", name.alias("name"), "j", "i")
    own = held.where("number % 4 = 0").join(held.where("number % 4 <> 0"), ["step", "family", "j", "i"], "left_anti")
    free = on_every_map(years, dry).join(held, ["step", "j", "i"], "left_anti")
    return kind("unclaimed", free).union(kind("composite", own, F.col("name"))).union(kind("undrawn", held.select("step", "j", "i").distinct().join(dry, ["j", "i"], "left_anti")))


def on_every_map(years: DataFrame, of: DataFrame) -> DataFrame:
    """step, j, i of the same cells on every map, empty ones too: what is asked of a cell is asked at each step, so these are as many as rows of the answer."""
    return of.select("j", "i").crossJoin(F.broadcast(years.select("step")))  # one row per change year


_NEAR = f"x AS (SELECT unnest([-1, 0, 1]) AS a), nb AS (SELECT n.step, n.name, n.j, n.i, n.j + x.a AS nj, ((n.i + y.a) % {W} + {W}) % {W} AS ni FROM n, x, x y)"


@query("JN20", f"{_MAPS}, {_NEAR} SELECT DISTINCT step, nb.name AS piece, o.name AS other FROM nb JOIN n o USING (step) WHERE o.j = nb.nj AND o.i = nb.ni AND nb.name <> o.name")
def cell_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that touch or overlap each other on a map."""
    held = stored(drawn(spark, sf_dir), "drawn")
    return cells.touching(held.withColumnRenamed("name", "piece"), held.withColumnRenamed("name", "other"), ["step"], W).where("piece <> other")


@query("JN21", f"""{_MAPS}, u AS (SELECT * FROM (SELECT step, j, i FROM ms, (SELECT unnest(range(0, {H})) AS j), (SELECT unnest([0, {W - 1}]) AS i)) ANTI JOIN n USING (step, j, i))
SELECT step, CAST(u.j AS INT) AS j, CAST(u.i AS INT) AS i, min(name) AS name FROM u JOIN n USING (step) WHERE n.i = {W - 1} - u.i AND abs(n.j - u.j) <= 1 GROUP BY step, u.j, u.i HAVING count(DISTINCT name) = 1""")
def cell_across_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclaimed cells at the seam that go to the one holder over it."""
    years = changes(spark, sf_dir)
    held = stored(drawn(spark, sf_dir, years), "drawn")
    edge = spark.range(H).select(F.col("id").cast("int").alias("j"), F.explode(F.array(F.lit(0), F.lit(W - 1))).alias("i"))
    return cells.across_seam(on_every_map(years, edge).join(held, ["step", "j", "i"], "left_anti"), held, W, ("step",))


@query("GE6", f"""{_MAPS.replace("WITH", "WITH RECURSIVE", 1)}, r(step, name, j, i, c) AS (SELECT step, name, j, i, j * {W} + i FROM n UNION SELECT n.step, n.name, n.j, n.i, r.c FROM r JOIN n ON n.step = r.step AND n.name = r.name AND ((n.j = r.j AND (n.i = (r.i + 1) % {W} OR r.i = (n.i + 1) % {W})) OR (n.i = r.i AND abs(n.j - r.j) = 1)))
SELECT step, name, j, i, CAST(min(c) AS BIGINT) AS region FROM r GROUP BY step, name, j, i""")
def cell_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected pieces of each name on each map."""
    return cells.regions(drawn(spark, sf_dir), ["step", "name"], W)


@query("GE7", f"""{_MAPS}, {_NEAR}, e AS (SELECT nb.step, nb.name, nb.j, nb.i FROM nb JOIN n o ON o.step = nb.step AND o.name = nb.name AND o.j = nb.nj AND o.i = nb.ni GROUP BY ALL HAVING count(*) = 9)
SELECT n.* FROM n WHERE EXISTS (SELECT 1 FROM e WHERE e.step = n.step AND e.name = n.name AND abs(e.j - n.j) <= 1 AND (abs(e.i - n.i) <= 1 OR abs(e.i - n.i) = {W - 1}))""")
def cell_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each name that are three cells wide on a map."""
    return cells.opened(drawn(spark, sf_dir), ["step", "name"], W)


_ALL = f"a AS (SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i FROM (SELECT unnest(range(0, {H})) AS j), (SELECT unnest(range(0, {W})) AS i))"


def grid_all(spark: SparkSession) -> DataFrame:
    return spark.range(H * W).select(F.expr(f"cast(id div {W} as int)").alias("j"), (F.col("id") % W).cast("int").alias("i"))


_D = f"least(abs(o.i - a.i), {W} - abs(o.i - a.i))"


@query("GE2", f"""{_MAPS}, {_ALL}, h AS (SELECT step, j, i, min(name) AS id FROM n GROUP BY ALL), em AS (SELECT step, j, i FROM (SELECT step, j, i FROM ms, a) e ANTI JOIN h USING (step, j, i)) SELECT a.step, a.j, a.i, arg_min(o.id, ((o.j - a.j) * (o.j - a.j) + {_D} * {_D}, o.id)) AS id FROM em a JOIN h o ON o.step = a.step GROUP BY ALL""")
def cell_nearest_fill_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every empty cell of every map filled with the nearest name, however far."""
    years = changes(spark, sf_dir)
    held = stored(drawn(spark, sf_dir, years).groupBy("step", "j", "i").agg(F.min("name").alias("id")), "held")
    return cells.nearest_fill_all(held, on_every_map(years, grid_all(spark)).join(held, ["step", "j", "i"], "left_anti"), W, ("step",))


@query("GE2", SQL["cell_nearest_fill_whole"])
def cell_nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of cell_nearest_fill_whole."""
    return cell_nearest_fill_whole(spark, sf_dir)


@query("GE3", f"""{_MAPS}, {_ALL}, f AS (SELECT step, j, i, (step, j, i) IN (SELECT (step, j, i) FROM n) AS flag FROM ms, a) SELECT a.step, a.j, a.i, a.flag, round(CASE WHEN a.flag THEN 1 ELSE -1 END * least(4.0, sqrt(coalesce(min((o.j - a.j) * (o.j - a.j) + {_D} * {_D}), 16))), 6) AS distance FROM f a LEFT JOIN f o ON o.step = a.step AND o.flag <> a.flag AND abs(o.j - a.j) <= 4 AND {_D} <= 4 GROUP BY a.step, a.j, a.i, a.flag""")
def cell_signed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the border of each map's held land, within four cells."""
    years = changes(spark, sf_dir)
    held = stored(drawn(spark, sf_dir, years).select("step", "j", "i", F.lit(True).alias("h")).distinct(), "held")
    flags = on_every_map(years, grid_all(spark)).join(held, ["step", "j", "i"], "left").select("step", "j", "i", F.coalesce("h", F.lit(False)).alias("flag"))
    return cells.signed_distance(stored(flags, "flags"), W, 4, ("step",)).select("step", "j", "i", "flag", F.round("distance", 6).alias("distance"))


@query("GE3", f"""{CELLS}, {_ALL}, f AS (SELECT a.j, a.i, (a.j, a.i) IN (SELECT (j, i) FROM pc) AS flag FROM a), d AS (SELECT a.j, a.i, CASE WHEN a.flag THEN 1 ELSE -1 END * least(4.0, sqrt(coalesce(min((o.j - a.j) * (o.j - a.j) + {_D} * {_D}), 16))) AS distance FROM f a LEFT JOIN f o ON o.flag <> a.flag AND abs(o.j - a.j) <= 4 AND {_D} <= 4 GROUP BY a.j, a.i, a.flag)
SELECT CAST(j // 2 AS BIGINT) AS j, CAST(i // 2 AS BIGINT) AS i, round(avg(distance), 6) AS distance FROM d GROUP BY 1, 2""")
def cell_texel_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance, of texels of two by two cells, to the border of the land that any polity held in any year."""
    held = all_cells(spark, sf_dir).select(F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i"), F.lit(True).alias("h")).distinct()
    flags = grid_all(spark).join(held, ["j", "i"], "left").select("j", "i", F.coalesce("h", F.lit(False)).alias("flag"))
    return cells.texel_distance(flags, W, 4).select("j", "i", F.round("distance", 6).alias("distance"))


_OWN = "h AS (SELECT j, i, arg_min(row_id, (area, row_id)) AS id FROM pc GROUP BY j, i)"


@query("GE4", f"""{CELLS}, {_OWN}, nb AS (SELECT a.j, a.i, a.id, o.id AS other FROM h a JOIN h o ON a.id <> o.id AND ((o.j = a.j AND (a.i = (o.i + 1) % {W} OR o.i = (a.i + 1) % {W})) OR (o.i = a.i AND abs(o.j - a.j) = 1))),
bo AS (SELECT DISTINCT j, i, CASE WHEN other > id THEN -1 ELSE 1 END AS side, abs(other - id) = 1 AS soft FROM nb WHERE abs(other - id) IN (1, 3, 5)),
be AS (SELECT a.j, a.i, min((least(abs(o.i - a.i), {W} - abs(o.i - a.i)) * least(abs(o.i - a.i), {W} - abs(o.i - a.i)) + (o.j - a.j) * (o.j - a.j), side, soft)) AS b FROM h a JOIN bo o ON abs(o.j - a.j) <= 3 AND least(abs(o.i - a.i), {W} - abs(o.i - a.i)) <= 3 GROUP BY a.j, a.i)
SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i, round(b[2] * (sqrt(b[1]) + 0.5), 6) AS distance, b[3] AS soft FROM be""")
def cell_border_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to borders between even and odd ids, soft where they lie close."""
    held = cells.by_priority(all_cells(spark, sf_dir).withColumnRenamed("row_id", "id"))
    ids = held.select("id").distinct()
    pairs = ids.withColumnRenamed("id", "lower").join(ids.withColumnRenamed("id", "upper"), (F.col("upper") - F.col("lower")).isin(1, 3, 5)).withColumn("soft", F.col("upper") - F.col("lower") == 1)
    return cells.border_distance(held, pairs, W, 3).select(F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i"), F.round("distance", 6).alias("distance"), "soft")


@query("GE8", f"""{_MAPS}, {_ALL}, {LAKES}, b AS (SELECT unnest(range(-2, 3)) AS a), ln AS (SELECT DISTINCT lk.j + b.a AS j, (lk.i + c.a + {W}) % {W} AS i FROM lk, b, b c), hn AS (SELECT DISTINCT n.step, n.j + b.a AS j, (n.i + c.a + {W}) % {W} AS i FROM n, b, b c)
SELECT step, j, i FROM (SELECT step, j, i FROM ms, a) ANTI JOIN n USING (step, j, i) SEMI JOIN ln USING (j, i) SEMI JOIN hn USING (step, j, i)""")
def cell_both_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty cells of each map with both a lake and held land near."""
    years = changes(spark, sf_dir)
    held = stored(drawn(spark, sf_dir, years).select("step", "j", "i").distinct(), "held")
    return cells.both_near(on_every_map(years, grid_all(spark)).join(held, ["step", "j", "i"], "left_anti"), lake_cells(spark, sf_dir), held, W, 2, ("step",))


_SEG = "SELECT s_suppkey AS seg, (s_suppkey * 31 % 70) * 1e0 AS x0, (s_suppkey * 17 % 45) * 1e0 AS y0, (s_suppkey * 31 % 70) + s_suppkey % 7 + 0e0 AS x1, (s_suppkey * 17 % 45) + s_suppkey % 4 + 0e0 AS y1, 0.2 + s_suppkey % 3 * 1e-1 AS half FROM {supplier}"
_PT = "SELECT c_custkey AS id, (c_custkey * 7919 % 8000) / 1e2 AS x, (c_custkey * 104729 % 5000) / 1e2 AS y FROM {customer}"


@query("JN23", f"""{bind.ctes(s=_SEG, p=_PT)}, t AS (SELECT *, CASE WHEN (x1 - x0) ** 2 + (y1 - y0) ** 2 > 0 THEN least(1.0, greatest(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) ELSE 0.0 END AS t FROM s, p),
d AS (SELECT id, half, sqrt((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2) AS d FROM t) SELECT id, round(min(d), 6) AS distance FROM d WHERE d <= half GROUP BY id""")
def cell_near_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within the half width of a segment."""
    seg = bind.frame(spark, sf_dir, _SEG).withColumn("half", F.col("half").cast("double"))
    return cells.near_segments(bind.frame(spark, sf_dir, _PT), seg, W).select("id", F.round("distance", 6).alias("distance"))


@query("WN17", f"""{_MAPS}, r AS (SELECT step, name, j, i, i - row_number() OVER (PARTITION BY step, name, j ORDER BY i) AS g FROM n), s AS (SELECT step, name, j, min(i) AS first, count(*) AS length FROM r GROUP BY step, name, j, g) SELECT step, name, arg_max(j, (length, -j, -first)) AS j, arg_max(first, (length, -j, -first)) AS first, max(length) AS length FROM s GROUP BY step, name""")
def cell_longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest row of cells of each name on each map."""
    r = cells.runs(drawn(spark, sf_dir), ["step", "name", "j"], "i").withColumn("length", (F.col("last") - F.col("first") + 1).cast("long"))
    best = F.max_by(F.struct("j", "first", "length"), F.struct("length", -F.col("j"), -F.col("first")))
    return r.groupBy("step", "name").agg(best.alias("b")).select("step", "name", "b.*")
