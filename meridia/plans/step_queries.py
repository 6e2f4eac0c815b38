"""Maps per change year of suppliers taken as polities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.operators import audits, cells, evolving, grid, steps
from meridia.operators.joins import interval_join
from meridia.plans import bind
from meridia.plans.cell_queries import CELLS, H, LAKES, W, YEARS, all_cells, changes, drawn, lake_cells
from meridia.registry import query
from meridia.shared import stored

_P = bind.POLITY


@query("WN9", f"{YEARS} SELECT step, year, CASE WHEN s = '' THEN '' ELSE sha256(s) END AS sign FROM st")
def step_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years in which the set of valid rows changes."""
    return steps.change_years(bind.frame(spark, sf_dir, _P)).withColumn("step", F.col("step").cast("long"))


def _held(spark: SparkSession, sf_dir: str, years: DataFrame) -> DataFrame:
    """step, row_id, name of rows valid at each change year."""
    return interval_join(bind.frame(spark, sf_dir, _P), years.withColumn("until", F.col("year")), "first", "last", "year", "until", 10)


_HELD = "hd AS (SELECT step, row_id, name FROM p, st WHERE first <= year AND year <= last)"
_RUNS = f"""{YEARS}, {_HELD}, d AS (SELECT DISTINCT name, step FROM hd), r AS (SELECT name, step, step - row_number() OVER (PARTITION BY name ORDER BY step) AS k FROM d) SELECT name, CAST(min(step) AS INT) AS first, CAST(max(step) AS INT) AS last FROM r GROUP BY name, k"""


@query("WN7 WN8", _RUNS)
def step_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of change steps in which a name is drawn."""
    return steps.merged(_held(spark, sf_dir, changes(spark, sf_dir)).select("name", "step").distinct(), ["name"])


@query("WN7 WN8", _RUNS)
def step_runs_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of step_runs."""
    return step_runs(spark, sf_dir)


@query("WN11", f"""{bind.ctes(p=_P)}, s AS (SELECT name, first, max(last) OVER (PARTITION BY name ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p) SELECT name, seen + 1 AS gone, first AS back FROM s WHERE first > seen + 1""")
def step_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years between a name's spans."""
    return steps.gaps(bind.frame(spark, sf_dir, _P).select("name", "first", "last"))


@query("WN18 AG24", f"""{bind.ctes(p=_P)}, d AS (SELECT name, min(row_id) AS line, list(row_id ORDER BY row_id) AS ids, list_sort(list_distinct(string_split(name, ''))) AS chars FROM p GROUP BY name) SELECT name, row_number() OVER (ORDER BY name) + 1 AS id, line, ids, chars FROM d""")
def step_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names numbered from 2, with their rows in order and their characters."""
    rows = bind.frame(spark, sf_dir, _P).groupBy("name").agg(F.min("row_id").alias("line"), F.array_sort(F.collect_set("row_id")).alias("ids"))
    rank = F.row_number().over(Window.orderBy("name")) + 1  # one row per name
    return rows.select("name", rank.cast("long").alias("id"), "line", "ids", F.array_sort(F.array_distinct(F.split("name", ""))).alias("chars"))


# Each cell's holder at every change year.
_HOLD = f"""{YEARS}, pc{CELLS.split(", pc", 1)[1]}, hc AS (SELECT step, j, i, min(name) AS name FROM pc, st WHERE first <= year AND year <= last GROUP BY step, j, i),
al AS (SELECT st.step, c.j, c.i, hc.name, st.year FROM (SELECT DISTINCT j, i FROM pc) c CROSS JOIN st LEFT JOIN hc ON hc.step = st.step AND hc.j = c.j AND hc.i = c.i)"""


def _holding(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The holder of each cell that has one at each change year, and the years."""
    years = changes(spark, sf_dir)
    rows = interval_join(all_cells(spark, sf_dir), years.withColumn("until", F.col("year")), "first", "last", "year", "until", 10)
    return stored(rows.groupBy("step", "j", "i").agg(F.min("name").alias("name")), "holders"), years


def _holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's holder at each change year, null where it has none: what is to be filled is every empty cell of every map."""
    held, years = _holding(spark, sf_dir)
    spine = all_cells(spark, sf_dir).select("j", "i").distinct().crossJoin(F.broadcast(years.select("step")))  # one row per step
    return stored(spine.join(held, ["step", "j", "i"], "left"), "maps")


_DRAWN = f"""{YEARS}, pc{CELLS.split(", pc", 1)[1]}, dr AS (SELECT DISTINCT CAST(step AS INT) AS step, name, CAST(j AS INT) AS j, CAST(i AS INT) AS i FROM pc, st WHERE first <= year AND year <= last)"""

_GONE = """m AS (SELECT *, last_value(name IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(name IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b,
  max(CASE WHEN name IS NOT NULL THEN step END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM al WINDOW w AS (PARTITION BY j, i ORDER BY step))"""
_CARRIED = f"""{_HOLD}, {_GONE}
SELECT CAST(step AS INT) AS step, CAST(j AS INT) AS j, CAST(i AS INT) AS i, a AS name FROM (SELECT *, min(CASE WHEN name IS NULL THEN year END) OVER (PARTITION BY j, i, s) AS f FROM m) WHERE name IS NULL AND a = b AND year - f <= 12"""


@query("WN12", _CARRIED)
def step_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclaimed cells carried through between the same holder, over every change year."""
    held, years = _holding(spark, sf_dir)
    return steps.carried(held, years, 12)


@query("WN12", _CARRIED)
def step_carried_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of step_carried."""
    return step_carried(spark, sf_dir)


_UNITS = "un AS (SELECT name, 'U' || CAST(row_id % 7 AS VARCHAR) AS outer_unit, h * w AS cells FROM p)"


@query("WN12 GE15", f"""{_HOLD}, {_UNITS}, {_GONE}, cr AS ({_CARRIED.split(_GONE, 1)[1]}),
k AS (SELECT c.step, c.name, c.j + y.d AS j, (c.i + x.d + {W}) % {W} AS i FROM cr c, (SELECT unnest([-1, 0, 1]) AS d) y, (SELECT unnest([-1, 0, 1]) AS d) x),
e AS (SELECT step, name, j, i FROM k GROUP BY ALL HAVING count(*) = 9), wd AS (SELECT cr.* FROM cr WHERE EXISTS (SELECT 1 FROM e WHERE e.step = cr.step AND e.name = cr.name AND abs(e.j - cr.j) <= 1 AND (abs(e.i - cr.i) <= 1 OR abs(e.i - cr.i) = {W - 1}))),
u AS (SELECT name, arg_max(outer_unit, (cells, outer_unit)) AS outer_unit FROM un GROUP BY name) SELECT step, wd.name, coalesce(outer_unit, wd.name) AS outer_unit, count(*) AS cells FROM wd LEFT JOIN u USING (name) GROUP BY ALL""")
def step_carried_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide parts of what is carried through, with the outer unit of the largest of the name's rows."""
    held, years = _holding(spark, sf_dir)
    wide = steps.wide_only(stored(steps.carried(held, years, 12), "carried"), W)
    units = bind.frame(spark, sf_dir, _P).select("name", F.concat(F.lit("U"), (F.col("row_id") % 7).cast("string")).alias("outer"), (F.col("h") * F.col("w")).alias("cells"))
    return steps.carried_units(wide, units).withColumnRenamed("outer", "outer_unit")


_AREA = f"6371.0088 * 6371.0088 * (2 * pi() / {W}) * (sin(radians(-90 + ({{0}} + 1) * 180.0 / {H})) - sin(radians(-90 + {{0}} * 180.0 / {H})))"
_SPAN_KEYS = ("a", "b", "first", "last")


@query("WN13", f"""{_HOLD.replace("WITH", "WITH RECURSIVE", 1)}, {_GONE}, o AS (SELECT j, i, s, a, b, min(step) AS first, max(step) AS last, min(year) AS y0, max(year) AS y1 FROM m WHERE name IS NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
n AS (SELECT DISTINCT a, b, first, last, j, i FROM o WHERE y1 - y0 <= 40),
r AS (SELECT *, j * {W} + i AS c FROM n UNION SELECT n.*, r.c FROM r JOIN n ON {" AND ".join(f"n.{k} = r.{k}" for k in _SPAN_KEYS)} AND ((n.j = r.j AND (n.i = (r.i + 1) % {W} OR r.i = (n.i + 1) % {W})) OR (n.i = r.i AND abs(n.j - r.j) = 1))),
lb AS (SELECT a, b, first, last, j, i, min(c) AS region FROM r GROUP BY ALL), f AS (SELECT a, b, first, last, region, count(*) AS cells, sum({_AREA.format("j")}) AS km2 FROM lb GROUP BY ALL HAVING sum({_AREA.format("j")}) >= 300000)
SELECT a, b, CAST(first AS INT) AS first, CAST(last AS INT) AS last, CAST(region AS BIGINT) AS region, cells, round(km2, 3) AS km2 FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE 'P' || CAST(row_id * 3 % 40 AS VARCHAR) = f.a AND name = f.b AND row_id % 20 <= f.first AND f.last <= row_id % 20 + 30)""")
def step_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions unclaimed for a while between two holders, those acknowledged left out."""
    held, years = _holding(spark, sf_dir)
    said = bind.frame(spark, sf_dir, _P).select(F.concat(F.lit("P"), (F.col("row_id") * 3 % 40).cast("string")).alias("a"), F.col("name").alias("b"), (F.col("row_id") % 20).alias("first"), (F.col("row_id") % 20 + 30).alias("last"))
    return steps.unresolved(held, years, 40, 300_000.0, H, W, said).withColumn("km2", F.round("km2", 3))


def dry_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """j, i of the land, off the lakes."""
    dry = bind.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % (H - 4) + 2).cast("int").alias("j"), F.expr(f"cast(o_orderkey div 50 % {W} as int)").alias("i")).distinct()
    return dry.join(lake_cells(spark, sf_dir), ["j", "i"], "left_anti")


@query("GE14")
def step_unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of land that none holds at each change year, with what the map says of them and what becomes of them."""
    years = changes(spark, sf_dir)
    rows = evolving.step_spans(bind.frame(spark, sf_dir, _P), years)
    spans = cells.boxes(rows.select("name", "first", "last", "j0", "i0", "h", "w"), W)
    outer = rows.select("name").distinct().withColumn("outer", F.concat(F.lit("U"), F.col("name").substr(2, 1)))
    runs = evolving.unclaimed(stored(dry_cells(spark, sf_dir), "dry"), spans, stored(lake_cells(spark, sf_dir), "lakes"), outer, years.count(), H, W)
    pieces = runs.withColumn("step", F.explode(F.sequence("first", "last"))).drop("first", "last")
    return steps.classify(pieces, 2_000_000.0).withColumn("km2", F.round("km2", 3))


@query("AG25", f"""{_DRAWN}, z AS (SELECT step, name, count(*) AS size FROM dr GROUP BY ALL), o AS (SELECT x.step, x.name AS a, y.name AS b, count(*) AS shared FROM dr x JOIN dr y ON x.step = y.step AND x.j = y.j AND x.i = y.i AND x.name < y.name GROUP BY ALL),
q AS (SELECT o.*, shared / least(za.size, zb.size) AS share, CASE WHEN zb.size < za.size THEN b ELSE a END AS winner FROM o JOIN z za ON za.step = o.step AND za.name = a JOIN z zb ON zb.step = o.step AND zb.name = b),
k AS (SELECT 'P' || CAST(row_id * 7 % 40 AS VARCHAR) AS a, name AS b, row_id % 30 AS f, row_id % 30 + 25 AS l FROM p), d AS (SELECT q.*, share >= 0.5 AS dup, EXISTS (SELECT 1 FROM k WHERE k.a = q.a AND k.b = q.b AND f <= step AND step <= l) AS known FROM q)
SELECT a, b, min(step) AS first, count(*) AS steps, max(shared) AS cells, round(max(share), 9) AS share, list_sort(list(DISTINCT winner)) AS winners, count(*) FILTER (dup) AS duplicate, count(*) FILTER (dup AND NOT known) AS unacknowledged FROM d GROUP BY a, b""")
def step_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the overlaps of each pair of names come to over all change years."""
    pairs = steps.overlap_pairs(stored(drawn(spark, sf_dir), "drawn"))
    said = bind.frame(spark, sf_dir, _P).select(F.concat(F.lit("P"), (F.col("row_id") * 7 % 40).cast("string")).alias("a"), F.col("name").alias("b"), (F.col("row_id") % 30).alias("first"), (F.col("row_id") % 30 + 25).alias("last"))
    return steps.review(pairs, said, 0.5).withColumn("share", F.round("share", 9))


_AROUND = "(SELECT unnest([-1, 0, 1]) AS d) y, (SELECT unnest([-1, 0, 1]) AS d) x"
_BAND = f"""wl AS (SELECT l.j, l.i FROM lk l, {_AROUND}, lk o WHERE o.j = l.j + y.d AND o.i = (l.i + x.d + {W}) % {W} GROUP BY l.j, l.i HAVING count(*) = 9),
bd AS (SELECT DISTINCT l.j + y.d AS j, (l.i + x.d + {W}) % {W} AS i FROM lk l, {_AROUND}), ba AS (SELECT * FROM bd WHERE (j, i) NOT IN (SELECT (j, i) FROM lk) AND EXISTS (SELECT 1 FROM wl WHERE abs(wl.j - bd.j) <= 3 AND least(abs(wl.i - bd.i), {W} - abs(wl.i - bd.i)) <= 3))"""


@query("GE9", f"WITH {LAKES}, {_BAND} SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i FROM ba")
def cell_shore_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells beside a lake where it is wide."""
    return cells.shore_band(lake_cells(spark, sf_dir), [], W)


@query("VQ6 GE6", f"""{_HOLD.replace("WITH", "WITH RECURSIVE", 1)}, {LAKES}, {_BAND}, hb AS (SELECT DISTINCT a.step, a.j, a.i FROM hc a JOIN hc b ON a.step = b.step AND a.name <> b.name AND ((a.j = b.j AND (a.i = (b.i + 1) % {W} OR b.i = (a.i + 1) % {W})) OR (a.i = b.i AND abs(a.j - b.j) = 1))),
n AS (SELECT hb.* FROM hb JOIN ba ON ba.j = hb.j AND ba.i = hb.i), r AS (SELECT *, j * {W} + i AS c FROM n UNION SELECT n.*, r.c FROM r JOIN n ON n.step = r.step AND abs(n.j - r.j) <= 1 AND (abs(n.i - r.i) <= 1 OR abs(n.i - r.i) = {W - 1})),
lb AS (SELECT step, j, i, min(c) AS region FROM r GROUP BY ALL), x AS (SELECT step, region, count(*) AS cells, min(j) AS j0, min(i) AS i0, max(j) AS j1, max(i) AS i1 FROM lb GROUP BY ALL),
k AS (SELECT *, round(400 * sqrt((j1 - j0 + 1) * (j1 - j0 + 1) + (i1 - i0 + 1) * (i1 - i0 + 1)), 6) AS km FROM x)
SELECT CAST(step AS INT) AS step, CAST(region AS BIGINT) AS region, cells, km FROM k WHERE km > 1000 AND NOT EXISTS (SELECT 1 FROM st, region WHERE st.step = k.step AND r_regionkey * 10 <= j1 AND r_regionkey * 10 + 3 >= j0 AND st.step % 60 <= i1 AND st.step % 60 + 8 >= i0)""")
def audit_shore_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders that run beside a shore for more than 1,000 km at any change year, those with an excuse left out."""
    held, years = _holding(spark, sf_dir)
    border = cells.border_cells(held.where("name is not null"), ["step"], W)
    band = cells.shore_band(lake_cells(spark, sf_dir), [], W)
    runs = cells.shore_runs(border, years.select("step").crossJoin(F.broadcast(band)), ["step"], W, 400.0)  # a shore band of bounded lakes
    row = bind.table(spark, sf_dir, "region").select((F.col("r_regionkey") * 10).alias("j0"), (F.col("r_regionkey") * 10 + 3).alias("j1"))
    excuses = years.select("step", (F.col("step") % 60).alias("i0"), (F.col("step") % 60 + 8).alias("i1")).crossJoin(F.broadcast(row))  # five regions
    return audits.shore_faults(runs, excuses, ["step"], 1000.0).select("step", "region", "cells", F.round("km", 6).alias("km"))


_CORRECTIONS = [
    {"kind": "rename", "name": "P1", "to": "P1 north", "y0": 0, "y1": 7},
    {"kind": "drop", "name": "P2", "y0": 3, "y1": 9},
    {"kind": "add", "name": "P3", "y0": 2, "y1": 5, "within": (0, 0, 2, 3)},
    {"kind": "carry", "name": "P8", "y0": 0, "y1": 12, "year": 1820},
    {"kind": "give", "name": "P4", "to": "P5", "y0": 0, "y1": 20, "inside": ("P8", 1820)},
    {"kind": "give", "name": "P4", "to": "P5", "y0": 0, "y1": 14, "within": (0, 0, 30, 40)},
    {"kind": "pocket", "name": "P6", "to": "P7", "y0": 0, "y1": 30, "at": (36, 17)},
    {"kind": "drop", "name": "P9", "y0": 0, "y1": 30, "within": (0, 0, 30, 79)},
]
_PIECE = f"((c.j = f.j AND (c.i = (f.i + 1) % {W} OR f.i = (c.i + 1) % {W})) OR (c.i = f.i AND abs(c.j - f.j) = 1))"


@query("GE12 GE13 JN26", f"""{_HOLD.replace("WITH", "WITH RECURSIVE", 1)}, sh AS (SELECT DISTINCT j, i FROM pc WHERE name = 'P8' AND first <= 1820 AND 1820 <= last), c0 AS (SELECT step, name, j, i FROM hc),
c1 AS (SELECT step, CASE WHEN name = 'P1' AND step <= 7 THEN 'P1 north' ELSE name END AS name, j, i FROM c0), c2 AS (SELECT * FROM c1 WHERE NOT (name = 'P2' AND step BETWEEN 3 AND 9)),
c3 AS (SELECT * FROM c2 UNION SELECT step, 'P3', j, i FROM (SELECT DISTINCT step FROM c2 WHERE step BETWEEN 2 AND 5), (SELECT unnest(range(0, 3)) AS j), (SELECT unnest(range(0, 4)) AS i)),
c4 AS (SELECT * FROM c3 UNION SELECT step, 'P8', j, i FROM (SELECT DISTINCT step FROM c3 WHERE step <= 12 AND step NOT IN (SELECT step FROM c3 WHERE name = 'P8')), sh),
c5 AS (SELECT DISTINCT step, CASE WHEN name = 'P4' AND step <= 20 AND (j, i) IN (SELECT (j, i) FROM sh) THEN 'P5' ELSE name END AS name, j, i FROM c4),
c6 AS (SELECT DISTINCT step, CASE WHEN name = 'P4' AND step <= 14 AND j BETWEEN 0 AND 30 AND i BETWEEN 0 AND 40 THEN 'P5' ELSE name END AS name, j, i FROM c5),
f AS (SELECT step, j, i FROM c6 WHERE name = 'P6' AND step <= 30 AND j = 36 AND i = 17 UNION SELECT c.step, c.j, c.i FROM f JOIN c6 c ON c.step = f.step AND c.name = 'P6' AND {_PIECE}),
c7 AS (SELECT DISTINCT c.step, CASE WHEN c.name = 'P6' AND f.step IS NOT NULL THEN 'P7' ELSE c.name END AS name, c.j, c.i FROM c6 c LEFT JOIN f ON f.step = c.step AND f.j = c.j AND f.i = c.i),
st9 AS (SELECT step, j, i FROM c7 WHERE name = 'P9' AND step <= 30 AND j > 30 UNION SELECT c.step, c.j, c.i FROM st9 f JOIN c7 c ON c.step = f.step AND c.name = 'P9' AND {_PIECE}),
c8 AS (SELECT * FROM c7 c WHERE NOT (name = 'P9' AND step <= 30 AND NOT EXISTS (SELECT 1 FROM st9 WHERE st9.step = c.step AND st9.j = c.j AND st9.i = c.i)))
SELECT CAST(step AS INT) AS step, name, count(*) AS cells FROM c8 GROUP BY step, name""")
def step_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of names at each change year after corrections in order."""
    held, _ = _holding(spark, sf_dir)
    rows = held.where("name is not null").select("step", "name", F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i"))
    source = all_cells(spark, sf_dir).select("name", "first", "last", F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i"))
    return steps.corrected(rows, _CORRECTIONS, W, source).groupBy("step", "name").agg(F.count(F.lit(1)).alias("cells"))


_EDGES = "SELECT DISTINCT 'P' || CAST(s_suppkey % 40 AS STRING) AS child, 'P' || CAST(s_suppkey % 40 DIV 3 AS STRING) AS parent, CASE WHEN s_suppkey % 40 % 5 = 4 THEN 'other' WHEN s_suppkey % 2 = 0 THEN 'member' ELSE 'vassal' END AS kind FROM {supplier} WHERE s_suppkey % 40 > 2"


@query("GE11", f"""WITH RECURSIVE ed AS ({bind.duck(_EDGES)}), u AS (SELECT child, parent FROM ed WHERE kind <> 'other'), r AS (SELECT child AS node, parent AS anc FROM u UNION SELECT r.node, u.parent FROM r JOIN u ON u.child = r.anc),
t AS (SELECT node, min(anc) AS o, count(DISTINCT anc) AS k FROM r WHERE anc NOT IN (SELECT child FROM ed) GROUP BY node) SELECT n.name, coalesce(o, n.name) AS outer_unit, coalesce(k, 1) AS roots FROM (SELECT DISTINCT child AS name FROM ed) n LEFT JOIN t ON t.node = n.name""")
def step_outer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root above each name by membership."""
    edges = bind.frame(spark, sf_dir, _EDGES)
    return steps.outer_units(edges, edges.select(F.col("child").alias("name")).distinct()).withColumnRenamed("outer", "outer_unit")


# Polities, composites (E0) to (E5) and relations, valid as the polity table says; lists as the source writes them.
_UNITS = """SELECT CASE WHEN s_suppkey % 10 = 3 THEN '(E' || CAST(s_suppkey DIV 10 % 6 AS STRING) || ')' WHEN s_suppkey % 10 = 7 THEN 'Vassalage of P' || CAST(s_suppkey DIV 10 % 40 AS STRING) || ' to E' || CAST(s_suppkey DIV 20 % 3 AS STRING) ELSE 'P' || CAST(s_suppkey % 40 AS STRING) END AS name,
CAST(1800 + s_suppkey * 17 % 60 AS INT) AS first, CAST(1800 + s_suppkey * 17 % 60 + s_suppkey * 7 % 30 AS INT) AS last, s_suppkey % 10 <> 7 AS polity,
CASE WHEN s_suppkey % 10 = 3 THEN 'P' || CAST(s_suppkey % 19 AS STRING) || ' ; P' || CAST(s_suppkey % 40 + 1 AS STRING) ELSE '' END AS components, CASE WHEN s_suppkey % 4 = 1 THEN '(E1);(E' || CAST(s_suppkey % 7 AS STRING) || ')' WHEN s_suppkey % 20 = 3 THEN '(E0)' ELSE '' END AS member_of FROM {supplier}"""
_KINDS = "SELECT '(E' || CAST(r_regionkey AS STRING) || ')' AS name, CASE WHEN r_regionkey < 3 THEN 'empire' ELSE 'grouping' END AS kind FROM {region}"
_RELATIONS = "SELECT 'Vassalage of P' || CAST(n_nationkey AS STRING) || ' to E' || CAST(r_regionkey AS STRING) AS name, (n_nationkey + r_regionkey) % 3 > 0 AS counts FROM {nation}, {region} WHERE r_regionkey < 3"
_UNDER = f"""{YEARS}, un AS ({bind.duck(_UNITS)}), ki AS ({bind.duck(_KINDS)}), re AS ({bind.duck(_RELATIONS)}), va AS (SELECT step, name, polity, components, member_of FROM un, st WHERE first <= year AND year <= last),
na AS (SELECT DISTINCT step, name, name[1] = '(' AS comp FROM va WHERE polity),
li AS (SELECT DISTINCT step, trim(c) AS child, name AS parent FROM (SELECT step, name, unnest(string_split(components, ';')) AS c FROM va WHERE polity AND name[1] = '(') WHERE trim(c) NOT IN ('', name)),
cl AS (SELECT DISTINCT step, name, trim(c) AS parent FROM (SELECT step, name, unnest(string_split(member_of, ';')) AS c FROM va WHERE polity) WHERE trim(c) <> ''),
sa AS (SELECT cl.step, cl.name AS child, cl.parent FROM cl JOIN na ON na.step = cl.step AND na.name = cl.parent AND comp WHERE cl.name <> cl.parent AND NOT EXISTS (SELECT 1 FROM li WHERE li.step = cl.step AND li.child = cl.name)),
rl AS (SELECT DISTINCT va.step, regexp_extract(name, 'of (.*) to (.*)', 1) AS v, regexp_extract(name, 'of (.*) to (.*)', 2) AS q FROM va JOIN re USING (name) WHERE NOT polity AND counts),
rp AS (SELECT rl.step, CASE WHEN a.name IS NOT NULL THEN a.name ELSE b.name END AS child, CASE WHEN c.name IS NOT NULL THEN c.name ELSE d.name END AS parent FROM rl LEFT JOIN na a ON a.step = rl.step AND a.name = '(' || v || ')' LEFT JOIN na b ON b.step = rl.step AND b.name = v
  LEFT JOIN na c ON c.step = rl.step AND c.name = '(' || q || ')' LEFT JOIN na d ON d.step = rl.step AND d.name = q),
al AS (SELECT step, child, parent FROM (SELECT * FROM li UNION SELECT * FROM sa UNION SELECT * FROM rp) e LEFT JOIN na ON na.step = e.step AND na.name = e.parent LEFT JOIN ki ON ki.name = e.parent WHERE child <> parent AND child IS NOT NULL AND parent IS NOT NULL AND (NOT coalesce(comp, false) OR coalesce(kind = 'empire', false))),
up AS (SELECT step, child AS node, parent AS anc FROM al UNION SELECT up.step, up.node, al.parent FROM up JOIN al ON al.step = up.step AND al.child = up.anc),
tp AS (SELECT step, node, min(anc) AS o, count(DISTINCT anc) AS k FROM up WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.step = up.step AND al.child = up.anc) GROUP BY ALL),
ou AS (SELECT na.step, na.name, coalesce(o, na.name) AS outer_unit, coalesce(k, 1) AS roots FROM na LEFT JOIN tp ON tp.step = na.step AND tp.node = na.name WHERE NOT comp)""".replace("WITH", "WITH RECURSIVE", 1).replace("SELECT step, child, parent FROM (SELECT * FROM li", "SELECT e.step, child, parent FROM (SELECT * FROM li")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of polities, composites and relations valid at each change year."""
    from meridia.functions.text import split_list

    years = changes(spark, sf_dir).withColumn("until", F.col("year"))
    rows = bind.frame(spark, sf_dir, _UNITS).select("name", "first", "last", "polity", split_list("components").alias("components"), split_list("member_of").alias("member_of"))
    return stored(interval_join(rows, years, "first", "last", "year", "until", 10).select("step", "name", "polity", "components", "member_of"), "units")


def _outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir)
    edges = steps.memberships(rows, bind.frame(spark, sf_dir, _KINDS), bind.frame(spark, sf_dir, _RELATIONS))
    return steps.outer_units_by_step(edges, rows.where("polity and not startswith(name, '(')").select("step", "name").distinct())


@query("GE11", f"{_UNDER} SELECT CAST(step AS INT) AS step, name, outer_unit, roots FROM ou")
def step_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer unit of each polity at each change year by components, memberships and vassalage; more than one root is an error to be looked at."""
    return _outer(spark, sf_dir).withColumnRenamed("outer", "outer_unit")


@query("GE11 AG25", f"""{_UNDER} SELECT CAST(step AS INT) AS step, what, name FROM (SELECT step, 'composite' AS what, name FROM na WHERE comp AND name NOT IN (SELECT name FROM ki)
UNION ALL SELECT DISTINCT step, 'relation', name FROM va WHERE NOT polity AND name NOT IN (SELECT name FROM re)
UNION ALL SELECT DISTINCT step, 'unsettled', name FROM cl WHERE NOT EXISTS (SELECT 1 FROM li WHERE li.step = cl.step AND li.child = cl.name) AND NOT EXISTS (SELECT 1 FROM cl m JOIN na ON na.step = m.step AND na.name = m.parent AND comp WHERE m.step = cl.step AND m.name = cl.name AND m.parent <> m.name))""")
def step_membership_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no table classes, and who is a member of nothing that is there."""
    return steps.membership_review(_units(spark, sf_dir), bind.frame(spark, sf_dir, _KINDS), bind.frame(spark, sf_dir, _RELATIONS))


# Holes of fifteen steps of six years, from customers; their largest states and lakes.
_HOLES = """SELECT c_custkey AS hole, CAST(c_custkey % 15 AS INT) AS step, CAST(c_custkey * 31 % 1009 AS INT) AS ord, CAST((c_custkey * c_custkey * 7 + c_custkey * 7919) % 6000 AS DOUBLE) / 100 - 30 AS lon, CAST((c_custkey * c_custkey * 13 + c_custkey * 104729) % 5987 AS DOUBLE) / 100 - 20 AS lat,
CAST((c_custkey * c_custkey * 7 + c_custkey * 7919) % 6000 AS DOUBLE) / 100 - 29.75 AS clon, CAST((c_custkey * c_custkey * 13 + c_custkey * 104729) % 5987 AS DOUBLE) / 100 - 20.25 AS clat, CAST(c_custkey % 17 + 1 AS DOUBLE) * 1000 AS km2, c_mktsegment AS state, c_nationkey % 7 = 0 AS lake FROM {customer}"""
_KNOWN_HOLES = "SELECT 'hole ' || CAST(1800 + n_nationkey % 15 * 6 AS STRING) || '..' || CAST(1805 + n_nationkey % 15 * 6 AS STRING) || ' 11E 12N' AS id FROM {nation}"


@query("WN14", f"""WITH RECURSIVE h AS ({bind.duck(_HOLES)}), l AS (SELECT b.hole, arg_min(a.hole, (a.ord, a.hole)) AS up FROM h a JOIN h b ON b.step = a.step + 1 AND abs(a.lon - b.lon) <= 2 AND abs(a.lat - b.lat) <= 2 GROUP BY b.hole),
r AS (SELECT hole, hole AS track FROM h WHERE hole NOT IN (SELECT hole FROM l) UNION ALL SELECT l.hole, r.track FROM r JOIN l ON l.up = r.hole),
t AS (SELECT track, arg_max((lon, lat, km2, floor(clon + 0.5), floor(clat + 0.5)), (km2, -step, -ord)) AS b, 1800 + min(step) * 6 AS first, 1805 + max(step) * 6 AS last, list_sort(list(DISTINCT state)) AS states, bool_or(lake) AS lake, count(*) AS holes, min((step, ord, hole)) AS begun FROM r JOIN h USING (hole) GROUP BY track),
n AS (SELECT *, 'hole ' || first || '..' || last || ' ' || CAST(abs(b[4]) AS BIGINT) || CASE WHEN b[4] < 0 THEN 'W' ELSE 'E' END || ' ' || CAST(abs(b[5]) AS BIGINT) || CASE WHEN b[5] < 0 THEN 'S' ELSE 'N' END AS base FROM t),
i AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || ' #' || row_number() OVER (PARTITION BY base ORDER BY begun) ELSE base END AS id FROM n)
SELECT track, id, first, last, b[1] AS lon, b[2] AS lat, b[3] AS km2, states, lake, holes, id IN ({bind.duck(_KNOWN_HOLES)}) AS acknowledged FROM i""")
def step_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes followed through consecutive steps, with their stable ids."""
    holes = bind.frame(spark, sf_dir, _HOLES).withColumn("states", F.array("state")).drop("state")
    ends = spark.range(15).select(F.col("id").cast("int").alias("step"), (1800 + F.col("id") * 6).cast("int").alias("year"), (1805 + F.col("id") * 6).cast("int").alias("until"))
    return steps.owed_holes(holes, ends, 2.0, bind.frame(spark, sf_dir, _KNOWN_HOLES))


@query("GE16 GE17", f"""{_DRAWN.replace("WITH", "WITH RECURSIVE", 1)}, {LAKES}, dy AS (SELECT DISTINCT CAST(o_orderkey % {H - 4} + 2 AS INT) AS j, CAST(o_orderkey // 50 % {W} AS INT) AS i FROM orders),
n AS (SELECT step, name, j, i FROM dr SEMI JOIN (SELECT * FROM dy WHERE (j, i) NOT IN (SELECT (j, i) FROM lk)) d USING (j, i)),
r AS (SELECT *, j * {W} + i AS c FROM n UNION SELECT n.*, r.c FROM r JOIN n ON n.step = r.step AND n.name = r.name AND ((n.j = r.j AND (n.i = (r.i + 1) % {W} OR r.i = (n.i + 1) % {W})) OR (n.i = r.i AND abs(n.j - r.j) = 1))),
lb AS (SELECT step, name, j, i, min(c) AS region FROM r GROUP BY ALL) SELECT step, name, CAST(region AS BIGINT) AS region, count(*) AS cells, round(sum({_AREA.format("j")}), 3) AS km2, sum({_AREA.format("j")}) < 1500000 AS minor FROM lb GROUP BY ALL""")
def step_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each name on dry land at each change year, those of a small area marked minor."""
    held = drawn(spark, sf_dir).join(stored(dry_cells(spark, sf_dir), "dry"), ["j", "i"], "left_semi")
    pieces = cells.regions(held, ["step", "name"], W).groupBy("step", "name", "region").agg(F.count(F.lit(1)).alias("cells"), F.sum(grid.km2(F.col("j"), H, W)).alias("km2"))
    return pieces.select("step", "name", "region", "cells", F.round("km2", 3).alias("km2"), (F.col("km2") < 1_500_000).alias("minor"))


_PARTS = f"""pc{CELLS.split(", pc", 1)[1]}, dr AS (SELECT DISTINCT CAST(step AS INT) AS step, name, CAST(j AS INT) AS j, CAST(i AS INT) AS i FROM pc, st WHERE first <= year AND year <= last), {LAKES}, dy AS (SELECT DISTINCT CAST(o_orderkey % {H - 4} + 2 AS INT) AS j, CAST(o_orderkey // 50 % {W} AS INT) AS i FROM orders),
n2 AS (SELECT dr.step, dr.name, coalesce(outer_unit, dr.name) AS outer_unit, dr.j, dr.i FROM dr SEMI JOIN (SELECT * FROM dy WHERE (j, i) NOT IN (SELECT (j, i) FROM lk)) d USING (j, i) LEFT JOIN ou ON ou.step = dr.step AND ou.name = dr.name), n3 AS (SELECT DISTINCT step, outer_unit, j, i FROM n2),
r AS (SELECT *, j * {W} + i AS c FROM n3 UNION SELECT n3.*, r.c FROM r JOIN n3 ON n3.step = r.step AND n3.outer_unit = r.outer_unit AND ((n3.j = r.j AND (n3.i = (r.i + 1) % {W} OR r.i = (n3.i + 1) % {W})) OR (n3.i = r.i AND abs(n3.j - r.j) = 1))),
lb AS (SELECT step, outer_unit, j, i, min(c) AS region FROM r GROUP BY ALL), sz AS (SELECT step, outer_unit, region, sum({_AREA.format("j")}) < 1500000 AS minor FROM lb GROUP BY ALL)"""


@query("GE16 GE17", f"""{_UNDER}, {_PARTS}
SELECT CAST(step AS INT) AS step, name, outer_unit, minor, count(*) AS cells FROM n2 JOIN lb USING (step, outer_unit, j, i) JOIN sz USING (step, outer_unit, region) GROUP BY ALL""")
def step_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each name on dry land at each change year, by pieces of its outer unit that are minor or not."""
    held = drawn(spark, sf_dir).join(stored(dry_cells(spark, sf_dir), "dry"), ["j", "i"], "left_semi").select("step", "name", "j", "i")
    got = steps.parts_of_units(held, stored(_outer(spark, sf_dir), "outer"), 1_500_000.0, H, W)
    return got.groupBy("step", "name", F.col("outer").alias("outer_unit"), "minor").agg(F.count(F.lit(1)).alias("cells"))


@query("WN17", f"""{_DRAWN}, v AS (SELECT *, j - row_number() OVER (PARTITION BY step, name, i ORDER BY j) AS g FROM dr), t AS (SELECT step, name, i, min(j) AS a, max(j) AS b FROM v GROUP BY step, name, i, g HAVING count(*) >= 3),
s AS (SELECT step, name, i, unnest(range(a, b - 1)) AS r FROM t), w AS (SELECT *, i - row_number() OVER (PARTITION BY step, name, r ORDER BY i) AS g FROM s), b AS (SELECT step, name, r, min(i) AS first, max(i) + 1 AS e, count(*) AS length FROM w GROUP BY step, name, r, g),
l AS (SELECT step, name, r, arg_max((length, first, e), (length, -first)) AS x, max(length) AS n FROM b GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY step, name) AS top FROM l), p2 AS (SELECT step, name, min(j) AS low FROM dr GROUP BY ALL)
SELECT step, name, CAST(x[1] AS BIGINT) AS length, CAST("row" AS BIGINT) AS "row", CAST(x[2] AS BIGINT) AS first, CAST(x[3] AS BIGINT) AS "end" FROM (SELECT step, name, arg_min(x, (abs(r + 1.5 - low - 4), r)) AS x, arg_min(r, (abs(r + 1.5 - low - 4), r)) AS "row" FROM m JOIN p2 USING (step, name) WHERE n >= top * 0.97 GROUP BY step, name)""")
def step_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest straight band three rows high in each name's land at each change year, near the fourth row of it."""
    held = drawn(spark, sf_dir)
    low = held.groupBy("step", "name").agg((F.min("j") + 4).alias("middle"))
    return cells.straight_bands(held.join(low, ["step", "name"]), ["step", "name"], 3, "middle", H)


_POCKET = f"least(abs(o.i - a.i), {W} - abs(o.i - a.i))"


@query("GE5", f"""{_HOLD}, em AS (SELECT step, j, i, 'U' || CAST((j // 5 + i // 8) % 4 AS VARCHAR) AS unit, (j + i) % 2 = 0 AS hole FROM al WHERE name IS NULL), ow AS (SELECT step, j, i, name AS id, 'U' || CAST(CAST(substr(name, 2) AS INT) % 4 AS VARCHAR) AS unit FROM hc),
h1 AS (SELECT a.step, a.j, a.i, arg_min(o.id, ((o.j - a.j) * (o.j - a.j) + {_POCKET} * {_POCKET}, o.id)) AS id FROM em a JOIN ow o ON o.step = a.step AND o.unit = a.unit WHERE a.hole GROUP BY ALL),
re AS (SELECT em.* FROM em ANTI JOIN h1 USING (step, j, i)), h2 AS (SELECT a.step, a.j, a.i, arg_min(o.id, ((o.j - a.j) * (o.j - a.j) + {_POCKET} * {_POCKET}, o.id)) AS id FROM re a JOIN ow o ON o.step = a.step GROUP BY ALL)
SELECT CAST(step AS INT) AS step, CAST(j AS INT) AS j, CAST(i AS INT) AS i, id FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)""")
def step_pockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty cells at each change year: holes are filled from their own unit's land, what is left from the nearest holder of that year."""
    held = _holders(spark, sf_dir)
    unit = F.concat(F.lit("U"), F.pmod(F.floor(F.col("j") / 5) + F.floor(F.col("i") / 8), F.lit(4)).cast("string"))
    empty = held.where("name is null").select("step", "j", "i", unit.alias("unit"), (F.pmod(F.col("j") + F.col("i"), F.lit(2)) == 0).alias("hole"))
    own = held.where("name is not null").select("step", "j", "i", F.col("name").alias("id"), F.concat(F.lit("U"), (F.substring("name", 2, 9).cast("int") % 4).cast("string")).alias("unit"))
    return cells.fill_pockets(own, empty, W, ("step",))


@query("IO7", f"""{bind.ctes(p=_P)} SELECT name, c AS chunk, greatest(first - 1800, c * 16) AS s0, least(last - 1800, c * 16 + 15) AS s1, dense_rank() OVER (PARTITION BY c ORDER BY name) - 1 AS name_no FROM p, (SELECT unnest(range(0, 8)) AS c) WHERE first - 1800 <= c * 16 + 15 AND last - 1800 >= c * 16""")
def step_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements cut to chunks of sixteen steps, names numbered in each."""
    from meridia.sources.tables import chunked

    rows = bind.frame(spark, sf_dir, _P).select("name", (F.col("first") - 1800).cast("long").alias("s0"), (F.col("last") - 1800).cast("long").alias("s1"))
    return chunked(rows, 16).withColumn("name_no", F.col("name_no").cast("long"))


_IDLE = f"""{YEARS}, {_HELD}, z AS (SELECT count(*) AS z FROM st), k AS (SELECT row_id AS ord, row_id % z AS y0, row_id % z + 3 AS y1, 'P' || CAST((row_id * 3 % 50) AS STRING) AS name FROM p, z),
x AS (SELECT ord, st.step FROM k, st WHERE st.step >= y0 AND st.step <= y1 AND NOT EXISTS (SELECT 1 FROM hd WHERE hd.step = st.step AND hd.name = k.name)) SELECT ord, CAST(count(*) AS BIGINT) AS idle_steps, CAST(min(step) AS INT) AS first FROM x GROUP BY ord"""


@query("AG26", _IDLE)
def step_idle_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections, one for each row, that change nothing in steps of their range."""
    years = changes(spark, sf_dir)
    n = years.count()
    k = bind.frame(spark, sf_dir, _P).select(F.col("row_id").alias("ord"), (F.col("row_id") % n).cast("int").alias("y0"), F.concat(F.lit("P"), (F.col("row_id") * 3 % 50).cast("string")).alias("name"))
    due = k.withColumn("step", F.explode(F.sequence("y0", F.least(F.col("y0") + 3, F.lit(n - 1)))))
    return due.join(_held(spark, sf_dir, years).select("step", "name"), ["step", "name"], "left_anti").groupBy("ord").agg(F.count(F.lit(1)).alias("idle_steps"), F.min("step").alias("first"))


@query("AG26", _IDLE)
def step_idle_corrections_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of step_idle_corrections."""
    return step_idle_corrections(spark, sf_dir)
