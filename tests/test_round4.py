"""What the fourth round's findings found, on small tables."""

from __future__ import annotations

import math
import random
import re

import duckdb
from pyspark.sql import functions as F

from meridia import registry, shared
from meridia.functions import geo
from meridia.operators import joins, picks, steps

registry.load()


def from_sql(name: str, folder, tables: tuple[str, ...]) -> list[dict]:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    res = con.execute(registry.SQL[name])
    names = [c[0] for c in res.description]
    return [dict(zip(names, r, strict=True)) for r in res.fetchall()]


def write(sql: str, folder, name: str) -> None:
    duckdb.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")


def test_cube_tiles_on_borders_are_those_of_the_sql(spark, tmp_path):
    # Longitudes that are multiples of 11.25 degrees lie on borders of tiles, 4500 on that of two faces.
    write("SELECT k AS p_partkey, 'p' AS p_name, 'b' AS p_brand, CAST(1 AS INTEGER) AS p_size FROM (SELECT unnest([0, 3375, 4500, 5625, 6750, 8900, 9000, 14625, 15750, 16875, 18000]) AS k)", tmp_path, "part")
    got = {r["qid"]: r.asDict() for r in registry.QUERIES["sc_cube"](spark, str(tmp_path)).collect()}
    want = {r["qid"]: r for r in from_sql("sc_cube", tmp_path, ("part",))}
    assert got == want and (got[4500]["node"], got[14625]["node"]) == (862, 1100)


def test_atan_is_the_nearest_double(spark):
    r = random.Random(4)
    xs = [0.0, 1.0, -1.0, 1e-9, *[r.uniform(-1, 1) for _ in range(2000)]]
    got = [x["a"] for x in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(geo.atan("x").alias("a")).collect()]
    assert sum(a != math.atan(x) for a, x in zip(got, xs, strict=True)) <= 20 and all(math.isclose(a, math.atan(x), rel_tol=3e-16) for a, x in zip(got, xs, strict=True))
    assert spark.range(1).select(geo.atan(F.lit(None).cast("double")).alias("a")).first()["a"] is None


def plans(monkeypatch, *modules) -> list[str]:
    """Physical plans of what modules store from now on."""
    out: list[str] = []
    for module in modules:
        kept = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, kept=kept: (out.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    return out


HOLE = "hole long, step int, ord int, lon double, lat double, clon double, clat double, km2 double, states array<string>, lake boolean"


def test_tracks_broadcast_no_side_for_the_size_of_its_files(spark, monkeypatch):
    # A few MB of files can be a million holes, which the driver can't hold as one broadcast.
    seen = plans(monkeypatch, steps)
    holes = spark.createDataFrame([(k, k % 3, k, float(k % 5), float(k % 2), 1.0, 1.0, float(k), ["East"], False) for k in range(30)], HOLE)
    ends = spark.createDataFrame([(s, 1800 + s, 1800 + s) for s in range(3)], "step int, year int, until int")
    out = steps.owed_holes(steps.stored(holes, "holes"), steps.stored(ends, "ends"), 2.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in p for p in seen) and not any("BroadcastHashJoin" in p for p in seen)
    assert plan.count("BroadcastHashJoin") == plan.count("BroadcastHashJoin [step") > 0  # the steps, which were counted


def test_picks_broadcast_only_what_was_counted(spark, monkeypatch):
    seen = plans(monkeypatch, picks, joins)
    lineage = joins.closure(spark.createDataFrame([(k, k // 3) for k in range(1, 40)], "child long, parent long"))
    assert not any("BroadcastHashJoin" in p for p in seen)
    rows = [(f, k, k * 7 % 10, False, k % 2 == 0, k % 9, 0, float(k * 9 % 100), float(k % 50)) for f in (1, 2) for k in range(40)]
    df = spark.createDataFrame(rows, "frame long, id long, score int, pinned boolean, near boolean, nearness int, used int, lon double, lat double")
    kin = picks.with_kin(picks.stored(df, "given"), lineage)
    assert "BroadcastHashJoin" not in kin._jdf.queryExecution().executedPlan().toString()
    assert picks.choose(kin, 3, 800.0, 8).groupBy("frame").count().collect() == [(1, 3), (2, 3)] or picks.choose(kin, 3, 800.0, 8).count() == 6
    # Frames are counted, and when they are many both sides are shuffled; rows never are broadcast.
    frames = spark.createDataFrame([(f, 10 * f, 10 * f + 5) for f in range(30)], "frame int, w0 int, w1 int")
    events = spark.createDataFrame([(k, k, k + 2) for k in range(300)], "id int, t0 int, t1 int")
    few = picks.near_in_time(frames, picks.stored(events, "rows"), 32, 300)
    assert re.search("BroadcastHashJoin .*, Build(Left|Right)", few._jdf.queryExecution().executedPlan().toString())[0].count("BuildLeft") == 1
    monkeypatch.setattr(picks, "bounded", lambda df, rows=None, most=10: shared.bounded(df, rows, 10))
    many = picks.near_in_time(frames, picks.stored(events, "rows"), 32, 300)
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.select("frame", "id").collect())) == sorted(map(tuple, few.select("frame", "id").collect())) != []


def test_turns_read_one_table_of_uses_each(spark, monkeypatch):
    # Plans must not grow by a table with every turn.
    seen = plans(monkeypatch, picks)
    rows = [(0, t, t, k, k * 7 % 10, False, True, 1, 10 * t, 10 * t, 10 * t + 1, 10 * t - 5, 10 * t + 5, float(k * 9 % 100), float(k % 50)) for t in range(8) for k in range(12)]
    df = spark.createDataFrame(rows, "series long, turn int, frame long, id long, score int, pinned boolean, near boolean, nearness long, day long, first long, last long, w0 long, w1 long, lon double, lat double")
    out = picks.in_turn(picks.with_kin(df, spark.createDataFrame([], "node long, ancestor long")), 2, 500.0, 8)
    assert out.count() == 16
    assert max(p.count("FileScan") for p in [*seen, out._jdf.queryExecution().executedPlan().toString()]) <= 4


def test_near_pairs_cost_a_dot_product(spark):
    r = random.Random(6)
    pts = spark.createDataFrame([(i, r.uniform(-180, 180), r.choice([r.uniform(-90, 90), r.uniform(80, 90), 0.0])) for i in range(120)] + [(120, None, 1.0), (121, 0.0, 0.0), (122, 180.0, 0.0), (123, 0.0, 0.0)], "a long, lon double, lat double")
    other = pts.withColumnRenamed("a", "b")
    both = pts.dropna().crossJoin(other.dropna().select("b", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))).select("a", "b", geo.great_circle_km("lon", "lat", "lon2", "lat2").alias("km"))
    want = {(x["a"], x["b"]): x["km"] for x in both.where("km is not null").collect()}
    for km in (0.0, 1e-4, sorted(want.values())[1500], 1500.0, 12000.0, 25000.0):  # the third is the distance of a pair to the last bit
        got = {(x["a"], x["b"]): x["km"] for x in joins.near_join(pts, other, km).collect()}
        assert got == {k: v for k, v in want.items() if v <= km}
    plan = joins.near_join(pts, other, 1500.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "COS(" not in plan[: plan.index("Join")] + next(x for x in plan.splitlines() if "Join" in x)  # no cosines per pair


def test_distances_are_rounded_as_the_sql_does(spark):
    r = random.Random(7)
    xs = [0.0, 0.000005, 1.000005, 123.456785, 1499.999995, 0.49999999999999994e-5, *[k / 1e6 + 5e-6 for k in range(0, 3000, 10)], *[r.uniform(0, 20000) for _ in range(500)]]
    got = [x["v"] for x in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(geo.half_up("x", 5).alias("v")).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 5)", [x]).fetchall()[0][0] for x in xs]


def test_interval_pairs_equal_the_join_and_come_in_lots(spark):
    r = random.Random(8)
    span = lambda n: [(k if k % 7 else None, d, d + r.choice([0, 3, 3, 900])) for k in range(n) for d in [r.choice([5, 6, 40, 400])]]
    a = spark.createDataFrame([*span(90), (91, None, 4), (92, 9, 2)], "k long, a0 long, a1 long")
    b = spark.createDataFrame([*span(70), (71, 4, None)], "f long, b0 long, b1 long")
    args = a, b, "a0", "a1", "b0", "b1", 4
    want = sorted(map(str, joins.interval_join(*args).select("k", "f").collect()))
    for lot in (512, 3):
        assert sorted(map(str, joins.interval_pairs(*args, "k", "f", lot).collect())) == want
    # A key stands beside all keys of a lot, then the next key beside the same ones in the same order.
    one = joins.interval_pairs(spark.range(6).selectExpr("id AS k", "1 AS a0", "2 AS a1"), spark.range(5).selectExpr("id AS f", "2 AS b0", "3 AS b1"), "a0", "a1", "b0", "b1", 4, "k", "f").collect()
    assert [x["f"] for x in one] == 6 * [x["f"] for x in one[:5]] and [x["k"] for x in one[::5]] == [x["k"] for x in one[4::5]]
    query = registry.QUERIES["jn_interval"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= query.index("Generate explode(_rs") < query.index("Join Inner")
