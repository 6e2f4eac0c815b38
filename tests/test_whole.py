"""Queries over whole tables beside those whose SQL cuts them, against their SQL on the given tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from meridia import registry
from meridia.operators import cells

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()
WHOLE = [n for n in ("step_runs_changes", "step_carried_changes", "step_review", "audit_shore_runs", "cell_shore_band", "step_corrected", "step_unresolved", "step_carried_units", "io_routes", "io_route_faults", "io_release", "io_pages", "io_climate", "io_manifest", "pick_months", "sc_calendars", "sc_precision_spans", "event_forced", "cell_border_distance", "route_positions", "step_idle_corrections_changes", "jn_nearest_in_time_whole", "jn_interval_whole", "jn_asof_whole", "sc_great_circle_whole", "grid_presence_whole", "cell_nearest_fill_whole", "audit_tile_borders") if os.path.isdir(SF)]


def both(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    plain = lambda r: tuple(round(x, 4) + 0.0 if isinstance(x, float) else x for x in r)
    res = con.execute(f"SELECT {', '.join(f'"{c}"' for c in df.columns)} FROM ({registry.SQL[name]})")
    return sorted(map(plain, df.collect()), key=repr), sorted(map(plain, res.fetchall()), key=repr)


@pytest.mark.parametrize("name", WHOLE)
def test_whole_query_matches_sql(spark, name):
    registry.load()
    got, want = both(spark, name)
    assert got and got == want


@pytest.mark.skipif(not WHOLE, reason="needs the given tables")
def test_change_steps_see_every_polity(spark):
    registry.load()
    years = registry.QUERIES["step_years"](spark, SF).select("year").collect()
    spans = spark.read.parquet(f"{SF}/supplier.parquet").selectExpr("1800 + s_suppkey * 17 % 60 AS a", "1800 + s_suppkey * 17 % 60 + s_suppkey * 7 % 30 AS b").collect()
    assert all(any(a <= y[0] <= b for y in years) for a, b in spans)
    last = max(r["last"] for r in registry.QUERIES["step_runs_changes"](spark, SF).collect())
    assert last > 14


@pytest.mark.skipif(not WHOLE, reason="needs the given tables")
def test_whole_queries_take_every_row(spark):
    registry.load()
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in TABLES}
    run = lambda name: registry.QUERIES[name](spark, SF)
    assert run("jn_nearest_in_time_whole").count() == n["orders"] and run("sc_great_circle_whole").count() == n["customer"]
    assert run("grid_presence_whole").agg({"bits": "sum"}).first()[0] == spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").distinct().count()


def test_nearest_fill_reaches_every_cell(spark):
    """A holder at distance 4 beats one at 4.24 in the square of 3, far cells are filled, and units keep apart."""
    cols, rows = 40, 30
    held = [("a", 3, 3, "P1"), ("a", 4, 0, "P9"), ("b", 29, 39, "P5"), ("b", 29, 37, "P4")]
    empty = [(u, j, i) for u in "abc" for j in range(rows) for i in range(cols) if (u, j, i) not in {h[:3] for h in held}]
    got = cells.nearest_fill_all(spark.createDataFrame(held, "unit string, j int, i int, id string"), spark.createDataFrame(empty, "unit string, j int, i int"), cols, ("unit",))
    want = {}
    for u, j, i in empty:
        near = [((j - y) ** 2 + min(abs(i - x), cols - abs(i - x)) ** 2, n) for v, y, x, n in held if v == u]
        if near:
            want[u, j, i] = min(near)[1]
    out = [tuple(r) for r in got.select("unit", "j", "i", "id").collect()]
    assert len(out) == len(want) and {r[:3]: r[3] for r in out} == want and want["a", 0, 0] == "P9"


@pytest.mark.skipif(not WHOLE, reason="needs the given tables")
def test_pockets_are_filled_at_every_change_year(spark):
    registry.load()
    n = registry.QUERIES["step_years"](spark, SF).count()
    filled = registry.QUERIES["step_pockets"](spark, SF)
    assert filled.select("step").distinct().count() > n // 2 and filled.groupBy("step", "j", "i").count().where("count > 1").count() == 0


def test_border_mismatches_to_both_sides(spark):
    from meridia.operators import audits

    rows = [(2 * r + c, r, c, j, i, 10 * (2 * r + j) + 2 * c + i) for r in (0, 1) for c in (0, 1) for j in range(3) for i in range(3)]
    changed = {(2, 0, 1): 99, (1, 1, 0): 98}  # tile 2 on its south border with tile 0, tile 1 on its west border with tile 0
    rows = [(t, r, c, j, i, changed.get((t, j, i), v)) for t, r, c, j, i, v in rows]
    got = audits.border_mismatches(spark.createDataFrame(rows, "tile int, row int, col int, j int, i int, value int"), 3)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1), (0, 2, 1)]
