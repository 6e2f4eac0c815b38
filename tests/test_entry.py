"""Queries against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from meridia import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["event_index", "event_rows", "event_overview", "event_roll_up", "jn_interval", "jn_asof", "jn_within_radius", "pick_viewport", "pick_changes", "cell_settled", "cell_signed_distance", "step_carried", "grid_quantised", "route_box", "triple_export", "audit_pages", "io_statements", "io_features"]


def plain(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.mark.parametrize("name", SOME)
@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(cols).collect()), key=repr)
    res = con.execute(registry.SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = sorted((plain(tuple(r[names.index(c)] for c in cols)) for r in res.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
