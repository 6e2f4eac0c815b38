"""Coverage of tiles, and picks under shared caps, against plain twins."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators import coverage, picks

AXES = np.array(geo.FACES, float)


def direction(lon, lat):
    a, b = math.radians(lon), math.radians(lat)
    return np.array([math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)])


def plain_discs(discs, levels, mesh):
    out = set()
    for level in range(levels + 1):
        n = 1 << level
        steps = np.arange(mesh) / (mesh - 1)
        for face in range(6):
            for x in range(n):
                for y in range(n):
                    a, b = np.meshgrid(np.tan(((x + steps) / n - 0.5) * math.pi / 2), np.tan(((y + steps) / n - 0.5) * math.pi / 2))
                    p = AXES[face][0] + a[..., None] * AXES[face][1] + b[..., None] * AXES[face][2]
                    p /= np.linalg.norm(p, axis=-1, keepdims=True)
                    for lon, lat, radii in discs:
                        if lon is None or radii is None or level >= len(radii) or radii[level] is None:
                            continue
                        u = direction(lon, lat)
                        far = 2 * geo.EARTH_KM * np.arcsin(np.minimum(1, np.linalg.norm(p - u, axis=-1) / 2))
                        w = AXES[face] @ u
                        own = max(range(6), key=lambda f: (round(AXES[f][0] @ u, 12), -f)) == face
                        here = own and all(math.floor((0.5 + 2 / math.pi * math.atan(c / w[0])) * n) == k for c, k in zip(w[1:], (x, y), strict=True))
                        if here or (far <= radii[level]).any():
                            out.add((face, level, x, y))
    return out


def rows_of(df):
    return [tuple(r[c] for c in coverage.TILE) for r in df.collect()]


def test_discs_reach_the_tiles_of_a_plain_search(spark):
    r = random.Random(5)
    discs = [(r.uniform(-180, 180), r.uniform(-85, 85), [None, 400.0, r.uniform(50, 2500), r.uniform(1, 900)]) for _ in range(6)]
    discs += [(12.3, 89.7, [1.0, 3000.0, None, 700.0]), (44.0, 1.0, [None, None, 30_000.0, 0.001]), (179.9, 10.0, [5.0]), (None, 1.0, [9e4] * 4), (1.0, 2.0, None), (3.0, 50.0, [])]
    df = spark.createDataFrame(discs, "lon double, lat double, radii array<double>").withColumn("face", F.lit(9)).withColumn("u", F.lit("clash"))
    got = rows_of(coverage.by_discs(df.unionByName(df), 3, 5))
    assert len(got) == len(set(got)) and set(got) == plain_discs(discs, 3, 5)
    assert coverage.by_discs(df.limit(0), 2).count() == 0


def test_cells_reach_tiles_over_the_edges_of_faces(spark):
    r = random.Random(6)
    points = [(r.uniform(-180, 180), r.uniform(-90, 90)) for _ in range(150)] + [(45.0, 0.0), (-45.01, 35.0), (0.0, 90.0), (44.9, 35.26), (None, 3.0)]
    reach, want = 0.1, set()
    for lon, lat in points:
        if lon is None:
            continue
        for face in range(6):
            w = AXES[face] @ direction(lon, lat)
            if w[0] <= 0:
                continue
            s, t = (0.5 + 2 / math.pi * math.atan(c / w[0]) for c in w[1:])
            for level in range(4):
                n = 1 << level
                want |= {(face, level, x, y) for x in range(n) for y in range(n) if x - reach <= s * n <= x + 1 + reach and y - reach <= t * n <= y + 1 + reach}
    df = spark.createDataFrame(points, "lon double, lat double").withColumn("level", F.lit("clash"))
    got = rows_of(coverage.by_cells(df, 3, reach))
    assert len(got) == len(set(got)) and set(got) == want
    assert coverage.by_cells(df.limit(0), 3, reach).count() == 0


def test_coverage_is_closed_upward(spark):
    wanted = [(0, 1, 0, 0), (0, 2, 0, 1), (0, 2, 3, 3), (0, 3, 1, 3), (0, 3, 7, 7), (1, 2, 1, 1), (0, 2, 0, 1)]
    df = spark.createDataFrame(wanted, "face int, level int, x int, y int")
    got = set(rows_of(coverage.grow(spark, 3, 1, df)))
    assert {t for t in got if t[1] == 0} == {(f, 0, 0, 0) for f in range(6)}
    assert {t for t in got if t[1]} == {(0, 1, 0, 0), (0, 2, 0, 1), (0, 3, 1, 3)}  # children of tiles not kept are left out
    kept = spark.createDataFrame(sorted(got), "face int, level int, x int, y int")
    assert coverage.without_parent(kept).count() == 0
    assert set(rows_of(coverage.without_parent(df))) == {(0, 1, 0, 0), (0, 2, 3, 3), (1, 2, 1, 1)}  # level 0 is not there, nor 1 over 3, 3
    within = df.where("level = 3 or x = 3")
    assert {t for t in rows_of(coverage.grow(spark, 3, 2, df, within, 3)) if t[1] > 1} == {(0, 2, 0, 1), (0, 2, 3, 3), (1, 2, 1, 1), (0, 3, 1, 3), (0, 3, 7, 7)}


def test_faults_of_bounds(spark):
    schema = "face int, level int, x int, y int, low long, high long"
    bounds = spark.createDataFrame([(0, 0, 0, 0, -10, 50), (0, 1, 0, 0, -5, 60), (0, 1, 1, 0, 3, 2), (0, 1, 1, 1, 0, 1), (0, 1, 1, 1, 0, 1), (2, 0, 0, 0, 0, 1), (3, 0, 0, 0, None, 1)], schema)
    available = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 0), (0, 1, 1, 0), (0, 1, 1, 1), (0, 1, 0, 1), (3, 0, 0, 0)], "face int, level int, x int, y int")
    heights = spark.createDataFrame([(0, 0, 0, 0, -9.5, 49.5), (0, 1, 0, 0, -4.0, 60.0)], "face int, level int, x int, y int, low double, high double")
    got = {tuple(r) for r in coverage.bound_faults(bounds, available, heights).collect()}
    assert got == {(0, 1, 0, 0, "range"), (0, 1, 0, 0, "parent"), (0, 1, 1, 0, "empty"), (0, 1, 1, 1, "repeated"), (0, 1, 0, 1, "absent"), (2, 0, 0, 0, "unavailable"), (3, 0, 0, 0, "empty")}
    assert coverage.bound_faults(bounds.limit(0), available.limit(0)).count() == 0


@pytest.mark.parametrize("slots", [40, 1000])
def test_names_under_shared_caps_equal_sequential_admission(spark, monkeypatch, slots):
    monkeypatch.setattr(picks, "BATCH", 9)
    r = random.Random(8)
    names = [(v, i, r.randint(0, 5), [(r.uniform(-30, 330), r.uniform(-30, 230), r.uniform(2, 30)) for _ in range(r.randint(1, 3))]) for v in range(2) for i in range(70)]
    want = set()
    for v in range(2):
        counts, used = {}, 0
        for _, i, _, discs in sorted((n for n in names if n[0] == v), key=lambda n: (n[2], n[1])):
            tiles = {(tx, ty) for x, y, d in discs for tx in range(6) for ty in range(4) if (min(max(x, tx * 50), tx * 50 + 50) - x) ** 2 + (min(max(y, ty * 50), ty * 50 + 50) - y) ** 2 <= (d * 1.5) ** 2}
            if tiles and used + len(tiles) <= slots and all(counts.get(t, 0) < 3 for t in tiles):
                used += len(tiles)
                counts |= {t: counts.get(t, 0) + 1 for t in tiles}
                want.add((v, i, tuple(sorted(ty * 6 + tx for tx, ty in tiles))))
    schema = "view int, id int, rank int, discs array<struct<x:double,y:double,r:double>>"
    df = spark.createDataFrame([*names, (0, None, 1, [(1.0, 1.0, 5.0)]), (1, 500, 1, []), (1, 501, 1, None)], schema)
    assert {(x["view"], x["id"], tuple(x["tiles"])) for x in picks.capped(df, 50, 6, 4, 3, slots, 1.5).collect()} == want
    assert picks.capped(df.limit(0), 50, 6, 4, 3, slots).count() == 0


def test_families_open_and_give_way(spark):
    """1 over 2 over 3; 4 alone. View 0: all closed; view 1: 1 opens; view 2: 1 between the bounds stays open, 2 opens too, 1 off screen."""
    rows = []
    for view, sizes, off in ((0, (10.0, 10.0), ()), (1, (90.0, 10.0), ()), (2, (50.0, 90.0), (1,)), (3, (20.0, None), ())):
        for i in (1, 2, 3, 4):
            size = sizes[i - 1] if i < 3 else None
            rows.append((view, i, 10 * i, 200.0 * i, 10.0, size, i not in off, False, view == 0 and i == 3))
    df = spark.createDataFrame(rows, "view long, id long, score int, px double, py double, size double, seen boolean, incumbent boolean, focal boolean")
    lineage = spark.createDataFrame([(2, 1), (3, 2), (3, 1)], "node long, ancestor long")
    got = {}
    for r in picks.families(df, lineage, 80.0, 40.0, 160, (1, 9), (1, 2)).collect():
        got.setdefault(r["view"], set()).add((r["id"], r["role"], r["label"]))
    assert got[0] == {(1, "marker", False), (4, "marker", True), (3, "marker", True)} or got[0] == {(1, "marker", True), (4, "marker", True), (3, "marker", True)}
    assert {(i, k) for i, k, _ in got[1]} == {(2, "marker"), (4, "marker"), (1, "context")} and sum(x[2] for x in got[1]) == 2
    assert {(i, k) for i, k, _ in got[2]} == {(3, "marker"), (4, "marker"), (1, "context"), (2, "context")} and not {x[0] for x in got[2] if x[2]} & {1}
    assert {(i, k) for i, k, _ in got[3]} == {(1, "marker"), (4, "marker")}
    assert picks.families(df.limit(0), lineage, 80.0, 40.0, 160, (1, 9), (1, 2)).count() == 0
