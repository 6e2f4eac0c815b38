"""Operators that SQL cannot check, against sequential twins, and plans of the join helpers."""

from __future__ import annotations

import json
import math
import random
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators import audits, cells, evolving, events, grid, joins, picks, steps
from meridia.operators.graph import components
from meridia.sources import tables


def km(a, b):
    h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0088 * asin(sqrt(min(1, h)))


def test_spaced_equals_greedy(spark):
    r = random.Random(3)
    rows = [(i, r.randint(0, 40), r.uniform(-180, 180), r.uniform(-89, 89)) for i in range(300)]
    taken = []
    for row in sorted(rows, key=lambda x: (-x[1], x[0])):
        if all(km(row[2:], t[2:]) >= 1500 for t in taken):
            taken.append(row)
    got = picks.spaced(spark.createDataFrame(rows, "id long, score int, lon double, lat double"), 1500.0, 25)
    assert [x["id"] for x in got.collect()] == [t[0] for t in taken[:25]]


def test_display_parents_equal_sequential(spark):
    r = random.Random(5)
    cands = {c: [r.randint(0, 29) for _ in range(3)] for c in range(30)}
    chosen: dict[int, int] = {}
    for c in sorted(cands):
        for p in cands[c]:
            at, seen = p, set()
            while at in chosen and at != c and at not in seen:
                seen.add(at)
                at = chosen[at]
            if p != c and at != c:
                chosen[c] = p
                break
    rows = [(c, p, k) for c, ps in cands.items() for k, p in enumerate(ps)]
    got = {x["child"]: x["parent"] for x in events.display_parents(spark.createDataFrame(rows, "child long, parent long, rank int")).collect()}
    assert got == chosen


def test_components_of_chains_and_stars(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(200) if i % 17] + [(500, r.randint(501, 600)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_interval_join_has_no_nested_loop(spark):
    a = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("a0"), (F.col("id") + 5).alias("a1"))
    b = spark.range(100).select(F.col("id").alias("m"), F.col("id").alias("b0"), (F.col("id") + 2).alias("b1"))
    out = joins.interval_join(a, b, "a0", "a1", "b0", "b1", 4)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    want = sum(1 for x in range(100) for y in range(100) if x <= y + 2 and y <= x + 5)
    assert out.count() == want


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("x", 5), ("x", 1), ("y", 9), ("z", 4)], "k string, at int")
    right = spark.createDataFrame([("x", 2, 20), ("x", 5, 50), ("y", 10, 100)], "k string, at int, v int")
    got = {(r["k"], r["at"]): r["v"] for r in joins.asof_join(left, right, ["k"], "at", ["v"]).collect()}
    assert got == {("x", 5): 50, ("x", 1): None, ("y", 9): None, ("z", 4): None}


def test_near_join_over_the_seam_and_poles(spark):
    r = random.Random(9)
    pts = [(i, r.uniform(-180, 180), r.choice([r.uniform(-90, 90), r.uniform(84, 90)])) for i in range(150)]
    df = spark.createDataFrame(pts, "a long, lon double, lat double")
    got = {(x["a"], x["b"]) for x in joins.near_join(df, df.withColumnRenamed("a", "b"), 1200.0).collect()}
    assert got == {(p[0], q[0]) for p in pts for q in pts if km(p[1:], q[1:]) <= 1200}


def test_global_rank_is_total(spark):
    df = spark.range(500).select("id", (F.col("id") * 7 % 50).alias("s"))
    got = joins.global_rank(df, [F.col("s").desc(), F.col("id")], "row").orderBy("row").collect()
    assert [x["row"] for x in got] == list(range(500))
    assert [(x["s"], x["id"]) for x in got] == sorted(((x["s"], x["id"]) for x in got), key=lambda x: (-x[0], x[1]))


def test_carried_counts_years_from_the_runs_first_step(spark):
    years = spark.createDataFrame([(k, 1800 + 5 * k) for k in range(9)], "step int, year int")
    names = {(0, 0): "AAnnnAAAA", (0, 1): "AAnnnnnnA", (0, 2): "AnBnnBnnA"}
    rows = [(k, j, i, None if s[k] == "n" else s[k]) for (j, i), s in names.items() for k in range(9)]
    held = spark.createDataFrame(rows, "step int, j int, i int, name string")
    got = {(x["step"], x["i"], x["name"]) for x in steps.carried(held, years, 10).collect()}
    assert got == {(2, 0, "A"), (3, 0, "A"), (4, 0, "A"), (2, 1, "A"), (3, 1, "A"), (4, 1, "A"), (3, 2, "B"), (4, 2, "B")}


def test_pieces_given_by_a_cell(spark):
    rows = [(0, "A", 0, i) for i in (1, 2, 3)] + [(0, "A", 5, i) for i in (7, 8)]
    got = steps.corrected(spark.createDataFrame(rows, "step int, name string, j int, i int"), [{"kind": "pocket", "name": "A", "to": "B", "y0": 0, "y1": 0, "at": (5, 7)}], 20)
    assert {(x["name"], x["j"], x["i"]) for x in got.collect()} == {("A", 0, 1), ("A", 0, 2), ("A", 0, 3), ("B", 5, 7), ("B", 5, 8)}


def test_regions_wrap(spark):
    rows = [(0, 0), (0, 9), (1, 9), (4, 4)]
    got = {(x["j"], x["i"]): x["region"] for x in cells.regions(spark.createDataFrame(rows, "j int, i int"), [], 10).collect()}
    assert got == {(0, 0): 0, (0, 9): 0, (1, 9): 0, (4, 4): 44}


def test_planted_route_faults_are_caught(spark):
    rows = [(1, 0, 0.0, 0.0, 5), (1, 1, 190.0, 0.0, 6), (1, 2, 10.0, 5.0, 4), (1, 4, 11.0, 5.0, 9), (2, 0, 0.0, 10.0, 1), (2, 1, 180.0, -10.0, 2)]
    got = {(x["route"], x["idx"]): x["fault"] for x in audits.route_faults(spark.createDataFrame(rows, "route int, idx int, lon double, lat double, day long")).collect()}
    assert got == {(1, 1): "place", (1, 2): "backward", (1, 4): "gap", (2, 1): "opposite"}


CANDIDATE = "series long, turn int, frame long, id long, score int, pinned boolean, near boolean, nearness long, day long, first long, last long, w0 long, w1 long, lon double, lat double"


def greedy(rows, n, apart, reach, used, above, taken=()):
    """One frame's picks in order, one after the other; rows and results are dicts."""
    clash = lambda r, t: r["id"] == t["id"] or r["id"] in above[t["id"]] or t["id"] in above[r["id"]] or km((r["lon"], r["lat"]), (t["lon"], t["lat"])) < apart
    out = list(taken) or sorted((r for r in rows if r["pinned"]), key=lambda r: (-r["score"], r["id"]))
    early = sorted((r for r in rows if r["near"]), key=lambda r: (-r["score"], r["id"]))
    rest = sorted((r for r in rows if not r["near"]), key=lambda r: (r["nearness"], -r["score"], r["id"]))
    early += [r for r in rest if r["nearness"] <= reach]
    for tier in (early, [r for r in rest if r["nearness"] > reach]):
        for most in sorted({0, *used.values()}):
            for r in tier:
                if len(out) < n and used.get(r["id"], 0) <= most and not any(clash(r, t) for t in out):
                    out.append(r)
    return out


def test_picks_equal_sequential_ones(spark):
    r = random.Random(11)
    parent = {i: (i // 3 if i else None) for i in range(60)}
    above = {}
    for i in parent:
        above[i], at = set(), parent[i]
        while at is not None:
            above[i].add(at)
            at = parent[at] if at else None
    place = {i: (r.uniform(-60, 60), r.uniform(-40, 40)) for i in parent}
    rows = []
    for series in (1, 2):
        for turn in range(4):
            frame, day = 100 * series + turn, 50 * turn
            for i in sorted(r.sample(range(60), 25)):
                first = day + r.randint(-90, 90)
                middle = first + 2
                near = first <= day + 10 and first + 4 >= day - 10
                rows.append((series, turn, frame, i, r.randint(0, 9), near and i % 20 == 7, near, abs(middle - day), day, first, first + 4, day - 40, day + 40, *place[i]))
    df = spark.createDataFrame(rows, CANDIDATE)
    lineage = spark.createDataFrame([(i, a) for i, x in above.items() for a in x], "node long, ancestor long")
    names = df.columns
    by = {}
    for x in rows:
        by.setdefault(x[2], []).append(dict(zip(names, x, strict=True)))
    inside = lambda rs: [x for x in rs if x["first"] <= x["w1"] and x["last"] >= x["w0"]]
    got = {}
    for x in picks.choose(picks.with_kin(df.withColumn("used", F.col("id") % 3), lineage), 4, 900.0, 25).orderBy("frame", "place").collect():
        got.setdefault(x["frame"], []).append(x["id"])
    want = {f: [x["id"] for x in greedy(rs, 4, 900, 25, {x["id"]: x["id"] % 3 for x in rs}, above)] for f, rs in by.items()}
    assert got == want and any(len(x) < 4 for x in want.values()) or got == want
    # In turn, with what the frames before and the next one take, and relaxation.
    sparse = ((500.0, 60), (100.0, 120))
    expected = {}
    for series in (1, 2):
        frames = [by[100 * series + t] for t in range(4)]
        alone = [greedy(inside(rs), 4, 900, 25, {}, above) for rs in frames]
        lists = []
        for t, rs in enumerate(frames):
            shown = {}
            for got_before in lists:
                for x in got_before:
                    if x["near"]:
                        shown[x["id"]] = shown.get(x["id"], 0) + 1
            if t < 3:
                mine = {x["id"]: x for x in rs}
                for x in alone[t + 1]:
                    if x["id"] in mine and (x["pinned"] or x["nearness"] < mine[x["id"]]["nearness"]):
                        shown[x["id"]] = shown.get(x["id"], 0) + 1
            chosen = greedy(inside(rs), 4, 900, 25, shown, above)
            for spacing, wide in sparse:
                if len(chosen) < 4:
                    near_enough = [x for x in rs if x["first"] <= max(x["w1"], x["day"] + wide) and x["last"] >= min(x["w0"], x["day"] - wide)]
                    chosen = greedy(near_enough, 4, spacing, 25, shown, above, chosen)
            lists.append(chosen)
            expected[100 * series + t] = [x["id"] for x in chosen]
    got = {}
    for x in picks.in_turn(picks.with_kin(df, lineage), 4, 900.0, 25, sparse).orderBy("frame", "place").collect():
        got.setdefault(x["frame"], []).append(x["id"])
    assert got == expected
    assert picks.in_turn(picks.with_kin(df.limit(0), lineage), 4, 900.0, 25).count() == 0


def test_spaced_needs_no_pairs_and_several_batches(spark, monkeypatch):
    monkeypatch.setattr(picks, "BATCH", 7)
    r = random.Random(12)
    rows = [(i, r.randint(0, 5), r.uniform(-30, 30), r.uniform(-30, 30)) for i in range(200)]
    taken = []
    for row in sorted(rows, key=lambda x: (-x[1], x[0])):
        if all(km(row[2:], t[2:]) >= 900 for t in taken):
            taken.append(row)
    df = spark.createDataFrame(rows, "id long, score int, lon double, lat double")
    assert [x["id"] for x in picks.spaced(df, 900.0, 15).collect()] == [t[0] for t in taken[:15]]
    assert picks.spaced(df.limit(0), 900.0, 15).count() == 0


def test_labels_equal_sequential_placing(spark, monkeypatch):
    monkeypatch.setattr(picks, "BATCH", 10)
    r = random.Random(13)
    rows = []
    for view in range(3):
        for i in range(120):
            x, y = r.uniform(0, 400 + 600 * view), r.uniform(0, 300)
            rows.append((view, i, r.randint(0, 9), r.random() < 0.3, x, y, x + 60, y + 12))
    want = set()
    for view in range(3):
        placed = []
        for b in sorted((b for b in rows if b[0] == view), key=lambda b: (b[2], b[1])):
            p = 0 if b[3] else 5
            if len(placed) < 20 and all(b[6] + p <= t[4] or t[6] <= b[4] - p or b[7] + p <= t[5] or t[7] <= b[5] - p for t in placed):
                placed.append(b)
        want |= {(b[0], b[1]) for b in placed}
    got = {tuple(x) for x in picks.labels(spark.createDataFrame(rows, "view long, id long, rank int, kept boolean, x0 double, y0 double, x1 double, y1 double"), 20, 5.0).collect()}
    assert got == want


def test_unclaimed_pieces_from_the_map(spark):
    """The facts of each piece, and its rule, against a flood fill at each step; at step 3 the map is empty."""
    r = random.Random(14)
    rows, cols, last = 20, 27, 5
    dry = {(j, i) for j in range(rows) for i in range(cols) if j and r.random() < 0.995}
    lakes = {(j, i) for j in range(5, 9) for i in range(6, 10)}
    dry -= lakes
    held, unit, at = set(), {"A": "U1", "B": "U1", "C": "U2"}, {}
    for step in (0, 1, 2, 4, last):
        for name in unit:
            if not step or name == "C" and step == 2 or name == "B" and step == last:
                at[name] = r.randint(0, 13), r.randint(0, 20)
            j0, i0 = at[name]
            held |= {(step, name, j, i) for j in range(j0, j0 + 7) for i in range(i0, i0 + 7) if (j, i) not in ((j0 + 3, i0 + 3), (j0 + 3, i0 + 4)) and j < rows}
    table = lambda x, schema: spark.createDataFrame(sorted(x), schema)
    spans = steps.merged(table(held, "step int, name string, j int, i int"), ["name", "j", "i"])
    spans = spans.unionByName(spans).unionByName(spark.createDataFrame([("A", 1, 1, None, 9), ("B", 2, 2, 4, 1), ("C", 3, 3, 6, 9)], spans.schema))
    found = evolving.unclaimed(table(dry, "j int, i int"), spans, table(lakes, "j int, i int"), table(unit.items(), "name string, outer string"), last + 1, rows, cols)
    out = steps.classify(found.withColumn("step", F.explode(F.sequence("first", "last"))), 4e6).cache()
    got = {(x["step"], x["region"]): (x["cells"], x["wide"], x["core"], x["lake"], x["coast"], x["states"], x["state"], x["rule"]) for x in out.collect()}
    areas = {(x["step"], x["region"]): x["km2"] for x in out.collect()}
    area = lambda j: 6371.0088**2 * (2 * math.pi / cols) * (sin(radians(-90 + (j + 1) * 180 / rows)) - sin(radians(-90 + j * 180 / rows)))
    want = {}
    around = lambda j, i: [(j + a, (i + b) % cols) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= j + a < rows]
    for step in range(last + 1):
        free = dry - {(j, i) for s, _, j, i in held if s == step}
        own = {}
        for s, n, j, i in held:
            if s == step:
                own.setdefault((j, i), set()).add(unit[n])
        core = set()
        for j, i in free:
            block = [(j + a, (i + b) % cols) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            if all(c in free for c in block):
                core |= set(block)
        left = set(free)
        while left:
            stack, piece = [left.pop()], set()
            while stack:
                j, i = stack.pop()
                piece.add((j, i))
                for c in ((j + 1, i), (j - 1, i), (j, (i + 1) % cols), (j, (i - 1) % cols)):
                    if c in left:
                        left.remove(c)
                        stack.append(c)
            beside = {c for p in piece for c in around(*p)}
            units = {u for c in beside for u in own.get(c, ())}
            lake, coast, wide = bool(beside & lakes), bool(beside - dry - lakes), bool(piece & core)
            region = min(j * cols + i for j, i in piece)
            km2 = sum(area(j) for j, _ in piece)
            assert areas[step, region] == pytest.approx(km2)
            rule = ("kept" if wide else "sliver") if coast else "state" if len(units) == 1 else "lake" if lake and km2 < 4e6 else "kept" if wide else "narrow"
            want[step, region] = (len(piece), wide, len(piece & core), lake, coast, len(units), min(units) if len(units) == 1 else None, rule)
    assert got == want and out.count() == len(got) and found.count() < len(got) and len(set(x[-1] for x in want.values())) > 2
    told = spark.createDataFrame([(0, min(k[1] for k in want if k[0] == 0 and want[k][-1] in ("kept", "sliver")), False)], "step int, region long, stateless boolean")
    small = out.drop("rule").withColumn("km2", F.lit(1.0))
    assert steps.classify(small, 4e6, told).where("rule = 'correction'").count() == 1


HOLE = "hole long, step int, ord int, lon double, lat double, clon double, clat double, km2 double, states array<string>, lake boolean"


def test_spans_of_years_in_steps(spark):
    years = spark.createDataFrame([(0, 1800), (1, 1805), (2, 1812)], "step int, year int")
    rows = spark.createDataFrame([("a", 1790, 1804), ("b", 1801, 1804), ("c", 1805, 1830), ("d", None, 1830)], "name string, first int, last int")
    assert sorted(tuple(x) for x in evolving.step_spans(rows, years).collect()) == [("a", 0, 0), ("c", 1, 2)]


def test_quiet_land_is_looked_at_once(spark):
    """A cell taken and left 100 times cuts the island that it lies on, not the one 20 columns off."""
    cells_ = [(j, i) for j in range(2, 5) for i in (*range(2, 5), *range(22, 25))]
    spans = [("A", 2, 2, s, s) for s in range(1, 200, 2)]
    out = evolving.unclaimed(spark.createDataFrame(cells_, "j int, i int"), spark.createDataFrame(spans, "name string, j int, i int, first int, last int"), spark.createDataFrame([], "j int, i int"), spark.createDataFrame([("A", "U")], "name string, outer string"), 200, 8, 40)
    got = sorted((x["region"], x["first"], x["last"], x["cells"], x["states"]) for x in out.collect())
    taken = 2 * 40 + 3
    assert got == sorted([(2 * 40 + 22, 0, 199, 9, 0)] + [(taken, s, s, 8, 1) if s % 2 else (taken - 1, s, s, 9, 0) for s in range(200)])
    empty = spark.createDataFrame([], "j int, i int")
    assert evolving.unclaimed(empty, spark.createDataFrame(spans, "name string, j int, i int, first int, last int"), empty, spark.createDataFrame([], "name string, outer string"), 200, 8, 40).count() == 0


def owed_in_order(holes, ends, reach, known):
    """The same by going through the steps, holding on to the holes of the step before."""
    places, last, before = [], [], None
    for step, year, until in ends:
        now = []
        for h in sorted((h for h in holes if h[1] == step), key=lambda h: h[2]):
            place = next((p for p, x, y in last if abs(x - h[3]) <= reach and abs(y - h[4]) <= reach), None) if before == step - 1 else None
            if place is None:
                place = {"track": h[0], "km2": 0.0, "first": year, "states": set(), "lake": False, "holes": 0}
                places.append(place)
            place["last"] = until
            if h[7] > place["km2"]:
                place |= {"km2": h[7], "lon": h[3], "lat": h[4], "c": (math.floor(h[5] + 0.5), math.floor(h[6] + 0.5))}
            place["states"] |= set(h[8])
            place["lake"] |= h[9]
            place["holes"] += 1
            now.append((place, h[3], h[4]))
        last, before = now, step
    for p in places:
        x, y = p["c"]
        p["base"] = f"hole {p['first']}..{p['last']} {abs(x)}{'W' if x < 0 else 'E'} {abs(y)}{'S' if y < 0 else 'N'}"
    out, seen = {}, {}
    for p in places:
        n = seen[p["base"]] = seen.get(p["base"], 0) + 1
        name = p["base"] if sum(q["base"] == p["base"] for q in places) == 1 else f"{p['base']} #{n}"
        out[p["track"]] = (name, p["first"], p["last"], p["lon"], p["lat"], p["km2"], sorted(p["states"]), p["lake"], p["holes"], name in known)
    return out


def test_owed_holes_equal_a_walk_through_the_steps(spark):
    r = random.Random(15)
    holes = [(k, r.choice([0, 1, 2, 3, 5, 6]), 300 - k, float(r.randint(-12, 12)), float(r.randint(-6, 6)), r.randint(-30, 30) / 10, r.randint(-20, 20) / 10, float(r.randint(1, 5)), r.sample(["East", "West", "North"], r.randint(0, 2)), r.random() < 0.3) for k in range(160)]
    ends = [(s, 1800 + 10 * s, 1809 + 10 * s) for s in range(7)]
    plain = owed_in_order(holes, ends, 2, set())
    known = {name for k, (name, *_) in plain.items() if k % 3 == 0} | {"hole 1700..1709 1E 1N"}
    args = spark.createDataFrame(holes, HOLE), spark.createDataFrame(ends, "step int, year int, until int"), 2.0
    got = {x["track"]: tuple(x)[1:] for x in steps.owed_holes(*args, spark.createDataFrame([(k,) for k in known], "id string")).collect()}
    want = owed_in_order(holes, ends, 2, known)
    assert got == want and len(want) < 120 and any("#2" in x[0] for x in want.values())
    assert steps.owed_holes(args[0].limit(0), *args[1:]).count() == 0


def test_owed_places_of_one_id_are_told_apart_in_order(spark):
    piece = (20_000.0, ["East", "West"], False)
    holes = [(7, 0, 0, 10.1, 5.4, 10.2, 5.1, *piece), (3, 0, 1, 14.0, 5.0, 9.6, 4.8, *piece), (9, 0, 2, -12.5, -2.0, -12.9, -2.1, *piece)]
    got = [x["id"] for x in steps.owed_holes(spark.createDataFrame(holes, HOLE), spark.createDataFrame([(0, 1800, 1809)], "step int, year int, until int"), 2.0).collect()]
    assert sorted(got) == ["hole 1800..1809 10E 5N #1", "hole 1800..1809 10E 5N #2", "hole 1800..1809 13W 2S"]


def test_smallest_extent_without_ordering_a_group(spark):
    """Groups in one bucket, across 180 degrees, all around, all around and dense, with equal gaps: the same as with all longitudes in order."""
    r = random.Random(4)
    groups = [[10.0], [10.0, 10.25, 10.5], [179.0, -179.0, 178.5], [0.0, 90.0, 180.0, -90.0], [r.uniform(-180, 180) for _ in range(40)], [k * 0.5 - 180 for k in range(720)], [k * 0.5 - 180 + (0.25 if k % 2 else 0.1) for k in range(720)], [round(r.uniform(-180, 180), 2) for _ in range(2000)] * 2, [-180.0, 180.0, 3.0]]
    rows = [(g, x, float(g)) for g, xs in enumerate(groups) for x in xs] + [(0, None, 5.0), (1, 5.0, None)]
    points = spark.createDataFrame(rows, "g int, lon double, lat double")
    for widths in ((1.0, 1 / 1024), (60.0, 5.0), (0.7,), (360.0, 45.0)):
        got = {x["g"]: (x["west"], x["east"]) for x in events.smallest_extent(points, ["g"], widths).collect()}
        for g, xs in enumerate(groups):
            lons = sorted(set(xs))
            gaps = [((b - a if b > a else b - a + 360), -a, b, a) for a, b in zip(lons, [*lons[1:], lons[0]], strict=True)]
            assert got[g] == max(gaps)[2:], (g, widths)


def test_corners_and_neighbours_over_face_edges(spark):
    """Neighbours are mutual and meet at the same two points; corners have one value on all faces, found by their place in space."""
    level, side = 2, 4
    tiles = [(f, x, y) for f in range(6) for x in range(side) for y in range(side)]
    got = {(x["face"], x["x"], x["y"], x["side"]): (x["face2"], x["x2"], x["y2"], x["side2"], x["turned"]) for x in grid.neighbours(spark.createDataFrame(tiles, "face int, x int, y int"), level).collect()}
    assert len(got) == 4 * len(tiles)

    def at(face, i, j):
        out, s, t = geo.FACES[face]
        return tuple(side * o + (2 * i - side) * a + (2 * j - side) * b for o, a, b in zip(out, s, t, strict=True))

    def ends(face, x, y, k):
        return {0: (at(face, x, y), at(face, x, y + 1)), 1: (at(face, x + 1, y), at(face, x + 1, y + 1)), 2: (at(face, x, y), at(face, x + 1, y)), 3: (at(face, x, y + 1), at(face, x + 1, y + 1))}[k]

    for key, (f, x, y, k, turned) in got.items():
        assert got[f, x, y, k] == (*key, turned)
        a, b = ends(*key), ends(f, x, y, k)
        assert a == (b[::-1] if turned else b)
    r = random.Random(2)
    texels = [(f, j, i, r.randint(-50, 50) if r.random() < 0.9 else None) for f, i, j in tiles if r.random() < 0.95]
    around = {}
    for f, j, i, v in texels:
        for a in (0, 1):
            for b in (0, 1):
                around.setdefault(at(f, i + a, j + b), []).append(v)
    want = {}
    for f in range(6):
        for j in range(side + 1):
            for i in range(side + 1):
                held = [v for v in around.get(at(f, i, j), []) if v is not None]
                if (j in (0, side) or i in (0, side)) and held:
                    mean = sum(held) / len(held)
                    owner = min(g for g in range(6) for u in range(side + 1) for v in range(side + 1) if at(g, u, v) == at(f, i, j))
                    want[f, j, i] = (owner, len(held), math.floor(abs(mean) + 0.5) * (1 if mean >= 0 else -1))
    rows = grid.face_corner_values(spark.createDataFrame(texels, "face int, j int, i int, value long"), side).collect()
    assert {(x["face"], x["j"], x["i"]): (x["owner"]["face"], x["texels"], x["value"]) for x in rows} == want


def test_spans_of_events(spark):
    """Spans: a start and an end widen one side each; corrected dates leave; years and months before the reform are Julian."""
    schema = "line_no long, cls string, qid long, label string, enwiki string, prop string, y long, m int, d int, prec int, lon double, lat double, editions int, parent long"
    row = lambda n, qid, prop, y, m, d, prec: (n, "war", qid, "x", None, prop, y, m, d, prec, 1.0, 2.0, 3, None)
    rows = [
        row(1, 1, "start", 1914, 7, 28, 11), row(2, 1, "point", 1918, 11, 11, 11), row(3, 1, "end", 1918, 11, 11, 11),
        row(4, 2, "start", 1817, 9, 29, 11), row(5, 2, "end", 1818, 9, 9, 11),
        row(6, 3, "point", 1815, 10, 17, 11), row(7, 3, "point", 1815, 10, 17, 11),
        row(8, 4, "start", 1453, 4, 15, 11), row(9, 4, "end", 1453, 5, 29, 11), row(10, 4, "end", 1453, 5, 20, 11),
        row(11, 5, "point", 1066, 1, 1, 9), row(12, 6, "point", 1520, 12, 1, 10), row(13, 7, "point", -700, 1, 1, 9), row(14, 8, "point", 1066, 10, 20, 11),
        row(15, 9, "start", 1337, 5, 24, 11), row(16, 9, "end", 1453, 1, 1, 9),
        row(17, 10, "end", 1900, 1, 1, 9), row(18, 10, "point", 1950, 1, 1, 9), row(19, 10, "start", 1990, 1, 1, 9),
    ]
    import datetime

    day = lambda y, m, d: datetime.date(y, m, d).toordinal() - 1
    classes = spark.createDataFrame([("war", 2.0)], "cls string, weight double")
    curated = spark.createDataFrame([(2, None, day(1816, 9, 30), None, None, None), (3, None, day(1813, 10, 17), None, None, None), (4, None, None, day(1453, 6, 7), None, None)], "qid long, boost double, day long, until long, lon double, lat double")
    got = {x["qid"]: (x["date"], x["t0"], x["t1"]) for x in events.index(spark.createDataFrame(rows, schema), classes, curated).collect()}
    assert got[1] == (day(1918, 11, 11), day(1914, 7, 28), day(1918, 11, 11))
    assert got[2] == (day(1816, 9, 30), day(1816, 9, 30), day(1818, 9, 9))
    assert got[3] == (day(1813, 10, 17),) * 3
    assert got[4] == (day(1453, 4, 15), day(1453, 4, 15), day(1453, 6, 7))
    assert got[5] == (day(1066, 1, 7), day(1066, 1, 7), day(1067, 1, 6))
    assert got[6] == (day(1520, 12, 11), day(1520, 12, 11), day(1521, 1, 10))
    assert got[8] == (day(1066, 10, 20),) * 3
    assert got[9] == (day(1337, 5, 24), day(1337, 5, 24), day(1454, 1, 9))
    assert got[10] == (day(1950, 1, 1), day(1950, 1, 1), day(1950, 12, 31))  # a start after and an end before widen nothing
    assert got[7][2] - got[7][1] == 365  # a Julian leap year


def test_forced_events_strict_or_lenient(spark):
    import pytest

    index = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, label string")
    listed = spark.createDataFrame([(2,), (2,), (7,)], "qid long")
    rows, missing = events.forced(index, listed)
    assert [tuple(x) for x in rows.collect()] == [(2, "b")] and [x["qid"] for x in missing.collect()] == [7]
    with pytest.raises(ValueError, match="7"):
        events.forced(index, listed, strict=True)


def test_densified_plan_works_each_arc_out_once(spark):
    from meridia.operators import routes

    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0), (1, 1, 20.0, 10.0, 5), (1, 2, 20.0, 10.0, 9), (1, 3, -170.0, 80.0, 10)], "route long, idx int, lon double, lat double, day long")
    out = routes.densified(v, 500.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ACOS") + plan.count("acos") == 1 and plan.lower().count("sin(") < 20, plan
    rows = out.orderBy("n").collect()
    assert [x["n"] for x in rows] == list(range(len(rows))) and all(km((a["lon"], a["lat"]), (b["lon"], b["lat"])) <= 500.001 for a, b in zip(rows, rows[1:], strict=False))


def test_routes_are_refused(spark):
    from meridia.operators import routes

    good = {"fid": 1, "kind": "route", "type": "LineString", "points": [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]], "epoch": "1850-02-27", "dates": ["1850-02-27", "1850-02-28", "1850-02-28"], "legs": [(0, 1, False, True), (1, 2, True, False)], "names": ["a", None, "b"]}
    cases = [("no route", {"kind": "track"}), ("no route", {"type": None}), ("too few vertices", {"points": [[0.0, 0.0]]}), ("place", {"points": [[0.0, 0.0], [1.0, 91.0], [2.0, 2.0]]}), ("place", {"points": [[0.0], [1.0, 1.0], [2.0, 2.0]]}), ("dates", {"dates": ["1850-02-27"] * 2}), ("dates", {"dates": None}), ("no date", {"dates": ["1850-02-27", "1850-02-29", "1850-03-01"]}), ("no date", {"dates": ["1850-02-27", None, "1850-03-01"]}), ("backward", {"dates": ["1850-02-27", "1850-03-02", "1850-03-01"]}), ("too few vertices", {"points": None}), ("legs", {"legs": [(0, 1, False, True)]}), ("leg", {"legs": [(0, 1, False, True), (1, 3, False, True)]}), ("leg", {"legs": [(0, 1, None, True), (1, 2, False, True)]}), ("names", {"names": ["a"]})]
    schema = "fid long, kind string, type string, points array<array<double>>, epoch string, dates array<string>, legs array<struct<`from`:long,`to`:long,uncertain:boolean,sea:boolean>>, names array<string>"
    rows = [tuple((good | {"fid": k} | c).values()) for k, (_, c) in enumerate([("", {})] + cases)]
    got = {x["fid"]: x["fault"] for x in routes.route_faults(routes.route_rows(spark.createDataFrame(rows, schema))).collect()}
    assert got == {k + 1: f for k, (f, _) in enumerate(cases)}
    v = [tuple(x) for x in routes.route_vertices(routes.route_rows(spark.createDataFrame(rows[:1], schema))).orderBy("idx").collect()]
    assert v == [(0, 0, 0.0, 0.0, 0, "a", 2), (0, 1, 1.0, 1.0, 1, None, 1), (0, 2, 2.0, 2.0, 1, "b", 1)]


def test_fingerprint_tells_sets_apart(spark):
    from meridia.sources import tables

    rows = spark.range(3000).select(F.col("id") % 2 == 0, "id").toDF("even", "id")
    sha = lambda df: {x["even"]: (x["rows"], x["sha"]) for x in tables.fingerprint(df, ["even"], ["id"]).collect()}
    assert sha(rows) == sha(rows.repartition(7).orderBy(F.col("id").desc())) and sha(rows)[True][0] == 1500
    other = sha(rows.where("id <> 1234"))
    assert other[False] == sha(rows)[False] and other[True] != sha(rows)[True]


def band_in_order(mask, h, prefer):
    """The same on one mask, row by row."""
    rows, columns = len(mask), len(mask[0])
    found = []
    for r in range(rows - h + 1):
        row, best, n = [all(mask[r + k][i] for k in range(h)) for i in range(columns)], (0, 0, 0), 0
        for i, inside in enumerate(row):
            n = n + 1 if inside else 0
            if n > best[0]:
                best = (n, i + 1 - n, i + 1)
        found.append((best[0], r, best[1], best[2]))
    top = max((f[0] for f in found), default=0)
    if h >= rows or not top:
        return None
    return min((f for f in found if f[0] >= 0.97 * top), key=lambda f: (abs(f[1] + h / 2 - prefer), f[1]))


def test_straight_bands_equal_a_walk_over_rows(spark):
    r = random.Random(17)
    masks = {k: [[r.random() < p for _ in range(60)] for _ in range(9)] for k, p in enumerate([0.5, 0.8, 0.9, 0.97, 1.0, 0.05] * 3)}
    cells_ = [(k, j, i) for k, m in masks.items() for j, row in enumerate(m) for i, inside in enumerate(row) if inside]
    df = spark.createDataFrame(cells_, "k int, j int, i int")
    for h in (1, 2, 4, 9):
        got = {x["k"]: (x["length"], x["row"], x["first"], x["end"]) for x in cells.straight_bands(df, ["k"], h, 4.2, 9).collect()}
        assert got == {k: b for k, m in masks.items() if (b := band_in_order(m, h, 4.2))}


ROWS = "step int, name string, polity boolean, components array<string>, member_of array<string>"


def outer_of(spark, rows, kinds=(), relations=(), members=None):
    df = spark.createDataFrame([(r[0], r[1], r[2], list(r[3]), list(r[4])) for r in rows], ROWS)
    kinds = spark.createDataFrame(list(kinds), "name string, kind string")
    relations = spark.createDataFrame(list(relations), "name string, counts boolean")
    told = None if members is None else spark.createDataFrame(members, "step int, child string, parent string")
    edges = steps.memberships(df, kinds, relations, told)
    leaves = df.where("polity and not startswith(name, '(')").select("step", "name").distinct()
    review = sorted(map(tuple, steps.membership_review(df, kinds, relations).collect()))
    return {(x["step"], x["name"]): (x["outer"], x["roots"]) for x in steps.outer_units_by_step(edges, leaves).collect()}, review


def test_memberships_in_order_of_precedence(spark):
    rows = [
        (0, "West", True, (), ()),
        (0, "East", True, (), ("(Empire)",)),  # not among its components
        (0, "North", True, (), ("(Old Empire)",)),  # of which none is valid
        (0, "South", True, (), ("(Empire)",)),  # listed elsewhere: what it says doesn't count
        (0, "(Empire)", True, ("West",), ()),
        (0, "(States)", True, ("South",), ()),
        (1, "West", True, (), ()),
        (1, "Duchy", True, (), ()),
        (1, "March", True, (), ()),
        (1, "(Kingdom)", True, ("West",), ()),
        (1, "Kingdom", True, (), ()),
        (1, "Vassalage of Duchy to Kingdom", False, (), ()),
        (1, "Vassalage of March to West", False, (), ()),
        (1, "Vassalage of March to Nowhere", False, (), ()),
    ]
    kinds = [("(Empire)", "empire"), ("(Kingdom)", "empire")]
    relations = [("Vassalage of Duchy to Kingdom", True), ("Vassalage of March to West", False)]
    got, review = outer_of(spark, rows, kinds, relations)
    assert got == {
        (0, "West"): ("(Empire)", 1), (0, "East"): ("(Empire)", 1), (0, "North"): ("North", 1), (0, "South"): ("South", 1),
        (1, "West"): ("(Kingdom)", 1), (1, "Duchy"): ("(Kingdom)", 1), (1, "March"): ("March", 1), (1, "Kingdom"): ("Kingdom", 1),
    }
    assert review == [(0, "composite", "(States)"), (0, "unsettled", "North"), (1, "relation", "Vassalage of March to Nowhere")]
    got, _ = outer_of(spark, rows, [*kinds, ("(States)", "empire")], [("Vassalage of March to West", True)], [(0, "South", "(Empire)"), (1, "Kingdom", "Nowhere"), (1, "Duchy", "March")])
    assert got[0, "South"] == ("(Empire)", 2) and got[1, "March"] == got[1, "Duchy"] == ("(Kingdom)", 1) and got[1, "Kingdom"] == ("Kingdom", 1)
    assert outer_of(spark, []) == ({}, [])


def test_members_count_toward_their_units_pieces(spark):
    cells_ = [(0, "Duchy", 20, 10), *[(0, "Kingdom", j, i) for j in range(20, 26) for i in range(11, 20)], (0, "Isle", 40, 50), (0, "Kingdom", 40, 30)]
    df = spark.createDataFrame(cells_, "step int, name string, j int, i int")
    alone = {(x["name"], x["minor"]) for x in steps.parts_of_units(df, spark.createDataFrame([], "step int, name string, outer string"), 500_000.0, 50, 80).collect()}
    assert alone == {("Duchy", True), ("Kingdom", False), ("Kingdom", True), ("Isle", True)}
    outer = spark.createDataFrame([(0, "Duchy", "(Empire)"), (0, "Kingdom", "(Empire)")], "step int, name string, outer string")
    got = {(x["name"], x["outer"], x["minor"]) for x in steps.parts_of_units(df, outer, 500_000.0, 50, 80).collect()}
    assert got == {("Duchy", "(Empire)", False), ("Kingdom", "(Empire)", False), ("Kingdom", "(Empire)", True), ("Isle", "Isle", True)}


def test_polities_are_read_with_years_links_and_either_nesting(spark, tmp_path):
    ring = [[10, 40], [12, 40], [12, 42], [10, 40]]
    feature = lambda properties, geometry: {"type": "Feature", "properties": properties, "geometry": geometry}
    rome = {"Name": " Roman Republic", "FromYear": -44, "ToYear": 0, "Area": 1.0, "Type": "POLITY", "Wikidata": "Q17167", "SeshatID": "", "Components": "", "MemberOf": "(Mediterranean); (Italy)"}
    features = [feature(rome, {"type": "Polygon", "coordinates": [ring]}), feature({"Name": "(Isles)", "FromYear": 1, "ToYear": 5, "Type": "POLITY", "Components": "A;;B "}, {"type": "MultiPolygon", "coordinates": [[ring, ring], [ring]]}), feature({"Name": "Vassalage of A to B", "FromYear": -1, "ToYear": 7}, None)]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = tables.read_polities(spark, str(tmp_path / "a.json"))
    got = {x["fid"]: (x["name"], x["first"], x["last"], x["polity"], x["wikidata"], x["components"], x["member_of"], [len(p) for p in x["parts"]]) for x in rows.collect()}
    assert got == {0: ("Roman Republic", -43, 0, True, "Q17167", [], ["(Mediterranean)", "(Italy)"], [1]), 1: ("(Isles)", 1, 5, True, "", ["A", "B"], [], [2, 1]), 2: ("Vassalage of A to B", 0, 7, False, "", [], [], [])}
    at = [(x["fid"], x["part"], x["ring"]) for x in tables.ring_vertices(rows).where("idx = 1 and lon = 12 and lat = 40").collect()]
    assert sorted(at) == [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0)]
    (tmp_path / "b.json").write_text(json.dumps({"features": [feature(rome, {"type": "Point", "coordinates": [1, 2]})]}))
    with pytest.raises(Exception, match="a polity's geometry is a Point"):
        tables.read_polities(spark, str(tmp_path / "b.json")).collect()


def test_each_fault_of_a_correction_is_named(spark):
    good = ("a", 1, "give", 5, 9, "why", "book")
    rows = [good, ("a", 2, "take", 5, 9, "why", "book"), ("a", 3, None, 5, 9, "why", "book"), ("a", 4, "give", 9, 5, "why", "book"), ("a", 5, "give", None, 5, "why", "book"), ("c", 6, "give", 5, 9, "why", "book"), ("a", 7, "give", 0, 9, "why", "book"),
            ("a", 8, "give", 5, 21, "why", "book"), ("a", 9, "give", 5, 9, " ", "book"), ("a", 10, "give", 5, 9, "why", None), ("a", 11, "overlap", 5, 9, "why", ""), ("b", 12, "give", -5000, 9, "why", "book"), ("a", 13, *good[2:]), ("a", 13, *good[2:]), (None, 14, *good[2:])]
    df = spark.createDataFrame(rows, "era string, number int, kind string, y0 int, y1 int, why string, source string")
    eras = spark.createDataFrame([("a", 1, 19), ("b", None, 0)], "era string, low int, high int")
    got = sorted((x["number"], x["fault"]) for x in audits.correction_faults(df, eras, 20, ["give", "overlap"]).collect())
    assert got == [(2, "operation"), (3, "operation"), (4, "years"), (5, "years"), (6, "era"), (7, "outside its era"), (8, "past the last year"), (9, "no reason"), (10, "no source"), (13, "repeated"), (13, "repeated"), (14, "era")]
    assert audits.correction_faults(df.limit(0), eras, 20, ["give"]).count() == 0


def test_texels_have_the_mean_of_their_cells(spark):
    r = random.Random(33)
    flags = [(j, i, r.random() < 0.4) for j in range(6) for i in range(8)]
    df = spark.createDataFrame(flags, "j int, i int, flag boolean")
    of = {(x["j"], x["i"]): x["distance"] for x in cells.signed_distance(df, 8, 3).collect()}
    got = {(x["j"], x["i"]): x["distance"] for x in cells.texel_distance(df, 8, 3).collect()}
    assert got == pytest.approx({(j, i): sum(of[2 * j + a, 2 * i + b] for a in (0, 1) for b in (0, 1)) / 4 for j in range(3) for i in range(4)})


def test_page_faults_across_blocks(spark):
    """Scores in order across blocks of any size, ids twice on one page only, nulls."""
    r = random.Random(41)
    rows, want = [], {}
    for page in ("a", "b", None):
        before = None
        ids = r.sample(range(1000), 58)
        for k, n in enumerate(sorted(r.sample(range(200), 60))):
            score = r.choice([5, 4, 3, None])
            qid = ids[k % 58] + (0 if page else 5000)
            lon = 500.0 if r.random() < 0.1 else 1.0
            fault = "place" if lon > 180 else "order" if None not in (score, before) and score > before else "id twice" if k % 58 < 2 else None
            if fault:
                want[page, qid, fault] = want.get((page, qid, fault), 0) + 1
            rows.append((page, n, qid, 0, 1, None, score, lon, 1.0))
            before = score
    df = spark.createDataFrame(rows, "page string, row long, qid long, t0 long, t1 long, parent long, score long, lon double, lat double")
    whole = sorted((q, f) for (_, q, f), n in want.items() for _ in range(n))
    for block in (1, 7, 50, 1 << 16):
        got = sorted((x["qid"], x["fault"]) for x in audits.page_faults(df, block).collect())
        assert got == whole
