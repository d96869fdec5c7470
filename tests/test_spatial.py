from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightfold.functions import geofn as G
from nightfold.operators import glow as L, spatial as P


def hav(a, b, c, d):
    la1, la2 = math.radians(a), math.radians(c)
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def points(n, seed, world=False):
    rnd = random.Random(seed)
    box = (-89, 89, -180, 180) if world else (36, 37, -122, -121)
    return [(i, rnd.uniform(box[0], box[1]), rnd.uniform(box[2], box[3])) for i in range(n)]


@pytest.mark.parametrize("world, k", [(False, 1), (True, 1), (True, 3)])
def test_nearest_equals_brute_force(spark, world, k):
    left, right = points(60, 1, world), points(80, 2, world)
    left += [(100 + i, 10.0, 179.99) for i in range(5)] + [(110, 89.0, 5.0)]  # one place many times, the date line, the pole
    right += [(900, 10.01, -179.99), (901, 88.9, -170.0), (902, 88.9, -170.0)]
    lf = spark.createDataFrame(left, "i long, lat double, lon double")
    rt = spark.createDataFrame(right, "j long, lat double, lon double")
    got = {}
    for r in P.nearest(lf, rt, "j", k=k).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"], r["km"]))
    for i, la, lo in left:
        want = sorted((hav(la, lo, a, b), j) for j, a, b in right)[:k]
        mine = [x for x in sorted(got[i])]
        assert [x[2] for x in mine] == pytest.approx([w[0] for w in want], abs=1e-6)
        assert [x[1] for x in mine] == [w[1] for w in want]


@pytest.mark.parametrize("radius", [5.0, 300.0, 4000.0])
def test_radius_join_equals_brute_force(spark, radius):
    left, right = points(40, 3, radius > 100), points(60, 4, radius > 100)
    right = [r for r in right if abs(r[2]) < 170 - radius / 60]
    left = [r for r in left if abs(r[2]) < 170 - radius / 60 and abs(r[1]) < 70]
    right = [r for r in right if abs(r[1]) < 70]
    if radius > 1000:
        left, right = [r for r in left if abs(r[2]) < 90], [r for r in right if abs(r[2]) < 90]
    lf = spark.createDataFrame(left, "i long, lat double, lon double")
    rt = spark.createDataFrame(right, "j long, lat double, lon double")
    got = sorted((r["i"], r["j"]) for r in P.radius_join(lf, rt, radius).select("i", "j").collect())
    assert got == sorted((i, j) for i, a, b in left for j, c, d in right if hav(a, b, c, d) <= radius)


def test_radius_join_deals_a_crowded_cell_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)
    rnd = random.Random(5)
    spots = [(rnd.uniform(88, 90), rnd.uniform(-180, 180)) for _ in range(40)] + [(90.0, 1.0), (None, 1.0)]
    left = [(i, *rnd.choice(spots)) for i in range(300)] + [(7, *spots[0])] * 3
    right = [(i, *rnd.choice(spots)) for i in range(90)] + [(3, *spots[0])] * 2
    lf = spark.createDataFrame(left, "i long, lat double, lon double")
    rt = spark.createDataFrame(right, "j long, lat double, lon double")
    out = P.radius_join(lf, rt, 150.0)
    assert out.columns == ["i", "lat", "lon", "j", "lat2", "lon2", "km"]
    near = out.select("i", "j", F.spark_partition_id().alias("task")).collect()
    want = sorted((i, j) for i, a, b in left for j, c, d in right if None not in (a, c) and hav(a, b, c, d) <= 150.0)
    assert sorted((r["i"], r["j"]) for r in near) == want
    held = [sum(r["task"] == t for r in near) for t in {r["task"] for r in near}]
    assert len(held) > 20 and max(held) < len(near) / 5


@pytest.mark.parametrize("radius", [40.0, 1500.0])
def test_not_near_equals_brute_force_and_broadcasts_nothing(spark, radius):
    rnd = random.Random(11)
    spots = [*((a, b) for _, a, b in points(60, 12, True)), *((a, b) for _, a, b in points(40, 13)), (10.0, 179.99), (10.0, -179.99), (89.99, 5.0), (89.99, -170.0), (90.0, 0.0), (-90.0, 3.0)]
    pick = lambda n: [(i, rnd.choice(["x", "y", None]), *rnd.choice(spots)) for i in range(n)]
    left = [*pick(150), (900, "x", None, 1.0), (901, "x", math.nan, 1.0), (901, "x", math.nan, 1.0), (902, "y", 36.5, math.inf)]
    right = [*pick(60), *[(500 + i, "x", 0.0, 0.0) for i in range(5)], (700, "x", math.nan, 1.0), (701, "x", None, 1.0)]
    lf = spark.createDataFrame(left, "i long, k string, lat double, lon double")
    rt = spark.createDataFrame(right, "j long, k string, lat double, lon double")
    out = P.not_near(lf, rt, "k", radius)
    ok = lambda v: v is not None and math.isfinite(v)
    near = lambda k, a, b: any(k is not None and k == m and ok(a) and ok(b) and ok(c) and ok(d) and hav(a, b, c, d) < radius for _, m, c, d in right)
    assert sorted(r["i"] for r in out.collect()) == sorted(i for i, k, a, b in left if not near(k, a, b))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_nearest_scaled_prefers_towns_then_lowest_score(spark):
    rnd = random.Random(9)
    places = [(i, f"p{i}", rnd.choice(["city", "town", "community"]), rnd.uniform(36, 37), rnd.uniform(-122, -121), rnd.choice([0.5, 4.0, 60.0, 900.0])) for i in range(40)]
    pts = [(i, rnd.uniform(35.5, 37.5), rnd.uniform(-122.5, -120.5)) for i in range(30)] + [(99, 10.0, 20.0)]
    got = {r["q"]: r["place_id"] for r in P.nearest_scaled(
        spark.createDataFrame(pts, "q long, lat double, lon double"),
        spark.createDataFrame(places, "place_id long, name string, kind string, lat double, lon double, land_km2 double"), "q").collect()}
    for q, la, lo in pts:
        s = [(hav(la, lo, p[3], p[4]) / math.sqrt(max(p[5], 1.0) / math.pi), p[0], p[2]) for p in places]
        towns = [x for x in s if x[2] in ("city", "town") and x[0] <= 2.0]
        assert got[q] == min(towns or s)[1]


def brute_farthest(pool, seeds, quota, km_per_m):
    d = lambda a, b: math.hypot(hav(a["lat"], a["lon"], b["lat"], b["lon"]), (a["elevation_m"] - b["elevation_m"]) * km_per_m)
    chosen, left, rest = list(seeds), dict(quota), sorted((p for p in pool if p["id"] not in {s["id"] for s in seeds}), key=lambda p: p["id"])
    for s in seeds:
        left[s["region"]] -= 1
    while True:
        open_ = [p for p in rest if left.get(p["region"], 0) > 0]
        if not open_:
            return [c["id"] for c in chosen]
        best = max(open_, key=lambda p: (round(min(d(p, c) for c in chosen), 9), [-ord(ch) for ch in p["id"]]))
        rest.remove(best)
        chosen.append(best)
        left[best["region"]] -= 1


def test_farthest_points_equal_greedy_search(spark):
    rnd = random.Random(4)
    rows = [(f"x{i:02d}", f"R{i % 3}", rnd.uniform(33, 41), rnd.uniform(-124, -115), rnd.uniform(0, 2500)) for i in range(40)]
    pool = spark.createDataFrame(rows, "id string, region string, lat double, lon double, elevation_m double")
    local = pool.collect()
    quota = {"R0": 4, "R1": 3, "R2": 2}
    got = [r["id"] for r in P.farthest_points(pool, local[:2], quota, 0.1, cut_every=3)]
    assert got == brute_farthest(local, local[:2], quota, 0.1)


def test_farthest_points_skip_those_that_fail_and_break_ties_by_id(spark):
    rows = [("a", "R", 36.0, -120.0, 0.0), ("b", "R", 36.0, -119.0, 0.0), ("c", "R", 36.0, -121.0, 0.0)]
    pool = spark.createDataFrame(rows, "id string, region string, lat double, lon double, elevation_m double")
    seed = [r for r in pool.collect() if r["id"] == "a"]
    assert [r["id"] for r in P.farthest_points(pool, seed, {"R": 2}, 0.1)] == ["a", "b"]
    assert [r["id"] for r in P.farthest_points(pool, seed, {"R": 2}, 0.1, passes=lambda r: r["id"] != "b")] == ["a", "c"]


def test_quota_rounds_halves_up(spark):
    s = spark.createDataFrame([("x", "R", True)] * 27, "id string, region string, online boolean")
    assert P.quotas(s, 6, 2).first()["quota"] == 5


def test_unique_ids(spark):
    rows = [(1, "Cañada", "Kern"), (2, "Davis", "Yolo"), (3, "Davis", "Yolo"), (4, "Davis", "Kern")]
    got = {r["k"]: r["id"] for r in P.unique_ids(spark.createDataFrame(rows, "k long, name string, county string"), "k").collect()}
    assert got == {1: "canada", 2: "davis-yolo", 3: "davis-yolo-2", 4: "davis-kern"}


def test_ring_sums_equal_brute_force(spark):
    rnd = random.Random(6)
    cells = {(rnd.randint(-90, 90), rnd.randint(-90, 90)): rnd.uniform(1, 9) for _ in range(150)}
    g = spark.createDataFrame([(x, y, e) for (x, y), e in cells.items()], "gx long, gy long, emission double")
    edges = [0.0, 1.5, 6.0, 40.0]
    got = {(r["gx"], r["gy"]): [r["r0"], r["r1"], r["r2"]] for r in L.ring_features(g, edges).collect()}
    for (x, y) in list(cells)[:30]:
        want = [sum(e for (a, b), e in cells.items() if lo <= math.hypot(a - x, b - y) < hi) for lo, hi in zip(edges, edges[1:])]
        assert got[(x, y)] == pytest.approx(want, abs=1e-6)
    dark = [(0, 0), (500, 500), (-91, 17), (3, -4)]
    aims = spark.createDataFrame(dark, "gx long, gy long")
    got = {(r["gx"], r["gy"]): [r["r0"], r["r1"], r["r2"]] for r in L.ring_features(g, edges, targets=aims).collect()}
    for (x, y) in dark[:1] + dark[2:]:
        want = [sum(e for (a, b), e in cells.items() if lo <= math.hypot(a - x, b - y) < hi) for lo, hi in zip(edges, edges[1:])]
        assert got[(x, y)] == pytest.approx(want, abs=1e-9)
    assert got[(500, 500)] == [0.0, 0.0, 0.0]


def test_kernel_is_recovered_and_never_negative(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, 3)) * [1, 50, 500]
    t = x @ [3.0, 0.0, 0.02]
    rows = spark.createDataFrame([(*map(float, r), float(v), float(i)) for i, (r, v) in enumerate(zip(x, t))], "r0 double, r1 double, r2 double, target double, lon double")
    assert L.fit_kernel(rows, ["r0", "r1", "r2"]) == pytest.approx([3.0, 0.0, 0.02], abs=1e-8)
    minus = rows.withColumn("target", F.col("r0") * 3.0 - F.col("r1") * 0.01 + 1)
    assert (L.fit_kernel(minus, ["r0", "r1", "r2"]) >= 0).all()
    assert L.error_summary(L.spatial_cv(rows, ["r0", "r1", "r2"])).first()["rmse_mag"] == pytest.approx(0.0, abs=1e-8)


def test_darkest_window_faces_away_from_the_peak(spark):
    dome = [0.0] * 16
    dome[4] = 5.0
    s = spark.createDataFrame([("s", i, v) for i, v in enumerate(dome)], "site string, sector int, dome double")
    sums = [sum(dome[(i + k) % 16] for k in range(4)) for i in range(16)]
    away = [abs(((i + 1.5) % 16 - 4 + 8) % 16 - 8) for i in range(16)]
    want = max((i for i in range(16) if sums[i] == min(sums)), key=lambda i: (away[i], -i))
    assert L.darkest_window(s, ["site"]).first()["darkest_sector"] == want


def test_scales_at_their_edges(spark):
    r = spark.createDataFrame([(0.009, 22.0), (0.01, 21.76), (40.96, 17.0)], "r double, m double")
    got = [(x["l"], x["b"]) for x in r.select(G.level(F.col("r")).alias("l"), G.bortle_class(F.col("m")).alias("b")).collect()]
    assert got == [(0, "1"), (1, "1"), (13, "8–9")]
    back = spark.range(1).select(G.ucd_of_sqm(G.sqm(F.lit(123.0))).alias("u"), G.mcd_to_ucd(F.lit(-1.0)).alias("n")).first()
    assert back["u"] == pytest.approx(123.0) and back["n"] is None


def test_spaced_spots_keep_the_darkest(spark):
    rows = [("s", 10.0, 21.0, 36.00, -120.0), ("s", 12.0, 21.5, 36.01, -120.0), ("s", 30.0, 20.0, 37.0, -120.0), ("s", 1.0, 22.0, 38.0, -120.0)]
    d = spark.createDataFrame(rows, "site string, km double, sqm double, lat2 double, lon2 double")
    assert sorted(r["sqm"] for r in L.spaced_spots(d, ["site"]).collect()) == [20.0, 21.5]


def test_satellite_hides_the_far_side(spark):
    x, y = G.scan_angles(F.col("lat"), F.col("lon"), 6378137.0, 6356752.31414, 35786023.0, -75.0)
    # The worked example of the imager's public user guide: 33.846162 N, 84.690932 W.
    near, far = spark.createDataFrame([(33.846162, -84.690932), (0.0, 105.0)], "lat double, lon double").select(x.alias("x"), y.alias("y")).collect()
    assert (near["x"], near["y"]) == (pytest.approx(-0.024052, abs=1e-6), pytest.approx(0.095340, abs=1e-6)) and far["x"] is None


def test_radius_join_copies_fewer_rows_where_pairs_are_very_many(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "PIECES", 8, raising=False)
    sides, plain = [], P._spread
    monkeypatch.setattr(P, "_spread", lambda lt, rt: sides.append(plain(lt, rt)) or sides[0])
    left = spark.range(700).selectExpr("id AS i", "10 + id % 37 / 100D AS lat", "20 + id % 41 / 100D AS lon")
    right = spark.range(500).selectExpr("id AS j", "10 + id % 31 / 100D AS lat", "20 + id % 43 / 100D AS lon")
    out = P.radius_join(left, right, 300.0)
    assert out.select("i", "j").distinct().count() == out.count() == 700 * 500
    assert sides[0][0].count() + sides[0][1].count() < 20_000  # blocks of 16: some 48,000


def test_radius_join_round_the_globe(spark):
    rnd = random.Random(11)
    pole = [(rnd.choice([-1, 1]) * rnd.uniform(88.8, 90), rnd.uniform(-180, 180)) for _ in range(60)]
    line = [(rnd.uniform(-60, 60), rnd.choice([-1, 1]) * rnd.uniform(179.2, 180)) for _ in range(120)]
    rest = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(60)]
    pts = [(10.0, 179.95), (10.0, -179.95), (89.9, 0.0), (89.9, 90.0), (-90.0, 5.0), (90.0, 0.0), *pole, *line, *rest]
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "a int, lat double, lon double")
    b = a.withColumnRenamed("a", "b")

    km = lambda p, q: hav(*p, *q)
    for r in (50.0, 400.0, 9000.0):
        got = {(x["a"], x["b"]) for x in P.radius_join(a, b, r).select("a", "b").collect()}
        assert got == {(i, j) for i, p in enumerate(pts) for j, q in enumerate(pts) if km(p, q) <= r}
    keyed = a.withColumn("k", F.col("a") % 2)
    other = b.filter("b % 3 = 0").withColumn("k", F.col("b") % 2)
    got = {x["a"] for x in P.not_near(keyed, other, "k", 50.0).collect()}
    assert got == {i for i, p in enumerate(pts) if not any(j % 3 == 0 and j % 2 == i % 2 and km(p, q) < 50 for j, q in enumerate(pts))}


def test_nearest_within_a_limit(spark):
    rnd = random.Random(12)
    left = spark.createDataFrame([(i, rnd.choice("abz"), rnd.uniform(30, 31), rnd.uniform(10, 11), rnd.uniform(0, 40)) for i in range(80)], "i int, k string, lat double, lon double, lim double")
    right = spark.createDataFrame([(i, rnd.choice("ab"), rnd.uniform(30, 31), rnd.uniform(10, 11)) for i in range(60)], "r int, k string, lat double, lon double")
    whole = P.nearest(left, right, "r", k=2, keys=["k"]).filter("km <= lim")
    cut = P.nearest(left, right, "r", k=2, keys=["k"], within=F.col("lim"))
    rows = lambda d: sorted((x["i"], x["rank"], x["r"]) for x in d.collect())
    assert rows(whole) == rows(cut) and rows(cut)
