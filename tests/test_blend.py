from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightfold.operators import blend as B, hourly as H, models as M, sensitivity as S, verify as V

D0 = dt.date(2024, 1, 1)
MEMBERS = B.Members({"gfs": (1, 2), "ecmwf": (1,)}, {"nbm": (1, 2)}, ("A", "B"), {"primary": "usable_primary", "era5": "usable_era5"})
COLUMNS = ["site", "night_date", "lead", "split", "season", "month", "dark_hours", "n_models_available", "spread_frac_clear", "usable_primary", "usable_era5",
           *[f"{m}_{f}" for m in ("gfs", "ecmwf", "nbm") for f in ("frac_clear", "longest_clear_run_frac", "mean_cover", "pred_usable")]]
TYPES = "site string, night_date date, lead int, split string, season string, month int, dark_hours int, n_models_available int, spread_frac_clear double, usable_primary boolean, usable_era5 boolean, " + ", ".join(
    f"{m}_frac_clear double, {m}_longest_clear_run_frac double, {m}_mean_cover double, {m}_pred_usable boolean" for m in ("gfs", "ecmwf", "nbm")
)


def dataset(seed=3, nights=80):
    """Two sites, two leads; one model stops at lead 1 and both have gaps."""
    r, rows = np.random.default_rng(seed), []
    for i in range(nights):
        for site in "AB":
            clear = r.random()
            for lead in (1, 2):
                own = lambda gap: None if r.random() < gap else float(np.clip(clear + r.normal() * 0.2, 0, 1))
                g, e, n = own(0.1), own(0.1) if lead == 1 else None, own(0.0)
                have = [x for x in (g, e) if x is not None]
                y = bool(clear + 0.1 * (site == "B") > 0.5)
                feats = [v for x in (g, e, n) for v in (x, x, None if x is None else 1 - x, None if x is None else x > 0.5)]
                d = D0 + dt.timedelta(days=i)
                rows.append((site, d, lead, "train" if i < 60 else "test", "DJF", d.month, 10, len(have), float(np.std(have)) if len(have) > 1 else None, None if i % 9 == 0 else y, y if r.random() < 0.9 else not y, *feats))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(dataset(), TYPES)


def test_each_variant_has_its_rows_and_inputs(spark, data):
    long = B.member_rows(data, MEMBERS)
    rows = dataset()
    n = {(r["variant"], r["lead"]): r["n"] for r in long.filter("label = 'era5'").groupBy("variant", "lead").agg(F.count("*").alias("n")).collect()}
    col = {c: i for i, c in enumerate(COLUMNS)}
    count = lambda f: sum(1 for r in rows if f(r))
    assert n["geo", 1] == n["site", 1] == count(lambda r: r[2] == 1 and r[col["n_models_available"]] > 0)
    assert n["ecmwf_lr", 1] == count(lambda r: r[2] == 1 and r[col["ecmwf_frac_clear"]] is not None) and ("ecmwf_lr", 2) not in n
    assert n["equal_weight_cal", 1] == count(lambda r: r[2] == 1 and r[col["ecmwf_frac_clear"]] is not None and r[col["gfs_frac_clear"]] is not None)
    used = long.filter("variant = 'gfs_lr' and label = 'primary'").agg(*[F.max(F.abs(c)).alias(c) for c in MEMBERS.inputs]).first().asDict()
    assert {k for k, v in used.items() if v} == {"gfs_frac_clear", "gfs_longest_clear_run_frac", "gfs_mean_cover", "site_A", "site_B", "month_sin", "month_cos", "dark_hours"}
    geo = long.filter("variant = 'geo'").agg(F.max("site_A"), F.max("site_B")).first()
    assert tuple(geo) == (0.0, 0.0)


def test_unused_inputs_get_no_weight_and_change_nothing(spark, data):
    """A variant fitted among all others is the same model as one fitted alone on its own inputs."""
    long = B.member_rows(data, MEMBERS)
    together = B.fit(spark, long, MEMBERS.inputs, calibrated=(), folds=2)
    inputs = ["gfs_frac_clear", "gfs_longest_clear_run_frac", "gfs_mean_cover", "site_A", "site_B", "month_sin", "month_cos", "dark_hours"]
    alone = B.fit(spark, B.member_rows(data, MEMBERS, ["gfs_lr"], inputs), inputs, calibrated=(), folds=2)
    pick = lambda f: {tuple(a["keys"].values()): a for a in f.artifacts}
    both, one = pick(together), pick(alone)
    assert set(one) == {k for k in both if k[2] == "gfs_lr"}
    for k, a in one.items():
        of = dict(zip(both[k]["output_features"], both[k]["coef"]))
        assert a["c"] == both[k]["c"] and [of[f] for f in a["output_features"]] == pytest.approx(a["coef"], abs=1e-7)
        assert all(v == 0 for f, v in of.items() if f not in a["output_features"])


def test_every_method_is_scored_on_the_same_rows(spark, data):
    long = B.member_rows(data, MEMBERS)
    fitted = B.fit(spark, long, MEMBERS.inputs, folds=2)
    train = data.filter("split = 'train'")
    rates = V.climatology(train, "usable_primary").withColumn("label", F.lit("primary")).unionByName(V.climatology(train, "usable_era5").withColumn("label", F.lit("era5")))
    p = B.all_methods(data, MEMBERS, B.predict(long, fitted), rates).toPandas()
    for (label, lead), part in p.groupby(["label", "lead"]):
        sets = {m: frozenset(zip(g["site"], g["night_date"])) for m, g in part.groupby("method")}
        assert len(set(sets.values())) == 1
        wanted = {"climatology", "persistence", "equal_weight", "equal_weight_cal", "gfs_rule", "gfs_lr", "nbm_rule", "nbm_raw", "nbm_lr", "blend"} | ({"ecmwf_rule", "ecmwf_lr"} if lead == 1 else set())
        assert set(sets) == wanted
    assert ((p["p"] >= 0) & (p["p"] <= 1)).all()
    best = {(r["label"], r["lead"]): r["best_single"] for r in B.best_single(fitted, MEMBERS).collect()}
    assert best["era5", 2] == "gfs_lr" and set(best) == {(a, b) for a in ("primary", "era5") for b in (1, 2)}


def test_test_labels_never_reach_the_models(spark, data):
    flipped = data.withColumn("usable_era5", F.when(F.col("split") == "test", ~F.col("usable_era5")).otherwise(F.col("usable_era5")))
    fit = lambda d: [np.round(a["coef"], 9).tolist() for a in B.fit(spark, B.member_rows(d, MEMBERS, ["geo"], ["gfs_frac_clear"]), ["gfs_frac_clear"], folds=2).artifacts]
    assert fit(data) == fit(flipped)


def test_the_served_variant_depends_on_the_place(spark):
    p = spark.createDataFrame([("era5", 1, v, s, D0, "test", 1, q) for s in ("A", "X") for v, q in (("site", 0.1), ("geo", 0.9))], "label string, lead int, variant string, site string, night_date date, split string, y int, p double")
    got = {r["site"]: r["variant"] for r in B.with_own_variant(p, spark.createDataFrame([("A",), ("A",)], "site string")).collect()}
    assert got == {"A": "site", "X": "geo"}


def test_final_fit_names_its_stations(spark, data):
    fitted, trained = B.final_fit(spark, B.member_rows(data, MEMBERS, ["geo"], ["gfs_frac_clear"]), ["gfs_frac_clear"], folds=2)
    assert {tuple(r["trained_on"]) for r in trained.collect()} == {("A", "B")} and len(fitted.artifacts) == 4


def test_models_judged_by_other_labels(spark):
    p = spark.createDataFrame([("a", 1, "s", D0, 0.2), ("b", 1, "s", D0, 0.7)], "label string, lead int, site string, night_date date, p double")
    t = spark.createDataFrame([("a", "s", D0, "DJF", 1), ("b", "s", D0, "DJF", None)], "label string, site string, night_date date, season string, y int")
    got = {(r["label"], r["method"], r["family"], r["p"]) for r in B.cross_truth(p, t).collect()}
    assert got == {("a", "blend_a", "blend", 0.2), ("a", "blend_b", "cross_truth", 0.7)}


def test_isotonic_in_parts_is_isotonic_at_once(spark):
    r = np.random.default_rng(7)
    rows = [(k, float(round(p, 2)), int(r.random() < p**2)) for k in (1, 2) for p in r.random(400)]
    got = {x["k"]: (x["isotonic_x"], x["isotonic_y"]) for x in M.isotonic_knots(spark.createDataFrame(rows, "k int, p double, y int"), ["k"]).collect()}
    for k in (1, 2):
        ps = sorted({p for kk, p, _ in rows if kk == k})
        mean = {}
        for a in range(len(ps)):
            for b in range(a, len(ps)):
                ys = [y for kk, p, y in rows if kk == k and ps[a] <= p <= ps[b]]
                mean[a, b] = sum(ys) / len(ys)
        want = [max(min(mean[a, b] for b in range(i, len(ps))) for a in range(i + 1)) for i in range(len(ps))]
        assert np.interp(ps, *got[k]) == pytest.approx(want)


def test_definitions_in_one_pass(spark):
    """Runs and shares of each definition against plain counting."""
    r = np.random.default_rng(5)
    nights, rows = {}, []
    for k in range(30):
        covers = [None if r.random() < 0.2 else float(r.choice([0.05, 0.15, 0.25, 0.9])) for _ in range(9)]
        nights[k] = covers
        rows += [(k, s, c, 9) for s, c in enumerate(covers)]
    h = spark.createDataFrame(rows, "k int, slot int, cover double, n_hours int")
    got = S.definition_summaries(h, ["k"], "cover", "n_hours", (0.1, 0.2), (2, 3), 0.3).collect()
    for x in got:
        c = nights[x["k"]]
        known = [v for v in c if v is not None]
        if (9 - len(known)) / 9 > 0.3:
            assert x["usable"] is None and x["frac_clear"] is None
            continue
        clear = ["1" if v is not None and v <= x["clear_threshold"] + 1e-9 else "0" for v in c]
        longest = max(map(len, "".join(clear).split("0")))
        assert (x["usable"], x["label"]) == (longest >= x["min_run"], f"{x['clear_threshold']:g}/{x['min_run']}")
        assert (x["frac_clear"], x["longest_clear_run_frac"], x["mean_cover"]) == pytest.approx((clear.count("1") / len(known), longest / 9, sum(known) / len(known)))


def test_hours_of_a_night(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    w = spark.createDataFrame([("s", D0, at(18.5), at(22))], "site string, night_date date, dusk timestamp, dawn timestamp")
    f = spark.createDataFrame([("s", "gfs", 1, at(19), 0.1), ("s", "ecmwf", 1, at(19), 0.5), ("s", "ecmwf", 2, at(19), 0.5), ("s", "gfs", 2, at(20), 0.9)], "site string, model string, lead int, hour timestamp, cover double")
    rows = {(r["lead"], r["hour"].hour): r for r in H.hour_rows(w, f, {"gfs": (1, 2), "ecmwf": (1,)}, (1, 2)).collect()}
    assert set(rows) == {(d, h) for d in (1, 2) for h in (19, 20, 21, 22)}
    a = rows[1, 19]
    assert (a["mean_cover"], a["spread_cover"], a["share_clear"]) == pytest.approx((0.3, 0.2, 0.5))
    assert rows[2, 19]["mean_cover"] is None and rows[2, 20]["share_clear"] == 0.0 and rows[1, 22]["night_position"] == 1.0
