from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightfold.operators import verify as V
from nightfold.util import exact_quantiles, ranked_cumsum

D0 = dt.date(2024, 1, 1)
SCHEMA = "label string, lead int, site string, night_date date, season string, y int, method string, kind string, family string, p double"


def preds(n=400, seed=3, method="blend"):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(0.3 * y + 0.7 * rng.random(n), 0, 1), 2)
    rows = [("primary", 1, f"s{i % 3}", D0 + dt.timedelta(days=int(i % 120)), "DJF", int(y[i]), method, "prob", method, float(p[i])) for i in range(n)]
    return rows, y, p


def weeks_of(rows):
    codes = np.array([r[3].isocalendar()[0] * 100 + r[3].isocalendar()[1] for r in rows])
    return np.unique(codes, return_inverse=True)


def brute_auc(y, p, w):
    pos, neg = y == 1, y == 0
    gt = (p[pos][:, None] > p[neg][None, :]) + 0.5 * (p[pos][:, None] == p[neg][None, :])
    return float((w[pos][:, None] * w[neg][None, :] * gt).sum() / (w[pos].sum() * w[neg].sum()))


def test_auc_equals_pair_count(spark):
    rows, y, p = preds()
    got = V.auc(spark.createDataFrame(rows, SCHEMA), ["label"]).first()["auc"]
    assert got == pytest.approx(brute_auc(y, p, np.ones(len(y))), abs=1e-12)


def test_bootstrap_matches_weighted_rows(spark):
    rows, y, p = preds()
    df = spark.createDataFrame(rows, SCHEMA)
    _, code = weeks_of(rows)
    counts = V.md5_week_counts(int(code.max()) + 1, 40, 11)
    w = counts[:, code]
    brier = (w * (p - y) ** 2).sum(axis=1) / w.sum(axis=1)
    lo, hi = np.percentile(brier, [2.5, 97.5])
    rec = V.score(df, resamples=40, seed=11, reference="blend").filter("subset_type = 'overall'").first()
    assert rec["brier"] == pytest.approx(float(np.mean((p - y) ** 2)))
    assert (rec["brier_lo"], rec["brier_hi"]) == (pytest.approx(lo), pytest.approx(hi))
    aucs = [brute_auc(y, p, r) for r in w]
    ci = V.bootstrap_auc(df, ["label", "lead", "method"], 40, 11).first()
    assert (ci["auc_lo"], ci["auc_hi"]) == tuple(pytest.approx(v, abs=1e-9) for v in np.percentile(aucs, [2.5, 97.5]))


def test_too_few_weeks_gives_no_interval(spark):
    rows, _, _ = preds(30)
    rows = [(*r[:3], D0, *r[4:]) for r in rows]
    rec = V.score(spark.createDataFrame(rows, SCHEMA), resamples=10, reference="blend").filter("subset_type = 'overall'").first()
    assert rec["n_weeks"] == 1 and rec["brier"] is not None and rec["brier_lo"] is None


def test_paired_against_itself_is_zero(spark):
    a, _, _ = preds(method="a")
    b, _, _ = preds(method="b")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    d = V.paired(spark.createDataFrame(a + b, SCHEMA), pairs, 20, 1).first()
    assert d["brier_diff"] == 0 and d["significant"] is False and d["share_a_better"] == 0


def test_bins_use_the_exact_edges(spark):
    ps = [0.0, 0.1, 0.3, 0.6, 0.7, 0.9999, 1.0]
    got = [r["b"] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(V.bin_of(F.col("p")).alias("b")).collect()]
    assert got == [int(i) for i in np.clip(np.digitize(ps, np.linspace(0, 1, 11)[1:-1]), 0, 9)]


def test_decomposition_adds_up(spark):
    rows, y, p = preds()
    d = V.brier_decomposition(spark.createDataFrame(rows, SCHEMA), ["method"]).first()
    assert d["reliability"] - d["resolution"] + d["uncertainty"] + d["binning_residual"] == pytest.approx(float(np.mean((p - y) ** 2)))


def test_relative_value_is_one_for_a_perfect_forecast(spark):
    rows, y, _ = preds()
    perfect = [(*r[:9], float(r[5])) for r in rows]
    v = V.relative_value(spark.createDataFrame(perfect, SCHEMA), ["method"]).collect()
    assert all(r["value"] == pytest.approx(1.0) for r in v)


def test_persistence_is_by_date_not_by_row(spark):
    rows = [("a", D0, 1, True), ("a", D0 + dt.timedelta(days=2), 1, False), ("a", D0 + dt.timedelta(days=3), 1, None)]
    d = spark.createDataFrame(rows, "site string, night_date date, lead int, y boolean")
    out = {r["night_date"]: r["persistence"] for r in V.persistence(d, d, "y").collect()}
    assert out[D0 + dt.timedelta(days=2)] is None and out[D0 + dt.timedelta(days=3)] is False


def test_unseen_month_falls_back_to_site_mean(spark):
    t = spark.createDataFrame([("a", 1, 0.2, 10), ("a", 2, 0.6, 5)], "site string, month int, rate double, n long")
    r = spark.createDataFrame([("a", 1), ("a", 7)], "site string, month int")
    got = {x["month"]: x["p_climatology"] for x in V.apply_climatology(r, t).collect()}
    assert got[1] == 0.2 and got[7] == pytest.approx(0.4)


def test_leak_check_needs_strict_order(spark):
    d = spark.createDataFrame([(D0, "train"), (D0, "test")], "night_date date, split string")
    assert V.leak_check(d).count() == 1


@pytest.mark.parametrize("hot", [False, True])
def test_quantiles_and_running_counts_are_exact(spark, hot):
    rng = np.random.default_rng(1)
    v = np.where(rng.random(3000) < 0.4, 0.5, rng.random(3000) ** 6) if hot else rng.random(3000)
    d = spark.createDataFrame([("k", float(x)) for x in v], "k string, v double")
    q = exact_quantiles(d, ["k"], "v", {"a": 0.025, "b": 0.5, "c": 0.95}).first()
    assert (q["a"], q["b"], q["c"]) == tuple(pytest.approx(x) for x in np.percentile(v, [2.5, 50, 95]))
    ranks = {r["v"]: r["n_below"] for r in ranked_cumsum(d.withColumn("n", F.lit(1)), ["k"], "v", ["n"]).collect()}
    s = np.sort(v)
    assert all(ranks[float(x)] == np.searchsorted(s, x, side="left") for x in np.unique(v)[::37])


def test_forward_scores_need_every_row(spark):
    from nightfold.operators.forecast import score_forward

    rows = [("a", D0, 1, True, 0.8, 0.9, 0.5), ("a", D0, 2, False, 0.2, None, 0.5)]
    v = spark.createDataFrame(rows, "site string, night_date date, lead int, y boolean, p double, b double, c double")
    got = {(r["method"], r["lead"]) for r in score_forward(v, {"blend": "p", "bench": "b", "climatology": "c"}, "y").collect()}
    assert ("bench", 1) in got and ("bench", 2) not in got and ("bench", None) not in got and ("blend", None) in got


def test_ranges_follow_a_hot_key(spark):
    """A key with nine tenths of the rows gets most of the ranges, more with more rows; sums and quantiles stay exact."""
    from nightfold.util import exact_quantiles, place_in_ranges, ranked_cumsum

    conf = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        ranges = {}
        for n in (900, 9000):
            rows = [("hot", float((i * 7919) % n)) for i in range(n)] + [(f"k{i % 50}", float(i)) for i in range(1000)]
            df = spark.createDataFrame(rows, "k string, v double")
            placed = place_in_ranges(df, ["k"], "v")
            spans = placed.filter("k = 'hot'").groupBy("_bucket").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("_bucket").collect()
            assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))
            ranges[n] = len(spans)
            sizes = [r["n"] for r in placed.groupBy("_bucket").agg(F.count("*").alias("n")).collect()]
            assert max(sizes) <= 3 * (n + 1000) / 20
        assert 5 <= ranges[900] < ranges[9000]
        got = ranked_cumsum(df.withColumn("m", F.lit(1)), ["k"], "v", ["m"]).filter("k = 'hot'").collect()
        assert {r["v"]: r["m_below"] for r in got} == {float(i): i for i in range(9000)}
        q = {r["k"]: r["m"] for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
        assert q["hot"] == 4499.5 and q["k7"] == 482.0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_auc_replicates_take_slices_of_rows():
    """Many weeks behind every score: memory follows the slice, not scores times weeks."""
    import tracemalloc

    rnd = np.random.default_rng(4)
    weeks, scores, replicates = 300, 200, 200
    counts = rnd.integers(0, 3, (replicates, weeks)).astype(float)
    p, i = np.repeat(np.arange(scores) / scores, weeks), np.tile(np.arange(weeks), scores)
    pos, neg = rnd.integers(0, 4, len(p)).astype(float), rnd.integers(0, 4, len(p)).astype(float)
    tracemalloc.start()
    won, total_pos, total_neg = V.auc_sums(counts, p, i, pos, neg)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * V.SLICE * replicates * 8 < counts[:, i].nbytes
    gp, gn = ((counts @ m.reshape(scores, weeks).T) for m in (pos, neg))
    assert np.array_equal(won, (gp * (np.cumsum(gn, axis=1) - gn / 2)).sum(axis=1))
    assert np.array_equal(total_pos, gp.sum(axis=1)) and np.array_equal(total_neg, gn.sum(axis=1))
