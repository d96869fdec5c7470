from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightfold.operators import models as M

D0 = dt.date(2024, 1, 1)
FEATS = ["a", "b"]


def table(n=300, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 30.0] + [0.0, 100.0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.03 * (x[:, 1] - 100))))).astype(int)
    x[rng.random(n) < 0.15, 1] = np.nan
    rows = [(1, f"g{i % 3}", D0 + dt.timedelta(days=i // 5), None if np.isnan(x[i, 0]) else float(x[i, 0]), None if np.isnan(x[i, 1]) else float(x[i, 1]), int(y[i])) for i in range(n)]
    return rows, x, y


SCHEMA = "lead int, grp string, day date, a double, b double, y int"


def fit_dense(x, y, c):
    """The same model by a plain Newton solve on one array."""
    gaps = np.isnan(x)
    med = np.nanmedian(x, axis=0)
    cols = np.flatnonzero(gaps.any(axis=0))
    z = np.hstack([np.where(gaps, med, x), gaps[:, cols].astype(float)])
    mean, sd = z.mean(axis=0), z.std(axis=0)
    z = np.hstack([(z - mean) / np.where(sd == 0, 1, sd), np.ones((len(z), 1))])
    pen = np.r_[np.ones(z.shape[1] - 1), 0.0]
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(c * (z.T * (p * (1 - p))) @ z + np.diag(pen), c * z.T @ (p - y) + pen * beta)
    return med, beta


def test_logistic_matches_a_dense_solve(spark):
    rows, x, y = table()
    a = M.fit_logistic_grid(spark.createDataFrame(rows, SCHEMA), ["lead"], FEATS, "y", "day", folds=3, c_grid=(0.1,))[0]
    med, beta = fit_dense(x, y, 0.1)
    assert a["medians"] == pytest.approx(list(med)) and a["indicators"] == [1]
    assert [*a["coef"], a["intercept"]] == pytest.approx(list(beta), abs=1e-7)


def test_c_is_chosen_by_expanding_folds(spark):
    rows, x, y = table()
    grid = (0.001, 0.1, 10.0)
    a = M.fit_logistic_grid(spark.createDataFrame(rows, SCHEMA), ["lead"], FEATS, "y", "day", folds=3, c_grid=grid)[0]
    day = np.array([r[2].toordinal() for r in rows])
    days = np.unique(day)
    size = len(days) // 4
    want = {}
    for c in grid:
        losses = []
        for i in range(3):
            start = len(days) - (3 - i) * size
            tr, va = day < days[start], (day >= days[start]) & (day < (days[start + size] if start + size < len(days) else 10**9))
            xt = x[tr]
            gaps = np.isnan(xt)
            med, beta = fit_dense(xt, y[tr], c)
            cols = np.flatnonzero(gaps.any(axis=0))
            z0 = np.hstack([np.where(gaps, med, xt), gaps[:, cols].astype(float)])
            gv = np.isnan(x[va])
            zv = np.hstack([np.where(gv, med, x[va]), gv[:, cols].astype(float)])
            zv = np.hstack([(zv - z0.mean(axis=0)) / z0.std(axis=0), np.ones((va.sum(), 1))])
            p = np.clip(1 / (1 + np.exp(-zv @ beta)), 1e-3, 1 - 1e-3)
            losses.append(float(np.mean(-(y[va] * np.log(p) + (1 - y[va]) * np.log(1 - p)))))
        want[c] = np.mean(losses)
    assert a["cv_scores"] == pytest.approx(want, abs=1e-7) and a["c"] == M.choose_c(want)


def test_near_ties_take_the_more_regularised():
    assert M.choose_c({0.1: 0.50005, 1.0: 0.5, 10.0: 0.5}, 1e-4) == 0.1


def test_prediction_rebuilds_the_model(spark):
    rows, x, y = table()
    df = spark.createDataFrame(rows, SCHEMA)
    arts = M.fit_logistic_grid(df, ["lead"], FEATS, "y", "day", folds=3, c_grid=(0.1,))
    p = M.predict(df, M.artifact_frame(spark, arts, ["lead"], ["int"]), FEATS, ["lead"])
    a = arts[0]
    gaps = np.isnan(x)
    z = np.hstack([np.where(gaps, a["medians"], x), gaps[:, a["indicators"]].astype(float)])
    want = 1 / (1 + np.exp(-((z - a["mean"]) / a["scale"] @ a["coef"] + a["intercept"])))
    assert sorted(r["p"] for r in p.collect()) == pytest.approx(sorted(want))


def test_isotonic_map_is_linear_between_knots_and_flat_outside(spark):
    base = {"keys": {"lead": 1}, "split": "all", "exclude": None, "inputs": ["a"], "medians": [0.0], "indicators": [], "output_features": ["a"], "mean": [0.0], "scale": [1.0],
            "coef": [1.0], "intercept": 0.0, "c": 1.0, "cv_log_loss": 0.0, "n_train": 1, "base_rate": 0.5, "train_start": "", "train_end": "", "isotonic_x": [0.25, 0.75], "isotonic_y": [0.1, 0.9]}
    xs = np.array([-5.0, -0.5, 0.0, 0.7, 5.0])
    df = spark.createDataFrame([(1, float(v)) for v in xs], "lead int, a double")
    got = [r["p"] for r in M.predict(df, M.artifact_frame(spark, [base], ["lead"], ["int"]), ["a"], ["lead"]).orderBy("a").collect()]
    assert got == pytest.approx(list(np.interp(1 / (1 + np.exp(-xs)), [0.25, 0.75], [0.1, 0.9])))


def test_held_out_group_never_reaches_its_own_model(spark):
    rows, _, _ = table()
    df = spark.createDataFrame(rows, SCHEMA)
    flipped = df.withColumn("y", F.when(F.col("grp") == "g1", 1 - F.col("y")).otherwise(F.col("y")))
    run = lambda d: M.leave_group_out(d, d, ["lead"], ["int"], FEATS, "y", "day", "grp", folds=2, c_grid=(0.1,)).filter("grp = 'g1'")
    pick = lambda d: sorted((r["day"], round(r["p"], 9)) for r in run(d).collect())
    assert pick(df) == pick(flipped)


def test_walk_forward_ignores_the_future(spark):
    rows, _, _ = table()
    df = spark.createDataFrame(rows, SCHEMA)
    late = df.withColumn("y", F.when(F.col("day") >= F.lit("2024-02-01").cast("date"), 1 - F.col("y")).otherwise(F.col("y")))
    run = lambda d: sorted(round(r["p"], 9) for r in M.walk_forward(d, ["lead"], ["int"], FEATS, "y", "day", "2024-02-01", folds=2, c_grid=(0.1,)).filter("period = '2024-02'").collect())
    assert run(df) == run(late) and run(df)


def test_calibration_is_applied_only_when_needed(spark):
    rows, _, _ = table()
    df = spark.createDataFrame(rows, SCHEMA)
    arts = M.fit_logistic_grid(df, ["lead"], FEATS, "y", "day", folds=3, c_grid=(1.0,))
    oof = M.out_of_fold(df, ["lead"], ["int"], FEATS, "y", "day", arts, folds=3)
    assert not M.calibrate(oof, ["lead"], "y", arts, threshold=1.0)[0]["applied"]
    a = M.calibrate(oof, ["lead"], "y", arts, threshold=0.0)[0]
    assert a["applied"] and a["isotonic_y"] == sorted(a["isotonic_y"])


def test_shipping_keeps_the_incumbent_when_worse(spark):
    d = spark.createDataFrame([(1, -0.01), (2, 0.002)], "lead int, lo double")
    r = M.shipping_decision(d).first()
    assert (r["method"], r["worse_at_leads"]) == ("geo_airports", [2])


def test_no_rows_give_no_models(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.fit_logistic_grid(empty, ["lead"], FEATS, "y", "day", folds=2, c_grid=(0.1,)) == []
    assert M.artifact_frame(spark, [], ["lead"], ["int"]).isEmpty()


def test_rows_meet_models_and_folds_without_a_shuffle_by_key(spark, monkeypatch):
    """With three keys a shuffle by key leaves all rows, or all values, to three tasks."""
    rows = spark.createDataFrame([(1 + i % 3, dt.date(2020, 1, 1 + i % 28), float(i % 7), int(i * 5 % 11 > 4)) for i in range(168)], "lead int, day date, x double, y int")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    merged = []
    quantiles = M.exact_quantiles
    monkeypatch.setattr(M, "exact_quantiles", lambda df, *a, **k: (merged.append(plan(df)), quantiles(df, *a, **k))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        arts = M.fit_logistic_grid(rows, ["lead"], ["x"], "y", "day", folds=2, c_grid=(0.1, 1.0))
        oof = plan(M.out_of_fold(rows, ["lead"], ["int"], ["x"], "y", "day", arts, folds=2))
        scored = plan(M.predict(rows, M.artifact_frame(spark, arts, ["lead"], ["int"]), ["x"], ["lead"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert merged and all("SortMergeJoin" not in p for p in merged)
    assert "Exchange hashpartitioning" not in scored and scored.count("BroadcastHashJoin") == 1
    assert oof.count("BroadcastHashJoin") >= 2
