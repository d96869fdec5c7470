"""Queries over the model operators: folds, tuned blends, hold-outs, prediction, artifact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightfold.operators import models as M, nights as N, timeseries as S, verify as V
from nightfold.functions.timefn import hours_inside
from nightfold.plans.catalog_verify import NIGHT, RESAMPLES, SEED, predictions
from nightfold.plans.derived import BASE, FULL, MODELS, R, as_ts, big, dataset, hourly_base, r6, series, table, text, windows, with_
from nightfold.plans.registry import query

FEATS = ["quantity", "price", "discount", "tax"]
KEYS, TYPES = ["lead"], ["int"]


def shipments(spark, sf):
    """Line items as a learning table: three leads, four inputs (one with gaps), a noisy label, a group."""
    li = table(spark, sf, "lineitem")
    return li.select(
        (1 + F.col("l_linenumber") % 3).cast("int").alias("lead"), F.to_date("l_shipdate").alias("day"), F.col("l_linestatus").alias("group"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 10000).alias("price"),
        F.when(F.col("l_tax") < 0.07, F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"),
        ((F.col("l_quantity") + F.col("l_partkey") * 37 % 50 + F.col("l_discount") * 100) > 55).cast("int").alias("y"),
    )


SHIP = """sp AS (SELECT CAST(1 + l_linenumber % 3 AS INTEGER) AS lead, CAST(l_shipdate AS DATE) AS day, l_linestatus AS grp, l_quantity AS quantity, l_extendedprice / 10000 AS price, CASE WHEN l_tax < 0.07 THEN l_discount END AS discount, l_tax AS tax,
  CASE WHEN l_quantity + l_partkey * 37 % 50 + l_discount * 100 > 55 THEN 1 ELSE 0 END AS y FROM lineitem)"""


@query("date_folds", "M2", with_(SHIP) + """, d AS (SELECT lead, day, row_number() OVER (PARTITION BY lead ORDER BY day) - 1 AS r, count(*) OVER (PARTITION BY lead) AS n FROM (SELECT DISTINCT lead, day FROM sp)),
  f AS (SELECT DISTINCT lead, n, unnest(range(4)) AS fold FROM d), g AS (SELECT lead, fold, n - (4 - fold) * (n // 5) AS a, n - (4 - fold) * (n // 5) + n // 5 AS b FROM f)
  SELECT g.lead, CAST(fold AS BIGINT) AS fold, CAST(x.day AS VARCHAR) AS val_from, CAST(y.day AS VARCHAR) AS val_before FROM g JOIN d x ON x.lead = g.lead AND x.r = g.a LEFT JOIN d y ON y.lead = g.lead AND y.r = g.b""")
def date_folds(spark, sf):
    f = M.date_folds(shipments(spark, sf), ["lead"], "day", 4)
    return f.select("lead", big("fold").alias("fold"), F.col("val_from").cast("string").alias("val_from"), F.col("val_before").cast("string").alias("val_before"))


@query("expanding_months", "W14", with_(SHIP) + "SELECT DISTINCT lead, strftime(day, '%Y-%m') AS period, CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS month_start, CAST(CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS month_end FROM sp WHERE date_trunc('month', day) >= DATE '2000-01-01'")
def expanding_months(spark, sf):
    m = M.expanding_months(shipments(spark, sf), ["lead"], "day", "2000-01-01")
    return m.select("lead", "period", F.col("month_start").cast("string").alias("month_start"), F.col("month_end").cast("string").alias("month_end"))


def _artifact_rows(spark, arts):
    return M.artifact_frame(spark, arts, KEYS, TYPES)


@query("tuned_logistic", "M3 M4 M18")
def tuned_logistic(spark, sf):
    arts = M.fit_logistic_grid(shipments(spark, sf), KEYS, FEATS, "y", "day")
    return M.artifact_summary(_artifact_rows(spark, arts), KEYS)


@query("calibrated_blend", "M18 M19")
def calibrated_blend(spark, sf):
    rows = shipments(spark, sf)
    arts = M.fit_logistic_grid(rows, KEYS, FEATS, "y", "day")
    oof = M.out_of_fold(rows, KEYS, TYPES, FEATS, "y", "day", arts)
    arts = M.calibrate(oof, KEYS, "y", arts, threshold=0.02)
    return spark.createDataFrame([(a["keys"]["lead"], a["oof_ece"], a["n_oof"], a["applied"], len(a["isotonic_x"])) for a in arts], "lead string, oof_ece double, n_oof long, applied boolean, knots int")


@query("held_out_groups", "M22 M23")
def held_out_groups(spark, sf):
    rows = shipments(spark, sf)
    p = M.leave_group_out(rows, rows, KEYS, TYPES, FEATS, "y", "day", "group")
    return p.groupBy("lead", "group").agg(F.count("*").alias("n"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))


@query("walk_forward_skill", "M25 Q14")
def walk_forward_skill(spark, sf):
    rows = shipments(spark, sf).withColumn("p_climatology", F.lit(0.5))
    p = M.walk_forward(rows, KEYS, TYPES, FEATS, "y", "day", "2001-06-01")
    return M.monthly_skill(p, ["lead"], ["p"])


# A fixed model (parameters, not data), for comparing prediction with plain SQL.
FIXED = {
    "keys": {"lead": 1}, "split": "all", "exclude": None, "inputs": FEATS, "medians": [25.0, 4.0, 0.05, 0.04], "indicators": [2],
    "output_features": [*FEATS, "missing_discount"], "mean": [25.0, 4.0, 0.05, 0.04, 0.2], "scale": [14.0, 3.0, 0.03, 0.02, 0.4],
    "coef": [1.2, -0.3, 0.4, 0.05, -0.1], "intercept": 0.2, "c": 1.0, "cv_log_loss": 0.5, "n_train": 100, "base_rate": 0.5,
    "train_start": "1995-01-01", "train_end": "1999-12-31", "isotonic_x": [0.1, 0.4, 0.9], "isotonic_y": [0.05, 0.45, 0.95],
}


def fixed_models(spark):
    plain = {**FIXED, "keys": {"lead": 2}, "isotonic_x": [], "isotonic_y": [], "coef": [0.6, 0.6, 0.1, -0.2, 0.3], "train_end": "2000-06-30", "cv_log_loss": 0.4}
    return _artifact_rows(spark, [FIXED, plain])


def _lin(w):
    z = [f"(coalesce({f}, {m}) - {mu}) / {sd} * {c}" for f, m, mu, sd, c in zip(FEATS, FIXED["medians"], FIXED["mean"], FIXED["scale"], w)]
    return " + ".join(["0.2", *z, f"((CASE WHEN discount IS NULL THEN 1.0 ELSE 0.0 END) - 0.2) / 0.4 * {w[4]}"])


@query("artifact_prediction", "M5 P21", with_(SHIP) + f""", q AS (SELECT *, CASE lead WHEN 1 THEN 1 / (1 + exp(-({_lin(FIXED['coef'])}))) WHEN 2 THEN 1 / (1 + exp(-({_lin([0.6, 0.6, 0.1, -0.2, 0.3])}))) END AS q FROM sp),
  p AS (SELECT *, CASE WHEN lead <> 1 THEN q WHEN q < 0.1 THEN 0.05 WHEN q >= 0.9 THEN 0.95 WHEN q >= 0.4 THEN 0.45 + (0.95 - 0.45) * (q - 0.4) / (0.9 - 0.4) ELSE 0.05 + (0.45 - 0.05) * (q - 0.1) / (0.4 - 0.1) END AS p FROM q)
  SELECT lead, grp AS "group", CAST(day AS VARCHAR) AS day, count(*) AS n, {R('sum(p)')} AS total_p FROM p GROUP BY ALL""")
def artifact_prediction(spark, sf):
    p = M.predict(shipments(spark, sf), fixed_models(spark), FEATS, ["lead"])
    return p.groupBy("lead", "group", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), r6(F.sum("p")).alias("total_p"))


@query("spread_quantile", "M18", with_(SHIP) + f"SELECT lead, {R('quantile_cont(price, 0.75)')} AS spread_threshold FROM sp GROUP BY lead")
def spread_quantile(spark, sf):
    return M.spread_threshold(shipments(spark, sf), ["lead"], "price").select("lead", r6("spread_threshold").alias("spread_threshold"))


@query("equal_weight_forecast", "P12", with_(*FULL) + f"SELECT site, {NIGHT}, lead, {R('CASE WHEN lead <= 5 AND gfs_frac_clear IS NOT NULL AND ecmwf_frac_clear IS NOT NULL THEN (gfs_frac_clear + ecmwf_frac_clear) / 2 ELSE coalesce(gfs_frac_clear, ecmwf_frac_clear) END')} AS equal_weight, {R('nbm_frac_clear')} AS nbm_raw, CAST(nbm_pred_usable AS DOUBLE) AS nbm_rule FROM dat")
def equal_weight_forecast(spark, sf):
    d = dataset(spark, sf)
    return d.select("site", text("night_date").alias("night_date"), "lead", r6(N.mean_present([F.col(f"{m}_frac_clear") for m in MODELS])).alias("equal_weight"),
                    r6("nbm_frac_clear").alias("nbm_raw"), F.col("nbm_pred_usable").cast("double").alias("nbm_rule"))


@query("best_single_method", "M17", with_("""p AS (SELECT CAST(1 + o_custkey % 3 AS INTEGER) AS lead, o_orderpriority AS method, avg(o_totalprice) / 1e6 AS loss FROM orders GROUP BY ALL)""") + "SELECT lead, arg_min(method, (loss, method)) AS best_single FROM p GROUP BY lead")
def best_single_method(spark, sf):
    o = table(spark, sf, "orders").groupBy((1 + F.col("o_custkey") % 3).cast("int").alias("lead"), F.col("o_orderpriority").alias("method")).agg((F.avg("o_totalprice") / 1e6).alias("cv_log_loss"))
    return M.best_single(o, ["lead"])


def _ship_sql():
    from nightfold.plans.catalog_verify import PRE, WEIGHTS

    return with_(PRE, WEIGHTS) + """, w AS (SELECT label, lead, method, week, count(*) AS n, sum((p - y) * (p - y)) AS sq FROM pre GROUP BY ALL),
  bo AS (SELECT x.label, x.lead, x.week, x.n AS na, x.sq AS sa, z.n AS nb, z.sq AS sb FROM w x JOIN w z ON x.method = 'climatology' AND z.method = 'blend' AND z.label = x.label AND z.lead = x.lead AND z.week = x.week),
  bt AS (SELECT o.label, o.lead, r, sum(sa * t.w) / sum(na * t.w) - sum(sb * t.w) / sum(nb * t.w) AS d FROM bo o JOIN wt t ON t.label = o.label AND t.lead = o.lead AND t.week = o.week GROUP BY ALL),
  d AS (SELECT lead, quantile_cont(d, 0.025) AS lo FROM bt GROUP BY lead)
  SELECT list_sort(coalesce(list(lead) FILTER (lo > 0), [])) AS worse_at_leads, CASE WHEN count(*) FILTER (lo > 0) > 0 THEN 'geo_airports' ELSE 'statewide_loro' END AS method FROM d"""


@query("shipping_decision", "M24", _ship_sql())
def shipping_decision(spark, sf):
    """The challenger goes out unless it is significantly worse at any lead, by the paired week-block interval."""
    pair = spark.createDataFrame([("climatology", "blend")], "a string, b string")
    return M.shipping_decision(V.paired(predictions(spark, sf), pair, RESAMPLES, SEED))


@query("weight_shares", "F25 Q13", None)
def weight_shares(spark, sf):
    d = dataset(spark, sf).filter("usable_era5 is not null").withColumn("y", F.col("usable_era5").cast("int"))
    feats = [f"{m}_{f}" for m in MODELS for f in N.MODEL_INPUTS]
    arts = M.fit_logistic_grid(d, ["lead"], feats, "y", "night_date")
    return M.weight_shares(_artifact_rows(spark, arts), ["lead"], list(MODELS))


@query("largest_coefficients", "O10 M36 Q13", None)
def largest_coefficients(spark, sf):
    arts = M.fit_logistic_grid(shipments(spark, sf), KEYS, FEATS, "y", "day")
    return M.largest_coefficients(_artifact_rows(spark, arts), ["lead"], 12)


@query("trained_before_test", "M1", with_(SHIP) + "SELECT lead, CAST(max(day) AS VARCHAR) AS train_end FROM sp GROUP BY lead HAVING CAST(max(day) AS VARCHAR) >= '2001-08-01'")
def trained_before_test(spark, sf):
    ends = shipments(spark, sf).groupBy("lead").agg(F.max("day").cast("string").alias("train_end"))
    return M.trained_before(ends, "2001-08-01")


THR, RUNS = (0.10, 0.20, 0.30), (2, 3, 4)
GRID = " UNION ALL ".join(
    f"""SELECT site, night_date, {t}::DOUBLE AS clear_threshold, {r} AS min_run, CASE WHEN 1 - sum(v) / sum(h) <= 0.6 THEN max(c) >= {r} END AS usable FROM (SELECT site, night_date, block, count(*) AS h, count(cover) AS v, sum(clear) AS c FROM
  (SELECT *, sum(1 - clear) OVER (PARTITION BY site, night_date ORDER BY hour ROWS UNBOUNDED PRECEDING) AS block FROM (SELECT *, CASE WHEN cover <= {t} + 1e-9 THEN 1 ELSE 0 END AS clear FROM gh)) GROUP BY ALL) GROUP BY site, night_date"""
    for t in THR for r in RUNS
)


@query("definition_grid", "P20", with_(*BASE, "gh AS (SELECT b.site, b.night_date, b.hour, s.cover FROM bb b LEFT JOIN (SELECT * FROM ser WHERE source = 'era5') s USING (site, hour))") + f""", g AS ({GRID})
  SELECT site, clear_threshold, min_run, count(usable) AS labelled, {R('avg(CAST(usable AS DOUBLE))')} AS base_rate FROM g GROUP BY ALL""")
def definition_grid(spark, sf):
    base = hourly_base(spark, sf)
    w = windows(spark, sf, base).withColumn("n_hours", hours_inside(as_ts("dusk"), as_ts("dawn"))).filter("n_hours > 0")
    h = S.attach_windows(series(spark, sf, base).filter("source = 'era5'"), w, ["site"], "night_date", "dusk", "dawn").join(w.select("site", "night_date", "n_hours"), ["site", "night_date"])
    g = M.definition_grid(h, ["site", "night_date"], "cover", "n_hours", THR, RUNS, 0.6)
    return g.groupBy("site", "clear_threshold", "min_run").agg(F.count("usable").alias("labelled"), r6(F.avg(F.col("usable").cast("double"))).alias("base_rate"))


HOURLY = f"""hm AS (SELECT b.site, b.hour, avg(s.cover) AS mean_cover, CASE WHEN count(s.cover) >= 2 THEN stddev_pop(s.cover) END AS spread_cover, avg(CASE WHEN s.cover <= 0.2 + 1e-9 THEN 1.0 WHEN s.cover IS NOT NULL THEN 0.0 END) AS share
  FROM bb b LEFT JOIN (SELECT * FROM ser WHERE source IN ('gfs', 'ecmwf', 'goes')) s USING (site, hour) GROUP BY ALL)"""


@query("hourly_model_rows", "A17 A30", with_(*BASE, HOURLY) + f"SELECT site, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, {R('mean_cover')} AS mean_cover, {R('spread_cover')} AS spread_cover, {R('share')} AS share_clear FROM hm")
def hourly_model_rows(spark, sf):
    from nightfold.operators.forecast import hourly_rows

    base = hourly_base(spark, sf)
    h = hourly_rows(windows(spark, sf, base), series(spark, sf, base).withColumnRenamed("source", "model"), ["gfs", "ecmwf", "goes"])
    return h.select("site", text("hour").alias("hour"), r6("mean_cover").alias("mean_cover"), r6("spread_cover").alias("spread_cover"), r6("share_clear").alias("share_clear"))
