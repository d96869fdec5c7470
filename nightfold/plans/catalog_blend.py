"""The blend end to end on the modelling table: all members and labels in one job, and one-input forms beside SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightfold.functions.timefn import hours_inside
from nightfold.operators import blend as B, hourly as H, sensitivity as S, timeseries as T, verify as V
from nightfold.operators.forecast import assemble
from nightfold.operators.models import spread_threshold
from nightfold.plans.catalog_fits import MAPPED
from nightfold.plans.catalog_forecast import UPC, VER, nights_ahead
from nightfold.plans.catalog_quality import PT, records
from nightfold.plans.catalog_time import MED, _median_hours, first_longest, island_sql
from nightfold.plans.catalog_verify import BIN_SQL, NIGHT, PRE, REF, RESAMPLES, SEED, SUB, WEIGHTS
from nightfold.plans.derived import (
    BENCHMARKS, FC, FULL, LEADS, MODELS, R, REP, SER, SITES, TEST, TRAIN, WIN, as_ts, big, dataset, forecasts, hourly_base, r6, runs_sql, series, text, windows,
)
from nightfold.plans.fit_sql import fit_ctes, isotonic_ctes, model_p, recursive
from nightfold.plans.registry import query
from nightfold.util import cut_lineage

MEMBERS = B.Members(MODELS, BENCHMARKS, SITES)
FIRST = ["gfs_frac_clear"]
EACH = ["gfs_frac_clear", "ecmwf_frac_clear", "nbm_frac_clear", "ew_frac_clear"]
ECE = 0.05
CASE = ["label", "lead"]

LABELLED = """lb AS (SELECT *, unnest([{'label': 'primary', 'y': usable_primary}, {'label': 'asos', 'y': usable_asos}, {'label': 'era5', 'y': usable_era5}, {'label': 'goes', 'y': usable_goes}]) AS u FROM dat)"""


def fitted_geo(spark, d):
    """The site-agnostic blend on the first model's clear share alone, with imputation, tuning and calibration."""
    long = B.member_rows(d, MEMBERS, ["geo"], FIRST)
    return long, B.fit(spark, long, FIRST, threshold=ECE)


#: The same in SQL, up to (label, lead, site, night_date, p) in `geo`.
GEO = (
    LABELLED,
    "lng AS MATERIALIZED (SELECT u.label AS label, lead, site, night_date, split, gfs_frac_clear AS x, CAST(u.y AS INTEGER) AS y FROM lb WHERE n_models_available > 0)",
    "src AS (SELECT label, lead, CAST(night_date AS DATE) AS day, site AS grp, x, y FROM lng WHERE split = 'train' AND y IS NOT NULL)",
    *fit_ctes("src", CASE),
    f"oof AS (SELECT s.label, s.lead, {model_p('s', 'f')} AS p, s.y FROM src s JOIN fold f ON f.label = s.label AND f.lead = s.lead WHERE s.day >= f.val_from AND (f.val_before IS NULL OR s.day < f.val_before))",
    f"bn AS (SELECT label, lead, {BIN_SQL} AS bin, count(*) AS n, avg(p) AS f, avg(y) AS o FROM oof GROUP BY ALL)",
    "ec AS MATERIALIZED (SELECT label, lead, sum(n) AS n_oof, sum(n * abs(o - f)) / sum(n) AS ece FROM bn GROUP BY ALL)",
    *isotonic_ctes("oof", CASE),
    f"raw AS MATERIALIZED (SELECT s.label, s.lead, s.x, {model_p('s', 'm')} AS q FROM (SELECT DISTINCT label, lead, x FROM lng) s JOIN model m ON m.label = s.label AND m.lead = s.lead)",
    MAPPED.replace("r.lead, r.x", "r.label, r.lead, r.x").replace("raw r JOIN ec USING (lead)", "raw r LEFT JOIN ec ON ec.label = r.label AND ec.lead = r.lead").replace("i.lead = r.lead", "i.label = r.label AND i.lead = r.lead"),
    f"pm AS MATERIALIZED (SELECT label, lead, x, CASE WHEN coalesce(ece, 0) <= {ECE} THEN q WHEN pa IS NULL THEN vb WHEN pb IS NULL THEN va ELSE va + (vb - va) * (q - pa) / (pb - pa) END AS p FROM mp)",
    "geo AS MATERIALIZED (SELECT l.*, pm.p FROM lng l JOIN pm ON pm.label = l.label AND pm.lead = l.lead AND pm.x IS NOT DISTINCT FROM l.x)",
)


@query("blend_one_input", "M18 M19 M5 P10 U1", recursive(*FULL, *GEO) + f"SELECT label, lead, site, {NIGHT}, split, y, {R('p')} AS p FROM geo")
def blend_one_input(spark, sf):
    long, fitted = fitted_geo(spark, cut_lineage(dataset(spark, sf)))
    p = B.predict(long, fitted)
    return p.select("label", "lead", "site", text("night_date").alias("night_date"), "split", "y", r6("p").alias("p"))


@query("final_fit_one_input", "M35 M36 M18", recursive(*FULL, *GEO) + f"""SELECT m.label, m.lead, {R('m.c')} AS c, {R('m.cv_log_loss')} AS cv_log_loss, CAST(m.n AS BIGINT) AS n_train, {R('m.b2')} AS intercept, {R('m.b0')} AS coef, {R('ec.ece')} AS oof_ece, coalesce(ec.ece, 0) > {ECE} AS calibrated, t.trained_on, CAST(len(string_split(t.trained_on, ',')) AS BIGINT) AS n_stations
  FROM model m LEFT JOIN ec ON ec.label = m.label AND ec.lead = m.lead JOIN (SELECT label, lead, string_agg(DISTINCT grp, ',' ORDER BY grp) AS trained_on FROM src GROUP BY ALL) t ON t.label = m.label AND t.lead = m.lead""")
def final_fit_one_input(spark, sf):
    long = B.member_rows(cut_lineage(dataset(spark, sf)), MEMBERS, ["geo"], FIRST)
    fitted, trained = B.final_fit(spark, long, FIRST, threshold=ECE)
    ece = spark.createDataFrame([(a["keys"]["label"], int(a["keys"]["lead"]), a["oof_ece"], a["applied"]) for a in fitted.artifacts], "label string, lead int, oof_ece double, calibrated boolean")
    t = fitted.table.join(trained, CASE).join(ece, CASE)
    return t.select("label", "lead", r6("c").alias("c"), r6("cv_log_loss").alias("cv_log_loss"), big("n_train").alias("n_train"), r6("intercept").alias("intercept"), r6(F.col("coef")[0]).alias("coef"),
                    r6("oof_ece").alias("oof_ece"), "calibrated", F.array_join("trained_on", ",").alias("trained_on"), big("n_stations").alias("n_stations"))


_ROWS = " UNION ALL ".join(
    f"SELECT u.label AS label, lead, '{m}_lr' AS variant, site, night_date, split, {m}_frac_clear AS x, CAST(u.y AS INTEGER) AS y FROM lb WHERE {m}_frac_clear IS NOT NULL AND {m}_longest_clear_run_frac IS NOT NULL AND {m}_mean_cover IS NOT NULL AND {'lead <= 5' if m == 'ecmwf' else 'TRUE'}"
    for m in ("gfs", "ecmwf", "nbm")
) + " UNION ALL SELECT u.label, lead, 'equal_weight_cal', site, night_date, split, CASE WHEN lead <= 5 THEN (gfs_frac_clear + ecmwf_frac_clear) / 2 ELSE gfs_frac_clear END, CAST(u.y AS INTEGER) FROM lb WHERE gfs_frac_clear IS NOT NULL AND (lead > 5 OR ecmwf_frac_clear IS NOT NULL)"
SINGLES = (LABELLED, f"lng AS MATERIALIZED ({_ROWS})", "src AS (SELECT label, lead, variant, CAST(night_date AS DATE) AS day, site AS grp, x, y FROM lng WHERE split = 'train' AND y IS NOT NULL)", *fit_ctes("src", B.KEYS))


def fitted_singles(spark, d):
    long = B.member_rows(d, MEMBERS, ["gfs_lr", "ecmwf_lr", "nbm_lr", "equal_weight_cal"], EACH)
    return long, B.fit(spark, long, EACH)


@query("member_models_one_input", "M15 M16 M4", recursive(*FULL, *SINGLES) + f"SELECT l.label, l.lead, l.variant, site, {NIGHT}, l.split, y, {R(model_p('l', 'm'))} AS p FROM lng l JOIN model m ON m.label = l.label AND m.lead = l.lead AND m.variant = l.variant")
def member_models_one_input(spark, sf):
    long, fitted = fitted_singles(spark, cut_lineage(dataset(spark, sf)))
    return B.predict(long, fitted).select(*B.KEYS, "site", text("night_date").alias("night_date"), "split", "y", r6("p").alias("p"))


@query("best_single_one_input", "M17 M15", recursive(*FULL, *SINGLES) + "SELECT label, lead, arg_min(variant, (coalesce(cv_log_loss, 'inf'::DOUBLE), variant)) AS best_single FROM model WHERE variant IN ('gfs_lr', 'ecmwf_lr') GROUP BY label, lead")
def best_single_one_input(spark, sf):
    _, fitted = fitted_singles(spark, cut_lineage(dataset(spark, sf)))
    return B.best_single(fitted, MEMBERS)


@query("blend_all_methods", "M18 M15 M16 M17 M19 P12 P21")
def blend_all_methods(spark, sf):
    """Every label, lead and variant with all inputs; the predictions of all methods on the rows they share."""
    d = cut_lineage(dataset(spark, sf))
    long = cut_lineage(B.member_rows(d, MEMBERS))
    fitted = B.fit(spark, long, MEMBERS.inputs, threshold=ECE)
    nights = d.filter("split = 'train'")
    rates = None
    for label, column in MEMBERS.labels.items():
        own = V.climatology(nights, column).withColumn("label", F.lit(label))
        rates = own if rates is None else rates.unionByName(own)
    p = B.all_methods(d, MEMBERS, B.predict(long, fitted), rates)
    return p.select("label", "lead", "site", text("night_date").alias("night_date"), "season", "y", "method", "kind", "family", r6("p").alias("p"))


# ---------- several truths ----------

PAIR_SQL = """w AS (SELECT label, lead, method, week, count(*) AS n, sum((p - y) * (p - y)) AS sq FROM pre GROUP BY ALL),
  bo AS MATERIALIZED (SELECT x.label, x.lead, x.week, x.method AS a, z.method AS b, x.n AS na, x.sq AS sa, z.n AS nb, z.sq AS sb FROM w x JOIN w z ON z.label = x.label AND z.lead = x.lead AND z.week = x.week WHERE {which}),
  bp AS (SELECT label, lead, a, b, sum(sa) / sum(na) - sum(sb) / sum(nb) AS d FROM bo GROUP BY ALL),
  bt AS (SELECT o.label, o.lead, a, b, r, sum(sa * t.w) / sum(na * t.w) - sum(sb * t.w) / sum(nb * t.w) AS d FROM bo o JOIN wt t ON t.label = o.label AND t.lead = o.lead AND t.week = o.week GROUP BY ALL),
  ci AS (SELECT label, lead, a, b, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM bt GROUP BY ALL),
  di AS (SELECT label, lead, a, b, d AS brier_diff, lo, hi, hi < 0 OR lo > 0 AS significant FROM bp JOIN ci USING (label, lead, a, b))"""
WEEK = "isoyear(night_date) * 100 + weekofyear(night_date) AS week"

CROSS = (
    "tru2 AS (SELECT DISTINCT u.label AS label, site, night_date, month, season, split, CAST(u.y AS INTEGER) AS y FROM lb WHERE u.y IS NOT NULL)",
    "cl2 AS (SELECT label, site, month, avg(y) AS rate FROM tru2 WHERE split = 'train' GROUP BY ALL)",
    f"""jd AS (SELECT t.label, g.lead, g.site, g.night_date, t.y, t.month, {WEEK.replace('night_date', 'g.night_date')}, 'blend_' || g.label AS method, CASE WHEN g.label = t.label THEN 'blend' ELSE 'cross_truth' END AS family, g.p FROM geo g JOIN tru2 t ON t.site = g.site AND t.night_date = g.night_date WHERE g.split = 'test')""",
    """pre AS MATERIALIZED (SELECT label, lead, site, night_date, y, week, method, family, p FROM jd UNION ALL SELECT j.label, j.lead, j.site, j.night_date, j.y, j.week, 'climatology', 'climatology', c.rate FROM
  (SELECT DISTINCT label, lead, site, night_date, y, month, week FROM jd) j JOIN cl2 c USING (label, site, month))""",
    WEIGHTS, PAIR_SQL.format(which="x.method LIKE 'blend_%' AND x.method <> 'blend_' || x.label AND z.method = 'blend_' || x.label"),
    "sc AS (SELECT label, lead, method, count(*) AS n, avg((p - y) * (p - y)) AS brier FROM pre GROUP BY ALL)",
)


@query("cross_truth_scores", "M20 Q13", recursive(*FULL, *GEO, *CROSS) + f"""SELECT s.label AS judged_by, s.lead, s.method, s.n, {R('s.brier')} AS brier, {R('1 - s.brier / c.brier')} AS bss, {R('d.brier_diff')} AS vs_own, {R('d.lo')} AS lo, {R('d.hi')} AS hi, d.significant
  FROM sc s JOIN sc c ON c.method = 'climatology' AND c.label = s.label AND c.lead = s.lead LEFT JOIN di d ON d.label = s.label AND d.lead = s.lead AND d.a = s.method WHERE s.method <> 'climatology'""")
def cross_truth_scores(spark, sf):
    d = cut_lineage(dataset(spark, sf))
    long, fitted = fitted_geo(spark, d)
    truths = d.select("site", "night_date", "month", "season", "split", F.inline(F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).cast("int").alias("y")) for k, c in MEMBERS.labels.items()]))).filter("y is not null").distinct()
    judged = cut_lineage(B.cross_truth(B.predict(long, fitted).filter("split = 'test'"), truths.drop("month", "split")))
    rates = truths.filter("split = 'train'").groupBy("label", "site", "month").agg(F.avg("y").alias("rate"))
    rows = judged.select("label", "lead", "site", "night_date", "season", "y").distinct().withColumn("month", F.month("night_date")).join(rates, ["label", "site", "month"])
    preds = judged.unionByName(V.to_predictions(rows, {"climatology": ("prob", "climatology", F.col("rate"))}, ["label", "lead", "site", "night_date", "season", "y"]))
    preds = cut_lineage(preds)
    s = V.score(preds, 0, SEED, by=()).filter("method <> 'climatology'").select(F.col("label"), "lead", "method", "n", "brier", "bss")
    methods = [f"blend_{k}" for k in MEMBERS.labels]
    pairs = spark.createDataFrame([(k, f"blend_{j}", f"blend_{k}") for k in MEMBERS.labels for j in MEMBERS.labels if j != k], "label string, a string, b string").filter(F.col("a").isin(methods))
    p = V.paired(preds, pairs, RESAMPLES, SEED).select("label", "lead", F.col("a").alias("method"), F.col("brier_diff").alias("vs_own"), "lo", "hi", "significant")
    out = s.join(p, ["label", "lead", "method"], "left")
    return out.select(F.col("label").alias("judged_by"), "lead", "method", big("n").alias("n"), *[r6(c).alias(c) for c in ("brier", "bss", "vs_own", "lo", "hi")], "significant")


# ---------- other definitions ----------

THR, RUNS = (0.10, 0.20, 0.30), (2, 3, 4)
TRAIN_END, TEST_DAYS = TRAIN[1], TEST


def _thresholds(rel: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {t}::DOUBLE AS thr, * FROM ({runs_sql(rel, keys, thr=str(t), miss='0.6')})" for t in THR)


SENS = (
    "gh AS MATERIALIZED (SELECT b.site, b.night_date, b.hour, s.cover FROM bb b LEFT JOIN (SELECT * FROM ser WHERE source = 'era5') s USING (site, hour))",
    f"lt AS ({_thresholds('gh', 'site, night_date')})",
    "rn AS (SELECT unnest([2, 3, 4]) AS run)",
    "ld AS (SELECT thr || '/' || run AS label, thr, run, site, night_date, CAST(longest_clear_run >= run AS INTEGER) AS y FROM lt, rn)",
    """fh AS MATERIALIZED (SELECT b.site, b.night_date, b.hour, l.lead, m.model, f.cover FROM bb b CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS lead) l CROSS JOIN (SELECT unnest(['gfs', 'ecmwf']) AS model) m
  LEFT JOIN fc f ON f.site = b.site AND f.model = m.model AND f.lead = l.lead AND f.hour = b.hour WHERE NOT (m.model = 'ecmwf' AND l.lead > 5))""",
    f"ft AS ({_thresholds('fh', 'site, night_date, lead, model')})",
    "fw AS (SELECT thr, site, night_date, lead, max(CASE WHEN model = 'gfs' THEN frac_clear END) AS g, max(CASE WHEN model = 'ecmwf' THEN frac_clear END) AS e FROM ft GROUP BY ALL)",
    "rw AS MATERIALIZED (SELECT ld.*, fw.lead, month(ld.night_date) AS month, g AS x, CASE WHEN g IS NOT NULL AND e IS NOT NULL THEN (g + e) / 2 ELSE coalesce(g, e) END AS ew, e FROM ld JOIN fw USING (thr, site, night_date))",
    f"src AS (SELECT label, lead, CAST(night_date AS DATE) AS day, site AS grp, x, y FROM rw WHERE night_date <= DATE '{TRAIN_END}' AND y IS NOT NULL AND (x IS NOT NULL OR e IS NOT NULL))",
    *fit_ctes("src", CASE),
    f"cl2 AS (SELECT label, site, month, avg(y) AS rate FROM (SELECT DISTINCT label, site, night_date, month, y FROM rw WHERE night_date <= DATE '{TRAIN_END}' AND y IS NOT NULL) GROUP BY ALL)",
    f"""te AS (SELECT r.label, r.lead, r.site, r.night_date, r.y, {WEEK}, c.rate, r.ew, {model_p('r', 'm')} AS p FROM rw r JOIN cl2 c USING (label, site, month) JOIN model m ON m.label = r.label AND m.lead = r.lead
  WHERE r.night_date BETWEEN DATE '{TEST_DAYS[0]}' AND DATE '{TEST_DAYS[1]}' AND r.y IS NOT NULL AND r.x IS NOT NULL AND (r.lead > 5 OR r.e IS NOT NULL))""",
    "pre AS MATERIALIZED (SELECT label, lead, week, y, 'climatology' AS method, rate AS p FROM te UNION ALL SELECT label, lead, week, y, 'blend', p FROM te UNION ALL SELECT label, lead, week, y, 'equal_weight', ew FROM te)",
    WEIGHTS, PAIR_SQL.format(which="x.method = 'blend' AND z.method = 'equal_weight'"),
    "sc AS (SELECT label, lead, method, count(*) AS n, avg(y) AS base_rate, avg((p - y) * (p - y)) AS brier, sum(CASE WHEN p >= 0.5 AND y = 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END), 0) AS fcr FROM pre GROUP BY ALL)",
)


@query("definition_scores", "M14 P20", recursive(REP, SER, WIN, FC, *SENS) + f"""SELECT s.label AS definition, s.lead, s.n, {R('s.base_rate')} AS base_rate, {R('s.brier')} AS brier, {R('1 - s.brier / c.brier')} AS bss, {R('s.fcr')} AS false_clear_rate, {R('d.brier_diff')} AS brier_diff, {R('d.lo')} AS lo, {R('d.hi')} AS hi, d.significant
  FROM sc s JOIN sc c ON c.method = 'climatology' AND c.label = s.label AND c.lead = s.lead JOIN di d ON d.label = s.label AND d.lead = s.lead WHERE s.method = 'blend'""")
def definition_scores(spark, sf):
    base = hourly_base(spark, sf)
    w = windows(spark, sf, base).withColumn("n_hours", hours_inside(as_ts("dusk"), as_ts("dawn"))).filter("n_hours > 0")
    sized = w.select("site", "night_date", "n_hours")
    attach = lambda s: T.attach_windows(s, w, ["site"], "night_date", "dusk", "dawn").join(sized, ["site", "night_date"])
    truth = S.definition_summaries(attach(series(spark, sf, base).filter("source = 'era5'")), ["site", "night_date"], "cover", "n_hours", THR, RUNS, 0.6)
    fore = S.definition_summaries(attach(forecasts(spark, sf, base).filter("model <> 'nbm'")), ["site", "night_date", "lead", "model"], "cover", "n_hours", THR, RUNS, 0.6)
    rows = cut_lineage(S.definition_rows(truth, fore, MODELS, LEADS))
    preds = cut_lineage(S.predictions(spark, rows, MODELS, FIRST, TRAIN_END, TEST_DAYS))
    out = S.cells(preds, RESAMPLES, SEED)
    return out.select(F.col("label").alias("definition"), "lead", big("n").alias("n"), *[r6(c).alias(c) for c in ("base_rate", "brier", "bss", "false_clear_rate", "brier_diff", "lo", "hi")], "significant")


# ---------- hours ----------

ONE = ["mean_cover"]
HOUR = (
    "gh AS MATERIALIZED (SELECT b.site, b.night_date, b.hour, s.cover FROM bb b LEFT JOIN (SELECT * FROM ser WHERE source = 'era5') s USING (site, hour))",
    """hr AS MATERIALIZED (SELECT b.site, b.night_date, b.hour, l.lead, month(b.night_date) AS month, CAST(b.cover <= 0.2 + 1e-9 AS INTEGER) AS y, g.cover AS a, e.cover AS c,
  CASE WHEN g.cover IS NOT NULL AND e.cover IS NOT NULL THEN (g.cover + e.cover) / 2 ELSE coalesce(g.cover, e.cover) END AS x,
  (coalesce(CAST(g.cover <= 0.2 + 1e-9 AS INTEGER), 0) + coalesce(CAST(e.cover <= 0.2 + 1e-9 AS INTEGER), 0)) / nullif(CAST(g.cover IS NOT NULL AS INTEGER) + CAST(e.cover IS NOT NULL AS INTEGER), 0) AS share
  FROM gh b CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS lead) l LEFT JOIN fc g ON g.model = 'gfs' AND g.site = b.site AND g.lead = l.lead AND g.hour = b.hour LEFT JOIN fc e ON e.model = 'ecmwf' AND l.lead <= 5 AND e.site = b.site AND e.lead = l.lead AND e.hour = b.hour)""",
    f"tn AS MATERIALIZED (SELECT * FROM hr WHERE night_date <= DATE '{TRAIN[1]}' AND y IS NOT NULL)",
    "src AS (SELECT lead, CAST(night_date AS DATE) AS day, site AS grp, x, y FROM tn WHERE x IS NOT NULL)",
    *fit_ctes("src", ["lead"]),
)


def _hours(spark, sf):
    base = hourly_base(spark, sf)
    w = windows(spark, sf, base)
    rows = H.hour_rows(w, forecasts(spark, sf, base), MODELS, LEADS)
    return cut_lineage(H.with_truth(rows, series(spark, sf, base).filter("source = 'era5'"), TRAIN, TEST))


@query("hourly_model_scores", "M21 J6", recursive(REP, SER, WIN, FC, *HOUR) + f""", ra AS (SELECT lead, site, month, avg(y) AS r FROM tn GROUP BY ALL), al AS (SELECT lead, avg(y) AS r FROM tn GROUP BY ALL),
  te AS (SELECT h.*, {model_p('h', 'm')} AS p, coalesce(ra.r, al.r) AS pc FROM hr h JOIN model m USING (lead) JOIN al ON al.lead = h.lead LEFT JOIN ra ON ra.lead = h.lead AND ra.site = h.site AND ra.month = h.month
    WHERE night_date BETWEEN DATE '{TEST[0]}' AND DATE '{TEST[1]}' AND y IS NOT NULL AND a IS NOT NULL AND (h.lead > 5 OR h.c IS NOT NULL)),
  pr AS (SELECT lead, y, 'climatology' AS method, pc AS p FROM te UNION ALL SELECT lead, y, 'hourly_model', p FROM te UNION ALL SELECT lead, y, 'share_of_models', share FROM te),
  sc AS (SELECT lead, method, count(*) AS n, avg(y) AS base_rate, avg((p - y) * (p - y)) AS brier FROM pr GROUP BY ALL)
  SELECT s.lead, s.method, s.n, {R('s.base_rate')} AS base_rate, {R('s.brier')} AS brier, {R('1 - s.brier / c.brier')} AS bss FROM sc s JOIN sc c ON c.lead = s.lead AND c.method = 'climatology'""")
def hourly_model_scores(spark, sf):
    rows = _hours(spark, sf)
    preds = H.evaluation(rows, H.fit(spark, rows, ONE), ONE, MODELS)
    s = V.score(cut_lineage(preds), 0, SEED, by=())
    return s.select("lead", "method", big("n").alias("n"), *[r6(c).alias(c) for c in ("base_rate", "brier", "bss")])


@query("hourly_probabilities", "M34 M21 P15", recursive(REP, SER, WIN, FC, UPC, *HOUR) + f"SELECT h.site, {NIGHT.replace('night_date,', 'h.night_date,', 1)}, h.lead, strftime(h.hour, '%Y-%m-%d %H:%M:%S') AS hour, {R(model_p('h', 'm'))} AS p_clear FROM hr h JOIN up u ON u.site = h.site AND u.night_date = h.night_date AND u.lead = h.lead JOIN model m ON m.lead = h.lead")
def hourly_probabilities(spark, sf):
    rows = _hours(spark, sf)
    s = H.served(nights_ahead(spark, sf), rows, H.fit(spark, rows, ONE), ONE)
    return s.select("site", text("night_date").alias("night_date"), "lead", text("hour").alias("hour"), r6("p_clear").alias("p_clear"))


@query("hourly_model_whole", "M21 M34")
def hourly_model_whole(spark, sf):
    """All inputs of the hourly model, all leads: the scores of the three methods."""
    rows, inputs = _hours(spark, sf), H.feature_columns(list(MODELS))
    preds = H.evaluation(rows, H.fit(spark, rows, inputs), inputs, MODELS)
    s = V.score(cut_lineage(preds), RESAMPLES, SEED, by=())
    return s.select("lead", "method", big("n").alias("n"), *[r6(c).alias(c) for c in ("base_rate", "brier", "bss", "bss_lo", "bss_hi")])


# ---------- the assembled forecast ----------

ASM = f"""fo AS (SELECT site, night_date, lead, p FROM geo WHERE label = 'era5'),
bw AS (SELECT * FROM {first_longest(island_sql('med', 'site, night_date', 'cover <= 0.2 + 1e-9'), 'site, night_date')}),
sl AS (SELECT lead, quantile_cont(spread_frac_clear, 0.75) AS spread_threshold FROM dat WHERE split = 'train' GROUP BY lead)"""


@query("assembled_forecast", "M27 M5 P14 P16 W2", recursive(*FULL, MED, UPC, *GEO, PRE, SUB, REF, PT, ASM) + f"""SELECT u.site, strftime(u.night_date, '%Y-%m-%d %H:%M:%S') AS night_date, u.lead, {R('f.p')} AS p, {VER.format('f.p')} AS verdict, {R('d.spread_frac_clear')} AS spread,
  CASE WHEN d.spread_frac_clear IS NULL OR sl.spread_threshold IS NULL THEN 'Not enough models' WHEN d.spread_frac_clear > sl.spread_threshold THEN 'Models split' ELSE 'Models agree' END AS agreement, CAST(bw.length AS BIGINT) AS window_hours,
  CASE WHEN t.bss IS NULL THEN 'Unknown' WHEN t.bss >= 0.5 THEN 'High' WHEN t.bss >= 0.3 THEN 'Medium' ELSE 'Low' END AS trust
  FROM up u LEFT JOIN dat d ON d.site = u.site AND d.night_date = u.night_date AND d.lead = u.lead LEFT JOIN fo f ON f.site = u.site AND f.night_date = u.night_date AND f.lead = u.lead LEFT JOIN sl ON sl.lead = u.lead
  LEFT JOIN bw ON bw.site = u.site AND bw.night_date = u.night_date LEFT JOIN rec t ON t.lead = u.lead AND t.method = 'blend' AND t.subset_type = 'overall'""")
def assembled_forecast(spark, sf):
    d = cut_lineage(dataset(spark, sf))  # read several times below
    feats = d.select("site", "night_date", "lead", "spread_frac_clear")
    long, fitted = fitted_geo(spark, d)  # the artifacts are a table; serving joins rows to it
    probs = B.predict(long, fitted).filter("label = 'era5'").select("site", "night_date", "lead", "p")
    best = T.best_window(_median_hours(spark, sf), ["site", "night_date"], "cover", 0.2, "dawn").select("site", "night_date", F.col("length").alias("window_hours"))
    limits = spread_threshold(d.filter("split = 'train'"), ["lead"])
    out = assemble(nights_ahead(spark, sf), feats, probs, records(spark, sf), best, limits)
    return out.select("site", text("night_date").alias("night_date"), "lead", r6("p").alias("p"), "verdict", r6("spread_frac_clear").alias("spread"), "agreement", big("window_hours").alias("window_hours"), "trust")
