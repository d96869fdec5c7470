"""Whole fits beside the same fits in SQL: tuning, hold-outs, walk-forward, calibration, coefficient tables.

One input with gaps (or two without) keeps the SQL to three equations a step; nothing else is smaller: every row, every
fold, every value of C. The same operators run with all inputs in `catalog_models`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from nightfold.operators import models as M
from nightfold.plans.catalog_models import KEYS, SHIP, TYPES, shipments
from nightfold.plans.catalog_verify import BIN_SQL
from nightfold.plans.derived import R, big, r6
from nightfold.plans.fit_sql import EACH_GROUP, EACH_MONTH, fit_ctes, isotonic_ctes, model_p, recursive
from nightfold.plans.registry import query

ONE = ["discount"]
SRC = "src AS (SELECT lead, day, grp, discount AS x, y FROM sp)"
START = "2001-06-01"
ECE = 0.005  # low enough for some leads to need a map


@query("tuned_one_input", "M3 M4 M36 P23", recursive(SHIP, SRC, *fit_ctes("src", KEYS)) + f"""SELECT lead, {R('c')} AS c, {R('cv_log_loss')} AS cv_log_loss, CAST(n AS BIGINT) AS n_train, {R('pos / n')} AS base_rate, {R('med')} AS median,
  {R('b0')} AS coef_value, {R('CASE WHEN gaps > 0 THEN b1 END')} AS coef_missing, {R('b2')} AS intercept, CAST(d.a AS VARCHAR) AS train_start, CAST(d.b AS VARCHAR) AS train_end FROM model JOIN (SELECT lead, min(day) AS a, max(day) AS b FROM src GROUP BY lead) d USING (lead)""")
def tuned_one_input(spark, sf):
    arts = M.fit_logistic_grid(shipments(spark, sf), KEYS, ONE, "y", "day")
    a = M.artifact_frame(spark, arts, KEYS, TYPES)
    return a.select("lead", *[r6(c).alias(c) for c in ("c", "cv_log_loss")], big("n_train").alias("n_train"), r6("base_rate").alias("base_rate"), r6(F.col("medians")[0]).alias("median"),
                    r6(F.col("coef")[0]).alias("coef_value"), r6(F.get("coef", F.lit(1))).alias("coef_missing"), r6("intercept").alias("intercept"), "train_start", "train_end")


@query("held_out_one_input", "M22 M23", recursive(SHIP, SRC, *fit_ctes("src", KEYS, EACH_GROUP)) + f""", q AS (SELECT s.*, {model_p('s', 'm')} AS p FROM src s JOIN model m ON m.lead = s.lead AND m.split = s.grp)
  SELECT lead, grp AS "group", CAST(day AS VARCHAR) AS day, count(*) AS n, {R('avg(p)')} AS mean_p, {R('avg((p - y) * (p - y))')} AS brier FROM q GROUP BY ALL""")
def held_out_one_input(spark, sf):
    rows = shipments(spark, sf)
    p = M.leave_group_out(rows, rows, KEYS, TYPES, ONE, "y", "day", "group")
    return p.groupBy("lead", "group", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), r6(F.avg("p")).alias("mean_p"), r6(F.avg((F.col("p") - F.col("y")) ** 2)).alias("brier"))


@query("walk_forward_one_input", "M25 Q14", recursive(SHIP, SRC, *fit_ctes("src", KEYS, EACH_MONTH, start=START)) + f""", q AS (SELECT s.*, m.split AS period, {model_p('s', 'm')} AS p FROM src s JOIN model m ON m.lead = s.lead AND m.split = strftime(s.day, '%Y-%m'))
  SELECT lead, period, count(*) AS n, {R('avg(y)')} AS base_rate, {R('1 - avg((p - y) * (p - y)) / 0.25')} AS bss_p FROM q GROUP BY ALL""")
def walk_forward_one_input(spark, sf):
    rows = shipments(spark, sf).withColumn("p_climatology", F.lit(0.5))
    s = M.monthly_skill(M.walk_forward(rows, KEYS, TYPES, ONE, "y", "day", START), ["lead"], ["p"])
    return s.select("lead", "period", "n", r6("base_rate").alias("base_rate"), r6("bss_p").alias("bss_p"))


OOF = f"""oof AS (SELECT s.lead, {model_p('s', 'f')} AS p, s.y FROM src s JOIN fold f ON f.lead = s.lead WHERE s.day >= f.val_from AND (f.val_before IS NULL OR s.day < f.val_before)),
bn AS (SELECT lead, {BIN_SQL} AS bin, count(*) AS n, avg(p) AS f, avg(y) AS o FROM oof GROUP BY ALL),
ec AS MATERIALIZED (SELECT lead, sum(n) AS n_oof, sum(n * abs(o - f)) / sum(n) AS ece FROM bn GROUP BY lead)"""
#: The map through the fitted points, flat outside: the last point at or before a probability and the first after it.
MAPPED = """mp AS (SELECT r.lead, r.x, r.q, ec.ece, ec.n_oof, max(i.p) FILTER (i.p <= r.q) AS pa, arg_max(i.v, i.p) FILTER (i.p <= r.q) AS va, min(i.p) FILTER (i.p > r.q) AS pb, arg_min(i.v, i.p) FILTER (i.p > r.q) AS vb
  FROM raw r JOIN ec USING (lead) LEFT JOIN iso i ON i.lead = r.lead GROUP BY ALL)"""


@query("calibrated_one_input", "M18 M19", recursive(SHIP, SRC, *fit_ctes("src", KEYS), OOF, *isotonic_ctes("oof", KEYS), f"raw AS (SELECT s.lead, s.x, {model_p('s', 'm')} AS q FROM (SELECT DISTINCT lead, x FROM src) s JOIN model m USING (lead))", MAPPED) + f"""SELECT lead, x AS discount, CAST(n_oof AS BIGINT) AS n_oof, {R('ece')} AS oof_ece, ece > {ECE} AS applied,
  {R(f'CASE WHEN ece <= {ECE} THEN q WHEN pa IS NULL THEN vb WHEN pb IS NULL THEN va ELSE va + (vb - va) * (q - pa) / (pb - pa) END')} AS p FROM mp""")
def calibrated_one_input(spark, sf):
    rows = shipments(spark, sf)
    arts = M.fit_logistic_grid(rows, KEYS, ONE, "y", "day")
    arts = M.calibrate(M.out_of_fold(rows, KEYS, TYPES, ONE, "y", "day", arts), KEYS, "y", arts, threshold=ECE)
    values = rows.select("lead", "discount").distinct()
    p = M.predict(values, M.artifact_frame(spark, arts, KEYS, TYPES), ONE, KEYS)
    how = spark.createDataFrame([(int(a["keys"]["lead"]), a["n_oof"], a["oof_ece"], a["applied"]) for a in arts], "lead int, n_oof long, oof_ece double, applied boolean")
    return p.join(F.broadcast(how), "lead").select("lead", "discount", "n_oof", r6("oof_ece").alias("oof_ece"), "applied", r6("p").alias("p"))  # how: one row a model


TWO = ["gfs_frac_clear", "ecmwf_mean_cover"]
SRC2 = "src AS (SELECT lead, day, grp, quantity / 50 AS x, tax AS x2, y FROM sp)"


def _two(spark, sf):
    rows = shipments(spark, sf).withColumns({TWO[0]: F.col("quantity") / 50, TWO[1]: F.col("tax")})
    return M.artifact_frame(spark, M.fit_logistic_grid(rows, KEYS, TWO, "y", "day"), KEYS, TYPES)


@query("two_input_shares", "F25 Q13", recursive(SHIP, SRC2, *fit_ctes("src", KEYS, second=True)) + f"""SELECT lead, model, {R('v / (abs(b0) + abs(b1))')} AS share FROM (SELECT lead, b0, b1, 'gfs' AS model, abs(b0) AS v FROM model UNION ALL SELECT lead, b0, b1, 'ecmwf', abs(b1) FROM model)""")
def two_input_shares(spark, sf):
    return M.weight_shares(_two(spark, sf), KEYS, ["gfs", "ecmwf"]).select("lead", "model", r6("share").alias("share"))


@query("two_input_coefficients", "O10 M36 Q13", recursive(SHIP, SRC2, *fit_ctes("src", KEYS, second=True)) + f"""SELECT lead, feature, {R('coef')} AS coef, row_number() OVER (PARTITION BY lead ORDER BY abs(coef) DESC, feature) AS rank FROM (SELECT lead, 'gfs_frac_clear' AS feature, b0 AS coef FROM model UNION ALL SELECT lead, 'ecmwf_mean_cover', b1 FROM model)""")
def two_input_coefficients(spark, sf):
    return M.largest_coefficients(_two(spark, sf), KEYS, 12).select("lead", "feature", r6("coef").alias("coef"), big("rank").alias("rank"))
