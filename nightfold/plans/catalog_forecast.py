"""Queries over forecast assembly, verification of the log and the streaming-shaped merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightfold.functions import timefn as T
from nightfold.operators import forecast as C, timeseries as S, verify as V
from nightfold.plans.catalog_quality import PT, records
from nightfold.plans.catalog_sky import ts
from nightfold.plans.catalog_verify import PRE, REF, SUB
from nightfold.plans.derived import BASE, FC, FEA, R, REP, TRAIN, features, WIN, big, hourly_base, labels, LAB, r6, reports, series, table, text, windows, with_
from nightfold.plans.registry import query

NIGHT = "strftime(night_date, '%Y-%m-%d %H:%M:%S') AS night_date"
NOW = "2024-01-10 03:00:00"
VER = "CASE WHEN {0} IS NULL THEN 'No data' WHEN {0} >= 0.7 THEN 'Go' WHEN {0} >= 0.4 THEN 'Maybe' ELSE 'Skip' END"


@query("verdicts_and_kinds", "P14 P18", with_(REP) + f"""SELECT event_id, {VER.format('p')} AS verdict, CASE WHEN p IS NULL THEN 'Unknown' WHEN p >= 0.5 THEN 'High' WHEN p >= 0.3 THEN 'Medium' ELSE 'Low' END AS trust,
  CASE WHEN p IS NULL OR cover IS NULL THEN 'Not enough models' WHEN p > cover THEN 'Models split' ELSE 'Models agree' END AS agreement, CASE WHEN p >= 0.6 THEN 'clear' WHEN p < 0.35 THEN 'cloudy' WHEN p IS NOT NULL THEN 'mixed' END AS kind FROM (SELECT event_id, cover, CASE WHEN k % 10 > 0 THEN k / 100.0::DOUBLE END AS p FROM rep)""")
def verdicts_and_kinds(spark, sf):
    p = F.when(F.col("k") % 10 > 0, F.col("k") / 100.0)
    return reports(spark, sf).select("event_id", C.verdict_for(p).alias("verdict"), C.trust_level(p).alias("trust"), C.agreement(p, F.col("cover")).alias("agreement"), C.hour_kind(p).alias("kind"))


@query("assigned_leads", "P15", f"SELECT event_id, CAST(greatest(1, least(7, ceil((epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}')) / 1e6 / 86400.0))) AS INTEGER) AS lead FROM events")
def assigned_leads(spark, sf):
    return table(spark, sf, "events").select("event_id", T.assign_lead(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp")).alias("lead"))


UPC = f"up AS (SELECT *, CAST(greatest(1, least(7, ceil((epoch_us(dusk) - epoch_us(TIMESTAMP '{NOW}')) / 1e6 / 86400.0))) AS INTEGER) AS lead FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY night_date) AS r FROM win WHERE dusk IS NOT NULL AND dawn > TIMESTAMP '{NOW}') WHERE r <= 7)"


def nights_ahead(spark, sf):
    return C.upcoming(windows(spark, sf), ["site"], F.lit(NOW).cast("timestamp"))


@query("upcoming_nights", "P16 P15", with_(REP, WIN, UPC) + f"SELECT site, {NIGHT}, {ts('dusk')}, {ts('dawn')}, lead FROM up")
def upcoming_nights(spark, sf):
    return nights_ahead(spark, sf).select("site", *[text(c).alias(c) for c in ("night_date", "dusk", "dawn")], "lead")


@query("conditions_met", "P17", with_(REP) + """SELECT event_id, p >= 0.7 AS is_clear, sqm >= 20.3 AS is_dark, free >= 3 AS moon_down, CAST(coalesce(CAST(p >= 0.7 AS INTEGER), 0) + coalesce(CAST(sqm >= 20.3 AS INTEGER), 0) + coalesce(CAST(free >= 3 AS INTEGER), 0) AS BIGINT) AS met
  FROM (SELECT event_id, CASE WHEN k % 10 > 0 THEN k / 100.0::DOUBLE END AS p, CASE WHEN k % 7 > 0 THEN 18 + value / 20 END AS sqm, k % 8 AS free FROM rep)""")
def conditions_met(spark, sf):
    k = F.col("k")
    c = C.conditions(F.when(k % 10 > 0, k / 100.0), F.when(k % 7 > 0, 18 + F.col("value") / 20), k % 8)
    return reports(spark, sf).select("event_id", *[(big(x) if n == "met" else x).alias(n) for n, x in c.items()])


TAG = "rc AS (SELECT lead, subset_type, subset, bss, false_clear_rate, n FROM rec WHERE method = 'blend')"


@query("track_records", "J17 P21", with_(PRE, SUB, REF, PT, TAG) + f"""SELECT o.o_orderpriority AS site, o.lead, count(*) AS nights, {R('max(a.bss)')} AS overall_bss, {R('max(s.bss)')} AS site_bss, CAST(max(s.n) AS BIGINT) AS site_n, max(CASE WHEN v.site IS NULL THEN 'geo' ELSE 'site' END) AS variant
  FROM (SELECT o_orderpriority, CAST(1 + o_orderkey % 3 AS INTEGER) AS lead FROM orders) o LEFT JOIN rc a ON a.lead = o.lead AND a.subset_type = 'overall' LEFT JOIN rc s ON s.lead = o.lead AND s.subset_type = 'site' AND s.subset = o.o_orderpriority
  LEFT JOIN (SELECT DISTINCT o_orderpriority AS site FROM orders WHERE o_orderpriority < '3') v ON v.site = o.o_orderpriority GROUP BY 1, 2""")
def track_records(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("site"), (1 + F.col("o_orderkey") % 3).cast("int").alias("lead"))
    # Reduced to one row per site and lead before the joins: the record is the same for all its nights.
    per = o.groupBy("site", "lead").agg(F.count("*").alias("nights"))
    t = C.track_record(per, records(spark, sf))
    t = C.route_variant(t, o.filter("site < '3'"))
    return t.select("site", "lead", "nights", r6("overall_bss").alias("overall_bss"), r6("site_bss").alias("site_bss"), big("site_n").alias("site_n"), "variant")


@query("early_evening_models", "A29", with_(*BASE) + f"""SELECT site, {NIGHT}, CAST(sum(CASE WHEN c <= 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS n_clear, count(*) AS n_models FROM
  (SELECT w.site, w.night_date, s.source, avg(s.cover) AS c FROM win w JOIN ser s ON s.site = w.site AND s.hour >= date_trunc('hour', w.dusk - INTERVAL 150 MINUTE) AND s.hour < w.dusk GROUP BY ALL HAVING avg(s.cover) IS NOT NULL) GROUP BY site, night_date""")
def early_evening_models(spark, sf):
    base = hourly_base(spark, sf)
    n = windows(spark, sf, base).withColumn("first_stars", F.col("dusk") - F.expr("INTERVAL 150 MINUTES"))
    e = C.early_evening(series(spark, sf, base).withColumnRenamed("source", "model"), n)
    return e.select("site", text("night_date").alias("night_date"), "n_clear", "n_models")


HRW = """hw AS (SELECT b.site, b.night_date, b.hour, max(CASE WHEN source = 'gfs' THEN cover END) AS a, max(CASE WHEN source = 'ecmwf' THEN cover END) AS b, max(CASE WHEN source = 'goes' THEN cover END) AS c FROM bb b JOIN ser s USING (site, hour) GROUP BY ALL),
ha AS (SELECT site, night_date, hour, CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER) + CAST(c IS NOT NULL AS INTEGER) AS n, coalesce(CAST(a <= 0.2 AS INTEGER), 0) + coalesce(CAST(b <= 0.2 AS INTEGER), 0) + coalesce(CAST(c <= 0.2 AS INTEGER), 0) AS k FROM hw)"""


@query("model_agreement", "A30", with_(*BASE, HRW) + f""", x AS (SELECT * FROM ha WHERE n > 0), y AS (SELECT site, night_date, arg_min(k > 0, hour) AS starts FROM x GROUP BY ALL)
  SELECT site, {NIGHT}, CAST(max(n) AS BIGINT) AS n_models, bool_and(k = n) AS all_clear, bool_and(k = 0) AS all_cloudy, bool_and(k = n OR k = 0) AS always_agree, {ts('min(CASE WHEN NOT (k = n OR k = 0) THEN hour END)', 'first_split')}, {ts('min(CASE WHEN (k > 0) <> starts THEN hour END)', 'first_flip')} FROM x JOIN y USING (site, night_date) GROUP BY site, night_date""")
def model_agreement(spark, sf):
    models = ["gfs", "ecmwf", "goes"]
    base = hourly_base(spark, sf)
    h = C.hourly_rows(windows(spark, sf, base), series(spark, sf, base).withColumnRenamed("source", "model"), models)
    a = C.forecast_agreement(h, ["site", "night_date"], models)
    return a.select("site", text("night_date").alias("night_date"), big("n_models").alias("n_models"), "all_clear", "all_cloudy", "always_agree", text("first_split").alias("first_split"), text("first_flip").alias("first_flip"))


PH = "ph AS (SELECT b.site, b.night_date, 1 - avg(s.cover) AS p FROM bb b JOIN ser s USING (site, hour) WHERE s.cover IS NOT NULL GROUP BY ALL)"


def night_odds(spark, sf):
    base = hourly_base(spark, sf)
    b = S.backbone(windows(spark, sf, base), ["site", "night_date"], "dusk", "dawn")
    s = series(spark, sf, base).filter("cover is not null").join(b, ["site", "hour"])
    return s.groupBy("site", "night_date").agg((1 - F.avg("cover")).alias("p"))


@query("next_better_night", "O7", with_(*BASE, FC, FEA) + f""", q AS (SELECT site, lead, CAST(month(night_date) * 10 + floor(day(night_date) / 7) AS BIGINT) AS week, night_date, gfs_frac_clear AS p FROM fe), f AS (SELECT site, lead, week, min(night_date) AS d0, any_value(p0) AS p0 FROM (SELECT *, first_value(p) OVER (PARTITION BY site, lead, week ORDER BY night_date) AS p0 FROM q) GROUP BY ALL),
  l AS (SELECT site, lead, week, arg_min(night_date, (-p, night_date)) AS night_date, max(p) AS p, any_value(p0) AS p0 FROM q JOIN f USING (site, lead, week) WHERE night_date > d0 AND p IS NOT NULL AND p0 IS NOT NULL GROUP BY ALL) SELECT site, lead, week, {NIGHT}, {R('p')} AS p FROM l WHERE p >= greatest(0.6, p0 + 0.25)""")
def next_better_night(spark, sf):
    d = F.col("night_date")
    n = features(spark, sf).select("site", "lead", "night_date", (F.month(d) * 10 + F.floor(F.dayofmonth(d) / 7)).cast("long").alias("week"), F.col("gfs_frac_clear").alias("p"))
    b = C.next_better_night(n, ["site", "lead", "week"])
    return b.select("site", "lead", "week", text("night_date").alias("night_date"), r6("p").alias("p"))


@query("place_ranking", "W15", with_(REP) + """SELECT site, user_id AS place, row_number() OVER (PARTITION BY site ORDER BY met DESC, p DESC NULLS LAST, sqm DESC NULLS LAST, user_id) AS rank FROM (SELECT site, user_id, max(k) % 4 AS met, CASE WHEN max(k) % 5 > 0 THEN avg(k) / 100 END AS p, 18 + avg(value) / 20 AS sqm FROM rep GROUP BY ALL)""")
def place_ranking(spark, sf):
    k = F.max("k")
    p = reports(spark, sf).groupBy("site", F.col("user_id").alias("place")).agg((k % 4).alias("met"), F.when(k % 5 > 0, F.avg("k") / 100).alias("p"), (18 + F.avg("value") / 20).alias("sqm"))
    return C.rank_places(p, ["site"]).select("site", "place", big("rank").alias("rank"))


@query("odds_for_event_places", "J21", with_(*BASE, PH) + f"SELECT r.event_id, {R('p')} AS odds FROM rep r LEFT JOIN ph ON ph.site = r.site AND ph.night_date = CAST(r.valid - INTERVAL 12 HOUR AS DATE)")
def odds_for_event_places(spark, sf):
    from nightfold.operators.events import with_odds

    e = reports(spark, sf).select("event_id", "site", F.to_date(F.col("valid") - F.expr("INTERVAL 12 HOURS")).alias("night_date"))
    return with_odds(e, night_odds(spark, sf)).select("event_id", r6("odds").alias("odds"))


# ---------- the forecast log ----------

LOG = """lg AS (SELECT r.site, CAST(r.valid AS DATE) AS issue_date, CAST(r.valid AS DATE) + CAST(r.k % 4 AS INTEGER) AS night_date, CAST(1 + r.k % 4 AS INTEGER) AS lead, r.valid AS issued_at, r.value % 1 AS p_usable, CASE WHEN r.k >= 0 THEN r.k / 100.0::DOUBLE END AS nbm, event_id FROM rep r),
lf AS (SELECT site, issue_date, night_date, arg_min({'lead': lead, 'p': p_usable, 'nbm': nbm, 'at': issued_at}, (issued_at, event_id)) AS r FROM lg GROUP BY ALL)"""


def forecast_log(spark, sf):
    """The first forecast of each (issue date, site, night) wins."""
    from nightfold.operators.merge import first_wins

    k = F.col("k")
    log = reports(spark, sf).select(
        "site", F.to_date("valid").alias("issue_date"), F.date_add(F.to_date("valid"), (k % 4).cast("int")).alias("night_date"), (1 + k % 4).cast("int").alias("lead"),
        F.col("valid").alias("issued_at"), (F.col("value") % 1).alias("p_usable"), (k / 100.0).alias("nbm"), "event_id",
    )
    return first_wins(log, ["site", "issue_date", "night_date"], ["issued_at", "event_id"]).drop("event_id")


@query("forecast_log", "T1 S15 U5 D18", with_(REP, LOG) + f"SELECT site, CAST(issue_date AS VARCHAR) AS issue_date, CAST(night_date AS VARCHAR) AS night_date, r.lead AS lead, {R('r.p')} AS p_usable, {ts('r.at', 'issued_at')} FROM lf")
def forecast_log_query(spark, sf):
    g = forecast_log(spark, sf)
    return g.select("site", F.col("issue_date").cast("string").alias("issue_date"), F.col("night_date").cast("string").alias("night_date"), "lead", r6("p_usable").alias("p_usable"), text("issued_at").alias("issued_at"))


VLG = "vl AS (SELECT lf.site, lf.issue_date, lf.night_date, r.lead AS lead, r.p AS p_usable, r.nbm AS nbm, lab.usable_era5 AS y FROM lf LEFT JOIN lab ON lab.site = lf.site AND lab.night_date = lf.night_date WHERE issue_date >= DATE '2024-01-03' AND lf.night_date <= DATE '2024-01-25')"


def verified(spark, sf):
    lab = labels(spark, sf).select("site", "night_date", "usable_era5")
    return C.verified_log(forecast_log(spark, sf), lab, "2024-01-03", "2024-01-25")


@query("verified_log", "J7 J8 T2", with_(*BASE, LAB, LOG, VLG) + f"SELECT site, CAST(issue_date AS VARCHAR) AS issue_date, CAST(night_date AS VARCHAR) AS night_date, lead, {R('p_usable')} AS p_usable, y AS usable_era5 FROM vl")
def verified_log(spark, sf):
    v = verified(spark, sf)
    return v.select("site", F.col("issue_date").cast("string").alias("issue_date"), F.col("night_date").cast("string").alias("night_date"), "lead", r6("p_usable").alias("p_usable"), "usable_era5")


@query("forward_scores", "M26 T8 J5", with_(*BASE, LAB, LOG, VLG) + f""", ra AS (SELECT site, month(night_date) AS month, avg(CAST(usable_era5 AS DOUBLE)) AS rate FROM lab WHERE night_date <= DATE '{TRAIN[1]}' AND usable_era5 IS NOT NULL GROUP BY ALL), rs AS (SELECT site, avg(rate) AS rate FROM ra GROUP BY site),
  l AS (SELECT lead, (isoyear(night_date) * 100 + weekofyear(night_date)) AS week, CAST(y AS DOUBLE) AS y, unnest([{{'m': 'climatology', 'p': coalesce(ra.rate, rs.rate)}}, {{'m': 'blend', 'p': p_usable}}, {{'m': 'nbm', 'p': nbm}}]) AS u FROM vl LEFT JOIN ra ON ra.site = vl.site AND ra.month = month(vl.night_date) LEFT JOIN rs ON rs.site = vl.site WHERE y IS NOT NULL),
  g AS (SELECT u.m AS method, lead, count(*) AS n, count(DISTINCT week) AS n_weeks, sum(y) AS sy, sum(pow(u.p - y, 2)) AS sq, sum(CASE WHEN u.p >= 0.5 THEN 1 ELSE 0 END) AS go, sum(CASE WHEN u.p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS gu FROM l GROUP BY GROUPING SETS ((u.m), (u.m, lead)))
  SELECT a.method, a.lead, a.n, a.n_weeks, {R('a.sy / a.n')} AS base_rate, {R('a.sq / a.n')} AS brier, {R('1 - a.sq / b.sq')} AS bss, CAST(a.go AS BIGINT) AS go_calls, CAST(a.gu AS BIGINT) AS go_calls_usable, {R('(a.go - a.gu) / nullif(a.go, 0)')} AS false_clear_rate FROM g a JOIN g b ON b.method = 'climatology' AND a.lead IS NOT DISTINCT FROM b.lead""")
def forward_scores(spark, sf):
    nights = labels(spark, sf).filter(F.col("night_date") <= F.lit(TRAIN[1]).cast("date")).withColumn("month", F.month("night_date"))
    v = V.apply_climatology(verified(spark, sf).withColumn("month", F.month("night_date")), V.climatology(nights, "usable_era5"))
    s = C.score_forward(v, {"climatology": "p_climatology", "blend": "p_usable", "nbm": "nbm"}, "usable_era5")
    return s.select("method", "lead", "n", "n_weeks", *[r6(c).alias(c) for c in ("base_rate", "brier", "bss", "false_clear_rate")], "go_calls", "go_calls_usable")
