"""Queries over the time-series operators: reports, windows, runs, labels, features, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightfold.functions import timefn as T
from nightfold.operators import nights as N, timeseries as S
from nightfold.plans.derived import (
    BASE, BENCHMARKS, FC, FEA, FULL, LAB, MODELS, MOON, NIT, REP, SER, SITES, big, code_sql, dataset,
    features, hourly_base, labels, moon, r6, reports, runs_sql, series, table, text, windows, with_,
)
from nightfold.plans.registry import query

SUMMARY = ("missing_frac", "frac_clear", "longest_clear_run", "longest_clear_run_frac", "mean_cover")
SUM_SQL = ", ".join(f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in SUMMARY)
LOOK = "(SELECT b.site, d.source, b.night_date, b.hour, s.cover FROM bb b JOIN (SELECT DISTINCT site, source FROM ser) d USING (site) LEFT JOIN ser s ON s.site = b.site AND s.source = d.source AND s.hour = b.hour)"


def _summary(df, *keys):
    return df.select(*keys, text("night_date").alias("night_date"), big("n_hours").alias("n_hours"), *[r6(c).alias(c) for c in SUMMARY], "usable")


NIGHT = "strftime(night_date, '%Y-%m-%d %H:%M:%S') AS night_date"
RUN_SQL = with_(*BASE) + f"SELECT site, source, {NIGHT}, CAST(n_hours AS BIGINT) AS n_hours, {SUM_SQL}, usable FROM ({runs_sql(LOOK, 'site, source, night_date')})"


@query("usable_nights", "A1 A2 F1 F2 J1 P1 P2 P3 W1", RUN_SQL)
def usable_nights(spark, sf):
    base = hourly_base(spark, sf)
    return _summary(S.run_summary(windows(spark, sf, base), series(spark, sf, base), ["site"], "night_date", "dusk", "dawn", "cover", by=["source"]), "site", "source")


def _spine(spark, sf):
    base = hourly_base(spark, sf)
    s = series(spark, sf, base)
    spine = S.backbone(windows(spark, sf, base), ["site", "night_date"], "dusk", "dawn").join(s.select("site", "source").distinct(), "site")
    return S.lookup_at(spine, s, ["site", "source"])


@query("run_summary_blocks", "A2 W1 J1", RUN_SQL)
def run_summary_blocks(spark, sf):
    return _summary(S.run_summary_windowed(_spine(spark, sf), ["site", "source", "night_date"], "hour", "cover"), "site", "source")


@query("run_rule_nested", "A3", with_(*BASE) + f"SELECT site, source, {NIGHT}, usable FROM ({runs_sql(LOOK, 'site, source, night_date')})")
def run_rule_nested(spark, sf):
    nested = _spine(spark, sf).groupBy("site", "source", "night_date").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("hour", "cover"))), lambda x: x["cover"]).alias("covers")
    )
    return nested.select("site", "source", text("night_date").alias("night_date"), S.is_usable(F.col("covers"), S.RunRules()).alias("usable"))


for _method, _agg in (("nearest", None), ("max", "max(cover)")):
    _rel = "ser" if _agg is None else "(SELECT site, source, hour, max(cover) AS cover FROM rep GROUP BY ALL)"

    @query(f"hourly_cover_{_method}", "A1 F1 P1 P2 T3",
           with_(REP, SER) + f"SELECT site, source, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, round(cover + 1e-9, 6) + 0.0 AS cover FROM {_rel}")
    def hourly_cover(spark, sf, method=_method):
        h = S.hourly_cover(reports(spark, sf), ["site", "source"], "valid", "cover", method)
        return h.select("site", "source", text("hour").alias("hour"), r6("cover").alias("cover"))


@query("sky_code_modes", "P1 P2", with_(REP) + f"""SELECT site, skyc1, skyc2, count(*) AS n,
  max(greatest({code_sql('skyc1')}, {code_sql('skyc2')})) AS cover_default,
  max(greatest({code_sql('skyc1', 'conservative')}, {code_sql('skyc2', 'conservative')})) AS cover_conservative FROM rep GROUP BY ALL""")
def sky_code_modes(spark, sf):
    layers = ["skyc1", "skyc2"]
    return reports(spark, sf).groupBy("site", *layers).agg(
        F.count("*").alias("n"),
        F.max(S.observation_cover(layers)).alias("cover_default"),
        F.max(S.observation_cover(layers, "conservative")).alias("cover_conservative"),
    )


@query("backbone_hours", "F2 D6", with_(*BASE) + f"SELECT site, {NIGHT}, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour FROM bb")
def backbone_hours(spark, sf):
    return S.backbone(windows(spark, sf), ["site", "night_date"], "dusk", "dawn").select("site", text("night_date").alias("night_date"), text("hour").alias("hour"))


@query("series_at_backbone", "J1", with_(*BASE) + f"SELECT site, source, {NIGHT}, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, round(cover + 1e-9, 6) + 0.0 AS cover FROM {LOOK}")
def series_at_backbone(spark, sf):
    return _spine(spark, sf).select("site", "source", text("night_date").alias("night_date"), text("hour").alias("hour"), r6("cover").alias("cover"))


@query("night_position", "F7", with_(*BASE) + f"""SELECT site, {NIGHT}, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour,
  round(greatest(0.0, least(1.0, (epoch_us(hour) - epoch_us(dusk)) / (epoch_us(dawn) - epoch_us(dusk)))) + 1e-9, 6) + 0.0 AS position FROM bb""")
def night_position(spark, sf):
    w = windows(spark, sf)
    b = S.backbone(w, ["site", "night_date", "dusk", "dawn"], "dusk", "dawn")
    return b.select("site", text("night_date").alias("night_date"), text("hour").alias("hour"), r6(T.night_position(F.col("hour"), F.col("dusk"), F.col("dawn"))).alias("position"))


# ---------- runs, islands, crossings ----------

MED = f"""med AS (SELECT b.site, b.night_date, b.dusk, b.dawn, b.hour, quantile_cont(s.cover, 0.5) AS cover FROM bb b
  LEFT JOIN (SELECT * FROM ser WHERE source IN ('gfs', 'ecmwf', 'goes')) s USING (site, hour) GROUP BY ALL)"""


def island_sql(rel: str, keys: str, cond: str) -> str:
    """SQL of `islands` for hourly rows: consecutive flagged hours."""
    return f"""(SELECT {keys}, min(hour) AS st, max(hour) AS en, count(*) AS length FROM
      (SELECT *, hour - to_hours(CAST(row_number() OVER (PARTITION BY {keys} ORDER BY hour) AS INTEGER)) AS g FROM {rel} WHERE {cond}) GROUP BY {keys}, g)"""


def first_longest(rel: str, keys: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY length DESC, st) AS r FROM {rel}) WHERE r = 1)"


def _median_hours(spark, sf):
    base = hourly_base(spark, sf)
    w = windows(spark, sf, base)
    models = series(spark, sf, base).filter(F.col("source").isin("gfs", "ecmwf", "goes"))
    med = N.median_by_hour(models, ["site", "hour"])
    b = S.backbone(w, ["site", "night_date", "dusk", "dawn"], "dusk", "dawn")
    return b.join(med, ["site", "hour"], "left").withColumnRenamed("median_cover", "cover")


SPAN = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {1}"


@query("median_cover_by_hour", "A17", with_(*BASE, MED) + f"SELECT site, {NIGHT}, {SPAN.format('hour', 'hour')}, round(cover + 1e-9, 6) + 0.0 AS cover FROM med")
def median_cover_by_hour(spark, sf):
    return _median_hours(spark, sf).select("site", text("night_date").alias("night_date"), text("hour").alias("hour"), r6("cover").alias("cover"))


@query("best_window", "W2", with_(*BASE, MED) + f"""SELECT site, {NIGHT}, {SPAN.format('st', 'start')}, {SPAN.format('en', '"end"')}, length,
  {SPAN.format('least(en + INTERVAL 1 HOUR, w.dawn)', '"until"')} FROM {first_longest(island_sql('med', 'site, night_date', 'cover <= 0.2 + 1e-9'), 'site, night_date')} JOIN win w USING (site, night_date)""")
def best_window(spark, sf):
    b = S.best_window(_median_hours(spark, sf), ["site", "night_date"], "cover", 0.2, "dawn")
    return b.select("site", *[text(c).alias(c) for c in ("night_date", "start", "end", "until")], "length")


@query("longest_clear_span", "W3", with_(*BASE, MED) + f"""SELECT site, {NIGHT}, {SPAN.format('greatest(st - INTERVAL 30 MINUTE, w.dusk)', 'start')},
  {SPAN.format('least(en + INTERVAL 30 MINUTE, w.dawn)', '"end"')}, length FROM {first_longest(island_sql('med', 'site, night_date', '1 - cover >= 0.6'), 'site, night_date')} JOIN win w USING (site, night_date)""")
def longest_clear_span(spark, sf):
    hours = _median_hours(spark, sf)
    r = S.longest_run(hours, ["site", "night_date"], (1 - F.col("cover")) >= 0.6, "dusk", "dawn")
    return r.select("site", *[text(c).alias(c) for c in ("night_date", "start", "end")], "length")


@query("moon_up_runs", "W5", with_(REP, MOON) + f"""SELECT site, day, {SPAN.format('min(hour)', 'start')}, {SPAN.format('max(coalesce(nx, hour))', '"end"')} FROM
  (SELECT *, sum(CASE WHEN f AND NOT pf THEN 1 ELSE 0 END) OVER (PARTITION BY site, day ORDER BY hour ROWS UNBOUNDED PRECEDING) AS r FROM
    (SELECT site, CAST(CAST(hour AS DATE) AS VARCHAR) AS day, hour, alt > 0 AS f, coalesce(lag(alt > 0) OVER w, false) AS pf, lead(hour) OVER w AS nx FROM moon
     WINDOW w AS (PARTITION BY site, CAST(CAST(hour AS DATE) AS VARCHAR) ORDER BY hour))) WHERE f GROUP BY site, day, r""")
def moon_up_runs(spark, sf):
    m = moon(spark, sf).withColumn("day", F.to_date("hour").cast("string"))
    return S.true_runs(m, ["site", "day"], "hour", F.col("alt") > 0).select("site", "day", text("start").alias("start"), text("end").alias("end"))


SUN = """sun AS (SELECT DISTINCT site, strftime(valid - INTERVAL 12 HOUR, '%Y-%m-%d') AS evening, date_trunc('hour', valid) AS t,
  45 * sin((epoch(date_trunc('hour', valid)) / 3600.0 - 7) * (2 * pi() / 24)) - 3 * CAST(site[2:2] AS INTEGER) AS alt FROM rep)"""


def sun(spark, sf):
    """Sampled Sun altitude at every hour any report falls in, grouped by the evening it belongs to."""
    r = reports(spark, sf)
    t = F.date_trunc("hour", "valid")
    alt = 45 * F.sin((F.unix_timestamp(t) / 3600.0 - 7) * (2 * F.pi() / 24)) - 3 * F.substring("site", 2, 1).cast("int")
    return r.select("site", F.date_format(F.col("valid") - F.expr("INTERVAL 12 HOURS"), "yyyy-MM-dd").alias("evening"), t.alias("t"), alt.alias("alt")).distinct()


CRO = """cro AS (SELECT site, evening, make_timestamp(CAST(epoch_us(t) + round((epoch_us(t1) - epoch_us(t)) * (a / (a - a1))) AS BIGINT)) AS tm, a > 0 AS falling FROM
  (SELECT *, alt + 18 AS a, lead(alt + 18) OVER w AS a1, lead(t) OVER w AS t1 FROM sun WINDOW w AS (PARTITION BY site, evening ORDER BY t)) WHERE a1 IS NOT NULL AND (a > 0) <> (a1 > 0))"""


@query("altitude_crossings", "W6", with_(REP, SUN, CRO) + f"SELECT site, evening, {SPAN.format('tm', 'crossed')}, falling FROM cro")
def altitude_crossings(spark, sf):
    return S.crossings(sun(spark, sf), ["site", "evening"], "t", "alt", -18.0).select("site", "evening", text("at").alias("crossed"), "falling")


@query("dark_windows", "W6 F3", with_(REP, SUN, CRO) + f"""SELECT site, evening, {SPAN.format('CAST(tm AS DATE)', 'night_date')}, {SPAN.format('tm', 'dusk')}, {SPAN.format('nx', 'dawn')} FROM
  (SELECT *, lead(tm) OVER w AS nx, lead(falling) OVER w AS nf FROM cro WINDOW w AS (PARTITION BY site, evening ORDER BY tm)) WHERE falling AND NOT nf""")
def dark_windows(spark, sf):
    c = S.crossings(sun(spark, sf), ["site", "evening"], "t", "alt", -18.0)
    return S.dark_windows(c, ["site", "evening"]).select("site", "evening", *[text(x).alias(x) for x in ("night_date", "dusk", "dawn")])


@query("local_minima", "W7", with_(*BASE) + f"""SELECT site, source, day, {SPAN.format('hour', 'hour')}, round(cover + 1e-9, 6) + 0.0 AS cover FROM
  (SELECT *, lag(cover) OVER w AS p, lead(cover) OVER w AS n FROM (SELECT *, CAST(CAST(hour AS DATE) AS VARCHAR) AS day FROM ser WHERE cover IS NOT NULL)
   WINDOW w AS (PARTITION BY site, source, day ORDER BY hour)) WHERE cover <= p AND cover < n AND cover <= 0.3""")
def local_minima(spark, sf):
    s = series(spark, sf).filter("cover is not null").withColumn("day", F.to_date("hour").cast("string"))
    m = S.local_minima(s, ["site", "source", "day"], "hour", "cover", 0.3)
    return m.select("site", "source", "day", text("hour").alias("hour"), r6("cover").alias("cover"))


@query("sky_story", "W8 P18", with_(*BASE, MED) + f""", k AS (SELECT site, night_date, hour, CASE WHEN 1 - cover >= 0.6 THEN 'clear' WHEN 1 - cover < 0.35 THEN 'cloudy' ELSE 'mixed' END AS kind FROM med WHERE cover IS NOT NULL),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY site, night_date ORDER BY hour ROWS UNBOUNDED PRECEDING) AS run FROM
    (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY site, night_date ORDER BY hour) = kind THEN 0 ELSE 1 END AS nw FROM k)),
  r AS (SELECT *, count(*) OVER (PARTITION BY site, night_date) AS n FROM (SELECT site, night_date, run, min(kind) AS kind, min(hour) AS st, max(hour) AS en FROM g GROUP BY ALL)),
  x AS (SELECT *, row_number() OVER (PARTITION BY site, night_date ORDER BY st) AS i FROM r WHERE en > st OR n = 1)
  SELECT site, {NIGHT}, arg_min(kind, st) AS first_kind, arg_max(kind, st) AS last_kind, count(*) AS n_runs,
  {SPAN.format("max(CASE WHEN i = 2 THEN st - INTERVAL 30 MINUTE END)", 'change')} FROM x GROUP BY site, night_date""")
def sky_story(spark, sf):
    h = _median_hours(spark, sf).filter("cover is not null")
    p = 1 - F.col("cover")
    h = h.withColumn("kind", F.when(p >= 0.6, "clear").when(p < 0.35, "cloudy").otherwise("mixed"))
    s = S.story_runs(h, ["site", "night_date"], "kind")
    return s.select("site", text("night_date").alias("night_date"), "first_kind", "last_kind", "n_runs", text("change").alias("change"))


# ---------- labels, features, dataset ----------

LAB_NUM = ("asos_missing_frac", "era5_missing_frac", "goes_missing_frac", "truth_longest_clear_run", "truth_mean_cover", "asos_mean_cover", "era5_mean_cover", "goes_mean_cover")
LAB_TXT = ("usable_primary", "usable_asos", "usable_era5", "usable_asos_max", "usable_goes", "exclusion_primary", "exclusion_asos", "exclusion_era5", "exclusion_goes")


@query("night_labels", "A4 J3 P8 D7", with_(*BASE, LAB) + f"SELECT site, {NIGHT}, {', '.join(LAB_TXT)}, CAST(n_single_source_hours AS BIGINT) AS n_single_source_hours, {', '.join(f'round({c} + 1e-9, 6) + 0.0 AS {c}' for c in LAB_NUM)} FROM lab")
def night_labels(spark, sf):
    return labels(spark, sf).select("site", text("night_date").alias("night_date"), *LAB_TXT, big("n_single_source_hours").alias("n_single_source_hours"), *[r6(c).alias(c) for c in LAB_NUM])


@query("hourly_truth", "J3", with_(*BASE, LAB) + f"""SELECT site, {SPAN.format('hour', 'hour')}, round(greatest(asos, era5) + 1e-9, 6) + 0.0 AS truth, (asos IS NULL) <> (era5 IS NULL) AS single_source FROM tru""")
def hourly_truth(spark, sf):
    t = N.hourly_truth(N.widen_sources(series(spark, sf), ["asos", "era5"]))
    return t.select("site", text("hour").alias("hour"), r6("truth").alias("truth"), "single_source")


FE_COLS = [f"{m}_{f}" for m in (*MODELS, *BENCHMARKS) for f in N.FEATURES]


@query("forecast_features", "A5 A6 P12 J2", with_(*BASE, FC, FEA) + "SELECT site, " + NIGHT + ", lead, " + ", ".join(c if c.endswith("pred_usable") else f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in FE_COLS)
       + ", CAST(n_models_available AS BIGINT) AS n_models_available, round(spread_frac_clear + 1e-9, 6) + 0.0 AS spread_frac_clear FROM fe")
def forecast_features(spark, sf):
    f = features(spark, sf)
    return f.select("site", text("night_date").alias("night_date"), "lead", *[F.col(c) if c.endswith("pred_usable") else r6(c).alias(c) for c in FE_COLS],
                    big("n_models_available").alias("n_models_available"), r6("spread_frac_clear").alias("spread_frac_clear"))


@query("night_astronomy", "A7", with_(*BASE, MOON, NIT) + f"SELECT site, {NIGHT}, CAST(dark_hours AS BIGINT) AS dark_hours, round(moon_illum_mean + 1e-9, 6) + 0.0 AS moon_illum_mean, CAST(moon_free_dark_hours AS BIGINT) AS moon_free_dark_hours FROM nit")
def night_astronomy(spark, sf):
    base = hourly_base(spark, sf)
    n = N.night_table(windows(spark, sf, base), moon(spark, sf, base))
    return n.select("site", text("night_date").alias("night_date"), big("dark_hours").alias("dark_hours"), r6("moon_illum_mean").alias("moon_illum_mean"), big("moon_free_dark_hours").alias("moon_free_dark_hours"))


@query("modelling_dataset", "J2 P4 P5 D8 U1", with_(*FULL) + f"""SELECT site, {NIGHT}, lead, CAST(month AS BIGINT) AS month, season, split, CAST(dark_hours AS BIGINT) AS dark_hours, usable_primary,
  round(gfs_frac_clear + 1e-9, 6) + 0.0 AS gfs_frac_clear, round(spread_frac_clear + 1e-9, 6) + 0.0 AS spread_frac_clear, exclusion_primary FROM dat""")
def modelling_dataset(spark, sf):
    d = dataset(spark, sf)
    return d.select("site", text("night_date").alias("night_date"), "lead", big("month").alias("month"), "season", "split", big("dark_hours").alias("dark_hours"),
                    "usable_primary", r6("gfs_frac_clear").alias("gfs_frac_clear"), r6("spread_frac_clear").alias("spread_frac_clear"), "exclusion_primary")


FAULTY = "fy AS (SELECT site, night_date, lead, CASE WHEN lead = 1 THEN dark_hours + 12 ELSE dark_hours END AS dark_hours FROM dat UNION ALL SELECT site, night_date, lead, dark_hours FROM dat WHERE lead = 2)"


@query("dataset_problems", "Q11 S12", with_(*FULL, FAULTY) + """, bad AS (SELECT 'dark_hours outside 4-13' AS problem, count(*) AS n FROM fy WHERE dark_hours > 0 AND dark_hours NOT BETWEEN 4 AND 13
  UNION ALL SELECT 'duplicate keys', coalesce(sum(d), 0) FROM (SELECT count(*) - 1 AS d FROM fy GROUP BY site, night_date, lead)) SELECT problem, CAST(n AS BIGINT) AS n FROM bad WHERE n > 0""")
def dataset_problems(spark, sf):
    """On a table with known faults: one lead's nights made too long, another's rows repeated."""
    d = dataset(spark, sf)
    long = d.withColumn("dark_hours", F.when(F.col("lead") == 1, F.col("dark_hours") + 12).otherwise(F.col("dark_hours")))
    return N.validate_dataset(long.unionByName(d.filter("lead = 2")))


@query("design_matrix", "P6 P7 P23", with_(*FULL) + f"""SELECT site, {NIGHT}, lead, round(gfs_frac_clear + 1e-9, 6) + 0.0 AS gfs_frac_clear, round(ecmwf_mean_cover + 1e-9, 6) + 0.0 AS ecmwf_mean_cover,
  {', '.join(f"CAST(site = '{s}' AS DOUBLE) AS site_{s}" for s in SITES)}, round(sin(2 * pi() * month / 12) + 1e-9, 6) + 0.0 AS month_sin, round(cos(2 * pi() * month / 12) + 1e-9, 6) + 0.0 AS month_cos,
  CAST(dark_hours AS DOUBLE) AS dark_hours FROM dat""")
def design_matrix(spark, sf):
    m = N.design_matrix(dataset(spark, sf), N.feature_list(MODELS, 1), SITES, ["site", "night_date", "lead"])
    return m.select("site", text("night_date").alias("night_date"), "lead", r6("gfs_frac_clear").alias("gfs_frac_clear"), r6("ecmwf_mean_cover").alias("ecmwf_mean_cover"),
                    *[f"site_{s}" for s in SITES], r6("month_sin").alias("month_sin"), r6("month_cos").alias("month_cos"), "dark_hours")


MEM = "mem AS (SELECT r.site, r.source AS model, CAST(r.user_id % 7 AS VARCHAR) AS member, r.hour, max(r.cover) AS cover FROM rep r GROUP BY ALL)"


@query("ensemble_votes", "A12 D19", with_(*BASE, MEM) + f""", v AS ({runs_sql("(SELECT b.site, b.night_date, d.model, d.member, b.hour, m.cover FROM bb b JOIN (SELECT DISTINCT site, model, member FROM mem) d USING (site) LEFT JOIN mem m ON m.site = b.site AND m.model = d.model AND m.member = d.member AND m.hour = b.hour)", "site, night_date, model, member", miss="0.9")})
  SELECT site, {NIGHT}, model, round(avg(CAST(usable AS DOUBLE)) + 1e-9, 6) + 0.0 AS p_usable, count(usable) AS n_voting FROM v GROUP BY site, night_date, model""")
def ensemble_votes(spark, sf):
    r = reports(spark, sf).withColumn("member", (F.col("user_id") % 7).cast("string")).withColumnRenamed("source", "model")
    mem = S.hourly_cover(r, ["site", "model", "member"], "valid", "cover", "max")
    e = N.ensemble_p_usable(windows(spark, sf), mem, S.RunRules(max_missing=0.9))
    return e.select("site", text("night_date").alias("night_date"), "model", r6("p_usable").alias("p_usable"), "n_voting")


# ---------- coverage ----------

COV = """exp AS (SELECT DISTINCT site, CAST(night_date AS TIMESTAMP) + to_hours(CASE WHEN h < 12 THEN h + 24 ELSE h END) AS hour FROM win0, (SELECT unnest([23, 0, 1, 2, 3]) AS h)),
cov AS (SELECT e.site, year(e.hour) AS year, count(*) AS n, count(s.cover) AS v FROM exp e LEFT JOIN (SELECT * FROM ser WHERE source = 'asos') s USING (site, hour) GROUP BY ALL),
cv AS (SELECT site, year, sum(n) AS n_hours, sum(v) AS n_valid, sum(v) / sum(n) AS coverage FROM cov GROUP BY GROUPING SETS ((site), (site, year)))"""


def _coverage(spark, sf):
    days = windows(spark, sf).select("site", "night_date")
    exp = N.proxy_night_hours(days, ["site"], "night_date", "UTC", [23, 0, 1, 2, 3])
    return N.night_coverage(exp, series(spark, sf).filter("source = 'asos'"), ["site"])


@query("night_coverage", "A13 F4", with_(*BASE, COV) + "SELECT site, CAST(year AS BIGINT) AS year, CAST(n_hours AS BIGINT) AS n_hours, CAST(n_valid AS BIGINT) AS n_valid, round(coverage + 1e-9, 6) + 0.0 AS coverage FROM cv")
def night_coverage(spark, sf):
    return _coverage(spark, sf).select("site", big("year").alias("year"), big("n_hours").alias("n_hours"), big("n_valid").alias("n_valid"), r6("coverage").alias("coverage"))


@query("site_check", "A14 M37", with_(*BASE, COV) + """SELECT c.site, round(coalesce(cv.coverage, 0.0) + 1e-9, 6) + 0.0 AS coverage, coalesce(cv.coverage >= 0.85, false) AS passed, CASE WHEN cv.coverage IS NULL THEN 'not found' ELSE '' END AS note
  FROM (SELECT DISTINCT 'S' || CAST(n_nationkey % 4 AS VARCHAR) AS site FROM nation) c LEFT JOIN (SELECT * FROM cv WHERE year IS NULL) cv USING (site)""")
def site_check(spark, sf):
    cand = table(spark, sf, "nation").select(F.concat(F.lit("S"), (F.col("n_nationkey") % 4).cast("string")).alias("site")).distinct()
    return N.check_sites(cand, _coverage(spark, sf)).select("site", r6("coverage").alias("coverage"), "passed", "note")


@query("local_night_hours", "F4", with_(*BASE) + f"""SELECT DISTINCT site, {SPAN.format("timezone('America/Los_Angeles', CAST(night_date AS TIMESTAMP) + to_hours(CASE WHEN h < 12 THEN h + 24 ELSE h END)) AT TIME ZONE 'UTC'", 'hour')} FROM win0, (SELECT unnest([23, 0, 1, 2, 3]) AS h)""")
def local_night_hours(spark, sf):
    days = windows(spark, sf).select("site", "night_date")
    return N.proxy_night_hours(days, ["site"], "night_date", "America/Los_Angeles", [23, 0, 1, 2, 3]).select("site", text("hour").alias("hour"))


@query("last_complete_night", "A32", with_(REP) + "SELECT CAST(least(CAST(min(m) AS DATE) - 1, DATE '2024-08-31') AS VARCHAR) AS last_night FROM (SELECT site, source, max(valid) AS m FROM rep GROUP BY ALL)")
def last_complete_night(spark, sf):
    ends = reports(spark, sf).withColumnRenamed("valid", "ts")
    return N.cached_last_night(ends, "2024-08-31").select(F.col("last_night").cast("string").alias("last_night"))


AOD = "aod AS (SELECT site, hour, avg(k) / 100.0 AS aod FROM rep GROUP BY ALL)"


@query("night_aerosol", "A16", with_(*BASE, AOD) + f"""SELECT w.site, {SPAN.format('w.night_date', 'night_date')}, round(CASE WHEN count(a.aod) >= greatest(2, CAST(floor(floor((epoch(any_value(w.dawn)) - epoch(any_value(w.dusk))) / 3600) / 2) AS INTEGER)) THEN quantile_cont(a.aod, 0.5) END + 1e-9, 6) + 0.0 AS aod
  FROM win w LEFT JOIN aod a ON a.site = w.site AND a.hour BETWEEN date_trunc('hour', w.dusk) AND date_trunc('hour', w.dawn + INTERVAL '3599999999 microseconds') GROUP BY w.site, w.night_date""")
def night_aerosol(spark, sf):
    a = reports(spark, sf).groupBy("site", T.centred_hour(F.col("valid")).alias("hour")).agg((F.avg("k") / 100).alias("aod"))
    return N.night_aod(windows(spark, sf), a).select("site", text("night_date").alias("night_date"), r6("aod").alias("aod"))


# ---------- calendar and set operations ----------


@query("week_and_season", "F6 P5", """SELECT (isoyear(o_orderdate) * 100 + weekofyear(o_orderdate))::BIGINT AS week, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'MAM'
  WHEN month(o_orderdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n FROM orders GROUP BY ALL""")
def week_and_season(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").groupBy(big(T.week_code(d)).alias("week"), T.season(F.month(d)).alias("season")).agg(F.count("*").alias("n"))


@query("split_counts", "P4", """SELECT CASE WHEN d BETWEEN DATE '1999-01-01' AND DATE '2000-06-30' THEN 'test' WHEN d BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train' ELSE 'none' END AS split, count(*) AS n
  FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1""")
def split_counts(spark, sf):
    s = T.assign_split(F.to_date("o_orderdate"), ("1995-01-01", "1998-12-31"), ("1999-01-01", "2000-06-30"))
    return table(spark, sf, "orders").groupBy(s.alias("split")).agg(F.count("*").alias("n"))


@query("range_chunks", "F5", """WITH r AS (SELECT o_custkey AS cust, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders GROUP BY 1),
  m AS (SELECT cust, 'month' AS unit, greatest(CAST(m AS DATE), lo) AS a, least(last_day(CAST(m AS DATE)), hi) AS b FROM (SELECT *, unnest(generate_series(date_trunc('month', lo), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM r)),
  y AS (SELECT cust, 'year' AS unit, greatest(CAST(m AS DATE), lo) AS a, least(CAST(m + INTERVAL 1 YEAR AS DATE), hi + 1) AS b FROM (SELECT *, unnest(generate_series(date_trunc('year', lo), CAST(hi AS TIMESTAMP), INTERVAL 1 YEAR)) AS m FROM r))
  SELECT cust, unit, CAST(a AS VARCHAR) AS lo, CAST(b AS VARCHAR) AS hi FROM (SELECT * FROM m UNION ALL SELECT * FROM y)""")
def range_chunks(spark, sf):
    d = F.to_date("o_orderdate")
    r = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.min(d).alias("lo"), F.max(d).alias("hi"))
    part = lambda unit, arr: r.select("cust", F.lit(unit).alias("unit"), F.explode(arr).alias("c")).select("cust", "unit", F.col("c.lo").cast("string").alias("lo"), F.col("c.hi").cast("string").alias("hi"))
    return part("month", T.month_chunks(F.col("lo"), F.col("hi"))).unionByName(part("year", T.year_chunks(F.col("lo"), F.col("hi"))))


@query("moment_nights", "F3", """SELECT CAST(CAST(timezone('America/Los_Angeles', ts AT TIME ZONE 'UTC') - INTERVAL 12 HOUR AS DATE) AS VARCHAR) AS night_date, count(*) AS n FROM events GROUP BY 1""")
def moment_nights(spark, sf):
    n = T.night_of_moment(F.col("ts").cast("timestamp"), "America/Los_Angeles").cast("string")
    return table(spark, sf, "events").groupBy(n.alias("night_date")).agg(F.count("*").alias("n"))


@query("hours_union", "U2", with_(*BASE) + f"SELECT DISTINCT {SPAN.format('hour', 'hour')} FROM bb")
def hours_union(spark, sf):
    return S.backbone(windows(spark, sf), ["site", "night_date"], "dusk", "dawn").select(text("hour").alias("hour")).distinct()


DONE = "done AS (SELECT hour FROM (SELECT DISTINCT site, hour FROM ser WHERE source = 'goes') GROUP BY hour HAVING count(*) = (SELECT count(DISTINCT site) FROM ser WHERE source = 'goes'))"


@query("hours_still_to_do", "J9 U3 U4", with_(*BASE, DONE) + f"SELECT DISTINCT {SPAN.format('hour', 'hour')} FROM bb WHERE hour NOT IN (SELECT hour FROM done)")
def hours_still_to_do(spark, sf):
    from nightfold.operators.merge import not_done_everywhere

    wanted = S.backbone(windows(spark, sf), ["site", "night_date"], "dusk", "dawn").select("hour").distinct()
    return not_done_everywhere(wanted, series(spark, sf).filter("source = 'goes'"), "hour", "site").select(text("hour").alias("hour"))


@query("first_and_last_wins", "U5 T1 S4 S5", """SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_min(event_id, event_id) AS first_id, arg_max(event_id, event_id) AS last_id FROM events GROUP BY ALL""")
def first_and_last_wins(spark, sf):
    from nightfold.operators.merge import first_wins, later_wins

    e = table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    keys = ["user_id", "event_type", "day"]
    a = first_wins(e, keys, ["event_id"]).select(*keys, F.col("event_id").alias("first_id"))
    return a.join(later_wins(e, keys, ["event_id"]).select(*keys, F.col("event_id").alias("last_id")), keys)


@query("one_row_per_night", "P25", with_(*FULL) + f"SELECT site, {NIGHT}, lead, split FROM dat WHERE lead = (SELECT min(lead) FROM dat)")
def one_row_per_night(spark, sf):
    from nightfold.operators.quality import one_row_per_night as lowest

    return lowest(dataset(spark, sf)).select("site", text("night_date").alias("night_date"), "lead", "split")
