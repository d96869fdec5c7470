"""Logical tables (reports, hourly series, windows, forecasts, places, predictions) derived from the
supplied tables, each as a DataFrame and as the SQL of the same relation.

Every derivation keeps every row of its source: keys and values are computed from columns, nothing is
filtered away to make a check cheaper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightfold.operators.timeseries import RunRules, hourly_cover, observation_cover
from nightfold.util import as_ts

LEADS = (1, 2, 3, 4, 5, 6, 7)
MODELS = {"gfs": LEADS, "ecmwf": LEADS[:5]}  # one model stops earlier
BENCHMARKS = {"nbm": LEADS}
# Sparse reports: nights keep a label unless more than 60 % of their hours are missing.
RULES = RunRules(max_missing=0.6)
TRAIN, TEST = ("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-01-31")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(c: Column | str) -> Column:
    """Timestamps and dates as text, so that two engines compare them the same way."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def r6(c: Column | str, places: int = 6) -> Column:
    """Rounded for comparison: nudged off exact halves, negative zero folded into zero."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), places) + F.lit(0.0)


def R(expr: str, places: int = 6) -> str:
    """SQL twin of `r6`."""
    return f"round({expr} + 1e-9, {places}) + 0.0"


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------- reports ----------

SOURCE_OF = {"view": "asos", "click": "era5", "signup": "goes", "purchase": "gfs", "error": "ecmwf"}
SITES = ("S0", "S1", "S2")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Station reports: three sites, five sources, layer codes for the station source, a cover for the rest."""
    e = table(spark, sf, "events")
    source = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_OF.items() for x in kv]), F.col("event_type"))
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    code1 = (
        F.when(v < 10, "CLR").when(v < 25, "few ").when(v < 45, "SCT").when(v < 80, "BKN").when(v < 150, "OVC").otherwise("M")
    )
    code2 = F.when(k < 60, "").when(k < 80, "FEW").when(k < 95, " sct").otherwise("VV")
    r = e.select(
        "event_id", "user_id", F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("site"),
        source.alias("source"), as_ts("ts").alias("valid"), v.alias("value"), k.alias("k"),
        code1.alias("skyc1"), code2.alias("skyc2"),
    )
    layered = observation_cover(["skyc1", "skyc2"])
    return r.withColumn(
        "cover", F.when(F.col("source") == "asos", layered).otherwise(F.least(F.col("value"), F.lit(100.0)) / 100)
    )


_MODES = {"default": 0.1875, "conservative": 0.25}


def code_sql(c: str, mode: str = "default") -> str:
    return (
        f"CASE upper(trim({c})) WHEN 'CLR' THEN 0.0::DOUBLE WHEN 'FEW' THEN {_MODES[mode]}::DOUBLE WHEN 'SCT' THEN 0.4375::DOUBLE "
        f"WHEN 'BKN' THEN 0.75::DOUBLE WHEN 'OVC' THEN 1.0::DOUBLE WHEN 'VV' THEN 1.0::DOUBLE END"
    )


REP = f"""rep0 AS (SELECT event_id, user_id, 'S' || CAST(user_id % 3 AS VARCHAR) AS site,
  CASE event_type WHEN 'view' THEN 'asos' WHEN 'click' THEN 'era5' WHEN 'signup' THEN 'goes' WHEN 'purchase' THEN 'gfs' ELSE 'ecmwf' END AS source,
  ts AS valid, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
rep1 AS (SELECT *, CASE WHEN value < 10 THEN 'CLR' WHEN value < 25 THEN 'few ' WHEN value < 45 THEN 'SCT' WHEN value < 80 THEN 'BKN'
    WHEN value < 150 THEN 'OVC' ELSE 'M' END AS skyc1,
  CASE WHEN k < 60 THEN '' WHEN k < 80 THEN 'FEW' WHEN k < 95 THEN ' sct' ELSE 'VV' END AS skyc2 FROM rep0),
rep AS (SELECT *, CASE WHEN source = 'asos' THEN greatest({code_sql('skyc1')}, {code_sql('skyc2')})
  ELSE least(value, 100.0::DOUBLE) / 100 END AS cover,
  date_trunc('hour', valid + INTERVAL '1799999999 microseconds') AS hour FROM rep1)"""


def hourly_base(spark: SparkSession, sf: str) -> DataFrame:
    """The one pass over the raw reports that everything hourly is derived from: per (site, source, centred
    hour, clock hour) the nearest and the cloudiest parseable report. Hours x sources small, whatever the
    number of reports; written once to the shared checkpoint folder, so a plan that needs windows, series
    and Moon times reads the raw table a single time."""
    from nightfold.functions.timefn import centred_hour
    from nightfold.util import cut_lineage

    r = reports(spark, sf).withColumn("hour", centred_hour(F.col("valid")))
    away = F.abs(F.unix_micros("valid") - F.unix_micros("hour"))
    best = F.when(F.col("cover").isNotNull(), F.struct(away.alias("d"), (-F.col("cover")).alias("c")))
    g = r.groupBy("site", "source", "hour", F.date_trunc("hour", "valid").alias("clock"))
    return cut_lineage(g.agg(F.min(best).alias("best"), F.max("cover").alias("top")))


def series(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """Hourly (site, source, hour, cover): nearest report per centred hour."""
    if base is None:
        return hourly_cover(reports(spark, sf), ["site", "source"], "valid", "cover")
    return base.groupBy("site", "source", "hour").agg((-F.min("best")["c"]).alias("cover"))


SER = """ser AS (SELECT site, source, hour, -(min(CASE WHEN cover IS NOT NULL
    THEN {'d': abs(epoch_us(valid) - epoch_us(hour)), 'c': -cover} END)).c AS cover FROM rep GROUP BY ALL)"""


# ---------- windows ----------


def windows(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """A dark window per site and date seen in the reports; one site has no darkness on the 15th."""
    seen = reports(spark, sf).select("site", F.col("valid").alias("clock")) if base is None else base
    d = seen.select("site", F.to_date("clock").alias("night_date")).distinct()
    day, idx = F.dayofmonth("night_date"), F.substring("site", 2, 1).cast("int")
    at = lambda minutes: F.timestamp_micros((F.unix_date("night_date").cast("long") * 1440 + minutes) * 60000000)
    none = (day == 15) & (F.col("site") == "S2")
    return d.select(
        "site", "night_date",
        F.when(~none, at(1080 + 2 * day + 10 * idx)).alias("dusk"), F.when(~none, at(1770 - day)).alias("dawn"),
    )


WIN = """win0 AS (SELECT DISTINCT site, CAST(valid AS DATE) AS night_date FROM rep),
win AS (SELECT site, night_date,
  CASE WHEN NOT (day(night_date) = 15 AND site = 'S2') THEN CAST(night_date AS TIMESTAMP) + to_minutes(1080 + 2 * day(night_date) + 10 * CAST(site[2:2] AS INTEGER)) END AS dusk,
  CASE WHEN NOT (day(night_date) = 15 AND site = 'S2') THEN CAST(night_date AS TIMESTAMP) + to_minutes(1770 - day(night_date)) END AS dawn
  FROM win0),
bb AS (SELECT site, night_date, dusk, dawn, unnest(generate_series(date_trunc('hour', dusk + INTERVAL '3599999999 microseconds'),
  date_trunc('hour', dawn), INTERVAL 1 HOUR)) AS hour FROM win WHERE dusk IS NOT NULL)"""


# ---------- forecasts ----------


def forecasts(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """(site, model, lead, hour, cover): what a model's series said `lead` days before the hour."""
    s = series(spark, sf, base)
    model = F.when(F.col("source") == "goes", "nbm").otherwise(F.col("source"))
    f = s.filter(F.col("source").isin("gfs", "ecmwf", "goes")).withColumn("model", model)
    lead = F.explode(F.array(*[F.lit(x) for x in LEADS])).alias("lead")
    return f.select("site", "model", "hour", "cover", lead).withColumn(
        "hour", F.col("hour") + F.make_dt_interval(F.col("lead"))
    )


FC = """fc AS (SELECT site, CASE source WHEN 'goes' THEN 'nbm' ELSE source END AS model, lead, hour + to_days(lead) AS hour, cover
  FROM ser, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS lead) WHERE source IN ('gfs', 'ecmwf', 'goes'))"""


def runs_sql(rel: str, keys: str, thr: str = "0.2", run: int = 3, miss: str = "0.25") -> str:
    """SQL of the run summary over a relation with one row per (keys, hour) and a cover column."""
    return f"""SELECT {keys}, sum(h) AS n_hours, 1 - sum(v) / sum(h) AS missing_frac,
  CASE WHEN 1 - sum(v) / sum(h) <= {miss} AND sum(v) > 0 THEN sum(c) / sum(v) END AS frac_clear,
  CASE WHEN 1 - sum(v) / sum(h) <= {miss} THEN CAST(max(c) AS DOUBLE) END AS longest_clear_run,
  CASE WHEN 1 - sum(v) / sum(h) <= {miss} THEN max(c) / sum(h) END AS longest_clear_run_frac,
  CASE WHEN 1 - sum(v) / sum(h) <= {miss} THEN sum(s) / sum(v) END AS mean_cover,
  CASE WHEN 1 - sum(v) / sum(h) <= {miss} THEN max(c) >= {run} END AS usable
FROM (SELECT {keys}, block, count(*) AS h, count(cover) AS v, sum(cover) AS s, sum(clear) AS c FROM
  (SELECT *, sum(1 - clear) OVER (PARTITION BY {keys} ORDER BY hour ROWS UNBOUNDED PRECEDING) AS block FROM
    (SELECT {keys}, hour, cover, CASE WHEN cover <= {thr} + 1e-9 THEN 1 ELSE 0 END AS clear FROM {rel}))
  GROUP BY {keys}, block) GROUP BY {keys}"""


# ---------- labels, features and the modelling table ----------


def wide_hours(spark: SparkSession, sf: str, base: DataFrame) -> DataFrame:
    """One column per source, and the cloudiest-report variant of the station source, in one aggregation."""
    hours = base.groupBy("site", "source", "hour").agg((-F.min("best")["c"]).alias("cover"), F.max("top").alias("top"))
    pick = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    return hours.groupBy("site", "hour").agg(*[pick(s, "cover").alias(s) for s in ("asos", "era5", "goes")], pick("asos", "top").alias("asos_max"))


def labels(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    from nightfold.operators.nights import build_labels

    base = hourly_base(spark, sf) if base is None else base
    return build_labels(windows(spark, sf, base), wide_hours(spark, sf, base), RULES)


def features(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    from nightfold.operators.nights import build_features

    base = hourly_base(spark, sf) if base is None else base
    return build_features(windows(spark, sf, base), forecasts(spark, sf, base), MODELS, BENCHMARKS, LEADS, RULES)


def moon(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """(site, hour, illum, alt) at every hour that any report falls in."""
    seen = reports(spark, sf).select("site", F.date_trunc("hour", "valid").alias("clock")) if base is None else base
    h = seen.select("site", F.col("clock").alias("hour")).distinct()
    hrs = F.unix_timestamp("hour") / 3600.0
    return h.select(
        "site", "hour", ((1 + F.cos(hrs * (2 * F.pi() / 708.7))) / 2).alias("illum"),
        (60 * F.sin(hrs * (2 * F.pi() / 24.84) + F.substring("site", 2, 1).cast("int"))).alias("alt"),
    )


MOON = """moon AS (SELECT site, hour, (1 + cos(hrs * (2 * pi() / 708.7))) / 2 AS illum, 60 * sin(hrs * (2 * pi() / 24.84) + CAST(site[2:2] AS INTEGER)) AS alt
  FROM (SELECT DISTINCT site, date_trunc('hour', valid) AS hour, epoch(date_trunc('hour', valid)) / 3600.0 AS hrs FROM rep))"""


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    from nightfold.operators.nights import build_dataset, night_table

    base = hourly_base(spark, sf)
    nights = night_table(windows(spark, sf, base), moon(spark, sf, base))
    return build_dataset(nights, labels(spark, sf, base), features(spark, sf, base), TRAIN, TEST)


def _src(name: str, pick: str) -> str:
    return f"""{name} AS ({runs_sql(f"(SELECT b.site, b.night_date, b.hour, s.cover FROM bb b LEFT JOIN ({pick}) s USING (site, hour))", "site, night_date", miss="0.6")})"""


WIDE = """top AS (SELECT site, hour, max(cover) AS cover FROM rep WHERE source = 'asos' GROUP BY ALL),
tru AS (SELECT site, hour, max(CASE WHEN source = 'asos' THEN cover END) AS asos, max(CASE WHEN source = 'era5' THEN cover END) AS era5 FROM ser GROUP BY ALL)"""
LAB = ",\n".join([
    WIDE,
    *[_src(f"l_{s}", f"SELECT site, hour, cover FROM ser WHERE source = '{s}'") for s in ("asos", "era5", "goes")],
    _src("l_max", "SELECT site, hour, cover FROM top"),
    _src("l_tru", "SELECT site, hour, greatest(asos, era5) AS cover FROM tru"),
    """one AS (SELECT b.site, b.night_date, sum(CASE WHEN (t.asos IS NULL) <> (t.era5 IS NULL) THEN 1 ELSE 0 END) AS n_single FROM bb b
  LEFT JOIN tru t USING (site, hour) GROUP BY ALL)""",
    """lab AS (SELECT w.site, w.night_date,
  CASE WHEN w.dusk IS NOT NULL AND a.missing_frac <= 0.6 AND e.missing_frac <= 0.6 THEN t.usable END AS usable_primary,
  a.usable AS usable_asos, e.usable AS usable_era5, m.usable AS usable_asos_max, g.usable AS usable_goes,
  a.missing_frac AS asos_missing_frac, e.missing_frac AS era5_missing_frac, g.missing_frac AS goes_missing_frac,
  coalesce(one.n_single, 0) AS n_single_source_hours, t.longest_clear_run AS truth_longest_clear_run, t.mean_cover AS truth_mean_cover,
  a.mean_cover AS asos_mean_cover, e.mean_cover AS era5_mean_cover, g.mean_cover AS goes_mean_cover,
  CASE WHEN w.dusk IS NULL THEN 'no_darkness' WHEN a.missing_frac > 0.6 AND e.missing_frac > 0.6 THEN 'asos_and_era5_missing'
    WHEN a.missing_frac > 0.6 THEN 'asos_missing' WHEN e.missing_frac > 0.6 THEN 'era5_missing' END AS exclusion_primary,
  CASE WHEN w.dusk IS NULL THEN 'no_darkness' WHEN a.missing_frac > 0.6 THEN 'asos_missing' END AS exclusion_asos,
  CASE WHEN w.dusk IS NULL THEN 'no_darkness' WHEN e.missing_frac > 0.6 THEN 'era5_missing' END AS exclusion_era5,
  CASE WHEN w.dusk IS NULL THEN 'no_darkness' WHEN g.missing_frac > 0.6 THEN 'goes_missing' END AS exclusion_goes
  FROM win w LEFT JOIN l_asos a USING (site, night_date) LEFT JOIN l_era5 e USING (site, night_date) LEFT JOIN l_goes g USING (site, night_date)
  LEFT JOIN l_max m USING (site, night_date) LEFT JOIN l_tru t USING (site, night_date) LEFT JOIN one USING (site, night_date))""",
])

_FEATS = ("frac_clear", "longest_clear_run", "longest_clear_run_frac", "mean_cover", "usable", "missing_frac")


def _feature_sql() -> str:
    spine = "(SELECT b.site, b.night_date, l.lead, m.model, b.hour FROM bb b, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS lead) l, (SELECT unnest(['gfs', 'ecmwf', 'nbm']) AS model) m)"
    rel = f"""(SELECT x.site, x.night_date, x.lead, x.model, x.hour, f.cover FROM {spine} x
      LEFT JOIN fc f ON f.site = x.site AND f.model = x.model AND f.lead = x.lead AND f.hour = x.hour AND NOT (x.model = 'ecmwf' AND x.lead > 5))"""
    cols = []
    for m in ("gfs", "ecmwf", "nbm"):
        for f in _FEATS:
            out = "pred_usable" if f == "usable" else f
            pick = "bool_or" if f == "usable" else "max"
            body = f"{pick}(CASE WHEN f.model = '{m}' THEN f.{f} END)"
            cols.append(f"{'coalesce(' + body + ', 1.0)' if f == 'missing_frac' else body} AS {m}_{out}")
    return f"""fr AS ({runs_sql(rel, "site, night_date, lead, model", miss="0.6")}),
fe AS (SELECT w.site, w.night_date, l.lead, {", ".join(cols)},
  count(CASE WHEN f.model <> 'nbm' THEN f.frac_clear END) AS n_models_available,
  CASE WHEN count(CASE WHEN f.model <> 'nbm' THEN f.frac_clear END) >= 2 THEN stddev_pop(CASE WHEN f.model <> 'nbm' THEN f.frac_clear END) END AS spread_frac_clear
  FROM (win w CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS lead) l) LEFT JOIN fr f ON f.site = w.site AND f.night_date = w.night_date AND f.lead = l.lead GROUP BY w.site, w.night_date, l.lead)"""


FEA = _feature_sql()
NIT = """nit AS (SELECT w.site, w.night_date, w.dusk, w.dawn, count(b.hour) AS dark_hours, avg(m.illum) AS moon_illum_mean,
  coalesce(sum(CASE WHEN m.alt < 0 THEN 1 ELSE 0 END), 0) AS moon_free_dark_hours
  FROM win w LEFT JOIN bb b ON b.site = w.site AND b.night_date = w.night_date LEFT JOIN moon m ON m.site = b.site AND m.hour = b.hour GROUP BY ALL)"""
SEASON_SQL = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'DJF' WHEN month({0}) IN (3, 4, 5) THEN 'MAM' WHEN month({0}) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"
DAT = f"""dat AS (SELECT f.*, n.* EXCLUDE (site, night_date), l.* EXCLUDE (site, night_date), month(f.night_date) AS month,
  {SEASON_SQL.format('f.night_date')} AS season,
  CASE WHEN f.night_date BETWEEN DATE '2024-01-21' AND DATE '2024-01-31' THEN 'test' WHEN f.night_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' THEN 'train' ELSE 'none' END AS split
  FROM fe f JOIN nit n USING (site, night_date) JOIN lab l USING (site, night_date))"""
BASE = (REP, SER, WIN)
FULL = (REP, SER, WIN, FC, MOON, LAB, FEA, NIT, DAT)
