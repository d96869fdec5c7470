"""Labels, forecast features, astronomy per night and coverage: everything keyed (site, night)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightfold.functions.timefn import assign_split, hours_inside, season, wall_clock_to_utc
from nightfold.operators.timeseries import (
    RunRules, attach_windows, summary_aggs, summary_columns,
)
from nightfold.util import as_ts

LABELS = {"primary": "usable_primary", "asos": "usable_asos", "era5": "usable_era5", "goes": "usable_goes"}
FEATURES = ("frac_clear", "longest_clear_run", "longest_clear_run_frac", "mean_cover", "pred_usable", "missing_frac")
MODEL_INPUTS = ("frac_clear", "longest_clear_run_frac", "mean_cover")
LAYERS = ("low", "mid", "high")
KEYS = ["site", "night_date"]


def widen_sources(series: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(site, source, hour, cover) to one row per (site, hour) with a column per listed source."""
    return series.groupBy("site", "hour").agg(
        *[F.max(F.when(F.col("source") == s, F.col("cover"))).alias(s) for s in sources]
    )


def hourly_truth(wide: DataFrame) -> DataFrame:
    """Adds the cloudier of the two truths (one alone counts) and the flag for 'only one was there'."""
    return wide.withColumn("truth", F.greatest("asos", "era5")).withColumn(
        "single_source", F.isnull("asos") != F.isnull("era5")
    )


def exclusion_reason(no_dark: Column, asos_bad: Column, era5_bad: Column) -> Column:
    """Why a two-source label is missing; no darkness beats every other reason."""
    return (
        F.when(no_dark, "no_darkness")
        .when(asos_bad & era5_bad, "asos_and_era5_missing")
        .when(asos_bad, "asos_missing")
        .when(era5_bad, "era5_missing")
    )


def single_source_reason(no_dark: Column, bad: Column, reason: str) -> Column:
    return F.when(no_dark, "no_darkness").when(bad, reason)


def build_labels(windows: DataFrame, wide: DataFrame, rules: RunRules = RunRules()) -> DataFrame:
    """Every label of every night from one pass over the hourly table (columns asos, asos_max, era5, goes,
    low, mid, high; any of the last five may be absent). All sources share one aggregation, so the number
    of shuffles does not grow with the number of labels."""
    cols = [c for c in ("asos", "era5", "asos_max", "goes", *LAYERS) if c in wide.columns]
    hours = attach_windows(hourly_truth(wide), windows, ["site"], "night_date", "dusk", "dawn")
    aggs = [a for c in (*cols, "truth") for a in summary_aggs(F.col(c), rules, c)]
    parts = hours.groupBy(*KEYS).agg(*aggs, F.sum(F.col("single_source").cast("int")).alias("_single"))
    w = windows.select(*KEYS, "dusk", "dawn", hours_inside(as_ts("dusk"), as_ts("dawn")).alias("n_hours"))
    full = w.join(parts, KEYS, "left")
    flat = full.select(
        *KEYS, "n_hours", F.isnull("dusk").alias("_no_dark"), F.coalesce("_single", F.lit(0)).alias("n_single_source_hours"),
        *[c for p in (*cols, "truth") for c in summary_columns(F.col("n_hours"), rules, p, f"_{p}_")],
    )
    null_bool, null_double = F.lit(None).cast("boolean"), F.lit(None).cast("double")
    get = lambda p, f, absent: F.col(f"_{p}_{f}") if p in (*cols, "truth") else absent
    no_dark = F.col("_no_dark")
    bad = {
        p: F.coalesce(get(p, "missing_frac", F.when(F.col("n_hours") > 0, 1.0)) > rules.max_missing, F.lit(False))
        for p in ("asos", "era5", "goes")
    }
    never = F.lit(False)
    usable = lambda c: F.when(~no_dark, c)
    return flat.select(
        *KEYS,
        F.when(~no_dark & ~bad["asos"] & ~bad["era5"], F.col("_truth_usable")).alias("usable_primary"),
        usable(get("asos", "usable", null_bool)).alias("usable_asos"),
        usable(get("era5", "usable", null_bool)).alias("usable_era5"),
        usable(get("asos_max", "usable", null_bool)).alias("usable_asos_max"),
        usable(get("goes", "usable", null_bool)).alias("usable_goes"),
        F.col("_asos_missing_frac").alias("asos_missing_frac"),
        F.col("_era5_missing_frac").alias("era5_missing_frac"),
        get("goes", "missing_frac", F.when(F.col("n_hours") > 0, 1.0)).alias("goes_missing_frac"),
        "n_single_source_hours",
        F.col("_truth_longest_clear_run").alias("truth_longest_clear_run"),
        F.col("_truth_mean_cover").alias("truth_mean_cover"),
        F.col("_asos_mean_cover").alias("asos_mean_cover"),
        F.col("_era5_mean_cover").alias("era5_mean_cover"),
        get("goes", "mean_cover", null_double).alias("goes_mean_cover"),
        *[F.col(f"_{x}_mean_cover").alias(f"era5_{x}_mean_cover") for x in LAYERS if x in cols],
        exclusion_reason(no_dark, bad["asos"], bad["era5"]).alias("exclusion_primary"),
        exclusion_reason(no_dark, bad["asos"], never).alias("exclusion_asos"),
        exclusion_reason(no_dark, never, bad["era5"]).alias("exclusion_era5"),
        single_source_reason(no_dark, bad["goes"], "goes_missing").alias("exclusion_goes"),
    )


def spread(columns: Sequence[Column]) -> tuple[Column, Column]:
    """(how many are present, their population standard deviation or NULL below two)."""
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    n = F.size(present)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    mean = total(present) / n
    var = total(F.transform(present, lambda x: (x - mean) * (x - mean))) / n
    return n, F.when(n >= 2, F.sqrt(var))


def mean_present(columns: Sequence[Column]) -> Column:
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))


def build_features(
    windows: DataFrame,
    forecasts: DataFrame,
    models: dict[str, Sequence[int]],
    benchmarks: dict[str, Sequence[int]],
    leads: Sequence[int],
    rules: RunRules = RunRules(),
) -> DataFrame:
    """Wide per-(site, night, lead) features from long forecasts (site, model, lead, hour, cover).

    One conditional aggregation covers every model, so there is no pivot stage. A lead a model does not
    have, or a night it has no rows for, is NULL with missing_frac 1. Spread and model count use members
    only: a benchmark never changes them.
    """
    everyone = {**models, **benchmarks}
    hours = attach_windows(forecasts, windows, ["site"], "night_date", "dusk", "dawn")
    has = {m: (F.col("model") == m) & F.col("lead").isin(list(ls)) for m, ls in everyone.items()}
    aggs = [a for m in everyone for a in summary_aggs(F.when(has[m], F.col("cover")), rules, m)]
    parts = hours.groupBy(*KEYS, "lead").agg(*aggs)
    spine = windows.select(
        *KEYS, hours_inside(as_ts("dusk"), as_ts("dawn")).alias("n_hours"),
        F.explode(F.array(*[F.lit(x) for x in leads])).alias("lead"),
    )
    full = spine.join(parts, [*KEYS, "lead"], "left")
    cols = []
    for m in everyone:
        named = dict(zip(
            ("missing_frac", "frac_clear", "longest_clear_run", "longest_clear_run_frac", "mean_cover", "pred_usable"),
            summary_columns(F.col("n_hours"), rules, m), strict=True))
        named["missing_frac"] = F.coalesce(named["missing_frac"], F.lit(1.0))
        cols += [named[f].alias(f"{m}_{f}") for f in FEATURES]
    wide = full.select(*KEYS, "lead", *cols)
    n, sd = spread([F.col(f"{m}_frac_clear") for m in models])
    return wide.withColumn("n_models_available", n).withColumn("spread_frac_clear", sd)


def feature_list(models: dict[str, Sequence[int]], lead: int) -> list[str]:
    """Input columns of a blend at this lead: three per member, plus the spread with two or more."""
    here = [m for m, ls in models.items() if lead in ls]
    return [f"{m}_{f}" for m in here for f in MODEL_INPUTS] + (["spread_frac_clear"] if len(here) >= 2 else [])


def night_table(windows: DataFrame, moon: DataFrame) -> DataFrame:
    """Windows plus dark hours, mean Moon illumination over them and how many have the Moon down.
    `moon`: (site, hour, illum, alt). Nights without darkness keep their row with zeros."""
    lit = attach_windows(moon, windows, ["site"], "night_date", "dusk", "dawn")
    per = lit.groupBy(*KEYS).agg(
        F.avg("illum").alias("moon_illum_mean"),
        F.sum((F.col("alt") < 0).cast("int")).alias("moon_free_dark_hours"),
    )
    out = windows.withColumn("dark_hours", hours_inside(as_ts("dusk"), as_ts("dawn"))).join(per, KEYS, "left")
    return out.withColumn("moon_free_dark_hours", F.coalesce("moon_free_dark_hours", F.lit(0)))


def build_dataset(
    nights: DataFrame, labels: DataFrame, features: DataFrame, train: tuple[str, str], test: tuple[str, str]
) -> DataFrame:
    """The modelling table: features ⋈ per-night columns, plus month, season and split."""
    per_night = nights.join(labels, KEYS)
    out = features.join(per_night, KEYS, "left").withColumn("month", F.month("night_date"))
    return out.withColumn("season", season(F.col("month"))).withColumn(
        "split", assign_split(F.col("night_date"), train, test)
    )


def context_columns(sites: Sequence[str]) -> list[Column]:
    """Site one-hot, month as a point on a circle, dark hours."""
    angle = 2 * F.pi() * F.col("month") / 12
    return [
        *[(F.col("site") == s).cast("double").alias(f"site_{s}") for s in sites],
        F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos"), F.col("dark_hours").cast("double").alias("dark_hours"),
    ]


def design_matrix(rows: DataFrame, features: Sequence[str], sites: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """`keep` columns, then the feature columns in order, then the context columns."""
    return rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in features], *context_columns(sites))


def ensemble_p_usable(windows: DataFrame, members: DataFrame, rules: RunRules = RunRules()) -> DataFrame:
    """Share of an ensemble's members whose own forecast makes the night usable, and how many could vote.
    `members`: (site, model, member, hour, cover)."""
    from nightfold.operators.timeseries import run_summary

    votes = run_summary(windows, members, ["site"], "night_date", "dusk", "dawn", "cover", rules, by=["model", "member"])
    return votes.groupBy(*KEYS, "model").agg(
        F.avg(F.col("usable").cast("double")).alias("p_usable"), F.count("usable").alias("n_voting")
    )


# ---------- coverage ----------


def proxy_night_hours(days: DataFrame, keys: Sequence[str], day: str, tz: str, local_hours: Sequence[int]) -> DataFrame:
    """UTC instants of fixed local night hours; hours before noon belong to the night before."""
    rows = days.select(*keys, day, F.explode(F.array(*[F.lit(h) for h in local_hours])).alias("_h"))
    local_day = F.when(F.col("_h") < 12, F.date_add(day, 1)).otherwise(F.col(day))
    wall = local_day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("_h"))
    utc = wall_clock_to_utc(wall.cast("timestamp"), tz)
    return rows.select(*keys, utc.alias("hour")).filter("hour is not null").distinct()


def night_coverage(expected: DataFrame, hourly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of expected hours that hold a value, per key and year and (year NULL) overall."""
    seen = expected.join(hourly.select(*keys, "hour", "cover"), [*keys, "hour"], "left")
    per = seen.groupBy(*keys, F.year("hour").alias("year")).agg(
        F.count("*").alias("_n"), F.count("cover").alias("_v")
    )
    sets = per.rollup(*keys, "year").agg(
        F.sum("_n").alias("n_hours"), F.sum("_v").alias("n_valid"), F.grouping_id().alias("_g")
    )
    return sets.filter("_g in (0, 1)").drop("_g").withColumn("coverage", F.col("n_valid") / F.col("n_hours"))


def check_sites(candidates: DataFrame, coverage: DataFrame, minimum: float = 0.85) -> DataFrame:
    """Every candidate with its overall coverage; one with no record fails with a note."""
    total = coverage.filter("year is null").select("site", "coverage")
    out = candidates.join(total, "site", "left")
    return out.select(
        *candidates.columns,
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce(F.col("coverage") >= minimum, F.lit(False)).alias("passed"),
        F.when(F.isnull("coverage"), "not found").otherwise("").alias("note"),
    )


def cached_last_night(ends: DataFrame, frozen_end: str | None = None) -> DataFrame:
    """Last night every (site, source) reaches: the earliest of the latest times, less a day, never past
    the frozen end. `ends`: (site, source, ts)."""
    latest = ends.groupBy("site", "source").agg(F.max("ts").alias("_last"))
    night = F.date_sub(F.to_date(F.min("_last")), 1)
    if frozen_end:
        night = F.least(night, F.lit(frozen_end).cast("date"))
    return latest.agg(night.alias("last_night"))


def night_aod(windows: DataFrame, aerosol: DataFrame) -> DataFrame:
    """Median aerosol load from floor(dusk) to ceil(dawn); NULL with fewer than max(2, hours // 2) values."""
    from nightfold.functions.timefn import ceil_hour, floor_hour

    wide = windows.select(*KEYS, floor_hour(as_ts("dusk")).alias("dusk"), ceil_hour(as_ts("dawn")).alias("dawn"),
                          ((F.unix_timestamp(as_ts("dawn")) - F.unix_timestamp(as_ts("dusk"))) / 3600).cast("int").alias("_h"))
    inside = attach_windows(aerosol.filter("aod is not null"), wide, ["site"], "night_date", "dusk", "dawn")
    per = inside.groupBy(*KEYS).agg(F.count("aod").alias("n"), F.percentile("aod", 0.5).alias("_m"))
    enough = F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("_h") / 2))
    return wide.join(per, KEYS, "left").select(*KEYS, F.when(enough, F.col("_m")).alias("aod"))


def median_by_hour(covers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cross-model median per key (a handful of models each, so the exact percentile buffer is tiny)."""
    return covers.groupBy(*keys).agg(F.percentile("cover", 0.5).alias("median_cover"))


# ---------- validation ----------


def validate_dataset(df: DataFrame, keys: Sequence[str] = ("site", "night_date", "lead")) -> DataFrame:
    """One row per broken invariant: (problem, n). Empty means the table may be written."""
    fractions = [c for c in df.columns if c.endswith(("_frac_clear", "_longest_clear_run_frac", "_mean_cover", "_missing_frac"))]
    dark = F.col("dark_hours")
    checks = {f"{c} outside [0, 1]": ~F.col(c).between(0, 1) for c in fractions}
    checks["dark_hours outside 4-13"] = (dark > 0) & ~dark.between(4, 13)
    row = df.agg(*[F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(f"c{i}") for i, cond in enumerate(checks.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("problem"), F.col(f"c{i}").alias("n")) for i, name in enumerate(checks)])
    row_level = row.select(F.inline(pairs))
    dup = df.groupBy(*keys).agg((F.count("*") - 1).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n"))
    out = row_level.unionByName(dup.select(F.lit("duplicate keys").alias("problem"), "n"))
    types = dict(df.dtypes)
    static = [(f"{c} is a naive timestamp", 1) for c, t in types.items() if t == "timestamp_ntz"]
    static += [(f"{c} should be boolean", 1) for c in LABELS.values() if types.get(c, "boolean") != "boolean"]
    if static:
        out = out.unionByName(df.sparkSession.createDataFrame(static, "problem string, n long"))
    return out.filter("n > 0")
