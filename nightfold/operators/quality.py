"""Data-quality and result tables: plain aggregates over the modelling table and the metric records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nightfold.functions.geofn import haversine_km
from nightfold.util import count_if, exact_quantiles, ratio

SEASON_ORDER = ("DJF", "MAM", "JJA", "SON")


def one_row_per_night(df: DataFrame) -> DataFrame:
    """Rows of the lowest lead: night-level columns repeat across leads."""
    lowest = df.agg(F.min("lead").alias("lead"))
    return df.join(F.broadcast(lowest), "lead", "left_semi")


def rate(c: str | Column) -> Column:
    """Share of known values that are true."""
    return F.avg((F.col(c) if isinstance(c, str) else c).cast("double"))


def overview(nights: DataFrame) -> DataFrame:
    """Nights, range, nights without darkness, dark hours min/median/max, labelled nights per split.
    Dark hours take at most a few dozen values, so the exact median's buffer is tiny."""
    dark = F.when(F.col("dark_hours") > 0, F.col("dark_hours"))
    known = F.col("usable_primary").isNotNull()
    return nights.groupBy("site").agg(
        F.count("*").alias("nights"), F.min("night_date").alias("first"), F.max("night_date").alias("last"),
        count_if(F.col("dark_hours") == 0).alias("no_darkness"),
        F.min(dark).alias("dark_min"), F.percentile(dark, 0.5).alias("dark_median"), F.max(dark).alias("dark_max"),
        count_if(known & (F.col("split") == "train")).alias("labelled_train"),
        count_if(known & (F.col("split") == "test")).alias("labelled_test"),
    )


def observation_coverage(nights: DataFrame) -> DataFrame:
    """Mean missing share and exclusions per source, and the share of hours that rest on one source."""
    return nights.filter("dark_hours > 0").groupBy("site").agg(
        F.avg("asos_missing_frac").alias("asos_missing"), F.count("exclusion_asos").alias("asos_excluded"),
        F.avg("era5_missing_frac").alias("era5_missing"), F.count("exclusion_era5").alias("era5_excluded"),
        (F.sum("n_single_source_hours") / F.sum("dark_hours")).alias("single_source_share"),
    )


def forecast_coverage(df: DataFrame, models: dict[str, Sequence[int]]) -> DataFrame:
    """Share of site-nights with features per (model, lead), from the first night that lead has any; with
    that first night. Two small aggregates instead of a window over every row: the first available
    night per (model, lead), then a conditional average."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{m}_frac_clear").alias("v")) for m in models])
    long = df.select("night_date", "lead", F.inline(pairs))
    has = [F.lit(m) for m in models]
    table = F.create_map(*[x for m, h in zip(models, has, strict=True) for x in (h, F.array(*[F.lit(int(i)) for i in models[m]]))])
    long = long.filter(F.array_contains(F.element_at(table, F.col("model")), F.col("lead")))
    by_night = long.groupBy("model", "lead", "night_date").agg(F.count("*").alias("n"), F.count("v").alias("k"))
    first = by_night.filter("k > 0").groupBy("model", "lead").agg(F.min("night_date").alias("first_night"))
    inside = by_night.join(first, ["model", "lead"], "left").withColumn("_in", F.col("night_date") >= F.col("first_night"))
    return inside.groupBy("model", "lead", "first_night").agg(
        F.coalesce(ratio(F.sum(F.when(F.col("_in"), F.col("k"))), F.sum(F.when(F.col("_in"), F.col("n")))), F.lit(0.0)).alias("coverage")
    )


def pivot_leads(table: DataFrame, rows: Sequence[str], value: str, leads: Sequence[int]) -> DataFrame:
    """One column L{lead} per lead (fixed values, so no extra pass to discover them)."""
    out = table.groupBy(*rows).pivot("lead", list(leads)).agg(F.first(value, ignorenulls=True))
    return out.select(*rows, *[F.col(str(x)).alias(f"L{x}") for x in leads])


def exclusions(nights: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """Excluded nights per reason, in total and as a share; only sites with any exclusion."""
    r = F.col("exclusion_primary")
    out = nights.groupBy("site").agg(*[count_if(r == x).alias(x) for x in reasons], F.count(r).alias("total_excluded"), F.count("*").alias("_n"))
    return out.filter("total_excluded > 0").withColumn("share_of_nights", F.col("total_excluded") / F.col("_n")).drop("_n")


def base_rate_by_season(nights: DataFrame, label: str) -> DataFrame:
    """Rate and labelled count per (site, season), and per site over all seasons (season 'all')."""
    sets = nights.filter(F.col(label).isNotNull()).rollup("site", "season").agg(
        rate(label).alias("rate"), F.count("*").alias("n"), F.grouping_id().alias("_g")
    )
    return sets.filter("_g < 3").withColumn("season", F.when(F.col("_g") == 1, "all").otherwise(F.col("season"))).drop("_g")


def label_comparison(nights: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Rate of each label per site."""
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).alias("y")) for k, c in labels.items()])
    return nights.select("site", F.inline(pairs)).groupBy("site", "label").agg(rate("y").alias("rate"), F.count("y").alias("n"))


def agreement(nights: DataFrame) -> DataFrame:
    """How two truths disagree per site, which side the satellite takes, and what cloud the model saw."""
    a, e, g = F.col("usable_asos"), F.col("usable_era5"), F.col("usable_goes")
    both = nights.filter(a.isNotNull() & e.isNotNull())
    only_a, only_e = a & ~e, e & ~a
    share = lambda c: F.avg(c.cast("double"))
    aggs = [
        F.count("*").alias("n"), share(a == e).alias("agree"), share(only_a).alias("asos_only"), share(only_e).alias("era5_only"),
        F.avg(F.when(only_a, g.cast("double"))).alias("asos_only_goes_usable"),
        F.avg(F.when(only_e, g.cast("double"))).alias("era5_only_goes_usable"),
    ]
    aggs += [F.avg(F.when(only_a, F.col(c))).alias(f"asos_only_{c}") for c in ("era5_high_mean_cover", "era5_low_mean_cover") if c in nights.columns]
    return both.groupBy("site").agg(*aggs)


def cohen_kappa(a: Column, b: Column) -> Column:
    """Aggregate: agreement beyond chance of two booleans (rows with both known)."""
    x = F.when(a.isNotNull() & b.isNotNull(), a.cast("double"))
    y = F.when(a.isNotNull() & b.isNotNull(), b.cast("double"))
    pa, pb, po = F.avg(x), F.avg(y), F.avg((x == y).cast("double"))
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when(pe != 1, (po - pe) / (1 - pe))


def satellite_agreement(nights: DataFrame, referee: str, labels: dict[str, str]) -> DataFrame:
    """Raw agreement and kappa with each label, per site and over all sites (site 'all')."""
    g = F.col(referee)
    aggs = [F.count(g).alias("labelled")]
    for name, c in labels.items():
        aggs += [F.avg((F.col(c) == g).cast("double")).alias(f"agree_{name}"), cohen_kappa(F.col(c), g).alias(f"kappa_{name}")]
    return nights.rollup("site").agg(*aggs).withColumn("site", F.coalesce("site", F.lit("all")))


def train_test_shift(nights: DataFrame, label: str) -> DataFrame:
    y, s = F.col(label), F.col("split")
    part = lambda v: F.when(s == v, y)
    return nights.groupBy("site").agg(*[x for v in ("train", "test") for x in (rate(part(v)).alias(f"{v}_rate"), F.count(part(v)).alias(f"{v}_n"))])


def test_sufficiency(df: DataFrame, label: str, minimum: int = 300) -> DataFrame:
    ok = (F.col("lead") == 1) & (F.col("split") == "test") & F.col(label).isNotNull() & (F.col("n_models_available") > 0)
    return df.agg(count_if(ok).alias("n")).withColumn("enough", F.col("n") >= minimum)


def climatology_comparison(rates: DataFrame, years: DataFrame, nights: DataFrame, label: str) -> DataFrame:
    """Per site: years used, long-term rate (weighted by nights) and training-period rate."""
    long = rates.groupBy("site").agg((F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("long_rate"), F.sum("n").alias("labelled_nights"))
    used = years.groupBy("site").agg(F.count_distinct("year").alias("n_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    train = nights.filter("split = 'train'").groupBy("site").agg(rate(label).alias("train_rate"))
    return used.join(long, "site", "left").join(train, "site", "left")


def reference_used(long_years: DataFrame) -> DataFrame:
    """Which climatology a score was measured against and how many years each site gave it."""
    return long_years.groupBy("site").agg(F.size(F.collect_set("year")).alias("years")).withColumn("source", F.lit("long_term"))


def crosscheck_distances(df: DataFrame, keys: Sequence[str], value: str, within: Sequence[float]) -> DataFrame:
    """Matched count, median, 95th percentile, maximum and shares within given limits."""
    q = exact_quantiles(df, keys, value, {"median": 0.5, "p95": 0.95})
    shares = [F.avg((F.col(value) <= w).cast("double")).alias(f"within_{w:g}".replace(".", "_")) for w in within]
    agg = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.max(value).alias("max"), *shares)
    return agg.join(q, list(keys))


def boundary_radii(places: DataFrame) -> DataFrame:
    """Adds `radii`: how far a place's centre lies from its boundary's inner point, in radii of a circle with its land area
    (0.01 km2 at least)."""
    radius = F.sqrt(F.greatest(F.col("land_km2"), F.lit(0.01)) / F.pi())
    return places.withColumn("radii", haversine_km("lat", "lon", "lat_internal", "lon_internal") / radius)


def boundary_check(places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: median of the radii and the shares within one and two."""
    r = boundary_radii(places).filter("radii is not null")
    shares = [F.avg((F.col("radii") <= w).cast("double")).alias(f"share_within_{w}") for w in (1, 2)]
    return r.groupBy(*keys).agg(F.count("*").alias("n"), *shares).join(exact_quantiles(r, keys, "radii", {"median": 0.5}), list(keys))


def over_limit(rows: DataFrame, value: str, limit: float, names: Sequence[str], digits: int = 1) -> DataFrame:
    """The rows beyond the limit by name, with the rounded value, to be shown largest first (`value_exact` keeps the order)."""
    return rows.filter(F.col(value) > limit).select(*names, F.round(value, digits).alias(value), F.col(value).alias("value_exact"))


def elevation_check(table: DataFrame, keys: Sequence[str], own: str, other: str, within: float = 25.0) -> DataFrame:
    """Per key, of the rows with both heights: how many, median and 95th percentile of the absolute difference, share within
    the limit; and how many lack the own height."""
    d = table.withColumn("_d", F.abs(F.col(own) - F.col(other)))
    agg = d.groupBy(*keys).agg(F.count("_d").alias("n"), F.avg((F.col("_d") <= within).cast("double")).alias("share_within"), F.sum(F.isnull(own).cast("int")).alias("missing"))
    return agg.join(exact_quantiles(d, keys, "_d", {"median_abs": 0.5, "p95_abs": 0.95}), list(keys), "left")


def place_counts(places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: places of each kind, and how many centres come from a populated place."""
    of = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0))).alias
    kind = F.col("kind")
    return places.groupBy(*keys).agg(
        F.count("*").alias("n_places"), of(kind.isin("city", "town"))("n_incorporated"), of(kind == "community")("n_communities"),
        of(F.col("point") == "populated")("centre_from_populated_place"), F.count("check_km").alias("n_matched"),
    )


# ---------- result tables over metric records ----------


def headline(records: DataFrame, label: str, lead: int) -> DataFrame:
    """Overall record of every method but the hard rules."""
    return records.filter((F.col("label") == label) & (F.col("lead") == lead) & (F.col("subset_type") == "overall") & (F.col("family") != "rule")).select(
        "method", "brier", "bss", "log_loss", "auc", "false_clear_rate", "miss_rate"
    )


def hard_methods(records: DataFrame, label: str, lead: int) -> DataFrame:
    return records.filter((F.col("label") == label) & (F.col("lead") == lead) & (F.col("subset_type") == "overall") & (F.col("kind") == "hard")).select(
        "method", "false_clear_rate", "miss_rate", "accuracy"
    )


def metric_by_lead(records: DataFrame, label: str, metric: str, leads: Sequence[int], kind: str = "prob") -> DataFrame:
    r = records.filter((F.col("label") == label) & (F.col("subset_type") == "overall") & (F.col("kind") == kind))
    return pivot_leads(r, ["method"], metric, leads)


def breakdown(records: DataFrame, label: str, lead: int, subset_type: str, methods: Sequence[str]) -> DataFrame:
    """One row per subset: n, weeks, base rate, then skill and false-clear rate of each method."""
    r = records.filter((F.col("label") == label) & (F.col("lead") == lead) & (F.col("subset_type") == subset_type))
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    return r.groupBy("subset").agg(
        F.max("n").alias("n"), F.max("n_weeks").alias("weeks"), F.max("base_rate").alias("base_rate"),
        *[pick(m, c).alias(f"{c}_{m}") for m in methods for c in ("bss", "false_clear_rate")],
    )


def label_sensitivity(records: DataFrame, lead: int, labels: Sequence[str], metric: str = "bss") -> DataFrame:
    r = records.filter((F.col("lead") == lead) & (F.col("subset_type") == "overall") & (F.col("kind") == "prob"))
    return r.groupBy("method").agg(*[F.max(F.when(F.col("label") == x, F.col(metric))).alias(x) for x in labels])


def cross_truth(records: DataFrame, diffs: DataFrame, lead: int, shipped: str, rival: str) -> DataFrame:
    """The model trained on one label judged by every other: its skill, its rival's, their difference."""
    r = records.filter((F.col("lead") == lead) & (F.col("subset_type") == "overall"))
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    out = r.groupBy("label").agg(
        F.max("base_rate").alias("base_rate"), pick(shipped, "auc").alias("auc"), pick(rival, "auc").alias("auc_rival"),
        pick(shipped, "bss").alias("bss"), pick(rival, "bss").alias("bss_rival"), pick(shipped, "false_clear_rate").alias("false_clear_rate"),
    )
    d = diffs.filter((F.col("lead") == lead) & (F.col("a") == shipped) & (F.col("b") == rival)).select("label", "brier_diff", "significant")
    return out.filter("bss is not null").join(d, "label", "left")


def blend_by_lead(records: DataFrame, diffs: DataFrame, method: str, rival: str) -> DataFrame:
    """Per lead: the method's skill and false-clear rate, and its verdict against a rival."""
    r = records.filter((F.col("method") == method) & (F.col("subset_type") == "overall")).select("label", "lead", "bss", "false_clear_rate")
    d = diffs.filter((F.col("a") == method) & (F.col("b") == rival)).select("label", "lead", "brier_diff", "significant")
    return r.join(d, ["label", "lead"], "left").withColumn("verdict", verdict())


def verdict() -> Column:
    """In words: what a paired difference says."""
    return (
        F.when(F.col("brier_diff").isNull(), "not compared")
        .when(F.col("significant") & (F.col("brier_diff") < 0), "better")
        .when(F.col("significant"), "worse")
        .otherwise("not significantly different")
    )


def value_table(curves: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """One row per method, one column per chosen cost/loss ratio."""
    pick = lambda a: F.max(F.when(F.abs(F.col("alpha") - a) < 1e-9, F.col("value"))).alias("a_" + f"{a:g}".replace(".", "_"))
    return curves.groupBy("label", "lead", "method").agg(*[pick(a) for a in alphas])


def robustness(cells: DataFrame, lead: int) -> DataFrame:
    """Per definition: base rate, skill and the verdict; `cells` has one row per definition and lead."""
    return cells.filter(F.col("lead") == lead).withColumn("verdict", verdict())


def station_table(stations: DataFrame, records: DataFrame, method: str) -> DataFrame:
    """Station places with the method's per-station record (stations without one are left out)."""
    r = records.filter((F.col("subset_type") == "site") & (F.col("method") == method)).select(F.col("subset").alias("site"), "lead", "bss", "false_clear_rate", "n")
    return r.join(stations, "site")


def region_table(stations: DataFrame, records: DataFrame, method: str, other: str) -> DataFrame:
    """Regions by falling skill: station count, nights, skill of the method and of another, calls that held."""
    counts = stations.groupBy("region").agg(F.count("*").alias("stations"))
    r = records.filter(F.col("subset_type") == "region").withColumnRenamed("subset", "region")
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    per = r.groupBy("lead", "region").agg(
        F.max("n").alias("nights"), pick(method, "bss").alias("skill"), pick(other, "bss").alias("skill_other"),
        (1 - pick(method, "false_clear_rate")).alias("go_held"),
    )
    rank = F.row_number().over(W.partitionBy("lead").orderBy(F.desc_nulls_last("skill"), "region"))
    return per.join(counts, "region").withColumn("place", rank)
