"""Assembling a forecast: verdicts, trust, agreement, conditions, windows, and the table behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nightfold.functions.timefn import assign_lead, floor_hour, night_position
from nightfold.operators.nights import mean_present, spread
from nightfold.operators.timeseries import backbone, is_clear
from nightfold.util import as_ts, count_if

CLEAR_P, CLOUDY_P = 0.6, 0.35


# ---------- words ----------


def verdict_for(p: Column, go: float = 0.70, maybe: float = 0.40) -> Column:
    return F.when(p.isNull(), "No data").when(p >= go, "Go").when(p >= maybe, "Maybe").otherwise("Skip")


def trust_level(bss: Column, high: float = 0.5, medium: float = 0.3) -> Column:
    return F.when(bss.isNull(), "Unknown").when(bss >= high, "High").when(bss >= medium, "Medium").otherwise("Low")


def agreement(spread_: Column, threshold: Column) -> Column:
    return F.when(spread_.isNull() | threshold.isNull(), "Not enough models").when(spread_ > threshold, "Models split").otherwise("Models agree")


def hour_kind(p: Column) -> Column:
    return F.when(p >= CLEAR_P, "clear").when(p < CLOUDY_P, "cloudy").when(p.isNotNull(), "mixed")


def conditions(p: Column, sqm: Column, moon_free: Column, go: float = 0.70, dark_sqm: float = 20.3, min_run: int = 3) -> dict[str, Column]:
    """Clear, dark and Moon-down, each true, false or unknown, and how many are met."""
    clear, dark, moon = p >= go, sqm >= dark_sqm, moon_free >= min_run
    met = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in (clear, dark, moon)), F.lit(0))
    return {"is_clear": clear, "is_dark": dark, "moon_down": moon, "met": met}


# ---------- nights ahead ----------


def upcoming(windows: DataFrame, keys: Sequence[str], now: Column, n: int = 7) -> DataFrame:
    """The window now open (or the next) and the following ones, n in all, each with its lead."""
    ahead = windows.filter(F.col("dusk").isNotNull() & (as_ts("dawn") > now))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("night_date"))
    return ahead.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r").withColumn("lead", assign_lead(as_ts("dusk"), now, n))


def hourly_rows(windows: DataFrame, covers: DataFrame, models: Sequence[str], threshold: float = 0.2) -> DataFrame:
    """One row per dark hour: each model's cover, their mean and spread, the share saying clear, and where
    in the night the hour is. `covers`: (site, model, hour, cover). No model at all leaves NULLs."""
    wide = covers.filter(F.col("model").isin(list(models))).groupBy("site", "hour").agg(
        *[F.max(F.when(F.col("model") == m, F.col("cover"))).alias(f"{m}_cover") for m in models]
    )
    hours = backbone(windows, ["site", "night_date", "dusk", "dawn"], "dusk", "dawn").join(wide, ["site", "hour"], "left")
    cols = [F.col(f"{m}_cover") for m in models]
    n, sd = spread(cols)
    clear = sum((is_clear(c, threshold).cast("int") for c in cols), F.lit(0))
    return hours.withColumns({
        "mean_cover": mean_present(cols), "spread_cover": sd, "share_clear": F.when(n > 0, clear / n),
        "night_position": night_position(F.col("hour"), as_ts("dusk"), as_ts("dawn")), "month": F.month("night_date"),
    })


def track_record(nights: DataFrame, records: DataFrame, method: str = "blend") -> DataFrame:
    """Adds the method's overall skill at the night's lead and, where there is one, the site's own."""
    r = records.filter(F.col("method") == method)
    keep = ["bss", "false_clear_rate", "n"]
    overall = r.filter("subset_type = 'overall'").select("lead", *[F.col(c).alias(f"overall_{c}") for c in keep])
    site = r.filter("subset_type = 'site'").select("lead", F.col("subset").alias("site"), *[F.col(c).alias(f"site_{c}") for c in keep])
    return nights.join(overall, "lead", "left").join(site, ["site", "lead"], "left")


def route_variant(rows: DataFrame, evaluated: DataFrame) -> DataFrame:
    """'site' for places with a record of their own, 'geo' for all others."""
    known = evaluated.select("site").distinct().withColumn("_k", F.lit(True))
    return rows.join(known, "site", "left").withColumn("variant", F.when(F.col("_k"), "site").otherwise("geo")).drop("_k")


def assemble(nights: DataFrame, features: DataFrame, probabilities: DataFrame, records: DataFrame, best: DataFrame, spread_limits: DataFrame) -> DataFrame:
    """The forecast table: one row per site and night with probability, verdict, agreement, best window,
    and trust from the record at that lead."""
    keys = ["site", "night_date"]
    out = nights.join(features, [*keys, "lead"], "left").join(probabilities, [*keys, "lead"], "left")
    out = out.join(spread_limits, "lead", "left").join(best, keys, "left")
    out = track_record(out, records)
    return out.withColumns({
        "verdict": verdict_for(F.col("p")), "agreement": agreement(F.col("spread_frac_clear"), F.col("spread_threshold")),
        "trust": trust_level(F.col("overall_bss")),
    })


# ---------- one night, in numbers ----------


def early_evening(covers: DataFrame, nights: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Between first stars and dusk: how many models average a clear sky, of how many. `nights` adds
    first_stars; only where the gap is at least half an hour."""
    n = nights.filter(F.unix_timestamp(as_ts("dusk")) - F.unix_timestamp("first_stars") >= 1800)
    n = n.withColumn("_from", floor_hour(F.col("first_stars"))).withColumn("_day", F.explode(F.array_distinct(F.array(F.to_date("_from"), F.to_date("dusk")))))
    c = covers.withColumn("_day", F.to_date("hour"))
    inside = c.join(n.select("site", "night_date", "_from", "dusk", "_day"), ["site", "_day"]).filter((F.col("hour") >= F.col("_from")) & (F.col("hour") < as_ts("dusk")))
    per = inside.groupBy("site", "night_date", "model").agg(F.avg("cover").alias("c")).filter("c is not null")
    return per.groupBy("site", "night_date").agg(count_if(F.col("c") <= threshold).alias("n_clear"), F.count("*").alias("n_models"))


def forecast_agreement(hours: DataFrame, keys: Sequence[str], models: Sequence[str], threshold: float = 0.2) -> DataFrame:
    """Hour by hour agreement of the models, told per night: how many models there are, whether all say
    clear or cloud throughout, the first hour they split, and the first hour a united verdict flips."""
    cols = [F.col(f"{m}_cover") for m in models]
    n = F.size(F.filter(F.array(*cols), lambda c: c.isNotNull()))
    clear = sum(((F.coalesce(c <= threshold, F.lit(False))).cast("int") for c in cols), F.lit(0))
    h = hours.withColumn("_n", n).withColumn("_c", clear).filter("_n > 0")
    agree = (F.col("_c") == F.col("_n")) | (F.col("_c") == 0)
    per = h.groupBy(*keys).agg(
        F.max("_n").alias("n_models"), F.bool_and(F.col("_c") == F.col("_n")).alias("all_clear"), F.bool_and(F.col("_c") == 0).alias("all_cloudy"),
        F.bool_and(agree).alias("always_agree"), F.min(F.when(~agree, F.col("hour"))).alias("first_split"),
        F.min_by(F.col("_c") > 0, F.col("hour")).alias("starts_clear"),
        F.min(F.when(F.col("_c") > 0, F.col("hour"))).alias("_first_clear"), F.min(F.when(F.col("_c") == 0, F.col("hour"))).alias("_first_cloud"),
    )
    return per.withColumn("first_flip", F.when(F.col("starts_clear"), F.col("_first_cloud")).otherwise(F.col("_first_clear"))).drop("_first_clear", "_first_cloud")


def next_better_night(nights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A later night much clearer than the first: at least 0.6 and 0.25 above it."""
    first = F.min_by("p", "night_date")
    start = nights.groupBy(*keys).agg(F.min("night_date").alias("_first"), first.alias("_p0"))
    later = nights.join(start, list(keys)).filter((F.col("night_date") > F.col("_first")) & F.col("p").isNotNull() & F.col("_p0").isNotNull())
    best = later.groupBy(*keys, "_p0").agg(
        F.max("p").alias("p"), F.min_by("night_date", F.struct(-F.col("p"), F.col("night_date"))).alias("night_date")
    )
    return best.filter(F.col("p") >= F.greatest(F.lit(0.6), F.col("_p0") + 0.25)).drop("_p0")


def rank_places(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Places of a night by conditions met, then probability, then darkness; unknown last."""
    order = W.partitionBy(*keys).orderBy(F.col("met").desc(), F.col("p").desc_nulls_last(), F.col("sqm").desc_nulls_last(), F.col("place"))
    return df.withColumn("rank", F.row_number().over(order))


def forecast_log_rows(forecast: DataFrame, issued_at: Column, tz: str) -> DataFrame:
    """Log rows: the forecast as shown at the moment it was issued, keyed by the local issue date."""
    return forecast.withColumn("issued_at", issued_at).withColumn("issue_date", F.to_date(F.from_utc_timestamp("issued_at", tz)))


# ---------- verification of the log ----------


def verified_log(log: DataFrame, labels: DataFrame, start: str, ready_before: str) -> DataFrame:
    """Logged forecasts issued since `start` whose night is old enough, with the observed label."""
    ready = log.filter((F.col("issue_date") >= F.lit(start).cast("date")) & (F.col("night_date") <= F.lit(ready_before).cast("date")))
    return ready.join(labels, ["site", "night_date"], "left")


def score_forward(verified: DataFrame, methods: dict[str, str], label: str, threshold: float = 0.5) -> DataFrame:
    """Scores per lead and pooled (lead NULL), a method only where it has a value on every row of the group.

    One pass over the rows: each lead's sums per method; the pooled row is their roll-up.
    """
    from nightfold.functions.timefn import week_code
    from nightfold.util import ratio

    y = F.col(label).cast("double")
    rows = verified.filter(F.col(label).isNotNull())
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("p")) for m, c in methods.items()])
    long = rows.select("lead", week_code(F.col("night_date")).alias("week"), y.alias("y"), F.inline(pairs))
    go = F.col("p") >= threshold
    per = long.groupBy("lead", "method", "week").agg(
        F.count("*").alias("n"), F.sum("y").alias("sy"), count_if(F.col("p").isNull()).alias("gaps"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sq"),
        count_if(go).alias("go"), count_if(go & (F.col("y") == 1)).alias("go_usable"),
    )
    out = per.rollup("method", "lead").agg(
        *[F.sum(c).alias(c) for c in ("n", "sy", "gaps", "sq", "go", "go_usable")], F.count_distinct("week").alias("n_weeks"), F.grouping_id().alias("_g")
    ).filter("_g < 3 and gaps = 0")
    ref = out.filter("method = 'climatology'").select(F.col("lead").alias("_l"), F.col("sq").alias("ref"))
    joined = out.join(ref, out["lead"].eqNullSafe(ref["_l"]), "left")
    return joined.select(
        "method", "lead", "n", "n_weeks", (F.col("sy") / F.col("n")).alias("base_rate"), (F.col("sq") / F.col("n")).alias("brier"),
        (1 - ratio(F.col("sq"), F.col("ref"))).alias("bss"), F.col("go").alias("go_calls"), F.col("go_usable").alias("go_calls_usable"),
        ratio(F.col("go") - F.col("go_usable"), F.col("go")).alias("false_clear_rate"),
    )
