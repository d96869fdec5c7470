"""Does the verdict hold under other definitions of a usable night? Labels, features, fits and scores for a grid of
(clear threshold, shortest run), with the definition as a grouping key: one pass over the hours keeps a bit set per
threshold, one fitting job has the models of all definitions and leads, one scoring job their records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightfold.functions.timefn import season
from nightfold.operators import models as M, verify as V
from nightfold.operators.nights import MODEL_INPUTS, mean_present
from nightfold.operators.timeseries import bits_of, is_clear, longest_bit_run

KEYS = ["label", "lead"]


def definition_name(threshold: float, run: int) -> str:
    return f"{threshold:g}/{run}"


def definition_summaries(hours: DataFrame, keys: Sequence[str], value: str, n_hours: str, thresholds: Sequence[float], runs: Sequence[int], max_missing: float) -> DataFrame:
    """(keys, label, clear_threshold, min_run, usable, frac_clear, longest_clear_run_frac, mean_cover) of every period under
    every definition; NULL where too many hours are missing. `hours`: attached hours with `slot`."""
    aggs = [bits_of(is_clear(F.col(value), t), F.col("slot")).alias(f"b{i}") for i, t in enumerate(thresholds)]
    per = hours.groupBy(*keys).agg(F.count(value).alias("_v"), F.avg(value).alias("_mean"), F.max(n_hours).alias("_n"), *aggs)
    ok = ((F.col("_n") - F.col("_v")) / F.col("_n") <= max_missing) & (F.col("_v") > 0)
    per = per.withColumns({f"r{i}": longest_bit_run(F.col(f"b{i}")) for i in range(len(thresholds))})
    cells = [
        F.struct(
            F.lit(definition_name(t, r)).alias("label"), F.lit(t).alias("clear_threshold"), F.lit(r).alias("min_run"), F.when(ok, F.col(f"r{i}") >= r).alias("usable"),
            F.when(ok, F.bit_count(f"b{i}") / F.col("_v")).alias("frac_clear"), F.when(ok, F.col(f"r{i}") / F.col("_n")).alias("longest_clear_run_frac"), F.when(ok, F.col("_mean")).alias("mean_cover"),
        )
        for i, t in enumerate(thresholds) for r in runs
    ]
    return per.select(*keys, F.inline(F.array(*cells)))


def definition_rows(truth: DataFrame, forecasts: DataFrame, models: dict[str, Sequence[int]], leads: Sequence[int]) -> DataFrame:
    """(label, clear_threshold, min_run, lead, site, night_date, month, y, {m}_{input}): `truth` are summaries by (site, night_date),
    `forecasts` by (site, night_date, lead, model). Every night has every lead; a model has no value beyond its leads."""
    own = lambda m, f: F.max(F.when((F.col("model") == m) & F.col("lead").isin(list(models[m])), F.col(f))).alias(f"{m}_{f}")
    wide = forecasts.groupBy("site", "night_date", "label", "lead").agg(*[own(m, f) for m in models for f in MODEL_INPUTS])
    y = truth.select("site", "night_date", "label", "clear_threshold", "min_run", F.month("night_date").alias("month"), F.col("usable").cast("int").alias("y"))
    y = y.withColumn("lead", F.explode(F.array(*[F.lit(x) for x in leads])))
    return y.join(wide, ["site", "night_date", "label", "lead"], "left")


def _available(models: dict[str, Sequence[int]]) -> Column:
    return sum((F.col(f"{m}_frac_clear").isNotNull().cast("int") for m in models), F.lit(0)) > 0


def predictions(spark: SparkSession, rows: DataFrame, models: dict[str, Sequence[int]], features: Sequence[str], train_end: str, test: tuple[str, str], folds: int = 4) -> DataFrame:
    """Climatology, equal weight and blend (on `features`) of every definition and lead, on the test rows that all have:
    label, lead, site, night_date, season, y, method, kind, family, p."""
    train = rows.filter((F.col("night_date") <= F.lit(train_end).cast("date")) & F.col("y").isNotNull())
    arts = M.fit_logistic_grid(train.filter(_available(models)), KEYS, features, "y", "night_date", folds=folds)
    table = M.artifact_frame(spark, arts, KEYS, ["string", "int"])
    rates = train.groupBy("label", "site", "night_date", "month").agg(F.max("y").alias("y")).groupBy("label", "site", "month").agg(F.avg("y").alias("p_climatology"))
    now = rows.filter(F.col("night_date").between(F.lit(test[0]).cast("date"), F.lit(test[1]).cast("date")) & F.col("y").isNotNull())
    for m, leads in models.items():
        now = now.filter(~F.col("lead").isin(list(leads)) | F.col(f"{m}_frac_clear").isNotNull())
    now = M.predict(now.join(rates, ["label", "site", "month"]), table, features, KEYS).filter("p is not null")
    now = now.withColumn("season", season(F.col("month")))
    methods = {
        "climatology": ("prob", "climatology", F.col("p_climatology")), "blend": ("prob", "blend", F.col("p")),
        "equal_weight": ("prob", "equal_weight", mean_present([F.when(F.col("lead").isin(list(ls)), F.col(f"{m}_frac_clear")) for m, ls in models.items()])),
    }
    return V.to_predictions(now, methods, ["label", "lead", "site", "night_date", "season", "y"])


def cells(preds: DataFrame, resamples: int, seed: int) -> DataFrame:
    """One row per definition and lead: n, base rate, the blend's brier, skill and false clear rate, and its paired
    difference from equal weight with interval."""
    spark = preds.sparkSession
    s = V.score(preds, 0, seed, by=()).filter("method = 'blend'").select("label", "lead", "n", "base_rate", "brier", "bss", "false_clear_rate")
    d = V.paired(preds, spark.createDataFrame([("blend", "equal_weight")], "a string, b string"), resamples, seed)
    return s.join(d.select("label", "lead", "brier_diff", "lo", "hi", "significant"), ["label", "lead"])
