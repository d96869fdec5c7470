"""The hourly model: the probability that one dark hour is clear, per lead, from every member's cover in that hour.
Training rows, one fitting job for all leads, evaluation against the share of models and climatology, and serving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightfold.functions.timefn import assign_split, night_position, season
from nightfold.operators import models as M, verify as V
from nightfold.operators.nights import mean_present, spread
from nightfold.operators.timeseries import backbone, is_clear
from nightfold.util import as_ts

LABEL = "hourly_clear"


def _own(m: str, leads: Sequence[int]) -> Column:
    return F.when(F.col("lead").isin(list(leads)), F.col(f"{m}_cover"))


def feature_columns(models: Sequence[str]) -> list[str]:
    return [*[f"{m}_cover" for m in models], "mean_cover", "spread_cover", "night_position"]


def hour_rows(windows: DataFrame, forecasts: DataFrame, models: dict[str, Sequence[int]], leads: Sequence[int], threshold: float = 0.2) -> DataFrame:
    """One row per dark hour and lead: each member's cover, mean, spread, share saying clear, place in the night, month.
    `forecasts`: (site, model, lead, hour, cover). A member has no value beyond its leads."""
    wide = forecasts.filter(F.col("model").isin(list(models))).groupBy("site", "lead", "hour").agg(*[F.max(F.when(F.col("model") == m, F.col("cover"))).alias(f"{m}_cover") for m in models])
    spine = backbone(windows, ["site", "night_date", "dusk", "dawn"], "dusk", "dawn").withColumn("lead", F.explode(F.array(*[F.lit(x) for x in leads])))
    rows = spine.join(wide, ["site", "lead", "hour"], "left").withColumns({f"{m}_cover": _own(m, ls) for m, ls in models.items()})
    covers = [F.col(f"{m}_cover") for m in models]
    n, sd = spread(covers)
    clear = sum((F.coalesce(is_clear(c, threshold).cast("int"), F.lit(0)) for c in covers), F.lit(0))
    return rows.withColumns({
        "mean_cover": mean_present(covers), "spread_cover": sd, "share_clear": F.when(n > 0, clear / n), "month": F.month("night_date"),
        "night_position": night_position(F.col("hour"), as_ts("dusk"), as_ts("dawn")),
    })


def with_truth(rows: DataFrame, truth: DataFrame, train: tuple[str, str], test: tuple[str, str], threshold: float = 0.2) -> DataFrame:
    """Adds clear (NULL where `truth`, (site, hour, cover), has no value) and split."""
    t = truth.select("site", "hour", is_clear(F.col("cover"), threshold).cast("int").alias("clear"))
    return rows.join(t, ["site", "hour"], "left").withColumn("split", assign_split(F.col("night_date"), train, test))


def fit(spark: SparkSession, rows: DataFrame, features: Sequence[str], folds: int = 4) -> DataFrame:
    """The models of all leads, one row each."""
    train = rows.filter("split = 'train' and clear is not null and mean_cover is not null")
    return M.artifact_frame(spark, M.fit_logistic_grid(train, ["lead"], features, "clear", "night_date", folds=folds), ["lead"], ["int"])


def evaluation(rows: DataFrame, table: DataFrame, features: Sequence[str], models: dict[str, Sequence[int]]) -> DataFrame:
    """Predictions of the hourly model, the share of models and climatology on the test hours that all members have."""
    train = rows.filter("split = 'train' and clear is not null")
    rate = train.groupBy("lead", "site", "month").agg(F.avg("clear").alias("_rate"))
    every = train.groupBy("lead").agg(F.avg("clear").alias("_all"))
    now = rows.filter("split = 'test' and clear is not null")
    for m, leads in models.items():
        now = now.filter(~F.col("lead").isin(list(leads)) | F.col(f"{m}_cover").isNotNull())
    now = M.predict(now, table, features, ["lead"]).filter("p is not null").join(rate, ["lead", "site", "month"], "left").join(every, "lead")
    now = now.withColumns({"label": F.lit(LABEL), "season": season(F.col("month")), "y": F.col("clear")})
    methods = {
        "climatology": ("prob", "climatology", F.coalesce("_rate", "_all")), "hourly_model": ("prob", "hourly", F.col("p")), "share_of_models": ("prob", "share", F.col("share_clear")),
    }
    return V.to_predictions(now, methods, ["label", "lead", "site", "night_date", "season", "y"])


def served(nights: DataFrame, rows: DataFrame, table: DataFrame, features: Sequence[str]) -> DataFrame:
    """(site, night_date, lead, hour, p_clear) for the dark hours of `nights` (site, night_date, lead): each night takes the
    forecasts and the model of its own lead. A stateless join, for a batch or a stream of nights alike."""
    hours = rows.join(nights.select("site", "night_date", "lead"), ["site", "night_date", "lead"])
    return M.predict(hours, table, features, ["lead"], "p_clear").select("site", "night_date", "lead", "hour", "p_clear")
