"""Structured Streaming jobs. Each takes and returns streaming DataFrames, or starts a query whose sink
is a folder of batch directories.

Sinks write `batch=<id>` directories in overwrite mode, so a replayed batch replaces its own output: with
a checkpoint location the result is exactly once, whichever executor or driver is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from nightfold.operators.merge import later_wins
from nightfold.operators.timeseries import is_clear
from nightfold.operators.verify import METHOD, SUMS, collapsed, week_partials
from nightfold.streaming.daylog import DayLog
from nightfold.util import as_ts


# ---------- sinks ----------


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Everything written so far (with its batch number); empty when nothing is."""
    full = StructType(list(schema.fields)).add("batch", "long")
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def start(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Writes each micro-batch (after `prepare`) to its own directory; runs over what is available now."""

    def write(batch: DataFrame, ident: int) -> None:
        out = batch if prepare is None else prepare(batch, ident)
        out.write.mode("overwrite").parquet(f"{path}/batch={ident}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, source: str, schema: StructType, path: str, checkpoint: str, per_batch: int = 1000, fmt: str = "parquet") -> StreamingQuery:
    """Resumable file ingest: files already taken are never taken again (the checkpoint remembers them)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(fmt).load(source)
    return start(stream, path, checkpoint)


# ---------- first and later wins ----------


def first_wins_within(stream: DataFrame, keys: Sequence[str], ts: str, retention: str) -> DataFrame:
    """First row of each key to arrive, remembered for `retention` of event time."""
    return stream.withWatermark(ts, retention).dropDuplicatesWithinWatermark(list(keys))


def first_wins_log(stream: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str, date_key: str) -> StreamingQuery:
    """First row of each key for ever, filed by `date_key` (`DayLog`): a batch opens the days that it touches and no others."""
    return DayLog(path, stream.schema, date_key, tuple(keys), tuple(order)).stream(stream, checkpoint)


def resolve_later(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current value of every key in a folder of batches: the later end wins, then the later name; late arrivals
    need no rewrite, because precedence is decided when reading. For a log that grows use a `DayLog` with `later`."""
    return later_wins(read_batches(spark, path, schema).drop("batch"), keys, order)


def settled(chunk_end: Column, last_day_values: Column, today: Column, settle_days: int = 30) -> Column:
    """A chunk counts once its last day has any value, or when it is old enough for gaps to be final."""
    return (last_day_values > 0) | (F.datediff(today, chunk_end) > settle_days)


# ---------- event-time operators ----------


def hourly_nearest(reports: DataFrame, keys: Sequence[str], ts: str, cover: str, delay: str = "2 hours") -> DataFrame:
    """Nearest parseable report per centred hour, emitted once the hour can no longer change."""
    almost = F.expr("INTERVAL '00:29:59.999999' HOUR TO SECOND")
    r = reports.withColumn("_shifted", as_ts(ts) + almost).withWatermark("_shifted", delay)
    hour = F.date_trunc("hour", F.col("_shifted"))
    away = F.abs(F.unix_micros(as_ts(ts)) - F.unix_micros(hour))
    best = F.min(F.when(F.col(cover).isNotNull(), F.struct(away.alias("d"), (-F.col(cover)).alias("c"))))
    out = r.groupBy(F.window("_shifted", "1 hour").alias("_w"), *keys).agg(best.alias("_b"))
    return out.select(*keys, F.col("_w.start").alias("hour"), (-F.col("_b.c")).alias("cover"))


def clear_runs(hours: DataFrame, keys: Sequence[str], ts: str, cover: str, threshold: float = 0.2, delay: str = "2 hours") -> DataFrame:
    """Runs of consecutive clear hours as sessions: an hour that is missing or not clear ends the run."""
    clear = hours.withWatermark(ts, delay).filter(is_clear(F.col(cover), threshold))
    s = clear.groupBy(*keys, F.session_window(ts, "1 hour").alias("_s")).agg(F.count("*").alias("length"))
    return s.select(*keys, F.col("_s.start").alias("start"), (F.col("_s.end") - F.expr("INTERVAL 1 HOUR")).alias("end"), "length")


def delayed_verification(forecasts: DataFrame, labels: DataFrame, wait: str = "9 days", limit: str = "30 days") -> DataFrame:
    """Each logged forecast with its night's label when it arrives within `limit`, otherwise with NULL.
    forecasts: site, night (timestamp), p, …; labels: site, night, y."""
    f = forecasts.withWatermark("night", wait).alias("f")
    lab = labels.select(F.col("site").alias("_site"), F.col("night").alias("_night"), "y").withWatermark("_night", limit).alias("l")
    on = (F.col("site") == F.col("_site")) & (F.col("night") == F.col("_night")) & (F.col("_night") >= F.col("night")) & (F.col("_night") <= F.col("night") + F.expr(f"INTERVAL {limit}"))
    return f.join(lab, on, "leftOuter").drop("_site", "_night")


# ---------- running scores ----------


def score_batches(stream: DataFrame, path: str, checkpoint: str, threshold: float = 0.5) -> StreamingQuery:
    """Adds each batch's weekly sums per method to a folder; `running_scores` turns them into metrics."""

    def prepare(batch: DataFrame, ident: int) -> DataFrame:
        return week_partials(collapsed(batch, ()), threshold, ())

    return start(stream, path, checkpoint, prepare)


def running_scores(spark: SparkSession, path: str, min_weeks: int = 8) -> DataFrame:
    """Per method and lead: rows, weeks, Brier and skill so far, and whether there are enough weeks for an
    interval."""
    from nightfold.operators.verify import metric_columns, with_reference

    sums = spark.read.parquet(path).groupBy(*METHOD, "week").agg(*[F.sum(c).alias(c) for c in SUMS])
    weekly = with_reference(sums, ["label", "lead", "week"])
    total = weekly.groupBy(*METHOD).agg(*[F.sum(c).alias(c) for c in (*SUMS, "ref_sq")], F.count_distinct("week").alias("n_weeks"))
    m = metric_columns()
    return total.select(*METHOD, "n", "n_weeks", m["brier"].alias("brier"), m["bss"].alias("bss"), (F.col("n_weeks") >= min_weeks).alias("enough_weeks"))
