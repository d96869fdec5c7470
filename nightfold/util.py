"""Shared plumbing: session settings, lineage cuts and order statistics that never sort a whole group in one task."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

SALTS = 16


def session(app: str = "nightfold", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC clock, AQE with skew handling)."""
    b = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the session's own setting, or a scratch one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="nightfold-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so losing an executor never replays the whole loop."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_ts(c: str | Column) -> Column:
    """The column as TIMESTAMP, whichever of the two timestamp types the scan produced."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def clean_double(c: str | Column) -> Column:
    """DOUBLE with NaN turned into NULL (missing has exactly one spelling past ingest)."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def share_if(c: Column) -> Column:
    """Share of rows where `c` is true; a NULL condition counts as false."""
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def ratio(num: Column, den: Column) -> Column:
    """num/den, NULL when the denominator is 0 or NULL."""
    return F.when(den != 0, num.cast("double") / den)


def place_in_ranges(vals: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Adds `_bucket`: rows of a key in ascending ranges of `by`, equal values together.

    One range exchange by (keys, by), numbered by its partitions and written once, so that the numbers stay. Its bounds are
    sampled from the rows: a key with most of the rows gets most of the ranges, many small keys share one, and the size of
    ranges follows the session's partition size. Nothing is copied per key.
    """
    ranged = vals.repartitionByRange(*[F.asc(k) for k in keys], F.asc(by)).withColumn("_bucket", F.spark_partition_id())
    return cut_lineage(ranged)


def ranked_cumsum(
    df: DataFrame, keys: Sequence[str], by: str, measures: Sequence[str], distinct: bool = False
) -> DataFrame:
    """Distinct `by` values per key with each measure's total and its running total below (`{m}_below`).

    Exact, and no task ever sorts a whole key: values are first collapsed to distinct ones (map-side
    combine), split into ranges, and the running total is (totals of lower ranges) + (running total
    inside the range).
    """
    keys = list(keys)
    vals = df if distinct else df.groupBy(*keys, by).agg(*[F.sum(m).alias(m) for m in measures])
    placed = place_in_ranges(vals, keys, by)
    totals = placed.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_b_{m}") for m in measures]
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    return placed.join(totals, [*keys, "_bucket"]).select(
        *keys,
        by,
        *measures,
        *[(F.col(f"_b_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"{m}_below") for m in measures],
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles of `value` per key (numpy's default rule), whose memory never
    depends on how many distinct values a key has.

    Values are collapsed to counts and placed in ranges; the ranges' totals tell which of them hold the
    wanted ranks, and only those ranges are sorted. `weight` (a whole number) lets the caller pass values
    already collapsed.
    """
    keys = list(keys)
    dummy = not keys
    if dummy:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("_n"))
    placed = place_in_ranges(counts, keys, value)
    whole, upto = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_t"))
    totals = totals.withColumn("_below", F.coalesce(F.sum("_t").over(upto), F.lit(0))).withColumn("_total", F.sum("_t").over(whole))
    pos = {name: F.lit(q) * (F.col("_total") - 1) for name, q in quantiles.items()}
    ranks = [r for p in pos.values() for r in (F.floor(p), F.ceil(p))]
    holds = [(F.col("_below") <= r) & (r < F.col("_below") + F.col("_t")) for r in ranks]
    needed = totals.filter(reduce(lambda a, b: a | b, holds)).select(*keys, "_bucket", "_below", "_total")
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.join(needed, [*keys, "_bucket"])
    ranked = ranked.withColumn("_at", F.col("_below") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    here = lambda r: F.max(F.when((F.col("_at") <= r) & (r < F.col("_at") + F.col("_n")), F.col(value)))
    aggs = []
    for name, p in pos.items():
        low, high, frac = here(F.floor(p)), here(F.ceil(p)), F.max(p - F.floor(p))
        aggs.append((low + (high - low) * frac).alias(name))
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.drop("_all") if dummy else out
