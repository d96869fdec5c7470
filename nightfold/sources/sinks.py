"""Sinks: validated datasets, metric and artifact JSON, climatology as nested JSON, the append-only log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightfold.operators.merge import first_wins
from nightfold.operators.nights import validate_dataset


class InvalidDataset(Exception):
    """The table breaks an invariant and was not written."""


def save_dataset(df: DataFrame, path: str) -> None:
    """Validates, then writes partitioned by site. Every problem found is named."""
    problems = validate_dataset(df).collect()  # one row per broken rule
    if problems:
        raise InvalidDataset("; ".join(f"{p['problem']} ({p['n']})" for p in problems))
    df.write.mode("overwrite").partitionBy("site").parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities in double columns become NULL (JSON has neither)."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        cols.append(F.when(~bad, c).alias(name) if kind in ("double", "float") else c)
    return df.select(*cols)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with nulls written out."""
    finite(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def climatology_to_json(table: DataFrame) -> DataFrame:
    """(label, site, month, rate, n) to one row per label: {site: {month: {rate, n}}}. Bounded by sites x 12."""
    months = F.map_from_entries(F.collect_list(F.struct(F.col("month").cast("string"), F.struct("rate", "n").alias("v"))))
    per_site = table.groupBy("label", "site").agg(months.alias("months"))
    return per_site.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("site", "months"))).alias("sites"))


CLIMATOLOGY = "label string, sites map<string, map<string, struct<rate: double, n: long>>>"


def read_climatology(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(CLIMATOLOGY).json(path)
    sites = raw.select("label", F.explode("sites").alias("site", "months"))
    rows = sites.select("label", "site", F.explode("months").alias("month", "v"))
    return rows.select("label", "site", F.col("month").cast("int").alias("month"), "v.rate", "v.n")


def append_log(existing: DataFrame | None, new: DataFrame, order: Sequence[str], keys: Sequence[str] = ("issue_date", "site", "night_date")) -> DataFrame:
    """Rows to add to a log: the first per key among the new ones, less the keys already there."""
    fresh = first_wins(new, keys, order)
    return fresh if existing is None else fresh.join(existing.select(*keys), list(keys), "left_anti")
