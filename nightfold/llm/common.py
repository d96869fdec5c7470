"""Shared plumbing of the training-data operators: tables in the shared folder, gapless ranks and Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from nightfold.util import ensure_checkpoint_dir

#: A word, as the contracts spell it: anything between spaces, tabs and line ends.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """`df` written as Parquet under spark.checkpoint.dir and read back: cuts lineage, survives lost executors.

    Each call has a folder of its own; they live as long as the checkpoint folder does.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/nightfold-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], spread: Column, out: str, buckets: Column | int) -> DataFrame:
    """Adds `out`: 0, 1, 2, ... per key (keys without nulls), deterministic, without any task holding a whole key.

    Rows of a key are dealt into `buckets` by `spread` (a deterministic hash of the row); each bucket is
    numbered by `order` and shifted by the size of the buckets before it.
    """
    keys = list(keys)
    n = buckets if isinstance(buckets, Column) else F.lit(buckets)
    dealt = df.withColumn("_b", F.pmod(spread, n).cast("int"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    return ranked.join(sizes, [*keys, "_b"]).withColumn(out, (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_r", "_before")
