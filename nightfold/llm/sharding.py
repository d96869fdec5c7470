"""Sharding by jump consistent hashing: a stable key and the number of shards decide, no ring table is kept,
and appending shards moves only the rows that the new ones take."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightfold.llm.common import gapless_rank, shuffle_partitions, stored

SHARDS = 16
#: Multiplier of the 64-bit generator of jump consistent hashing (fixed value).
STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, for all keys at once: a key jumps ahead until the next jump would leave the range."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.full(len(state), -1, dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(STEP) + np.uint64(1)
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def with_shard(docs: DataFrame, id_col: str, shards: int, out: str) -> DataFrame:
    """`docs` with its shard as int column `out`. The key is the id alone; a null id counts as id 0."""

    @F.pandas_udf("int")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(jump(ids.to_numpy(), shards).astype(np.int32))

    return docs.withColumn(out, run(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 1; null text: 1), text_crc32, law = 'key', shard, slot,
    and grown_shard (with one more shard).

    slot counts 0, 1, 2, ... inside a shard without gaps; a shard is numbered in pieces, so no task holds one.
    Repeated ids share a shard and are told apart by size and checksum (whole copies are interchangeable). A null
    text counts as empty (checksum 0). Other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = with_shard(with_shard(rows, "doc_id", shards, "shard"), "doc_id", shards + 1, "grown_shard")
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    ranked = gapless_rank(rows, ["shard"], order, F.xxhash64("doc_id", "size", "text_crc32"), "slot", 4 * shuffle_partitions(docs.sparkSession))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with `shard` and `slot` as in `shard` added; columns of those names are
    replaced. Slots are numbered on slim rows, so texts are shuffled once."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = stored(docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("_row", F.monotonically_increasing_id()), "rows")
    slim = with_shard(rows.select(F.col("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_tie")), "_id", shards, "shard")
    ranked = gapless_rank(slim, ["shard"], [F.col("_id"), F.col("_tie"), F.col("_row")], F.xxhash64("_id", "_tie", "_row"), "slot", 4 * shuffle_partitions(docs.sparkSession))
    return rows.join(ranked.select("_row", "shard", "slot").hint("merge"), "_row").drop("_row")
