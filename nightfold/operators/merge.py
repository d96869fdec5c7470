"""Keyed merges: which of several rows for a key counts, and what is still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the lowest by `order`. An aggregate, so a hot key shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


def later_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the highest by `order` (for chunks: end of range, then file stem)."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


def not_done_everywhere(wanted: DataFrame, done: DataFrame, item: str, entity: str) -> DataFrame:
    """Items not yet present for every entity that has any."""
    entities = done.select(F.count_distinct(entity).alias("_all"))
    complete = done.groupBy(item).agg(F.count_distinct(entity).alias("_n")).join(entities, F.col("_n") == F.col("_all"))
    return wanted.join(complete.select(item), item, "left_anti")


def union_loose(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column missing from a frame is NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
