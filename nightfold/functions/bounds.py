"""Bounds that keep NULL as NULL (Spark's greatest and least skip it, which would invent a value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(c: Column, lo) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(lo)))


def at_most(c: Column, hi) -> Column:
    return F.when(c.isNotNull(), F.least(c, F.lit(hi)))


def clip(c: Column, lo, hi) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))
