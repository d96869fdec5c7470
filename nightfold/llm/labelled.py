"""The labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str | Column) -> Column:
    """True for the rows that no classifier learns from: crc32 of the id as text, modulo 5, is 0. A null id counts as ''."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, y, text) of at most `rows` labelled documents that are not held out: those whose ids hash lowest.

    A document with several labels counts as 1 if one of them is 1; null labels and ids are left out. The ids are
    chosen on the label table alone and are at most `rows`, which bounds what is joined.
    """
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(~held_out("doc_id")).dropna()
    chosen = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
