"""A keyed log that grows for years: rows are filed by day, a day's many small batches are folded into one, and a batch looks
only at the days it touches.

Layout: `{day}=…/first=…/last=…`. A micro-batch n writes first = last = n into each of its days, overwriting only those
folders, so that a replay replaces its own output. Folding writes one folder that spans the batches it holds; a folder that
another one of its day spans is dead, whether or not it has been removed yet, so a crash between writing and removing
changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from nightfold.operators.merge import first_wins, later_wins

SPAN = ["first", "last"]


@dataclass(frozen=True)
class DayLog:
    """`keys` (which include `day`) name an entry. `later`: of several rows of a key the highest by `order` counts (late
    arrivals may replace), otherwise the row that came first, and inside a batch the lowest by `order`."""

    path: str
    schema: StructType
    day: str
    keys: Sequence[str]
    order: Sequence[str]
    later: bool = False

    def _all(self, spark: SparkSession) -> DataFrame:
        full = StructType(list(self.schema.fields)).add("first", "long").add("last", "long")
        try:
            return spark.read.schema(full).option("basePath", self.path).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], full)

    def rows(self, spark: SparkSession, lo=None, hi=None, before: int | None = None) -> DataFrame:
        """The live rows (with their span) of days lo to hi, of batches below `before`. Days are folders: others are not opened."""
        df = self._all(spark)
        if lo is not None:
            df = df.filter(F.col(self.day).between(F.lit(lo), F.lit(hi)))
        if before is not None:
            df = df.filter(F.col("last") < before)
        spans = df.select(self.day, *SPAN).distinct()  # one row a folder
        a, b = spans.alias("a"), spans.alias("b")
        wider = (F.col("b.first") <= F.col("a.first")) & (F.col("b.last") >= F.col("a.last")) & ((F.col("b.first") != F.col("a.first")) | (F.col("b.last") != F.col("a.last")))
        dead = a.join(b, (F.col(f"a.{self.day}") == F.col(f"b.{self.day}")) & wider, "left_semi")
        return df.join(dead, [self.day, *SPAN], "left_anti")

    def current(self, spark: SparkSession, lo=None, hi=None) -> DataFrame:
        """The row of every key that counts, of days lo to hi."""
        live = self.rows(spark, lo, hi).drop(*SPAN)
        return later_wins(live, self.keys, self.order) if self.later else live

    def _file(self, rows: DataFrame, first: Column, last: Column) -> None:
        filed = rows.withColumn("first", first.cast("long")).withColumn("last", last.cast("long"))
        filed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.day, *SPAN).parquet(self.path)

    def append(self, batch: DataFrame, ident: int) -> None:
        """Files one micro-batch. First wins: keys that earlier batches hold are dropped, which opens the batch's own days only."""
        new = later_wins(batch, self.keys, self.order) if self.later else first_wins(batch, self.keys, self.order)
        if not self.later:
            span = batch.agg(F.min(self.day).alias("lo"), F.max(self.day).alias("hi")).first()
            if span["lo"] is not None:
                done = self.rows(batch.sparkSession, span["lo"], span["hi"], before=ident)
                new = new.join(done.select(*self.keys), list(self.keys), "left_anti")
        self._file(new.select(*[f.name for f in self.schema.fields]), F.lit(ident), F.lit(ident))

    def stream(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Files everything that is available now; the checkpoint remembers what has been taken."""
        return stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def fold(self, spark: SparkSession, upto: int, lo=None, hi=None) -> int:
        """Makes one folder of the batches up to `upto` of each day that has several, and removes those; returns how many
        folders went. Rows that no longer count go with them."""
        live = self.rows(spark, lo, hi).filter(F.col("last") <= upto)
        many = live.select(self.day, *SPAN).distinct().groupBy(self.day).agg(F.count("*").alias("n"), F.min("first").alias("_from"), F.max("last").alias("_upto")).filter("n > 1")
        rows = live.drop(*SPAN).join(many.drop("n"), self.day)
        kept = rows.select(*[f.name for f in self.schema.fields], "_from", "_upto")
        if self.later:
            kept = later_wins(kept, self.keys, self.order).select(*kept.columns)
        filed = kept.repartition(F.col(self.day)).withColumnsRenamed({"_from": "first", "_upto": "last"})
        filed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.day, *SPAN).parquet(self.path)
        return self._remove_dead(spark, lo, hi)

    def _remove_dead(self, spark: SparkSession, lo=None, hi=None) -> int:
        df = self._all(spark)
        if lo is not None:
            df = df.filter(F.col(self.day).between(F.lit(lo), F.lit(hi)))
        held = {tuple(r) for r in df.select(F.col(self.day).cast("string"), *SPAN).distinct().collect()}  # folders, not rows
        dead = [(d, a, b) for d, a, b in held if any(x == d and p <= a and q >= b and (p, q) != (a, b) for x, p, q in held)]
        jvm = spark._jvm
        for d, a, b in dead:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.day}={d}/first={a}/last={b}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return len(dead)
