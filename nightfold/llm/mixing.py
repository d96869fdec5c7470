"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a token target. Of all rates between 0 and MAX_RATE that meet it, entropy balancing takes those
nearest to one copy of everything; by duality they are exponentially tilted, rate = min(MAX_RATE, exp(l * x)) with
x the document's size over its source's token-weighted mean size, and one multiplier l per source. All multipliers
are found together by guarded Newton steps, each one aggregation. Rates depend on (source, size) alone, so the steps
run on the counts of those. Rates become whole copies by systematic rounding over falling sizes, what is then
still missing or too much is settled in documents that fit, and each (source, size) deals its copies to its
documents by a stable rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nightfold.llm.common import WORD, gapless_rank, stored

MAX_RATE = 3
WEIGHTS = (1, 2, 3)
SETTLING = 6  # rounds of settling; each leaves less than the smallest document that it could still use
RANK_ROWS = 500  # documents of one (source, size) that a task numbers
MAX_STEPS = 100


def words_in(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(src, source_size, target) from (src, source_size), one row per source: all tokens shared by weight, weights
    dealt in turn over the sources in order of `src`; a target stops at MAX_RATE times its source's size and
    the excess goes to the others by weight, until none is above.

    That end is min(cap, level * weight) with one level for all; sources are visited by cap / weight, and the
    level is that at the first source which it does not fill. One row per source is all that is sorted here.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(W.orderBy("src")) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", (F.col("source_size") * MAX_RATE).cast("double"))
    everywhere, at = W.partitionBy(), W.orderBy(F.col("cap") / F.col("w"), "src")
    filled, later = at.rowsBetween(W.unboundedPreceding, -1), at.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("w").over(later))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("src"), F.col("level").alias("level")))).over(everywhere)["level"])
    return s.select("src", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def multipliers(hist: DataFrame, goals: DataFrame) -> DataFrame:
    """(src, scale, l) for each source of hist (src, size, n) and goals (src, source_size, target); l is null where
    every rate is MAX_RATE (nothing less meets the target) and where a source has no words."""
    mean = hist.groupBy("src").agg(F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")), F.sum(F.col("n") * F.col("size"))).alias("scale"))
    state = goals.join(mean, "src").where((F.col("source_size") > 0) & (F.col("target") < MAX_RATE * F.col("source_size")))
    none = F.lit(None).cast("double")
    state = state.select("src", "scale", "target", F.log(F.col("target") / F.col("source_size")).alias("l"), none.alias("lo"), none.alias("hi"), F.lit(False).alias("done"))
    state = stored(state, "newton")
    for _ in range(MAX_STEPS):
        if state.where("not done").isEmpty():
            return state.select("src", "scale", "l")
        open_ = hist.join(state.where("not done"), "src")
        tokens, tilt = F.col("n") * F.col("size"), F.exp(F.col("l") * F.col("size") / F.col("scale"))
        sums = open_.groupBy("src").agg(
            F.sum(tokens * F.least(F.lit(float(MAX_RATE)), tilt)).alias("got"),
            F.sum(F.when(tilt < MAX_RATE, tokens * F.col("size") / F.col("scale") * tilt).otherwise(0.0)).alias("slope"),
        )
        state = state.join(sums, "src", "left").withColumn("gap", F.col("got") - F.col("target"))
        close = F.abs("gap") <= F.col("target") * 1e-9
        state = state.withColumn("lo", F.when(F.col("gap") < 0, F.col("l")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") > 0, F.col("l")).otherwise(F.col("hi")))
        newton = F.col("l") - F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.when(F.col("slope") > 0, F.col("gap") / F.col("slope")).otherwise(F.signum("gap") * 4.0)))
        inside = (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        narrow = F.col("hi") - F.col("lo") <= F.abs("l") * 1e-15
        following = F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        finished = F.col("done") | F.coalesce(close, F.lit(False)) | F.coalesce(narrow, F.lit(False))
        state = stored(state.select("src", "scale", "target", F.when(finished, F.col("l")).otherwise(following).alias("l"), "lo", "hi", finished.alias("done")), "newton")
    raise ValueError(f"token targets not met after {MAX_STEPS} steps")


def copies_by_size(hist: DataFrame, goals: DataFrame) -> DataFrame:
    """(src, size, n, source_size, target, total): whole copies `total` for the n documents of each (source, size)."""
    found = multipliers(hist, goals)
    g = hist.join(goals, "src").join(found.withColumnRenamed("src", "_src"), F.col("src") == F.col("_src"), "left")
    rate = F.when(F.col("l").isNull(), F.lit(float(MAX_RATE))).otherwise(F.least(F.lit(float(MAX_RATE)), F.exp(F.round("l", 12) * F.col("size") / F.col("scale"))))
    # Decimals: sums then do not depend on the order in which tasks deliver.
    g = g.withColumn("e", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("n") * rate).cast("decimal(28,6)"))
    falling = W.partitionBy("src").orderBy(F.desc("size"))
    upto = falling.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    g = g.withColumn("cum", F.sum("e").over(upto)).withColumn("total", whole(F.col("cum")) - whole(F.col("cum") - F.col("e"))).drop("e", "cum", "l", "scale", "_src")
    for _ in range(SETTLING):
        g = g.withColumn("r", F.round("target").cast("long") - F.sum(F.col("total") * F.col("size")).over(W.partitionBy("src")))
        g = g.withColumn("room", F.when((F.col("size") == 0) | (F.col("size") > F.abs("r")), 0).when(F.col("r") > 0, MAX_RATE * F.col("n") - F.col("total")).otherwise(F.col("total")).cast("long"))
        g = g.withColumn("before", F.coalesce(F.sum(F.col("room") * F.col("size")).over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        part = F.when(F.col("room") > 0, F.greatest(F.lit(0), F.least("room", F.floor((F.abs("r") - F.col("before")) / F.col("size"))))).otherwise(0)
        g = g.withColumn("total", (F.col("total") + F.signum("r") * part).cast("long")).drop("r", "room", "before")
    return g


def _copies(rows: DataFrame) -> DataFrame:
    """rows (src, size, id, tie, ...) with source_size, target and copies added."""
    hist = stored(rows.groupBy("src", "size").agg(F.count("*").alias("n")), "sizes")
    goals = stored(targets(hist.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))), "targets")
    plan = stored(copies_by_size(hist, goals), "copies")
    dealt = rows.join(plan, ["src", "size"])
    dealt = gapless_rank(dealt, ["src", "size"], [F.col("id"), F.col("tie")], F.xxhash64("id", "tie"), "rank", F.ceil(F.col("n") / RANK_ROWS))
    return dealt.withColumn("copies", (F.floor(F.col("total") / F.col("n")) + F.when(F.col("rank") < F.col("total") % F.col("n"), 1).otherwise(0)).cast("long")).drop("rank", "n", "total")


def _source_key(source_col: str) -> Column:
    """A key without nulls that sorts as the source does, null last."""
    s = F.col(source_col)
    return F.when(s.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), s.cast("string")))


def rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (copies * size), copies, source.

    No document has more than MAX_RATE copies. A null text has size 0 and, like every wordless text, no copies;
    nulls in source form a source of their own, which sorts last. Repeated rows are separate documents;
    documents that agree in source, size, id and text are interchangeable. Other columns are not read; an
    empty table gives an empty result.
    """
    rows = stored(docs.select(_source_key(source_col).alias("src"), words_in(text_col).alias("size"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(source_col).alias("source")), "sized")
    out = _copies(rows)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of `docs`, all columns, each as often as `rates` gives it copies. Names beginning
    with `_mix_` are taken."""
    rows = stored(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "rows")
    slim = rows.select(_source_key(source_col).alias("src"), words_in(text_col).alias("size"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col("_mix_row").alias("row"))
    taken = stored(_copies(stored(slim, "sized")).where("copies > 0").select(F.col("row").alias("_mix_row"), F.col("copies").cast("int").alias("_mix_copies")), "taken")
    out = rows.join(taken.hint("merge"), "_mix_row").withColumn("_mix_k", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
