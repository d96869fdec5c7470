"""Irregular reports to hourly values, values to gap-aware runs, samples to crossings and extrema.

Grouping keys always include the period (a night), so no window here sorts an entity's whole history:
a hot station only means more small groups. Where a run can be read off a fixed number of hour slots it
is held in the bits of one long, which turns "longest run" into an order-free aggregate with map-side
combine: no sort, no collected list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nightfold.functions.timefn import ceil_hour, centred_hour, dark_hours, floor_hour, hours_inside
from nightfold.util import as_ts

CLEAR_TOLERANCE = 1e-9

# Sky-cover code -> cloud fraction, two modes.
SKY_COVER = {
    "default": {"CLR": 0.0, "SKC": 0.0, "NCD": 0.0, "NSC": 0.0, "FEW": 0.1875,
                "SCT": 0.4375, "BKN": 0.75, "OVC": 1.0, "VV": 1.0},
    "conservative": {"CLR": 0.0, "SKC": 0.0, "NCD": 0.0, "NSC": 0.0, "FEW": 0.25,
                     "SCT": 0.4375, "BKN": 0.75, "OVC": 1.0, "VV": 1.0},
}


@dataclass(frozen=True)
class RunRules:
    """When an hour is clear, how long a run makes a period usable, how much may be missing."""

    clear_threshold: float = 0.20
    min_run: int = 3
    max_missing: float = 0.25


# ---------- reports ----------


def sky_code_to_fraction(code: Column, mode: str = "default") -> Column:
    """Cloud fraction of one layer code (trimmed, any case); unknown codes are NULL."""
    table = F.create_map(*[F.lit(v) for kv in SKY_COVER[mode].items() for v in kv])
    return F.try_element_at(table, F.upper(F.trim(code)))


def observation_cover(layers: Sequence[str], mode: str = "default") -> Column:
    """Cloud fraction of a report: its cloudiest parseable layer, NULL if it has none."""
    return F.greatest(*[sky_code_to_fraction(F.col(c), mode) for c in layers])


def is_clear(cover: Column, threshold: float | Column) -> Column:
    """True when cover <= threshold (with a hair of tolerance); a missing hour is never clear."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce(cover <= t + F.lit(CLEAR_TOLERANCE), F.lit(False))


def hourly_cover(
    reports: DataFrame, keys: Sequence[str], ts: str, cover: str, method: str = "nearest", out: str = "cover"
) -> DataFrame:
    """One row per (keys, hour) that has any report.

    nearest: the parseable report closest to the hour, the cloudier of equals; max: the cloudiest.
    Hours whose reports hold nothing parseable stay, with NULL.
    """
    r = reports.withColumn("hour", centred_hour(as_ts(ts)))
    if method == "max":
        return r.groupBy(*keys, "hour").agg(F.max(cover).alias(out))
    if method != "nearest":
        raise ValueError(f"unknown method {method!r}")
    # First the cloudiest of equally near reports, then the nearest: two hash aggregates, no sort of raw rows.
    away = F.when(F.col(cover).isNotNull(), F.abs(F.unix_micros(as_ts(ts)) - F.unix_micros("hour")))
    by_distance = r.withColumn("_d", away).groupBy(*keys, "hour", "_d").agg(F.max(cover).alias("_c"))
    return by_distance.groupBy(*keys, "hour").agg(F.min_by("_c", "_d").alias(out))


# ---------- windows and their hours ----------


def backbone(windows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """One row per (keys, hour) for every whole hour inside each window; `slot` counts from 0."""
    return windows.select(*keys, F.posexplode(dark_hours(as_ts(start), as_ts(end))).alias("slot", "hour"))


def lookup_at(spine: DataFrame, series: DataFrame, keys: Sequence[str], ts: str = "hour") -> DataFrame:
    """Series values at exactly the spine's hours (NULL where the series has none)."""
    return spine.join(series, [*keys, ts], "left")


def attach_windows(
    series: DataFrame, windows: DataFrame, keys: Sequence[str], period: str, start: str, end: str, ts: str = "hour"
) -> DataFrame:
    """Keep the series rows that fall on a whole hour of some window; add the period and the hour's slot.

    Joins on (keys, UTC date): each window lists the few dates it touches, so even one entity with most
    of the rows is spread over its dates, and a period's hours stay in at most two partitions.
    """
    first, last = ceil_hour(as_ts(start)), floor_hour(as_ts(end))
    w = (
        windows.filter(first <= last)
        .select(*keys, period, first.alias("_first"), last.alias("_last"))
        .withColumn("_day", F.explode(F.sequence(F.to_date("_first"), F.to_date("_last"))))
    )
    s = series.withColumn("_day", F.to_date(ts))
    slot = ((F.unix_timestamp(ts) - F.unix_timestamp("_first")) / 3600).cast("int")
    return (
        s.join(w, [*keys, "_day"])
        .filter(F.col(ts).between(F.col("_first"), F.col("_last")))
        .withColumn("slot", slot)
        .drop("_day", "_first", "_last")
    )


# ---------- runs ----------


WORD_HOURS = 62  # slots in a word: a long without its sign


def bits_of(flag: Column, slot: Column, word: int = 0, words: int = 1) -> Column:
    """Aggregate: the slots of the given word where `flag` holds, as the bits of a long. A slot beyond the last
    word is an error: it would fall on another slot's bit."""
    in_word = slot - word * WORD_HOURS
    one = F.call_function("shiftleft", F.lit(1).cast("long"), in_word)
    beyond = F.raise_error(F.lit(f"a window of more than {words * WORD_HOURS} hours needs more words")).cast("long")
    here = F.when(slot >= words * WORD_HOURS, beyond).when((in_word >= 0) & (in_word < WORD_HOURS) & flag, one)
    return F.bit_or(here.otherwise(F.lit(0).cast("long")))


def longest_bit_run(*bits: Column) -> Column:
    """Length of the longest run of set bits over words, the first word first; a run may go on from word to word."""
    text = F.bin(bits[0]) if len(bits) == 1 else F.concat(*[F.lpad(F.bin(b), WORD_HOURS, "0") for b in reversed(bits)])
    return F.array_max(F.transform(F.split(text, "0+"), F.length))


def summary_aggs(value: Column, rules: RunRules, prefix: str = "", slot: str = "slot", words: int = 1) -> list[Column]:
    """The order-free partial aggregates a period summary needs for one value column, for windows of up to
    words * WORD_HOURS hours (a longer one is an error)."""
    clear = is_clear(value, rules.clear_threshold)
    return [
        F.count(value).alias(f"{prefix}_n"),
        F.avg(value).alias(f"{prefix}_mean"),
        *[bits_of(clear, F.col(slot), k, words).alias(f"{prefix}_bits{k or ''}") for k in range(words)],
    ]


def summary_columns(n_hours: Column, rules: RunRules, prefix: str = "", out: str = "", words: int = 1) -> list[Column]:
    """Final summary columns from `summary_aggs`; NULL aggregates (no row at all) read as all missing.

    Too much missing: only missing_frac is kept. No hours at all: everything is NULL.
    """
    n = F.coalesce(F.col(f"{prefix}_n"), F.lit(0))
    bits = [F.coalesce(F.col(f"{prefix}_bits{k or ''}"), F.lit(0)) for k in range(words)]
    some = n_hours > 0
    missing = F.when(some, (n_hours - n) / n_hours)
    ok = some & (missing <= rules.max_missing)
    run = longest_bit_run(*bits)
    return [
        missing.alias(f"{out}missing_frac"),
        F.when(ok & (n > 0), sum((F.bit_count(b) for b in bits), F.lit(0)) / n).alias(f"{out}frac_clear"),
        F.when(ok, run.cast("double")).alias(f"{out}longest_clear_run"),
        F.when(ok, run / n_hours).alias(f"{out}longest_clear_run_frac"),
        F.when(ok, F.col(f"{prefix}_mean")).alias(f"{out}mean_cover"),
        F.when(ok, run >= rules.min_run).alias(f"{out}usable"),
    ]


def run_summary(
    windows: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    period: str,
    start: str,
    end: str,
    value: str,
    rules: RunRules = RunRules(),
    by: Sequence[str] = (),
    words: int = 1,
) -> DataFrame:
    """Gap-aware run summary per (keys, period, by): one row for every window with at least one hour and
    every `by` value seen in the series. Windows of up to words * WORD_HOURS hours are summed in bits, longer ones by
    `run_summary_windowed`; the result is the same.
    """
    n_hours = hours_inside(as_ts(start), as_ts(end))
    dims = series.select(*keys, *by).distinct() if by else None
    with_dims = lambda d: d if dims is None else d.join(dims, list(keys))
    spans = windows.select(*keys, period, start, end, n_hours.alias("n_hours")).filter("n_hours > 0")
    short, long = spans.filter(F.col("n_hours") <= words * WORD_HOURS), spans.filter(F.col("n_hours") > words * WORD_HOURS)
    parts = (
        attach_windows(series, short, keys, period, start, end)
        .groupBy(*keys, period, *by)
        .agg(*summary_aggs(F.col(value), rules, words=words))
    )
    full = with_dims(short.select(*keys, period, "n_hours")).join(parts, [*keys, period, *by], "left")
    out = full.select(*keys, period, *by, "n_hours", *summary_columns(F.col("n_hours"), rules, words=words))
    hours = with_dims(backbone(long.select(*keys, period, start, end), [*keys, period], start, end))
    found = lookup_at(hours, series.select(*keys, *by, "hour", value), [*keys, *by])
    return out.unionByName(run_summary_windowed(found, [*keys, period, *by], "hour", value, rules).withColumn("n_hours", F.col("n_hours").cast(out.schema["n_hours"].dataType)))


def run_summary_windowed(
    hours: DataFrame, keys: Sequence[str], order: str, value: str, rules: RunRules = RunRules()
) -> DataFrame:
    """The same summary from a spine already joined with its series, by block numbers: every hour that is
    not clear opens a new block, so the clear hours sharing a block are consecutive. `keys` must bound a
    group to one period."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    clear = is_clear(F.col(value), rules.clear_threshold)
    blocks = (
        hours.withColumn("_clear", clear.cast("int"))
        .withColumn("_block", F.sum(1 - F.col("_clear")).over(w))
        .groupBy(*keys, "_block")
        .agg(
            F.count("*").alias("_h"), F.count(value).alias("_v"), F.sum(value).alias("_s"), F.sum("_clear").alias("_c")
        )
    )
    per = blocks.groupBy(*keys).agg(
        F.sum("_h").alias("n_hours"), F.sum("_v").alias("_v"), F.sum("_s").alias("_s"),
        F.sum("_c").alias("_c"), F.max("_c").alias("_run"),
    )
    missing = (F.col("n_hours") - F.col("_v")) / F.col("n_hours")
    ok = missing <= rules.max_missing
    some = ok & (F.col("_v") > 0)
    return per.select(
        *keys, "n_hours", missing.alias("missing_frac"),
        F.when(some, F.col("_c") / F.col("_v")).alias("frac_clear"),
        F.when(ok, F.col("_run").cast("double")).alias("longest_clear_run"),
        F.when(ok, F.col("_run") / F.col("n_hours")).alias("longest_clear_run_frac"),
        F.when(some, F.col("_s") / F.col("_v")).alias("mean_cover"),
        F.when(ok, F.col("_run") >= rules.min_run).alias("usable"),
    )


def longest_clear_run(covers: Column, threshold: float) -> Column:
    """Longest clear run of an hour-ordered array<double>, for series already nested per period."""
    step = lambda acc, c: F.struct(
        F.when(is_clear(c, threshold), acc["cur"] + 1).otherwise(0).alias("cur"),
        F.greatest(acc["best"], F.when(is_clear(c, threshold), acc["cur"] + 1).otherwise(0)).alias("best"),
    )
    zero = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best"))
    return F.aggregate(covers, zero, step, lambda acc: acc["best"])


def is_usable(covers: Column, rules: RunRules) -> Column:
    """Three-valued usable rule of an hour-ordered array: NULL when empty or too sparse."""
    n = F.size(covers)
    missing = F.size(F.filter(covers, lambda c: c.isNull())) / n
    return F.when((n > 0) & (missing <= rules.max_missing), longest_clear_run(covers, rules.clear_threshold) >= rules.min_run)


# ---------- islands ----------


def islands(df: DataFrame, keys: Sequence[str], ts: str, flag: Column, gap: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Maximal runs of flagged rows no further apart than `gap`: (keys, start, end, length)."""
    w = W.partitionBy(*keys).orderBy(ts)
    on = df.filter(flag)
    prev = F.lag(ts).over(w)
    on = on.withColumn("_new", (prev.isNull() | (F.col(ts) > prev + F.expr(gap))).cast("int"))
    on = on.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return on.groupBy(*keys, "_island").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("length")
    ).drop("_island")


def longest_island(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The longest run per key, the earliest of equals."""
    pick = F.struct(F.col("length"), (-F.unix_micros("start")).alias("s"))
    return runs.groupBy(*keys).agg(
        F.max_by("start", pick).alias("start"), F.max_by("end", pick).alias("end"), F.max("length").alias("length")
    )


def best_window(hours: DataFrame, keys: Sequence[str], cover: str, threshold: float, dawn: str | None = None) -> DataFrame:
    """First longest clear run per period: start, last clear hour, its length, and `until` (an hour after
    the last clear hour, never past dawn)."""
    best = longest_island(islands(hours, keys, "hour", is_clear(F.col(cover), threshold)), keys)
    until = F.col("end") + F.expr("INTERVAL 1 HOUR")
    if dawn:
        best = best.join(hours.groupBy(*keys).agg(F.max(dawn).alias("_dawn")), list(keys))
        until = F.least(until, as_ts("_dawn"))
    return best.withColumn("until", until).drop("_dawn")


def longest_run(hours: DataFrame, keys: Sequence[str], flag: Column, dusk: str, dawn: str) -> DataFrame:
    """Longest run of flagged hours as a span: half an hour either side, clipped to the window."""
    w = hours.groupBy(*keys).agg(F.max(dusk).alias("_dusk"), F.max(dawn).alias("_dawn"))
    best = longest_island(islands(hours, keys, "hour", flag), keys).join(w, list(keys))
    half = F.expr("INTERVAL 30 MINUTES")
    return best.select(
        *keys,
        F.greatest(F.col("start") - half, as_ts("_dusk")).alias("start"),
        F.least(F.col("end") + half, as_ts("_dawn")).alias("end"),
        "length",
    )


def true_runs(samples: DataFrame, keys: Sequence[str], ts: str, flag: Column) -> DataFrame:
    """(start, end) of each stretch where `flag` holds; the end is the first sample where it stops
    holding, or the last sample when it never stops."""
    w = W.partitionBy(*keys).orderBy(ts)
    s = samples.withColumn("_f", F.coalesce(flag, F.lit(False)))
    s = s.withColumn("_prev", F.lag("_f", 1, False).over(w)).withColumn("_next", F.lead(ts).over(w))
    s = s.withColumn("_run", F.sum((F.col("_f") & ~F.col("_prev")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return (
        s.filter("_f")
        .groupBy(*keys, "_run")
        .agg(F.min(ts).alias("start"), F.max(F.coalesce("_next", ts)).alias("end"))
        .drop("_run")
    )


def crossings(samples: DataFrame, keys: Sequence[str], ts: str, value: str, level: float | Column) -> DataFrame:
    """Where the sampled value crosses `level`, linearly interpolated: (keys, at, falling)."""
    w = W.partitionBy(*keys).orderBy(ts)
    level = level if isinstance(level, Column) else F.lit(level)
    s = samples.select(*keys, F.col(ts).alias("_t"), (F.col(value) - level).alias("_a"))
    s = s.withColumn("_t1", F.lead("_t").over(w.orderBy("_t"))).withColumn("_a1", F.lead("_a").over(w.orderBy("_t")))
    s = s.filter(F.col("_a1").isNotNull() & ((F.col("_a") > 0) != (F.col("_a1") > 0)))
    micros = F.unix_micros("_t") + F.round(
        (F.unix_micros("_t1") - F.unix_micros("_t")) * (F.col("_a") / (F.col("_a") - F.col("_a1")))
    ).cast("long")
    return s.select(*keys, F.timestamp_micros(micros).alias("at"), (F.col("_a") > 0).alias("falling"))


def dark_windows(cross: DataFrame, keys: Sequence[str], tz: str = "UTC") -> DataFrame:
    """Pairs each falling crossing (dusk) with the next rising one (dawn), keyed by dusk's local date."""
    w = W.partitionBy(*keys).orderBy("at")
    nxt = cross.withColumn("dawn", F.lead("at").over(w)).withColumn("_f", F.lead("falling").over(w))
    return nxt.filter(F.col("falling") & (F.col("_f") == F.lit(False))).select(
        *keys, F.to_date(F.from_utc_timestamp("at", tz)).alias("night_date"), F.col("at").alias("dusk"), "dawn"
    )


def local_minima(samples: DataFrame, keys: Sequence[str], ts: str, value: str, cap: float) -> DataFrame:
    """Samples no higher than the one before, lower than the one after, and at most `cap`."""
    w = W.partitionBy(*keys).orderBy(ts)
    v = F.col(value)
    s = samples.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.lead(value).over(w))
    return s.filter((v <= F.col("_p")) & (v < F.col("_n")) & (v <= cap)).drop("_p", "_n")


def story_runs(hours: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Runs of equal hour kind per period, one-hour blips dropped (unless it is the only run): first and
    last kind, the number of runs, and when the second run starts."""
    w = W.partitionBy(*keys).orderBy("hour")
    h = hours.withColumn("_new", F.coalesce(F.lag(kind).over(w) != F.col(kind), F.lit(True)).cast("int"))
    h = h.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = h.groupBy(*keys, "_run").agg(
        F.first(kind).alias("kind"), F.min("hour").alias("start"), F.max("hour").alias("end")
    )
    n_all = F.count("*").over(W.partitionBy(*keys))
    runs = runs.withColumn("_n", n_all).filter((F.col("end") > F.col("start")) | (F.col("_n") == 1))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("start"))
    runs = runs.withColumn("_r", rank)
    return runs.groupBy(*keys).agg(
        F.min_by("kind", "start").alias("first_kind"),
        F.max_by("kind", "start").alias("last_kind"),
        F.count("*").alias("n_runs"),
        F.min(F.when(F.col("_r") == 2, F.col("start") - F.expr("INTERVAL 30 MINUTES"))).alias("change"),
    )
