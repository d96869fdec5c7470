"""Time as columns: centred hours, dark-hour sequences, night dates, weeks, seasons, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightfold.functions.bounds import clip

HOUR = F.expr
_ALMOST_HALF_HOUR = "INTERVAL '00:29:59.999999' HOUR TO SECOND"
_ALMOST_HOUR = "INTERVAL '00:59:59.999999' HOUR TO SECOND"

# Month -> meteorological season.
SEASONS = {12: "DJF", 1: "DJF", 2: "DJF", 3: "MAM", 4: "MAM", 5: "MAM",
           6: "JJA", 7: "JJA", 8: "JJA", 9: "SON", 10: "SON", 11: "SON"}


def centred_hour(ts: Column) -> Column:
    """Top of the hour H whose window (H-30 min, H+30 min] holds `ts`."""
    return F.date_trunc("hour", ts + F.expr(_ALMOST_HALF_HOUR))


def ceil_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts + F.expr(_ALMOST_HOUR))


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def hours_inside(start: Column, end: Column) -> Column:
    """How many whole hours H satisfy start <= H <= end (0 when either is unknown or none fits)."""
    n = (F.unix_timestamp(floor_hour(end)) - F.unix_timestamp(ceil_hour(start))) / 3600 + 1
    return F.coalesce(F.greatest(n.cast("int"), F.lit(0)), F.lit(0))


def dark_hours(start: Column, end: Column) -> Column:
    """Array of the whole hours in [start, end]; empty when unknown or start's hour is after end's."""
    lo, hi = ceil_hour(start), floor_hour(end)
    return F.when(lo <= hi, F.sequence(lo, hi, F.expr("INTERVAL 1 HOUR"))).otherwise(
        F.array().cast("array<timestamp>")
    )


def night_of_window(dusk: Column, tz: Column | str) -> Column:
    """A dark window belongs to the local date of its dusk."""
    return F.to_date(F.from_utc_timestamp(dusk, tz))


def night_of_moment(ts: Column, tz: Column | str) -> Column:
    """A moment belongs to the evening before local noon: 01:00 on Sunday is Saturday's night."""
    return F.to_date(F.from_utc_timestamp(ts, tz) - F.expr("INTERVAL 12 HOURS"))


def week_code(d: Column) -> Column:
    """ISO year * 100 + ISO week."""
    return (F.extract(F.lit("YEAROFWEEK"), d) * 100 + F.weekofyear(d)).cast("int")


def season(month: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in SEASONS.items() for v in kv])
    return F.try_element_at(table, month.cast("int"))


def assign_split(d: Column, train: tuple[str, str], test: tuple[str, str]) -> Column:
    """'train' / 'test' by inclusive date ranges, 'none' elsewhere."""
    rng = lambda r: d.between(F.lit(r[0]).cast("date"), F.lit(r[1]).cast("date"))
    return F.when(rng(test), "test").when(rng(train), "train").otherwise("none")


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, with microseconds."""
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def night_position(hour: Column, dusk: Column, dawn: Column) -> Column:
    """Where the hour sits in its window: 0 at dusk, 1 at dawn, clamped."""
    return clip(seconds_between(dusk, hour) / seconds_between(dusk, dawn), 0.0, 1.0)


def wall_clock_to_utc(local: Column, tz: Column | str) -> Column:
    """UTC instant of a wall-clock time; a time that does not exist moves forward, an ambiguous one is NULL."""
    utc = F.to_utc_timestamp(local, tz)
    again = F.from_utc_timestamp(utc + F.expr("INTERVAL 1 HOUR"), tz)
    return F.when(again == local, F.lit(None).cast("timestamp")).otherwise(utc)


def month_chunks(start: Column, end: Column) -> Column:
    """array<struct<lo,hi>> of calendar-month pieces covering [start, end], both inclusive."""
    months = F.sequence(F.trunc(start, "MM"), end, F.expr("INTERVAL 1 MONTH"))
    return F.transform(
        months, lambda m: F.struct(F.greatest(m, start).alias("lo"), F.least(F.last_day(m), end).alias("hi"))
    )


def year_chunks(start: Column, end: Column) -> Column:
    """array<struct<lo,hi>> of calendar-year pieces of [start, end]; hi is exclusive."""
    years = F.sequence(F.trunc(start, "YEAR"), end, F.expr("INTERVAL 1 YEAR"))
    return F.transform(
        years,
        lambda y: F.struct(
            F.greatest(y, start).alias("lo"),
            F.least(F.add_months(y, 12), F.date_add(end, 1)).alias("hi"),
        ),
    )


def assign_lead(dusk: Column, now: Column, max_lead: int = 7) -> Column:
    """Days ahead, as the training data counts them: ceil(hours / 24) held inside 1..max_lead."""
    days = F.ceil(seconds_between(now, dusk) / 86400.0).cast("int")
    return clip(days, 1, max_lead)
