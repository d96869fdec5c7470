"""Sky events as rows: meteor showers per place, close pairings, merging, ordering and filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nightfold.functions import skyfn as K

SHOWER = ["shower", "place"]
# Bright stars near the Moon's path.
MOON_STARS = ("Aldebaran", "Regulus", "Spica", "Antares")


def zenith_with_moon(zenith_sqm: Column, moon_alt: Column, phase_angle: Column) -> Column:
    """Overhead brightness with moonlight while the Moon is up."""
    lit = K.moon_sky_nl(90 - moon_alt, F.lit(0.0), 90 - moon_alt, phase_angle)
    return K.nl_to_mag(K.mag_to_nl(zenith_sqm) + F.when(moon_alt > 0, lit).otherwise(0.0))


def shower_rates(samples: DataFrame) -> DataFrame:
    """Expected hourly rate at each sample: shower, place, t, zhr, r, radiant_alt, zenith_sqm, moon_alt, phase_angle."""
    lm = K.limiting_magnitude(zenith_with_moon(F.col("zenith_sqm"), F.col("moon_alt"), F.col("phase_angle")))
    return samples.withColumn("rate", K.expected_rate(F.col("zhr"), F.col("r"), F.col("radiant_alt"), lm))


def shower_outlook(rates: DataFrame, keys: Sequence[str] = SHOWER, share: float = 0.6, steps_per_hour: int = 4) -> DataFrame:
    """Per shower and place: best moment and rate, the stretch at 60 % of it or more, hours with the Moon up,
    and the rate a natural sky would give at the best moment."""
    keys = list(keys)
    top = F.min_by(F.struct("t", "rate", "radiant_alt", "zhr", "r", "moon_alt"), F.struct(-F.col("rate"), F.col("t")))
    best = rates.groupBy(*keys).agg(
        top.alias("_b"), (F.avg((F.col("moon_alt") > 0).cast("double")) * F.count("*") / steps_per_hour).alias("moon_up_hours")
    ).select(*keys, "moon_up_hours", F.col("_b.t").alias("best_utc"), F.col("_b.rate").alias("best_rate"), F.col("_b.radiant_alt").alias("radiant_alt"),
             (F.col("_b.moon_alt") > 0).alias("moon_up_at_best"),
             K.expected_rate(F.col("_b.zhr"), F.col("_b.r"), F.col("_b.radiant_alt"), K.limiting_magnitude(F.lit(K.NATURAL_SQM))).alias("dark_rate"))
    good = rates.join(best.select(*keys, "best_utc", "best_rate"), keys).filter(
        F.when(F.col("best_rate") > 0, F.col("rate") >= share * F.col("best_rate")).otherwise(F.col("t") == F.col("best_utc"))
    )
    span = good.groupBy(*keys).agg(F.min("t").alias("best_start"), F.max("t").alias("best_end"))
    return best.join(span, keys).withColumn("outlook", K.rate_outlook(F.col("best_rate")))


def rank_by_rate(outlook: DataFrame, top: int | None = None) -> DataFrame:
    """Places of each shower by falling rate."""
    rank = F.row_number().over(W.partitionBy("shower").orderBy(F.col("best_rate").desc(), "place"))
    out = outlook.withColumn("rank", rank)
    return out if top is None else out.filter(F.col("rank") <= top)


def best_view(events: DataFrame, positions: DataFrame, max_sun: float = -8.0, min_alt: float = 8.0) -> DataFrame:
    """Moment nearest each event, within 18 hours, when both objects are high enough and the Sun low enough.
    `positions`: site, t, sun_alt, alt_a, az_a, alt_b on a regular grid (one row per site and quarter hour),
    listed for the days around them (288 moments at most a day), and an event picks from its day's list, so
    equal events stay separate rows."""
    ok = (F.col("sun_alt") <= max_sun) & (F.least("alt_a", "alt_b") >= min_alt)
    moment = F.struct(F.col("t"), ((F.col("alt_a") + F.col("alt_b")) / 2).alias("alt"), F.col("az_a").alias("az"))
    day = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.date_add(F.to_date("t"), i)))
    grids = positions.filter(ok).select("site", day.alias("_day"), moment.alias("_m")).groupBy("site", "_day").agg(F.collect_list("_m").alias("_grid"))
    gap = lambda m: F.abs(F.unix_micros(m["t"]) - F.unix_micros("utc"))
    near = F.filter("_grid", lambda m: gap(m) <= F.lit(18 * 3600 * 1000000))
    best = F.array_min(F.transform(near, lambda m: F.struct(gap(m).alias("g"), m["t"].alias("t"), m["alt"].alias("alt"), m["az"].alias("az"))))
    picked = events.withColumn("_day", F.to_date("utc")).join(grids, ["site", "_day"]).withColumn("_b", best).filter("_b is not null")
    return picked.select(*events.columns, F.col("_b.t").alias("view"), "_b.alt", "_b.az")


def merge_moon_pairings(pairings: DataFrame, tz: str) -> DataFrame:
    """One event per site and night for the Moon: the names in time order, the closest one's moment and gap.
    Each target counts once a night, at its closest, so the names gathered are at most the targets there are."""
    night = F.to_date(F.from_utc_timestamp(F.col("view") - F.expr("INTERVAL 12 HOURS"), tz))
    pairings = pairings.groupBy("site", night.alias("night_date"), "target").agg(F.min(F.struct("separation", "utc")).alias("_c"))
    pairings = pairings.select("site", "night_date", "target", "_c.separation", "_c.utc")
    names = F.transform(F.array_sort(F.collect_list(F.struct("utc", "target"))), lambda e: e["target"])
    first = F.min(F.struct("separation", "utc", "target")).alias("_m")
    per = pairings.groupBy("site", "night_date").agg(names.alias("names"), first)
    n = F.size("names")
    listing = F.when(n == 1, F.element_at("names", 1)).otherwise(
        F.concat(F.array_join(F.slice("names", F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at("names", -1))
    )
    return per.select("site", "night_date", "names", F.concat(F.lit("The Moon near "), listing).alias("title"), F.col("_m.separation").alias("separation"),
                      F.col("_m.utc").alias("utc"), F.col("_m.target").alias("closest"), K.apart_words(F.col("_m.separation")).alias("words"))


def worth_showing(events: DataFrame, stars: Sequence[str] = MOON_STARS, min_planet_alt: float = 8.0) -> DataFrame:
    """Leaves out the Moon passing only bright stars, and planet showings too low to see."""
    other = F.exists("names", lambda n: ~n.isin(list(stars)))
    return events.filter(F.when(F.col("kind") == "pairing", other).when(F.col("kind") == "planet", F.col("alt") >= min_planet_alt).otherwise(True))


def in_order(frames: Sequence[DataFrame], start: Column) -> DataFrame:
    """Events of every kind that are recent (a day back) or still active; the caller sorts for display."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    keep = (F.col("utc") >= start - F.expr("INTERVAL 1 DAY")) | F.coalesce(F.col("active_end") >= start, F.lit(False))
    return out.filter(keep)


def dark_week(moment: Column, tz: str) -> tuple[Column, Column]:
    """Three local days either side of a New Moon."""
    d = F.to_date(F.from_utc_timestamp(moment, tz))
    return F.date_sub(d, 3), F.date_add(d, 3)


def with_odds(event_places: DataFrame, forecast: DataFrame) -> DataFrame:
    """Forecast probability of each ranked place's night, where the forecast reaches it."""
    return event_places.join(forecast.select("site", "night_date", F.col("p").alias("odds")), ["site", "night_date"], "left")
