from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nightfold.functions import skyfn as K
from nightfold.operators import events as E, forecast as C, visibility as Y


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


L = lambda x: F.lit(float(x))
NIGHT = dt.date(2025, 1, 1)
T0 = dt.datetime(2025, 1, 2, 3)


def test_brightness_scale_inverts(spark):
    assert value(spark, K.nl_to_mag(K.mag_to_nl(L(20.5)))) == pytest.approx(20.5)
    assert value(spark, K.times_natural(L(22.0))) == 1.0
    assert value(spark, K.extinction_airmass(L(0))) == pytest.approx(1.0, abs=1e-3) and value(spark, K.extinction_airmass(L(90))) == pytest.approx(38, abs=0.5)


def test_unknown_stays_unknown(spark):
    null = F.lit(None).cast("double")
    assert value(spark, K.airmass(null)) is None and value(spark, K.sky_brightness(L(60), null)) is None


def test_moon_below_adds_nothing_and_twilight_ends(spark):
    dark = value(spark, K.sky_nl(L(60), L(21)))
    assert value(spark, K.sky_nl(L(60), L(21), moon_alt=L(-1), moon_sep=L(50), phase_angle=L(0))) == dark
    assert value(spark, K.sky_nl(L(60), L(21), moon_alt=L(30), moon_sep=L(50), phase_angle=L(0))) > dark
    assert value(spark, K.twilight_nl(L(-15))) == 0 and value(spark, K.twilight_nl(L(-8))) > 0


def test_galactic_centre_and_pole(spark):
    ra, dec = K.galactic_to_equatorial(L(0), L(0))
    assert value(spark, ra) == pytest.approx(266.405, abs=0.01) and value(spark, dec) == pytest.approx(-28.936, abs=0.01)
    ra, dec = K.galactic_to_equatorial(L(0), L(90))
    assert value(spark, ra) == pytest.approx(192.859, abs=0.01) and value(spark, dec) == pytest.approx(27.128, abs=0.01)


def test_altaz_at_the_pole_and_zenith(spark):
    alt, _ = K.altaz_from_radec(L(10), L(90), L(38), L(123))
    assert value(spark, alt) == pytest.approx(38.0)
    alt, _ = K.altaz_from_radec(L(10), L(38), L(38), L(10))
    assert value(spark, alt) == pytest.approx(90.0)


def test_meteor_rate_never_exceeds_zhr_and_needs_the_radiant_up(spark):
    assert value(spark, K.expected_rate(L(100), L(2.5), L(90), L(7.5))) == pytest.approx(100.0)
    assert value(spark, K.expected_rate(L(100), L(2.5), L(-5), L(6.5))) == 0.0


def test_activity_wraps_the_new_year(spark):
    d = spark.createDataFrame([("12-28", "01-12", dt.datetime(2026, 1, 3, 21))], "a string, b string, p timestamp")
    s, e = K.active_window(F.col("a"), F.col("b"), F.col("p"))
    r = d.select(s.alias("s"), e.alias("e")).first()
    assert (r["s"], r["e"]) == (dt.date(2025, 12, 28), dt.date(2026, 1, 13))


def moon(spark, alts):
    rows = [("a", NIGHT, T0 + dt.timedelta(hours=i), float(a), 180.0, 90.0, 0.5) for i, a in enumerate(alts)]
    return spark.createDataFrame(rows, "site string, night_date date, t timestamp, alt double, az double, phase_angle double, illum double")


def test_object_is_judged_at_its_highest(spark):
    rows = [("a", NIGHT, "x", T0 + dt.timedelta(hours=i), alt, 90.0, 3.0, False, 21.0) for i, alt in enumerate([5.0, 40.0, 20.0])]
    t = spark.createDataFrame(rows, "site string, night_date date, object string, t timestamp, alt double, az double, vis_mag double, extended boolean, zenith_sqm double")
    r = Y.best_moments(Y.with_moon(t, moon(spark, [-9, -9, -9]))).first()
    assert (r["best"], r["up_from"], r["up_until"], r["visible"]) == (T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2), True)
    assert r["where"] == "halfway up in the E"
    assert Y.best_moments(Y.with_moon(t, moon(spark, [0, 0, 0])), 60.0).isEmpty()


def test_interval_rules(spark):
    h = spark.createDataFrame([("a", NIGHT, T0 + dt.timedelta(hours=i), 0.9, T0 - dt.timedelta(hours=1), T0 + dt.timedelta(hours=9)) for i in range(6)],
                              "site string, night_date date, hour timestamp, p double, dusk timestamp, dawn timestamp")
    up = spark.createDataFrame([("a", NIGHT, T0 + dt.timedelta(hours=4), T0 + dt.timedelta(hours=5))], "site string, night_date date, start timestamp, end timestamp")
    assert Y.dark_clear_hours(h, up).first()["hours"] == pytest.approx(0.9 * 5)
    s = Y.clear_moonless(h, up).first()
    assert (s["start"], s["end"]) == (T0 - dt.timedelta(minutes=30), T0 + dt.timedelta(hours=3, minutes=30))


def test_band_description(spark):
    rows = [(1, float(l), float(alt), float(az), con) for l, (alt, az, con) in enumerate([(-10, 90, "A"), (20, 100, "B"), (60, 180, "C"), (30, 250, "B"), (-5, 260, "D")])]
    b = spark.createDataFrame(rows, "k int, l double, alt double, az double, con string")
    r = Y.describe_band(b, ["k"]).first()
    assert (r["top_alt"], r["top_az"], r["through"], r["ends"]) == (60.0, 180.0, ["C", "B"], ["E", "WSW"])


def test_moon_pairings_merge_by_night(spark):
    rows = [("a", T0, T0, "Jupiter", 2.0), ("a", T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=2), "Regulus", 1.0), ("a", T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=1), "Spica", 1.5)]
    p = spark.createDataFrame(rows, "site string, view timestamp, utc timestamp, target string, separation double")
    got = [(r["title"], r["closest"]) for r in E.merge_moon_pairings(p, "America/Los_Angeles").orderBy("night_date").collect()]
    assert got == [("The Moon near Jupiter and Regulus", "Regulus"), ("The Moon near Spica", "Spica")]


def test_shower_stretch_is_sixty_percent_of_the_best(spark):
    rows = [(1, "a", T0 + dt.timedelta(minutes=15 * i), 100.0, 2.0, alt, 22.0, -10.0, 90.0) for i, alt in enumerate([10.0, 45.0, 90.0, 50.0, 5.0])]
    s = spark.createDataFrame(rows, "shower int, place string, t timestamp, zhr double, r double, radiant_alt double, zenith_sqm double, moon_alt double, phase_angle double")
    o = E.shower_outlook(E.shower_rates(s)).first()
    assert (o["best_utc"], o["best_start"], o["best_end"]) == (T0 + dt.timedelta(minutes=30), T0 + dt.timedelta(minutes=15), T0 + dt.timedelta(minutes=45))
    assert o["dark_rate"] == pytest.approx(o["best_rate"]) and o["moon_up_hours"] == 0


def test_verdicts(spark):
    d = spark.createDataFrame([(0.7,), (0.4,), (0.39,), (None,)], "p double")
    assert [r["v"] for r in d.select(C.verdict_for(F.col("p")).alias("v")).collect()] == ["Go", "Maybe", "Skip", "No data"]


def test_next_better_night_needs_a_clear_margin(spark):
    rows = [("a", dt.date(2025, 1, i), p) for i, p in ((1, 0.5), (2, 0.7), (3, 0.8))]
    d = spark.createDataFrame(rows, "site string, night_date date, p double")
    assert C.next_better_night(d, ["site"]).first()["night_date"] == dt.date(2025, 1, 3)
    assert C.next_better_night(d.filter("p < 0.75"), ["site"]).isEmpty()


def test_forecast_agreement_flip_and_split(spark):
    rows = [("a", T0 + dt.timedelta(hours=i), x, y) for i, (x, y) in enumerate([(0.1, 0.1), (0.1, 0.9), (0.9, 0.9)])]
    r = C.forecast_agreement(spark.createDataFrame(rows, "site string, hour timestamp, x_cover double, y_cover double"), ["site"], ["x", "y"]).first()
    assert (r["n_models"], r["first_split"], r["first_flip"], r["always_agree"]) == (2, T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2), False)
