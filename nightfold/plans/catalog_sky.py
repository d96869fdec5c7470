"""Queries over sky physics, visibility and events, on samples derived from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightfold.functions import geofn as G, skyfn as K
from nightfold.operators import events as E, timeseries as S, visibility as Y
from nightfold.plans.derived import MOON, REP, R, big, moon, r6, reports, table, text, windows, with_
from nightfold.plans.catalog_spatial import comp, count_le
from nightfold.plans.registry import query

NIGHT = "strftime(night_date, '%Y-%m-%d %H:%M:%S') AS night_date"


def ts(c, out=None):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {out or c}"


# ---------- SQL of the physics ----------


def s_clip(x, lo, hi):
    return f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x}))"


def s_air(z):
    return f"pow(1 - 0.96 * pow(sin(radians({s_clip(z, 0, 90)})), 2), -0.5)"


def s_ext(z):
    return f"1 / (cos(radians({s_clip(z, 0, 90)})) + 0.50572 * pow(96.07995 - {s_clip(z, 0, 90)}, -1.6364))"


def s_flux(a):
    return f"pow(10.0, -0.4 * (3.84 + 0.026 * abs({a}) + 4e-9 * pow(abs({a}), 4)))"


def s_sep(x):
    r = s_clip(x, 0.5, 180)
    return f"({10**5.36!r} * (1.06 + pow(cos(radians({r})), 2)) + CASE WHEN {r} >= 10 THEN pow(10.0, 6.15 - {r} / 40) ELSE 6.2e7 * pow({r}, -2.0) END)"


def s_moonsky(sep, z, mz, a, k="0.2"):
    return f"{s_sep(sep)} * {s_flux(a)} * pow(10.0, -0.4 * {k} * {s_air(mz)}) * (1 - pow(10.0, -0.4 * {k} * {s_air(z)}))"


def s_nl(m):
    return f"34.08 * exp(20.7233 - 0.92104 * ({m}))"


def s_mag(b):
    return f"(20.7233 - ln(({b}) / 34.08)) / 0.92104"


def s_nelm(m):
    return f"7.93 - 5 * log10(pow(10.0, 4.316 - ({m}) / 5) + 1)"


def s_sky(alt, zs, ma, ms, pa):
    z = f"(90 - {alt})"
    rh = f"pow(10.0, -0.4 * 0.2 * ({s_air(z)} - 1)) * {s_air(z)}"
    return f"({s_nl(f'greatest(22.0, {zs})')} * {rh} + greatest({s_nl(zs)} - {s_nl('22.0')}, 0.0) * {rh} + CASE WHEN {ma} > 0 THEN {s_moonsky(ms, z, f'(90 - {ma})', pa)} ELSE 0.0 END)"


def s_limit(alt, zs, ma, ms, pa):
    return f"({s_nelm(s_mag(s_sky(alt, zs, ma, ms, pa)))}) - 0.2 * ({s_ext(f'(90 - {alt})')}) + 0.2"


def s_angle(a1, d1, a2, d2):
    dot = f"cos(radians({d1})) * cos(radians({a1})) * cos(radians({d2})) * cos(radians({a2})) + cos(radians({d1})) * sin(radians({a1})) * cos(radians({d2})) * sin(radians({a2})) + sin(radians({d1})) * sin(radians({d2}))"
    return f"degrees(acos({s_clip(dot, -1, 1)}))"


# ---------- formulas over the reports ----------

SMP = "sm AS (SELECT event_id, value % 90 AS alt, 17.0::DOUBLE + k / 20.0::DOUBLE AS zs, k - 40.0::DOUBLE AS ma, value * 3 % 180 AS ms, k * 1.7::DOUBLE AS pa, -(value % 25) AS sun, k * 1.3::DOUBLE + 1 AS ss, CASE WHEN k % 10 > 0 THEN k / 100.0::DOUBLE END AS aod, value * 8 AS elev FROM rep)"


def samples(spark, sf):
    v, k = F.col("value"), F.col("k").cast("double")
    return reports(spark, sf).select(
        "event_id", (v % 90).alias("alt"), (17.0 + k / 20.0).alias("zs"), (k - 40.0).alias("ma"), (v * 3 % 180).alias("ms"), (k * 1.7).alias("pa"),
        (-(v % 25)).alias("sun"), (k * 1.3 + 1).alias("ss"), F.when(F.col("k") % 10 > 0, k / 100.0).alias("aod"), (v * 8).alias("elev"),
    )


@query("moonlit_sky_brightness", "F15 F16 F17", with_(REP, SMP) + f"SELECT event_id, {R(s_mag(s_sky('alt', 'zs', 'ma', 'ms', 'pa')))} AS sqm, {R(s_limit('alt', 'zs', 'ma', 'ms', 'pa'))} AS faintest, {R('pow(10.0, 0.4 * (22.0 - zs))')} AS times_natural, {R(s_nelm('zs'))} AS nelm FROM sm")
def moonlit_sky_brightness(spark, sf):
    parts = {"moon_alt": F.col("ma"), "moon_sep": F.col("ms"), "phase_angle": F.col("pa")}
    return samples(spark, sf).select("event_id", r6(K.sky_brightness(F.col("alt"), F.col("zs"), **parts)).alias("sqm"), r6(K.faintest_visible(F.col("alt"), F.col("zs"), **parts)).alias("faintest"),
                                     r6(K.times_natural(F.col("zs"))).alias("times_natural"), r6(K.limiting_magnitude(F.col("zs"))).alias("nelm"))


def s_tw(z):
    return f"11.84 + 1.518 * ({z} - 95) - 0.057 * ({z} - 95) * ({z} - 95)"


TWI = f"CASE WHEN 90 - sun >= 105 THEN 0.0 ELSE {s_nl(s_tw(s_clip('(90 - sun)', 95, 105)))} - {s_nl(s_tw('105.0'))} END"
_CZ = "cos(radians(90 - alt))"
_XS = f"(1 / ({_CZ} + 0.025 * exp(-11 * {_CZ})))"
TSH = f"(pow(10.0, 0.4 * (90 - alt) / (360 * 0.2)) * (1 - pow(10.0, -0.4 * 0.2 * {_XS})) / {s_clip('ss', 1, 180)}) / ((1 - pow(10.0, -0.4 * 0.2)) / (90 - sun))"


TERM, SCALE = f"ln({s_sep('ms')})", f"{s_flux('pa')} * pow(10.0, -0.4 * 0.2 * {s_air('(90 - ma)')})"


@query("twilight_brightness", "F17 F16", with_(REP, SMP) + f"SELECT event_id, {R(TWI, 3)} AS twilight_nl, {R(TSH)} AS shape, {R(TERM)} AS moon_term, {R(SCALE)} AS moon_scale FROM sm")
def twilight_brightness(spark, sf):
    return samples(spark, sf).select("event_id", r6(K.twilight_nl(F.col("sun")), 3).alias("twilight_nl"), r6(K.twilight_shape(90 - F.col("alt"), F.col("ss"), F.col("sun"))).alias("shape"),
                                     r6(F.log(K.moon_sep_term(F.col("ms")))).alias("moon_term"), r6(K.moon_scale(F.col("ma"), F.col("pa"))).alias("moon_scale"))


@query("air_and_haze", "F19 F28", with_(REP, SMP) + f"""SELECT event_id, {R(f"0.1066 * exp(-greatest(elev, 0) / 1000.0 / 8.2) + 0.031 + {K.MAG_PER_TAU!r} * coalesce(aod, {K.AOD_REF!r})")} AS extinction, {R(f"coalesce(greatest({K.MAG_PER_TAU!r} * (aod - {K.AOD_REF!r}), 0.0), 0.0)")} AS dimming,
  CASE WHEN {K.MAG_PER_TAU!r} * (aod - {K.AOD_REF!r}) >= 1.0 THEN 'Thick smoke or haze' WHEN {K.MAG_PER_TAU!r} * (aod - {K.AOD_REF!r}) >= 0.5 THEN 'Smoke or haze' WHEN {K.MAG_PER_TAU!r} * (aod - {K.AOD_REF!r}) >= 0.2 THEN 'Some haze' END AS words FROM sm""")
def air_and_haze(spark, sf):
    d = K.dimming(F.col("aod"))
    return samples(spark, sf).select("event_id", r6(K.extinction(F.col("elev"), F.col("aod"))).alias("extinction"), r6(d).alias("dimming"), K.haze_words(d).alias("words"))


HGT = "CASE WHEN alt >= 70 THEN 'nearly overhead' WHEN alt >= 45 THEN 'high' WHEN alt >= 20 THEN 'halfway up' WHEN alt >= 5 THEN 'low' ELSE 'on the horizon' END"
NF = "CAST(round_even(ms / 30, 0) AS INTEGER)"


@query("plain_words", "F22", with_(REP, SMP) + f"""SELECT event_id, CASE WHEN zs >= 21.3 THEN 'Very dark' WHEN zs >= 20.3 THEN 'Dark' WHEN zs >= 19.25 THEN 'Suburban' WHEN zs >= 18 THEN 'Bright' ELSE 'City' END AS tier, CASE WHEN alt >= 70 THEN {HGT} ELSE {HGT} || ' in the ' || {comp('ss', G.COMPASS16)} END AS where_words,
  CASE WHEN pa / 100 + 1.0003 < 1.05 THEN 'About as dark as a natural sky' ELSE printf('%.1f× brighter than a natural sky', pa / 100 + 1.0003) END AS brightness,
  CASE WHEN ms / 30 + 0.0003 < 0.75 THEN printf('%.1f° apart, less than a finger''s width at arm''s length', ms / 30 + 0.0003) ELSE printf('%.1f° apart, about ', ms / 30 + 0.0003) || CASE CAST(round_even(ms / 30 + 0.0003, 0) AS INTEGER) WHEN 1 THEN 'one finger''s width' WHEN 2 THEN 'two fingers'' width' WHEN 3 THEN 'three fingers'' width' ELSE CAST(round_even(ms / 30 + 0.0003, 0) AS INTEGER) || ' fingers' END || ' at arm''s length' END AS apart FROM sm""")
def plain_words(spark, sf):
    return samples(spark, sf).select("event_id", K.darkness_title(F.col("zs")).alias("tier"), K.where_words(F.col("alt"), F.col("ss")).alias("where_words"),
                                     K.brightness_words(F.col("pa") / 100 + 1.0003).alias("brightness"), K.apart_words(F.col("ms") / 30 + 0.0003).alias("apart"))


@query("part_of_night", "F22", with_(REP) + "SELECT CASE WHEN hour(valid) BETWEEN 12 AND 21 THEN 'in the evening' WHEN hour(valid) >= 22 OR hour(valid) < 3 THEN 'around midnight' ELSE 'before dawn' END AS part, count(*) AS n FROM rep GROUP BY 1")
def part_of_night(spark, sf):
    return reports(spark, sf).groupBy(K.part_of_night(F.col("valid")).alias("part")).agg(F.count("*").alias("n"))


GX = [f"(cos(radians(ms)) * {K.GALACTIC[0][j]} * cos(radians(pa)) + cos(radians(ms)) * sin(radians(pa)) * {K.GALACTIC[1][j]} + sin(radians(ms)) * {K.GALACTIC[2][j]})" for j in range(3)]


@query("galactic_directions", "F27", with_(REP, "sm AS (SELECT event_id, k * 3.6::DOUBLE AS pa, value % 80 - 40 AS ms FROM rep)") + f"SELECT event_id, {R(f'(degrees(atan2({GX[1]}, {GX[0]})) + 360) % 360.0')} AS ra, {R(f'degrees(asin({s_clip(GX[2], -1, 1)}))')} AS dec FROM sm")
def galactic_directions(spark, sf):
    ra, dec = K.galactic_to_equatorial(F.col("k") * 3.6, F.col("value") % 80 - 40)
    return reports(spark, sf).select("event_id", r6(ra).alias("ra"), r6(dec).alias("dec"))


# ---------- tracks ----------

HRS = "epoch(hour) / 3600.0::DOUBLE"
TRK0 = f"""t0 AS (SELECT DISTINCT site, CAST(valid - INTERVAL 12 HOUR AS DATE) AS night_date, user_id % 40 AS object, date_trunc('hour', valid) AS hour, 34.0::DOUBLE + 2 * CAST(site[2:2] AS INTEGER) AS lat FROM rep),
t1 AS (SELECT *, object * 9.0::DOUBLE AS ra, object * 7 % 120 - 40.0::DOUBLE AS dec, ({HRS} * 15.041) % 360 AS lst FROM t0),
t2 AS (SELECT *, radians(lst - ra) AS h, radians(dec) AS d, radians(lat) AS p FROM t1),
tk AS (SELECT site, night_date, object, hour AS t, degrees(asin({s_clip('sin(p) * sin(d) + cos(p) * cos(d) * cos(h)', -1, 1)})) AS alt, (degrees(atan2(-cos(d) * sin(h), sin(d) * cos(p) - cos(d) * sin(p) * cos(h))) + 360) % 360.0 AS az, object / 8.0::DOUBLE AS vis_mag, object % 4 = 0 AS extended, 18.0::DOUBLE + object / 10.0::DOUBLE AS zenith_sqm FROM t2),
ms AS (SELECT DISTINCT site, CAST(hour - INTERVAL 12 HOUR AS DATE) AS night_date, hour AS t, alt, (epoch(hour) / 3600.0::DOUBLE * 14.49) % 360 AS az, abs((epoch(hour) / 3600.0::DOUBLE) % 708 - 354) / 354 * 180 AS phase_angle, illum FROM moon),
tm AS (SELECT tk.*, ms.alt AS moon_alt, ms.az AS moon_az, ms.phase_angle, ms.illum, {s_angle('tk.az', 'tk.alt', 'ms.az', 'ms.alt')} AS moon_sep FROM tk JOIN ms USING (site, night_date, t))"""


def tracks(spark, sf):
    r = reports(spark, sf)
    t0 = r.select("site", F.to_date(F.col("valid") - F.expr("INTERVAL 12 HOURS")).alias("night_date"), (F.col("user_id") % 40).cast("int").alias("object"), F.date_trunc("hour", "valid").alias("t")).distinct()
    o = F.col("object")
    alt, az = K.altaz_from_radec(o * 9.0, o * 7 % 120 - 40.0, 34.0 + 2 * F.substring("site", 2, 1).cast("int"), (F.unix_timestamp("t") / 3600.0 * 15.041) % 360)
    return t0.select("site", "night_date", "object", "t", alt.alias("alt"), az.alias("az"), (o / 8.0).alias("vis_mag"), (o % 4 == 0).alias("extended"), (18.0 + o / 10.0).alias("zenith_sqm"))


def moon_samples(spark, sf):
    h = F.unix_timestamp("hour") / 3600.0
    return moon(spark, sf).select("site", F.to_date(F.col("hour") - F.expr("INTERVAL 12 HOURS")).alias("night_date"), F.col("hour").alias("t"), "alt", ((h * 14.49) % 360).alias("az"),
                                  (F.abs(h % 708 - 354) / 354 * 180).alias("phase_angle"), "illum")


TRK = (REP, MOON, TRK0)


@query("object_tracks", "F21 D16 J22", with_(*TRK) + f"SELECT site, {NIGHT}, object, {ts('t')}, {R('alt')} AS alt, {R('az')} AS az, {R('moon_sep', 4)} AS moon_sep FROM tm")
def object_tracks(spark, sf):
    t = Y.with_moon(tracks(spark, sf), moon_samples(spark, sf))
    return t.select("site", text("night_date").alias("night_date"), big("object").alias("object"), text("t").alias("t"), r6("alt").alias("alt"), r6("az").alias("az"), r6("moon_sep", 4).alias("moon_sep"))


@query("objects_tonight", "M32 F17 F18", with_(*TRK) + f""", b AS (SELECT site, night_date, object, min(CASE WHEN alt >= 10 THEN t END) AS up_from, max(CASE WHEN alt >= 10 THEN t END) AS up_until, arg_min({{'t': t, 'alt': alt, 'az': az, 'v': vis_mag, 'e': extended, 'z': zenith_sqm, 'ma': moon_alt, 'ms': moon_sep, 'pa': phase_angle}}, (-alt, t)) AS b FROM tm GROUP BY ALL),
  c AS (SELECT site, night_date, object, up_from, up_until, b.t AS best, b.alt AS alt, b.az AS az, b.v AS v, b.e AS e, b.z AS zs, b.ma AS ma, b.ms AS ms, b.pa AS pa FROM b WHERE up_from IS NOT NULL), d AS (SELECT *, {s_limit('alt', 'zs', 'ma', 'ms', 'pa')} AS lim FROM c)
  SELECT site, {NIGHT}, object, {ts('best')}, {ts('up_from')}, {ts('up_until')}, {R('lim', 5)} AS limit_mag, alt > 0 AND v <= lim - CASE WHEN e THEN 0.5 ELSE 0.0 END AS visible, CASE WHEN alt >= 70 THEN {HGT} ELSE {HGT} || ' in the ' || {comp('az', G.COMPASS16)} END AS where_words FROM d""")
def objects_tonight(spark, sf):
    b = Y.best_moments(Y.with_moon(tracks(spark, sf), moon_samples(spark, sf)))
    return b.select("site", text("night_date").alias("night_date"), big("object").alias("object"), *[text(c).alias(c) for c in ("best", "up_from", "up_until")], r6("limit", 5).alias("limit_mag"), "visible", F.col("where").alias("where_words"))


@query("stars_visible", "A27", with_(*TRK) + f""", lo AS (SELECT site, night_date, arg_min(t, (moon_alt, t)) AS t FROM tm GROUP BY ALL)
  SELECT site, {NIGHT}, {ts('t')}, CAST(sum(CASE WHEN vis_mag <= {s_limit('alt', 'zenith_sqm', 'moon_alt', 'moon_sep', 'phase_angle')} THEN 1 ELSE 0 END) AS BIGINT) AS here, CAST(sum(CASE WHEN vis_mag <= {s_limit('alt', '22.0', 'moon_alt', 'moon_sep', 'phase_angle')} THEN 1 ELSE 0 END) AS BIGINT) AS natural, max(moon_alt > 0) AS moon_up FROM tm JOIN lo USING (site, night_date, t) WHERE alt > 0 GROUP BY site, night_date, t""")
def stars_visible(spark, sf):
    s = Y.stars_visible(Y.with_moon(tracks(spark, sf), moon_samples(spark, sf)).withColumnRenamed("vis_mag", "mag"))
    return s.select("site", text("night_date").alias("night_date"), text("t").alias("t"), "here", "natural", "moon_up")


INT = """iv AS (SELECT site, night_date, min(t) AS st, max(coalesce(nx, t)) AS en FROM (SELECT *, sum(CASE WHEN f AND NOT pf THEN 1 ELSE 0 END) OVER (PARTITION BY site, night_date ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM
  (SELECT site, night_date, t, alt > 0 AS f, coalesce(lag(alt > 0) OVER w, false) AS pf, lead(t) OVER w AS nx FROM ms WINDOW w AS (PARTITION BY site, night_date ORDER BY t))) WHERE f GROUP BY site, night_date, r),
cl AS (SELECT site, night_date, greatest(st, dusk) AS st, least(en, dawn) AS en FROM iv JOIN win USING (site, night_date) WHERE dusk IS NOT NULL AND least(en, dawn) > greatest(st, dusk)),
ph AS (SELECT b.site, b.night_date, b.dusk, b.dawn, b.hour, 1 - avg(s.cover) AS p FROM bb b JOIN ser s USING (site, hour) WHERE s.cover IS NOT NULL GROUP BY ALL)"""
from nightfold.plans.derived import SER, WIN, hourly_base, series  # noqa: E402

NIT = (REP, SER, WIN, MOON, TRK0, INT)


def moon_intervals(spark, sf):
    m = moon_samples(spark, sf)
    return Y.clip_to_window(S.true_runs(m, ["site", "night_date"], "t", F.col("alt") > 0), windows(spark, sf))


def hour_odds(spark, sf):
    base = hourly_base(spark, sf)
    b = S.backbone(windows(spark, sf, base), ["site", "night_date", "dusk", "dawn"], "dusk", "dawn")
    p = series(spark, sf, base).filter("cover is not null").groupBy("site", "hour").agg((1 - F.avg("cover")).alias("p"))
    return b.join(p, ["site", "hour"])


@query("moon_up_in_dark", "J18", with_(*NIT) + f"SELECT site, {NIGHT}, {ts('st', 'start')}, {ts('en', chr(34) + 'end' + chr(34))} FROM cl")
def moon_up_in_dark(spark, sf):
    return moon_intervals(spark, sf).select("site", *[text(c).alias(c) for c in ("night_date", "start", "end")])


@query("dark_clear_hours", "A18 J18", with_(*NIT) + f"SELECT site, {NIGHT}, {R('sum(CASE WHEN NOT EXISTS (SELECT 1 FROM cl WHERE cl.site = ph.site AND cl.night_date = ph.night_date AND cl.st <= ph.hour AND ph.hour < cl.en) THEN p ELSE 0 END)')} AS hours FROM ph GROUP BY site, night_date")
def dark_clear_hours(spark, sf):
    return Y.dark_clear_hours(hour_odds(spark, sf), moon_intervals(spark, sf)).select("site", text("night_date").alias("night_date"), r6("hours").alias("hours"))


@query("clear_moonless_span", "W4 J18", with_(*NIT) + f""", g AS (SELECT * FROM ph WHERE p >= 0.5 AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.site = ph.site AND cl.night_date = ph.night_date AND cl.st < ph.hour + INTERVAL 30 MINUTE AND ph.hour - INTERVAL 30 MINUTE < cl.en)),
  i AS (SELECT site, night_date, min(hour) AS a, max(hour) AS b, count(*) AS n, any_value(dusk) AS dusk, any_value(dawn) AS dawn FROM (SELECT *, hour - to_hours(CAST(row_number() OVER (PARTITION BY site, night_date ORDER BY hour) AS INTEGER)) AS k FROM g) GROUP BY site, night_date, k),
  f AS (SELECT site, night_date, n, greatest(a - INTERVAL 30 MINUTE, dusk) AS st, least(b + INTERVAL 30 MINUTE, dawn) AS en FROM (SELECT *, row_number() OVER (PARTITION BY site, night_date ORDER BY n DESC, a) AS r FROM i) WHERE r = 1)
  SELECT site, {NIGHT}, {ts('st', 'start')}, {ts('en', chr(34) + 'end' + chr(34))}, n AS length FROM f WHERE epoch(en) - epoch(st) >= 7200""")
def clear_moonless_span(spark, sf):
    s = Y.clear_moonless(hour_odds(spark, sf), moon_intervals(spark, sf), 2.0, 0.5)
    return s.select("site", *[text(c).alias(c) for c in ("night_date", "start", "end")], "length")


@query("viewing_night", "J19", with_(REP, WIN) + f""", j AS (SELECT r.event_id, w.night_date, w.dusk, NOT (w.dusk <= r.valid AND w.dawn >= r.valid) AS o, abs(epoch_us(w.dusk) / 2e6 + epoch_us(w.dawn) / 2e6 - epoch_us(r.valid) / 1e6) AS d FROM rep r JOIN win w ON w.site = r.site AND w.dusk IS NOT NULL AND abs(date_diff('day', CAST(r.valid AS DATE), w.night_date)) <= 2)
  SELECT event_id, {ts('arg_min(night_date, (o, d))', 'night_date')}, {ts('arg_min(dusk, (o, d))', 'dusk')} FROM j GROUP BY event_id""")
def viewing_night(spark, sf, twice=False):
    m = reports(spark, sf).select("event_id", "site", "valid")
    m = m.unionAll(m) if twice else m
    v = Y.viewing_night(m, windows(spark, sf), "valid")
    return v.select("event_id", text("night_date").alias("night_date"), text("dusk").alias("dusk"))


@query("milky_way_moment", "M32", with_(*TRK) + f""", s AS (SELECT site, night_date, t, sum(greatest(alt, 0.0)) AS score FROM tk WHERE abs(((object * 9 + 180) % 360) - 180) <= 90 GROUP BY ALL), w AS (SELECT s.site, s.night_date, s.t, ms.alt <= 0 AS down, CASE WHEN ms.alt <= 0 THEN score ELSE score * 0.25 END AS v FROM s JOIN ms USING (site, night_date, t))
  SELECT site, {NIGHT}, {ts('arg_min(t, (-v, t))', 'best')}, arg_min(down, (-v, t)) AS moon_down FROM w GROUP BY site, night_date""")
def milky_way_moment(spark, sf):
    band = tracks(spark, sf).withColumn("l", F.col("object") * 9.0)
    m = Y.milky_way_best(band, moon_samples(spark, sf))
    return m.select("site", text("night_date").alias("night_date"), text("best").alias("best"), "moon_down")


@query("opposite_moon", "M32", with_(*TRK) + f""", u AS (SELECT *, row_number() OVER (PARTITION BY site, night_date ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY site, night_date) AS n FROM ms WHERE alt > 5)
  SELECT site, {NIGHT}, {ts('t')}, {R('alt')} AS moon_alt, {comp('((az + 180) % 360)', G.COMPASS16)} AS face FROM u WHERE i = floor(n / 2)""")
def opposite_moon(spark, sf):
    o = Y.opposite_moon(moon_samples(spark, sf))
    return o.select("site", text("night_date").alias("night_date"), text("t").alias("t"), r6("moon_alt").alias("moon_alt"), "face")


@query("darkest_patch", "M32", with_(*TRK) + f", g AS (SELECT site, night_date, alt, az, {s_mag(s_sky('alt', 'zenith_sqm', 'moon_alt', 'moon_sep', 'phase_angle'))} AS sqm FROM tm WHERE alt >= 20) SELECT site, {NIGHT}, {R('arg_max(alt, sqm)')} AS darkest_alt, {R('max(sqm)')} AS darkest_sqm, {R('min(sqm)')} AS near_moon_sqm FROM g GROUP BY site, night_date")
def darkest_patch(spark, sf):
    t = Y.with_moon(tracks(spark, sf), moon_samples(spark, sf)).filter("alt >= 20")
    g = t.withColumn("sqm", K.sky_brightness(F.col("alt"), F.col("zenith_sqm"), moon_alt=F.col("moon_alt"), moon_sep=F.col("moon_sep"), phase_angle=F.col("phase_angle")))
    p = Y.darkest_patch(g, ["site", "night_date"])
    return p.select("site", text("night_date").alias("night_date"), *[r6(c).alias(c) for c in ("darkest_alt", "darkest_sqm", "near_moon_sqm")])


@query("pick_pattern", "O8", with_(*TRK) + f""", b AS (SELECT site, night_date, object, arg_min({{'alt': alt, 'v': vis_mag, 'e': extended, 'z': zenith_sqm, 'ma': moon_alt, 'ms': moon_sep, 'pa': phase_angle}}, (-alt, t)) AS b FROM tm GROUP BY ALL HAVING max(alt) >= 10), c AS (SELECT site, night_date, object, b.v AS v, b.alt > 0 AND b.v <= {s_limit('b.alt', 'b.z', 'b.ma', 'b.ms', 'b.pa')} - CASE WHEN b.e THEN 0.5 ELSE 0.0 END AS visible FROM b)
  SELECT site, {NIGHT}, CAST(arg_min(object, (NOT visible, CASE object WHEN 12 THEN 0 WHEN 7 THEN 1 ELSE 99 END, v, CAST(object AS VARCHAR))) AS VARCHAR) AS object FROM c WHERE visible GROUP BY site, night_date""")
def pick_pattern(spark, sf):
    b = Y.best_moments(Y.with_moon(tracks(spark, sf), moon_samples(spark, sf)))
    items = b.join(tracks(spark, sf).select("object", "vis_mag").distinct(), "object").withColumn("kind", F.lit("pattern")).withColumn("object", F.col("object").cast("string"))
    p = Y.pick_first(items, ["site", "night_date"], {"12": 0, "7": 1})
    return p.select("site", text("night_date").alias("night_date"), "object")


CAT = "st AS (SELECT s_suppkey AS star, (s_suppkey * 37.7::DOUBLE) % 360 AS ra, (s_suppkey * 13.3::DOUBLE) % 140 - 60 AS dec, abs(s_acctbal) / 2000 AS mag FROM supplier), cu AS (SELECT n_nationkey AS cluster, n_nationkey * 14.0::DOUBLE AS ra, n_nationkey * 4.0::DOUBLE - 45 AS dec, 15.0::DOUBLE AS radius FROM nation)"


def star_catalog(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("star"), ((k * 37.7) % 360).alias("ra"), ((k * 13.3) % 140 - 60).alias("dec"), (F.abs("s_acctbal") / 2000).alias("mag"))


@query("cluster_magnitude", "A28", with_(CAT) + f", n AS (SELECT cluster, mag, row_number() OVER (PARTITION BY cluster ORDER BY mag) AS r FROM cu JOIN st ON {s_angle('cu.ra', 'cu.dec', 'st.ra', 'st.dec')} <= radius) SELECT cu.cluster, {R('max(mag)')} AS mag FROM cu LEFT JOIN n ON n.cluster = cu.cluster AND r <= 3 GROUP BY 1")
def cluster_magnitude(spark, sf):
    k = F.col("n_nationkey")
    cl = table(spark, sf, "nation").select(k.alias("cluster"), (k * 14.0).alias("ra"), (k * 4.0 - 45).alias("dec"), F.lit(15.0).alias("radius"))
    return Y.group_magnitude(cl, star_catalog(spark, sf)).select("cluster", r6("mag").alias("mag"))


@query("figure_positions", "A35", with_(CAT) + f""", v AS (SELECT star % 7 AS figure, avg(cos(radians(dec)) * cos(radians(ra))) AS x, avg(cos(radians(dec)) * sin(radians(ra))) AS y, avg(sin(radians(dec))) AS z FROM st GROUP BY 1), m AS (SELECT star % 7 AS figure, mag, row_number() OVER (PARTITION BY star % 7 ORDER BY mag, star) AS r FROM st)
  SELECT v.figure, {R('(degrees(atan2(y, x)) + 360) % 360.0')} AS ra, {R('degrees(asin(z / sqrt(x * x + y * y + z * z)))')} AS dec, {R('min(mag)')} AS mag, {R('max(mag)')} AS faint_mag FROM v JOIN m USING (figure) WHERE r <= 5 GROUP BY v.figure, x, y, z""")
def figure_positions(spark, sf):
    s = star_catalog(spark, sf)
    p = Y.pattern_positions(s.select((F.col("star") % 7).alias("figure"), "ra", "dec"), s, within=1e-4)
    return p.select("figure", *[r6(c).alias(c) for c in ("ra", "dec", "mag", "faint_mag")])


BAND = (
    "bd AS (SELECT site, night_date, t, object * 9.0::DOUBLE AS l, alt, az, 'C' || (object % 12) AS con FROM tk)",
    "bw AS (SELECT *, coalesce(lead(alt) OVER w, first_value(alt) OVER w) AS a1, coalesce(lead(az) OVER w, first_value(az) OVER w) AS z1 FROM bd WINDOW w AS (PARTITION BY site, night_date, t ORDER BY l))",
    "bz AS (SELECT *, ((az + alt / (alt - a1) * ((z1 - az + 540) % 360 - 180)) % 360 + 360) % 360 AS way FROM bw WHERE (alt > 0) <> (a1 > 0))",
    f"be AS (SELECT site, night_date, t, string_agg(c, ',' ORDER BY l) AS ends FROM (SELECT *, {comp('way', G.COMPASS16)} AS c, row_number() OVER (PARTITION BY site, night_date, t ORDER BY l) AS k FROM bz) WHERE k <= 2 GROUP BY ALL)",
    "ba AS (SELECT site, night_date, t, con, min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY site, night_date, t ORDER BY -alt, con) AS r FROM bd WHERE alt > 15) GROUP BY ALL)",
    "bt AS (SELECT site, night_date, t, string_agg(con, ',' ORDER BY r) AS through FROM (SELECT *, row_number() OVER (PARTITION BY site, night_date, t ORDER BY r) AS k FROM ba) WHERE k <= 4 GROUP BY ALL)",
    "bp AS (SELECT site, night_date, t, max(alt) AS top_alt, arg_min(az, (-alt, l)) AS top_az, max(CASE WHEN abs((l + 180) % 360 - 180) <= 10 THEN alt END) AS core_alt FROM bd GROUP BY ALL)",
)


@query("band_description", "A37", with_(*TRK, *BAND) + f"""SELECT site, {NIGHT}, {ts('t')}, {R('top_alt')} AS top_alt, {R('top_az')} AS top_az, coalesce(ends, '') AS ends, {R('core_alt')} AS core_alt, coalesce(through, '') AS through
  FROM bp LEFT JOIN be USING (site, night_date, t) LEFT JOIN bt USING (site, night_date, t) WHERE top_alt > 0""")
def band_description(spark, sf):
    con = F.concat(F.lit("C"), (F.col("object") % 12).cast("string"))
    band = tracks(spark, sf).withColumn("l", F.col("object") * 9.0).withColumn("con", con)
    d = Y.describe_band(band, ["site", "night_date", "t"])
    return d.select("site", text("night_date").alias("night_date"), text("t").alias("t"), r6("top_alt").alias("top_alt"), r6("top_az").alias("top_az"), F.array_join("ends", ",").alias("ends"), r6("core_alt").alias("core_alt"), F.array_join("through", ",").alias("through"))


# ---------- showers and pairings ----------

SHO = """sh AS (SELECT n_nationkey AS shower, lpad(CAST(1 + n_nationkey % 12 AS VARCHAR), 2, '0') || '-10' AS start_md, lpad(CAST(1 + (n_nationkey + 1) % 12 AS VARCHAR), 2, '0') || '-05' AS end_md, make_timestamp(1998, CAST(1 + n_nationkey % 12 AS BIGINT), 20, 6, 0, 0.0) AS peak FROM nation),
aw AS (SELECT *, make_date(1998 - CASE WHEN s0 > CAST(peak AS DATE) THEN 1 ELSE 0 END, month(s0), day(s0)) AS st, make_date(1998 + CASE WHEN CAST(e0 AS TIMESTAMP) < peak THEN 1 ELSE 0 END, month(e0), day(e0)) + 1 AS en FROM (SELECT *, CAST('1998-' || start_md AS DATE) AS s0, CAST('1998-' || end_md AS DATE) AS e0 FROM sh))"""


def showers(spark, sf):
    k = F.col("n_nationkey")
    md = lambda m, d: F.concat(F.lpad((1 + m % 12).cast("string"), 2, "0"), F.lit(d))
    s = table(spark, sf, "nation").select(k.alias("shower"), md(k, "-10").alias("start_md"), md(k + 1, "-05").alias("end_md"), F.to_timestamp(F.concat(F.lit("1998-"), md(k, "-20 06:00:00"))).alias("peak"))
    a, b = K.active_window(F.col("start_md"), F.col("end_md"), F.col("peak"))
    return s.withColumn("start", a).withColumn("end", b)


@query("shower_activity", "F24", with_(SHO) + "SELECT shower, CAST(st AS VARCHAR) AS start, CAST(en AS VARCHAR) AS \"end\" FROM aw")
def shower_activity(spark, sf):
    return showers(spark, sf).select("shower", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


@query("showers_active", "J25", with_(SHO) + "SELECT o_orderkey, shower FROM orders JOIN aw ON en >= CAST(o_orderdate AS DATE) AND st <= CAST(o_orderdate AS DATE) + 3")
def showers_active(spark, sf):
    # A range condition per order date: the periods are listed by the days they span, then joined by day.
    s = showers(spark, sf)
    days = s.select("shower", "start", "end", F.explode(F.sequence(F.date_sub("start", 3), F.col("end"))).alias("day"))
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return Y.overlapping(o.join(days, "day"), "start", "end", F.col("day"), F.date_add("day", 3)).select("o_orderkey", "shower")


RAT = f"""ra AS (SELECT k % 6 AS shower, site AS place, valid AS t, 20.0::DOUBLE + k % 6 * 20 AS zhr, 2.0::DOUBLE + k % 6 / 10.0::DOUBLE AS r, value % 100 - 10 AS ralt, 18.0::DOUBLE + CAST(site[2:2] AS INTEGER) AS zs, k - 50.0::DOUBLE AS ma, k * 1.5::DOUBLE AS pa, event_id FROM rep),
rb AS (SELECT *, {s_nelm(s_mag(s_nl('zs') + ' + CASE WHEN ma > 0 THEN ' + s_moonsky('(90 - ma)', '0.0', '(90 - ma)', 'pa') + ' ELSE 0.0 END'))} AS lm FROM ra),
rc AS (SELECT *, CASE WHEN ralt > 0 THEN zhr * sin(radians({s_clip('ralt', 0, 90)})) / pow(r, 6.5 - least(lm, 6.5)) ELSE 0.0 END AS rate FROM rb)"""


def shower_samples(spark, sf):
    k = F.col("k")
    return reports(spark, sf).select(
        (k % 6).alias("shower"), F.col("site").alias("place"), F.col("valid").alias("t"), (20.0 + k % 6 * 20).alias("zhr"), (2.0 + (k % 6) / 10.0).alias("r"),
        (F.col("value") % 100 - 10).alias("radiant_alt"), (18.0 + F.substring("site", 2, 1).cast("int")).alias("zenith_sqm"), (k - 50.0).alias("moon_alt"), (k * 1.5).alias("phase_angle"),
    )


@query("shower_outlook", "A34 W13 F20 M32", with_(REP, RAT) + f""", b AS (SELECT shower, place, arg_min({{'t': t, 'rate': rate, 'ralt': ralt, 'zhr': zhr, 'r': r, 'ma': ma}}, (-rate, t)) AS b, avg(CAST(ma > 0 AS DOUBLE)) * count(*) / 4 AS moon_up_hours FROM rc GROUP BY ALL),
  g AS (SELECT shower, place, min(t) AS a, max(t) AS z FROM rc JOIN b USING (shower, place) WHERE CASE WHEN b.rate > 0 THEN rc.rate >= 0.6 * b.rate ELSE rc.t = b.t END GROUP BY ALL)
  SELECT b.shower, b.place, {ts('b.t', 'best_utc')}, {R('b.rate', 5)} AS best_rate, {R('moon_up_hours')} AS moon_up_hours, {ts('a', 'best_start')}, {ts('z', 'best_end')}, CASE WHEN b.rate >= 30 THEN 'Great' WHEN b.rate >= 12 THEN 'Good' WHEN b.rate >= 5 THEN 'Fair' ELSE 'Weak' END AS outlook FROM b JOIN g USING (shower, place)""")
def shower_outlook(spark, sf):
    o = E.shower_outlook(E.shower_rates(shower_samples(spark, sf)))
    return o.select(big("shower").alias("shower"), "place", *[text(c).alias(c) for c in ("best_utc", "best_start", "best_end")], r6("best_rate", 5).alias("best_rate"), r6("moon_up_hours").alias("moon_up_hours"), "outlook")


@query("shower_place_ranking", "M32 W15", with_(REP, RAT) + ", b AS (SELECT shower, place, max(rate) AS v FROM rc GROUP BY ALL) SELECT shower, place, row_number() OVER (PARTITION BY shower ORDER BY v DESC, place) AS rank FROM b")
def shower_place_ranking(spark, sf):
    r = E.rank_by_rate(E.shower_outlook(E.shower_rates(shower_samples(spark, sf))))
    return r.select(big("shower").alias("shower"), "place", big("rank").alias("rank"))


PAI = "pa AS (SELECT event_id, site, valid AS view, valid AS utc, CASE k % 4 WHEN 0 THEN 'Regulus' WHEN 1 THEN 'Jupiter' WHEN 2 THEN 'Spica' ELSE 'Venus' END AS target, value / 100 + 0.0003 AS separation FROM rep)"


def pairings(spark, sf):
    names = F.array(*[F.lit(x) for x in ("Regulus", "Jupiter", "Spica", "Venus")])
    return reports(spark, sf).select("event_id", "site", F.col("valid").alias("view"), F.col("valid").alias("utc"), F.element_at(names, F.col("k") % 4 + 1).alias("target"), (F.col("value") / 100 + 0.0003).alias("separation"))


@query("moon_pairings_merged", "A31 F3", with_(REP, PAI) + f""", o AS (SELECT site, CAST(timezone('America/Los_Angeles', view AT TIME ZONE 'UTC' - INTERVAL 12 HOUR) AS DATE) AS night_date, target, min(separation) AS separation, arg_min(utc, (separation, utc)) AS utc FROM pa GROUP BY ALL),
  g AS (SELECT site, night_date, list(target ORDER BY utc, target) AS names, min(separation) AS separation, arg_min(target, (separation, utc, target)) AS closest FROM o GROUP BY ALL)
  SELECT site, CAST(night_date AS VARCHAR) AS night_date, len(names) AS n, names[1] AS first_name, names[-1] AS last_name, {R('separation')} AS separation, closest FROM g""")
def moon_pairings_merged(spark, sf):
    m = E.merge_moon_pairings(pairings(spark, sf), "America/Los_Angeles")
    return m.select("site", F.col("night_date").cast("string").alias("night_date"), big(F.size("names")).alias("n"), F.element_at("names", 1).alias("first_name"), F.element_at("names", -1).alias("last_name"), r6("separation").alias("separation"), "closest")


@query("events_worth_showing", "P19", with_(REP) + "SELECT kind, count(*) AS n FROM (SELECT CASE k % 3 WHEN 0 THEN 'pairing' WHEN 1 THEN 'planet' ELSE 'meteor' END AS kind, CASE k % 4 WHEN 0 THEN 'Regulus' WHEN 1 THEN 'Jupiter' WHEN 2 THEN 'Spica' ELSE 'Venus' END AS name, value AS alt FROM rep) WHERE CASE kind WHEN 'pairing' THEN name NOT IN ('Regulus', 'Spica') WHEN 'planet' THEN alt >= 8 ELSE true END GROUP BY kind")
def events_worth_showing(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("pairing", "planet", "meteor")])
    names = F.array(*[F.lit(x) for x in ("Regulus", "Jupiter", "Spica", "Venus")])
    e = reports(spark, sf).select(F.element_at(kinds, F.col("k") % 3 + 1).alias("kind"), F.array(F.element_at(names, F.col("k") % 4 + 1)).alias("names"), F.col("value").alias("alt"))
    return E.worth_showing(e).groupBy("kind").agg(F.count("*").alias("n"))


@query("best_pairing_view", "W16", with_(REP) + f""", e AS (SELECT event_id, site, valid AS utc FROM rep), p AS (SELECT site, time_bucket(INTERVAL 15 MINUTE, valid) AS t, -(avg(k) - 30.0::DOUBLE) AS sun, avg(value) AS a, avg(k) * 0.9::DOUBLE AS b FROM rep GROUP BY ALL),
  j AS (SELECT e.event_id, p.t, (p.a + p.b) / 2 AS alt, abs(epoch_us(p.t) - epoch_us(e.utc)) AS g FROM e JOIN p ON p.site = e.site AND p.t BETWEEN e.utc - INTERVAL 18 HOUR AND e.utc + INTERVAL 18 HOUR AND p.sun <= -8 AND least(p.a, p.b) >= 8)
  SELECT event_id, {ts('arg_min(t, (g, t))', 'view')}, {R('arg_min(alt, (g, t))')} AS alt FROM j GROUP BY event_id""")
def best_pairing_view(spark, sf, twice=False):
    r = reports(spark, sf)
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp("valid") / 900) * 900)
    pos = r.groupBy("site", slot.alias("t")).agg((-(F.avg("k") - 30.0)).alias("sun_alt"), F.avg("value").alias("alt_a"), F.avg("k").alias("az_a"), (F.avg("k") * 0.9).alias("alt_b"))
    e = r.select("event_id", "site", F.col("valid").alias("utc"))
    v = E.best_view(e.unionAll(e) if twice else e, pos)
    return v.select("event_id", text("view").alias("view"), r6("alt").alias("alt"))


@query("events_in_order", "O9 U1", with_(REP) + f"SELECT event_id, kind, {ts('utc')} FROM (SELECT event_id, source AS kind, valid AS utc, CASE WHEN source = 'asos' THEN valid + to_days(CAST(k % 20 AS INTEGER)) END AS active_end FROM rep) WHERE utc >= TIMESTAMP '2024-01-14' OR coalesce(active_end >= TIMESTAMP '2024-01-15', false)")
def events_in_order(spark, sf):
    r = reports(spark, sf).select("event_id", F.col("source").alias("kind"), F.col("valid").alias("utc"), "k")
    meteor = r.filter("kind = 'asos'").withColumn("active_end", F.col("utc") + F.make_dt_interval(F.col("k") % 20)).drop("k")
    rest = r.filter("kind <> 'asos'").drop("k")
    o = E.in_order([rest, meteor], F.lit("2024-01-15").cast("timestamp"))
    return o.select("event_id", "kind", text("utc").alias("utc"))


@query("dark_week", "W17", with_(REP) + "SELECT event_id, CAST(d - 3 AS VARCHAR) AS first, CAST(d + 3 AS VARCHAR) AS last FROM (SELECT event_id, CAST(timezone('America/Los_Angeles', valid AT TIME ZONE 'UTC') AS DATE) AS d FROM rep)")
def dark_week(spark, sf):
    a, b = E.dark_week(F.col("valid"), "America/Los_Angeles")
    return reports(spark, sf).select("event_id", a.cast("string").alias("first"), b.cast("string").alias("last"))


@query("glow_grid_lookup", "F18 F28", with_(*TRK) + f"""SELECT site, {NIGHT}, object, {ts('t')}, {R('v')} AS glow FROM (SELECT *, (1 - fa) * ((1 - fz) * (1 + i * 0.5 + j0 / 10.0) + fz * (1 + i * 0.5 + j1 / 10.0)) + fa * ((1 - fz) * (1 + (i + 1) * 0.5 + j0 / 10.0) + fz * (1 + (i + 1) * 0.5 + j1 / 10.0)) AS v FROM
  (SELECT *, (a - [0.0, 20.0, 45.0, 90.0][i + 1]) / ([0.0, 20.0, 45.0, 90.0][i + 2] - [0.0, 20.0, 45.0, 90.0][i + 1]) AS fa, az / 10 - floor(az / 10) AS fz, CAST(floor(az / 10) AS INTEGER) % 36 AS j0, (CAST(floor(az / 10) AS INTEGER) + 1) % 36 AS j1 FROM
    (SELECT *, {s_clip('alt', 0, 90)} AS a, least(2, {count_le([0, 20, 45, 90], s_clip('alt', 0, 90))} - 1) AS i FROM tk)))""")
def glow_grid_lookup(spark, sf, twice=False):
    grid = reports(spark, sf).select("site").distinct()
    grid = grid.withColumn("alt_node", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("az_node", F.explode(F.sequence(F.lit(0), F.lit(35))))
    grid = grid.withColumn("value", 1 + F.col("alt_node") * 0.5 + F.col("az_node") / 10.0)
    samples = tracks(spark, sf).select("site", "night_date", "object", "t", "alt", "az")
    g = Y.glow_lookup(samples.unionAll(samples) if twice else samples, grid, [0, 20, 45, 90])
    return g.select("site", text("night_date").alias("night_date"), big("object").alias("object"), text("t").alias("t"), r6("glow").alias("glow"))


# ---------- limits from tables ----------


def s_axis(nodes, f, x):
    """SQL of `on_axis` for values that are f(node)."""
    c, lst = s_clip(x, nodes[0], nodes[-1]), "[" + ", ".join(f"{n}::DOUBLE" for n in nodes) + "]"
    i = f"least({len(nodes) - 2}, {count_le(nodes, c)} - 1)"
    a, b = f"{lst}[{i} + 1]", f"{lst}[{i} + 2]"
    return f"({f(a)} + ({f(b)} - {f(a)}) * ({c} - {a}) / ({b} - {a}))"


AXES = {
    "nat": (K.LIMIT_ALTS, lambda n: f"(55 + pow({n}, 1.5) / 40 + s)"), "moon_alt": (K.LIMIT_ALTS, lambda n: f"(1 / (1.2 - {n} / 100))"), "tw_alt": (K.LIMIT_ALTS, lambda n: f"(2 - sqrt({n}) / 10)"),
    "x_ext": (K.LIMIT_ALTS, lambda n: f"(1 / (0.05 + {n} / 90))"), "moon_sep": (K.LIMIT_SEPS, lambda n: f"(2 - log10({n} + 1) + s / 50)"),
}


def _limit_sql(dark: bool) -> str:
    ax = lambda name, x: s_axis(*AXES[name], x)
    b = ax("nat", "alt")
    if not dark:
        b += f" + 3 + az / 100 + CASE WHEN moon_alt > 0 THEN (moon_alt / 30) * pow(10, {ax('moon_sep', 'moon_sep')}) * {ax('moon_alt', 'alt')} ELSE 0 END"
    b += f" + CASE WHEN object % 3 = 0 THEN 5 * {ax('tw_alt', 'alt')} / {s_clip('az / 2', 1, 180)} ELSE 0 END"
    return f"7.93 - 5 * log10(pow(10, 4.316 - ((20.7233 - ln(({b}) / 34.08)) / 0.92104) / 5) + 1) - (0.2 + s / 100) * {ax('x_ext', 'alt')} + 0.15"


@query("limits_from_tables", "F18", with_(*TRK) + f"SELECT site, {NIGHT}, object, {ts('t')}, {R(_limit_sql(False), 5)} AS limit_mag, {R(_limit_sql(True), 5)} AS dark_limit FROM (SELECT *, CAST(site[2:2] AS INTEGER) AS s FROM tm)")
def limits_from_tables(spark, sf):
    """Every object's limiting magnitude from its site's tables, with and without the Moon and the glow."""
    s = F.substring("site", 2, 1).cast("int")
    sites = reports(spark, sf).select("site").distinct().withColumn("s", s)

    def axis(name):
        of = _AXIS_COLUMNS[name]
        return F.transform(F.array(*[F.lit(float(n)) for n in AXES[name][0]]), lambda n: of(n, F.col("s"))).alias(name)

    tables = sites.select("site", F.struct(*[axis(n) for n in AXES], (0.2 + F.col("s") / 100).alias("k"), F.lit(0.15).alias("k_ref")).alias("tables"))
    t = Y.with_moon(tracks(spark, sf), moon_samples(spark, sf)).join(tables, "site")  # one row a site
    args = (F.col("tables"), F.col("alt"), 3 + F.col("az") / 100, F.col("moon_sep"), F.when(F.col("moon_alt") > 0, F.col("moon_alt") / 30).otherwise(0.0), F.col("az") / 2, F.when(F.col("object") % 3 == 0, 5.0).otherwise(0.0))
    return t.select("site", text("night_date").alias("night_date"), big("object").alias("object"), text("t").alias("t"), r6(K.limit_from_tables(*args), 5).alias("limit_mag"), r6(K.limit_from_tables(*args, dark=True), 5).alias("dark_limit"))


_AXIS_COLUMNS = {
    "nat": lambda n, s: 55 + F.pow(n, F.lit(1.5)) / 40 + s, "moon_alt": lambda n, s: 1 / (1.2 - n / 100), "tw_alt": lambda n, s: 2 - F.sqrt(n) / 10,
    "x_ext": lambda n, s: 1 / (0.05 + n / 90), "moon_sep": lambda n, s: 2 - F.log10(n + 1) + s / 50,
}
