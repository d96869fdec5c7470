"""Queries over the parsers: text in every supported format is built from table columns, odd cases included, and parsed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nightfold.plans.derived import BASE, R, REP, big, r6, reports, series, table, text, with_
from nightfold.plans.registry import query
from nightfold.sources import readers as S, sinks as K
from nightfold.streaming import jobs as J
from nightfold.streaming.daylog import DayLog
from nightfold.util import ensure_checkpoint_dir

# ---------- station lines ----------

STATION = ["station", "valid", "skyc1", "skyc2", "skyc3", "skyc4", "metar"]


def station_lines(spark, sf):
    """Every report as a CSV line: minutes only, a stray carriage return and an open quote in the remark, a torn line for
    every 29th and an unreadable time for every 31st."""
    r, e = reports(spark, sf), F.col("event_id")
    whole = F.concat_ws(",", "site", F.date_format("valid", "yyyy-MM-dd HH:mm"), "skyc1", "skyc2", F.lit("M"), F.lit("M"), F.concat(F.lit('RMK "'), F.col("source"), F.lit("\rNO")))
    bad_time = F.concat_ws(",", "site", F.lit("soon"), "skyc1", "skyc2", F.lit("M"), F.lit("M"), F.lit("x"))
    line = F.when(e % 29 == 0, F.concat_ws(",", "site", F.lit("2024-01-01 00:00"))).when(e % 31 == 0, bad_time).otherwise(whole)
    return r.select(line.alias("value"))


@query("parsed_reports", "S1", with_(REP) + """SELECT site AS station, strftime(date_trunc('minute', valid), '%Y-%m-%d %H:%M:%S') AS valid, skyc1, skyc2, 'M' AS skyc3, count(*) OVER () AS n_rows FROM
  (SELECT DISTINCT site, date_trunc('minute', valid) AS valid, skyc1, skyc2 FROM rep1 WHERE event_id % 29 <> 0 AND event_id % 31 <> 0)""")
def parsed_reports(spark, sf):
    rows, _ = S.parse_reports(station_lines(spark, sf), STATION)
    rows = rows.select("station", text("valid").alias("valid"), "skyc1", "skyc2", "skyc3")
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("n_rows"))))  # one row


@query("quarantined_reports", "S1", with_(REP) + """SELECT CASE WHEN event_id % 29 = 0 THEN 'too few fields' ELSE 'unreadable time' END AS reason, count(*) AS n FROM rep WHERE event_id % 29 = 0 OR event_id % 31 = 0 GROUP BY 1""")
def quarantined_reports(spark, sf):
    _, bad = S.parse_reports(station_lines(spark, sf), STATION)
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


# ---------- hourly payloads ----------


def _payload(hours, keys, series_of, zone=None):
    """Payload JSON per key: the times and, under each name, the values as text, in the order of the hours."""
    at = F.date_format("hour", "yyyy-MM-dd'T'HH:mm")
    cells = F.array_sort(F.collect_list(F.struct(F.col("hour"), at.alias("t"), *[v.alias(n) for n, v in series_of.items()])))  # hours of one day
    g = hours.groupBy(*keys).agg(cells.alias("c"))
    pairs = [F.lit("time"), F.col("c.t")]
    for n in series_of:
        pairs += [F.lit(n), F.col(f"c.{n}")]
    body = F.struct((zone if zone is not None else F.lit("GMT")).alias("timezone"), F.create_map(*pairs).alias("hourly"))
    return g.withColumn("value", F.to_json(body, {"ignoreNullFields": "false"}))


def hourly_payloads(spark, sf):
    """A payload per site, source and day; odd percentages just outside the range are rounding, some days are in another zone,
    some hold an impossible value, some are cut short."""
    h = series(spark, sf).filter("cover is not null").withColumn("day", F.to_date("hour"))
    d = F.dayofmonth("day")
    pct = F.when(F.col("cover") >= 1, F.when(F.hour("hour") % 2 == 0, 101.0).otherwise(100.0)).otherwise(F.round(F.col("cover") * 100, 4))
    pct = F.when((d % 11 == 0) & (F.col("source") == "gfs"), pct + 150).otherwise(pct)
    p = _payload(h.withColumn("pct", pct), ["site", "source", "day"], {"cloud_cover_gfs": F.col("pct").cast("string"), "visibility": F.hour("hour").cast("string")}, F.when(F.dayofmonth("day") % 13 == 0, "PST").otherwise("UTC"))
    value = F.when(F.dayofmonth("day") % 17 == 0, F.expr("left(value, length(value) - 9)")).otherwise(F.col("value"))
    name = F.concat(F.lit("/in/"), F.col("site"), F.lit("/"), F.col("source"), F.lit("/"), F.date_format("day", "yyyyMMdd"), F.lit("_"), F.date_format("day", "yyyyMMdd"), F.lit(".json"))
    return p.select(value.alias("value"), name.alias("file"))


PAY = "pay AS (SELECT site, source, hour, cover, day(hour) AS d FROM ser WHERE cover IS NOT NULL)"
BAD = "CASE WHEN d % 17 = 0 THEN 'not JSON' WHEN d % 13 = 0 THEN 'not UTC' WHEN d % 11 = 0 AND source = 'gfs' THEN 'out of range' END"


@query("parsed_hourly", "S2 S3", with_(*BASE, PAY) + f"""SELECT '/in/' || site || '/' || source || '/' || strftime(hour, '%Y%m%d') || '_' || strftime(hour, '%Y%m%d') || '.json' AS file, strftime(hour, '%Y%m%d') AS chunk_end, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour,
  {R('least(1.0, round(cover * 100, 4) / 100)')} AS cloud_cover, CAST(hour(hour) AS DOUBLE) AS visibility, CAST(NULL AS DOUBLE) AS cloud_cover_low FROM pay WHERE {BAD} IS NULL""")
def parsed_hourly(spark, sf):
    rows, _ = S.parse_hourly(hourly_payloads(spark, sf), ["cloud_cover", "visibility", "cloud_cover_low"], "gfs")
    return rows.select("file", "chunk_end", text("hour").alias("hour"), r6("cloud_cover").alias("cloud_cover"), "visibility", "cloud_cover_low")


@query("quarantined_hourly", "S3", with_(*BASE, PAY) + f"SELECT {BAD} AS reason, count(DISTINCT (site, source, CAST(hour AS DATE))) AS n FROM pay WHERE {BAD} IS NOT NULL GROUP BY 1")
def quarantined_hourly(spark, sf):
    _, bad = S.parse_hourly(hourly_payloads(spark, sf), ["cloud_cover"], "gfs")
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("parsed_forecast_payload", "S9", with_(*BASE) + f"""SELECT site || '/' || strftime(hour, '%Y-%m-%d') AS file, source AS model, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, {R('round(100 * cover, 3) / 100')} AS cloud_cover, {R('round(50 * cover, 3) / 100')} AS cloud_cover_low
  FROM (SELECT s.*, h.hour AS hh FROM (SELECT DISTINCT site, hour FROM ser WHERE source IN ('gfs', 'ecmwf')) h JOIN ser s USING (site, hour)) WHERE source IN ('gfs', 'ecmwf')
  UNION ALL SELECT h.site || '/' || strftime(h.hour, '%Y-%m-%d'), m.source, strftime(h.hour, '%Y-%m-%d %H:%M:%S'), NULL, NULL FROM (SELECT DISTINCT site, hour FROM ser WHERE source IN ('gfs', 'ecmwf')) h, (SELECT unnest(['gfs', 'ecmwf']) AS source) m WHERE NOT EXISTS (SELECT 1 FROM ser s WHERE s.site = h.site AND s.hour = h.hour AND s.source = m.source)""")
def parsed_forecast_payload(spark, sf):
    """One payload per site and day with the total and the low cover of two models."""
    s = series(spark, sf).filter("source in ('gfs', 'ecmwf')")
    pick = lambda m, k: F.max(F.when(F.col("source") == m, F.round(F.col("cover") * k, 3).cast("string")))
    wide = s.groupBy("site", "hour").agg(*[pick(m, k).alias(f"{v}_{m}_id") for m in ("gfs", "ecmwf") for v, k in (("cloud_cover", 100), ("cloud_cover_low", 50))])
    names = [c for c in wide.columns if c.startswith("cloud")]
    p = _payload(wide.withColumn("day", F.to_date("hour")), ["site", "day"], {c: F.col(c) for c in names})
    p = p.select("value", F.concat_ws("/", "site", F.date_format("day", "yyyy-MM-dd")).alias("file"))
    out = S.parse_forecast_payload(p, {"gfs": "gfs_id", "ecmwf": "ecmwf_id"}, ["cloud_cover", "cloud_cover_low"])
    return out.select("file", "model", text("hour").alias("hour"), r6("cloud_cover").alias("cloud_cover"), r6("cloud_cover_low").alias("cloud_cover_low"))


MEMBERS = {"asos": "", "era5": "_member01", "goes": "_member02"}


@query("parsed_ensemble", "S10", with_(*BASE) + f"""SELECT h.site || '/' || strftime(h.hour, '%Y-%m-%d') AS file, CASE m.source WHEN 'asos' THEN 'control' WHEN 'era5' THEN 'member01' ELSE 'member02' END AS member, strftime(h.hour, '%Y-%m-%d %H:%M:%S') AS hour, {R('round(100 * s.cover, 3) / 100')} AS cover
  FROM (SELECT DISTINCT site, hour FROM ser WHERE source IN ('asos', 'era5', 'goes')) h CROSS JOIN (SELECT unnest(['asos', 'era5', 'goes']) AS source) m LEFT JOIN ser s ON s.site = h.site AND s.hour = h.hour AND s.source = m.source""")
def parsed_ensemble(spark, sf):
    s = series(spark, sf).filter(F.col("source").isin(list(MEMBERS)))
    wide = s.groupBy("site", "hour").agg(*[F.max(F.when(F.col("source") == k, F.round(F.col("cover") * 100, 3).cast("string"))).alias(f"cloud_cover{v}_ens") for k, v in MEMBERS.items()])
    p = _payload(wide.withColumn("day", F.to_date("hour")), ["site", "day"], {c: F.col(c) for c in wide.columns if c.startswith("cloud")})
    out = S.parse_ensemble(p.select("value", F.concat_ws("/", "site", F.date_format("day", "yyyy-MM-dd")).alias("file")), "ens")
    return out.select("file", "member", text("hour").alias("hour"), r6("cover").alias("cover"))


@query("parsed_aerosol", "S11", with_(*BASE) + f"SELECT site || '/' || strftime(hour, '%Y-%m-%d') AS file, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, {R('round(cover, 4)')} AS aod FROM ser WHERE source = 'goes' AND cover > 0.2")
def parsed_aerosol(spark, sf):
    s = series(spark, sf).filter("source = 'goes'").withColumn("day", F.to_date("hour"))
    p = _payload(s, ["site", "day"], {"aerosol_optical_depth": F.when(F.col("cover") > 0.2, F.round("cover", 4).cast("string"))})
    out = S.parse_aerosol(p.select("value", F.concat_ws("/", "site", F.date_format("day", "yyyy-MM-dd")).alias("file")))
    return out.select("file", text("hour").alias("hour"), r6("aod").alias("aod"))


# ---------- places and stations ----------


@query("parsed_stations", "S6", f"SELECT s_name AS name, CAST(s_suppkey AS VARCHAR) AS id, {R('30 + s_suppkey % 17')} AS lat, {R('-120 + s_suppkey % 23 / 10.0')} AS lon, CASE WHEN s_suppkey % 7 > 0 THEN s_acctbal END AS elevation_m, CASE WHEN s_suppkey % 5 > 0 THEN 'W' || s_nationkey ELSE '' END AS region, s_suppkey % 3 = 0 AS online, s_suppkey % 4 = 0 AS is_awos, CAST(DATE '1950-01-01' + CAST(s_suppkey % 20000 AS INTEGER) AS VARCHAR) AS archive_begin FROM supplier")
def parsed_stations(spark, sf):
    """A GeoJSON document per nation with its suppliers as stations."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    props = F.struct(
        k.cast("string").alias("sid"), F.col("s_name").alias("sname"), F.when(k % 7 > 0, F.col("s_acctbal")).alias("elevation"), F.lit("America/Los_Angeles").alias("tzname"),
        F.date_add(F.lit("1950-01-01").cast("date"), (k % 20000).cast("int")).cast("string").alias("archive_begin"), (k % 3 == 0).alias("online"),
        F.when(k % 5 > 0, F.concat(F.lit("W"), F.col("s_nationkey").cast("string"))).alias("wfo"), F.struct(F.when(k % 4 == 0, "1").otherwise("0").alias("IS_AWOS")).alias("attributes"),
    )
    feature = F.struct(F.struct(F.array(-120 + k % 23 / 10.0, (30 + k % 17).cast("double")).alias("coordinates")).alias("geometry"), props.alias("properties"))
    docs = s.groupBy("s_nationkey", F.floor(k / 1000).alias("part")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))  # a thousand stations a document
    out = S.parse_stations(docs)
    return out.select("name", "id", r6("lat").alias("lat"), r6("lon").alias("lon"), "elevation_m", "region", "online", "is_awos", F.col("archive_begin").cast("string").alias("archive_begin"))


PLACES = "pl AS (SELECT c_custkey AS k, c_name, c_acctbal, CASE c_custkey % 4 WHEN 0 THEN '25' WHEN 1 THEN '43' WHEN 2 THEN '57' ELSE '99' END AS lsad FROM customer)"


def place_lines(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    lsad = F.element_at(F.array(*[F.lit(x) for x in ("25", "43", "57", "99")]), (k % 4 + 1).cast("int"))
    name = F.concat(F.lit("Place "), k.cast("string"), F.when(k % 4 == 0, " city").when(k % 4 == 1, " town").when(k % 4 == 2, " CDP").otherwise(""))
    return c.select(F.concat_ws("|", F.when(k % 3 == 0, "CA").otherwise("NV"), F.lpad(k.cast("string"), 7, "0"), (k * 10).cast("string"), name, lsad, (k * 1000).cast("string"), F.concat((30 + k % 10).cast("string"), F.lit(" ")), (-(k % 50)).cast("string")).alias("value"), k.alias("k"))


CENSUS = ["USPS", "GEOID", "ANSICODE", "NAME", "LSAD", "ALAND", "INTPTLAT", "INTPTLONG"]


@query("parsed_census_places", "S7", with_(PLACES) + f"SELECT lpad(CAST(k AS VARCHAR), 7, '0') AS geoid, k * 10 AS gnis_id, 'Place ' || k AS name, CASE lsad WHEN '25' THEN 'city' WHEN '43' THEN 'town' ELSE 'community' END AS kind, CAST(30 + k % 10 AS DOUBLE) AS lat, CAST(-(k % 50) AS DOUBLE) + 0.0 AS lon, {R('k / 1000.0')} AS land_km2 FROM pl WHERE k % 3 = 0")
def parsed_census_places(spark, sf):
    t = S.parse_table(place_lines(spark, sf), "|", CENSUS)
    return S.census_places(t, "CA").select("geoid", "gnis_id", "name", "kind", "lat", (F.col("lon") + 0.0).alias("lon"), r6("land_km2").alias("land_km2"))


@query("parsed_zip_areas", "S7", with_(PLACES) + "SELECT lpad(CAST(k AS VARCHAR), 7, '0') AS zip, CAST(30 + k % 10 AS DOUBLE) AS lat, CAST(-(k % 50) AS DOUBLE) + 0.0 AS lon FROM pl WHERE CAST(substr(lpad(CAST(k AS VARCHAR), 7, '0'), 1, 3) AS INTEGER) BETWEEN 0 AND 0")
def parsed_zip_areas(spark, sf):
    t = S.parse_table(place_lines(spark, sf), "|", CENSUS)
    return S.zip_areas(t, 0, 0).select("zip", "lat", (F.col("lon") + 0.0).alias("lon"))


GNIS = ["feature_id", "feature_name", "feature_class", "state_name", "county_name", "prim_lat_dec", "prim_long_dec"]


@query("parsed_named_features", "S7", "SELECT p_partkey AS gnis_id, p_name AS name, p_type AS feature_class, p_brand AS county, CAST(p_size AS DOUBLE) AS lat, p_retailprice AS lon FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 8 <> 0")
def parsed_named_features(spark, sf):
    """Some coordinates are unreadable; such features are left out."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    lat = F.when(k % 8 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    lines = p.select(F.concat_ws("|", k.cast("string"), "p_name", "p_type", F.when(k % 3 == 0, "California").otherwise("Nevada"), "p_brand", lat, F.col("p_retailprice").cast("string")).alias("value"))
    return S.named_features(S.parse_table(lines, "|", GNIS), "California")


def geoname_lines(spark, sf):
    """Tab-separated places; populations are empty for every fifth, every sixth is no populated place."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    e = F.lit("")
    cells = [k.cast("string"), F.col("c_name"), e, e, (20 + k % 40).cast("string"), (-150 + k % 90).cast("string"), F.when(k % 6 == 0, "S").otherwise("P"), F.lit("PPL"), F.when(k % 9 == 0, "MX").otherwise("US"), e,
             F.when(k % 2 == 0, "CA").otherwise("NV"), F.lpad((k % 25).cast("string"), 3, "0"), e, e, F.when(k % 5 == 0, "").otherwise((k * 7).cast("string")), e, F.when(k % 4 == 0, "-").otherwise((k % 3000).cast("string")), e, e]
    return c.select(F.concat_ws("\t", *cells).alias("value"))


def county_lines(spark, sf):
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    return n.select(F.concat_ws("\t", F.concat(F.lit("US.CA."), F.lpad(k.cast("string"), 3, "0")), F.concat("n_name", F.lit(" County")), F.col("n_name"), k.cast("string")).alias("value"))


@query("parsed_geonames", "S7", "SELECT c_custkey AS geonameid, c_name AS name, n_name AS county, CAST(20 + c_custkey % 40 AS DOUBLE) AS lat, CAST(-150 + c_custkey % 90 AS DOUBLE) AS lon, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey * 7 END AS population, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 3000 AS DOUBLE) END AS dem FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 25 WHERE c_custkey % 2 = 0 AND c_custkey % 6 <> 0")
def parsed_geonames(spark, sf):
    counties = S.counties(S.parse_table(county_lines(spark, sf), "\t", S.COUNTY_CODES), "US.CA.")
    out = S.geonames(S.parse_table(geoname_lines(spark, sf), "\t", S.GEONAMES), counties, "CA")
    return out.drop("fcode")


@query("parsed_cities", "S8", "SELECT c_name AS name, CAST(20 + c_custkey % 40 AS DOUBLE) AS lat, CAST(-150 + c_custkey % 90 AS DOUBLE) AS lon, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey * 7 END AS population, CASE WHEN c_custkey % 9 = 0 THEN 'MX' ELSE 'US' END AS country FROM customer WHERE 20 + c_custkey % 40 BETWEEN 30 AND 45 AND -150 + c_custkey % 90 BETWEEN -128 AND -111")
def parsed_cities(spark, sf):
    return S.cities(S.parse_table(geoname_lines(spark, sf), "\t", S.GEONAMES), (33.0, 42.0), (-125.0, -114.0))


@query("parsed_network", "S17", f"SELECT 'K' || s_suppkey AS id, s_name AS name, CAST(30 + s_suppkey % 17 AS DOUBLE) AS lat, {R('-120.5 + s_suppkey % 9')} AS lon, s_acctbal AS elevation_m, 'R' || s_nationkey AS region, 'America/Los_Angeles' AS timezone FROM supplier")
def parsed_network(spark, sf):
    """The station list as YAML documents, names quoted."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    block = F.concat(
        F.lit("- elevation_m: "), F.col("s_acctbal").cast("string"), F.lit("\n  id: K"), k.cast("string"), F.lit("\n  lat: "), (30 + k % 17).cast("string"), F.lit("\n  lon: "), (-120.5 + k % 9).cast("string"),
        F.lit("\n  name: '"), F.col("s_name"), F.lit("'\n  region: R"), F.col("s_nationkey").cast("string"), F.lit("\n  timezone: America/Los_Angeles\n"),
    )
    head = F.lit("# made by the selection\nquotas:\n  R1: 3\nstations:\n")
    docs = s.groupBy("s_nationkey", F.floor(k / 1000).alias("part")).agg(F.concat(head, F.array_join(F.collect_list(block), "")).alias("value"))
    return S.parse_network(docs).withColumn("lon", r6("lon"))


@query("parsed_showers", "S17", f"SELECT 'C' || p_partkey AS code, p_name AS name, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey % 8000 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS peak, p_retailprice AS ra, CASE WHEN p_size > 5 THEN CAST(p_size AS DOUBLE) END AS zhr FROM part")
def parsed_showers(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    row = F.struct(F.concat(F.lit("C"), k.cast("string")).alias("code"), F.col("p_name").alias("name"), F.date_format(F.timestamp_micros((F.unix_date(F.lit("2024-01-01").cast("date")).cast("long") * 24 + k % 8000) * 3600000000), "yyyy-MM-dd HH:mm:ss").alias("peak"), F.col("p_retailprice").alias("ra"), F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).alias("zhr"))
    return S.parse_showers(p.select(F.to_json(row).alias("value"))).select("code", "name", text("peak").alias("peak"), "ra", "zhr")


@query("parsed_log", "S17", with_(REP) + f"SELECT site, CAST(CAST(valid AS DATE) AS VARCHAR) AS issue_date, CAST(CAST(valid AS DATE) + CAST(k % 4 AS INTEGER) AS VARCHAR) AS night_date, CAST(1 + k % 4 AS INTEGER) AS lead, CASE WHEN k % 10 > 0 THEN {R('k / 100.0')} END AS p_usable FROM rep")
def parsed_log(spark, sf):
    k = F.col("k")
    day = F.to_date("valid")
    lines = reports(spark, sf).select(F.concat_ws(",", day.cast("string"), "site", F.date_add(day, (k % 4).cast("int")).cast("string"), (1 + k % 4).cast("string"), F.when(k % 10 > 0, (k / 100.0).cast("string")).otherwise("")).alias("value"))
    out = S.parse_log(lines, ["issue_date", "site", "night_date", "lead", "p_usable"])
    return out.select("site", F.col("issue_date").cast("string").alias("issue_date"), F.col("night_date").cast("string").alias("night_date"), "lead", r6("p_usable").alias("p_usable"))


# ---------- satellite pixels and JSON out ----------


@query("satellite_boxes", "S16", f"""WITH px AS (SELECT CAST(l_orderkey % 10 AS INTEGER) AS scan, CAST(l_partkey % 40 AS INTEGER) AS row, CAST(l_suppkey % 40 AS INTEGER) AS col, CAST(l_linenumber % 3 AS INTEGER) AS bcm, CAST(l_quantity % 4 AS INTEGER) AS dqf FROM lineitem),
  st AS (SELECT s_name AS site, CAST(s_suppkey % 50 AS INTEGER) AS r, CAST(s_suppkey * 7 % 50 AS INTEGER) AS c FROM supplier),
  b AS (SELECT site, scan, avg(CASE WHEN dqf = 0 AND bcm < 2 THEN CAST(bcm AS DOUBLE) END) AS cover, sum(CASE WHEN dqf = 0 AND bcm < 2 THEN 1 ELSE 0 END) AS n_good FROM st JOIN px ON px.row BETWEEN r - 2 AND r + 2 AND px.col BETWEEN c - 2 AND c + 2 GROUP BY ALL)
  SELECT st.site, b.scan, {R('b.cover')} AS cover, CAST(coalesce(b.n_good, 0) AS BIGINT) AS n_good FROM st LEFT JOIN b USING (site)""")
def satellite_boxes(spark, sf):
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    k = lambda c, n, out: (F.col(c) % n).cast("int").alias(out)
    px = li.select(k("l_orderkey", 10, "scan"), k("l_partkey", 40, "row"), k("l_suppkey", 40, "col"), k("l_linenumber", 3, "bcm"), k("l_quantity", 4, "dqf"))
    st = s.select(F.col("s_name").alias("site"), k("s_suppkey", 50, "site_row"), (F.col("s_suppkey") * 7 % 50).cast("int").alias("site_col"))
    return S.satellite_boxes(px, st).select("site", "scan", r6("cover").alias("cover"), big("n_good").alias("n_good"))


@query("json_without_nan", "S13", with_(REP) + f"SELECT event_id, CASE WHEN k % 5 > 1 THEN {R('value')} END AS value, source FROM rep")
def json_without_nan(spark, sf):
    """Metrics as JSON text, not-a-number and infinite ones as null, read back."""
    k = F.col("k")
    odd = F.when(k % 5 == 0, float("nan")).when(k % 5 == 1, float("inf")).otherwise(F.col("value"))
    out = K.finite(reports(spark, sf).select("event_id", odd.alias("value"), "source"))
    js = out.select(F.to_json(F.struct("event_id", "value", "source"), {"ignoreNullFields": "false"}).alias("j")).filter("j not like '%NaN%' and j not like '%Infinity%' and j like '%\"value\":%'")
    return js.select(F.from_json("j", "event_id long, value double, source string").alias("r")).select("r.event_id", r6("r.value").alias("value"), "r.source")


# ---------- streams as batches ----------


RUN_SQL = """cl AS (SELECT *, hour - to_hours(CAST(row_number() OVER (PARTITION BY site, source ORDER BY hour) AS INTEGER)) AS island FROM ser WHERE cover <= 0.2 + 1e-9)"""


@query("clear_run_sessions", "T4", with_(*BASE, RUN_SQL) + """SELECT site, source, strftime(min(hour), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(hour), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS length FROM cl GROUP BY site, source, island""")
def clear_run_sessions(spark, sf):
    """The streaming operator on a batch: session windows over clear hours."""
    runs = J.clear_runs(series(spark, sf), ["site", "source"], "hour", "cover")
    return runs.select("site", "source", text("start").alias("start"), text("end").alias("end"), "length")




CHUNK = """ck AS (SELECT site, source, hour, cover, CAST(hour AS DATE) AS day, CASE WHEN (hour(hour) + day(hour)) % 3 = 0 THEN 2 ELSE 1 END AS n FROM ser)"""


def _work_folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/nightfold-{name}-{uuid.uuid4().hex}"


@query("ingested_events", "T7 S15", "SELECT event_id, event_type, value FROM events")
def ingested_events(spark, sf):
    """The events as a file stream, taken twice with one checkpoint: every file counts once. (A pattern, since the table may be a
    single file.)"""
    events = table(spark, sf, "events")
    out, mark = _work_folder(spark, "ingest"), _work_folder(spark, "mark")
    for _ in range(2):
        J.ingest(spark, f"{sf}/events.parque[t]", events.schema, out, mark).awaitTermination()
    return J.read_batches(spark, out, events.schema).select("event_id", "event_type", "value")


@query("late_chunks", "T5 S4", with_(*BASE, CHUNK) + f"SELECT site, source, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, {R('CASE WHEN n = 2 THEN cover / 2 ELSE cover END')} AS cover FROM ck")
def late_chunks(spark, sf):
    """A chunk with the later end comes first, one with an earlier end later, then the log is folded: the later end counts."""
    s = series(spark, sf).withColumn("day", F.to_date("hour"))
    again = (F.hour("hour") + F.dayofmonth("hour")) % 3 == 0
    chunk = lambda rows, end: rows.select("day", "site", "source", "hour", "cover", F.lit(end).alias("chunk_end"))
    early, late = chunk(s, "0915"), chunk(s.filter(again).withColumn("cover", F.col("cover") / 2), "0922")
    log = DayLog(_work_folder(spark, "chunks"), early.schema, "day", ("day", "site", "source", "hour"), ("chunk_end",), later=True)
    log.append(late, 0)
    log.append(early, 1)
    log.fold(spark, 1)
    return log.current(spark).select("site", "source", text("hour").alias("hour"), r6("cover").alias("cover"))


@query("first_forecasts_filed", "T1 S15", with_(REP) + f"SELECT site, CAST(CAST(valid AS DATE) AS VARCHAR) AS day, {R('arg_min(value, event_id)')} AS value FROM rep GROUP BY site, CAST(valid AS DATE)")
def first_forecasts_filed(spark, sf):
    """Reports in three batches by number, filed by day, folded after the second: the first of each site and day counts."""
    r = reports(spark, sf).select(F.to_date("valid").alias("day"), "site", "event_id", "value")
    top = F.broadcast(r.agg(F.max("event_id").alias("top")))  # one row
    parts = r.join(top).withColumn("n", F.floor(F.col("event_id") * 3 / (F.col("top") + 1)) + 1).drop("top")
    log = DayLog(_work_folder(spark, "log"), r.schema, "day", ("day", "site"), ("event_id",))
    for n in (1, 2, 3):
        log.append(parts.filter(F.col("n") == n).drop("n"), n)
        if n == 2:
            log.fold(spark, 2)
    return log.current(spark).select("site", F.col("day").cast("string").alias("day"), r6("value").alias("value"))


@query("settled_chunks", "T6", with_(*BASE) + """, d AS (SELECT site, source, CAST(hour AS DATE) AS day, count(cover) AS n FROM ser GROUP BY ALL) SELECT site, source, CAST(day AS VARCHAR) AS chunk_end, n > 0 OR day < DATE '2024-01-16' AS settled FROM d""")
def settled_chunks(spark, sf):
    """Which chunks count on 15 February: those whose last day has a value, or that ended over 30 days before."""
    d = series(spark, sf).groupBy("site", "source", F.to_date("hour").alias("day")).agg(F.count("cover").alias("n"))
    return d.select("site", "source", F.col("day").cast("string").alias("chunk_end"), J.settled(F.col("day"), F.col("n"), F.lit("2024-02-15").cast("date")).alias("settled"))
