"""Queries over the spatial operators: places, stations, light grids and city glow."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightfold.functions import geofn as G
from nightfold.operators import glow as L, merge as M, spatial as P
from nightfold.plans.derived import R, big, r6, table, with_
from nightfold.plans.registry import query

# ---------- derived places, sites, cells, lights ----------


def _latlon(key: str, lat_mul: int = 7919, lon_mul: int = 104729):
    k = F.col(key)
    return (32.0 + (k * lat_mul % 17000) / 1000.0).alias("lat"), (-125.0 + (k * lon_mul % 11000) / 1000.0).alias("lon")


def _latlon_sql(key: str, lat_mul: int = 7919, lon_mul: int = 104729) -> str:
    return f"32.0::DOUBLE + ({key} * {lat_mul} % 17000) / 1000.0::DOUBLE AS lat, -125.0::DOUBLE + ({key} * {lon_mul} % 11000) / 1000.0::DOUBLE AS lon"


def places(spark, sf):
    c = table(spark, sf, "customer")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("BUILDING", "city", "AUTOMOBILE", "town", "MACHINERY", "community", "HOUSEHOLD", "neighbourhood", "FURNITURE", "zip")]), F.col("c_mktsegment"))
    k = F.col("c_custkey")
    return c.select(
        k.alias("place_id"), F.concat(F.lit("Villa Ñuñoa "), (k % 97).cast("string"), F.when(k % 3 == 0, " city").otherwise(" CDP")).alias("census_name"),
        F.concat(F.lit("Villa Ñuñoa "), (k % 97).cast("string")).alias("name"), F.coalesce(kind, F.lit("community")).alias("kind"),
        F.col("c_nationkey").alias("county"), *_latlon("c_custkey"), F.floor(F.abs("c_acctbal") * 10).alias("population"),
        (1 + k % 50).cast("double").alias("land_km2"), (k * 31 % 3000).cast("double").alias("elevation_m"),
    )


PLACES = f"""pl AS (SELECT c_custkey AS place_id, 'Villa Ñuñoa ' || (c_custkey % 97) || CASE WHEN c_custkey % 3 = 0 THEN ' city' ELSE ' CDP' END AS census_name, 'Villa Ñuñoa ' || (c_custkey % 97) AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'city' WHEN 'AUTOMOBILE' THEN 'town' WHEN 'MACHINERY' THEN 'community' WHEN 'HOUSEHOLD' THEN 'neighbourhood' WHEN 'FURNITURE' THEN 'zip' ELSE 'community' END AS kind,
  c_nationkey AS county, {_latlon_sql('c_custkey')}, CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS population, CAST(1 + c_custkey % 50 AS DOUBLE) AS land_km2, CAST(c_custkey * 31 % 3000 AS DOUBLE) AS elevation_m FROM customer)"""


def towns(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("town_id"), F.concat(F.lit("Villa Ñuñoa "), (k % 97).cast("string")).alias("name"), F.col("s_nationkey").alias("county"), *_latlon("s_suppkey", 7907, 104723), F.abs("s_acctbal").alias("emission"), (k % 3 == 0).alias("hidden"))


TOWNS = f"tw AS (SELECT s_suppkey AS town_id, 'Villa Ñuñoa ' || (s_suppkey % 97) AS name, s_nationkey AS county, {_latlon_sql('s_suppkey', 7907, 104723)}, abs(s_acctbal) AS emission FROM supplier)"


def sites(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(F.col("n_name").alias("site"), (33.0 + k * 0.61).alias("lat"), (-124.5 + k * 0.41).alias("lon"), F.col("n_regionkey").alias("region"))


SITES = "si AS (SELECT n_name AS site, 33.0::DOUBLE + n_nationkey * 0.61::DOUBLE AS lat, -124.5::DOUBLE + n_nationkey * 0.41::DOUBLE AS lon, n_regionkey AS region FROM nation)"
NORTH, WEST, STEP, ROWS, COLS = 40.0, -122.0, 0.02, 397, 401


def cells(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select((k * 7919 % ROWS).alias("row"), (k * 104729 % COLS).alias("col"), (F.col("p_size") * F.col("p_size") * 1.5).alias("v"), "p_retailprice")
    g = p.groupBy("row", "col").agg(F.max("v").alias("ucd"), F.sum("p_retailprice").alias("radiance"))
    return L.cell_points(g, NORTH, WEST, STEP)


CELLS = f"ce AS (SELECT p_partkey * 7919 % {ROWS} AS row, p_partkey * 104729 % {COLS} AS col, max(p_size * p_size * 1.5::DOUBLE) AS ucd, sum(p_retailprice) AS radiance, {NORTH}::DOUBLE - (p_partkey * 7919 % {ROWS} + 0.5::DOUBLE) * {STEP}::DOUBLE AS lat, {WEST}::DOUBLE + (p_partkey * 104729 % {COLS} + 0.5::DOUBLE) * {STEP}::DOUBLE AS lon FROM part GROUP BY 1, 2, 5, 6)"


def hav(a, b, c, d):
    return f"2 * 6371.0::DOUBLE * asin(sqrt(greatest(0.0::DOUBLE, least(1.0::DOUBLE, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"


def brg(a, b, c, d):
    x = f"sin(radians({d} - {b})) * cos(radians({c}))"
    y = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))"
    return f"((degrees(atan2({x}, {y})) + 360) % 360.0)"


def sector(b, n):
    return f"CAST(floor(({b} + {360 / n / 2}) / {360 / n}) AS INTEGER) % {n}"


def comp(b, names):
    return "[" + ", ".join(f"'{x}'" for x in names) + f"][{sector(b, len(names))} + 1]"


SQM = "22.0 - 2.5 * log10((greatest({0}, 0.0) + 174.0) / 174.0)"
BORT = "CASE " + " ".join(f"WHEN {{0}} >= {lo} THEN {n}::DOUBLE" for lo, _, n, _ in G.BORTLE) + " ELSE 8.5::DOUBLE END"
BCLS = "CASE " + " ".join(f"WHEN {{0}} >= {lo} THEN '{c}'" for lo, c, _, _ in G.BORTLE) + f" ELSE '{G.BORTLE_LAST[0]}' END"


def count_le(bounds, x):
    return "len(list_filter([" + ", ".join(f"{b}::DOUBLE" for b in bounds) + f"], lambda e: e <= {x}))"


# ---------- geometry ----------


@query("distance_and_bearing", "F9 F10", with_(PLACES, SITES) + f""", j AS (SELECT p.place_id, p.lat, p.lon, s.lat AS lat2, s.lon AS lon2, p.elevation_m AS e FROM pl p JOIN (SELECT *, row_number() OVER (ORDER BY lat) - 1 AS k FROM si) s ON s.k = p.county)
  SELECT place_id, {R(hav('lat', 'lon', 'lat2', 'lon2'))} AS km, {R(brg('lat', 'lon', 'lat2', 'lon2'))} AS bearing, {comp(brg('lat', 'lon', 'lat2', 'lon2'), G.COMPASS8)} AS point8, {comp(brg('lat', 'lon', 'lat2', 'lon2'), G.COMPASS16)} AS point16,
  {R(f"sqrt(pow({hav('lat', 'lon', 'lat2', 'lon2')}, 2) + pow((e - 100.0) * 0.1, 2))")} AS design_km FROM j""")
def distance_and_bearing(spark, sf):
    s = table(spark, sf, "nation").select(F.col("n_nationkey").alias("county"), (33.0 + F.col("n_nationkey") * 0.61).alias("lat2"), (-124.5 + F.col("n_nationkey") * 0.41).alias("lon2"))
    j = places(spark, sf).join(s, "county")
    b = G.bearing_deg("lat", "lon", "lat2", "lon2")
    return j.select("place_id", r6(G.haversine_km("lat", "lon", "lat2", "lon2")).alias("km"), r6(b).alias("bearing"), G.compass(b, G.COMPASS8).alias("point8"), G.compass(b).alias("point16"),
                    r6(G.design_distance_km("lat", "lon", "elevation_m", "lat2", "lon2", 100.0, 0.1)).alias("design_km"))


LA_K = "sqrt(2 / (1 + sin(radians(40.5)) * sin(radians(lat)) + cos(radians(40.5)) * cos(radians(lat)) * cos(radians(lon + 119.5))))"
LA_X = f"6371.0 * {LA_K} * cos(radians(lat)) * sin(radians(lon + 119.5))"
LA_Y = f"6371.0 * {LA_K} * (cos(radians(40.5)) * sin(radians(lat)) - sin(radians(40.5)) * cos(radians(lat)) * cos(radians(lon + 119.5)))"


@query("equal_area_projection", "F11", with_(PLACES) + f"SELECT place_id, {R(LA_X, 4)} AS x, {R(LA_Y, 4)} AS y FROM pl")
def equal_area_projection(spark, sf):
    x, y = G.laea(F.col("lat"), F.col("lon"), 40.5, -119.5)
    return places(spark, sf).select("place_id", r6(x, 4).alias("x"), r6(y, 4).alias("y"))


_EQ, _PO, _HT, _L0 = 6378137.0, 6356752.31414, 35786023.0, -137.0
_F, _H = (_PO / _EQ) ** 2, _EQ + _HT
_E2 = (_EQ**2 - _PO**2) / _EQ**2


@query("satellite_scan_angles", "F12", with_(PLACES, f"""a AS (SELECT place_id, atan({_F} * tan(radians(lat))) AS lc, radians(lon * 3) - radians({_L0}) AS dl FROM pl),
b AS (SELECT *, {_PO} / sqrt(1 - {_E2} * pow(cos(lc), 2)) AS rc FROM a), c AS (SELECT place_id, {_H} - rc * cos(lc) * cos(dl) AS sx, -rc * cos(lc) * sin(dl) AS sy, rc * sin(lc) AS sz FROM b)""")
       + f"SELECT place_id, CASE WHEN {_H} * ({_H} - sx) >= sy * sy + sz * sz / {_F} THEN {R('asin(-sy / sqrt(sx * sx + sy * sy + sz * sz))')} END AS x, CASE WHEN {_H} * ({_H} - sx) >= sy * sy + sz * sz / {_F} THEN {R('atan(sz / sx)')} END AS y FROM c")
def satellite_scan_angles(spark, sf):
    # Longitudes are stretched around the globe, so that many places lie behind the horizon.
    x, y = G.scan_angles(F.col("lat"), F.col("lon") * 3, _EQ, _PO, _HT, _L0)
    return places(spark, sf).select("place_id", r6(x).alias("x"), r6(y).alias("y"))


@query("sky_brightness_scales", "F13 P26 A36", with_(CELLS) + f"SELECT row, col, {R(SQM.format('ucd'))} AS sqm, {R('ucd / 174.0')} AS ratio, CAST({count_le(G.LEVEL_BOUNDS, 'ucd / 174.0')} AS BIGINT) AS level, {BCLS.format('(' + SQM.format('ucd') + ')')} AS bortle, {BORT.format('(' + SQM.format('ucd') + ')')} AS bortle_number FROM ce")
def sky_brightness_scales(spark, sf):
    c = L.point_report(cells(spark, sf).withColumn("ucd", G.mcd_to_ucd(F.col("ucd") / 1000.0)))
    return c.select("row", "col", r6("sqm").alias("sqm"), r6("ratio").alias("ratio"), big("level").alias("level"), "bortle", G.bortle_number(F.col("sqm")).alias("bortle_number"))


MIDS = [G.ZONE_BOUNDS[1] / 2] + [(G.ZONE_BOUNDS[i] * G.ZONE_BOUNDS[i + 1]) ** 0.5 for i in range(1, 14)] + [G.ZONE_BOUNDS[14] * 2]
ZON = "CAST(" + count_le(G.ZONE_BOUNDS[1:], "ucd / 174.0") + " AS INTEGER)"
MIDL = "[" + ", ".join(f"{m!r}::DOUBLE" for m in MIDS) + "]"


@query("zone_of_ratio", "F14", with_(CELLS) + f"SELECT row, col, {ZON} AS zone, {R(f'{MIDL}[{ZON} + 1]')} AS center, {R('2.5 * log10((ucd + 174.0) / (ucd * 1.1 + 174.0))')} AS error_mag FROM ce")
def zone_of_ratio(spark, sf):
    z = G.zone_of_ratio(F.col("ucd") / 174.0)
    return cells(spark, sf).select("row", "col", z.alias("zone"), r6(G.zone_center_ratio(z)).alias("center"), r6(G.mag_error(F.col("ucd") * 1.1, F.col("ucd"))).alias("error_mag"))


# ---------- gazetteer ----------

SLUG = "trim(regexp_replace(lower(replace(replace({0}, 'Ñ', 'N'), 'ñ', 'n')), '[^a-z0-9]+', '-', 'g'), '-')"


@query("place_names", "F8 F26", with_(PLACES) + f"""SELECT place_id, {SLUG.format('census_name')} AS slug, regexp_replace(census_name, ' (city|town|CDP)$', '') AS short,
  CASE WHEN kind = 'zip' THEN name || ' · ZIP code near ' || name ELSE name || ' · ' || county || ' County' END AS label FROM pl""")
def place_names(spark, sf):
    n = F.col("name")
    return places(spark, sf).select("place_id", G.slug(F.col("census_name")).alias("slug"), G.short_name(F.col("census_name")).alias("short"), G.place_label(n, F.col("kind"), F.col("county").cast("string"), n).alias("label"))


@query("unique_place_ids", "W11", with_(PLACES) + f""", s AS (SELECT place_id, {SLUG.format('name')} AS s, {SLUG.format('CAST(county AS VARCHAR)')} AS c FROM pl), b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY s) = 1 THEN s ELSE s || '-' || c END AS i FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY place_id) AS r FROM b) SELECT place_id, CASE WHEN r = 1 THEN i ELSE i || '-' || r END AS id FROM r""")
def unique_place_ids(spark, sf):
    p = places(spark, sf).withColumn("county", F.col("county").cast("string"))
    return P.unique_ids(p, "place_id").select("place_id", "id")


@query("town_centres", "J10", with_(PLACES, TOWNS) + f""", m AS (SELECT place_id, land_km2, arg_min(town_id, (km, town_id)) AS town_id, min(km) AS km FROM (SELECT p.place_id, p.land_km2, t.town_id, {hav('p.lat', 'p.lon', 't.lat', 't.lon')} AS km FROM pl p JOIN tw t ON t.name = p.name AND t.county = p.county) GROUP BY ALL),
  g AS (SELECT * FROM m WHERE km <= greatest(60 * sqrt(greatest(land_km2, 0.01) / pi()), 3.0))
  SELECT p.place_id, g.town_id, {R('g.km')} AS km, {R('coalesce(t.lat, p.lat)')} AS lat, {R('coalesce(t.lon, p.lon)')} AS lon, CASE WHEN g.town_id IS NULL THEN 'own-record' ELSE 'populated-place' END AS point FROM pl p LEFT JOIN g ON g.place_id = p.place_id LEFT JOIN tw t ON t.town_id = g.town_id""")
def town_centres(spark, sf):
    c = P.town_centres(places(spark, sf), towns(spark, sf), max_radii=60.0)
    return c.select("place_id", "town_id", r6("km").alias("km"), r6("lat").alias("lat"), r6("lon").alias("lon"), "point")


@query("not_near_same_name", "J11", with_(PLACES, TOWNS) + f"SELECT town_id FROM tw t WHERE NOT EXISTS (SELECT 1 FROM pl p WHERE p.name = t.name AND {hav('t.lat', 't.lon', 'p.lat', 'p.lon')} < 200.0)")
def not_near_same_name(spark, sf):
    return P.not_near(towns(spark, sf), places(spark, sf), "name", 200.0).select("town_id")


@query("plausible_place", "J12", with_(PLACES, TOWNS) + f""", s AS (SELECT t.town_id, p.place_id, p.kind IN ('city', 'town') AS inc, {hav('t.lat', 't.lon', 'p.lat', 'p.lon')} / sqrt(greatest(p.land_km2, 1.0) / pi()) AS score FROM tw t, pl p)
  SELECT town_id, coalesce(arg_min(CASE WHEN inc AND score <= 2.0 THEN place_id END, CASE WHEN inc AND score <= 2.0 THEN score END), arg_min(place_id, score)) AS place_id FROM s GROUP BY town_id""")
def plausible_place(spark, sf):
    return P.nearest_scaled(towns(spark, sf), places(spark, sf), "town_id").select("town_id", "place_id")


@query("nearest_named_place", "J13 P24", with_(PLACES, TOWNS) + f""", m AS (SELECT t.town_id, arg_min(p.place_id, {hav('t.lat', 't.lon', 'p.lat', 'p.lon')}) AS place_id, min({hav('t.lat', 't.lon', 'p.lat', 'p.lon')}) AS km FROM tw t, pl p WHERE p.kind <> 'zip' GROUP BY 1)
  SELECT town_id, m.place_id, {R('km')} AS km, CASE WHEN km < 1.0 THEN name ELSE 'Near ' || name END AS description FROM m JOIN pl USING (place_id)""")
def nearest_named_place(spark, sf):
    named = places(spark, sf).filter("kind <> 'zip'").select("place_id", F.col("name").alias("pname"), "lat", "lon")
    n = P.nearest(towns(spark, sf), named, "place_id", payload=["pname"])
    return n.select("town_id", "place_id", r6("km").alias("km"), P.describe(n, "pname").alias("description"))


@query("three_nearest_stations", "J16", with_(PLACES, SITES) + f"""SELECT place_id, CAST(r AS BIGINT) AS rank, site, {R('km')} AS km FROM (SELECT place_id, site, km, row_number() OVER (PARTITION BY place_id ORDER BY km, site) AS r FROM (SELECT p.place_id, s.site, {hav('p.lat', 'p.lon', 's.lat', 's.lon')} AS km FROM pl p, si s)) WHERE r <= 3""")
def three_nearest_stations(spark, sf):
    n = P.nearest(places(spark, sf).select("place_id", "lat", "lon"), sites(spark, sf), "site", k=3)
    return n.select("place_id", big("rank").alias("rank"), "site", r6("km").alias("km"))


@query("map_click_grid", "J14", with_(PLACES, f"""g AS (SELECT 32.0::DOUBLE + 0.5::DOUBLE / 2 + floor(id / 22) * 0.5::DOUBLE AS lat, -125.0::DOUBLE + 0.5::DOUBLE / 2 + (id % 22) * 0.5::DOUBLE AS lon FROM (SELECT unnest(range(22 * 34)) AS id)),
m AS (SELECT lat, lon, arg_min(place_id, km) AS place_id, min(km) AS km FROM (SELECT g.lat, g.lon, p.place_id, {hav('g.lat', 'g.lon', 'p.lat', 'p.lon')} AS km FROM g, pl p WHERE p.kind <> 'zip') GROUP BY ALL)""") + f"SELECT {R('lat')} AS lat, {R('lon')} AS lon, place_id, {R('km')} AS km FROM m WHERE km <= 30.0")
def map_click_grid(spark, sf):
    named = places(spark, sf).filter("kind <> 'zip'")
    n = P.nearest(P.grid_points(spark, (-125.0, 32.0, -114.0, 49.0), 0.5), named, "place_id").filter("km <= 30.0")
    return n.select(r6("lat").alias("lat"), r6("lon").alias("lon"), "place_id", r6("km").alias("km"))


@query("nearest_darker_site", "J23", with_(SITES) + f""", q AS (SELECT *, 17.5 + 0.25 * (row_number() OVER (ORDER BY lat) - 1) AS sqm FROM si)
  SELECT a.site, arg_min(b.site, ({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, b.site)) AS place, {R(f"min({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')})")} AS km FROM q a JOIN q b ON b.site <> a.site AND b.sqm >= 20.3 GROUP BY a.site""")
def nearest_darker_site(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("site"), (33.0 + F.col("n_nationkey") * 0.61).alias("lat"), (-124.5 + F.col("n_nationkey") * 0.41).alias("lon"), (17.5 + 0.25 * F.col("n_nationkey")).alias("sqm"))
    return P.nearest_darker(n.drop("sqm"), n, 20.3).select("site", "place", r6("km").alias("km"))


@query("search_ranking", "O6 P24", with_(PLACES) + "SELECT county, place_id, row_number() OVER (PARTITION BY county ORDER BY kind = 'zip', population DESC, name, place_id) AS place FROM pl")
def search_ranking(spark, sf):
    from pyspark.sql import Window as W

    p = places(spark, sf)
    rank = F.row_number().over(W.partitionBy("county").orderBy(*P.search_order(p), "place_id"))
    return p.select("county", "place_id", big(rank).alias("place"))


@query("bounds_check", "P22", with_(PLACES) + "SELECT lat BETWEEN 34.0 AND 42.0 AND lon BETWEEN -124.0 AND -115.0 AS inside, count(*) AS n, count(CASE WHEN elevation_m > 0 THEN elevation_m END) AS known_elevation FROM pl GROUP BY 1")
def bounds_check(spark, sf):
    inside = G.inside_bounds(F.col("lat"), F.col("lon"), (34.0, 42.0), (-124.0, -115.0))
    known = F.when(F.col("elevation_m") > 0, F.col("elevation_m"))
    return places(spark, sf).groupBy(inside.alias("inside")).agg(F.count("*").alias("n"), F.count(known).alias("known_elevation"))


@query("place_union", "U6 U1", with_(PLACES, TOWNS) + "SELECT place_id AS id, name, kind, population FROM pl UNION ALL SELECT town_id, name, NULL, NULL FROM tw")
def place_union(spark, sf):
    a = places(spark, sf).select(F.col("place_id").alias("id"), "name", "kind", "population")
    return M.union_loose(a, towns(spark, sf).select(F.col("town_id").alias("id"), "name"))


# ---------- station network ----------

STA = "st AS (SELECT place_id AS id, 'R' || (county % 5) AS region, lat, lon, elevation_m, kind <> 'zip' AS online, DATE '2000-01-01' + CAST(place_id % 9000 AS INTEGER) AS archive_begin FROM pl)"


def stations(spark, sf):
    return places(spark, sf).select(
        F.col("place_id").alias("id"), F.concat(F.lit("R"), (F.col("county") % 5).cast("string")).alias("region"), "lat", "lon", "elevation_m",
        (F.col("kind") != "zip").alias("online"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("place_id") % 9000).cast("int")).alias("archive_begin"),
    )


@query("station_candidates", "P13", with_(PLACES, STA) + "SELECT id, region FROM st WHERE online AND id NOT IN (3, 5, 8) AND archive_begin <= DATE '2002-01-01'")
def station_candidates(spark, sf):
    return P.candidates(stations(spark, sf), [3, 5, 8], "2002-01-01").select("id", "region")


@query("region_quotas", "A15", with_(PLACES, STA) + "SELECT region, count(*) AS online, greatest(2, CAST(floor(count(*) / 60 + 0.5) AS BIGINT)) AS quota FROM st WHERE online GROUP BY region")
def region_quotas(spark, sf):
    return P.quotas(stations(spark, sf), 60, 2)


def _picks(count=15, per_region=3):
    """The greedy walk written out: one CTE a pick, farthest from all earlier ones among regions that are still open."""
    far = f"sqrt(pow({hav('s.lat', 's.lon', 'k.lat', 'k.lon')}, 2) + pow((s.elevation_m - k.elevation_m) * 0.1, 2))"
    ctes = ["so AS (SELECT id, region, lat, lon, elevation_m FROM st WHERE online)", "ct AS (SELECT avg(lat) AS lat, avg(lon) AS lon FROM so)",
            f"p0 AS (SELECT 0 AS pick, s.* FROM so s, ct k ORDER BY round({hav('s.lat', 's.lon', 'k.lat', 'k.lon')}, 6), s.id LIMIT 1)"]
    for i in range(1, count):
        ctes.append(f"k{i} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM p{j}' for j in range(i))})")
        ctes.append(f"""p{i} AS MATERIALIZED (SELECT {i} AS pick, s.id, s.region, s.lat, s.lon, s.elevation_m FROM so s, k{i} k
  WHERE s.id NOT IN (SELECT id FROM k{i}) AND s.region NOT IN (SELECT region FROM k{i} GROUP BY region HAVING count(*) >= {per_region}) GROUP BY ALL ORDER BY round(min({far}), 6) DESC, s.id LIMIT 1)""")
    return [*ctes, f"pk AS ({' UNION ALL '.join(f'SELECT * FROM p{j}' for j in range(count))})"]


@query("spread_out_selection", "O5", with_(PLACES, STA, *_picks()) + "SELECT pick, id, region FROM pk")
def spread_out_selection(spark, sf):
    st = stations(spark, sf)
    quota = {f"R{i}": 3 for i in range(5)}
    picks = P.farthest_points(st.filter("online"), [], quota, 0.1)
    rows = [(i, int(p["id"]), p["region"]) for i, p in enumerate(picks)]
    return spark.createDataFrame(rows, "pick int, id long, region string")


# ---------- light grids ----------


@query("cells_around_sites", "J15", with_(SITES, CELLS) + f"SELECT site, count(*) AS n, {R(f'max(km)')} AS far, {R('min(km)')} AS near FROM (SELECT s.site, {hav('s.lat', 's.lon', 'c.lat', 'c.lon')} AS km FROM si s, ce c) WHERE km <= 50.0 GROUP BY site")
def cells_around_sites(spark, sf):
    a = L.around(sites(spark, sf), cells(spark, sf), 50.0)
    return a.groupBy("site").agg(F.count("*").alias("n"), r6(F.max("km")).alias("far"), r6(F.min("km")).alias("near"))


NEAR = f"nr AS (SELECT s.site, s.lat, s.lon, c.lat AS lat2, c.lon AS lon2, c.ucd, {SQM.format('c.ucd')} AS sqm, {hav('s.lat', 's.lon', 'c.lat', 'c.lon')} AS km FROM si s, ce c)"


@query("darkest_nearby", "O1", with_(SITES, CELLS, NEAR) + f"""SELECT site, {R('min(km)')} AS km, {R('arg_min(sqm, km)')} AS sqm, {comp(brg('any_value(lat)', 'any_value(lon)', 'arg_min(lat2, km)', 'arg_min(lon2, km)'), G.COMPASS8)} AS direction
  FROM (SELECT *, max(sqm) OVER (PARTITION BY site) AS best FROM nr WHERE km <= 100.0) WHERE sqm >= best - 0.15 GROUP BY site""")
def darkest_nearby(spark, sf):
    d = L.darkest_within(L.around(sites(spark, sf), cells(spark, sf), 100.0), ["site"])
    return d.select("site", r6("km").alias("km"), r6("sqm").alias("sqm"), "direction")


@query("nearest_dark_spot", "O2", with_(SITES, CELLS, NEAR) + f"SELECT site, {R('min(km)')} AS km FROM nr WHERE km <= 200.0 AND {BORT.format('sqm')} <= 3 GROUP BY site")
def nearest_dark_spot(spark, sf):
    return L.nearest_dark(L.around(sites(spark, sf), cells(spark, sf), 200.0), ["site"]).select("site", r6("km").alias("km"))


def _band(c):
    return R(f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)")


@query("darkness_area_shares", "A22", with_(SITES, CELLS, NEAR) + f", b AS (SELECT site, {BORT.format('sqm')} AS b FROM nr WHERE km <= 50.0) SELECT site, {_band('b <= 3')} AS band_1_3, {_band('b > 3 AND b <= 4.5')} AS band_4_45, {_band('b > 4.5 AND b <= 6')} AS band_5_6, {_band('b > 6')} AS band_7_9 FROM b GROUP BY site")
def darkness_area_shares(spark, sf):
    s = L.area_shares(L.around(sites(spark, sf), cells(spark, sf), 50.0), ["site"])
    return s.select("site", *[r6(c).alias(c) for c in s.columns if c != "site"])


@query("site_light_report", "A36", with_(SITES, CELLS, NEAR) + f""", h AS (SELECT n_name AS site, 50.0::DOUBLE + n_nationkey * 90 AS ucd, 40.0::DOUBLE + n_nationkey * 100 AS base FROM nation),
  {', '.join(f"d{r} AS (SELECT site, min(km) AS km, arg_min(sqm, km) AS sqm FROM (SELECT *, max(sqm) OVER (PARTITION BY site) AS best FROM nr WHERE km <= {r}.0) WHERE sqm >= best - 0.15 GROUP BY site)" for r in (25, 50, 100))},
  nd AS (SELECT site, min(km) AS km FROM nr WHERE km <= 200.0 AND {BORT.format('sqm')} <= 3 GROUP BY site)
  SELECT h.site, {R(SQM.format('ucd'))} AS sqm, {R('(' + SQM.format('ucd') + ') - (' + SQM.format('base') + ')')} AS delta_mag, {R('(ucd + 1e-9) / (base + 1e-9)')} AS artificial_ratio, {', '.join(f"{R(f'd{r}.km')} AS darkest_km_{r}" for r in (25, 50, 100))}, {R('nd.km')} AS nearest_dark_km
  FROM h LEFT JOIN d25 ON d25.site = h.site LEFT JOIN d50 ON d50.site = h.site LEFT JOIN d100 ON d100.site = h.site LEFT JOIN nd ON nd.site = h.site""")
def site_light_report(spark, sf):
    n = table(spark, sf, "nation")
    here = n.select(F.col("n_name").alias("site"), (50.0 + F.col("n_nationkey") * 90).alias("ucd"))
    base = n.select(F.col("n_name").alias("site"), (40.0 + F.col("n_nationkey") * 100).alias("ucd"))
    s = L.site_report(sites(spark, sf), here, base, cells(spark, sf))
    return s.select("site", *[r6(c).alias(c) for c in ("sqm", "delta_mag", "artificial_ratio", "darkest_km_25", "darkest_km_50", "darkest_km_100", "nearest_dark_km")])


@query("emission_blocks", "A19", with_(CELLS) + f"""SELECT CAST(floor(row / 2) AS BIGINT) AS row, CAST(floor(col / 2) AS BIGINT) AS col, {R(f"sum(radiance) / 4 * pow({STEP} * 2 * 111.195, 2) * cos(radians({NORTH} - (floor(row / 2) + 0.5) * {STEP} * 2))")} AS emission FROM ce WHERE row < 396 AND col < 400 GROUP BY floor(row / 2), floor(col / 2)""")
def emission_blocks(spark, sf):
    return L.emission(cells(spark, sf), NORTH, STEP, 2, ROWS, COLS).select("row", "col", r6("emission").alias("emission"))


KMG = f"kg AS (SELECT CAST(floor({LA_X.replace('40.5', '36.0').replace('119.5', '118.0')} / 2) AS BIGINT) AS gx, CAST(floor({LA_Y.replace('40.5', '36.0').replace('119.5', '118.0')} / 2) AS BIGINT) AS gy, sum(radiance) AS emission FROM ce GROUP BY ALL)"


def km_grid(spark, sf):
    return L.to_km_grid(cells(spark, sf).withColumnRenamed("radiance", "emission"), (36.0, -118.0), 2.0)


@query("km_grid", "A20", with_(CELLS, KMG) + f"SELECT gx, gy, {R('emission', 3)} AS emission FROM kg")
def km_grid_query(spark, sf):
    return km_grid(spark, sf).select("gx", "gy", r6("emission", 3).alias("emission"))


@query("coarse_sources", "A21", with_(CELLS) + f"SELECT CAST(floor(row / 4) AS BIGINT) AS row, CAST(floor(col / 4) AS BIGINT) AS col, {R('sum(radiance)', 3)} AS emission FROM ce GROUP BY 1, 2 HAVING sum(radiance) >= 950")
def coarse_sources(spark, sf):
    c = L.coarsen_sources(cells(spark, sf).withColumnRenamed("radiance", "emission"), 4, 950)
    return c.select("row", "col", r6("emission", 3).alias("emission"))


EDGES = [0.0, 3.0, 6.0, 12.0, 25.0, 50.0]
RINGS = f"ri AS (SELECT t.gx, t.gy, {', '.join(f'sum(CASE WHEN d >= {a} AND d < {b} THEN e ELSE 0 END) AS r{i}' for i, (a, b) in enumerate(zip(EDGES[:-1], EDGES[1:])))} FROM (SELECT a.gx, a.gy, b.emission AS e, sqrt(pow((a.gx - b.gx) * 2.0, 2) + pow((a.gy - b.gy) * 2.0, 2)) AS d FROM kg a, kg b) t GROUP BY ALL)"


@query("ring_sums", "M29", with_(CELLS, KMG, RINGS) + f"SELECT gx, gy, {', '.join(f'{R(f'r{i}', 3)} AS r{i}' for i in range(5))} FROM ri")
def ring_sums(spark, sf):
    return L.ring_features(km_grid(spark, sf), EDGES, 2.0).select("gx", "gy", *[r6(f"r{i}", 3).alias(f"r{i}") for i in range(5)])


DARK = RINGS.replace("ri AS", "rd AS").replace("a.gx, a.gy, b.emission", "a.gx + 3 AS gx, a.gy - 2 AS gy, b.emission").replace("(a.gx - b.gx)", "(a.gx + 3 - b.gx)").replace("(a.gy - b.gy)", "(a.gy - 2 - b.gy)")


@query("ring_sums_beside_lights", "M29", with_(CELLS, KMG, DARK) + f"SELECT gx, gy, {', '.join(f'{R(f'r{i}', 3)} AS r{i}' for i in range(5))} FROM rd")
def ring_sums_beside_lights(spark, sf):
    """Targets that are not sources: each lit cell's neighbour, most of them dark."""
    g = km_grid(spark, sf)
    beside = g.select((F.col("gx") + 3).alias("gx"), (F.col("gy") - 2).alias("gy"))
    return L.ring_features(g, EDGES, 2.0, beside).select("gx", "gy", *[r6(f"r{i}", 3).alias(f"r{i}") for i in range(5)])


def kernel_rows(spark, sf):
    """Ring sums with a brightness made from a known kernel plus a bounded ripple."""
    f = L.ring_features(km_grid(spark, sf), EDGES, 2.0)
    t = 0.02 * F.col("r0") + 0.005 * F.col("r1") + 0.001 * F.col("r2") + 0.0002 * F.col("r3")
    ripple = 1 + 0.05 * F.sin(F.col("gx") * 1.7 + F.col("gy") * 0.3)
    return f.withColumn("target", t * ripple).withColumn("lon", F.col("gx").cast("double"))


@query("light_kernel", "M28")
def light_kernel(spark, sf):
    rows = kernel_rows(spark, sf)
    w = L.fit_kernel(rows, [f"r{i}" for i in range(5)])
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "ring int, weight double")


@query("light_kernel_cv", "M28")
def light_kernel_cv(spark, sf):
    return L.error_summary(L.spatial_cv(kernel_rows(spark, sf), [f"r{i}" for i in range(5)]))


def _three_rings() -> tuple[str, ...]:
    """Non-negative least squares on three rings in SQL: each set of rings that may be lit is solved by determinants; the best
    solution without a negative weight is the answer. One system without each longitude band, and one of all (fold -1)."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    names = [*[f"a{i}{j}" for i, j in pairs], *[f"b{i}" for i in range(3)]]
    sums = [*[f"sum(r{i} * r{j} * w) AS a{i}{j}" for i, j in pairs], *[f"sum(r{i} * target * w) AS b{i}" for i in range(3)]]
    at = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    cands = ["SELECT fold, b0, b1, b2, 0.0 AS w0, 0.0 AS w1, 0.0 AS w2 FROM ne"]
    for i in range(3):
        cands.append("SELECT fold, b0, b1, b2, " + ", ".join(f"b{i} / a{i}{i}" if k == i else "0.0" for k in range(3)) + " FROM ne")
    for i, j in ((0, 1), (0, 2), (1, 2)):
        det = f"({at(i, i)} * {at(j, j)} - {at(i, j)} * {at(i, j)})"
        sol = {i: f"(b{i} * {at(j, j)} - {at(i, j)} * b{j}) / {det}", j: f"(b{j} * {at(i, i)} - {at(i, j)} * b{i}) / {det}"}
        cands.append("SELECT fold, b0, b1, b2, " + ", ".join(sol.get(k, "0.0") for k in range(3)) + " FROM ne")
    det3 = lambda c: f"({c[0][0]} * ({c[1][1]} * {c[2][2]} - {c[1][2]} * {c[2][1]}) - {c[0][1]} * ({c[1][0]} * {c[2][2]} - {c[1][2]} * {c[2][0]}) + {c[0][2]} * ({c[1][0]} * {c[2][1]} - {c[1][1]} * {c[2][0]}))"
    whole = [[at(i, j) for j in range(3)] for i in range(3)]
    swapped = lambda k: [[f"b{i}" if j == k else at(i, j) for j in range(3)] for i in range(3)]
    cands.append("SELECT fold, b0, b1, b2, " + ", ".join(f"{det3(swapped(k))} / {det3(whole)}" for k in range(3)) + " FROM ne")
    return (
        "kr AS (SELECT *, (0.02 * r0 + 0.005 * r1 + 0.001 * r2 + 0.0002 * r3) * (1 + 0.05 * sin(gx * 1.7 + gy * 0.3)) AS target, CAST(gx AS DOUBLE) AS lon FROM ri)",
        f"cu AS (SELECT [{', '.join(f'quantile_cont(lon, {i / 5})' for i in range(1, 5))}] AS cuts FROM kr)",
        f"kf AS MATERIALIZED (SELECT kr.*, len(list_filter(cuts, lambda c: c <= lon)) AS fold, 1 / pow(target + {L.NATURAL_UCD}, 2) AS w FROM kr, cu)",
        f"sm AS MATERIALIZED (SELECT fold, {', '.join(sums)} FROM kf GROUP BY fold)",
        f"ne AS (SELECT f.fold, {', '.join(f'sum(s.{n}) AS {n}' for n in names)} FROM (SELECT fold FROM sm UNION ALL SELECT -1) f JOIN sm s ON s.fold <> f.fold GROUP BY f.fold)",
        f"ca AS ({' UNION ALL '.join(cands)})",
        "ks AS MATERIALIZED (SELECT fold, arg_max({'w0': w0, 'w1': w1, 'w2': w2}, b0 * w0 + b1 * w1 + b2 * w2) AS w FROM ca WHERE isfinite(w0 + w1 + w2) AND w0 >= 0 AND w1 >= 0 AND w2 >= 0 GROUP BY fold)",
        f"er AS (SELECT 2.5 * log10((target + {L.NATURAL_UCD}) / (r0 * k.w.w0 + r1 * k.w.w1 + r2 * k.w.w2 + {L.NATURAL_UCD})) AS e FROM kf JOIN ks k USING (fold))",
    )


THREE = [f"r{i}" for i in range(3)]


@query("light_kernel_three_rings", "M28", with_(CELLS, KMG, RINGS, *_three_rings()) + f"SELECT ring, {R('CASE ring WHEN 0 THEN w.w0 WHEN 1 THEN w.w1 ELSE w.w2 END', 9)} AS weight FROM ks, (SELECT unnest([0, 1, 2]) AS ring) WHERE fold = -1")
def light_kernel_three_rings(spark, sf):
    w = L.fit_kernel(kernel_rows(spark, sf), THREE)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "ring int, weight double").select("ring", r6("weight", 9).alias("weight"))


@query("light_kernel_cv_three_rings", "M28", with_(CELLS, KMG, RINGS, *_three_rings()) + f"SELECT {R('sqrt(avg(e * e))')} AS rmse_mag, {R('avg(e)')} AS bias_mag, {R('avg(CASE WHEN abs(e) <= 0.15 THEN 1.0 ELSE 0.0 END)')} AS share_within_0_15, {R('avg(CASE WHEN abs(e) <= 0.30 THEN 1.0 ELSE 0.0 END)')} AS share_within_0_30, {R('quantile_cont(abs(e), 0.5)')} AS median_abs_mag FROM er")
def light_kernel_cv_three_rings(spark, sf):
    s = L.error_summary(L.spatial_cv(kernel_rows(spark, sf), THREE))
    return s.select(*[r6(c).alias(c) for c in ("rmse_mag", "bias_mag", "share_within_0_15", "share_within_0_30", "median_abs_mag")])


ATL = f"atl AS (SELECT row, col, ucd, ucd * (1 + ((row * 7 + col) % 11 - 4) / 10.0::DOUBLE) AS now, (row + col) % 15 AS zone FROM ce), up AS (SELECT *, greatest(0.1, least(10.0, (now + 5.22) / (ucd + 5.22))) AS change FROM atl)"


def atlas(spark, sf):
    r, c = F.col("row"), F.col("col")
    return cells(spark, sf).withColumn("model_base", F.col("ucd")).withColumn("model_now", F.col("ucd") * (1 + ((r * 7 + c) % 11 - 4) / 10.0)).withColumn("zone", (r + c) % 15)


@query("atlas_update", "M30", with_(CELLS, ATL) + f"SELECT row, col, {R('change')} AS change, {R('ucd * change')} AS updated_ucd FROM up")
def atlas_update(spark, sf):
    return L.update_atlas(atlas(spark, sf)).select("row", "col", r6("change").alias("change"), r6("updated_ucd").alias("updated_ucd"))


@query("atlas_card", "M30", with_(CELLS, ATL) + f"SELECT {R('avg(CASE WHEN ucd > 17.4 THEN CAST(change > 1.0 AS DOUBLE) END)')} AS share_brighter, {R('avg(CASE WHEN change <= 0.1 OR change >= 10 THEN 1.0 ELSE 0.0 END)')} AS share_clipped, count(ucd) AS n_cells, {R('quantile_cont(CASE WHEN ucd > 174.0 THEN change END, 0.5)')} AS median_lit FROM up")
def atlas_card(spark, sf):
    c = L.change_card(L.update_atlas(atlas(spark, sf)))
    return c.select(r6("share_brighter").alias("share_brighter"), r6("share_clipped").alias("share_clipped"), "n_cells", r6("median_lit").alias("median_lit"))


@query("zone_validation", "M31", with_(CELLS, ATL) + f""", v AS (SELECT abs({ZON} - zone) AS z, ({SQM.format('ucd')}) - ({SQM.format(f'{MIDL}[zone + 1] * 174.0')}) AS d, zone >= 7 AS lit FROM atl)
  SELECT {R('avg(CASE WHEN z <= 1 THEN 1.0 ELSE 0.0 END)')} AS within_one_zone, {R('avg(CASE WHEN abs(d) <= 0.3 THEN 1.0 ELSE 0.0 END)')} AS share_within_0_3_mag, {R('avg(CASE WHEN lit THEN d END)')} AS lit_bias_mag, {R('avg(CASE WHEN lit THEN CAST(z <= 1 AS DOUBLE) END)')} AS lit_within_one_zone,
  {R('avg(CASE WHEN lit THEN 1.0 ELSE 0.0 END)')} AS lit_share_of_cells, {R('quantile_cont(abs(d), 0.5)')} AS median_abs_mag, {R('quantile_cont(CASE WHEN lit THEN abs(d) END, 0.5)')} AS lit_median_abs_mag FROM v""")
def zone_validation(spark, sf):
    v = L.validate_zones(atlas(spark, sf))
    return v.select(*[r6(c).alias(c) for c in v.columns])


# ---------- city glow ----------

KERNEL = [9.0, 7.0, 5.0, 3.0, 2.0, 1.0, 0.5, 0.2, 0.1]


def lights(spark, sf):
    return cells(spark, sf).select((F.col("row") * 1000 + F.col("col")).alias("source_id"), "lat", "lon", F.col("radiance").alias("emission"))


def cities(spark, sf):
    return places(spark, sf).filter("kind <> 'zip'").select(F.col("place_id").alias("city"), "lat", "lon", "population")


def shares(spark, sf):
    owned = L.assign_cities(lights(spark, sf), cities(spark, sf))
    return L.source_shares(sites(spark, sf), owned, KERNEL)


RING = f"least(8, greatest(0, {count_le(G.RING_EDGES_KM, 'km')} - 1))"
SHARES = f"""li AS (SELECT row * 1000 + col AS source_id, lat, lon, radiance AS emission FROM ce),
ct AS (SELECT place_id AS city, lat, lon, greatest(2.0, least(25.0, 1.5 + 4.0 * sqrt(population / 1e5))) AS reach FROM pl WHERE kind <> 'zip'),
ow AS (SELECT source_id, arg_min(city, (km, city)) AS city FROM (SELECT l.source_id, c.city, c.reach, {hav('l.lat', 'l.lon', 'c.lat', 'c.lon')} AS km FROM li l JOIN ct c ON abs(l.lat - c.lat) < 0.3) WHERE km <= reach GROUP BY 1),
sh0 AS (SELECT s.site, l.source_id, l.emission, {hav('s.lat', 's.lon', 'l.lat', 'l.lon')} AS km, {brg('s.lat', 's.lon', 'l.lat', 'l.lon')} AS bearing FROM si s, li l),
sh AS (SELECT h.*, o.city, emission * {KERNEL}[{RING} + 1] AS zenith, CASE WHEN km >= 2.0 THEN emission * pow(greatest(km, 10.0), -2.5) ELSE 0 END AS dome, {sector('bearing', 16)} AS sector FROM sh0 h LEFT JOIN ow o USING (source_id) WHERE km <= 300.0)"""
GLOW = (SITES, CELLS, PLACES, SHARES)


@query("zenith_shares", "A24 F23", with_(*GLOW) + f"SELECT site, count(*) AS n, {R('sum(zenith)', 3)} AS zenith, {R('sum(dome)')} AS dome FROM sh GROUP BY site")
def zenith_shares(spark, sf):
    return shares(spark, sf).groupBy("site").agg(F.count("*").alias("n"), r6(F.sum("zenith"), 3).alias("zenith"), r6(F.sum("dome")).alias("dome"))


@query("glow_by_direction", "A23", with_(*GLOW) + f""", p AS (SELECT site, sector, sum(zenith) AS z, sum(dome) AS d FROM sh GROUP BY ALL), k AS (SELECT DISTINCT site, unnest(range(16)) AS sector FROM sh)
  SELECT k.site, CAST(k.sector AS BIGINT) AS sector, {R('coalesce(z, 0) / sum(z) OVER (PARTITION BY k.site)')} AS overhead_share, {R('coalesce(d, 0)')} AS dome FROM k LEFT JOIN p USING (site, sector)""")
def glow_by_direction(spark, sf):
    g = L.sector_glow(shares(spark, sf), ["site"])
    return g.select("site", big("sector").alias("sector"), r6("overhead_share").alias("overhead_share"), r6("dome").alias("dome"))


@query("darkest_direction", "W10", with_(*GLOW) + """, p AS (SELECT site, sector, sum(dome) AS d FROM sh GROUP BY ALL), k AS (SELECT DISTINCT site, unnest(range(16)) AS sector FROM sh), f AS (SELECT k.site, k.sector, coalesce(d, 0.0) AS d FROM k LEFT JOIN p USING (site, sector)),
  t AS (SELECT site, sector + o AS i, sector, d FROM f, (SELECT unnest([0, 16]) AS o)), w AS (SELECT site, i, sum(d) OVER (PARTITION BY site ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM t),
  pk AS (SELECT site, arg_max(sector, (d, -sector)) AS peak, sum(d) AS total FROM f GROUP BY site),
  c AS (SELECT w.site, i, s, min(s) OVER (PARTITION BY w.site) AS lo, abs((((i + 1.5) % 16) - peak + 8 + 16) % 16 - 8) AS away, total FROM w JOIN pk USING (site) WHERE i < 16)
  SELECT site, CAST(arg_min(i, (-away, i)) AS BIGINT) AS darkest_sector FROM c WHERE s <= lo + 1e-9 * greatest(total, 1e-12) GROUP BY site""")
def darkest_direction(spark, sf):
    d = L.darkest_window(L.sector_glow(shares(spark, sf), ["site"]), ["site"])
    return d.select("site", big("darkest_sector").alias("darkest_sector"))


@query("city_contributors", "O3 J20 A23", with_(*GLOW) + f""", c AS (SELECT site, city, sum(dome) AS w FROM sh GROUP BY ALL), t AS (SELECT *, sum(w) OVER (PARTITION BY site) AS total, coalesce(sum(CASE WHEN city IS NULL THEN w END) OVER (PARTITION BY site), 0) AS sc FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY w DESC, city) AS r FROM t WHERE city IS NOT NULL AND total > 0) SELECT site, r AS rank, city, {R('w / total')} AS share, {R('sc / total')} AS scattered_share FROM r WHERE r <= 6 AND w / total > 0.01""")
def city_contributors(spark, sf):
    t = L.top_cities(shares(spark, sf), ["site"])
    return t.select("site", big("rank").alias("rank"), "city", r6("share").alias("share"), r6("scattered_share").alias("scattered_share"))


@query("source_owner_city", "J20", with_(*GLOW) + "SELECT source_id, city FROM li LEFT JOIN ow USING (source_id)")
def source_owner_city(spark, sf):
    return L.assign_cities(lights(spark, sf), cities(spark, sf)).select("source_id", "city")


@query("dome_reference", "A33", with_(SITES, CELLS, PLACES, SHARES) + f"SELECT {R('coalesce(sum(emission), 0) * pow(50.0, -2.5)')} AS dome_reference FROM li WHERE {hav('38.0', '-119.0', 'lat', 'lon')} <= 20.0")
def dome_reference(spark, sf):
    return L.dome_reference(lights(spark, sf), 38.0, -119.0).select(r6("dome_reference").alias("dome_reference"))


NODES = [5.0, 20.0, 80.0, 300.0]


def shape_table(spark):
    """A smooth stand-in for the tabulated dome shapes: 4 distances x 72 offsets x 3 heights (parameters
    of the operator, not data)."""
    return spark.range(4 * 72 * 3).select(
        F.floor(F.col("id") / 216).cast("int").alias("node"), (F.floor(F.col("id") / 3) % 72).cast("int").alias("offset"), (F.col("id") % 3 * 30).cast("int").alias("alt")
    ).withColumn("value", 1 + F.cos(F.radians(F.col("offset") * 5.0)) * (1 - F.col("alt") / 90.0) / (1 + F.col("node")))


LN = [f"ln({x})" for x in NODES]
LOGD = "ln(greatest(5.0, least(300.0, km)))"
NODE_I = f"greatest(0, least(2, (CASE WHEN {LOGD} >= {LN[3]} THEN 4 WHEN {LOGD} >= {LN[2]} THEN 3 WHEN {LOGD} >= {LN[1]} THEN 2 WHEN {LOGD} >= {LN[0]} THEN 1 ELSE 0 END) - 1))"
SHAPE = f"""nd AS (SELECT site, zenith, {LOGD} AS ld, {NODE_I} AS i, CAST(round_even(bearing / 5, 0) AS INTEGER) % 72 AS b FROM sh), fr AS (SELECT *, (ld - [{', '.join(LN)}][i + 1]) / ([{', '.join(LN)}][i + 2] - [{', '.join(LN)}][i + 1]) AS f FROM nd),
hi AS (SELECT site, b, node, sum(w) AS w FROM (SELECT site, b, i AS node, zenith * (1 - f) AS w FROM fr UNION ALL SELECT site, b, i + 1, zenith * f FROM fr) GROUP BY ALL),
tb AS (SELECT node, off, alt, 1 + cos(radians(off * 5.0)) * (1 - alt / 90.0) / (1 + node) AS value FROM (SELECT unnest(range(4)) AS node), (SELECT unnest(range(72)) AS off), (SELECT unnest([0, 30, 60]) AS alt))"""


@query("glow_over_the_sky", "A25", with_(*GLOW, SHAPE) + f"SELECT site, CAST(alt AS BIGINT) AS alt, CAST((off + b) % 72 AS BIGINT) AS az, {R('sum(w * value) / any_value(tw)')} AS value FROM hi JOIN tb USING (node) JOIN (SELECT site, sum(zenith) AS tw FROM sh GROUP BY site) USING (site) GROUP BY site, 2, 3")
def glow_over_the_sky(spark, sf):
    s = L.sky_shape(shares(spark, sf), shape_table(spark), ["site"], NODES)
    return s.select("site", big("alt").alias("alt"), big("az").alias("az"), r6("value").alias("value"))


def _spot(r):
    return f"d{r} AS (SELECT site, lat2, lon2, sqm, km FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, lat2, lon2) AS rn FROM (SELECT *, max(sqm) OVER (PARTITION BY site) AS best FROM nr WHERE km <= {r}.0) WHERE sqm >= best - 0.15) WHERE rn = 1)"


SPACED = (
    *[_spot(r) for r in (25, 50, 100)],
    "o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY -sqm, lat2, lon2) AS n FROM (SELECT DISTINCT site, sqm, lat2, lon2 FROM (SELECT * FROM d25 UNION ALL SELECT * FROM d50 UNION ALL SELECT * FROM d100) WHERE km >= 1.5))",
    f"o2 AS (SELECT b.* FROM o b JOIN o a ON a.site = b.site AND a.n = 1 WHERE b.n = 2 AND {hav('a.lat2', 'a.lon2', 'b.lat2', 'b.lon2')} >= 4.0)",
    f"o3 AS (SELECT c.* FROM o c JOIN o a ON a.site = c.site AND a.n = 1 LEFT JOIN o2 ON o2.site = c.site WHERE c.n = 3 AND {hav('a.lat2', 'a.lon2', 'c.lat2', 'c.lon2')} >= 4.0 AND (o2.site IS NULL OR {hav('o2.lat2', 'o2.lon2', 'c.lat2', 'c.lon2')} >= 4.0))",
)


@query("spaced_dark_spots", "O4", with_(SITES, CELLS, NEAR, *SPACED) + f"SELECT site, {R('sqm')} AS sqm, {R('lat2')} AS lat2, {R('lon2')} AS lon2 FROM (SELECT * FROM o WHERE n = 1 UNION ALL SELECT * FROM o2 UNION ALL SELECT * FROM o3)")
def spaced_dark_spots(spark, sf):
    near = L.around(sites(spark, sf), cells(spark, sf), 100.0)
    spots = None
    for r in (25.0, 50.0, 100.0):
        d = L.darkest_within(near.filter(F.col("km") <= r), ["site"])
        spots = d if spots is None else spots.unionByName(d)
    s = L.spaced_spots(spots, ["site"])
    return s.select("site", r6("sqm").alias("sqm"), r6("lat2").alias("lat2"), r6("lon2").alias("lon2"))
