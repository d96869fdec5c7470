"""Scans: text and JSON files to the logical tables. Types are explicit, bad payloads go to a quarantine
table, and duplicates between chunks are settled by declared precedence.

Every format is a `parse_…` of a DataFrame of text (lines, or one payload a row), which is a plan like any other: the
text may come from files, a stream or a column. `scan_…` reads files as text and parses them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightfold.functions.bounds import clip
from nightfold.functions.geofn import short_name
from nightfold.operators.merge import later_wins
from nightfold.util import clean_double

SKY_COLS = ["skyc1", "skyc2", "skyc3", "skyc4"]
HOURLY = "timezone string, hourly map<string, array<string>>"
# Place codes of the census files and the kinds they stand for.
PLACE_KIND = {"25": "city", "43": "town", "57": "community"}


# ---------- station reports ----------


def _lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(value, file) of every line; a line ends with \\n alone, so a stray carriage return stays inside."""
    r = spark.read.option("lineSep", "\n")
    if encoding != "UTF-8":
        r = r.option("encoding", encoding)
    return r.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def _payloads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file) of whole files."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def _header(lines: DataFrame, sep: str) -> tuple[list[str], DataFrame]:
    """(column names, the other lines): files of one scan share their first line."""
    first = lines.first()
    if first is None:
        return [], lines
    names = [c.replace("\r", "").replace("\ufeff", "").strip() for c in first["value"].split(sep)]
    return names, lines.filter((F.col("value") != first["value"]) & (F.trim("value") != ""))


def parse_table(lines: DataFrame, sep: str, names: Sequence[str]) -> DataFrame:
    """Text lines without quoting to one text column a name; fields that are not there are NULL."""
    cells = F.split(F.col("value"), "\\Q" + sep + "\\E", -1)
    return lines.withColumn("_cells", cells).select(*[F.get("_cells", F.lit(i)).alias(n) for i, n in enumerate(names)], "value")


def parse_reports(lines: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of station lines: every column text but `valid`; a stray carriage return is a space; rows equal in
    time and codes are one. A line without all codes or with an unreadable time is quarantined with a reason. Missing
    required columns fail."""
    lacking = {"station", "valid", *SKY_COLS} - set(names)
    if lacking:
        raise ValueError(f"station file lacks columns {sorted(lacking)}")
    raw = parse_table(lines, ",", names)
    tidy = raw.select(*[F.regexp_replace(c, "\r", " ").alias(c) for c in names], "value")
    typed = tidy.withColumn("valid", F.try_to_timestamp(F.trim("valid"), F.lit("yyyy-MM-dd HH:mm")))
    short = F.lit(False)
    for c in SKY_COLS:
        short = short | F.col(c).isNull()
    typed = typed.withColumn("reason", F.when(short, "too few fields").when(F.col("valid").isNull(), "unreadable time"))
    rows = typed.filter("reason is null").drop("value", "reason")
    return rows.dropDuplicates(["station", "valid", *SKY_COLS]), typed.filter("reason is not null").select("value", "reason")


def scan_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of station CSV files."""
    names, lines = _header(_lines(spark, path), ",")
    return parse_reports(lines, names)[0]


# ---------- hourly JSON ----------


def _chunk(name: Column) -> tuple[Column, Column]:
    """(end of the range, stem) of a chunk file named start_end.json."""
    stem = F.regexp_extract(name, r"([^/]+)\.json$", 1)
    return F.element_at(F.split(stem, "_"), 2), stem


def scan_hourly(spark: SparkSession, path: str | list[str], variables: Sequence[str], model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """`parse_hourly` of whole files."""
    return parse_hourly(_payloads(spark, path), variables, model)


def parse_hourly(payloads: DataFrame, variables: Sequence[str], model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of payloads (value, file). Rows: file, chunk_end, stem, hour and one fraction per variable.

    A variable is found under its own name or with the model's suffix; one that is absent is NULL. A payload
    is quarantined with a reason when it is not JSON, has no times, is not in UTC, has arrays of another length, or a
    percentage outside -1..101 (those two are rounding, and are clipped).
    """
    end, stem = _chunk(F.col("file"))
    raw = payloads.select("file", F.from_json("value", HOURLY + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    h = raw.select("file", end.alias("chunk_end"), stem.alias("stem"), F.col("j._corrupt").isNotNull().alias("_torn"), F.coalesce("j.timezone", F.lit("GMT")).alias("tz"), F.col("j.hourly").alias("hourly"))
    times = F.try_element_at("hourly", F.lit("time"))
    pick = {v: F.coalesce(*([F.try_element_at("hourly", F.lit(f"{v}_{model}"))] if model else []), F.try_element_at("hourly", F.lit(v))) for v in variables}
    h = h.withColumn("_time", times).withColumns({f"_{v}": F.transform(c, lambda x: x.cast("double")) for v, c in pick.items()})
    size_bad, range_bad = F.lit(False), F.lit(False)
    for v in variables:
        c = F.col(f"_{v}")
        size_bad = size_bad | (c.isNotNull() & (F.size(c) != F.size("_time")))
        if v.startswith("cloud_cover"):
            range_bad = range_bad | F.coalesce(F.exists(c, lambda x: (x < -1) | (x > 101)), F.lit(False))
    reason = (
        F.when(F.col("_torn"), "not JSON")
        .when(F.isnull("_time") | (F.size("_time") == 0), "no times")
        .when(~F.col("tz").isin("GMT", "UTC"), "not UTC")
        .when(size_bad, "length mismatch")
        .when(range_bad, "out of range")
    )
    h = h.withColumn("reason", reason)
    rows = h.filter("reason is null").select("file", "chunk_end", "stem", F.posexplode("_time").alias("_i", "_t"), *[f"_{v}" for v in variables])

    def value(v: str) -> Column:
        x = F.get(F.col(f"_{v}"), F.col("_i"))
        return (clip(x, 0.0, 100.0) / 100 if v.startswith("cloud_cover") else x).alias(v)

    hour = F.to_timestamp(F.substring(F.col("_t"), 1, 16), "yyyy-MM-dd'T'HH:mm")
    return rows.select("file", "chunk_end", "stem", hour.alias("hour"), *[value(v) for v in variables]), h.filter("reason is not null").select("file", "reason")


def load_cached(rows: DataFrame, keys: Sequence[str] = ("hour",)) -> DataFrame:
    """One row per key out of overlapping chunks: the chunk with the later end wins, then the later name."""
    return later_wins(rows, keys, ["chunk_end", "stem"])


def previous_runs(rows: DataFrame, leads: Sequence[int], model: str) -> DataFrame:
    """Columns cloud_cover_previous_day{d} to long (model, lead, hour, cover)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("lead"), F.col(f"cloud_cover_previous_day{d}").alias("cover")) for d in leads])
    return rows.select(F.lit(model).alias("model"), "hour", F.inline(pairs))


def scan_forecast_payload(spark: SparkSession, path: str, models: dict[str, str], layers: Sequence[str]) -> DataFrame:
    return parse_forecast_payload(_payloads(spark, path), models, layers).drop("file")


def parse_forecast_payload(payloads: DataFrame, models: dict[str, str], layers: Sequence[str]) -> DataFrame:
    """Every model of each payload as long rows (file, model, hour, layers); models: {short name: id}."""
    out = None
    for short, ident in models.items():
        rows, _ = parse_hourly(payloads, layers, ident)
        part = rows.select("file", F.lit(short).alias("model"), "hour", *layers)
        out = part if out is None else out.unionByName(part)
    return out


def scan_ensemble(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return parse_ensemble(_payloads(spark, path), suffix).drop("file")


def parse_ensemble(payloads: DataFrame, suffix: str) -> DataFrame:
    """(file, member, hour, cover) of ensemble payloads; the run without a member number is 'control'."""
    raw = payloads.select("file", F.from_json("value", HOURLY).alias("j")).select("file", F.col("j.hourly").alias("hourly"))
    e = raw.select("file", F.try_element_at("hourly", F.lit("time")).alias("_time"), F.explode("hourly").alias("key", "values"))
    e = e.filter((F.col("key") != "time") & F.col("key").endswith(suffix))
    name = F.regexp_extract("key", f"^cloud_cover_?(.*?)_?{suffix}$", 1)
    long = e.select("file", F.when(name == "", "control").otherwise(name).alias("member"), "_time", F.posexplode("values").alias("_i", "_v"))
    hour = F.to_timestamp(F.substring(F.get("_time", F.col("_i")), 1, 16), "yyyy-MM-dd'T'HH:mm")
    return long.select("file", "member", hour.alias("hour"), (F.col("_v").cast("double") / 100).alias("cover"))


def scan_aerosol(spark: SparkSession, path: str) -> DataFrame:
    return parse_aerosol(_payloads(spark, path)).drop("file")


def parse_aerosol(payloads: DataFrame) -> DataFrame:
    """(file, hour, aod), empty values dropped; a payload whose arrays differ in length gives nothing."""
    rows, _ = parse_hourly(payloads, ["aerosol_optical_depth"])
    return rows.select("file", "hour", F.col("aerosol_optical_depth").alias("aod")).filter("aod is not null")


# ---------- satellite ----------


def load_extracts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per-site monthly CSVs (…/site/month.csv): the last row written for an hour wins."""
    raw = spark.read.schema("hour string, cover string, n_good string, key string").option("header", True).csv(path)
    rows = raw.select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+\.csv$", 1).alias("site"), F.to_timestamp("hour").alias("hour"),
        clean_double("cover").alias("cover"), F.col("n_good").cast("int").alias("n_good"),
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_o"),
    )
    return later_wins(rows, ["site", "hour"], ["_f", "_b", "_o"]).drop("_f", "_b", "_o")


def satellite_boxes(pixels: DataFrame, sites: DataFrame, half: int = 2) -> DataFrame:
    """Mean cloud mask of the good pixels in the (2 half + 1)^2 box around each site's pixel, per scan.
    Pixels are added up per scan and position first, and every distinct box lists its positions, so the join is by equality and
    grows with boxes and scans, not with pixels times sites. A box without a good pixel is NULL and 0; a site outside
    the image altogether has one row without a scan."""
    good = (F.col("dqf") == 0) & F.col("bcm").isin(0, 1)
    sums = pixels.groupBy("scan", "row", "col").agg(
        F.sum(F.when(good, F.col("bcm").cast("double"))).alias("_s"), F.sum(good.cast("int")).alias("_n")
    )
    placed = sites.groupBy("site", "site_row", "site_col").agg(F.count("*").alias("_k"))
    offsets = F.sequence(F.lit(-half), F.lit(half))
    box = placed.select("site_row", "site_col").distinct()
    box = box.withColumn("row", F.explode(F.transform(offsets, lambda d: F.col("site_row") + d)))
    box = box.withColumn("col", F.explode(F.transform(offsets, lambda d: F.col("site_col") + d)))
    boxes = box.join(sums, ["row", "col"]).groupBy("site_row", "site_col", "scan").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    per = placed.join(boxes, ["site_row", "site_col"]).groupBy("site", "scan").agg(
        F.sum(F.col("_s") * F.col("_k")).alias("_s"), F.sum(F.col("_n") * F.col("_k")).alias("n_good")
    )
    per = per.select("site", "scan", F.when(F.col("n_good") > 0, F.col("_s") / F.col("n_good")).alias("cover"), "n_good")
    return sites.select("site").join(per, "site", "left").withColumn("n_good", F.coalesce("n_good", F.lit(0)))


# ---------- places and stations ----------


def scan_stations(spark: SparkSession, path: str) -> DataFrame:
    return parse_stations(_payloads(spark, path))


def parse_stations(payloads: DataFrame) -> DataFrame:
    """Station GeoJSON payloads to rows; coordinates are [lon, lat]."""
    schema = (
        "features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<sid: string, sname: string, elevation: double, "
        "tzname: string, archive_begin: string, online: boolean, wfo: string, county: string, attributes: struct<IS_AWOS: string>>>>"
    )
    f = payloads.select(F.explode(F.from_json("value", schema)["features"]).alias("f"))
    p, c = "f.properties.", F.col("f.geometry.coordinates")
    return f.select(
        F.col(p + "sid").alias("id"), F.col(p + "sname").alias("name"), c[1].alias("lat"), c[0].alias("lon"), F.col(p + "elevation").alias("elevation_m"),
        F.coalesce(p + "wfo", F.lit("")).alias("region"), F.coalesce(p + "county", F.lit("")).alias("county"), F.col(p + "tzname").alias("timezone"),
        F.to_date(p + "archive_begin").alias("archive_begin"), F.coalesce(p + "online", F.lit(False)).alias("online"),
        F.coalesce(F.col(p + "attributes.IS_AWOS") == "1", F.lit(False)).alias("is_awos"),
    )


def _table(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8", names: Sequence[str] | None = None) -> DataFrame:
    lines = _lines(spark, path, encoding)
    if not names:
        names, lines = _header(lines, sep)
    return parse_table(lines, sep, names).drop("value")


def scan_census_places(spark: SparkSession, path: str, region: str) -> DataFrame:
    return census_places(_table(spark, path, "|"), region)


def census_places(table: DataFrame, region: str) -> DataFrame:
    t = table.filter(F.trim("USPS") == region)
    kind = F.create_map(*[F.lit(x) for kv in PLACE_KIND.items() for x in kv])
    return t.select(
        F.col("GEOID").alias("geoid"), F.col("ANSICODE").cast("long").alias("gnis_id"), short_name(F.col("NAME")).alias("name"),
        F.coalesce(F.try_element_at(kind, F.col("LSAD")), F.lit("community")).alias("kind"), F.trim("INTPTLAT").cast("double").alias("lat"),
        F.trim("INTPTLONG").cast("double").alias("lon"), (F.col("ALAND").cast("double") / 1e6).alias("land_km2"),
    )


def scan_named_features(spark: SparkSession, path: str, state: str) -> DataFrame:
    return named_features(_table(spark, path, "|"), state)


def named_features(table: DataFrame, state: str) -> DataFrame:
    t = table.filter(F.col("state_name") == state)
    out = t.select(
        F.col("feature_id").cast("long").alias("gnis_id"), F.col("feature_name").alias("name"), "feature_class", F.col("county_name").alias("county"),
        F.col("prim_lat_dec").try_cast("double").alias("lat"), F.col("prim_long_dec").try_cast("double").alias("lon"),
    )
    return out.filter("lat is not null and lon is not null")


# Columns of the GeoNames dump, in order.
GEONAMES = ("geonameid", "name", "asciiname", "alternatenames", "lat", "lon", "fclass", "fcode", "cc", "cc2", "admin1", "admin2", "admin3", "admin4",
            "population", "elevation", "dem", "tz", "moddate")


def scan_geonames(spark: SparkSession, path: str, counties: DataFrame, admin1: str) -> DataFrame:
    return geonames(_table(spark, path, "\t", names=GEONAMES), counties, admin1)


def geonames(table: DataFrame, counties: DataFrame, admin1: str) -> DataFrame:
    """Populated places of one region with their county's name. `counties`: (admin2, county)."""
    t = table.filter((F.col("admin1") == admin1) & (F.col("fclass") == "P"))
    t = t.join(counties, "admin2", "left")
    return t.select(
        F.col("geonameid").cast("long").alias("geonameid"), "name", "fcode", "county", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
        F.coalesce(F.col("population").try_cast("long"), F.lit(0)).alias("population"), F.col("dem").try_cast("double").alias("dem"),
    )


def scan_counties(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    return counties(_table(spark, path, "\t", names=COUNTY_CODES), prefix)


COUNTY_CODES = ("code", "name", "asciiname", "geonameid")


def counties(table: DataFrame, prefix: str) -> DataFrame:
    """(admin2, county) of a region from the code list; ' County' is dropped."""
    t = table.filter(F.col("code").startswith(prefix))
    return t.select(F.expr(f"substring(code, {len(prefix) + 1})").alias("admin2"), F.regexp_replace("name", " County$", "").alias("county"))


def scan_population(spark: SparkSession, path: str, state: str, level: str = "162") -> DataFrame:
    t = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    t = t.filter((F.col("SUMLEV") == level) & (F.col("STATE") == state))
    return t.select(F.concat(F.lit(state), F.col("PLACE")).alias("geoid"), F.col("POPESTIMATE2024").cast("long").alias("population"))


def scan_zip_areas(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    return zip_areas(_table(spark, path, "|"), first, last)


def zip_areas(table: DataFrame, first: int, last: int) -> DataFrame:
    return table.filter(F.substring("GEOID", 1, 3).cast("int").between(first, last)).select(
        F.col("GEOID").alias("zip"), F.trim("INTPTLAT").cast("double").alias("lat"), F.trim("INTPTLONG").cast("double").alias("lon")
    )


def scan_cities(spark: SparkSession, path: str, lat: tuple[float, float], lon: tuple[float, float], margin: float = 3.0) -> DataFrame:
    return cities(_table(spark, path, "\t", names=GEONAMES), lat, lon, margin)


def cities(table: DataFrame, lat: tuple[float, float], lon: tuple[float, float], margin: float = 3.0) -> DataFrame:
    """Places of the city list within the bounds plus a margin."""
    t = table.select("name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.coalesce(F.col("population").try_cast("long"), F.lit(0)).alias("population"), F.col("cc").alias("country"))
    return t.filter(F.col("lat").between(lat[0] - margin, lat[1] + margin) & F.col("lon").between(lon[0] - margin, lon[1] + margin))


SHOWER = "code string, name string, active_start string, active_end string, peak string, ra double, dec double, speed double, r double, zhr double"


def scan_showers(spark: SparkSession, path: str) -> DataFrame:
    return parse_showers(_lines(spark, path))


def parse_showers(lines: DataFrame) -> DataFrame:
    """Shower calendar (JSON lines): typed, one row per shower."""
    return lines.filter(F.trim("value") != "").select(F.from_json("value", SHOWER).alias("s")).select("s.*").withColumn("peak", F.to_timestamp("peak"))


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    names, lines = _header(_lines(spark, path), ",")
    return parse_log(lines, names)


def parse_log(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """The forecast log with typed dates and numbers."""
    raw = parse_table(lines, ",", names).drop("value")
    typed = raw.withColumn("issue_date", F.to_date("issue_date")).withColumn("night_date", F.to_date("night_date"))
    return typed.withColumn("lead", F.col("lead").cast("int")).withColumn("p_usable", F.col("p_usable").try_cast("double"))


def parse_network(payloads: DataFrame) -> DataFrame:
    """The network's station list, a YAML document with one `- key: value` block per station under `stations:`: id, name,
    coordinates, elevation, region, timezone. Quotes round a value go; a block without an id is no station."""
    body = F.element_at(F.split("value", r"(?m)^stations:\s*$", 2), 2)
    blocks = payloads.select(F.explode(F.split(body, r"(?m)^\s*- ")).alias("b")).filter(F.trim("b") != "")
    m = blocks.select(F.str_to_map(F.trim("b"), F.lit("\n *"), F.lit(": *")).alias("m"))
    text = lambda k: F.regexp_replace(F.trim(F.try_element_at("m", F.lit(k))), r"^(['\"])(.*)\1$", "$2")
    number = lambda k: text(k).try_cast("double").alias(k)
    out = m.select(text("id").alias("id"), text("name").alias("name"), number("lat"), number("lon"), number("elevation_m"), text("region").alias("region"), text("timezone").alias("timezone"))
    return out.filter("id is not null and id <> ''")


def scan_network(spark: SparkSession, path: str) -> DataFrame:
    return parse_network(_payloads(spark, path))
