"""Distance joins, nearest neighbours and spread-out selection.

Distance joins are equi-joins on latitude bands and longitude cells, never nested loops. The nearest-
neighbour join starts with small cells and only carries unsettled points to larger ones, so dense areas
never compare everything with everything. Points sharing coordinates are collapsed first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window as W
from pyspark.sql import functions as F

from nightfold.functions.geofn import (
    EARTH_KM, KM_PER_DEG, design_distance_km, haversine_km, slug,
)
from nightfold.util import SALTS, cut_lineage, ranked_cumsum


def salted_lookup(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a side that is unique per key; the unique side is repeated per salt so that a key holding
    much of the big side is spread over tasks."""
    b = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return b.join(s, [*keys, "_salt"], how).drop("_salt")


# ---------- radius joins ----------


def _columns(band: Column, delta: float, radius_km: float) -> Column:
    """How many cells a latitude band has around the globe: none narrower than the radius anywhere in the band or
    its neighbours' edge, and one where a circle of the radius may reach round the pole."""
    edge = F.radians(F.greatest(F.abs(band), F.abs(band + 1)) * delta)  # the poleward edge
    # Half the longitudes that a circle around a point at that edge spans.
    reach = F.when(edge < math.pi / 2 - radius_km / EARTH_KM, F.asin(math.sin(min(radius_km / EARTH_KM, math.pi / 2)) / F.cos(edge)))
    return F.coalesce(F.greatest(F.floor(math.pi * 2 / reach), F.lit(1)), F.lit(1)).cast("long")


def _cell(lon: Column, columns: Column, step: Column | int = 0) -> Column:
    """The cell of a longitude, `step` cells on, counted around the globe."""
    return F.pmod(F.floor(F.pmod(lon, F.lit(360.0)) / 360 * columns) + step, columns).cast("long")


BLOCK = 2048  # rows of a cell, on either side, that one piece of the work holds
PIECES = 1024  # from so many on, pieces grow before they become more: a row is copied for each block that it meets
GROWN = 8  # times BLOCK, the most rows of a cell that a piece holds on either side


def _spread(lt: DataFrame, rt: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and their join keys. Where candidate pairs are many, a cell's rows are cut into blocks on both sides and every
    block meets every other in its own piece, and there are as many tasks as pieces: neither a crowded cell nor a small table in
    few files leaves the pairs to a few tasks, and what a task holds does not grow with the tables. With very many pairs blocks are larger,
    as the copies of rows that are shuffled are the pairs over half a block's rows."""
    cell = ["_band", "_cell"]
    per = lt.groupBy(*cell).agg(F.count("*").alias("_l")).join(rt.groupBy(*cell).agg(F.count("*").alias("_r")), cell)
    total = per.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0.0
    if total <= BLOCK * BLOCK:
        return lt, rt, cell
    held = min(max(BLOCK, math.ceil(math.sqrt(total / PIECES))), BLOCK * GROWN)
    crowded = per.filter((F.col("_l") > held) | (F.col("_r") > held))
    crowded = crowded.select(*cell, F.ceil(F.col("_l") / held).cast("int").alias("_ln"), F.ceil(F.col("_r") / held).cast("int").alias("_rn"))

    def blocks(side: DataFrame, own: str, other: str, at: str, each: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*side.columns), F.coalesce(F.col(own), F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        return side.join(crowded, cell, "left").select(*side.columns, mine.alias(at), every.alias(each))

    keys, n = [*cell, "_li", "_ri"], min(math.ceil(total / held**2), 20000)
    lt, rt = blocks(lt, "_ln", "_rn", "_li", "_ri"), blocks(rt, "_rn", "_ln", "_ri", "_li")
    return lt.repartition(n, *keys), rt.repartition(n, *keys).hint("merge"), keys


def radius_join(left: DataFrame, right: DataFrame, radius_km: float, within: Column | None = None) -> DataFrame:
    """Pairs (left.*, right.*, km) within `radius_km`, on the whole sphere: cells go round the globe, and bands
    that touch a pole have one. Both need lat/lon; the right side's are renamed lat2/lon2 and it is listed in the
    cells around it. `within` replaces the fixed limit by one that depends on the row (no larger than
    radius_km)."""
    wide = radius_km * 1.001
    delta = wide / KM_PER_DEG
    columns = _columns(F.col("_band"), delta, wide)
    lt = left.withColumn("_band", F.floor(F.col("lat") / delta)).withColumn("_cell", _cell(F.col("lon"), columns))
    three = F.array(F.lit(-1), F.lit(0), F.lit(1))
    rt = right.withColumn("_band", F.explode(F.transform(three, lambda d: F.floor(F.col("lat") / delta) + d)))
    rt = rt.withColumn("_cell", F.explode(F.array_distinct(F.transform(three, lambda d: _cell(F.col("lon"), columns, d)))))
    rt = rt.withColumnRenamed("lat", "lat2").withColumnRenamed("lon", "lon2")
    km = haversine_km("lat", "lon", "lat2", "lon2")
    limit = F.lit(radius_km) if within is None else within
    lt, rt, keys = _spread(lt, rt)
    return lt.join(rt, keys).drop(*keys).withColumn("km", km).filter(F.col("km") <= limit)


def _fine_cell(points: DataFrame, radius_km: float) -> DataFrame:
    """Adds `_fr`, `_fc`: cells whose points are all closer to each other than the radius, so that sharing one needs no
    distance. A cell is 0.45 radii high and, where it is widest, at most as wide. Null outside the globe."""
    delta = 0.45 * radius_km / KM_PER_DEG
    on_globe = (F.abs(F.col("lat")) <= 90) & (F.abs(F.col("lon")) <= 720)
    band = F.when(on_globe, F.floor(F.col("lat") / delta))
    edge = F.radians(F.least(F.least(F.abs(band), F.abs(band + 1)) * delta, F.lit(90.0)))  # towards the equator
    n = F.greatest(F.ceil(F.cos(edge) * (math.pi * 2 * EARTH_KM / (0.45 * radius_km))), F.lit(1)).cast("long")
    return points.withColumn("_fr", band).withColumn("_fc", _cell(F.col("lon"), n))


def not_near(left: DataFrame, right: DataFrame, key: str, radius_km: float) -> DataFrame:
    """Left rows with no right row of the same key closer than the radius.

    Left rows that share a fine cell with a right row are near whatever the distance; dense areas end there, by an equality
    join. Only the places of the others are listed in the cells around them (those of `radius_join`) and compared.
    Neither side is broadcast: listed rows are several times what their size was estimated at."""
    wide = radius_km * 1.001
    delta = wide / KM_PER_DEG
    columns = _columns(F.col("_band"), delta, wide)
    places = right.select(F.col(key).alias("_key"), F.col("lat"), F.col("lon")).distinct()
    fine = _fine_cell(places, radius_km).select(F.col("_key").alias(key), "_fr", "_fc").distinct()
    rest = _fine_cell(left, radius_km).join(fine.hint("merge"), [key, "_fr", "_fc"], "left_anti").select(*left.columns)
    three = F.array(F.lit(-1), F.lit(0), F.lit(1))
    aims = rest.select(F.col(key).alias("_key"), F.col("lat").alias("_la"), F.col("lon").alias("_lo")).distinct()
    aims = aims.withColumn("_band", F.explode(F.transform(three, lambda d: F.floor(F.col("_la") / delta) + d)))
    aims = aims.withColumn("_cell", F.explode(F.array_distinct(F.transform(three, lambda d: _cell(F.col("_lo"), columns, d)))))
    there = places.withColumn("_band", F.floor(F.col("lat") / delta)).withColumn("_cell", _cell(F.col("lon"), columns))
    close = haversine_km("_la", "_lo", "lat", "lon") < radius_km
    near = aims.join(there.hint("merge"), ["_key", "_band", "_cell"]).filter(close)
    near = near.select(F.col("_key").alias(key), F.col("_la").alias("lat"), F.col("_lo").alias("lon")).distinct()
    return rest.join(near.hint("merge"), [key, "lat", "lon"], "left_anti").select(*left.columns)


# ---------- nearest ----------

# Cell sizes in degrees; each divides 360, and the last one's block covers the whole sphere.
CELL_DEG = (0.05, 0.2, 0.9, 3.6, 18.0, 90.0, 180.0)


def nearest(
    left: DataFrame, right: DataFrame, right_id: str, k: int = 1, payload: Sequence[str] = (), keys: Sequence[str] = (),
    within: Column | None = None,
) -> DataFrame:
    """The k nearest right rows (sharing `keys`, if given) of every left row that has any: left.*, rank,
    km, right_id, payload.

    Distinct left points are matched in growing cells; a point is settled once its k-th candidate is
    nearer than the edge of the searched block. Ties go to the lower id. Exact on the whole sphere. A point whose
    keys no right row has is not searched at all; one is given up once the searched block reaches past `within`
    (km, of the left row), and rows farther than that are left out.
    """
    keys = list(keys)
    item = F.struct(F.col(right_id).alias("id"), *payload)
    places = right.select(*keys, F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), item.alias("_p"))
    if k == 1:
        places = places.groupBy(*keys, "lat2", "lon2").agg(F.min("_p").alias("_p"))
    here = [*keys, "lat", "lon"]
    limit = F.lit(None).cast("double") if within is None else within.cast("double")
    todo = left.select(*here, limit.alias("_within")).groupBy(*here).agg(F.max("_within").alias("_within"))
    if keys:
        todo = todo.join(places.select(*keys).distinct(), keys, "left_semi")
    settled: DataFrame | None = None
    three = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for deg in CELL_DEG:
        n = int(round(360 / deg))
        row, cell = (lambda c: F.floor(F.col(c) / deg)), (lambda c, d=0: F.pmod(F.floor(F.col(c) / deg) + d, F.lit(n)))
        around = places.withColumn("_a", F.explode(F.transform(three, lambda d: row("lat2") + d)))
        around = around.withColumn("_b", F.explode(F.array_distinct(F.transform(three, lambda d: cell("lon2", d)))))
        cand = todo.withColumn("_a", row("lat")).withColumn("_b", cell("lon")).join(around, [*keys, "_a", "_b"])
        cand = cand.select(*here, "_within", haversine_km("lat", "lon", "lat2", "lon2").alias("km"), "_p")
        order = F.struct("km", "_p")
        if k == 1:
            best = cand.groupBy(*here, "_within").agg(F.array(F.min(order)).alias("_best"))
        else:
            rank = F.row_number().over(W.partitionBy(*here, "_within").orderBy("km", "_p"))
            top = cand.withColumn("_r", rank).filter(F.col("_r") <= k)
            best = top.groupBy(*here, "_within").agg(F.array_sort(F.collect_list(order)).alias("_best"))
        if deg != CELL_DEG[-1]:
            side = F.lit(EARTH_KM) * F.asin(F.cos(F.radians("lat")) * math.sin(math.radians(min(deg, 90))))
            safe = F.least(F.lit(deg * KM_PER_DEG), side) * 0.999
            over = F.coalesce(F.col("_within") <= safe, F.lit(False))  # all there is within the limit was looked at
            best = best.filter(((F.size("_best") >= k) & (F.element_at("_best", -1)["km"] <= safe)) | over)
            todo = todo.filter(~over)
        best = cut_lineage(best.drop("_within"))
        settled = best if settled is None else settled.unionByName(best)
        todo = cut_lineage(todo.join(best.select(*here), here, "left_anti"))
        if todo.isEmpty():
            break
    out = F.transform(
        "_best",
        lambda x, i: F.struct(
            (i + 1).alias("rank"), x["km"].alias("km"), x["_p"]["id"].alias(right_id), *[x["_p"][c].alias(c) for c in payload]
        ),
    )
    found = salted_lookup(left, settled.withColumn("_best", out), here, "inner")
    if within is None:
        return found.select(*left.columns, F.inline("_best"))
    return found.select(*left.columns, limit.alias("_within"), F.inline("_best")).filter("km <= _within").drop("_within")


def nearest_scaled(points: DataFrame, places: DataFrame, point_id: str, near_score: float = 2.0) -> DataFrame:
    """The place each point most plausibly lies in: distance in units of the radius of a circle with the
    place's area; a city or town within `near_score` radii first, otherwise the lowest score of any kind.

    Searches everything up to a score at a time (doubling-size classes keep each distance join local) and
    raises the score for points that found nothing.
    """
    radius = F.sqrt(F.greatest(F.col("land_km2"), F.lit(1.0)) / math.pi)
    typed = places.select(
        "place_id", "name", "lat", "lon", radius.alias("radius"), F.col("kind").isin("city", "town").alias("inc"),
        F.floor(F.log2(radius)).cast("int").alias("_class"),
    )
    classes = [r[0] for r in typed.select("_class").distinct().orderBy("_class").collect()]  # one per doubling of size
    todo, settled, limit = points.select(point_id, "lat", "lon"), None, near_score
    while classes:
        reach = [min(limit * 2.0 ** (c + 1), 20100.0) for c in classes]
        parts = [radius_join(todo, typed.filter(F.col("_class") == c), r, F.lit(limit) * F.col("radius")) for c, r in zip(classes, reach, strict=True)]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.withColumn("score", F.col("km") / F.col("radius"))
        pick = F.struct("score", "place_id", "name")
        town = F.min(F.when(F.col("inc") & (F.col("score") <= near_score), pick))
        best = cut_lineage(found.groupBy(point_id).agg(F.coalesce(town, F.min(pick)).alias("_m")))
        settled = best if settled is None else settled.unionByName(best)
        todo = cut_lineage(todo.join(best.select(point_id), point_id, "left_anti"))
        if todo.isEmpty() or min(reach) >= 20100.0:
            break
        limit *= 8
    return settled.select(point_id, F.col("_m.place_id").alias("place_id"), F.col("_m.name").alias("near"))


def grid_points(spark, bounds: tuple[float, float, float, float], step: float) -> DataFrame:
    """Regular grid of cell centres over (west, south, east, north)."""
    west, south, east, north = bounds
    n_lat = math.ceil((north - south - step / 2) / step - 1e-9)
    n_lon = math.ceil((east - west - step / 2) / step - 1e-9)
    base = spark.range(n_lat * n_lon)
    return base.select(
        (F.lit(south + step / 2) + F.floor(F.col("id") / n_lon) * step).alias("lat"),
        (F.lit(west + step / 2) + (F.col("id") % n_lon) * step).alias("lon"),
    )


def describe(nearby: DataFrame, name: str = "name") -> Column:
    """'Town' when the nearest place is within a kilometre, else 'Near Town'."""
    return F.when(F.col("km") < 1.0, F.col(name)).otherwise(F.concat(F.lit("Near "), F.col(name)))


# ---------- selection ----------


def candidates(stations: DataFrame, excluded: Sequence[str], history_start: str) -> DataFrame:
    """Online stations with a region, not excluded, whose archive covers the history."""
    s = F.col
    return stations.filter(
        s("online") & (F.coalesce(s("region"), F.lit("")) != "") & ~s("id").isin(list(excluded))
        & (s("archive_begin") <= F.lit(history_start).cast("date"))
    )


def quotas(stations: DataFrame, per: int, floor_: int) -> DataFrame:
    """Stations to pick per region: online ones / per, halves up, at least `floor_`."""
    online = stations.filter(F.col("online") & (F.coalesce("region", F.lit("")) != ""))
    n = F.count("*")
    return online.groupBy("region").agg(n.alias("online"), F.greatest(F.lit(floor_).cast("long"), F.floor(n / per + 0.5).cast("long")).alias("quota"))


def farthest_points(
    pool: DataFrame, seeds: Sequence[Row], quota: dict[str, int], km_per_m: float,
    passes: Callable[[Row], bool] = lambda row: True, cut_every: int = 8,
) -> list[Row]:
    """Greedy maximin: the seeds, then repeatedly the pool row farthest from everything chosen, among
    regions with quota left; ties (to the millimetre) go to the first id. Returns the chosen rows in order.

    Each pick is one distributed arg-max; the running minimum distance is a column, and the chosen point
    enters it as a literal. Lineage is cut every few picks. With no seeds the most central row is first.
    """
    chosen, left = list(seeds), dict(quota)
    for s in seeds:
        left[s["region"]] = left.get(s["region"], 0) - 1
    taken = [s["id"] for s in seeds]
    fields = ["id", "region", "lat", "lon", "elevation_m"]
    state = pool.filter(~F.col("id").isin(taken)) if taken else pool
    far = F.lit(None).cast("double")
    for s in seeds:
        d = design_distance_km("lat", "lon", "elevation_m", s["lat"], s["lon"], s["elevation_m"], km_per_m)
        far = d if far is None else F.least(far, d)
    state = cut_lineage(state.select(*fields, far.alias("gap")))
    since = 0
    while True:
        open_regions = [r for r, n in left.items() if n > 0]
        live = state.filter(F.col("region").isin(open_regions)) if open_regions else state.limit(0)
        if not chosen:
            c = live.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).first()
            if c["lat"] is None:
                return chosen
            live = live.withColumn("gap", -haversine_km("lat", "lon", c["lat"], c["lon"]))
        top = live.agg(F.min_by(F.struct(*fields), F.struct(-F.round("gap", 6), F.col("id"))).alias("r")).first()
        if top is None or top["r"] is None:
            return chosen
        best = top["r"]
        state = state.filter(F.col("id") != best["id"])
        if passes(best):
            d = design_distance_km("lat", "lon", "elevation_m", best["lat"], best["lon"], best["elevation_m"], km_per_m)
            state = state.withColumn("gap", F.least(F.col("gap"), d))
            chosen.append(best)
            left[best["region"]] -= 1
        since += 1
        if since % cut_every == 0:
            state = cut_lineage(state)


# ---------- gazetteer ----------


def unique_ids(places: DataFrame, order: str) -> DataFrame:
    """URL ids: the slug of the name; places sharing one append their county; further clashes a number.
    `order` must be unique; numbers come from distributed running counts, so a name held by very many
    rows is not sorted in one task."""
    base = places.withColumn("_s", slug(F.col("name")))
    counts = base.groupBy("_s").agg(F.count("*").alias("_c"))
    joined = salted_lookup(base, counts, ["_s"], "inner")
    with_county = F.concat_ws("-", "_s", slug(F.coalesce("county", F.lit("ca"))))
    joined = joined.withColumn("_id", F.when(F.col("_c") == 1, F.col("_s")).otherwise(with_county))
    clash = joined.groupBy("_id").agg(F.count("*").alias("_k")).filter("_k > 1").select("_id")  # the few that need a number
    clashing = joined.join(clash, "_id", "left_semi").select("_id", order, F.lit(1).alias("_r"))
    ranks = ranked_cumsum(clashing, ["_id"], order, ["_r"])
    ranks = ranks.select("_id", order, (F.col("_r_below") + 1).alias("_r"))
    numbered = joined.join(ranks, ["_id", order], "left").withColumn("_r", F.coalesce("_r", F.lit(1)))
    return numbered.withColumn("id", F.when(F.col("_r") == 1, F.col("_id")).otherwise(F.concat_ws("-", "_id", F.col("_r").cast("string")))).drop("_s", "_c", "_id", "_r")


def town_centres(places: DataFrame, towns: DataFrame, max_radii: float = 2.5, min_km: float = 3.0) -> DataFrame:
    """The same-name, same-county settlement nearest a place's internal point when it is close enough for
    the place's size, otherwise the place's own point."""
    limit = F.greatest(max_radii * F.sqrt(F.greatest(F.col("land_km2"), F.lit(0.01)) / math.pi), F.lit(min_km))
    p = places.withColumn("_key", F.lower("name"))
    t = towns.withColumn("_key", F.lower("name"))
    t = t.withColumn("lat2", F.col("lat")).withColumn("lon2", F.col("lon"))
    best = nearest(p, t, "town_id", payload=["lat2", "lon2"], keys=["_key", "county"], within=limit)
    out = places.join(best.select("place_id", "town_id", "km", "lat2", "lon2"), "place_id", "left")
    return out.select(
        "place_id", F.coalesce("lat2", "lat").alias("lat"), F.coalesce("lon2", "lon").alias("lon"), "town_id", "km",
        F.when(F.col("town_id").isNotNull(), "populated-place").otherwise("own-record").alias("point"),
    )


def search_order(places: DataFrame) -> list[Column]:
    """Named places before ZIP codes, then population, then name."""
    return [(F.col("kind") == "zip").asc(), F.col("population").desc(), F.col("name").asc()]


def nearest_darker(sites: DataFrame, places: DataFrame, min_sqm: float) -> DataFrame:
    """Per site, the closest other place at least as dark as the bound."""
    dark = places.filter(F.col("sqm") >= min_sqm).select(F.col("site").alias("place"), "lat", "lon", "sqm")
    two = nearest(sites, dark, "place", k=2, payload=["sqm"]).filter(F.col("place") != F.col("site"))
    return two.groupBy("site").agg(F.min(F.struct("rank", "place", "km", "sqm")).alias("m")).select("site", "m.place", "m.km", "m.sqm")
