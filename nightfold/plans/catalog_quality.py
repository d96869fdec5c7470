"""Queries over the data-quality and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightfold.operators import nights as N, quality as Q, verify as V
from nightfold.plans.catalog_spatial import hav
from nightfold.plans.catalog_verify import AUC_SQL, GRP, LNG, METRICS, PRE, REF, SUB, long_nights, predictions
from nightfold.plans.derived import BENCHMARKS, FULL, MODELS, R, big, dataset, r6, table, with_
from nightfold.plans.registry import query

NI = "ni AS (SELECT * FROM dat WHERE lead = 1)"
REASONS = ("no_darkness", "asos_missing", "era5_missing", "asos_and_era5_missing")


def nights(spark, sf):
    return Q.one_row_per_night(dataset(spark, sf))


def q(name, covers, sql):
    return query(name, covers, with_(*FULL, NI) + sql)


@q("overview_table", "Q1 Q16", """SELECT site, count(*) AS nights, CAST(min(night_date) AS VARCHAR) AS first, CAST(max(night_date) AS VARCHAR) AS last, CAST(sum(CASE WHEN dark_hours = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_darkness,
  CAST(min(CASE WHEN dark_hours > 0 THEN dark_hours END) AS BIGINT) AS dark_min, quantile_cont(CASE WHEN dark_hours > 0 THEN CAST(dark_hours AS DOUBLE) END, 0.5) AS dark_median, CAST(max(dark_hours) AS BIGINT) AS dark_max,
  count(CASE WHEN split = 'train' THEN usable_primary END) AS labelled_train, count(CASE WHEN split = 'test' THEN usable_primary END) AS labelled_test FROM ni GROUP BY site""")
def overview_table(spark, sf):
    o = Q.overview(nights(spark, sf))
    return o.select("site", "nights", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "no_darkness", big("dark_min").alias("dark_min"), "dark_median", big("dark_max").alias("dark_max"), "labelled_train", "labelled_test")


@q("observation_coverage", "Q2", f"SELECT site, {R('avg(asos_missing_frac)')} AS asos_missing, count(exclusion_asos) AS asos_excluded, {R('avg(era5_missing_frac)')} AS era5_missing, count(exclusion_era5) AS era5_excluded, {R('sum(n_single_source_hours) / sum(dark_hours)')} AS single_source_share FROM ni WHERE dark_hours > 0 GROUP BY site")
def observation_coverage(spark, sf):
    o = Q.observation_coverage(nights(spark, sf))
    return o.select("site", r6("asos_missing").alias("asos_missing"), "asos_excluded", r6("era5_missing").alias("era5_missing"), "era5_excluded", r6("single_source_share").alias("single_source_share"))


@q("forecast_coverage", "Q3 W12", f""", l AS (SELECT night_date, lead, 'gfs' AS model, gfs_frac_clear AS v FROM dat UNION ALL SELECT night_date, lead, 'ecmwf', ecmwf_frac_clear FROM dat WHERE lead <= 5 UNION ALL SELECT night_date, lead, 'nbm', nbm_frac_clear FROM dat),
  f AS (SELECT model, lead, min(night_date) AS first_night FROM l WHERE v IS NOT NULL GROUP BY ALL)
  SELECT l.model, l.lead, CAST(first_night AS VARCHAR) AS first_night, {R('coalesce(count(CASE WHEN night_date >= first_night THEN v END) / nullif(count(CASE WHEN night_date >= first_night THEN 1 END), 0), 0.0)')} AS coverage FROM l LEFT JOIN f USING (model, lead) GROUP BY ALL""")
def forecast_coverage(spark, sf):
    c = Q.forecast_coverage(dataset(spark, sf), {**MODELS, **BENCHMARKS})
    return c.select("model", "lead", F.col("first_night").cast("string").alias("first_night"), r6("coverage").alias("coverage"))


@q("exclusions_table", "Q4", "SELECT site, " + ", ".join(f"CAST(sum(CASE WHEN exclusion_primary = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS {x}" for x in REASONS) + f", count(exclusion_primary) AS total_excluded, {R('count(exclusion_primary) / count(*)')} AS share_of_nights FROM ni GROUP BY site HAVING count(exclusion_primary) > 0")
def exclusions_table(spark, sf):
    return Q.exclusions(nights(spark, sf), REASONS).select("site", *REASONS, "total_excluded", r6("share_of_nights").alias("share_of_nights"))


@q("base_rate_by_season", "Q5 Q16", f"SELECT site, coalesce(season, 'all') AS season, {R('avg(CAST(usable_era5 AS DOUBLE))')} AS rate, count(*) AS n FROM ni WHERE usable_era5 IS NOT NULL GROUP BY GROUPING SETS ((site), (site, season))")
def base_rate_by_season(spark, sf):
    return Q.base_rate_by_season(nights(spark, sf), "usable_era5").select("site", "season", r6("rate").alias("rate"), "n")


@q("label_comparison", "Q6", f"SELECT site, label, {R('avg(CAST(y AS DOUBLE))')} AS rate, count(y) AS n FROM (" + " UNION ALL ".join(f"SELECT site, '{k}' AS label, {c} AS y FROM ni" for k, c in {**N.LABELS, "asos_max": "usable_asos_max"}.items()) + ") GROUP BY ALL")
def label_comparison(spark, sf):
    return Q.label_comparison(nights(spark, sf), {**N.LABELS, "asos_max": "usable_asos_max"}).select("site", "label", r6("rate").alias("rate"), "n")


def _avg(c):
    return R(f"avg(CAST({c} AS DOUBLE))")


@q("truth_agreement", "Q7", f"""SELECT site, count(*) AS n, {_avg('usable_asos = usable_era5')} AS agree, {_avg('usable_asos AND NOT usable_era5')} AS asos_only, {_avg('usable_era5 AND NOT usable_asos')} AS era5_only,
  {R('avg(CASE WHEN usable_asos AND NOT usable_era5 THEN CAST(usable_goes AS DOUBLE) END)')} AS asos_only_goes_usable, {R('avg(CASE WHEN usable_era5 AND NOT usable_asos THEN CAST(usable_goes AS DOUBLE) END)')} AS era5_only_goes_usable
  FROM ni WHERE usable_asos IS NOT NULL AND usable_era5 IS NOT NULL GROUP BY site""")
def truth_agreement(spark, sf):
    a = Q.agreement(nights(spark, sf))
    return a.select("site", "n", *[r6(c).alias(c) for c in ("agree", "asos_only", "era5_only", "asos_only_goes_usable", "era5_only_goes_usable")])


def _kappa(c):
    a, b = f"CASE WHEN {c} IS NOT NULL AND usable_goes IS NOT NULL THEN CAST({c} AS DOUBLE) END", f"CASE WHEN {c} IS NOT NULL AND usable_goes IS NOT NULL THEN CAST(usable_goes AS DOUBLE) END"
    pe = f"(avg({a}) * avg({b}) + (1 - avg({a})) * (1 - avg({b})))"
    return R(f"CASE WHEN {pe} <> 1 THEN (avg(CAST({c} = usable_goes AS DOUBLE)) - {pe}) / (1 - {pe}) END")


@q("satellite_agreement", "Q8", f"SELECT coalesce(site, 'all') AS site, count(usable_goes) AS labelled, " + ", ".join(f"{_avg(f'usable_{x} = usable_goes')} AS agree_{x}, {_kappa(f'usable_{x}')} AS kappa_{x}" for x in ("asos", "era5")) + " FROM ni GROUP BY GROUPING SETS ((), (site))")
def satellite_agreement(spark, sf):
    s = Q.satellite_agreement(nights(spark, sf), "usable_goes", {"asos": "usable_asos", "era5": "usable_era5"})
    return s.select("site", "labelled", *[r6(c).alias(c) for c in ("agree_asos", "kappa_asos", "agree_era5", "kappa_era5")])


@q("train_test_shift", "Q9", "SELECT site, " + ", ".join(f"{R(f'''avg(CASE WHEN split = '{v}' THEN CAST(usable_era5 AS DOUBLE) END)''')} AS {v}_rate, count(CASE WHEN split = '{v}' THEN usable_era5 END) AS {v}_n" for v in ("train", "test")) + " FROM ni GROUP BY site")
def train_test_shift(spark, sf):
    s = Q.train_test_shift(nights(spark, sf), "usable_era5")
    return s.select("site", r6("train_rate").alias("train_rate"), "train_n", r6("test_rate").alias("test_rate"), "test_n")


@q("test_sufficiency", "Q9", "SELECT count(*) AS n, count(*) >= 300 AS enough FROM dat WHERE lead = 1 AND split = 'test' AND usable_era5 IS NOT NULL AND n_models_available > 0")
def test_sufficiency(spark, sf):
    return Q.test_sufficiency(dataset(spark, sf), "usable_era5")


@query("climatology_comparison", "Q10 Q15", with_(LNG) + f""", u AS (SELECT site, count(DISTINCT year) AS n_years, CAST(min(year) AS BIGINT) AS first_year, CAST(max(year) AS BIGINT) AS last_year FROM yr GROUP BY site),
  g AS (SELECT site, sum(rate * n) / sum(n) AS long_rate, CAST(sum(n) AS BIGINT) AS labelled_nights FROM rt WHERE label = 'primary' GROUP BY site),
  t AS (SELECT site, avg(CAST(usable_primary AS DOUBLE)) AS train_rate FROM ln WHERE year(night_date) >= 2000 GROUP BY site)
  SELECT site, n_years, first_year, last_year, labelled_nights, {R('long_rate')} AS long_rate, {R('train_rate')} AS train_rate FROM u LEFT JOIN g USING (site) LEFT JOIN t USING (site)""")
def climatology_comparison(spark, sf):
    n = long_nights(spark, sf)
    years = V.usable_years(n, "usable_primary", 0.8)
    rates = V.rate_tables(n, years, {"primary": "usable_primary"})
    recent = n.withColumn("split", F.when(F.year("night_date") >= 2000, "train").otherwise("none"))
    c = Q.climatology_comparison(rates, years, recent, "usable_primary")
    return c.select("site", "n_years", big("first_year").alias("first_year"), big("last_year").alias("last_year"), "labelled_nights", r6("long_rate").alias("long_rate"), r6("train_rate").alias("train_rate"))


@query("reference_years", "Q15", with_(LNG) + "SELECT site, CAST(count(DISTINCT year) AS BIGINT) AS years, 'long_term' AS source FROM yr GROUP BY site")
def reference_years(spark, sf):
    return Q.reference_used(V.usable_years(long_nights(spark, sf), "usable_primary", 0.8)).select("site", big("years").alias("years"), "source")


@query("crosscheck_distances", "Q12", f"""SELECT l_returnflag AS grp, count(*) AS n, max(l_extendedprice) AS max, {R('avg(CASE WHEN l_extendedprice <= 10000 THEN 1.0 ELSE 0.0 END)')} AS within_10000, {R('avg(CASE WHEN l_extendedprice <= 50000 THEN 1.0 ELSE 0.0 END)')} AS within_50000,
  {R('quantile_cont(l_extendedprice, 0.5)')} AS median, {R('quantile_cont(l_extendedprice, 0.95)')} AS p95 FROM lineitem GROUP BY 1""")
def crosscheck_distances(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice")
    c = Q.crosscheck_distances(li, ["grp"], "l_extendedprice", [10000, 50000])
    return c.select("grp", "n", "max", *[r6(x).alias(x) for x in ("within_10000", "within_50000", "median", "p95")])


CENTRES = f"""ct AS (SELECT l_orderkey, l_linenumber, l_returnflag AS county, CASE l_linenumber % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'town' ELSE 'community' END AS kind, CASE WHEN l_suppkey % 3 = 0 THEN 'populated' ELSE 'geonames' END AS point,
  34 + l_quantity / 10 AS lat, -120 + l_partkey % 50 / 10.0 AS lon, 34 + l_quantity / 10 + l_discount / 4 AS lat_internal, -120 + l_partkey % 50 / 10.0 + l_tax / 5 AS lon_internal, l_linenumber * 1.5 AS land_km2,
  CASE WHEN l_partkey % 5 > 0 THEN l_quantity / 8 END AS check_km, CASE WHEN l_partkey % 7 > 0 THEN l_extendedprice / 50 END AS elevation_m, CASE WHEN l_suppkey % 9 > 0 THEN l_extendedprice / 50 + l_quantity - 20 END AS other_m FROM lineitem),
sp AS (SELECT *, {hav('lat', 'lon', 'lat_internal', 'lon_internal')} / sqrt(greatest(land_km2, 0.01) / pi()) AS radii FROM ct)"""


def centres(spark, sf):
    """Line items as places with two centres, a match distance and two heights, some of them missing."""
    li, q, p, s = table(spark, sf, "lineitem"), F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey")
    n, lat, lon = F.col("l_linenumber"), 34 + F.col("l_quantity") / 10, -120 + F.col("l_partkey") % 50 / 10.0
    return li.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("county"), F.when(n % 4 == 0, "city").when(n % 4 == 1, "town").otherwise("community").alias("kind"), F.when(s % 3 == 0, "populated").otherwise("geonames").alias("point"),
        lat.alias("lat"), lon.alias("lon"), (lat + F.col("l_discount") / 4).alias("lat_internal"), (lon + F.col("l_tax") / 5).alias("lon_internal"), (n * 1.5).alias("land_km2"),
        F.when(p % 5 > 0, q / 8).alias("check_km"), F.when(p % 7 > 0, F.col("l_extendedprice") / 50).alias("elevation_m"), F.when(s % 9 > 0, F.col("l_extendedprice") / 50 + q - 20).alias("other_m"),
    )


@query("crosscheck_boundaries", "Q12", with_(CENTRES) + f"SELECT county, count(*) AS n, {R('avg(CASE WHEN radii <= 1 THEN 1.0 ELSE 0.0 END)')} AS share_within_1, {R('avg(CASE WHEN radii <= 2 THEN 1.0 ELSE 0.0 END)')} AS share_within_2, {R('quantile_cont(radii, 0.5)')} AS median FROM sp GROUP BY county")
def crosscheck_boundaries(spark, sf):
    c = Q.boundary_check(centres(spark, sf), ["county"])
    return c.select("county", "n", *[r6(x).alias(x) for x in ("share_within_1", "share_within_2", "median")])


@query("crosscheck_outside", "Q12", with_(CENTRES) + f"SELECT l_orderkey, l_linenumber, county, {R('radii')} AS radii FROM sp WHERE radii > 2")
def crosscheck_outside(spark, sf):
    out = Q.over_limit(Q.boundary_radii(centres(spark, sf)), "radii", 2.0, ["l_orderkey", "l_linenumber", "county"])
    return out.select("l_orderkey", "l_linenumber", "county", r6("value_exact").alias("radii"))


@query("crosscheck_heights", "Q12", with_(CENTRES) + f"SELECT county, count(abs(elevation_m - other_m)) AS n, {R('avg(CASE WHEN abs(elevation_m - other_m) <= 25 THEN 1.0 WHEN elevation_m - other_m IS NOT NULL THEN 0.0 END)')} AS share_within, CAST(sum(CASE WHEN elevation_m IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, {R('quantile_cont(abs(elevation_m - other_m), 0.5)')} AS median_abs, {R('quantile_cont(abs(elevation_m - other_m), 0.95)')} AS p95_abs FROM ct GROUP BY county")
def crosscheck_heights(spark, sf):
    e = Q.elevation_check(centres(spark, sf), ["county"], "elevation_m", "other_m")
    return e.select("county", "n", r6("share_within").alias("share_within"), big("missing").alias("missing"), r6("median_abs").alias("median_abs"), r6("p95_abs").alias("p95_abs"))


@query("crosscheck_disagree", "Q12", with_(CENTRES) + f"SELECT county, l_orderkey, l_linenumber, {R('round(check_km, 1)')} AS check_km FROM ct WHERE check_km > 5")
def crosscheck_disagree(spark, sf):
    out = Q.over_limit(centres(spark, sf), "check_km", 5.0, ["county", "l_orderkey", "l_linenumber"])
    return out.select("county", "l_orderkey", "l_linenumber", r6("check_km").alias("check_km"))


@query("crosscheck_counts", "Q12", with_(CENTRES) + "SELECT county, count(*) AS n_places, CAST(sum(CASE WHEN kind IN ('city', 'town') THEN 1 ELSE 0 END) AS BIGINT) AS n_incorporated, CAST(sum(CASE WHEN kind = 'community' THEN 1 ELSE 0 END) AS BIGINT) AS n_communities, CAST(sum(CASE WHEN point = 'populated' THEN 1 ELSE 0 END) AS BIGINT) AS centre_from_populated_place, count(check_km) AS n_matched FROM ct GROUP BY county")
def crosscheck_counts(spark, sf):
    return Q.place_counts(centres(spark, sf), ["county"])


# ---------- result tables ----------

PT = f"""pt AS (SELECT {GRP}, {', '.join(f'sum({c}) AS {c}' for c in (*V.SUMS, 'ref_sq'))}, count(*) AS n_weeks FROM wr GROUP BY {GRP}),
au AS ({AUC_SQL.format(k=GRP, rel="(SELECT * FROM sub WHERE kind = 'prob' AND family <> 'rule')")}),
rec AS (SELECT {GRP}, n, n_weeks, sy / n AS base_rate, {', '.join(f'{e} AS {m}' for m, e in METRICS.items())}, auc FROM pt LEFT JOIN au USING ({GRP}))"""
DIF = """dif AS (SELECT x.label, x.lead, x.method AS a, z.method AS b, x.brier - z.brier AS brier_diff FROM rec x JOIN rec z USING (label, lead, subset_type, subset) WHERE subset_type = 'overall' AND x.method <> z.method)"""
VERD = "CASE WHEN brier_diff IS NULL THEN 'not compared' WHEN brier_diff < 0 THEN 'better' ELSE 'worse' END"


def records(spark, sf):
    return V.score(predictions(spark, sf), resamples=0)


def brier_gaps(spark, sf):
    """Brier differences of every method pair, marked as decided (the interval test has its own query)."""
    r = records(spark, sf).filter("subset_type = 'overall'").select("label", "lead", "method", "brier")
    b = r.select("label", "lead", F.col("method").alias("b"), F.col("brier").alias("bb"))
    return r.withColumnRenamed("method", "a").join(b, ["label", "lead"]).filter("a <> b").select("label", "lead", "a", "b", (F.col("brier") - F.col("bb")).alias("brier_diff"), F.lit(True).alias("significant"))


def rq(name, covers, sql):
    return query(name, covers, with_(PRE, SUB, REF, PT, DIF) + sql)


@rq("headline_table", "Q13", "SELECT method, " + ", ".join(f"{R(c)} AS {c}" for c in ("brier", "bss", "log_loss", "auc", "false_clear_rate", "miss_rate")) + " FROM rec WHERE lead = 1 AND subset_type = 'overall' AND family <> 'rule'")
def headline_table(spark, sf):
    h = Q.headline(records(spark, sf), "primary", 1)
    return h.select("method", *[r6(c).alias(c) for c in h.columns if c != "method"])


@rq("hard_method_table", "Q13", "SELECT method, " + ", ".join(f"{R(c)} AS {c}" for c in ("false_clear_rate", "miss_rate", "accuracy")) + " FROM rec WHERE lead = 2 AND subset_type = 'overall' AND kind = 'hard'")
def hard_method_table(spark, sf):
    h = Q.hard_methods(records(spark, sf), "primary", 2)
    return h.select("method", *[r6(c).alias(c) for c in h.columns if c != "method"])


@rq("metric_by_lead", "Q13", "SELECT method, " + ", ".join(f"{R(f'max(CASE WHEN lead = {x} THEN bss END)')} AS \"L{x}\"" for x in (1, 2, 3)) + " FROM rec WHERE subset_type = 'overall' AND kind = 'prob' GROUP BY method")
def metric_by_lead(spark, sf):
    m = Q.metric_by_lead(records(spark, sf), "primary", "bss", [1, 2, 3])
    return m.select("method", *[r6(f"L{x}").alias(f"L{x}") for x in (1, 2, 3)])


def _pick(m, c):
    return f"max(CASE WHEN method = '{m}' THEN {c} END)"


@rq("season_breakdown", "Q13", f"SELECT subset, CAST(max(n) AS BIGINT) AS n, max(n_weeks) AS weeks, {R('max(base_rate)')} AS base_rate, " + ", ".join(f"{R(_pick(m, c))} AS {c}_{m}" for m in ("blend", "persistence") for c in ("bss", "false_clear_rate")) + " FROM rec WHERE lead = 1 AND subset_type = 'season' GROUP BY subset")
def season_breakdown(spark, sf):
    b = Q.breakdown(records(spark, sf), "primary", 1, "season", ["blend", "persistence"])
    return b.select("subset", big("n").alias("n"), "weeks", *[r6(c).alias(c) for c in b.columns if c not in ("subset", "n", "weeks")])


@rq("label_sensitivity", "Q13", f"SELECT method, {R('max(CASE WHEN label = {0} THEN bss END)'.format(chr(39) + 'primary' + chr(39)))} AS \"primary\" FROM rec WHERE lead = 1 AND subset_type = 'overall' AND kind = 'prob' GROUP BY method")
def label_sensitivity(spark, sf):
    return Q.label_sensitivity(records(spark, sf), 1, ["primary"]).select("method", r6("primary").alias("primary"))


@rq("cross_truth_table", "Q13", f"""SELECT r.label, {R('max(base_rate)')} AS base_rate, {R(_pick('blend', 'auc'))} AS auc, {R(_pick('climatology', 'auc'))} AS auc_rival, {R(_pick('blend', 'bss'))} AS bss, {R(_pick('climatology', 'bss'))} AS bss_rival,
  {R(_pick('blend', 'false_clear_rate'))} AS false_clear_rate, {R('max(d.brier_diff)')} AS brier_diff FROM rec r JOIN dif d ON d.label = r.label AND d.lead = r.lead AND d.a = 'blend' AND d.b = 'climatology' WHERE r.lead = 1 AND subset_type = 'overall' GROUP BY r.label""")
def cross_truth_table(spark, sf):
    c = Q.cross_truth(records(spark, sf), brier_gaps(spark, sf), 1, "blend", "climatology").drop("significant")
    return c.select("label", *[r6(x).alias(x) for x in c.columns if x != "label"])


@rq("blend_by_lead", "Q13", f"SELECT r.label, r.lead, {R('bss')} AS bss, {R('false_clear_rate')} AS false_clear_rate, {R('brier_diff')} AS brier_diff, {VERD} AS verdict FROM rec r LEFT JOIN dif d ON d.label = r.label AND d.lead = r.lead AND d.a = 'blend' AND d.b = 'persistence' WHERE method = 'blend' AND subset_type = 'overall'")
def blend_by_lead(spark, sf):
    b = Q.blend_by_lead(records(spark, sf), brier_gaps(spark, sf), "blend", "persistence")
    return b.select("label", "lead", r6("bss").alias("bss"), r6("false_clear_rate").alias("false_clear_rate"), r6("brier_diff").alias("brier_diff"), "verdict")


@query("value_table", "Q14 M13", with_(PRE, """cu AS (SELECT label, lead, method, c.i * 5 / 100.0::DOUBLE AS a, count(*) AS n, sum(y) AS pos, sum(CASE WHEN p >= c.i * 5 / 100.0::DOUBLE THEN 1 ELSE 0 END) AS go,
  sum(CASE WHEN p >= c.i * 5 / 100.0::DOUBLE AND y = 1 THEN 1 ELSE 0 END) AS tp, c.i FROM pre, (SELECT unnest([2, 4, 6, 10]) AS i) c GROUP BY ALL),
  v AS (SELECT *, CASE WHEN least(a, pos / n) > a * pos / n THEN (least(a, pos / n) - (a * go + pos - tp) / n) / (least(a, pos / n) - a * pos / n) END AS value FROM cu)""")
       + "SELECT label, lead, method, " + ", ".join(f"{R(f'max(CASE WHEN i = {i} THEN value END)')} AS a_{n}" for i, n in ((2, "0_1"), (4, "0_2"), (6, "0_3"), (10, "0_5"))) + " FROM v GROUP BY label, lead, method")
def value_table(spark, sf):
    c = V.relative_value(predictions(spark, sf), ["label", "lead", "method"])
    v = Q.value_table(c, (0.1, 0.2, 0.3, 0.5))
    return v.select("label", "lead", "method", *[r6(x).alias(x) for x in ("a_0_1", "a_0_2", "a_0_3", "a_0_5")])


@rq("station_table", "J26 Q14", f""", st AS (SELECT DISTINCT o_orderpriority AS site, 'R' || substr(o_orderpriority, 1, 1) AS region FROM orders)
  SELECT site, region, lead, {R('bss')} AS bss, {R('false_clear_rate')} AS false_clear_rate, CAST(n AS BIGINT) AS n FROM rec JOIN st ON st.site = subset WHERE subset_type = 'site' AND method = 'blend'""")
def station_table(spark, sf):
    st = stations(spark, sf)
    return Q.station_table(st, records(spark, sf), "blend").select("site", "region", "lead", r6("bss").alias("bss"), r6("false_clear_rate").alias("false_clear_rate"), big("n").alias("n"))


def stations(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("site")).distinct().withColumn("region", F.concat(F.lit("R"), F.substring("site", 1, 1)))


@rq("region_table", "J26 Q14", f""", st AS (SELECT DISTINCT o_orderpriority AS site FROM orders), rg AS (SELECT lead, subset AS region, CAST(max(n) AS BIGINT) AS nights, {_pick('blend', 'bss')} AS skill, {_pick('persistence', 'bss')} AS other, 1 - {_pick('blend', 'false_clear_rate')} AS held FROM rec WHERE subset_type = 'site' GROUP BY ALL)
  SELECT lead, region, nights, {R('skill')} AS skill, {R('other')} AS skill_other, {R('held')} AS go_held, CAST(1 AS BIGINT) AS stations, row_number() OVER (PARTITION BY lead ORDER BY skill DESC, region) AS place FROM rg""")
def region_table(spark, sf):
    regions = stations(spark, sf).select("site", F.col("site").alias("region"))
    r = records(spark, sf).withColumn("subset_type", F.when(F.col("subset_type") == "site", "region").otherwise(F.col("subset_type")))
    t = Q.region_table(regions, r, "blend", "persistence")
    return t.select("lead", "region", "nights", r6("skill").alias("skill"), r6("skill_other").alias("skill_other"), r6("go_held").alias("go_held"), "stations", big("place").alias("place"))
