"""Queries over the verification operators: baselines, scores, intervals, reliability, value."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightfold.operators import verify as V
from nightfold.operators.nights import LABELS
from nightfold.plans.derived import FULL, R, SEASON_SQL, big, dataset, r6, table, text, with_
from nightfold.plans.registry import query
from nightfold.util import cut_lineage

RESAMPLES, SEED = 1000, 7
NIGHT = "strftime(night_date, '%Y-%m-%d %H:%M:%S') AS night_date"


def predictions(spark, sf):
    """Four methods' forecasts for every order, scored on whether the order was finished."""
    o = table(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    from nightfold.functions.timefn import season

    rows = o.select(
        F.lit("primary").alias("label"), (1 + F.col("o_custkey") % 3).cast("int").alias("lead"), F.col("o_orderpriority").alias("site"),
        d.alias("night_date"), season(F.month(d)).alias("season"), F.month(d).alias("month"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice", "o_custkey", "o_orderkey",
    )
    y, price = F.col("y"), F.col("o_totalprice")
    blend = F.round(F.least(F.lit(0.98), 0.01 + price / 900000.0 + 0.3 * y), 3)
    return V.to_predictions(
        rows,
        {
            "climatology": ("prob", "climatology", 0.3 + F.col("month") / 100.0),
            "blend": ("prob", "blend", blend),
            "persistence": ("hard", "persistence", (F.col("o_custkey") % 2).cast("double")),
            "gfs_rule": ("hard", "rule", (price > 250000).cast("double")),
        },
        ["label", "lead", "site", "night_date", "season", "y"],
    )


PRE = f"""o AS (SELECT 'primary' AS label, CAST(1 + o_custkey % 3 AS INTEGER) AS lead, o_orderpriority AS site, CAST(o_orderdate AS DATE) AS night_date,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, month(o_orderdate) AS month, o_totalprice AS price, o_custkey AS ck,
  {SEASON_SQL.format('o_orderdate')} AS season, isoyear(o_orderdate) * 100 + weekofyear(o_orderdate) AS week FROM orders),
pre AS (SELECT *, 'climatology' AS method, 'prob' AS kind, 'climatology' AS family, 0.3::DOUBLE + month / 100.0::DOUBLE AS p FROM o UNION ALL
  SELECT *, 'blend', 'prob', 'blend', round(least(0.98::DOUBLE, 0.01::DOUBLE + price / 900000.0::DOUBLE + 0.3::DOUBLE * y), 3) FROM o UNION ALL
  SELECT *, 'persistence', 'hard', 'persistence', CAST(ck % 2 AS DOUBLE) FROM o UNION ALL
  SELECT *, 'gfs_rule', 'hard', 'rule', CASE WHEN price > 250000 THEN 1.0 ELSE 0.0 END FROM o)"""
SUB = """sub AS (SELECT *, 'overall' AS subset_type, 'all' AS subset FROM pre UNION ALL SELECT *, 'site', site FROM pre UNION ALL SELECT *, 'season', season FROM pre)"""
SUMS = """count(*) AS n, sum(y) AS sy, sum((p - y) * (p - y)) AS sq,
  sum(-(y * ln(greatest(0.001, least(0.999, p))) + (1 - y) * ln(1 - greatest(0.001, least(0.999, p))))) AS ll,
  sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN p < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS hit"""
GRP = "label, lead, method, kind, family, subset_type, subset"
REF = f"""wk AS (SELECT {GRP}, week, {SUMS} FROM sub GROUP BY {GRP}, week),
wr AS (SELECT a.*, b.sq AS ref_sq FROM wk a JOIN wk b ON b.method = 'climatology' AND a.label = b.label AND a.lead = b.lead AND a.subset_type = b.subset_type AND a.subset = b.subset AND a.week = b.week)"""
METRICS = {
    "brier": "CASE WHEN family <> 'rule' THEN sq / n END",
    "bss": "CASE WHEN family <> 'rule' THEN 1 - sq / ref_sq END",
    "log_loss": "CASE WHEN kind = 'prob' AND family <> 'rule' THEN ll / n END",
    "false_clear_rate": "fp / nullif(tp + fp, 0)",
    "miss_rate": "fn / nullif(tp + fn, 0)",
    "accuracy": "hit / n",
}
WEIGHTS = f"""wks AS (SELECT label, lead, week, row_number() OVER (PARTITION BY label, lead ORDER BY week) - 1 AS i FROM (SELECT DISTINCT label, lead, week FROM pre)),
nw AS (SELECT label, lead, count(*) AS n FROM wks GROUP BY ALL),
dr AS (SELECT label, lead, r, CAST('0x' || substr(md5('{SEED}|' || r || '|' || s), 1, 8) AS BIGINT) % n AS i FROM (SELECT *, unnest(range(n)) AS s FROM (SELECT *, unnest(range({RESAMPLES})) AS r FROM nw))),
wt AS (SELECT d.label, d.lead, d.r, w.week, count(*) AS w FROM dr d JOIN wks w ON w.label = d.label AND w.lead = d.lead AND w.i = d.i GROUP BY ALL)"""
AUC_SQL = """SELECT {k}, sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM
  (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
    (SELECT {k}, p, sum(y) AS pos, sum(1 - y) AS neg FROM {rel} GROUP BY {k}, p)) GROUP BY {k}"""


@query("score_records", "M7 M9 M10 M6 W9 M8 F6", with_(PRE, SUB, REF, WEIGHTS) + f""", bt AS (SELECT {', '.join('a.' + c for c in GRP.split(', '))}, t.r, {', '.join(f'sum(a.{c} * t.w) AS {c}' for c in (*V.SUMS, 'ref_sq'))}
    FROM wr a JOIN wt t ON t.label = a.label AND t.lead = a.lead AND t.week = a.week GROUP BY ALL),
  ci AS (SELECT {GRP}, {', '.join(f'quantile_cont({e}, {q}) AS {m}_{s}' for m, e in METRICS.items() for s, q in (('lo', 0.025), ('hi', 0.975)))} FROM bt GROUP BY {GRP}),
  pt AS (SELECT {GRP}, {', '.join(f'sum({c}) AS {c}' for c in (*V.SUMS, 'ref_sq'))}, count(*) AS n_weeks FROM wr GROUP BY {GRP}),
  au AS ({AUC_SQL.format(k=GRP, rel="(SELECT * FROM sub WHERE kind = 'prob' AND family <> 'rule')")})
  SELECT p.label, p.lead, p.method, p.kind, p.family, p.subset_type, p.subset, CAST(p.n AS BIGINT) AS n, n_weeks, {R('sy / n')} AS base_rate, {R('au.auc')} AS auc,
  {', '.join(f'{R(e)} AS {m}' for m, e in METRICS.items())}, {', '.join(f'CASE WHEN n_weeks >= 8 THEN {R(f"{m}_{s}")} END AS {m}_{s}' for m in METRICS for s in ('lo', 'hi'))}
  FROM pt p JOIN ci USING (label, lead, method, kind, family, subset_type, subset) LEFT JOIN au USING (label, lead, method, kind, family, subset_type, subset)""")
def score_records(spark, sf):
    s = V.score(predictions(spark, sf), RESAMPLES, SEED)
    keep = ["label", "lead", "method", "kind", "family", "subset_type", "subset", "n_weeks"]
    return s.select(*keep, big("n").alias("n"), *[r6(c).alias(c) for c in s.columns if c not in (*keep, "n")])


@query("paired_differences", "M11", with_(PRE, WEIGHTS) + f""", w AS (SELECT label, lead, method, week, count(*) AS n, sum((p - y) * (p - y)) AS sq FROM pre GROUP BY ALL),
  pr AS (SELECT * FROM (VALUES ('blend', 'climatology'), ('persistence', 'climatology'), ('blend', 'persistence')) t(a, b)),
  bo AS (SELECT x.label, x.lead, x.week, pr.a, pr.b, x.n AS na, x.sq AS sa, z.n AS nb, z.sq AS sb FROM pr JOIN w x ON x.method = pr.a JOIN w z ON z.method = pr.b AND z.label = x.label AND z.lead = x.lead AND z.week = x.week),
  pt AS (SELECT label, lead, a, b, sum(sa) / sum(na) - sum(sb) / sum(nb) AS d FROM bo GROUP BY ALL),
  bt AS (SELECT o.label, o.lead, a, b, r, sum(sa * t.w) / sum(na * t.w) - sum(sb * t.w) / sum(nb * t.w) AS d FROM bo o JOIN wt t ON t.label = o.label AND t.lead = o.lead AND t.week = o.week GROUP BY ALL),
  ci AS (SELECT label, lead, a, b, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END) AS s FROM bt GROUP BY ALL)
  SELECT label, lead, a, b, {R('d')} AS brier_diff, {R('lo')} AS lo, {R('hi')} AS hi, {R('s')} AS share_a_better, hi < 0 OR lo > 0 AS significant FROM pt JOIN ci USING (label, lead, a, b)""")
def paired_differences(spark, sf):
    pairs = spark.createDataFrame([("blend", "climatology"), ("persistence", "climatology"), ("blend", "persistence")], "a string, b string")
    p = V.paired(predictions(spark, sf), pairs, RESAMPLES, SEED)
    return p.select("label", "lead", "a", "b", *[r6(c).alias(c) for c in ("brier_diff", "lo", "hi", "share_a_better")], "significant")


@query("win_lists", "A26", with_(PRE) + """, w AS (SELECT label, lead, method, avg((p - y) * (p - y)) AS b FROM pre GROUP BY ALL),
  d AS (SELECT x.label, x.lead, x.method AS a, z.method AS b, x.b < z.b AS better FROM w x JOIN w z USING (label, lead) WHERE x.method <> z.method)
  SELECT label, a, b, list_sort(coalesce(list(lead) FILTER (better), [])) AS better, list_sort(coalesce(list(lead) FILTER (NOT better), [])) AS not_better, CAST(sum(CASE WHEN better THEN 1 ELSE 0 END) AS BIGINT) AS wins, count(*) AS total FROM d GROUP BY ALL""")
def win_lists(spark, sf):
    w = predictions(spark, sf).groupBy("label", "lead", "method").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("s"))
    d = w.withColumnRenamed("method", "a").join(w.select("label", "lead", F.col("method").alias("b"), F.col("s").alias("t")), ["label", "lead"]).filter("a <> b")
    return V.win_lists(d.select("label", "lead", "a", "b", (F.col("s") - F.col("t")).alias("brier_diff"), F.lit(True).alias("significant")))


@query("auc_by_method", "M8 W9", with_(PRE) + f"SELECT label, lead, method, {R('auc')} AS auc FROM ({AUC_SQL.format(k='label, lead, method', rel='pre')})")
def auc_by_method(spark, sf):
    return V.auc(predictions(spark, sf), ["label", "lead", "method"]).select("label", "lead", "method", r6("auc").alias("auc"))


@query("auc_intervals", "M8 M6", with_(PRE, WEIGHTS) + f""", pw AS (SELECT label, lead, method, p, week, sum(y) AS pos, sum(1 - y) AS neg FROM pre WHERE kind = 'prob' GROUP BY ALL),
  x AS (SELECT a.label, a.lead, a.method, t.r, a.p, sum(pos * t.w) AS pos, sum(neg * t.w) AS neg FROM pw a JOIN wt t ON t.label = a.label AND t.lead = a.lead AND t.week = a.week GROUP BY ALL),
  y AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY label, lead, method, r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM x),
  z AS (SELECT label, lead, method, r, sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM y GROUP BY ALL)
  SELECT label, lead, method, {R('quantile_cont(auc, 0.025)')} AS auc_lo, {R('quantile_cont(auc, 0.975)')} AS auc_hi FROM z GROUP BY label, lead, method""")
def auc_intervals(spark, sf):
    prob = predictions(spark, sf).filter("kind = 'prob'")
    return V.bootstrap_auc(prob, ["label", "lead", "method"], RESAMPLES, SEED).select("label", "lead", "method", r6("auc_lo").alias("auc_lo"), r6("auc_hi").alias("auc_hi"))


EDGE = "[" + ", ".join(repr(e) + "::DOUBLE" for e in V.BINS[1:-1]) + "]"
BIN_SQL = f"len(list_filter({EDGE}, lambda e: e <= p))"


@query("reliability_bins", "M12", with_(PRE) + f""", b AS (SELECT label, lead, method, {BIN_SQL} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed FROM pre GROUP BY ALL),
  k AS (SELECT DISTINCT label, lead, method, unnest(range(10)) AS bin FROM pre)
  SELECT k.label, k.lead, k.method, CAST(k.bin AS BIGINT) AS bin, coalesce(n, 0) AS n, {R('mean_p')} AS mean_p, {R('observed')} AS observed FROM k LEFT JOIN b USING (label, lead, method, bin)""")
def reliability_bins(spark, sf):
    r = V.reliability(predictions(spark, sf), ["label", "lead", "method"])
    return r.select("label", "lead", "method", big("bin").alias("bin"), "n", r6("mean_p").alias("mean_p"), r6("observed").alias("observed"))


@query("brier_parts", "M12 M19", with_(PRE) + f""", b AS (SELECT label, lead, method, {BIN_SQL} AS bin, count(*) AS n, avg(p) AS f, avg(y) AS o, sum((p - y) * (p - y)) AS sq FROM pre GROUP BY ALL),
  t AS (SELECT label, lead, method, sum(n) AS n, sum(n * o) / sum(n) AS base FROM b GROUP BY ALL),
  d AS (SELECT label, lead, method, any_value(t.base) AS base, any_value(t.n) AS n, sum(b.sq) / any_value(t.n) AS brier, sum(b.n * (f - o) * (f - o)) / any_value(t.n) AS rel, sum(b.n * (o - base) * (o - base)) / any_value(t.n) AS res,
    sum(b.n * abs(o - f)) / any_value(t.n) AS ece FROM b JOIN t USING (label, lead, method) GROUP BY label, lead, method)
  SELECT label, lead, method, CAST(n AS BIGINT) AS n, {R('brier')} AS brier, {R('rel')} AS reliability, {R('res')} AS resolution, {R('base * (1 - base)')} AS uncertainty, {R('brier - (rel - res + base * (1 - base))')} AS binning_residual, {R('ece')} AS ece FROM d""")
def brier_parts(spark, sf):
    d = V.brier_decomposition(predictions(spark, sf), ["label", "lead", "method"])
    return d.select("label", "lead", "method", big("n").alias("n"), *[r6(c).alias(c) for c in ("brier", "reliability", "resolution", "uncertainty", "binning_residual", "ece")])


CUTS = """cu AS (SELECT label, lead, method, c.i * 5 / 100.0::DOUBLE AS cut, count(*) AS n, sum(y) AS pos, sum(CASE WHEN p >= c.i * 5 / 100.0::DOUBLE THEN 1 ELSE 0 END) AS go,
  sum(CASE WHEN p >= c.i * 5 / 100.0::DOUBLE AND y = 1 THEN 1 ELSE 0 END) AS tp FROM pre, (SELECT unnest(range(1, 20)) AS i) c GROUP BY ALL)"""


@query("economic_value", "M13", with_(PRE, CUTS) + f"""SELECT label, lead, method, cut AS alpha, {R('CASE WHEN least(cut, pos / n) > cut * pos / n THEN (least(cut, pos / n) - (cut * go + pos - tp) / n) / (least(cut, pos / n) - cut * pos / n) END')} AS value FROM cu""")
def economic_value(spark, sf):
    return V.relative_value(predictions(spark, sf), ["label", "lead", "method"]).select("label", "lead", "method", "alpha", r6("value").alias("value"))


@query("threshold_curve", "M13 M9", with_(PRE, CUTS) + f"""SELECT label, lead, method, cut AS threshold, {R('go / n')} AS go_rate, {R('(go - tp) / nullif(go, 0)')} AS false_clear_rate, {R('(pos - tp) / nullif(pos, 0)')} AS miss_rate FROM cu""")
def threshold_curve(spark, sf):
    t = V.threshold_curve(predictions(spark, sf), ["label", "lead", "method"])
    return t.select("label", "lead", "method", "threshold", *[r6(c).alias(c) for c in ("go_rate", "false_clear_rate", "miss_rate")])


# ---------- baselines on the modelling table ----------

TRN = "tr AS (SELECT DISTINCT site, night_date, month, usable_era5 AS y FROM dat WHERE split = 'train' AND usable_era5 IS NOT NULL), cl AS (SELECT site, month, avg(CAST(y AS DOUBLE)) AS rate, count(*) AS n FROM tr GROUP BY ALL)"


@query("climatology_table", "A8 M15", with_(*FULL, TRN) + f"SELECT site, CAST(month AS BIGINT) AS month, {R('rate')} AS rate, n FROM cl")
def climatology_table(spark, sf):
    t = V.climatology(dataset(spark, sf).filter("split = 'train'"), "usable_era5")
    return t.select("site", big("month").alias("month"), r6("rate").alias("rate"), "n")


@query("climatology_forecast", "J5 M15", with_(PRE) + f""", tr AS (SELECT DISTINCT site, night_date, month FROM o WHERE month % 5 <> 0), ty AS (SELECT site, night_date, month, max(y) AS y FROM o GROUP BY ALL),
  cl AS (SELECT site, month, avg(y) AS rate FROM ty JOIN tr USING (site, night_date, month) GROUP BY ALL), st AS (SELECT site, avg(rate) AS r FROM cl GROUP BY ALL)
  SELECT o.site, o.month::BIGINT AS month, count(*) AS n, {R('max(coalesce(cl.rate, st.r))')} AS p_climatology FROM o LEFT JOIN cl USING (site, month) LEFT JOIN st USING (site) GROUP BY ALL""")
def climatology_forecast(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("night_date"), F.month("o_orderdate").alias("month"), (F.col("o_orderstatus") == "F").cast("int").alias("y")
    )
    nights = o.groupBy("site", "night_date", "month").agg(F.max("y").alias("y"))
    t = V.climatology(nights.filter("month % 5 <> 0"), "y")
    return V.apply_climatology(o, t).groupBy("site", big("month").alias("month")).agg(F.count("*").alias("n"), r6(F.max("p_climatology")).alias("p_climatology"))


PER = "per AS (SELECT d.*, e.usable_era5 AS persistence FROM dat d LEFT JOIN (SELECT DISTINCT site, night_date, usable_era5 FROM dat) e ON e.site = d.site AND e.night_date = d.night_date - d.lead)"


@query("persistence_forecast", "J4 M15", with_(*FULL, PER) + f"SELECT site, {NIGHT}, lead, persistence FROM per")
def persistence_forecast(spark, sf):
    d = cut_lineage(dataset(spark, sf))
    return V.persistence(d, d, "usable_era5").select("site", text("night_date").alias("night_date"), "lead", "persistence")


@query("evaluation_rows", "P9 J24 P12", with_(*FULL, PER) + f"SELECT site, {NIGHT}, lead FROM per WHERE usable_era5 IS NOT NULL AND gfs_frac_clear IS NOT NULL AND nbm_frac_clear IS NOT NULL AND gfs_pred_usable IS NOT NULL AND persistence IS NOT NULL")
def evaluation_rows(spark, sf):
    d = cut_lineage(dataset(spark, sf))
    e = V.evaluation_rows(V.persistence(d, d, "usable_era5"), "usable_era5", ["gfs_frac_clear", "nbm_frac_clear", "gfs_pred_usable"])
    return e.select("site", text("night_date").alias("night_date"), "lead")


@query("training_rows", "P10", with_(*FULL) + f"SELECT site, {NIGHT}, lead FROM dat WHERE usable_era5 IS NOT NULL AND n_models_available > 0")
def training_rows(spark, sf):
    return V.training_rows(dataset(spark, sf), "usable_era5").select("site", text("night_date").alias("night_date"), "lead")


@query("labels_available", "P11", with_(*FULL) + """, l AS (SELECT split, 'primary' AS label, usable_primary AS y FROM dat WHERE lead = 1 UNION ALL SELECT split, 'asos', usable_asos FROM dat WHERE lead = 1 UNION ALL SELECT split, 'era5', usable_era5 FROM dat WHERE lead = 1 UNION ALL SELECT split, 'goes', usable_goes FROM dat WHERE lead = 1),
  c AS (SELECT label, count(CASE WHEN split = 'train' THEN y END) AS train, count(CASE WHEN split = 'test' THEN y END) AS test FROM l GROUP BY 1) SELECT * FROM c WHERE train >= 10 AND test >= 10""")
def labels_available(spark, sf):
    return V.labels_available(dataset(spark, sf), LABELS, minimum=10)


@query("leak_check", "M1", with_(PRE) + """, s AS (SELECT site, max(CASE WHEN month(night_date) <= 6 THEN night_date END) AS a, min(CASE WHEN month(night_date) > 6 THEN night_date END) AS b FROM o GROUP BY 1)
  SELECT site, CAST(a AS VARCHAR) AS train_end, CAST(b AS VARCHAR) AS test_start FROM s WHERE a >= b""")
def leak_check(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("night_date"))
    o = o.withColumn("split", F.when(F.month("night_date") <= 6, "train").otherwise("test"))
    return V.leak_check(o, ["site"]).select("site", F.col("train_end").cast("string").alias("train_end"), F.col("test_start").cast("string").alias("test_start"))


LNG = """ln AS (SELECT o_orderpriority AS site, CAST(o_orderdate AS DATE) AS night_date, max(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END) AS usable_primary, max(CASE WHEN o_totalprice > 50000 THEN o_totalprice > 300000 END) AS usable_asos FROM orders GROUP BY ALL),
yr AS (SELECT site, year(night_date) AS year, avg(CASE WHEN usable_primary IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage FROM ln GROUP BY ALL HAVING avg(CASE WHEN usable_primary IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.8),
rt AS (SELECT label, site, month, avg(CAST(y AS DOUBLE)) AS rate, count(*) AS n FROM (SELECT 'primary' AS label, site, month(night_date) AS month, usable_primary AS y FROM ln SEMI JOIN yr ON yr.site = ln.site AND yr.year = year(ln.night_date)
  UNION ALL SELECT 'asos', site, month(night_date), usable_asos FROM ln SEMI JOIN yr ON yr.site = ln.site AND yr.year = year(ln.night_date)) WHERE y IS NOT NULL GROUP BY ALL)"""


def long_nights(spark, sf):
    """A multi-year night table with two labels, from the orders."""
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("night_date")).agg(
        F.max(F.when(s != "P", s == "F")).alias("usable_primary"), F.max(F.when(p > 50000, p > 300000)).alias("usable_asos")
    )


@query("usable_years", "A9 M33", with_(LNG) + f"SELECT site, CAST(year AS BIGINT) AS year, {R('coverage')} AS coverage FROM yr")
def usable_years(spark, sf):
    return V.usable_years(long_nights(spark, sf), "usable_primary", 0.8).select("site", big("year").alias("year"), r6("coverage").alias("coverage"))


@query("long_climatology", "A10 M33 S14", with_(LNG) + f"SELECT label, site, CAST(month AS BIGINT) AS month, {R('rate')} AS rate, n FROM rt")
def long_climatology(spark, sf):
    n = long_nights(spark, sf)
    t = V.rate_tables(n, V.usable_years(n, "usable_primary", 0.8), {"primary": "usable_primary", "asos": "usable_asos"})
    return t.select("label", "site", big("month").alias("month"), r6("rate").alias("rate"), "n")


@query("base_rates_by_split", "A11", with_(*FULL) + f"SELECT site, split, {R('avg(CAST(y AS DOUBLE))')} AS base_rate, count(*) AS n FROM (SELECT DISTINCT site, split, night_date, usable_era5 AS y FROM dat WHERE split IN ('train', 'test') AND usable_era5 IS NOT NULL) GROUP BY ALL")
def base_rates_by_split(spark, sf):
    return V.base_rates_by_split(dataset(spark, sf), "usable_era5").select("site", "split", r6("base_rate").alias("base_rate"), "n")


@query("hourly_climatology", "J6 M21", with_(*FULL) + f""", h AS (SELECT b.site, month(b.night_date) AS month, s.cover <= 0.2 + 1e-9 AS y, b.night_date, b.hour FROM bb b JOIN (SELECT * FROM ser WHERE source = 'era5') s USING (site, hour)),
  c AS (SELECT site, month, avg(CAST(y AS DOUBLE)) AS rate FROM h WHERE night_date <= DATE '2024-01-20' AND site <> 'S1' AND y IS NOT NULL GROUP BY ALL), a AS (SELECT avg(CAST(y AS DOUBLE)) AS r FROM h WHERE night_date <= DATE '2024-01-20' AND site <> 'S1' AND y IS NOT NULL)
  SELECT site, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, {R('coalesce(rate, r)')} AS p_climatology FROM h LEFT JOIN c USING (site, month), a""")
def hourly_climatology(spark, sf):
    from nightfold.operators import timeseries as S
    from nightfold.plans.derived import series, windows

    b = S.backbone(windows(spark, sf), ["site", "night_date"], "dusk", "dawn")
    h = b.join(series(spark, sf).filter("source = 'era5'"), ["site", "hour"]).withColumn("month", F.month("night_date"))
    h = h.withColumn("clear", F.when(F.col("cover").isNotNull(), S.is_clear(F.col("cover"), 0.2)))
    train = h.filter("night_date <= date '2024-01-20' and site <> 'S1'")
    return V.hourly_climatology(h, train, "clear").select("site", text("hour").alias("hour"), r6("p_climatology").alias("p_climatology"))
