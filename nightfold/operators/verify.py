"""Baselines, scores and week-block intervals.

Scoring reduces rows to weekly partial sums once; point values, intervals, subsets and paired tests are
all computed from that small table. A prediction row has: label, lead, site, night_date, season, y (0/1),
method, kind ('prob' | 'hard'), family, p.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nightfold.functions.bounds import clip
from nightfold.functions.timefn import week_code
from nightfold.util import count_if, place_in_ranges, ranked_cumsum, ratio

P_CLIP = 1e-3
CASE = ["label", "lead"]
METHOD = [*CASE, "method", "kind", "family"]
SUMS = ("n", "sy", "sq", "ll", "tp", "fp", "fn", "hit")
BINS = [float(x) for x in np.linspace(0, 1, 11)]
ALPHAS = [i * 5 / 100 for i in range(1, 20)]


# ---------- baselines ----------


def climatology(rows: DataFrame, label: str, period: Sequence[str] = ("month",)) -> DataFrame:
    """(site, *period, rate, n): base rate of known labels, each night counted once (copies that differ count as true)."""
    nights = rows.filter(F.col(label).isNotNull()).groupBy("site", "night_date", *period).agg(F.max(label).alias("_y"))
    return nights.groupBy("site", *period).agg(F.avg(F.col("_y").cast("double")).alias("rate"), F.count("*").alias("n"))


def apply_climatology(rows: DataFrame, table: DataFrame, out: str = "p_climatology") -> DataFrame:
    """Rate of the row's (site, month); a month never seen falls back to the mean of the site's rates."""
    site = table.groupBy("site").agg(F.avg("rate").alias("_site_rate"))
    rate = table.select("site", "month", F.col("rate").alias("_rate"))
    joined = rows.join(rate, ["site", "month"], "left").join(site, "site", "left")
    return joined.withColumn(out, F.coalesce("_rate", "_site_rate")).drop("_rate", "_site_rate")


def hourly_climatology(rows: DataFrame, train: DataFrame, label: str, out: str = "p_climatology") -> DataFrame:
    """Rate of the (site, month); falls back to the overall rate."""
    known = train.filter(F.col(label).isNotNull())
    y = F.col(label).cast("double")
    rate = known.groupBy("site", "month").agg(F.avg(y).alias("_rate"))
    overall = known.agg(F.avg(y).alias("_all"))
    joined = rows.join(rate, ["site", "month"], "left").join(F.broadcast(overall))
    return joined.withColumn(out, F.coalesce("_rate", "_all")).drop("_rate", "_all")


def persistence(rows: DataFrame, nights: DataFrame, label: str, out: str = "persistence") -> DataFrame:
    """The site's own label exactly `lead` nights earlier (by date, so gaps give NULL); of copies that differ, a known
    one before NULL and true before false."""
    past = nights.groupBy("site", "night_date").agg(F.max(label).alias(out))
    now = rows.withColumn("_then", F.date_sub("night_date", F.col("lead")))
    return now.join(past.withColumnRenamed("night_date", "_then"), ["site", "_then"], "left").drop("_then")


def evaluation_rows(rows: DataFrame, label: str, needed: Iterable[str]) -> DataFrame:
    """Rows on which every method can be scored: label, every needed column and persistence known."""
    conds = [F.col(c).isNotNull() for c in (label, *needed, "persistence")]
    return rows.filter(reduce(lambda a, b: a & b, conds))


def training_rows(rows: DataFrame, label: str) -> DataFrame:
    return rows.filter(F.col(label).isNotNull() & (F.col("n_models_available") > 0))


def labels_available(rows: DataFrame, labels: dict[str, str], splits: Sequence[str] = ("train", "test"), minimum: int = 30) -> DataFrame:
    """Labels with at least `minimum` known nights in every split."""
    lowest = rows.agg(F.min("lead").alias("lead"))
    night = rows.join(F.broadcast(lowest), "lead", "left_semi")
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).alias("y")) for k, c in labels.items() if c in rows.columns])
    long = night.select("split", F.inline(pairs))
    agg = long.groupBy("label").agg(*[count_if((F.col("split") == s) & F.col("y").isNotNull()).alias(s) for s in splits])
    return agg.filter(reduce(lambda a, b: a & b, [F.col(s) >= minimum for s in splits]))


def leak_check(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keys whose last training date is not before their first test date (empty = no leak)."""
    agg = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("split") == "train", F.col("night_date"))).alias("train_end"),
        F.min(F.when(F.col("split") == "test", F.col("night_date"))).alias("test_start"),
    )
    return agg.filter(F.col("train_end") >= F.col("test_start"))


def usable_years(nights: DataFrame, label: str, min_coverage: float) -> DataFrame:
    """(site, year) with at least `min_coverage` of nights labelled."""
    cov = nights.groupBy("site", F.year("night_date").alias("year")).agg(
        F.avg(F.col(label).isNotNull().cast("double")).alias("coverage")
    )
    return cov.filter(F.col("coverage") >= min_coverage)


def rate_tables(nights: DataFrame, years: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(label, site, month, rate, n) from the usable years only."""
    kept = nights.withColumn("year", F.year("night_date")).join(years, ["site", "year"], "left_semi")
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).cast("double").alias("y")) for k, c in labels.items()])
    long = kept.select("site", F.month("night_date").alias("month"), F.inline(pairs)).filter("y is not null")
    return long.groupBy("label", "site", "month").agg(F.avg("y").alias("rate"), F.count("*").alias("n"))


def base_rates_by_split(rows: DataFrame, label: str) -> DataFrame:
    nights = rows.filter(F.col("split").isin("train", "test") & F.col(label).isNotNull())
    once = nights.groupBy("site", "split", "night_date").agg(F.max(label).alias("y"))
    return once.groupBy("site", "split").agg(F.avg(F.col("y").cast("double")).alias("base_rate"), F.count("*").alias("n"))


def to_predictions(rows: DataFrame, methods: dict[str, tuple[str, str, Column]], keep: Sequence[str]) -> DataFrame:
    """Long predictions from wide rows: {method: (kind, family, p)}."""
    many = F.array(*[
        F.struct(F.lit(m).alias("method"), F.lit(k).alias("kind"), F.lit(f).alias("family"), p.cast("double").alias("p"))
        for m, (k, f, p) in methods.items()
    ])
    return rows.select(*keep, F.inline(many))


# ---------- partial sums and metrics ----------


def collapsed(preds: DataFrame, by: Sequence[str] = ("site", "season")) -> DataFrame:
    """Equal forecasts of a method and week as one row (pos, neg: outcomes): weekly sums and AUC are both made of these."""
    y = F.col("y").cast("long")
    return preds.groupBy(*METHOD, *by, week_code(F.col("night_date")).alias("week"), "p").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def row_sums(threshold: float) -> list[Column]:
    """Aggregates of collapsed prediction rows, from which every metric but AUC follows."""
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    q = clip(p, P_CLIP, 1 - P_CLIP)
    where = lambda c, n: F.sum(F.when(c, n).otherwise(0)).cast("long")
    go = p >= threshold
    return [
        F.sum(pos + neg).alias("n"), F.sum(pos).cast("double").alias("sy"), F.sum(pos * (p - 1) * (p - 1) + neg * p * p).alias("sq"),
        F.sum(-(pos * F.log(q) + neg * F.log(1 - q))).alias("ll"),
        where(go, pos).alias("tp"), where(go, neg).alias("fp"), where(~go, pos).alias("fn"), F.sum(F.when(go, pos).otherwise(neg)).cast("long").alias("hit"),
    ]


def week_partials(collapsed_rows: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("site", "season")) -> DataFrame:
    """Sums per method, week and the columns that subsets will need."""
    return collapsed_rows.groupBy(*METHOD, *by, "week").agg(*row_sums(threshold))


def subset_partials(partials: DataFrame, by: Sequence[str] = ("site", "season")) -> DataFrame:
    """Weekly sums of each subset: everything, and each value of the `by` columns."""
    tags = [F.struct(F.lit("overall").alias("subset_type"), F.lit("all").alias("subset"))]
    tags += [F.struct(F.lit(c).alias("subset_type"), F.col(c).cast("string").alias("subset")) for c in by]
    wide = partials.select(*METHOD, "week", *SUMS, F.inline(F.array(*tags)))
    return wide.groupBy(*METHOD, "subset_type", "subset", "week").agg(*[F.sum(s).alias(s) for s in SUMS])


def with_reference(sums: DataFrame, keys: Sequence[str], reference: str = "climatology") -> DataFrame:
    """Adds the reference's squared-error sum of the same rows. Every method is scored on identical rows,
    so this joins a few sums, never the predictions."""
    ref = sums.filter(F.col("method") == reference).select(*keys, F.col("sq").alias("ref_sq"))
    return sums.join(ref, list(keys), "left")


def metric_columns() -> dict[str, Column]:
    """Metrics of a row of sums; those a method's kind or family does not have are NULL."""
    n, rule, prob = F.col("n"), F.col("family") == "rule", F.col("kind") == "prob"
    brier = ratio(F.col("sq"), n)
    return {
        "brier": F.when(~rule, brier),
        "bss": F.when(~rule, 1 - ratio(F.col("sq"), F.col("ref_sq"))),
        "log_loss": F.when(prob & ~rule, ratio(F.col("ll"), n)),
        "false_clear_rate": ratio(F.col("fp"), F.col("tp") + F.col("fp")),
        "miss_rate": ratio(F.col("fn"), F.col("tp") + F.col("fn")),
        "accuracy": ratio(F.col("hit"), n),
    }


def auc(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC AUC per key, ties counted half, without sorting any key in one task."""
    y = F.col("y").cast("long")
    return _auc(preds.select(*keys, "p", y.alias("pos"), (1 - y).alias("neg")), keys)


def _auc(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUC of rows (keys, p, pos, neg)."""
    scored = counted.groupBy(*keys, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    r = ranked_cumsum(scored, keys, "p", ["pos", "neg"], distinct=True)
    won = F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg")))
    return r.groupBy(*keys).agg(ratio(won, F.sum("pos") * F.sum("neg")).alias("auc"))


# ---------- week-block bootstrap ----------


@lru_cache(maxsize=32)
def md5_week_counts(n_weeks: int, resamples: int, seed: int) -> np.ndarray:
    """How often each replicate draws each week, as a (resamples x weeks) matrix. Draws come from md5 of
    "seed|replicate|slot", so any engine can repeat them."""
    out = np.zeros((resamples, n_weeks))
    for r in range(resamples):
        for s in range(n_weeks):
            h = hashlib.md5(f"{seed}|{r}|{s}".encode()).hexdigest()[:8]
            out[r, int(h, 16) % n_weeks] += 1
    return out


def with_week_place(weekly: DataFrame) -> DataFrame:
    """Adds `_i`, the week's place among the weeks of its (label, lead), and `_nw`, how many there are. One row a week is ranked."""
    weeks = weekly.select(*CASE, "week").distinct()
    weeks = weeks.withColumn("_i", F.row_number().over(W.partitionBy(*CASE).orderBy("week")) - 1).withColumn("_nw", F.count("*").over(W.partitionBy(*CASE)))
    return weekly.join(weeks, [*CASE, "week"])


def resampled(weekly: DataFrame, group: Sequence[str], sums: Sequence[str], statistics: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], names: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """(group, {name}_lo, {name}_hi, {name}_below): the 2.5 / 97.5 percentiles of each statistic over the replicates, and the
    share of replicates in which it is negative.

    A group's weekly sums (one row a week) meet the matrix of draws inside the task: replicates are the columns of a matrix
    product, never rows of a table.
    """
    group = list(group)
    placed = with_week_place(weekly).select(*group, "_i", "_nw", *[F.col(c).cast("double").alias(c) for c in sums])
    types = dict(placed.dtypes)

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = md5_week_counts(int(pdf["_nw"].iloc[0]), resamples, seed)[:, pdf["_i"].to_numpy()]
        values = counts @ pdf[list(sums)].to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = statistics({c: values[:, k] for k, c in enumerate(sums)})
        row = {c: [pdf[c].iloc[0]] for c in group}
        for m in names:
            known = found[m][np.isfinite(found[m])]
            lo, hi = np.percentile(known, [2.5, 97.5]) if len(known) else (None, None)
            row |= {f"{m}_lo": [lo], f"{m}_hi": [hi], f"{m}_below": [float((known < 0).mean()) if len(known) else None]}
        return pd.DataFrame(row)

    head = ", ".join(f"`{c}` {types[c]}" for c in group)
    return placed.groupBy(*group).applyInPandas(ends, head + "".join(f", `{m}_lo` double, `{m}_hi` double, `{m}_below` double" for m in names))


def metric_values(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """`metric_columns` of resampled sums, for methods that have all of them."""
    return {
        "brier": s["sq"] / s["n"], "bss": 1 - s["sq"] / s["ref_sq"], "log_loss": s["ll"] / s["n"], "false_clear_rate": s["fp"] / (s["tp"] + s["fp"]),
        "miss_rate": s["fn"] / (s["tp"] + s["fn"]), "accuracy": s["hit"] / s["n"],
    }


def score(
    preds: DataFrame, resamples: int = 1000, seed: int = 20260101, threshold: float = 0.5,
    by: Sequence[str] = ("site", "season"), min_weeks: int = 8, reference: str = "climatology",
) -> DataFrame:
    """One record per method and subset: n, weeks, base rate, every metric with its interval."""
    group = [*METHOD, "subset_type", "subset"]
    rows = collapsed(preds, by)
    weekly = with_reference(subset_partials(week_partials(rows, threshold, by), by), [*CASE, "subset_type", "subset", "week"], reference)
    metrics = metric_columns()
    point = weekly.groupBy(*group).agg(*[F.sum(c).alias(c) for c in (*SUMS, "ref_sq")], F.count("*").alias("n_weeks"))
    point = point.select(*group, "n", "n_weeks", ratio(F.col("sy"), F.col("n")).alias("base_rate"), *[c.alias(m) for m, c in metrics.items()])
    tags = [F.struct(F.lit("overall").alias("subset_type"), F.lit("all").alias("subset"))]
    tags += [F.struct(F.lit(c).alias("subset_type"), F.col(c).cast("string").alias("subset")) for c in by]
    prob = rows.filter("kind = 'prob' and family <> 'rule'").select(*METHOD, "pos", "neg", "p", F.inline(F.array(*tags)))
    out = point.join(_auc(prob, group), group, "left")
    if not resamples:
        return out
    boot = resampled(weekly, group, [*SUMS, "ref_sq"], metric_values, list(metrics), resamples, seed)
    out = out.join(boot, group, "left")
    known = lambda m: (F.col("n_weeks") >= min_weeks) & F.col(m).isNotNull()  # noqa: E731  a metric that the method does not have has no interval
    return out.select(*[c for c in out.columns if not c.endswith(("_lo", "_hi", "_below"))],
                      *[F.when(known(m), F.col(f"{m}_{s}")).alias(f"{m}_{s}") for m in metrics for s in ("lo", "hi")])


def paired(preds: DataFrame, pairs: DataFrame, resamples: int = 1000, seed: int = 20260101) -> DataFrame:
    """Brier A − Brier B on the same rows: point, interval, share of replicates in which A is better.
    `pairs`: (a, b), optionally with label and lead."""
    weekly = preds.groupBy(*CASE, "method", week_code(F.col("night_date")).alias("week")).agg(
        F.count("*").alias("n"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq")
    )
    side = lambda m: weekly.select(*CASE, "week", F.col("method").alias(m), F.col("n").alias(f"n_{m}"), F.col("sq").alias(f"sq_{m}"))
    both = pairs.join(side("a"), [c for c in (*CASE, "a") if c in pairs.columns or c == "a"]).join(side("b"), [*CASE, "week", "b"])
    key = [*CASE, "a", "b"]
    diff = ratio(F.sum("sq_a"), F.sum("n_a")) - ratio(F.sum("sq_b"), F.sum("n_b"))
    point = both.groupBy(*key).agg(diff.alias("brier_diff"))
    d = lambda s: {"d": s["sq_a"] / s["n_a"] - s["sq_b"] / s["n_b"]}
    ci = resampled(both, key, ["n_a", "sq_a", "n_b", "sq_b"], d, ["d"], resamples, seed)
    ci = ci.select(*key, F.col("d_lo").alias("lo"), F.col("d_hi").alias("hi"), F.col("d_below").alias("share_a_better"))
    return point.join(ci, key).withColumn("significant", (F.col("hi") < 0) | (F.col("lo") > 0))


SLICE = 4096  # (score, week) rows that meet the replicates at once


def auc_sums(counts: np.ndarray, p: np.ndarray, i: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per replicate (rows of `counts`, which has a column per week): pairs won (ties half), positives and negatives, of rows in
    order of their score p. Slices hold whole scores and at most SLICE rows, or one score, which has a row a week at most: memory is
    replicates x slice, however many weeks the scores of a range have between them."""
    won, below, total_pos = (np.zeros(len(counts)) for _ in range(3))
    starts = np.r_[0, np.flatnonzero(np.diff(p)) + 1, len(p)]
    k = 0
    while k < len(starts) - 1:
        to = max(k + 1, int(np.searchsorted(starts, starts[k] + SLICE, side="right")) - 1)
        edge = starts[k : to + 1]
        a, b = edge[0], edge[-1]
        w = counts[:, i[a:b]]
        gp = np.add.reduceat(w * pos[a:b], edge[:-1] - a, axis=1)
        gn = np.add.reduceat(w * neg[a:b], edge[:-1] - a, axis=1)
        under = below[:, None] + np.cumsum(gn, axis=1) - gn
        won += (gp * (under + 0.5 * gn)).sum(axis=1)
        below += gn.sum(axis=1)
        total_pos += gp.sum(axis=1)
        k = to
    return won, total_pos, below


def bootstrap_auc(preds: DataFrame, keys: Sequence[str], resamples: int = 1000, seed: int = 20260101) -> DataFrame:
    """AUC interval per key (keys include label and lead) from the same week draws.

    Scores are collapsed to (score, week) counts and split into ranges; each range yields
    its replicates' sums in bounded slices, and the ranges are then chained per key.
    """
    keys = list(keys)
    vals = preds.groupBy(*keys, "p", week_code(F.col("night_date")).alias("week")).agg(
        F.sum(F.col("y").cast("double")).alias("pos"), F.sum(1.0 - F.col("y").cast("double")).alias("neg")
    )
    placed = place_in_ranges(with_week_place(vals), keys, "p")
    placed = placed.select(*keys, "_bucket", "p", "_i", "_nw", "pos", "neg")

    def bucket_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = md5_week_counts(int(pdf["_nw"].iloc[0]), resamples, seed)
        pdf = pdf.sort_values("p", kind="stable")
        won, total_pos, below = auc_sums(counts, *[pdf[c].to_numpy() for c in ("p", "_i", "pos", "neg")])
        head = {c: [pdf[c].iloc[0]] for c in [*keys, "_bucket"]}
        return pd.DataFrame({**head, "won": [won], "pos": [total_pos], "neg": [below]})

    types = dict(preds.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    parts = placed.groupBy(*keys, "_bucket").applyInPandas(
        bucket_sums, f"{head}, _bucket int, won array<double>, pos array<double>, neg array<double>"
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_bucket")
        won, pos, neg = (np.stack(pdf[c].to_numpy()) for c in ("won", "pos", "neg"))
        below = np.cumsum(neg, axis=0) - neg
        den = pos.sum(axis=0) * neg.sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            values = (won + pos * below).sum(axis=0) / den
        values = values[np.isfinite(values)]
        lo, hi = np.percentile(values, [2.5, 97.5]) if len(values) else (None, None)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, "auc_lo": [lo], "auc_hi": [hi]})

    return parts.groupBy(*keys).applyInPandas(chain, f"{head}, auc_lo double, auc_hi double")


# ---------- reliability and value ----------


def bin_of(p: Column, edges: Sequence[float] = BINS) -> Column:
    """0-based bin by counting inner edges <= p, with the edges' exact doubles."""
    inner = F.array(*[F.lit(e) for e in edges[1:-1]])
    return F.size(F.filter(inner, lambda e: e <= p))


def reliability(preds: DataFrame, keys: Sequence[str], edges: Sequence[float] = BINS) -> DataFrame:
    """Every bin of every key: count, mean forecast, observed frequency (NULL when empty)."""
    agg = preds.groupBy(*keys, bin_of(F.col("p"), edges).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("observed")
    )
    rows = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("lo"), F.lit(edges[i + 1]).alias("hi")) for i in range(len(edges) - 1)])
    spine = agg.select(*keys).distinct().select(*keys, F.inline(rows))
    return spine.join(agg, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def brier_decomposition(preds: DataFrame, keys: Sequence[str], edges: Sequence[float] = BINS) -> DataFrame:
    """Reliability, resolution, uncertainty, what binning loses, and the expected calibration error."""
    y, p = F.col("y").cast("double"), F.col("p")
    bins = preds.groupBy(*keys, bin_of(p, edges).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("f"), F.avg(y).alias("o"), F.sum((p - y) * (p - y)).alias("sq")
    )
    n = F.sum("n")
    tot = bins.groupBy(*keys).agg(
        n.alias("n"), (F.sum(F.col("n") * F.col("o")) / n).alias("base"), (F.sum("sq") / n).alias("brier"),
        (F.sum(F.col("n") * F.pow(F.col("f") - F.col("o"), 2)) / n).alias("reliability"),
        (F.sum(F.col("n") * F.col("o") * F.col("o")) / n).alias("_oo"),
        (F.sum(F.col("n") * F.abs(F.col("o") - F.col("f"))) / n).alias("ece"),
    )
    res = F.col("_oo") - F.col("base") * F.col("base")
    unc = F.col("base") * (1 - F.col("base"))
    return tot.select(
        *keys, "n", "brier", "reliability", res.alias("resolution"), unc.alias("uncertainty"),
        (F.col("brier") - (F.col("reliability") - res + unc)).alias("binning_residual"), "ece",
    )


def _go_counts(preds: DataFrame, keys: Sequence[str], cuts: Sequence[float]) -> DataFrame:
    """(keys, cut, n, pos, go, tp): one pass, a conditional count per cut, then one row per cut."""
    y = F.col("y").cast("int") == 1
    aggs = [x for i, c in enumerate(cuts) for x in (
        count_if(F.col("p") >= c).alias(f"g{i}"), count_if((F.col("p") >= c) & y).alias(f"t{i}"))]
    wide = preds.groupBy(*keys).agg(F.count("*").alias("n"), count_if(y).alias("pos"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"g{i}").alias("go"), F.col(f"t{i}").alias("tp")) for i, c in enumerate(cuts)])
    return wide.select(*keys, "n", "pos", F.inline(rows))


def relative_value(preds: DataFrame, keys: Sequence[str], alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Share of the gap between the best fixed policy and a perfect forecast, per cost/loss ratio."""
    c = _go_counts(preds, keys, alphas).withColumnRenamed("cut", "alpha")
    a, s = F.col("alpha"), F.col("pos") / F.col("n")
    expense = (a * F.col("go") + (F.col("pos") - F.col("tp"))) / F.col("n")
    fixed, perfect = F.least(a, s), a * s
    return c.select(*keys, "alpha", F.when(fixed > perfect, (fixed - expense) / (fixed - perfect)).alias("value"))


def threshold_curve(preds: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = ALPHAS) -> DataFrame:
    """Per 'go' threshold: how often it says go, how many of those were wrong, how many usable were missed."""
    c = _go_counts(preds, keys, thresholds).withColumnRenamed("cut", "threshold")
    return c.select(
        *keys, "threshold", (F.col("go") / F.col("n")).alias("go_rate"),
        ratio(F.col("go") - F.col("tp"), F.col("go")).alias("false_clear_rate"),
        ratio(F.col("pos") - F.col("tp"), F.col("pos")).alias("miss_rate"),
    )


# ---------- verdicts over leads ----------


def win_lists(diffs: DataFrame) -> DataFrame:
    """Per (label, a, b): the leads where A is significantly better, the others, and the counts."""
    better = F.col("significant") & (F.col("brier_diff") < 0)
    leads = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("lead"))))
    return diffs.groupBy("label", "a", "b").agg(
        leads(better).alias("better"), leads(~better).alias("not_better"), count_if(better).alias("wins"), F.count("*").alias("total")
    )
