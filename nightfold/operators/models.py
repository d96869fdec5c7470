"""Calibrated logistic blends with date-safe tuning, leave-group-out and walk-forward refits.

Many models are fitted at once. A fit is described by which rows it may see (its key, a date bound, a
held-out group); every Newton step makes one pass over the rows in which each partition adds up the
gradient and curvature of every fit, so raw rows are never shuffled or gathered per model, whatever the
skew. Only parameter-sized sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from datetime import date
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from nightfold.util import cut_lineage, exact_quantiles, place_in_ranges

P_CLIP = 1e-3
C_GRID = tuple(10.0 ** (-3 + i * 0.5) for i in range(13))
TIE = 1e-4
EPOCH = date(1970, 1, 1)


# ---------- folds ----------


def date_folds(rows: DataFrame, keys: Sequence[str], day: str, k: int) -> DataFrame:
    """Expanding folds over unique dates: (keys, fold, val_from, val_before). Fold i validates on
    [val_from, val_before) and trains on everything earlier; the last fold has no end."""
    keys = list(keys)
    days = rows.select(*keys, day).distinct()  # one row per calendar date, however many rows a key has
    ranked = days.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(day)) - 1)
    n = days.groupBy(*keys).agg(F.count("*").alias("_n"))
    size = F.floor(F.col("_n") / (k + 1))
    folds = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    folds = folds.withColumn("_a", F.col("_n") - (k - F.col("fold")) * size).withColumn("_b", F.col("_a") + size)
    at = lambda c, out: ranked.select(*keys, F.col("_r").alias(c), F.col(day).alias(out))
    out = folds.filter(size > 0).join(at("_a", "val_from"), [*keys, "_a"]).join(at("_b", "val_before"), [*keys, "_b"], "left")
    return out.select(*keys, "fold", "val_from", "val_before")


def expanding_months(rows: DataFrame, keys: Sequence[str], day: str, start: str) -> DataFrame:
    """(keys, period, month_start, month_end): each month from `start` on, to be predicted from all earlier dates."""
    m = F.trunc(day, "MM")
    return rows.filter(m >= F.lit(start).cast("date")).select(*keys, m.alias("month_start")).distinct().select(
        *keys, F.date_format("month_start", "yyyy-MM").alias("period"), "month_start", F.add_months("month_start", 1).alias("month_end")
    )


# ---------- fits ----------


@dataclass(frozen=True)
class Population:
    """The rows a model is trained on: its key, dates before a bound, and not the held-out group."""

    key: tuple
    before: int | None = None  # days since 1970
    exclude: str | None = None


@dataclass
class Fit:
    pop: Population
    c: float
    val: tuple[int | None, int | None] | None = None  # validation dates [from, before)
    owner: Population | None = None  # the population whose C this fit helps to choose
    beta: np.ndarray | None = None
    value: float = math.inf
    step: np.ndarray | None = None
    scale: float = 1.0
    done: bool = False


def _days(d: date | None) -> int | None:
    return None if d is None else (d - EPOCH).days


@dataclass(frozen=True)
class Basis:
    """The columns that all fits of one table share: inputs about a common centre (0 where missing), a flag for every
    input that is ever missing, the constant. Each model's own design is a linear map of them, so a batch is laid
    out once, whatever the number of models."""

    centre: np.ndarray
    unit: np.ndarray
    gappy: tuple[int, ...]

    @property
    def width(self) -> int:
        return len(self.centre) + len(self.gappy) + 1

    def rows(self, x: np.ndarray) -> np.ndarray:
        gaps = np.isnan(x)
        u = np.where(gaps, 0.0, (x - self.centre) / self.unit)
        return np.hstack([u, gaps[:, list(self.gappy)].astype(float), np.ones((len(x), 1))])

    def design(self, prep: dict[str, Any]) -> tuple[np.ndarray, np.ndarray, tuple[int, ...]]:
        """(map, rows, columns): a model's design (imputed and standardised inputs, its indicators, the constant) as a map of
        the basis. Inputs that never vary in its training rows have no weight; neither their rows nor columns that
        only they need are there, so a model costs what it uses."""
        d, at = len(self.centre), {i: len(self.centre) + k for k, i in enumerate(self.gappy)}
        live = [i for i in range(d) if prep["varies"][i]]
        rows = np.array([*live, *range(d, len(prep["mean"]) + 1)])
        cols = (*live, *sorted(at[i] for i in {*live, *prep["indicators"]} if i in at), self.width - 1)
        a = np.zeros((len(prep["mean"]) + 1, self.width))
        mean, sd = prep["mean"], prep["sd"]
        for i in range(d):
            a[i, i], a[i, -1] = self.unit[i] / sd[i], (self.centre[i] - mean[i]) / sd[i]
            if i in at:
                a[i, at[i]] = (prep["median"][i] - self.centre[i]) / sd[i]
        for k, i in enumerate(prep["indicators"], start=d):
            a[k, at[i]], a[k, -1] = 1 / sd[k], -mean[k] / sd[k]
        a[-1, -1] = 1.0
        return a[np.ix_(rows, cols)], rows, cols


CELLS = 1 << 22  # numbers of a batch's products that are held at once


def _pass(rows: DataFrame, n_keys: int, work: list, kind: str, basis: Basis) -> dict[int, np.ndarray]:
    """One pass over the rows: for each work item its summed vector.

    work: (id, Population, columns of the basis, coefficients of them, val). kind 'newton' gives [loss, gradient, upper half
    of the curvature] for the columns; kind 'loss' gives [clipped log loss, rows] over the item's validation dates. Models of one
    population (all values of C) are evaluated together, as matrix products.
    """
    cols = [c for c in rows.columns if c.startswith("f")]
    by_key: dict[tuple, list] = {}
    by_pop: dict[Population, list] = {}
    for item in work:
        by_pop.setdefault(item[1], []).append(item)
    for pop, items in by_pop.items():
        by_key.setdefault(pop.key, []).append((pop, [i[0] for i in items], items[0][2], np.stack([i[3] for i in items], axis=1), [i[4] for i in items]))
    widest = max((len(item[2]) for item in work), default=1)
    step = max(1, CELLS // (widest * (widest + 1) // 2 if kind == "newton" else basis.width))

    def add(x: np.ndarray, y: np.ndarray, day: np.ndarray, group: np.ndarray, pops: list, acc: dict[int, np.ndarray]) -> None:
        laid_out: dict[tuple, tuple] = {}
        every, y = x, y[:, None]
        for pop, ids, columns, gamma, vals in pops:
            if columns not in laid_out:
                part, (left, right) = every[:, columns], np.triu_indices(len(columns))
                laid_out[columns] = part, part[:, left] * part[:, right] if kind == "newton" else None
            x, products = laid_out[columns]
            if kind == "newton":
                n = len(x) if pop.before is None else int(np.searchsorted(day, pop.before))
                if not n:
                    continue
                t = x[:n] @ gamma
                e = np.exp(-np.abs(t))
                p = np.where(t >= 0, 1.0, e) / (1 + e)
                loss, res, curve = np.maximum(t, 0) + np.log1p(e) - y[:n] * t, p - y[:n], p * (1 - p)
                if pop.exclude is not None:
                    keep = (group[:n] != pop.exclude)[:, None]
                    loss, res, curve = loss * keep, res * keep, curve * keep
                found = np.vstack([loss.sum(axis=0), x[:n].T @ res, products[:n].T @ curve])
            else:
                found = np.zeros((2, len(ids)))
                for k, (lo, hi) in enumerate(vals):
                    a, b = np.searchsorted(day, lo), len(day) if hi is None else np.searchsorted(day, hi)
                    q = np.clip(1 / (1 + np.exp(-np.clip(x[a:b] @ gamma[:, k], -700, 700))), P_CLIP, 1 - P_CLIP)
                    keep = np.ones(b - a, bool) if pop.exclude is None else group[a:b] != pop.exclude
                    found[:, k] = -(y[a:b, 0] * np.log(q) + (1 - y[a:b, 0]) * np.log(1 - q))[keep].sum(), keep.sum()
            for k, ident in enumerate(ids):
                acc[ident] = acc[ident] + found[:, k] if ident in acc else found[:, k].copy()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            for key, part in pdf.groupby([f"k{i}" for i in range(n_keys)], sort=False):
                pops = by_key.get(tuple(str(v) for v in key))
                if not pops:
                    continue
                part = part.sort_values("day", kind="stable")  # training rows are then a leading stretch
                y, day, group = part["y"].to_numpy(float), part["day"].to_numpy(), part["grp"].to_numpy()
                x = basis.rows(part[cols].to_numpy(float))
                for lo in range(0, len(x), step):
                    at = slice(lo, lo + step)
                    add(x[at], y[at], day[at], group[at], pops, acc)
        if acc:
            yield pd.DataFrame({"id": list(acc), "v": [a.tolist() for a in acc.values()]})

    # Element-wise sums: partial ones in each task, then one number per fit and place, however many partitions.
    parts = rows.mapInPandas(sums, "id int, v array<double>").select("id", F.posexplode("v").alias("at", "x"))
    got = parts.groupBy("id", "at").agg(F.sum("x").alias("x")).toArrow().to_pandas().sort_values(["id", "at"])
    return {int(i): v.to_numpy() for i, v in got.groupby("id")["x"]}


def _solve_all(rows: DataFrame, n_keys: int, fits: list[Fit], prep: dict[Population, dict], basis: Basis, max_passes: int = 200) -> None:
    """Damped Newton on C * loss + |w|^2 / 2 (constant unpenalised) for every fit at once; an error if one does not
    converge. A fit whose value can no longer fall, however short the step, is at its numerical optimum."""
    design = {pop: basis.design(prep[pop]) for pop in {f.pop for f in fits}}
    for f in fits:
        width = len(design[f.pop][1])
        f.beta, f.step, f.value, f.scale, f.done = np.zeros(width), np.zeros(width), math.inf, 1.0, False
    for _ in range(max_passes):
        live = [(i, f) for i, f in enumerate(fits) if not f.done]
        if not live:
            break
        work = [(i, f.pop, design[f.pop][2], design[f.pop][0].T @ (f.beta + f.scale * f.step), None) for i, f in live]
        got = _pass(rows, n_keys, work, "newton", basis)
        for i, f in live:
            if i not in got:
                f.done = True
                continue
            trial, v, (a, _, columns) = f.beta + f.scale * f.step, got[i], design[f.pop]
            m = len(columns)
            free = np.ones(len(trial))
            free[-1] = 0.0
            value = f.c * v[0] + 0.5 * float(free @ (trial * trial))
            if value > f.value + 1e-12 * abs(f.value):
                f.scale /= 2
                f.done = f.scale < 1e-9
                continue
            shared, (left, right) = np.zeros((m, m)), np.triu_indices(m)
            shared[left, right] = shared[right, left] = v[1 + m :]
            grad = f.c * (a @ v[1 : 1 + m]) + free * trial
            curve = f.c * (a @ shared @ a.T) + np.diag(free)
            step = -np.linalg.lstsq(curve, grad, rcond=None)[0]
            f.beta, f.value, f.step, f.scale = trial, value, step, 1.0
            f.done = float(-grad @ step) <= 1e-12 * (1 + abs(value))
            if f.done:
                f.beta = trial + step  # what little is left is quadratically smaller after one more step
    open_ = [f.pop for f in fits if not f.done]
    if open_:
        raise RuntimeError(f"{len(open_)} fits did not converge in {max_passes} passes, the first for {open_[0]}")
    for f in fits:  # back to all inputs
        whole = np.zeros(len(prep[f.pop]["mean"]) + 1)
        whole[design[f.pop][1]] = f.beta
        f.beta = whole


def _to_basis(f: Fit, prep: dict[str, Any], basis: Basis) -> tuple[tuple[int, ...], np.ndarray]:
    """(columns, coefficients of them) of a solved fit."""
    a, rows, columns = basis.design(prep)
    return columns, a.T @ f.beta[rows]


def _prepare(rows: DataFrame, keys: Sequence[str], features: Sequence[str], pops: list[Population], impute: bool, complete: set[Population]) -> tuple[dict[Population, dict], Basis]:
    """Medians, missing indicators, means and population standard deviations per population.

    Sums are gathered once per (key, group, date) and added up per population; medians come from
    collapsed value counts, of every input for the `complete` populations (their models are kept) and of
    the inputs that have gaps for the rest.
    """
    spark, d = rows.sparkSession, len(features)
    table = [(i, *p.key, p.before, p.exclude) for i, p in enumerate(pops)]
    key_cols = [f"k{i}" for i in range(len(keys))]
    schema = "pop int, " + ", ".join(f"{c} string" for c in key_cols) + ", before int, exclude string"
    pop = spark.createDataFrame(table, schema)
    seen = (F.isnull("before") | (F.col("day") < F.col("before"))) & (F.isnull("exclude") | (F.col("grp") != F.col("exclude")))
    # Sums are taken around each input's overall mean: squares of large values would swallow a small spread.
    pilot = [v or 0.0 for v in rows.agg(*[F.avg(f"f{i}") for i in range(d)]).first()] if d else []
    x = lambda i: F.col(f"f{i}") - pilot[i]
    aggs = [F.count("*").alias("n"), F.sum("y").alias("pos")]
    for i in range(d):
        aggs += [F.count(x(i)).alias(f"n{i}"), F.sum(x(i)).alias(f"s{i}"), F.sum(x(i) * x(i)).alias(f"q{i}"), F.min(f"f{i}").alias(f"lo{i}"), F.max(f"f{i}").alias(f"hi{i}")]
    cells = cut_lineage(rows.groupBy(*key_cols, "grp", "day").agg(*aggs))
    whole = cells.agg(F.sum("n").alias("n"), *[F.sum(f"{c}{i}").alias(f"{c}{i}") for c in "nq" for i in range(d)]).first()
    if not whole["n"]:
        return {}, Basis(np.zeros(d), np.ones(d), ())  # no rows, no models
    gappy = [i for i in range(d) if whole[f"n{i}"] < whole["n"]]
    spread = [math.sqrt(max((whole[f"q{i}"] or 0.0) / max(whole[f"n{i}"], 1), 0.0)) for i in range(d)]
    basis = Basis(np.array(pilot), np.array([v or 1.0 for v in spread]), tuple(gappy))
    kept = [i for i, p in enumerate(pops) if p in complete]
    names = [a for a in cells.columns if a not in (*key_cols, "grp", "day")]
    stats = cells.join(F.broadcast(pop), key_cols).filter(seen).groupBy("pop").agg(*[(F.min if c[:2] == "lo" else F.max if c[:2] == "hi" else F.sum)(c).alias(c) for c in names]).collect()
    medians: dict[tuple[int, int], float] = {}
    if impute:
        cuts = sorted({p.before for p in pops if p.before is not None})
        marks = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<int>")
        block = F.size(F.filter(marks, lambda c: c <= F.col("day")))
        pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"f{i}").alias("value")) for i in range(d)])
        long = rows.select(*key_cols, "grp", block.alias("block"), F.inline(pairs)).filter("value is not null")
        hist = long.groupBy(*key_cols, "grp", "block", "f", "value").agg(F.count("*").alias("w"))
        upto = pop.withColumn("_upto", F.size(F.filter(marks, lambda c: c < F.col("before"))))
        ok = (F.isnull("before") | (F.col("block") <= F.col("_upto"))) & (F.isnull("exclude") | (F.col("grp") != F.col("exclude")))
        wanted = F.col("f").isin(gappy) | F.col("pop").isin(kept)
        # Keys are few: sent to the tasks, the populations leave the values where they are; a shuffle by key would gather them.
        merged = hist.join(F.broadcast(upto), key_cols).filter(ok & wanted).groupBy("pop", "f", "value").agg(F.sum("w").alias("w"))
        for r in exact_quantiles(merged, ["pop", "f"], "value", {"m": 0.5}, weight="w").collect():
            medians[(r["pop"], r["f"])] = r["m"]
    out = {}
    for r in stats:
        n, med, mean, var, ind = r["n"], [], [], [], []
        for i in range(d):
            gaps = n - r[f"n{i}"]
            m = medians.get((r["pop"], i), 0.0)
            med.append(m)
            off = m - pilot[i]
            s, q = (r[f"s{i}"] or 0.0) + gaps * off, (r[f"q{i}"] or 0.0) + gaps * off * off
            lo, hi = r[f"lo{i}"], r[f"hi{i}"]
            constant = lo == hi and (not gaps or lo is None or m == lo)  # exactly, whatever the sums' rounding
            mean.append((m if lo is None else lo) if constant else pilot[i] + s / n)
            var.append(0.0 if constant else max(q / n - (s / n) ** 2, 0.0))
            if impute and gaps:
                ind.append((i, gaps / n))
        mean += [g for _, g in ind]
        var += [g * (1 - g) for _, g in ind]
        # A spread that is rounding noise next to the mean counts as none.
        sd = np.array([math.sqrt(v) if v > 1e-28 * m * m else 0.0 for v, m in zip(var, mean, strict=True)])
        varies = sd[:d] > 0
        sd[sd == 0] = 1.0
        out[pops[r["pop"]]] = {
            "median": np.array(med), "indicators": [i for i, _ in ind], "mean": np.array(mean), "sd": sd,
            "varies": varies, "n": n, "pos": float(r["pos"]),
        }
    return out, basis


def _pack(rows: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, day: str, group: str | None) -> DataFrame:
    """Rows in the compact form the passes read, written once to the shared checkpoint folder."""
    packed = rows.select(
        *[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)],
        (F.col(group).cast("string") if group else F.lit("")).alias("grp"), F.unix_date(F.col(day).cast("date")).alias("day"),
        F.col(y).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)],
    )
    return cut_lineage(packed)


def fit_logistic_grid(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, day: str,
    folds: int = 4, c_grid: Sequence[float] = C_GRID, tolerance: float = TIE, impute: bool = True,
    group: str | None = None, outer: Sequence[dict] | None = None,
) -> list[dict]:
    """Tune and fit one L2 logistic model per key and outer split; returns plain artifacts.

    outer: [{"name": ..., "exclude": group value or None, "before": date or None}], default one split with
    every row. C is the smallest whose mean validation loss over expanding date folds (inside the split's
    own training rows) is within `tolerance` of the best; folds whose training part has one class only
    are skipped.
    """
    outer = list(outer or [{"name": "all", "exclude": None, "before": None}])
    packed = _pack(rows, keys, features, y, day, group)
    key_cols = [f"k{i}" for i in range(len(keys))]
    key_values = [tuple(r) for r in packed.select(*key_cols).distinct().orderBy(*key_cols).collect()]
    finals = {(k, o["name"]): Population(k, _days(o.get("before")), o.get("exclude")) for k in key_values for o in outer}
    pops = sorted(set(finals.values()), key=repr)
    fold_table = _fold_table(packed, key_cols, pops, folds)
    inner: list[Fit] = []
    for p in pops:
        for lo, hi in fold_table.get(p, []):
            inner += [Fit(replace(p, before=lo), c, (lo, hi if hi is not None else p.before), p) for c in c_grid]
    prep, basis = _prepare(packed, keys, features, sorted({*pops, *(f.pop for f in inner)}, key=repr), impute, set(pops))
    inner = [f for f in inner if f.pop in prep and 0 < prep[f.pop]["pos"] < prep[f.pop]["n"]]
    pops = [p for p in pops if p in prep and 0 < prep[p]["pos"] < prep[p]["n"]]
    _solve_all(packed, len(keys), inner, prep, basis)
    losses = _pass(packed, len(keys), [(i, f.pop, *_to_basis(f, prep[f.pop], basis), f.val) for i, f in enumerate(inner)], "loss", basis) if inner else {}
    table: dict[Population, dict[float, list[float]]] = {}
    for i, f in enumerate(inner):
        v = losses.get(i)
        if v is not None and v[1]:
            table.setdefault(f.owner, {}).setdefault(f.c, []).append(v[0] / v[1])
    best: list[Fit] = []
    scores: dict[Population, dict[float, float]] = {}
    for p in pops:
        scores[p] = {c: float(np.mean(v)) for c, v in table.get(p, {}).items()}
        best.append(Fit(p, choose_c(scores[p], tolerance) if scores[p] else min(c_grid)))
    _solve_all(packed, len(keys), best, prep, basis)
    spans = {tuple(r[c] for c in key_cols): (r["a"], r["b"]) for r in packed.groupBy(*key_cols).agg(F.min("day").alias("a"), F.max("day").alias("b")).collect()}
    fitted = {f.pop: f for f in best}
    out = []
    for (k, name), p in finals.items():
        if p not in fitted:
            continue
        f, pr = fitted[p], prep[p]
        first, last = spans[k]
        last = last if p.before is None else min(last, p.before - 1)
        out.append({
            "keys": dict(zip(keys, k, strict=True)), "split": name, "exclude": p.exclude,
            "inputs": list(features), "medians": [float(v) for v in pr["median"]], "indicators": [int(i) for i in pr["indicators"]],
            "output_features": [*features, *[f"missing_{features[i]}" for i in pr["indicators"]]],
            "mean": pr["mean"].tolist(), "scale": pr["sd"].tolist(), "coef": f.beta[:-1].tolist(), "intercept": float(f.beta[-1]),
            "c": f.c, "cv_log_loss": scores[p].get(f.c), "cv_scores": scores[p], "n_train": int(pr["n"]), "base_rate": pr["pos"] / pr["n"],
            "train_start": str(date.fromordinal(EPOCH.toordinal() + first)), "train_end": str(date.fromordinal(EPOCH.toordinal() + last)),
            "isotonic_x": [], "isotonic_y": [],
        })
    return out


def _fold_table(packed: DataFrame, key_cols: list[str], pops: list[Population], folds: int) -> dict[Population, list[tuple[int, int | None]]]:
    """Validation ranges per population, from the unique dates of its own training rows."""
    spark = packed.sparkSession
    schema = "pop int, " + ", ".join(f"{c} string" for c in key_cols) + ", before int, exclude string"
    pop = spark.createDataFrame([(i, *p.key, p.before, p.exclude) for i, p in enumerate(pops)], schema)
    days = packed.select(*key_cols, "grp", "day").distinct()
    seen = (F.isnull("before") | (F.col("day") < F.col("before"))) & (F.isnull("exclude") | (F.col("grp") != F.col("exclude")))
    mine = days.join(F.broadcast(pop), key_cols).filter(seen).select("pop", "day")
    out: dict[Population, list] = {}
    for r in date_folds(mine, ["pop"], "day", folds).orderBy("pop", "fold").collect():
        out.setdefault(pops[r["pop"]], []).append((r["val_from"], r["val_before"]))
    return out


def choose_c(scores: dict[float, float], tolerance: float = TIE) -> float:
    """Smallest C whose loss is within the tolerance of the best."""
    best = min(scores.values())
    return min(c for c, v in scores.items() if v <= best + tolerance)


# ---------- artifacts and prediction ----------

ARTIFACT = (
    "split string, exclude string, inputs array<string>, medians array<double>, indicators array<int>, output_features array<string>, "
    "mean array<double>, scale array<double>, coef array<double>, intercept double, c double, cv_log_loss double, n_train long, "
    "base_rate double, train_start string, train_end string, isotonic_x array<double>, isotonic_y array<double>"
)


def artifact_frame(spark: SparkSession, artifacts: list[dict], keys: Sequence[str], types: Sequence[str]) -> DataFrame:
    """One row per model (parameter-sized)."""
    cast = {"int": int, "string": str, "long": int}
    names = [c.split()[0] for c in ARTIFACT.split(", ")]
    data = [(*[cast[t](a["keys"][k]) for k, t in zip(keys, types, strict=True)], *[a[n] for n in names]) for a in artifacts]
    return spark.createDataFrame(data, ", ".join(f"{k} {t}" for k, t in zip(keys, types, strict=True)) + ", " + ARTIFACT)


def linear_form(artifacts: DataFrame) -> DataFrame:
    """Each model as b0 + sum(slope_i x_i), with gap_i in place of slope_i x_i where input i is missing:
    median, indicator and scaling folded into constants, once per model rather than once per row."""
    n = F.size("inputs")
    at = lambda arr, i: F.element_at(F.col(arr), i)
    slope = F.transform(F.sequence(F.lit(1), n), lambda i: at("coef", i) / at("scale", i))
    flag = lambda i: F.coalesce(
        F.aggregate(
            F.filter(F.arrays_zip(F.col("indicators").alias("i"), F.slice("coef", n + 1, F.greatest(F.size("indicators"), F.lit(1))).alias("c"),
                                  F.slice("scale", n + 1, F.greatest(F.size("indicators"), F.lit(1))).alias("s")), lambda e: e["i"] == i - 1),
            F.lit(0.0), lambda acc, e: acc + e["c"] / e["s"],
        ), F.lit(0.0))
    gap = F.transform(F.sequence(F.lit(1), n), lambda i: at("coef", i) / at("scale", i) * at("medians", i) + flag(i))
    offset = F.aggregate(F.arrays_zip(F.col("coef").alias("c"), F.col("mean").alias("m"), F.col("scale").alias("s")), F.lit(0.0), lambda acc, e: acc + e["c"] * e["m"] / e["s"])
    return artifacts.withColumns({"_slope": slope, "_gap": gap, "_b0": F.col("intercept") - offset})


def isotonic(p: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear map through the knots, flat outside; unchanged without knots."""
    i = F.size(F.filter(xs, lambda e: e <= p))
    a, b = F.element_at(xs, i), F.element_at(xs, i + 1)
    ya, yb = F.element_at(ys, i), F.element_at(ys, i + 1)
    mapped = F.when(i == 0, F.element_at(ys, 1)).when(i >= F.size(xs), F.element_at(ys, -1)).otherwise(ya + (yb - ya) * (p - a) / (b - a))
    return F.when(F.size(xs) > 0, mapped).otherwise(p)


def predict(rows: DataFrame, artifacts: DataFrame, features: Sequence[str], on: Sequence[str], out: str = "p") -> DataFrame:
    """Adds the probability of the model matching the row's `on` columns (NULL without one). The models are
    few and small, so they are broadcast: rows are never gathered by key; scoring is plain arithmetic."""
    models = linear_form(artifacts).select(*on, F.struct("_slope", "_gap", "_b0", "isotonic_x", "isotonic_y").alias("_m"))
    joined = rows.join(F.broadcast(models), list(on), "left")
    terms = [F.coalesce(F.col(f).cast("double") * F.col("_m._slope")[i], F.col("_m._gap")[i]) for i, f in enumerate(features)]
    t = sum(terms, F.col("_m._b0"))
    joined = joined.withColumn("_q", 1 / (1 + F.exp(-t)))
    p = F.when(F.col("_m").isNotNull(), isotonic(F.col("_q"), F.col("_m.isotonic_x"), F.col("_m.isotonic_y")))
    return joined.select(*rows.columns, p.alias(out))


def out_of_fold(rows: DataFrame, keys: Sequence[str], types: Sequence[str], features: Sequence[str], y: str, day: str, artifacts: list[dict], folds: int = 4) -> DataFrame:
    """Predictions of each validation fold from models (at the chosen C) fitted on earlier dates only."""
    fold = date_folds(rows, keys, day, folds)
    bounds = {}
    for r in fold.collect():  # a few rows per model
        bounds.setdefault(tuple(str(r[k]) for k in keys), []).append((r["fold"], r["val_from"]))
    packed = _pack(rows, keys, features, y, day, None)
    fits, tags = [], []
    for a in artifacts:
        k = tuple(str(a["keys"][c]) for c in keys)
        for i, start in bounds.get(k, []):
            fits.append(Fit(Population(k, _days(start)), a["c"]))
            tags.append((a, i))
    prep, basis = _prepare(packed, keys, features, sorted({f.pop for f in fits}, key=repr), True, set())
    live = [(f, t) for f, t in zip(fits, tags, strict=True) if f.pop in prep and 0 < prep[f.pop]["pos"] < prep[f.pop]["n"]]
    _solve_all(packed, len(keys), [f for f, _ in live], prep, basis)
    frames = []
    for f, (a, i) in live:
        pr = prep[f.pop]
        frames.append({**a, "keys": {**a["keys"], "fold": i}, "medians": pr["median"].tolist(), "indicators": pr["indicators"],
                       "mean": pr["mean"].tolist(), "scale": pr["sd"].tolist(), "coef": f.beta[:-1].tolist(), "intercept": float(f.beta[-1])})
    models = artifact_frame(rows.sparkSession, frames, [*keys, "fold"], [*types, "int"])
    inside = rows.join(F.broadcast(fold), list(keys)).filter((F.col(day) >= F.col("val_from")) & (F.isnull("val_before") | (F.col(day) < F.col("val_before"))))
    return predict(inside, models, features, [*keys, "fold"]).drop("val_from", "val_before").filter("p is not null")


def _pooled(pdf: pd.DataFrame) -> list[tuple[float, float, float, float]]:
    """Blocks (first p, last p, sum of y, weight) of the best rising step function, by pooling neighbours that fall.
    Blocks go in as points do, so that pooled ranges can be pooled again."""
    blocks: list[list[float]] = []
    for lo, hi, sy, w in pdf[["lo", "hi", "sy", "w"]].sort_values("lo").itertuples(index=False):
        blocks.append([lo, hi, sy, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, s, n = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = last, blocks[-1][2] + s, blocks[-1][3] + n
    return [tuple(b) for b in blocks]


def isotonic_knots(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, isotonic_x, isotonic_y): isotonic regression of y on p per key, as knots at both ends of each step.

    All keys share one job: equal p are collapsed, ranges of p are pooled by themselves, then their blocks are pooled;
    pooling in parts gives the same steps. A key's last task holds its blocks only.
    """
    keys = list(keys)
    types = dict(scored.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    points = scored.groupBy(*keys, "p").agg(F.sum(F.col("y").cast("double")).alias("sy"), F.count("*").cast("double").alias("w"))
    points = place_in_ranges(points, keys, "p").select(*keys, "_bucket", F.col("p").alias("lo"), F.col("p").alias("hi"), "sy", "w")

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_pooled(pdf), columns=["lo", "hi", "sy", "w"])
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "lo", "hi", "sy", "w"]]

    def knots(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = [], []
        for lo, hi, sy, w in _pooled(pdf):
            ends = [lo] if lo == hi else [lo, hi]
            xs += ends
            ys += [sy / w] * len(ends)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "isotonic_x": [xs], "isotonic_y": [ys]})

    parts = points.groupBy(*keys, "_bucket").applyInPandas(blocks, f"{head}, lo double, hi double, sy double, w double")
    return parts.groupBy(*keys).applyInPandas(knots, f"{head}, isotonic_x array<double>, isotonic_y array<double>")


def calibrate(oof: DataFrame, keys: Sequence[str], y: str, artifacts: list[dict], threshold: float = 0.05) -> list[dict]:
    """Adds an isotonic map to the models whose out-of-fold calibration error (over ten bins) exceeds the threshold.
    Errors of all models are one aggregation, the maps of those that need one are one job."""
    from nightfold.operators.verify import brier_decomposition

    keys = list(keys)
    scored = cut_lineage(oof.select(*keys, "p", F.col(y).cast("double").alias("y")))
    errors = cut_lineage(brier_decomposition(scored, keys).select(*keys, "n", "ece"))
    of = lambda r: tuple(str(r[k]) for k in keys)
    ece = {of(r): r for r in errors.collect()}  # one row a model
    due = scored.join(F.broadcast(errors.filter(F.col("ece") > threshold).select(*keys)), keys, "left_semi")
    maps = {of(r): r for r in isotonic_knots(due, keys).collect()}
    out = []
    for a in artifacts:
        k = tuple(str(a["keys"][c]) for c in keys)
        r, m = ece.get(k), maps.get(k)
        a = {**a, "oof_ece": None if r is None else r["ece"], "n_oof": 0 if r is None else r["n"], "applied": m is not None}
        if m is not None:
            a["isotonic_x"], a["isotonic_y"] = list(m["isotonic_x"]), list(m["isotonic_y"])
        out.append(a)
    return out


def spread_threshold(rows: DataFrame, keys: Sequence[str], spread: str = "spread_frac_clear", q: float = 0.75) -> DataFrame:
    """The spread above which models count as split, from training rows."""
    return exact_quantiles(rows, keys, spread, {"spread_threshold": q})


# ---------- reading artifacts ----------


def coefficients(artifacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    z = F.arrays_zip(F.col("output_features").alias("feature"), F.col("coef").alias("coef"))
    return artifacts.select(*keys, F.inline(z))


def largest_coefficients(artifacts: DataFrame, keys: Sequence[str], top: int = 12) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.abs("coef").desc(), "feature")
    return coefficients(artifacts, keys).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def weight_shares(artifacts: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Share of the absolute coefficients on each model's three inputs."""
    from nightfold.operators.nights import MODEL_INPUTS

    table = F.map_from_arrays("output_features", "coef")
    total = lambda m: sum((F.abs(F.coalesce(F.try_element_at(table, F.lit(f"{m}_{f}")), F.lit(0.0))) for f in MODEL_INPUTS), F.lit(0.0))
    rows = artifacts.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("model"), total(m).alias("v")) for m in models])))
    grand = F.sum("v").over(W.partitionBy(*keys))
    return rows.select(*keys, "model", F.when(grand > 0, F.col("v") / grand).otherwise(0.0).alias("share"))


def artifact_summary(artifacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return artifacts.select(*keys, "c", "cv_log_loss", "n_train", "train_start", "train_end", "intercept",
                            F.map_from_arrays("output_features", "coef").alias("coef"), (F.size("isotonic_x") > 0).alias("calibrated"))


def trained_before(artifacts: DataFrame, test_start: str) -> DataFrame:
    """Models whose training reaches the test period (must be empty)."""
    return artifacts.filter(F.col("train_end") >= F.lit(test_start))


def best_single(cv: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The method with the lowest training-time validation loss, per key; one without a loss comes last."""
    return cv.groupBy(*keys).agg(F.min_by("method", F.struct(F.coalesce("cv_log_loss", F.lit(math.inf)), F.col("method"))).alias("best_single"))


def shipping_decision(paired: DataFrame, incumbent: str = "geo_airports", challenger: str = "statewide_loro") -> DataFrame:
    """Keep the incumbent if the challenger is significantly worse at any lead."""
    worse = F.sort_array(F.collect_list(F.when(F.col("lo") > 0, F.col("lead"))))
    return paired.agg(worse.alias("worse_at_leads")).withColumn(
        "method", F.when(F.size("worse_at_leads") > 0, incumbent).otherwise(challenger)
    )


# ---------- hold-out schemes ----------


def leave_group_out(rows: DataFrame, test: DataFrame, keys: Sequence[str], types: Sequence[str], features: Sequence[str], y: str, day: str, group: str, **kw) -> DataFrame:
    """Every test row predicted by the model of its key that never saw its group."""
    groups = [r[0] for r in test.select(F.col(group).cast("string")).distinct().orderBy(1).collect()]  # one model each
    outer = [{"name": g, "exclude": g, "before": None} for g in groups]
    arts = fit_logistic_grid(rows, keys, features, y, day, group=group, outer=outer, **kw)
    frame = artifact_frame(rows.sparkSession, arts, keys, types).withColumn("_held", F.col("exclude"))
    return predict(test.withColumn("_held", F.col(group).cast("string")), frame, features, [*keys, "_held"]).drop("_held")


def walk_forward(rows: DataFrame, keys: Sequence[str], types: Sequence[str], features: Sequence[str], y: str, day: str, start: str, **kw) -> DataFrame:
    """Every row from `start` on predicted by a model refitted on all dates before its month."""
    months = [r[0] for r in expanding_months(rows, [], day, start).select("month_start").distinct().orderBy(1).collect()]
    outer = [{"name": f"{m:%Y-%m}", "exclude": None, "before": m} for m in months]
    arts = fit_logistic_grid(rows, keys, features, y, day, outer=outer, **kw)
    frame = artifact_frame(rows.sparkSession, arts, keys, types).withColumn("period", F.col("split"))
    now = rows.filter(F.col(day) >= F.lit(start).cast("date")).withColumn("period", F.date_format(day, "yyyy-MM"))
    return predict(now, frame, features, [*keys, "period"])


def monthly_skill(preds: DataFrame, keys: Sequence[str], methods: Sequence[str], reference: str = "p_climatology") -> DataFrame:
    """Per key and period: rows, base rate and each method's skill against the reference."""
    y = F.col("y").cast("double")
    ref = F.avg(F.pow(F.col(reference) - y, 2))
    return preds.groupBy(*keys, "period").agg(
        F.count("*").alias("n"), F.avg(y).alias("base_rate"), *[(1 - F.avg(F.pow(F.col(m) - y, 2)) / ref).alias(f"bss_{m}") for m in methods]
    )


def definition_grid(hours: DataFrame, keys: Sequence[str], value: str, n_hours: str, thresholds: Sequence[float], runs: Sequence[int], max_missing: float) -> DataFrame:
    """Usable flag of every period under each (clear threshold, run length): one pass keeps a bit set per
    threshold, so the grid never multiplies the hourly rows. `hours`: attached hours with `slot`."""
    from nightfold.operators.timeseries import bits_of, is_clear, longest_bit_run

    aggs = [bits_of(is_clear(F.col(value), t), F.col("slot")).alias(f"b{i}") for i, t in enumerate(thresholds)]
    per = hours.groupBy(*keys).agg(F.count(value).alias("_v"), F.max(n_hours).alias("_n"), *aggs)
    ok = (F.col("_n") - F.col("_v")) / F.col("_n") <= max_missing
    cells = [
        F.struct(F.lit(t).alias("clear_threshold"), F.lit(r).alias("min_run"), F.when(ok, longest_bit_run(F.col(f"b{i}")) >= r).alias("usable"))
        for i, t in enumerate(thresholds) for r in runs
    ]
    return per.select(*keys, F.inline(F.array(*cells)))
