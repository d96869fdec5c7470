"""The blend end to end: every member model's training rows, one fitting job, artifacts, predictions of all methods.

A model here is a (label, lead, variant). Variants: `site` and `geo` blend all forecast models of the lead (with and
without the site among the inputs), `{m}_lr` takes one model, `equal_weight_cal` the members' mean. All rows of all variants
are one relation with the same inputs; an input that a variant does not use is constant there and gets no weight. So a single
job fits everything, and the artifacts are one table that joins back to rows by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightfold.operators import models as M, verify as V
from nightfold.operators.nights import LABELS, MODEL_INPUTS, context_columns, mean_present

KEYS, TYPES = ["label", "lead", "variant"], ["string", "int", "string"]
CONTEXT = ("month_sin", "month_cos", "dark_hours")


@dataclass(frozen=True)
class Members:
    """Which models forecast which leads, the benchmarks beside them, and the sites known to site-aware variants."""

    models: dict[str, Sequence[int]]
    benchmarks: dict[str, Sequence[int]] = field(default_factory=dict)
    sites: Sequence[str] = ()
    labels: dict[str, str] = field(default_factory=lambda: dict(LABELS))

    @property
    def variants(self) -> list[str]:
        return ["site", "geo", *[f"{m}_lr" for m in (*self.models, *self.benchmarks)], "equal_weight_cal"]

    @property
    def inputs(self) -> list[str]:
        own = [f"{m}_{f}" for m in (*self.models, *self.benchmarks) for f in MODEL_INPUTS]
        return [*own, "spread_frac_clear", "ew_frac_clear", *[f"site_{s}" for s in self.sites], *CONTEXT]


def _at(leads: Sequence[int]) -> Column:
    return F.col("lead").isin(list(leads))


def _uses(m: Members, variant: str) -> tuple[dict[str, Column], Column]:
    """(inputs of a variant with the condition under which a row has them, condition for a row to count)."""
    cols = lambda names: {f"{n}_{f}": _at({**m.models, **m.benchmarks}[n]) for n in names for f in MODEL_INPUTS}
    there = lambda names: reduce(lambda a, b: a & b, [~c | F.col(k).isNotNull() for k, c in names.items()])
    always = F.lit(True)
    context = {c: always for c in CONTEXT}
    sites = {f"site_{s}": always for s in m.sites}
    if variant in ("site", "geo"):
        several = sum((_at(leads).cast("int") for leads in m.models.values()), F.lit(0)) >= 2
        return {**cols(m.models), "spread_frac_clear": several, **context, **(sites if variant == "site" else {})}, F.col("n_models_available") > 0
    if variant == "equal_weight_cal":
        members = {f"{n}_frac_clear": _at(leads) for n, leads in m.models.items()}
        return {"ew_frac_clear": always, **context, **sites}, there(members)
    name = variant.removesuffix("_lr")
    return {**cols([name]), **context, **sites}, _at({**m.models, **m.benchmarks}[name]) & there(cols([name]))


def member_rows(rows: DataFrame, members: Members, variants: Sequence[str] | None = None, inputs: Sequence[str] | None = None) -> DataFrame:
    """(label, lead, variant, site, night_date, split, y, inputs): each dataset row once for every label and every variant
    that it can serve. y is NULL where the label is unknown. `inputs` restricts the models to some inputs."""
    inputs = list(inputs or members.inputs)
    own = [c for c in rows.columns if c != "dark_hours"]
    wide = rows.select(*own, *context_columns(members.sites)).withColumn("ew_frac_clear", mean_present([F.when(_at(leads), F.col(f"{n}_frac_clear")) for n, leads in members.models.items()]))
    serve = []
    for v in variants or members.variants:
        used, counts = _uses(members, v)
        value = lambda c, used=used: F.when(used[c], F.col(c).cast("double")).otherwise(0.0) if c in used else F.lit(0.0)
        serve.append(F.struct(F.lit(v).alias("variant"), counts.alias("counts"), *[value(c).alias(c) for c in inputs]))
    truths = F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).cast("int").alias("y")) for k, c in members.labels.items() if c in rows.columns])
    keep = ["lead", "site", "night_date", "split"]
    each = wide.select(*keep, truths.alias("truths"), F.inline(F.array(*serve))).filter("counts")
    return each.select(*keep, "variant", *inputs, F.inline("truths")).select("label", "lead", "variant", *keep[1:], "y", *inputs)


@dataclass
class Fitted:
    """Artifacts of all models and their table."""

    artifacts: list[dict]
    table: DataFrame
    inputs: list[str]


def fit(spark: SparkSession, long: DataFrame, inputs: Sequence[str], calibrated: Sequence[str] = ("site", "geo"), threshold: float = 0.05, folds: int = 4) -> Fitted:
    """Fits every (label, lead, variant) of `long` (as of `member_rows`) on its known training rows; the `calibrated` variants
    get an isotonic map where their out-of-fold calibration error is above the threshold."""
    train = long.filter("split = 'train' and y is not null")
    arts = M.fit_logistic_grid(train, KEYS, inputs, "y", "night_date", folds=folds)
    due = [a for a in arts if a["keys"]["variant"] in calibrated]
    if due:
        oof = M.out_of_fold(train.filter(F.col("variant").isin(list(calibrated))), KEYS, TYPES, inputs, "y", "night_date", due, folds=folds)
        arts = [a for a in arts if a["keys"]["variant"] not in calibrated] + M.calibrate(oof, KEYS, "y", due, threshold)
    return Fitted(arts, M.artifact_frame(spark, arts, KEYS, TYPES), list(inputs))


def predict(long: DataFrame, fitted: Fitted) -> DataFrame:
    """(label, lead, variant, site, night_date, y, p) of every row whose model exists."""
    p = M.predict(long, fitted.table, fitted.inputs, KEYS)
    return p.filter("p is not null").select(*KEYS, "site", "night_date", "split", "y", "p")


def with_own_variant(predictions: DataFrame, known_sites: DataFrame) -> DataFrame:
    """The served blend: `site` where the place is one of `known_sites` (site), `geo` elsewhere."""
    known = known_sites.select("site").distinct().withColumn("_k", F.lit(True))
    routed = predictions.filter("variant in ('site', 'geo')").join(known, "site", "left")
    return routed.filter((F.col("variant") == "site") == F.coalesce("_k", F.lit(False))).drop("_k")


def final_fit(spark: SparkSession, long: DataFrame, inputs: Sequence[str], **kw) -> tuple[Fitted, DataFrame]:
    """The shipped statewide model: `geo` fitted on every station's training rows, and (label, lead, trained_on, n_stations)."""
    geo = long.filter("variant = 'geo'")
    trained = geo.filter("split = 'train' and y is not null").groupBy("label", "lead").agg(F.array_sort(F.collect_set("site")).alias("trained_on"))  # station names
    return fit(spark, geo, inputs, **kw), trained.withColumn("n_stations", F.size("trained_on"))


def best_single(fitted: Fitted, members: Members) -> DataFrame:
    """(label, lead, best_single): the one-model variant with the lowest training-time validation loss, benchmarks apart."""
    names = [f"{m}_lr" for m in members.models]
    cv = fitted.table.filter(F.col("variant").isin(names)).select("label", "lead", F.col("variant").alias("method"), "cv_log_loss")
    return M.best_single(cv, ["label", "lead"])


def all_methods(rows: DataFrame, members: Members, predictions: DataFrame, climatologies: DataFrame) -> DataFrame:
    """Predictions of every method on the rows that all of them can be scored on (test rows): label, lead, site,
    night_date, season, y, method, kind, family, p.

    climatologies: (label, site, month, rate). Persistence takes the label's own past. The blend is its site-aware variant.
    """
    test = rows.filter("split = 'test'")
    parts = []
    for label, column in members.labels.items():
        if column not in rows.columns:
            continue
        own = V.persistence(test, rows.filter(F.col(column).isNotNull()), column)
        own = V.apply_climatology(own, climatologies.filter(F.col("label") == label).drop("label"))
        parts.append(own.withColumn("label", F.lit(label)).withColumn("y", F.col(column).cast("int")))
    wide = reduce(lambda a, b: a.unionByName(b), parts)
    everyone = {**members.models, **members.benchmarks}
    needed = F.col("y").isNotNull() & F.col("persistence").isNotNull()
    for n, leads in everyone.items():
        here = F.col(f"{n}_pred_usable").isNotNull()
        for f in MODEL_INPUTS:
            here = here & F.col(f"{n}_{f}").isNotNull()
        needed = needed & (~_at(leads) | here)
    wide = wide.filter(needed)
    plain: dict[str, tuple[str, str, Column]] = {
        "climatology": ("prob", "climatology", F.col("p_climatology")), "persistence": ("hard", "persistence", F.col("persistence").cast("double")),
        "equal_weight": ("prob", "equal_weight", mean_present([F.when(_at(leads), F.col(f"{n}_frac_clear")) for n, leads in members.models.items()])),
    }
    for n, leads in everyone.items():
        plain[f"{n}_rule"] = ("hard", "rule", F.when(_at(leads), F.col(f"{n}_pred_usable").cast("double")))
    for n, leads in members.benchmarks.items():
        plain[f"{n}_raw"] = ("prob", "benchmark", F.when(_at(leads), F.col(f"{n}_frac_clear")))
    keep = ["label", "lead", "site", "night_date", "season", "y"]
    simple = V.to_predictions(wide, plain, keep).filter("p is not null")
    family = F.when(F.col("variant") == "site", "blend").when(F.col("variant") == "equal_weight_cal", "equal_weight_cal")
    family = family.when(F.col("variant").isin([f"{b}_lr" for b in members.benchmarks]), "benchmark").otherwise("single_lr")
    named = predictions.filter("variant <> 'geo'").select(
        "label", "lead", "site", "night_date", F.when(F.col("variant") == "site", "blend").otherwise(F.col("variant")).alias("method"), F.lit("prob").alias("kind"), family.alias("family"), "p"
    )
    modelled = wide.select(*keep).join(named, ["label", "lead", "site", "night_date"])
    return simple.unionByName(modelled.select(*simple.columns))


def cross_truth(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """Models trained on one label judged by every label: predictions (label, lead, site, night_date, p, ...) meet truths
    (label, site, night_date, season, y). The result has the judging label as `label` and `blend_{trained label}` as method."""
    p = predictions.select(F.concat(F.lit("blend_"), "label").alias("method"), "lead", "site", "night_date", "p")
    own = F.when(F.col("method") == F.concat(F.lit("blend_"), "label"), "blend").otherwise("cross_truth")
    judged = p.join(truths.filter("y is not null"), ["site", "night_date"])
    return judged.select("label", "lead", "site", "night_date", "season", "y", "method", F.lit("prob").alias("kind"), own.alias("family"), "p")
