from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nightfold.operators import nights as N
from nightfold.operators.timeseries import RunRules

T0 = dt.datetime(2025, 1, 2, 2)
NIGHT = dt.date(2025, 1, 1)


def windows(spark, dark=True):
    rows = [("a", NIGHT, T0 if dark else None, T0 + dt.timedelta(hours=7) if dark else None)]
    return spark.createDataFrame(rows, "site string, night_date date, dusk timestamp, dawn timestamp")


def wide(spark, asos, era5):
    rows = [("a", T0 + dt.timedelta(hours=i), x, y) for i, (x, y) in enumerate(zip(asos, era5))]
    return spark.createDataFrame(rows, "site string, hour timestamp, asos double, era5 double")


def test_one_missing_source_is_used_and_counted(spark):
    lab = N.build_labels(windows(spark), wide(spark, [0.0] * 7 + [None], [0.1] * 8)).first()
    assert lab["usable_primary"] is True and lab["n_single_source_hours"] == 1 and lab["exclusion_primary"] is None
    assert lab["usable_goes"] is None and lab["exclusion_goes"] == "goes_missing"


def test_primary_takes_the_cloudier_source(spark):
    lab = N.build_labels(windows(spark), wide(spark, [0.0] * 8, [0.9] * 8)).first()
    assert (lab["usable_asos"], lab["usable_era5"], lab["usable_primary"]) == (True, False, False)


def test_sparse_source_excludes_the_night(spark):
    lab = N.build_labels(windows(spark), wide(spark, [None] * 3 + [0.0] * 5, [0.0] * 8)).first()
    assert lab["usable_primary"] is None and lab["exclusion_primary"] == "asos_missing" and lab["usable_era5"] is True


def test_no_darkness_overrides(spark):
    lab = N.build_labels(windows(spark, dark=False), wide(spark, [0.0], [0.0])).first()
    assert lab["exclusion_primary"] == "no_darkness" and lab["usable_era5"] is None and lab["exclusion_goes"] == "no_darkness"


def test_absent_lead_is_null_with_everything_missing(spark):
    f = [("a", m, 1, T0 + dt.timedelta(hours=i), 0.1) for m in ("x", "y", "b") for i in range(8)]
    fc = spark.createDataFrame(f, "site string, model string, lead int, hour timestamp, cover double")
    out = {r["lead"]: r for r in N.build_features(windows(spark), fc, {"x": [1, 2], "y": [1]}, {"b": [1, 2]}, [1, 2]).collect()}
    assert out[1]["x_frac_clear"] == 1.0 and out[1]["spread_frac_clear"] == 0.0 and out[1]["n_models_available"] == 2
    assert out[2]["y_frac_clear"] is None and out[2]["y_missing_frac"] == 1.0 and out[2]["spread_frac_clear"] is None


def test_benchmark_never_changes_the_spread(spark):
    f = [("a", m, 1, T0 + dt.timedelta(hours=i), c) for m, c in (("x", 0.1), ("y", 0.9), ("b", 0.9)) for i in range(8)]
    fc = spark.createDataFrame(f, "site string, model string, lead int, hour timestamp, cover double")
    assert N.build_features(windows(spark), fc, {"x": [1], "y": [1]}, {"b": [1]}, [1]).first()["spread_frac_clear"] == 0.5


def test_validator_names_every_problem(spark):
    from nightfold.sources.sinks import InvalidDataset, save_dataset

    df = spark.createDataFrame([("a", NIGHT, 1, 2, 1.5, True), ("a", NIGHT, 1, 2, 0.5, True)], "site string, night_date date, lead int, dark_hours int, x_frac_clear double, usable_primary boolean")
    found = {r["problem"]: r["n"] for r in N.validate_dataset(df).collect()}
    assert found == {"x_frac_clear outside [0, 1]": 1, "dark_hours outside 4-13": 2, "duplicate keys": 1}
    with pytest.raises(InvalidDataset):
        save_dataset(df, "/nowhere")
    assert N.validate_dataset(df.limit(1).withColumn("x_frac_clear", F.lit(0.5)).withColumn("dark_hours", F.lit(9))).isEmpty()


def test_ensemble_members_with_gaps_do_not_vote(spark):
    m = [("a", "e", "control", T0 + dt.timedelta(hours=i), 0.0) for i in range(8)] + [("a", "e", "m1", T0 + dt.timedelta(hours=i), 0.9) for i in range(8)] + [("a", "e", "m2", T0, 0.0)]
    out = N.ensemble_p_usable(windows(spark), spark.createDataFrame(m, "site string, model string, member string, hour timestamp, cover double"), RunRules()).first()
    assert (out["p_usable"], out["n_voting"]) == (0.5, 2)
