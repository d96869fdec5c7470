from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nightfold.functions import timefn as T
from nightfold.operators import timeseries as S

T0 = dt.datetime(2025, 3, 9, 4)


def hours(spark, covers, key="n"):
    rows = [(key, i, T0 + dt.timedelta(hours=i), c) for i, c in enumerate(covers)]
    return spark.createDataFrame(rows, "night string, slot int, hour timestamp, cover double")


RULES = S.RunRules()
CASES = [
    ([0, 0.1, 0.2, 0.9], True),
    ([0, 0.1, 0.9, 0, 0.1], False),
    ([0.1, 0.1, None, 0.1, 0.1, 0.9, 0.9, 0.9], False),  # a gap breaks the run
    ([0.2 + 1e-12, 0.2, 0.2], True),  # the threshold is inclusive, with a hair of tolerance
    ([0.1] * 5 + [None, None], None),  # 2 of 7 missing
    ([0.1] * 6 + [None], True),  # 1 of 7 missing
    ([0.1, 0.1, None, None], None),
]


@pytest.mark.parametrize("covers, usable", CASES)
def test_usable_rule_three_ways(spark, covers, usable):
    covers = [None if c is None else float(c) for c in covers]
    h = hours(spark, covers)
    assert S.run_summary_windowed(h, ["night"], "hour", "cover").first()["usable"] is usable
    nested = h.groupBy("night").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "cover"))), lambda x: x["cover"]).alias("c"))
    assert nested.select(S.is_usable(F.col("c"), RULES).alias("u")).first()["u"] is usable
    bits = h.groupBy("night").agg(*S.summary_aggs(F.col("cover"), RULES), F.count("*").alias("n"))
    assert bits.select(*S.summary_columns(F.col("n"), RULES)).first()["usable"] is usable


def test_empty_period_is_unknown_not_false(spark):
    assert spark.range(1).select(S.is_usable(F.array().cast("array<double>"), RULES).alias("u")).first()["u"] is None


def test_bit_runs_equal_block_runs_on_random_series(spark):
    rnd = random.Random(7)
    rows = []
    for k in range(200):
        for i in range(rnd.randint(1, 13)):
            rows.append((f"n{k}", i, T0 + dt.timedelta(hours=i), rnd.choice([None, 0.0, 0.1, 0.2, 0.5, 1.0])))
    h = spark.createDataFrame(rows, "night string, slot int, hour timestamp, cover double")
    a = S.run_summary_windowed(h, ["night"], "hour", "cover").select("night", "missing_frac", "frac_clear", "longest_clear_run", "mean_cover", "usable")
    g = h.groupBy("night").agg(*S.summary_aggs(F.col("cover"), RULES), F.count("*").alias("n"))
    b = g.select("night", *S.summary_columns(F.col("n"), RULES)).select(*a.columns)
    rnd6 = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(rnd6, a.collect()), key=str) == sorted(map(rnd6, b.collect()), key=str)


@pytest.mark.parametrize("minute, hour", [(30, 4), (31, 5), (0, 4), (59, 5)])
def test_centred_hour(spark, minute, hour):
    ts = F.lit(dt.datetime(2025, 3, 9, 4, minute)).cast("timestamp")
    assert spark.range(1).select(T.centred_hour(ts).alias("h")).first()["h"] == dt.datetime(2025, 3, 9, hour)


def test_nearest_report_and_ties(spark):
    rows = [("a", T0 - dt.timedelta(minutes=10), 0.2), ("a", T0 + dt.timedelta(minutes=10), 0.7), ("a", T0 + dt.timedelta(minutes=2), None), ("a", T0 + dt.timedelta(hours=2), None)]
    r = spark.createDataFrame(rows, "site string, valid timestamp, cover double")
    out = {x["hour"]: x["cover"] for x in S.hourly_cover(r, ["site"], "valid", "cover").collect()}
    assert out == {T0: 0.7, T0 + dt.timedelta(hours=2): None}
    with pytest.raises(ValueError):
        S.hourly_cover(r, ["site"], "valid", "cover", "mean")


def test_layers(spark):
    r = spark.createDataFrame([("CLR", "M"), (" few ", "bkn"), ("M", ""), ("VV", None)], "a string, b string")
    assert [x["c"] for x in r.select(S.observation_cover(["a", "b"]).alias("c")).collect()] == [0.0, 0.75, None, 1.0]


def test_run_summary_keeps_windows_without_reports(spark):
    w = spark.createDataFrame([("a", dt.date(2025, 3, 8), T0, T0 + dt.timedelta(hours=3)), ("a", dt.date(2025, 3, 9), T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=1, hours=3)),
                               ("a", dt.date(2025, 3, 10), None, None)], "site string, night_date date, dusk timestamp, dawn timestamp")
    s = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), 0.0) for i in range(4)], "site string, hour timestamp, cover double")
    out = {r["night_date"].day: (r["n_hours"], r["missing_frac"], r["usable"]) for r in S.run_summary(w, s, ["site"], "night_date", "dusk", "dawn", "cover").collect()}
    assert out == {8: (4, 0.0, True), 9: (4, 1.0, None)}


def test_true_runs_close_at_first_false_or_last_sample(spark):
    flags = [False, True, True, False, True]
    d = spark.createDataFrame([(1, T0 + dt.timedelta(hours=i), f) for i, f in enumerate(flags)], "k int, t timestamp, f boolean")
    got = sorted((r["start"], r["end"]) for r in S.true_runs(d, ["k"], "t", F.col("f")).collect())
    h = lambda i: T0 + dt.timedelta(hours=i)
    assert got == [(h(1), h(3)), (h(4), h(4))]


def test_crossings_interpolate_and_pair(spark):
    alts = [10.0, -10.0, -30.0, -10.0, 10.0]
    d = spark.createDataFrame([(1, T0 + dt.timedelta(hours=i), a) for i, a in enumerate(alts)], "k int, t timestamp, alt double")
    c = S.crossings(d, ["k"], "t", "alt", -20.0)
    assert sorted((r["at"], r["falling"]) for r in c.collect()) == [(T0 + dt.timedelta(minutes=90), True), (T0 + dt.timedelta(minutes=150), False)]
    w = S.dark_windows(c, ["k"]).first()
    assert (w["dusk"], w["dawn"]) == (T0 + dt.timedelta(minutes=90), T0 + dt.timedelta(minutes=150))


def test_best_window_is_first_longest_and_stops_at_dawn(spark):
    h = hours(spark, [0.0, 0.0, 0.9, 0.0, 0.0, 0.9]).withColumn("dawn", F.lit(T0 + dt.timedelta(hours=1, minutes=20)))
    b = S.best_window(h, ["night"], "cover", 0.2, "dawn").first()
    assert (b["start"], b["length"], b["until"]) == (T0, 2, T0 + dt.timedelta(hours=1, minutes=20))


def test_wall_clock_across_dst(spark):
    from nightfold.operators.nights import proxy_night_hours

    days = spark.createDataFrame([("a", dt.date(2025, 3, 8)), ("a", dt.date(2025, 11, 1))], "site string, d date")
    got = sorted(r["hour"] for r in proxy_night_hours(days, ["site"], "d", "America/Los_Angeles", [23, 0, 1, 2, 3]).collect())
    # Spring: 02:00 moves to 03:00 and merges with it. Autumn: the ambiguous 01:00 is dropped.
    assert len(got) == 4 + 4


def test_long_windows_in_words_and_by_blocks(spark):
    import random
    from datetime import datetime, timedelta

    rnd = random.Random(8)
    start = datetime(2024, 3, 1)
    lengths = {"a": 62, "b": 63, "c": 64, "d": 99, "e": 200}
    covers, rows = {}, []
    for k, n in lengths.items():
        covers[k] = [rnd.choice([0.0, 0.1, 0.1, 0.1, None if rnd.random() < 0.2 else 0.05, 0.9 if rnd.random() < 0.2 else 0.0]) for _ in range(n)]
        if k == "c":
            covers[k] = [0.0] * n
        rows += [(k, start + timedelta(hours=i), c) for i, c in enumerate(covers[k]) if c is not None]
    windows = spark.createDataFrame([(k, "p", start, start + timedelta(hours=n - 1)) for k, n in lengths.items()], "site string, night_date string, dusk timestamp, dawn timestamp")
    series = spark.createDataFrame(rows, "site string, hour timestamp, cover double")

    def longest(c):
        best = run = 0
        for v in c:
            run = run + 1 if v is not None and v <= 0.2 else 0
            best = max(best, run)
        return float(best)

    for words in (1, 2, 4):
        out = S.run_summary(windows, series, ["site"], "night_date", "dusk", "dawn", "cover", words=words).collect()
        assert {r["site"]: (r["n_hours"], r["longest_clear_run"]) for r in out} == {k: (n, longest(covers[k])) for k, n in lengths.items()}


def test_slots_beyond_the_words_are_an_error(spark):
    h = spark.createDataFrame([("n", i, 0.0) for i in range(70)], "night string, slot int, cover double")
    bad = h.groupBy("night").agg(*S.summary_aggs(F.col("cover"), S.RunRules()))
    with pytest.raises(Exception, match="needs more words"):
        bad.collect()
