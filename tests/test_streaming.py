from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from nightfold.streaming import jobs as J
from nightfold.streaming.daylog import DayLog

T0 = dt.datetime(2025, 1, 1, 0)


def feed(spark, tmp_path, rows, schema, name="in", parts=1):
    """Writes rows as `parts` separate files and returns the folder."""
    path = str(tmp_path / name)
    step = max(1, (len(rows) + parts - 1) // parts)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def run_to_table(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


SCHEMA = "site string, valid timestamp, cover double"


def test_hourly_nearest_matches_the_batch_operator(spark, tmp_path):
    from nightfold.operators.timeseries import hourly_cover

    rows = [("a", T0 + dt.timedelta(minutes=7 * i), None if i % 5 == 0 else (i % 11) / 10) for i in range(60)]
    rows.append(("a", T0 + dt.timedelta(days=3), 0.0))  # moves the watermark past everything before it
    path = feed(spark, tmp_path, rows, SCHEMA)
    batch = {(r["hour"], r["cover"]) for r in hourly_cover(spark.read.parquet(path), ["site"], "valid", "cover").collect() if r["hour"] < T0 + dt.timedelta(days=2)}
    stream = J.hourly_nearest(spark.readStream.schema(SCHEMA).parquet(path), ["site"], "valid", "cover")
    got = {(r["hour"], r["cover"]) for r in run_to_table(stream, "hourly_out").collect()}
    assert got == batch


def test_clear_runs_split_at_gaps(spark, tmp_path):
    covers = [0.0, 0.1, 0.9, 0.0, None, 0.0, 0.0, 0.0]
    rows = [("a", T0 + dt.timedelta(hours=i), c) for i, c in enumerate(covers)] + [("a", T0 + dt.timedelta(days=3), 0.0)]
    path = feed(spark, tmp_path, rows, SCHEMA.replace("valid", "hour"))
    s = J.clear_runs(spark.readStream.schema(SCHEMA.replace("valid", "hour")).parquet(path), ["site"], "hour", "cover")
    got = sorted((r["start"].hour, r["length"]) for r in run_to_table(s, "runs_out").collect())
    assert got == [(0, 2), (3, 1), (5, 3)]


LOG = "issue_date date, site string, night_date date, at timestamp, p double"


def test_first_wins_log_across_runs_and_replays(spark, tmp_path):
    d = dt.date(2025, 1, 1)
    path = feed(spark, tmp_path, [(d, "a", d, T0, 0.1), (d, "b", d, T0, 0.2)], LOG)
    out, ck = str(tmp_path / "log"), str(tmp_path / "ck")
    stream = lambda: spark.readStream.schema(LOG).parquet(path)
    keys = ["issue_date", "site", "night_date"]
    J.first_wins_log(stream(), keys, ["at"], out, ck, "issue_date").awaitTermination()
    spark.createDataFrame([(d, "a", d, T0, 0.9), (d, "c", d, T0 + dt.timedelta(hours=1), 0.4), (d, "c", d, T0, 0.3)], LOG).coalesce(1).write.mode("append").parquet(path)
    J.first_wins_log(stream(), keys, ["at"], out, ck, "issue_date").awaitTermination()
    log = DayLog(out, stream().schema, "issue_date", keys, ["at"])
    got = sorted((r["site"], r["p"]) for r in log.current(spark).collect())
    assert got == [("a", 0.1), ("b", 0.2), ("c", 0.3)]


def test_a_log_is_filed_by_day_and_folded(spark, tmp_path):
    """Replays replace, folding keeps the rows, dead folders do not count even before they are removed."""
    day = lambda n: dt.date(2025, 1, 1) + dt.timedelta(days=n)
    make = lambda rows: spark.createDataFrame(rows, LOG)
    log = DayLog(str(tmp_path / "log"), make([]).schema, "issue_date", ["issue_date", "site", "night_date"], ["at"])
    assert log.current(spark).isEmpty()
    first = make([(day(0), "a", day(0), T0, 0.1), (day(1), "a", day(1), T0, 0.2)])
    for _ in range(2):  # a replay
        log.append(first, 0)
    log.append(make([(day(0), "a", day(0), T0, 0.9), (day(0), "b", day(0), T0, 0.3)]), 1)
    log.append(make([]), 2)
    log.append(make([(day(0), "b", day(0), T0, 0.8), (day(0), "c", day(0), T0, 0.4), (day(5), "z", day(5), T0, 0.5)]), 3)
    want = [("a", 0.1), ("a", 0.2), ("b", 0.3), ("c", 0.4), ("z", 0.5)]
    values = lambda: sorted((r["site"], r["p"]) for r in log.current(spark).collect())
    assert values() == want
    plan = log.rows(spark, day(1), day(1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(issue_date" in plan and [r["p"] for r in log.current(spark, day(1), day(1)).collect()] == [0.2]
    before = log.current(spark).withColumn("first", F.lit(0).cast("long")).withColumn("last", F.lit(1).cast("long")).filter("issue_date = date '2025-01-01' and site in ('a', 'b')")
    before.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("issue_date", "first", "last").parquet(log.path)  # folded, nothing removed yet
    assert values() == want
    assert log.fold(spark, 3) >= 3 and values() == want
    assert log.rows(spark).select("issue_date", "first", "last").distinct().groupBy("issue_date").count().filter("count > 1").isEmpty()
    log.append(make([(day(0), "c", day(0), T0, 0.7), (day(0), "d", day(0), T0, 0.6)]), 4)
    assert values() == [*want[:4], ("d", 0.6), ("z", 0.5)]


def test_later_chunks_replace_whenever_they_come(spark, tmp_path):
    schema = "day date, hour int, chunk_end string, cover double"
    d = dt.date(2025, 1, 1)
    make = lambda rows: spark.createDataFrame(rows, schema)
    log = DayLog(str(tmp_path / "log"), make([]).schema, "day", ["day", "hour"], ["chunk_end"], later=True)
    log.append(make([(d, 0, "0922", 0.9), (d, 1, "0922", 0.5)]), 0)
    log.append(make([(d, 0, "0915", 0.1), (d, 2, "0915", 0.2)]), 1)
    log.append(make([(d, 1, "0930", 0.7)]), 2)
    values = lambda: sorted((r["hour"], r["cover"]) for r in log.current(spark).collect())
    assert values() == [(0, 0.9), (1, 0.7), (2, 0.2)]
    log.fold(spark, 2)
    assert values() == [(0, 0.9), (1, 0.7), (2, 0.2)] and log.rows(spark).count() == 3


def test_first_wins_within_watermark(spark, tmp_path):
    path = feed(spark, tmp_path, [("a", T0, 0.1), ("a", T0, 0.2), ("b", T0, 0.3)], SCHEMA)
    s = J.first_wins_within(spark.readStream.schema(SCHEMA).parquet(path), ["site"], "valid", "1 day")
    assert sorted(r["site"] for r in run_to_table(s, "first_out").collect()) == ["a", "b"]


def test_ingest_resumes_without_repeats(spark, tmp_path):
    path = feed(spark, tmp_path, [("a", T0, 0.1), ("b", T0, 0.2)], SCHEMA, parts=2)
    schema = spark.read.parquet(path).schema
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    J.ingest(spark, path, schema, out, ck, per_batch=1).awaitTermination()
    spark.createDataFrame([("c", T0, 0.3)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    J.ingest(spark, path, schema, out, ck, per_batch=1).awaitTermination()
    rows = J.read_batches(spark, out, schema)
    assert sorted(r["site"] for r in rows.collect()) == ["a", "b", "c"] and rows.select("batch").distinct().count() == 3


def test_late_chunks_are_resolved_on_read(spark, tmp_path):
    schema = "hour timestamp, chunk_end string, stem string, cover double"
    path = feed(spark, tmp_path, [(T0, "0922", "0901_0922", 0.9)], schema)
    spark.createDataFrame([(T0, "0915", "0901_0915", 0.1), (T0 + dt.timedelta(hours=1), "0915", "0901_0915", 0.2)], schema).write.mode("append").parquet(path)
    st = spark.read.parquet(path).schema
    J.ingest(spark, path, st, str(tmp_path / "o"), str(tmp_path / "k")).awaitTermination()
    got = J.resolve_later(spark, str(tmp_path / "o"), st, ["hour"], ["chunk_end", "stem"])
    assert [r["cover"] for r in got.orderBy("hour").collect()] == [0.9, 0.2]


def test_settled_policy(spark):
    rows = [(dt.date(2025, 1, 31), 0), (dt.date(2025, 1, 31), 3), (dt.date(2024, 12, 1), 0)]
    d = spark.createDataFrame(rows, "chunk_end date, values int")
    got = [r["s"] for r in d.select(J.settled(F.col("chunk_end"), F.col("values"), F.lit("2025-02-10").cast("date")).alias("s")).collect()]
    assert got == [False, True, True]


def test_delayed_verification_waits_then_gives_up(spark, tmp_path):
    fs, ls = "site string, night timestamp, p double", "site string, night timestamp, y int"
    end = T0 + dt.timedelta(days=200)
    f = feed(spark, tmp_path, [("a", T0, 0.7), ("b", T0, 0.4), ("a", end, 0.1)], fs, "f")
    lab = feed(spark, tmp_path, [("a", T0, 1), ("z", end, 0)], ls, "l")
    read = lambda p, s: spark.readStream.schema(s).parquet(p)
    out = J.delayed_verification(read(f, fs), read(lab, ls))
    got = {(r["site"], r["night"] == T0): r["y"] for r in run_to_table(out, "verified_out").collect()}
    assert got[("a", True)] == 1 and got.get(("b", True), "missing") is None


def test_running_scores_add_up_over_batches(spark, tmp_path):
    schema = "label string, lead int, method string, kind string, family string, night_date date, y int, p double"
    rows = [("primary", 1, m, "prob", m, dt.date(2025, 1, 1) + dt.timedelta(days=7 * i), i % 2, p) for i in range(10) for m, p in (("climatology", 0.5), ("blend", 0.2 + 0.6 * (i % 2)))]
    path = feed(spark, tmp_path, rows, schema, parts=4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    J.score_batches(stream, str(tmp_path / "s"), str(tmp_path / "k")).awaitTermination()
    got = {r["method"]: r for r in J.running_scores(spark, str(tmp_path / "s")).collect()}
    assert got["blend"]["n"] == 10 and got["blend"]["n_weeks"] == 10 and got["blend"]["enough_weeks"]
    assert round(got["blend"]["bss"], 9) == round(1 - 0.04 / 0.25, 9)
