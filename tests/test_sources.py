from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from nightfold.sources import readers as R, sinks as K


def test_station_csv_quirks(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text('station,valid,skyc1,skyc2,skyc3,skyc4,metar\nTRK,2008-01-01 10:53,CLR,M,M,M,NO SN 9"\nTRK,2008-01-01 10:53,CLR,M,M,M,again\nTRK,2008-01-01 11:53,OVC,M,M,M,a\rb\n', newline="")
    out = sorted(R.scan_reports(spark, str(f)).collect(), key=lambda r: r["valid"])
    assert len(out) == 2 and out[0]["valid"] == dt.datetime(2008, 1, 1, 10, 53) and out[1]["metar"] == "a b"
    bad = tmp_path / "b.csv"
    bad.write_text("station,valid\nX,2008-01-01 10:53\n")
    with pytest.raises(ValueError, match="skyc1"):
        R.scan_reports(spark, str(bad))


def payload(n=2, **hourly):
    return json.dumps({"timezone": "GMT", "hourly": {"time": [f"2025-03-08T{h:02d}:00" for h in range(n)], **hourly}})


def test_hourly_json(spark, tmp_path):
    (tmp_path / "20250301_20250308.json").write_text(payload(4, cloud_cover_gfs=[-1, 101, None, 50]))
    rows, bad = R.scan_hourly(spark, str(tmp_path), ["cloud_cover", "cloud_cover_low"], "gfs")
    got = [(r["cloud_cover"], r["cloud_cover_low"]) for r in rows.orderBy("hour").collect()]
    assert got == [(0.0, None), (1.0, None), (None, None), (0.5, None)] and bad.isEmpty()


def test_bad_payloads_are_quarantined(spark, tmp_path):
    (tmp_path / "a_1.json").write_text(payload(2, cloud_cover=[0, 150]))
    (tmp_path / "a_2.json").write_text(payload(2, cloud_cover=[0]))
    (tmp_path / "a_3.json").write_text(json.dumps({"timezone": "PST", "hourly": {"time": ["2025-03-08T00:00"], "cloud_cover": [1]}}))
    (tmp_path / "a_4.json").write_text(json.dumps({"hourly": {}}))
    rows, bad = R.scan_hourly(spark, str(tmp_path), ["cloud_cover"])
    assert rows.isEmpty() and sorted(r["reason"] for r in bad.collect()) == ["length mismatch", "no times", "not UTC", "out of range"]


def test_overlapping_chunks_later_end_wins(spark, tmp_path):
    (tmp_path / "0901_0915.json").write_text(payload(2, cloud_cover=[10, 10]))
    (tmp_path / "0901_0922.json").write_text(payload(1, cloud_cover=[90]))
    rows, _ = R.scan_hourly(spark, str(tmp_path), ["cloud_cover"])
    assert [r["cloud_cover"] for r in R.load_cached(rows).orderBy("hour").collect()] == [0.9, 0.1]


def test_leads_models_and_members(spark, tmp_path):
    (tmp_path / "p_1.json").write_text(payload(1, cloud_cover_previous_day1_gfs=[10], cloud_cover_previous_day2_gfs=[20]))
    rows, _ = R.scan_hourly(spark, str(tmp_path / "p_1.json"), ["cloud_cover_previous_day1", "cloud_cover_previous_day2"], "gfs")
    assert {(r["lead"], r["cover"]) for r in R.previous_runs(rows, [1, 2], "gfs").collect()} == {(1, 0.1), (2, 0.2)}
    (tmp_path / "l_1.json").write_text(payload(1, cloud_cover_a=[10], cloud_cover_b=[30]))
    assert {(r["model"], r["cloud_cover"]) for r in R.scan_forecast_payload(spark, str(tmp_path / "l_1.json"), {"x": "a", "y": "b"}, ["cloud_cover"]).collect()} == {("x", 0.1), ("y", 0.3)}
    (tmp_path / "e_1.json").write_text(payload(1, cloud_cover_ens=[10], cloud_cover_member07_ens=[30], cloud_cover_other=[1]))
    assert {(r["member"], r["cover"]) for r in R.scan_ensemble(spark, str(tmp_path / "e_1.json"), "ens").collect()} == {("control", 0.1), ("member07", 0.3)}
    (tmp_path / "a_1.json").write_text(payload(3, aerosol_optical_depth=[0.1, None, 0.3]))
    assert [r["aod"] for r in R.scan_aerosol(spark, str(tmp_path / "a_1.json")).orderBy("hour").collect()] == [0.1, 0.3]


def test_extracts_last_row_wins(spark, tmp_path):
    d = tmp_path / "SAC"
    d.mkdir()
    (d / "2025-01.csv").write_text("hour,goes_cover,n_good,key\n2025-01-01T05:00:00+00:00,0.5,3,a\n2025-01-01T05:00:00+00:00,nan,0,b\n2025-01-01T06:00:00+00:00,0.25,25,c\n")
    got = {r["hour"].hour: (r["site"], r["cover"], r["n_good"]) for r in R.load_extracts(spark, str(d)).collect()}
    assert got == {5: ("SAC", None, 0), 6: ("SAC", 0.25, 25)}


def test_satellite_boxes_ignore_bad_pixels(spark):
    px = [(1, r, c, 1 if c == 1 else 0, 0 if (r, c) != (0, 0) else 3) for r in range(3) for c in range(3)]
    pixels = spark.createDataFrame(px, "scan int, row int, col int, bcm int, dqf int")
    sites = spark.createDataFrame([("a", 1, 1), ("z", 99, 99)], "site string, site_row int, site_col int")
    got = {r["site"]: (r["cover"], r["n_good"]) for r in R.satellite_boxes(pixels, sites, 1).collect()}
    assert got == {"a": (3 / 8, 8), "z": (None, 0)}


def test_satellite_boxes_add_up_pixels_before_they_meet_sites(spark):
    """Many pixels of one place and many sites on it: the join holds a row per box, place and scan, not per pixel and site."""
    px = [(i % 2, i % 3, 0, i % 3, 0 if i % 5 else None) for i in range(600)] + [(None, 1, 0, 1, 0), (7, 2, 0, 1, 3)]
    pixels = spark.createDataFrame(px, "scan int, row int, col int, bcm int, dqf int")
    at = [("a", 1, 1), ("a", 1, 1), ("a", 2, 0), (None, 1, 1), ("n", None, 1), ("z", 99, 9)] + [(f"s{i}", 1, 0) for i in range(50)]
    sites = spark.createDataFrame(at, "site string, site_row int, site_col int")
    out = R.satellite_boxes(pixels, sites, 1)
    want = []
    for site, _, _ in at:
        scans: dict = {}
        for other, r, c in at:
            for scan, row, col, bcm, dqf in px:
                if site is not None and other == site and None not in (r, c) and abs(row - r) <= 1 and abs(col - c) <= 1:
                    scans.setdefault(scan, []).extend([bcm] if dqf == 0 and bcm in (0, 1) else [])
        want += [(site, k, sum(v) / len(v) if v else None, len(v)) for k, v in scans.items()] or [(site, None, None, 0)]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "dqf" in line and "LogicalRDD" in line)
    above = [line for line in lines[:scan] if "Join" in line or "Aggregate" in line]
    assert "Aggregate" in above[-1]  # pixels are aggregated before any join


def test_places_and_stations(spark, tmp_path):
    (tmp_path / "p.txt").write_text("﻿USPS|GEOID|ANSICODE|NAME|LSAD|ALAND|INTPTLAT|INTPTLONG \nCA|06|123|Davis city|25|2000000|38.5|-121.7\nNV|32|9|Reno city|25|1|1|1\n")
    p = R.scan_census_places(spark, str(tmp_path / "p.txt"), "CA").collect()
    assert [(r["name"], r["kind"], r["land_km2"], r["lon"]) for r in p] == [("Davis", "city", 2.0, -121.7)]
    (tmp_path / "c.txt").write_text("US.CA.113\tYolo County\tYolo\t1\n")
    counties = R.scan_counties(spark, str(tmp_path / "c.txt"), "US.CA.")
    line = ["1", "Davis", "", "", "38.5", "-121.7", "P", "PPL", "US", "", "CA", "113", "", "", "", "", "16", "", ""]
    (tmp_path / "g.txt").write_text("\t".join(line) + "\n")
    g = R.scan_geonames(spark, str(tmp_path / "g.txt"), counties, "CA").first()
    assert (g["county"], g["population"], g["dem"]) == ("Yolo", 0, 16.0)
    (tmp_path / "n.json").write_text(json.dumps({"features": [{"geometry": {"coordinates": [-121.5, 38.5]}, "properties": {"sid": "SAC", "sname": "Sacramento", "elevation": 5.0, "tzname": "America/Los_Angeles", "archive_begin": "1941-01-01", "online": True, "wfo": "STO", "county": "Sacramento", "attributes": {"IS_AWOS": "1"}}}]}))
    s = R.scan_stations(spark, str(tmp_path / "n.json")).first()
    assert (s["lat"], s["lon"], s["is_awos"], s["archive_begin"]) == (38.5, -121.5, True, dt.date(1941, 1, 1))


def test_station_lines_that_do_not_parse_are_kept_apart(spark):
    lines = spark.createDataFrame([("TRK,2008-01-01 10:53,CLR,M,M,M,x",), ("TRK,never,CLR,M,M,M,x",), ("TRK,2008-01-01",)], "value string")
    rows, bad = R.parse_reports(lines, ["station", "valid", "skyc1", "skyc2", "skyc3", "skyc4", "metar"])
    assert rows.count() == 1 and sorted(tuple(r) for r in bad.collect()) == [("TRK,2008-01-01", "too few fields"), ("TRK,never,CLR,M,M,M,x", "unreadable time")]


def test_torn_json_is_quarantined(spark):
    p = spark.createDataFrame([('{"timezone": "GMT", "hourly": {"time": ["2025-', "a_1.json")], "value string, file string")
    rows, bad = R.parse_hourly(p, ["cloud_cover"])
    assert rows.isEmpty() and [r["reason"] for r in bad.collect()] == ["not JSON"]


def test_network_list(spark, tmp_path):
    (tmp_path / "n.yaml").write_text("# head\nquotas:\n  A: 1\nstations:\n- elevation_m: 12.5\n  id: KSFO\n  lat: 37.6\n  lon: -122.4\n  name: 'San: Francisco'\n  region: bay\n  timezone: America/Los_Angeles\n- id: KX\n  name: X\n")
    got = {r["id"]: tuple(r)[1:] for r in R.scan_network(spark, str(tmp_path / "n.yaml")).collect()}
    assert got == {"KSFO": ("San: Francisco", 37.6, -122.4, 12.5, "bay", "America/Los_Angeles"), "KX": ("X", None, None, None, None, None)}


def test_json_sinks_turn_nan_into_null(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 0.5)], "i int, v double")
    K.write_json(df, str(tmp_path / "m"))
    got = sorted((r["i"], r["v"]) for r in spark.read.schema("i int, v double").json(str(tmp_path / "m")).collect())
    assert got == [(1, None), (2, None), (3, 0.5)]


def test_climatology_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("primary", "a", 1, 0.25, 4), ("primary", "a", 2, 0.5, 2), ("goes", "b", 1, 1.0, 1)], "label string, site string, month int, rate double, n long")
    K.climatology_to_json(t).write.json(str(tmp_path / "c"))
    assert sorted(map(tuple, K.read_climatology(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, t.collect()))


def test_log_first_forecast_of_the_day_wins(spark):
    schema = "issue_date string, site string, night_date string, p double, at int"
    old = spark.createDataFrame([("d1", "a", "n1", 0.1, 1)], schema)
    new = spark.createDataFrame([("d1", "a", "n1", 0.9, 2), ("d1", "a", "n2", 0.4, 3), ("d1", "a", "n2", 0.5, 2)], schema)
    assert [(r["night_date"], r["p"]) for r in K.append_log(old, new, ["at"]).collect()] == [("n2", 0.5)]


def test_dataset_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(2025, 1, 1), 1, 9, 0.5, None)], "site string, night_date date, lead int, dark_hours int, x_frac_clear double, usable_primary boolean")
    K.save_dataset(df, str(tmp_path / "d"))
    assert K.load_dataset(spark, str(tmp_path / "d")).select(*df.columns).collect() == df.collect()
    assert R.scan_log is not None and F is not None
