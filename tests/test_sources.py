"""Readers, writers and the streaming counterparts."""

from __future__ import annotations

import gzip
import hashlib
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paneloom.config import PanelConfig
from paneloom.operators import measurement
from paneloom.sources import files, measurements, rules, sinks
from paneloom.streaming import windows


def archive(path, text, name="a.csv"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(name, text)


def test_zipped_csv(spark, tmp_path):
    archive(tmp_path / "x.zip", '\ufeffState Code,POC,Extra\n01,"1",a\n02,2\n03,3,c\n')
    rows = files.zipped_csv(spark, f"file://{tmp_path}/x.zip", ["State Code", "POC"]).orderBy("State Code").collect()
    assert [(r["State Code"], r["POC"], r["is_ragged"]) for r in rows] == [(None, None, True), ("01", "1", False), ("03", "3", False)]
    with pytest.raises(Exception, match="no column"):
        files.zipped_csv(spark, f"file://{tmp_path}/x.zip", ["Nope"]).count()
    archive(tmp_path / "y.zip", "a", "a.txt")
    with pytest.raises(Exception, match="0 CSV members"):
        files.zipped_csv(spark, f"file://{tmp_path}/y.zip", ["a"]).count()


def test_daily_weather(spark, tmp_path):
    lines = ["US1,20200101,TMAX,251,,,S,0700", "US1,20200102,TMAX,-9999,,,S,", "US1,20200103,TMAX,1,,G,S,", "US1,20200104,TMAX,1,,,,", "CA1,20200101,TMAX,1,,,S,", "US1,20209901,TMAX,1,,,S,", "US1,20200101,PRCP,1,,,S,"]
    (tmp_path / "w.csv.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    rows = files.daily_weather(spark, f"file://{tmp_path}/w.csv.gz").withColumn("reason", files.weather_reason())
    assert [r["reason"] for r in rows.collect()] == [None, "missing", "quality", "source", "other", "other", "other"]


DAILY = {"State Code": "01", "Parameter Code": "44201", "Sample Duration": "8-HR RUN AVG BEGIN HOUR", "Pollutant Standard": "Ozone 8-hour 2015", "Units of Measure": "Parts per million", "Event Type": "None", "Observation Count": "17", "1st Max Value": "0.0719"}
HOURLY = {"State Code": "56", "Parameter Code": "44201", "Parameter Name": "Ozone", "Units of Measure": "Parts per million", "Method Type": "FEM", "Method Code": "047", "Sample Measurement": "0.031", "code_reason": None}
WEATHER = {"station": "USW00012345", "date": "20200229", "element": "TMAX", "value": "-12", "m_flag": None, "q_flag": "", "s_flag": "S", "obs_time": "0700"}


def reasons(spark, base, changes, reason):
    rows = [(i, *(base | change).values()) for i, (change, _) in enumerate(changes)]
    ddl = ", ".join(["i int", *[f"`{c}` string" for c in base]])
    got = {r["i"]: r["reason"] for r in spark.createDataFrame(rows, ddl).withColumn("reason", reason).collect()}
    assert [got[i] for i in range(len(changes))] == [expected for _, expected in changes]


def test_daily_rows(spark):
    reasons(spark, DAILY, [
        ({}, None), ({"Pollutant Standard": None}, "not the target"), ({"State Code": "02"}, "out of scope"), ({"State Code": "72"}, "out of scope"), ({"State Code": "1"}, "out of scope"), ({"Event Type": "Excluded"}, "events excluded"),
        ({"Observation Count": "x"}, "no count"), ({"1st Max Value": "inf"}, "no value"), ({"1st Max Value": "NaN"}, "no value"), ({"Observation Count": "12"}, "incomplete day"),
    ], rules.daily_reason())
    row = spark.createDataFrame([tuple(DAILY.values())], ", ".join(f"`{c}` string" for c in DAILY)).select(rules.daily_ppb()).first()
    assert row[0] == 71


def test_hourly_rows(spark):
    reasons(spark, HOURLY, [
        ({}, None), ({"Units of Measure": "ppb"}, "not the target"), ({"State Code": "15"}, "out of scope"), ({"Method Code": "47"}, "method"), ({"Method Type": "other"}, "method"), ({"code_reason": "unknown code"}, "unknown code"),
        ({"Sample Measurement": ""}, "no value"),
    ], rules.hourly_reason(F.col("code_reason")))


def test_weather_forms(spark):
    reasons(spark, WEATHER, [
        ({}, None), ({"station": "US1"}, "station"), ({"date": "20210229"}, "date"), ({"date": "2021-01-1"}, "date"), ({"value": "1.5"}, "value"), ({"value": None}, "value"), ({"q_flag": "A"}, "quality flag"), ({"m_flag": "BB"}, "measurement flag"),
        ({"s_flag": "?"}, "source flag"), ({"obs_time": "700"}, "time"), ({"obs_time": ""}, None),
    ], rules.weather_form_reason())


def rows_of(columns, base, changes):
    lines = [",".join(columns)]
    for change in changes:
        lines.append(",".join((base | change).get(c, "") for c in columns))
    return "\n".join(lines) + "\n"


def test_measurement_archives(spark, tmp_path):
    place = {"County Code": "003", "Site Num": "0010", "POC": "1", "Date Local": "2020-07-01"}
    hours = HOURLY | place | {"Time Local": "07:00", "Qualifier": ""}
    archive(tmp_path / "h.zip", rows_of(measurements.HOURLY, hours, [{}, {"Time Local": "07:30"}, {"Qualifier": "AN"}, {"Qualifier": "IT"}, {"Qualifier": "??"}, {"Site Num": "10"}, {"Sample Measurement": "x"}]) + "a,b\n")
    codes = spark.createDataFrame([("AN", "Malfunction", "Null Data Qualifier"), ("IT", "Wildfire", "Informational Only")], "code string, description string, kind string")
    got = measurements.hourly(spark, f"file://{tmp_path}/h.zip", codes).collect()
    assert [r["reason"] for r in got] == [None, "time", "rejected code", None, "unknown code", "identifier", "no value", "fields"]
    assert (got[0]["site_id"], got[0]["local_hour"], got[0]["ppb"]) == ("56-003-0010", 7, 31.0) and got[2]["ppb"] is None
    days = DAILY | place | {"Date of Last Change": "2021-02-03"}
    archive(tmp_path / "d.zip", rows_of(measurements.DAILY, days, [{}, {}, {"Observation Count": "3"}, {"Date Local": "2020-13-01"}, {"Date Local": "2020-07-02"}]))
    rows = measurements.daily(spark, f"file://{tmp_path}/d.zip")
    assert [(r["reason"], r["value"]) for r in rows.collect()] == [(None, 71.0), (None, 71.0), ("incomplete day", None), ("time", None), (None, 71.0)]
    assert measurements.available_days(rows).count() == 2
    plan = files.bulk_plan(spark, [2020, 2021], {"hourly": "h_{year}.zip", "daily": "d_{year}.zip"}, ["codes.csv"])
    assert {r["file"] for r in plan.collect()} == {"h_2020.zip", "h_2021.zip", "d_2020.zip", "d_2021.zip", "codes.csv"}


def test_file_report(spark, tmp_path):
    for name, lines in {"a": "01,2020-01-01\n01,2020-02-01\n", "b": "01,2019-12-31\n", "c": "xx,2020-05-05\n", "d": "\n"}.items():
        (tmp_path / f"{name}.csv").write_text(lines)
    rows = spark.read.schema("state string, day date").csv(f"file://{tmp_path}/*.csv").withColumn("file", F.input_file_name())
    got = {r["name"]: r for r in rules.file_report(rows, files.file_summary(spark, f"file://{tmp_path}/*.csv"), F.col("day"), 2020, F.when(F.col("state") == "xx", "state")).collect()}
    assert {n: r["verdict"] for n, r in got.items()} == {"a.csv": "valid", "b.csv": "out of year", "c.csv": "rejected rows", "d.csv": "empty"}
    assert got["a.csv"]["n_rows"] == 2 and got["a.csv"]["sha256"] == hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()


def test_identifiers(spark):
    base = {"State Code": "01", "County Code": "003", "Site Num": "0010", "Parameter Code": "44201", "POC": "1"}
    reasons(spark, base, [({}, None), ({"County Code": "3"}, "County Code"), ({"POC": "123"}, "POC"), ({"Site Num": None}, "Site Num")], rules.identifier_reason())


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 1200, 0.5, True, None), ("<c>", 3, -0.25, False, "x")], "name string, n int, v double, ok boolean, note string")
    text = sinks.markdown(rows, title="T", note="N", labels={"<c>": "see"})
    assert text.splitlines()[0] == "## T" and "| a\\|b | 1,200 | 0.5 | yes |  |" in text and "| see |" in text and text.endswith("*Note:* N\n")
    assert "<td>&lt;c&gt;</td>" in sinks.html(rows, caption="A & B") and "<caption>A &amp; B</caption>" in sinks.html(rows, caption="A & B")
    entry = sinks.write_report(rows, tmp_path / "r.csv", ["name", "n"])
    assert entry["rows"] == 2 and entry["sha256"] == hashlib.sha256((tmp_path / "r.csv").read_bytes()).hexdigest()
    with pytest.raises(ValueError):
        sinks.html(rows, caption="x", most=1)
    shown = rows.select(sinks.interval_text(F.col("v"), F.lit(-1.0), F.lit(2.0)).alias("i"), sinks.signed_text(F.col("v")).alias("d"), sinks.signed_text(F.col("v") / 1000, 2).alias("s")).collect()
    assert [tuple(r) for r in shown] == [("+0.50 [-1.00, 2.00]", "+0.500", "+0.001"), ("-0.25 [-1.00, 2.00]", "\u22120.250", "\u22120.000")]
    assert sinks.selected(rows, name="a|b", ok=True).count() == 1


def test_stations(spark, tmp_path):
    (tmp_path / "s.txt").write_text("US000000001  40.5000 -100.2500 -999.9 NE NAME\nCA000000002  50.0000 -100.0000  100.0\nUS000000003  41.0000  -99.0000  250.5\n")
    got = {r["station"]: (r["latitude"], r["longitude"], r["elevation"]) for r in files.stations(spark, f"file://{tmp_path}/s.txt").collect()}
    assert got == {"US000000001": (40.5, -100.25, None), "US000000003": (41.0, -99.0, 250.5)}


def test_last_row_of_a_code_wins(spark, tmp_path):
    (tmp_path / "q.csv").write_text("code,kind\nA,old\nB,only\nA,new\n")
    got = {r["code"]: r["kind"] for r in files.last_by_file_order(spark, f"file://{tmp_path}/q.csv", ["code"]).collect()}
    assert got == {"A": "new", "B": "only"}


def test_attempt_checkpoints(spark, tmp_path):
    schema = "attempt int, replicate int, success boolean, quantities map<string, map<string, double>>"
    for i, ok in enumerate([True, False, True]):
        sinks.write_once(tmp_path / f"{i}.json", {"attempt": i, "replicate": i, "success": ok, "quantities": {"R": {"A": 1.5, "B": float(i)}}})
    rows = files.attempts(spark, f"file://{tmp_path}/*.json", schema)
    assert sinks.long_attempts(rows).where("quantity = 'B'").agg(F.sum("value")).first()[0] == 2.0
    sinks.write_once(tmp_path / "0.json", {"attempt": 0, "replicate": 0, "success": True, "quantities": {"R": {"A": 1.5, "B": 0.0}}})
    with pytest.raises(FileExistsError):
        sinks.write_once(tmp_path / "0.json", {"attempt": 0})
    sinks.write_once(tmp_path / "9.json", {"attempt": 9, "replicate": 2, "success": True, "quantities": {}})
    with pytest.raises(ValueError, match="successful replicate"):
        files.attempts(spark, f"file://{tmp_path}/*.json", schema)


def test_manifest_and_summary(spark, tmp_path):
    sinks.append_line(tmp_path / "m.jsonl", {"file": "a", "bytes": 3})
    sinks.append_line(tmp_path / "m.jsonl", {"file": "b", "bytes": 4})
    assert files.manifest(spark, f"file://{tmp_path}/m.jsonl", "file string, bytes long").agg(F.sum("bytes")).first()[0] == 7
    got = files.file_summary(spark, f"file://{tmp_path}/m.jsonl").first()
    assert got["sha256"] == hashlib.sha256((tmp_path / "m.jsonl").read_bytes()).hexdigest()
    assert files.request_plan(spark, [2020, 2021], ["01", "02", "04"], "http://x/{year}/{state}").count() == 6
    with pytest.raises(ValueError):
        files.require_columns(spark.range(1), ["id"], forbidden=["id"])


def test_fit_and_panel_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i % 3}", f"2020-01-{i + 1:02d}", float(i)) for i in range(20)], "site_id string, date_local string, y double")
    sinks.write_panel(rows, f"file://{tmp_path}/p", files=2)
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == 20
    sinks.write_fit(rows, f"file://{tmp_path}/f", {"sites": 3})
    assert sinks.read_fit(spark, f"file://{tmp_path}/f", {"sites": 3}).count() == 20
    with pytest.raises(ValueError):
        sinks.read_fit(spark, f"file://{tmp_path}/f", {"sites": 4})
    assert sinks.markdown(rows.limit(1), ["site_id", "y"]).splitlines()[1] == "|---|--:|"
    assert json.loads(json.dumps({"a": 1})) == {"a": 1}


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2020, 1, 1)
    hours = [(s, start + timedelta(hours=h), float((7 * h + s) % 50)) for s in (1, 2) for h in range(96) if (h + s) % 5]
    frame = spark.createDataFrame(hours, "site int, ts timestamp, ppb double")
    frame.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"file://{tmp_path}/in")
    q = windows.moving_means(stream).writeStream.outputMode("append").format("memory").queryName("means").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["site"], r["ts"]): r["mean"] for r in spark.table("means").collect()}
    batch = {(r["site"], r["ts"]): r["mean"] for r in windows.moving_means(frame).collect()}
    assert got and set(got.items()) <= set(batch.items())
    by_day = measurement.daily_windows(frame.select("site", F.to_date("ts").alias("date_local"), F.hour("ts").alias("local_hour"), "ppb"), "site", PanelConfig())
    one = {(r["site"], r["date_local"]): r["mda8"] for r in by_day.collect() if r["mda8"] is not None}
    two = {(r["site"], r["date_local"]): r["mda8"] for r in windows.daily_maxima(frame).collect() if r["mda8"] is not None}
    assert one == two and one
