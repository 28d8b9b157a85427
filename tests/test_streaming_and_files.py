"""Streams equal batches across a restart; files in and out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plantlens import views
from plantlens.operators import clean, health, incidents, scale, windows
from plantlens.sources.files import read_alerts, read_telemetry_csv, write_results
from plantlens.streaming import telemetry as st


def run(query_of, folder, name):
    writer = query_of.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True)
    writer.start().awaitTermination(180)


@pytest.fixture(scope="module")
def feed(spark, sf, tmp_path_factory):
    """ev in three files by time; the third arrives after the first run."""
    folder = str(tmp_path_factory.mktemp("feed"))
    ev = views.ev(spark, sf).select("stream_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value", "k")
    cuts = [r[0] for r in ev.selectExpr("explode(percentile(unix_micros(ts), array(0.34, 0.67))) c").collect()]
    part = F.when(F.unix_micros("ts") < int(cuts[0]), 0).when(F.unix_micros("ts") < int(cuts[1]), 1).otherwise(2)
    parts = [ev.filter(part == k).coalesce(1) for k in range(3)]
    return folder, ev.schema, parts, views.ev(spark, sf)


def test_stream_equals_batch_across_restart(spark, feed, tmp_path):
    folder, schema, parts, ev = feed
    out = str(tmp_path)
    makers = {
        "windows": lambda s: st.stream_windows(s, ["value"], 5, ties=("event_id",)),
        "health": lambda s: st.stream_health(s, ["k"], 2, ties=("event_id",)),
        "incidents": lambda s: st.stream_incidents(s, 100.0, "value", ties=("event_id",), top="event_id"),
        "faults": lambda s: st.stream_faults(s, ["k"], 2, ties=("event_id",), from_seq=1),
    }
    for wave in ((0, 1), (2,)):
        for k in wave:
            parts[k].write.mode("append").parquet(folder + "/in")
        for name, make in makers.items():
            run(make(st.stream_telemetry(spark, folder + "/in", schema)), out, name)
    got = spark.read.parquet(out + "/windows").select("stream_id", "window_id", F.element_at("flat", -1).alias("v"))
    want = windows.sliding_windows(ev, ["value"], 5).select("stream_id", "window_id", F.element_at(F.flatten("values"), -1).alias("v"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    got = spark.read.parquet(out + "/health").select("stream_id", "seq", "healthy")
    want = health.health(health.unchanged_runs(health.long_frame(ev, ["k"])), 2).select("stream_id", "seq", "healthy")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    tops = spark.read.parquet(out + "/incidents").groupBy("stream_id", "alert_id").agg(F.max_by("top_features", "version").cast("long").alias("top_features"))
    want = incidents.incidents(ev, 100.0, "value", top="event_id").select("stream_id", "alert_id", "top_features")
    assert tops.exceptAll(want).count() == 0 and tops.count() == want.count()
    fields = ["status", "channel", "anomaly_count", "start_seq", "end_seq", "reason"]
    faults = spark.read.parquet(out + "/faults").groupBy("stream_id", "alert_id").agg(F.max_by(F.struct(*fields), "version").alias("a")).select("stream_id", "alert_id", "a.*")
    stuck = health.stuck_channels(health.unchanged_runs(health.long_frame(ev, ["k"])), 2)
    want = incidents.fault_incidents(stuck, ev.select("stream_id", "seq", "ts"), from_seq=1).select("stream_id", "alert_id", *fields)
    assert faults.exceptAll(want).count() == 0 and faults.count() == want.count() > 0
    last = spark.read.parquet(out + "/incidents").groupBy("stream_id", "alert_id").agg(F.max_by(F.struct("status", "anomaly_count", "severity", "anomaly_score"), "version").alias("a")).select("stream_id", "alert_id", "a.*")
    want = incidents.incidents(ev, 100.0, "value").select("stream_id", "alert_id", "status", "anomaly_count", "severity", "anomaly_score")
    assert last.exceptAll(want).count() == 0 and last.count() == want.count()


def feed_in_order(spark, folder, batches, kind):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.read.parquet(f"{folder}/in").schema


def test_order_ties_and_reset(spark, tmp_path):
    folder, kind = str(tmp_path), "stream_id long, ts long, v double, again boolean"
    waves = [[(1, 10, 1.0, False), (1, 30, 3.0, False)], [(1, 20, 2.0, False), (1, 30, 3.5, False), (1, 60, 6.0, False)], [(1, 5, 0.5, False), (1, 61, 7.0, True), (1, 62, 7.0, False), (1, 200, 9.0, False)]]
    for wave in waves:
        schema = feed_in_order(spark, folder, [wave], kind)
        run(st.ordered_stream(st.stream_telemetry(spark, folder + "/in", schema), 15), folder, "ordered")
    got = sorted(((r.seq, r.v, r.late) for r in spark.read.parquet(folder + "/ordered").collect()), key=str)
    # 10 is let out by 30; 20 and both samples of 30 by 60; 5 is late; 60 to 62 by 200, which waits itself.
    assert got == sorted([(0, 1.0, False), (1, 2.0, False), (2, 3.0, False), (3, 3.5, False), (None, 0.5, True), (4, 6.0, False), (5, 7.0, False), (6, 7.0, False)], key=str)
    with pytest.raises(ValueError):
        st.ordered_stream(st.stream_telemetry(spark, folder + "/in", schema), 15, on_late="x")
    run(st.stream_health(st.stream_telemetry(spark, folder + "/in", schema, max_files=10), ["v"], 2, reset="again"), folder, "health")
    seen = sorted((r.ts.timestamp(), r.seq, r.healthy) for r in spark.read.parquet(folder + "/health").collect())
    assert [x[1:] for x in seen if x[0] >= 61] == [(0, True), (1, False), (2, True)]
    assert sum(x[0] == 30 for x in seen) == 2  # both samples of one time


def test_sessions_params_and_alert_folder(spark, tmp_path):
    folder, kind = str(tmp_path), "stream_id long, ts long, score double"
    schema = feed_in_order(spark, folder, [[(1, 10, 5.0), (1, 15, 7.0), (1, 20, 0.0), (1, 100, 9.0)], [(2, 10_000, 0.0), (1, 10_000, 0.0), (1, 10_001, 8.0)], [(1, 90_000, 6.0)]], kind)
    run(st.session_incidents(st.stream_telemetry(spark, folder + "/in", schema), 1.0, "30 seconds", delay="1 minute"), folder, "sessions")
    got = sorted((r.opened_at.timestamp(), r.anomaly_count, r.anomaly_score) for r in spark.read.parquet(folder + "/sessions").collect())
    assert got[:3] == [(10.0, 2, 7.0), (100.0, 1, 9.0), (10_001.0, 1, 8.0)]
    params = spark.createDataFrame([(1, "score", 1.0, 2.0), (3, "score", 0.0, 1.0)], "stream_id long, feature string, mean double, scale double")
    run(scale.enrich_standard(st.stream_telemetry(spark, folder + "/in", schema), params, ["score"], ["stream_id"]), folder, "scaled")
    scaled = {(r.stream_id, r.ts.timestamp()): r.score for r in spark.read.parquet(folder + "/scaled").collect()}
    assert scaled[1, 10.0] == 2.0 and scaled[1, 100.0] == 4.0 and scaled[2, 10_000.0] is None and len(scaled) == 8
    alerts = spark.createDataFrame([(1, "x", "OPEN")], "stream_id long, alert_id string, status string")
    alerts.write.parquet(folder + "/alerts")
    assert read_alerts(spark, folder + "/alerts").filter("status = 'OPEN'").collect() == alerts.collect()


def test_counted_write(spark, tmp_path):
    assert clean.write_counted(spark.range(7), 7, f"{tmp_path}/a") == 7
    with pytest.raises(ValueError, match="7 rows, not 8"):
        clean.write_counted(spark.range(7), 8, f"{tmp_path}/b")


def test_csv(spark, tmp_path):
    head = "Timestamp, FIT101,LIT101, MV101,Normal/Attack\n"
    (tmp_path / "b.csv").write_text(head + "28/12/2015 10:00:00 AM,1.5,2,,Normal\n28/12/2015 10:00:01 AM,2.5,x,1,A ttack\n")
    (tmp_path / "a.csv").write_text(head + "28/12/2015 09:00:00 AM,0.5,1,1,Normal\n")
    (tmp_path / "master.csv").write_text("junk\n1\n")
    got = read_telemetry_csv(spark, f"{tmp_path}/*.csv", exclude="m*", ts_format="dd/MM/yyyy h:mm:ss a").orderBy("ts").collect()
    assert [(r.FIT101, r.LIT101, r.MV101, r.label, r.source_rank) for r in got] == [(0.5, 1.0, 1.0, 0, 0), (1.5, 2.0, None, 0, 1), (2.5, None, 1.0, 1, 1)]
    (tmp_path / "c.csv").write_text(head + "28/12/2015 10:00:00 AM,1.5\n")
    with pytest.raises(Exception, match="has not 5 fields"):
        read_telemetry_csv(spark, f"{tmp_path}/c.csv").select("FIT101").collect()
    good, bad = read_telemetry_csv(spark, f"{tmp_path}/[ac].csv", mode="quarantine")
    assert good.count() == 1 and bad.count() == 1


def test_sinks(spark, tmp_path):
    df = spark.sql("select 1 a, array(1, 2) b")
    for fmt in ("parquet", "csv", "json"):
        write_results(df, f"{tmp_path}/{fmt}", fmt, files=1)
        assert spark.read.format(fmt).load(f"{tmp_path}/{fmt}").count() >= 1
    with pytest.raises(ValueError):
        write_results(df, str(tmp_path / "x"), "xls")
