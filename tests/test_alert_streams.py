"""Streams that go on from stored alerts, wait and time out; the alert table's buckets."""

from __future__ import annotations

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plantlens.operators import alerts as al
from plantlens.operators import incidents as inc
from plantlens.sources.files import read_alerts
from plantlens.streaming import telemetry as st
from plantlens.sources.alert_table import AlertTable, upsert_sink

ALERT = "stream_id long, alert_id string, open_seq long, version long, status string"


def start(made, folder, name):
    made.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start().awaitTermination(180)


def feed(spark, folder, rows, kind):
    spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return st.stream_telemetry(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)


def latest(spark, path):
    return al.upsert_alerts((rows := spark.read.parquet(path)).limit(0), rows)


def test_incidents_resume_from_stored_alerts(spark, tmp_path):
    """A fresh checkpoint that starts from the stored table goes on as if the first stream had never ended."""
    kind = "stream_id long, ts long, score double"
    first = [(1, 10, 5.0), (1, 20, 0.0), (1, 30, 7.0), (1, 40, 25.0), (2, 10, 0.0), (3, 10, 9.0)]
    then = [(1, 50, 8.0), (1, 60, 0.0), (1, 70, 6.0), (2, 50, 9.0), (3, 20, 0.0), (4, 5, 11.0), (1, 35, 99.0)]
    whole, a, b = (str(tmp_path / n) for n in ("whole", "a", "b"))
    make = lambda s, seed=None: st.stream_incidents(s, 2.0, seed=seed)
    start(make(feed(spark, whole, first, kind)), whole, "out")
    start(make(feed(spark, whole, then, kind)), whole, "out")
    start(make(feed(spark, a, first, kind)), a, "out")
    stored = AlertTable(spark, f"{a}/table", buckets=4)
    stored.upsert(spark.read.parquet(f"{a}/out"))
    seed = stored.read()
    start(make(feed(spark, b, then, kind), seed), b, "out")
    stored.upsert(spark.read.parquet(f"{b}/out"))
    fields = ["stream_id", "alert_id", "open_seq", "status", "severity", "anomaly_score", "anomaly_count", "opened_at", "window_end", "closed_at"]
    got, want = stored.read().select(fields), latest(spark, f"{whole}/out").select(fields)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # The incident open at the end of the first stream is the one closed by the second; numbers never meet; the sample older than the stored ones is late.
    mine = {r.alert_id: r for r in stored.read().filter("stream_id = 1").collect()}
    assert [(r.open_seq, r.status, r.anomaly_count, r.anomaly_score) for r in sorted(mine.values(), key=lambda r: r.open_seq)] == [(1, "CLOSED", 1, 5.0), (2, "CLOSED", 3, 25.0), (3, "OPEN", 1, 6.0)]


def test_seeds_of_batch_alerts(spark, tmp_path):
    """Alerts made by the batch operators seed streams too; of several open ones the newest goes on; ids alone give numbers."""
    rows = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([5, 0, 6, 7])], "stream_id long, seq long, score double").withColumn("ts", F.timestamp_seconds(F.col("seq") * 10))
    stored = inc.incidents(rows, 2.0)
    seeds = {r.stream_id: r for r in st.incident_seeds(stored).collect()}
    assert (seeds[1].n, seeds[1].open.open_seq, seeds[1].open["count"], seeds[1].open.peak) == (2, 2, 2, 7.0)
    assert seeds[1]._last == datetime.datetime(1970, 1, 1, 0, 0, 30)
    bare = spark.createDataFrame([(1, "alert-0007-x", "OPEN", 1, 3.0), (1, "alert-12345-y", "OPEN", 2, 4.0), (1, "alert-99999-na", "CLOSED", 1, 4.0)], "stream_id long, alert_id string, status string, anomaly_count int, anomaly_score double").withColumn("opened_at", F.timestamp_seconds(F.lit(5)))
    seed = st.incident_seeds(bare).first()
    assert seed.n == 99999 and seed.open.id == "alert-12345-y" and seed.seq == 0
    start(st.stream_incidents(feed(spark, str(tmp_path), [(1, 10, 0.0), (1, 20, 9.0)], "stream_id long, ts long, score double"), 2.0, seed=bare), str(tmp_path), "out")
    got = sorted((r.version, r.alert_id, r.status, r.anomaly_count) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "alert-12345-y", "CLOSED", 2), (1, "alert-100000-1970-01-01 00:00:20", "OPEN", 1)]


def test_faults_resume_from_stored_alerts(spark, tmp_path):
    kind = "stream_id long, ts long, a double, b double"
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    start(st.stream_faults(feed(spark, a, [(1, t, 1.0, float(t)) for t in range(5)], kind), ["a", "b"], 3), a, "out")
    stored = latest(spark, f"{a}/out")
    assert [(r.alert_id, r.status, r.anomaly_count) for r in stored.collect()] == [("tfault-0001-a-1970-01-01 00:00:02", "OPEN", 3)]
    start(st.stream_faults(feed(spark, b, [(1, t, float(t), 7.0) for t in range(10, 14)], kind), ["a", "b"], 3, seed=stored), b, "out")
    last = {r.alert_id: (r.status, r.anomaly_count, r.reason) for r in latest(spark, f"{b}/out").collect()}
    assert last == {"tfault-0001-a-1970-01-01 00:00:02": ("CLOSED", 3, "a unchanged for 5 samples"), "tfault-0002-b-1970-01-01 00:00:12": ("OPEN", 2, "b unchanged for 4 samples")}


def test_idle_streams_are_let_out_by_timers(spark, tmp_path):
    folder, kind = str(tmp_path), "stream_id long, ts long, v double"
    make = lambda rows: start(st.ordered_stream(feed(spark, folder, rows, kind), 10, idle=20), folder, "out")
    make([(1, 12, 2.0), (1, 10, 1.0), (2, 11, 1.0)])
    assert spark.read.parquet(f"{folder}/out").count() == 0  # all within 10 seconds of their streams' newest
    make([(2, 100, 2.0)])
    make([(2, 101, 3.0)])
    got = sorted((r.stream_id, r.seq, r.v, r.late) for r in spark.read.parquet(f"{folder}/out").collect())
    # Stream 1 has no newer sample: the watermark, 100 - 30 seconds, lets its samples out in order. 100 and 101 still wait.
    assert got == [(1, 0, 1.0, False), (1, 1, 2.0, False), (2, 0, 1.0, False)]
    make([(1, 500, 5.0), (2, 501, 5.0)])
    make([(3, 900, 0.0)])
    got = sorted((r.stream_id, r.seq, r.v) for r in spark.read.parquet(f"{folder}/out").filter("not late").collect())
    assert got == [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 5.0), (2, 0, 1.0), (2, 1, 2.0), (2, 2, 3.0), (2, 3, 5.0)]


def test_held_values_keep_their_types(spark, tmp_path):
    """Dates, decimals, times, large numbers, arrays and nulls come out of the state as they went in; null ties come first."""
    folder = str(tmp_path)
    kind = "stream_id long, ts long, tie string, big long, day date, exact decimal(20,4), at timestamp, list array<int>, v double"
    at = datetime.datetime(2024, 2, 29, 23, 59, 59, 123456)
    rows = [(1, 10, t, 2**62 + k, datetime.date(2024, 2, 29), Decimal("1234567890123456.7891"), at, [1, None], None) for k, t in enumerate(("b", None, "a"))]
    for wave in (rows, [(1, 100, None, None, None, None, None, None, float("nan"))], [(1, 200, None, 0, None, None, None, None, 0.0)]):
        start(st.ordered_stream(feed(spark, folder, wave, kind), 15, ties=("tie",)), folder, "out")
    got = sorted(spark.read.parquet(f"{folder}/out").collect(), key=lambda r: r.seq)
    assert [(r.seq, r.tie, r.big) for r in got] == [(0, None, 2**62 + 1), (1, "a", 2**62 + 2), (2, "b", 2**62), (3, None, None)]
    assert all((r.day, r.exact, r.at, r.list, r.v) == (datetime.date(2024, 2, 29), Decimal("1234567890123456.7891"), at, [1, None], None) for r in got[:3]) and got[3].v != got[3].v


def test_null_ties_in_stateful_operators(spark, tmp_path):
    folder, kind = str(tmp_path), "stream_id long, ts long, tie string, v double"
    for wave in ([(1, 10, "b", 1.0), (1, 10, None, 2.0)], [(1, 10, "a", 3.0), (1, 11, None, 4.0)]):
        start(st.stream_windows(feed(spark, folder, wave, kind), ["v"], 2, ties=("tie",)), folder, "out")
    # "a" of the second batch is not after "b" of the first.
    assert sorted((r.window_id, list(r.flat)) for r in spark.read.parquet(f"{folder}/out").collect()) == [(0, [2.0, 1.0]), (1, [1.0, 4.0])]


def test_sessions_need_rocksdb(spark, tmp_path):
    sdf = feed(spark, str(tmp_path), [(1, 1, 1.0)], "stream_id long, ts long, v double")
    name = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            st.ordered_stream(sdf, 1)
    finally:
        spark.conf.set(name, kept)


def alert_rows(spark, rows):
    return spark.createDataFrame(rows, ALERT)


def test_upserts_rewrite_the_buckets_of_their_keys(spark, tmp_path):
    table = AlertTable(spark, str(tmp_path), buckets=16)
    many = alert_rows(spark, [(1, f"a{k}", k, 1, "OPEN") for k in range(200)])
    assert table.upsert(many) == 16
    assert table.upsert(alert_rows(spark, [(1, "a7", 99, 2, "CLOSED"), (1, "new", 200, 2, "OPEN")])) <= 2
    assert table.upsert(alert_rows(spark, [(1, "a7", 99, 0, "OPEN")])) == 1  # an older version changes nothing
    rows = {r.alert_id: r for r in table.read().collect()}
    assert len(rows) == 201 and (rows["a7"].status, rows["a7"].open_seq) == ("CLOSED", 7) and rows["a8"].status == "OPEN"
    written = {p.name: len(list(p.glob("bucket=*"))) for p in (tmp_path / "data").iterdir()}
    assert written["2"] <= 2 and written["3"] == 1 and len(table.versions()) == 2
    # Columns may be added later; rows before have nulls there.
    table.upsert(alert_rows(spark, [(2, "b", 0, 1, "OPEN")]).withColumn("reason", F.lit("x")))
    assert {r.reason for r in table.read().collect()} == {None, "x"}
    assert read_alerts(spark, str(tmp_path)).count() == 202


def test_epochs(spark, tmp_path):
    """Again is nothing, a gap is an error, a fresh checkpoint adds to the table, an empty batch counts as an epoch."""
    write = upsert_sink(str(tmp_path), writer="q", buckets=4)
    write(alert_rows(spark, [(1, "x", 1, 1, "OPEN")]), 0)
    for _ in range(2):
        write(alert_rows(spark, [(1, "x", 1, 2, "CLOSED"), (1, "y", 2, 2, "OPEN")]), 1)
    write(alert_rows(spark, []), 2)
    table = AlertTable(spark, str(tmp_path))
    assert table.manifest()["writers"] == {"q": 2} and table.manifest()["n_buckets"] == 4
    with pytest.raises(RuntimeError, match="no epoch 4"):
        write(alert_rows(spark, [(1, "z", 3, 3, "OPEN")]), 5)
    with pytest.raises(RuntimeError, match="no epoch 6"):
        upsert_sink(str(tmp_path), writer="other")(alert_rows(spark, []), 7)
    upsert_sink(str(tmp_path), writer="fresh")(alert_rows(spark, [(1, "z", 3, 3, "OPEN")]), 0)
    assert sorted((r.alert_id, r.status) for r in table.read().collect()) == [("x", "CLOSED"), ("y", "OPEN"), ("z", "OPEN")]
    with pytest.raises(FileNotFoundError):
        AlertTable(spark, str(tmp_path / "nothing")).read()


def test_crash_before_the_commit_and_a_second_writer(spark, tmp_path, monkeypatch):
    table = AlertTable(spark, str(tmp_path), buckets=2)
    table.upsert(alert_rows(spark, [(1, "x", 1, 1, "OPEN")]))
    with monkeypatch.context() as m:
        m.setattr(AlertTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.upsert(alert_rows(spark, [(1, "x", 1, 2, "CLOSED"), (1, "left behind", 2, 2, "OPEN")]))
    assert [(r.alert_id, r.status) for r in table.read().collect()] == [("x", "OPEN")]
    table.upsert(alert_rows(spark, [(1, "x", 1, 3, "CLOSED")]))
    assert [(r.alert_id, r.status) for r in table.read().collect()] == [("x", "CLOSED")]
    stale = table.manifest()
    table.upsert(alert_rows(spark, [(1, "y", 2, 1, "OPEN")]))
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(dict(stale, version=stale["version"] + 1))
    assert json.loads((tmp_path / "manifest" / f"{table.versions()[-1]:012d}").read_text())["version"] == 3


def test_a_stream_writes_the_table(spark, tmp_path):
    """Incidents of a stream end in the table, over a restart and then a fresh checkpoint that starts from the table."""
    folder, kind, path = str(tmp_path), "stream_id long, ts long, score double", f"{tmp_path}/table"

    def go(sdf, name, seed=None):
        made = st.stream_incidents(sdf, 2.0, seed=seed)
        made.writeStream.foreachBatch(upsert_sink(path, buckets=4)).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start().awaitTermination(180)

    go(feed(spark, f"{folder}/1", [(1, 10, 5.0)], kind), "state")
    go(feed(spark, f"{folder}/1", [(1, 20, 6.0)], kind), "state")
    table = AlertTable(spark, path)
    assert [(r.status, r.anomaly_count) for r in table.read().collect()] == [("OPEN", 2)] and len(table.manifest()["writers"]) == 1
    go(feed(spark, f"{folder}/2", [(1, 30, 0.0), (1, 40, 9.0)], kind), "other", seed=spark.createDataFrame(table.read().collect(), table.read().schema))
    assert sorted((r.open_seq, r.status, r.anomaly_count) for r in table.read().collect()) == [(1, "CLOSED", 2), (2, "OPEN", 1)]
    assert len(table.manifest()["writers"]) == 2


def test_alerts_from_a_database(spark):
    """Filters and limits go to the database; categories and states read back are those that queries ask for."""
    url = "jdbc:derby:memory:alerts;create=true"
    rows = [(1, "alert-0001-na", k, "PROCESS_ANOMALY" if k % 2 else "TELEMETRY_FAULT", "OPEN" if k == 3 else "CLOSED") for k in range(6)]
    df = spark.createDataFrame(rows, "stream_id long, alert_id string, open_seq int, category string, status string").withColumn("opened_at", F.timestamp_seconds("open_seq"))
    df.write.format("jdbc").options(url=url, dbtable="alerts", driver="org.apache.derby.jdbc.EmbeddedDriver").option("createTableColumnTypes", "category varchar(20), status varchar(10), alert_id varchar(40)").save()
    stored = read_alerts(spark, url, driver="org.apache.derby.jdbc.EmbeddedDriver")
    found = al.query_alerts(stored, "PROCESS_ANOMALY", "OPEN")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(CATEGORY,PROCESS_ANOMALY)" in plan.replace("category", "CATEGORY")
    assert [r["open_seq"] if "open_seq" in stored.columns else r["OPEN_SEQ"] for r in found.collect()] == [3]
    assert al.list_alerts(stored, limit=2).count() == 2
