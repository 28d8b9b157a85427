"""Hand-computed cases, and equivalence of the keyed, bucketed and brute-force forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens import views
from plantlens.catalog import QUERIES
from plantlens.functions.cells import classify_channel, normalise_label, over_threshold, parse_ts, severity
from plantlens.operators import alerts, bucketed, clean, health, incidents, metrics, models, order, profile, scale, scores, segments, thresholds, windows

NAN, INF = float("nan"), float("inf")


def stream(spark, label, pred=None, score=None):
    n = len(label)
    rows = [(1, k, int(label[k]), int((pred or label)[k]), float((score or range(n))[k])) for k in range(n)]
    return spark.createDataFrame(rows, "stream_id long, seq long, label int, pred int, score double").withColumn("ts", F.timestamp_seconds(F.col("seq")))


@pytest.mark.parametrize(("text", "want"), [("0110010", [(1, 3), (5, 6)]), ("110", [(0, 2)]), ("011", [(1, 3)]), ("1", [(0, 1)]), ("00000", []), ("1" * 10, [(0, 10)])])
def test_segments(spark, text, want):
    df = stream(spark, list(text))
    assert sorted((r.start_seq, r.stop_seq) for r in segments.segments(df).collect()) == want
    assert sorted((r.start_seq, r.stop_seq) for r in bucketed.segments(df, F.col("label") == 1, 2).collect()) == want


@pytest.mark.parametrize(("truth", "pred", "want"), [("011110", "000100", "011110"), ("011110", "000000", "000000"), ("001100", "110111", "111111"), ("1100", "0100", "1100"), ("0011", "0001", "0011")])
def test_point_adjust(spark, truth, pred, want):
    got = metrics.point_adjust(stream(spark, list(truth), list(pred))).orderBy("seq").collect()
    assert "".join(str(r.adjusted) for r in got) == want


def test_label_any_and_last(spark):
    label = [1 if 100 <= k < 120 else 0 for k in range(200)]
    made = windows.window_labels(stream(spark, label), 30).filter("label_any <> label_last").collect()
    assert sorted(r.window_id + 29 for r in made) == list(range(120, 149))
    label = [1 if 100 <= k < 120 or 300 <= k < 340 else 0 for k in range(500)]
    assert windows.label_inflation(stream(spark, label), 30).first().inflation == 58


def test_rates(spark):
    r = metrics.prf(stream(spark, list("001110"), list("011100"))).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2) and r.precision == r.recall == pytest.approx(2 / 3) and r.f1 == pytest.approx(2 / 3)
    r = metrics.prf(stream(spark, list("001"), list("000"))).first()
    assert r.precision == r.f1 == 0.0
    assert metrics.prf(stream(spark, list("00001"), list("10001"))).first().fpr == 0.25


def test_areas(spark):
    r = metrics.auc(stream(spark, [0] * 90 + [1] * 10)).first()
    assert r.roc_auc == 1.0 and r.average_precision == 1.0
    assert metrics.auc(stream(spark, [0, 0, 0])).first().roc_auc is None
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300).tolist(), rng.integers(0, 40, 300).astype(float).tolist()
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    brute = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert metrics.auc(stream(spark, y, y, s)).first().roc_auc == pytest.approx(brute)


def test_best_f1_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.3).astype(int).tolist()
    s = (rng.random(400) + 0.3 * np.array(y)).tolist()
    grid = np.unique(np.quantile(s, np.linspace(0.5, 0.9995, 50)))
    runs, k = [], 0
    while k < len(y):
        e = k
        while e < len(y) and y[e] == y[k]:
            e += 1
        runs.append((y[k], k, e))
        k = e
    want = []
    for t in grid:
        tp = sum(e - a for lab, a, e in runs if lab and max(s[a:e]) > t)
        fp = sum(v > t for v, lab in zip(s, y) if not lab)
        want.append(2 * tp / (2 * tp + fp + sum(y) - tp))
    best = thresholds.best_f1(stream(spark, y, y, s), n_grid=50).first()
    assert best.f1 == pytest.approx(max(want)) and best.threshold == pytest.approx(grid[int(np.argmax(want))])


def test_strict_threshold_and_severity(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (NAN,), (None,)], "s double")
    assert [r[0] for r in df.select(over_threshold("s", 1.0)).collect()] == [False, False, True, False, False]
    df = spark.createDataFrame([(11.0, 1.0), (2.5, 1.0), (1.1, 1.0), (1.0, 0.0), (10.0, 1.0), (2.0, 1.0)], "s double, t double")
    assert [r[0] for r in df.select(severity("s", "t")).collect()] == ["HIGH", "MEDIUM", "LOW", "HIGH", "HIGH", "MEDIUM"]


def test_cells(spark):
    df = spark.createDataFrame([("Attack",), ("A ttack",), (" attack",), ("Normal",), ("1.0",), (None,)], "s string")
    assert [r[0] for r in df.select(normalise_label("s")).collect()] == [1, 1, 1, 0, 0, 0]
    assert [r[0] for r in df.select(normalise_label("s", numeric=True)).collect()] == [1, 1, 1, 0, 1, 0]
    df = spark.createDataFrame([(" 28/12/2015 02:00:00 PM",), ("28/12/2015 02:00:00 AM",), ("x",)], "s string")
    got = [r[0] for r in df.select(parse_ts("s")).collect()]
    assert (got[0] - got[1]).total_seconds() == 12 * 3600 and got[2] is None
    tags = ["FIT101", "LIT301", "AIT401", "DPIT301", "PIT502", "MV101", "P204", "UV401", "X1", "101"]
    df = spark.createDataFrame([(t,) for t in tags], "s string")
    assert [r[0] for r in df.select(classify_channel("s")).collect()] == ["continuous"] * 5 + ["discrete"] * 3 + ["unknown"] * 2


def channel(spark, values):
    rows = [(1, k, "FIT101", 0, v, 0) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "stream_id long, seq long, channel string, pos int, value double, label int").withColumn("ts", F.timestamp_seconds(F.col("seq") * 5))


@pytest.mark.parametrize(("values", "want"), [([0.0] * 4, [1, 2, 3, 4]), ([NAN] * 3, [0, 0, 0]), ([INF] * 3, [0, 0, 0]), ([0.0, 0.0, 0.0, NAN, 0.0, 0.0, 0.0], [1, 2, 3, 0, 1, 2, 3]), ([1.0, 1.0, None, 1.0], [1, 2, 0, 1]), ([1.0, 2.0, 2.0], [1, 1, 2])])
def test_unchanged_runs(spark, values, want):
    assert [r.run_length for r in health.unchanged_runs(channel(spark, values)).orderBy("seq").collect()] == want


def test_stuck_verdicts(spark):
    runs = health.unchanged_runs(channel(spark, [0.0] * 10 + [1.0]))
    got = health.health(runs, 5, 5.0).orderBy("seq").collect()
    assert [r.healthy for r in got] == [True] * 4 + [False] * 6 + [True]
    assert got[4].stuck_channels[0].unchanged_samples == 5 and got[4].stuck_channels[0].staleness_seconds == 20.0 and got[4].fault_type == "TELEMETRY_FAULT"
    assert health.stuck_channels(runs, 3).first().staleness_seconds is None
    with pytest.raises(ValueError):
        health.stuck_channels(runs, 1)
    faults = incidents.fault_incidents(health.stuck_channels(runs, 5, 5.0), runs.select("stream_id", "seq", "ts")).collect()
    assert len(faults) == 1 and faults[0].status == "CLOSED" and faults[0].anomaly_count == 6 and faults[0].alert_id.startswith("tfault-0001-FIT101-")
    assert health.monitored(["FIT101", "MV101"]) == ["FIT101"]
    for wrong in ([], ["FIT101", "FIT101"], ["X"]):
        with pytest.raises(ValueError):
            health.monitored(["FIT101"], wrong)


def test_incidents(spark):
    df = stream(spark, [0] * 7, score=[5, 1e-3, 9, 9, 0, 7, 0.0])
    got = incidents.incidents(df, 0.5).orderBy("open_seq").collect()
    assert [(r.anomaly_count, r.status, r.anomaly_score) for r in got] == [(1, "CLOSED", 5.0), (2, "CLOSED", 9.0), (1, "CLOSED", 7.0)]
    assert incidents.incidents(df, 0.5, top="seq").orderBy("open_seq").collect()[1].top_features == 2  # the first of two equal peaks
    assert got[1].closed_at.second == 4 and len({r.alert_id for r in got}) == 3
    assert incidents.incidents(stream(spark, [0, 0], score=[0, 1.0]), 0.5).first().status == "OPEN"


def test_health_validation(spark):
    kind = "healthy boolean, stuck_channels array<struct<feature:string,unchanged_samples:bigint>>"
    rows = [(True, []), (False, [("A", 3)]), (True, [("A", 3)]), (False, [(None, 3)]), (False, [("A", 0)]), (False, [("A", 3), ("A", 4)]), (None, None)]
    good, bad = incidents.validate_health(spark.createDataFrame(rows, kind), quarantine=True)
    assert good.count() == 2 and bad.count() == 5
    with pytest.raises(Exception, match="invalid health verdict"):
        incidents.validate_health(spark.createDataFrame(rows, kind)).collect()


def test_alert_table(spark):
    kind = "stream_id long, alert_id string, open_seq long, status string, version int"
    old = spark.createDataFrame([(1, "a", 1, "OPEN", 1), (1, "b", 2, "OPEN", 1)], kind)
    new = spark.createDataFrame([(1, "a", 9, "CLOSED", 2)], kind)
    got = {r.alert_id: (r.status, r.open_seq) for r in alerts.upsert_alerts(old, new).collect()}
    assert got == {"a": ("CLOSED", 1), "b": ("OPEN", 2)}
    with_time = old.withColumns({"category": F.lit("PROCESS_ANOMALY"), "opened_at": F.timestamp_seconds("open_seq")})
    assert alerts.query_alerts(with_time, limit=-3).count() == 0
    assert [r.alert_id for r in alerts.list_alerts(with_time, "process_anomaly", "open").collect()] == ["b", "a"]
    lines = spark.createDataFrame([('{"alert_id": "x", "open_seq": 1}',), ("{broken",), ('{"open_seq": 2}',)], "value string")
    good, bad = alerts.read_json_alerts(lines, spark.createDataFrame([], "alert_id string, open_seq long").schema)
    assert good.count() == 1 and bad.count() == 2


def test_contract(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0)], "b double, a double, label int")
    assert clean.enforce_contract(df, ["a", "b"], "select").columns == ["a", "b"]
    for features, text in ((["a", "b"], "out of order"), (["b", "a", "c"], "missing"), (["b"], "unknown"), (["a", "a"], "duplicate")):
        with pytest.raises(ValueError, match=text):
            clean.enforce_contract(df, features, others=["label"])
    with pytest.raises(Exception, match="keys differ"):
        spark.sql("select map('a', 1d) m").select(clean.map_to_vector("m", ["a", "b"])).collect()
    with pytest.raises(ValueError, match="rows"):
        clean.assert_count(df, 2)


def test_missing_values(spark):
    df = spark.createDataFrame([(1, 0, 7.0, None), (1, 1, None, 4.0), (1, 2, NAN, NAN)], "stream_id long, seq long, a double, b double")
    got = clean.ffill_zero(df, ["a", "b"]).orderBy("seq").collect()
    assert [(r.a, r.b) for r in got] == [(7.0, 0.0), (7.0, 4.0), (7.0, 4.0)]
    with pytest.raises(ValueError, match="a: 2 cells|b: 2 cells"):
        clean.reject_nonfinite(df, ["a", "b"])
    good, bad = clean.reject_nonfinite(df, ["a"], quarantine=True)
    assert good.count() == 1 and bad.count() == 2
    text = spark.createDataFrame([("1", "x"), (" 2 ", None)], "a string, b string")
    assert clean.coerce_numeric(text, ["a", "b"]).columns == ["a"]


def test_subsample(spark):
    df = spark.createDataFrame([(1, k, float(k % 2)) for k in range(4)], "stream_id long, seq long, a double")
    assert profile.constant_features(df, ["a"]).count() == 0
    assert profile.constant_features(order.subsample(df, 2), ["a"]).first().value == 0.0
    with pytest.raises(ValueError):
        order.subsample(df, 0)


def test_scalers(spark):
    df = spark.createDataFrame([(1, k, 1.0, float(k)) for k in range(3)], "stream_id long, seq long, a double, b double").withColumns({"label": F.lit(0), "ts": F.timestamp_seconds("seq")})
    params = scale.fit_standard(df, ["a", "b"])
    got = scale.apply_standard(df.withColumn("a", F.lit(7.0)), params).first()
    assert got.a == 6.0
    bounds = scale.fit_minmax_windows(df, ["a", "b"], 2)
    flat = windows.flatten_window(windows.sliding_windows(df, ["a", "b"], 2))
    made = scale.apply_minmax(flat, bounds).orderBy("window_id").collect()
    assert [list(r.flat) for r in made] == [[0.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 1.0]]
    with pytest.raises(ValueError):
        scale.apply_minmax(flat, bounds, clip=True)
    with pytest.raises(ValueError):
        windows.sliding_windows(df, ["a"], 5, strict=True)
    assert windows.sliding_windows(df, ["a"], 5).count() == 0


def test_params_round_trip(spark, tmp_path):
    params = spark.createDataFrame([("a", 0, 1.0)], "feature string, pos int, mean double")
    scale.save_params(params, str(tmp_path / "p"), 30)
    assert scale.load_params(spark, str(tmp_path / "p"), ["a"], 30).count() == 1
    with pytest.raises(ValueError):
        scale.load_params(spark, str(tmp_path / "p"), ["b"], 30)
    with pytest.raises(ValueError):
        scale.load_params(spark, str(tmp_path / "p"), ["a"], 31)


def test_bucketed_equals_keyed(spark, sf):
    li = views.li(spark, sf).withColumn("LIT101", F.when(F.col("seq") % 11 != 0, F.col("LIT101")))
    li = li.withColumns({"plant": F.col("stream_id"), "old": F.col("seq"), "stream_id": F.lit(1)}).drop("seq")
    one = bucketed.with_global_seq(li, ["ts", "plant", "old"])
    assert one.agg(F.min("seq"), F.max("seq"), F.countDistinct("seq"), F.count("*")).first()[:] == (0, one.count() - 1, one.count(), one.count())
    keyed = one.withColumn("m", F.max("label").over(windows.frame(30)))
    fast = bucketed.over_windows(one, 30, {"m": lambda w: F.max("label").over(w)}, 100)
    assert keyed.select("seq", "m").exceptAll(fast.select("seq", "m")).count() == 0 and keyed.count() == fast.count()
    for state in (F.col("label"), F.floor(F.col("seq") / 333), F.lit(1)):
        rows = one.withColumn("label", state.cast("int"))
        a = bucketed.run_lengths(rows, F.col("label"), 50).select("seq", "run_length")
        brute, last, n = {}, None, 0
        for r in rows.select("seq", "label").orderBy("seq").collect():
            n = n + 1 if r.label == last else 1
            last = r.label
            brute[r.seq] = n
        assert {r.seq: r.run_length for r in a.collect()} == brute
    x = clean.ffill_zero(one, ["LIT101"]).select("seq", "LIT101")
    y = bucketed.ffill_zero(one, ["LIT101"], 64).select("seq", "LIT101")
    assert x.exceptAll(y).count() == 0 and x.count() == y.count()
    assert bucketed.pick_mode(one) == "keyed" and bucketed.pick_mode(one, limit=10) == "bucketed"


def test_plans(spark, sf):
    plan = incidents.incidents(views.ev(spark, sf), 100.0, "value")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_detectors_separate_anomalies(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    x[:, 2] = x[:, 0] + x[:, 1] + 0.05 * rng.normal(size=2000)
    y = np.zeros(2000, int)
    y[::100] = 1
    x[y == 1, 2] += 6
    rows = spark.createDataFrame([(1, k, *map(float, r), int(t)) for k, (r, t) in enumerate(zip(x, y))], "stream_id long, seq long, a double, b double, c double, label int")
    normal = rows.filter("label = 0")
    pca = models.PCAReconstructor(["a", "b", "c"], 2).fit(normal).score(rows)
    assert metrics.auc(pca).first().roc_auc > 0.99
    forest = models.IsolationForest(["a", "b", "c"], "seq", 50).fit(normal).score(rows)
    assert metrics.auc(forest).first().roc_auc > 0.9
    graph = models.GraphForecaster(["a", "b", "c"], 1).fit(normal).deviations(rows)
    assert metrics.auc(graph.withColumn("score", F.col("c_dev"))).first().roc_auc > 0.9


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 0.0], [0.0, 2.0])], "t array<double>, x1 array<double>, x2 array<double>")
    r = df.select(scores.dual_score("x1", "x2", "t").alias("s"), scores.feature_errors("x1", "x2", "t").alias("e")).first()
    assert r.s == pytest.approx(1.25) and list(r.e) == [0.5, 2.0]
    top = spark.createDataFrame([([1.0, 3.0, 3.0],)], "e array<double>").select(scores.top_features("e", ["a", "b", "c"], 2).alias("t")).first().t
    assert [(f.feature, f.error) for f in top] == [("b", 3.0), ("c", 3.0)]
    with pytest.raises(ValueError):
        scores.ensemble(df, ["t"])


def test_label_ranges_as_a_frame(spark, sf):
    ev = views.table(spark, sf, "events").select("event_id", "ts")
    ranges = [("2024-01-03 00:00:00", "2024-01-05 12:00:00"), ("2024-01-10 00:00:00", "2024-01-10 23:59:59")]
    frame = spark.createDataFrame(ranges, "a string, b string").selectExpr("cast(a as timestamp_ntz) range_start", "cast(b as timestamp_ntz) range_end")
    want = clean.label_by_ranges(ev, ranges).select("event_id", "label")
    for most in (1000, 1):
        got = clean.label_by_ranges(ev, frame, most=most).select("event_id", "label")
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_all_windows_are_scaled(spark, tmp_path):
    rng = np.random.default_rng(6)
    streams = {1: 14, 5: 9, 6: 23, 40: 11}
    lines = [(k, f"2024-01-{n + 1:02d}", n, *rng.integers(0, 50, 4).astype(float).tolist(), n % 7, "N") for k, rows in streams.items() for n in range(rows)]
    made = spark.createDataFrame(lines, "l_suppkey long, l_shipdate string, l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linenumber int, l_returnflag string")
    made.withColumns({"l_shipdate": F.to_timestamp("l_shipdate"), "l_partkey": F.col("l_orderkey")}).write.parquet(f"{tmp_path}/lineitem.parquet")
    cut = {(k, n): np.array([x[3:8] for x in lines if x[0] == k][n : n + 10]) for k, rows in streams.items() for n in range(rows - 9)}
    low, high = (f(np.stack(list(cut.values())), axis=0) for f in (np.min, np.max))
    want = {(*key, i): v for key, x in cut.items() for i, v in enumerate(((x - low) / np.where(high == low, 1, high - low)).ravel().tolist())}
    got = {(r.stream_id, r.window_id, r.i): r.v for r in QUERIES["mm_apply_all"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and {k for k, _, _ in got} == {1, 6, 40}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def brute_neighbours(vectors, k):
    x = {i: np.array(v, np.float64) for i, v in vectors.items()}
    cos = lambda a, b: round(float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), 11)
    return {i: sorted((-cos(x[i], x[j]), j) for j in x if j != i)[:k] for i in x}


def test_cosine_graph_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(scores, "BLOCK", 16)
    monkeypatch.setattr(scores, "CHUNK", 5)
    rng = np.random.default_rng(9)
    vectors = {i: rng.normal(size=8).tolist() for i in range(90)} | {i: [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0] for i in range(90, 130)}
    odd = [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (None, [1.0] * 8), (3, vectors[3])]
    made = scores.topk_cosine_graph(spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>"), 5)
    assert "NestedLoop" not in made._jdf.queryExecution().toString() and "Cartesian" not in made._jdf.queryExecution().toString()
    got = {}
    for r in made.collect():
        got.setdefault(r.src, []).append((-round(r.cosine, 11), r.dst, r.weight))
    want = brute_neighbours(vectors, 5)
    assert {i: sorted((c, j) for c, j, _ in e) for i, e in got.items()} == want
    assert all(abs(sum(w for *_, w in e) - 1) < 1e-9 for e in got.values())


def test_graph_of_all_embeddings(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = brute_neighbours({r.vec_id: r.embedding for r in rows}, 5)
    got = {}
    for r in QUERIES["cosine_topk"](spark, sf).collect():
        got.setdefault(r.src, set()).add(r.dst)
    assert len(got) == len(rows) and got == {i: {j for _, j in e} for i, e in want.items()}
    label = {r.vec_id: r.label for r in rows}
    share = {i: np.exp([-c for c, _ in e]) for i, e in want.items()}
    means = {i: float(share[i] @ [label[j] for _, j in e] / share[i].sum()) for i, e in want.items()}
    agg = {r.src: r.aggregate for r in QUERIES["neighbour_agg"](spark, sf).collect()}
    assert agg.keys() == means.keys() and max(abs(agg[i] - means[i]) for i in agg) < 2e-6
