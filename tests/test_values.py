"""Detectors, quantiles and modes against numpy and plain loops, value by value."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens import views
from plantlens.catalog import QUERIES
from plantlens.operators import incidents, long_streams, metrics, models, thresholds
from plantlens.operators.quantiles import exact_quantiles
from plantlens.plans import runner
from plantlens.views import CHANNELS


@pytest.fixture(scope="module")
def li(spark, sf):
    """The long streams as arrays: rows in order, their streams, labels and values."""
    rows = views.li(spark, sf).orderBy("stream_id", "seq").collect()
    return np.array([r.stream_id for r in rows]), np.array([r.seq for r in rows]), np.array([r.label for r in rows]), np.array([[r[c] for c in CHANNELS] for r in rows])


def components(x, k):
    mean = x.mean(0)
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / len(x))
    return mean, vectors[:, np.argsort(-values)[:k]]


def test_pca_recon(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    mean, basis = components(x, 8)
    z = x - mean
    want = dict(zip([r.vec_id for r in rows], ((z - z @ basis @ basis.T) ** 2).mean(1)))
    got = {r.vec_id: r.score for r in QUERIES["pca_recon"](spark, sf).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8


def test_graph_forecast(spark, sf, li):
    stream, seq, label, x = li
    place = {(s, q): k for k, (s, q) in enumerate(zip(stream, seq))}
    # A lag is the sample before; training pairs are of two normal samples.
    pairs = [(place[s, q - 1], k) for k, (s, q) in enumerate(zip(stream, seq)) if q and label[k] == 0 and label[place[s, q - 1]] == 0]
    lag, now = x[[a for a, _ in pairs]], x[[b for _, b in pairs]]
    both = np.concatenate([lag, now], 1)
    c = np.cov(both.T, bias=True)
    spread = np.sqrt(np.maximum(np.diag(c), 1e-12))
    corr = np.abs(c / np.outer(spread, spread))[5:, 5:]
    last = np.array([place.get((s, q - 1), -1) for s, q in zip(stream, seq)])
    dev = np.empty_like(x)
    for s in range(5):
        near = [s, *[t for t in np.argsort(-corr[s], kind="stable") if t != s][:2]]
        slope = np.linalg.solve(c[np.ix_(near, near)] + 1e-9 * np.eye(3), c[near, 5 + s])
        base = both[:, 5 + s].mean() - slope @ both[:, near].mean(0)
        dev[:, s] = np.abs(x[:, s] - (x[last][:, near] @ slope + base))
    rows = np.flatnonzero(last >= 0)
    normal = dev[rows[label[rows] == 0]]
    q = np.quantile(normal, [0.25, 0.5, 0.75], axis=0)
    want = {(stream[k], seq[k]): (np.abs(dev[k] - q[1]) / (q[2] - q[0] + 1e-2)).max() for k in rows}
    got = {(r.stream_id, r.seq): r.score for r in QUERIES["graph_forecast"](spark, sf).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) / (1 + want[k]) for k in want) < 1e-5


def test_forest_paths(spark):
    """Scores of a forest of given trees, walked node by node; samples of all trees are subsample rows."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, *map(float, rng.normal(size=2))) for k in range(3000)], "key long, a double, b double")
    forest = models.IsolationForest(["a", "b"], "key", 20, 64, seed=3).fit(rows)
    assert len(forest.trees) == 20 and all(t[4][0] == 64 for t in forest.trees)
    again = models.IsolationForest(["a", "b"], "key", 20, 64, seed=3).fit(rows.repartition(7))
    assert all((s == t).all() for a, b in zip(forest.trees, again.trees) for s, t in zip(a, b))
    few = models.IsolationForest(["a", "b"], "key", 20, 64, seed=3).fit(rows.limit(10))
    assert all(t[4][0] == 10 for t in few.trees)

    def average(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def depth(tree, x):
        f, cut, left, right, n = tree
        node, level = 0, 0
        while f[node] >= 0:
            node = left[node] if x[f[node]] < cut[node] else right[node]
            level += 1
        return level + average(n[node])

    for r in forest.score(rows.limit(50)).collect():
        want = 2.0 ** (-np.mean([depth(t, (r.a, r.b)) for t in forest.trees]) / average(64))
        assert r.score == pytest.approx(want, abs=1e-9)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(size=2000), np.full(900, 0.25)])
    rows = spark.createDataFrame([(float(v), float(k % 3) if k % 5 else None, None) for k, v in enumerate(a)], "a double, b double, c double")
    shares = [0.0, 0.1, 0.5, 0.777, 0.9995, 1.0]
    got = exact_quantiles(rows, ["a", "b", "c"], shares, ranges=8)
    assert got["a"] == pytest.approx(np.quantile(a, shares)) and got["c"] == [None] * 6
    assert got["b"] == pytest.approx(np.quantile([k % 3 for k in range(len(a)) if k % 5], shares))
    assert thresholds.threshold_value(rows, "a", 99.0) == pytest.approx(np.percentile(a, 99))


def test_incidents_close_without_times(spark):
    """A normal window without any time closes an incident, at the incident's own last end."""
    rows = [(1, 0, 9.0, "2024-01-01 00:00:00", "2024-01-01 00:01:00"), (1, 1, 0.0, None, None), (1, 2, 9.0, None, None)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, score double, s string, e string").withColumns({"ts": F.to_timestamp("s"), "te": F.to_timestamp("e")})
    for mode in ("keyed", "bucketed"):
        got = long_streams.incidents(df, 1.0, start="ts", end="te", mode=mode, bucket=2).orderBy("open_seq").collect()
        assert [r.status for r in got] == ["CLOSED", "OPEN"] and got[0].closed_at == got[0].window_end and got[1].alert_id == "alert-0002-na"
    stuck = spark.createDataFrame([(1, 0, "A", 0, 2, "2024-01-01 00:00:00")], "stream_id long, seq long, channel string, pos int, run_length long, s string").withColumn("ts", F.to_timestamp("s"))
    verdicts = spark.createDataFrame([(1, 0, "2024-01-01 00:00:00"), (1, 1, None)], "stream_id long, seq long, s string").withColumn("ts", F.to_timestamp("s"))
    fault = incidents.fault_incidents(stuck, verdicts).first()
    assert fault.status == "CLOSED" and fault.closed_at == fault.opened_at


def test_auto_mode(spark, sf):
    one = views.one(spark, sf)
    with pytest.raises(ValueError):
        long_streams.incidents(one, 100.0, "value", mode="x")
    keyed, auto = (long_streams.incidents(one, 100.0, "value", mode=m, bucket=128) for m in ("keyed", "auto"))
    assert keyed.exceptAll(auto).count() == 0
    plan = long_streams.point_adjust(one.withColumn("pred", F.lit(0)), mode="bucketed", bucket=128)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_run_all_over_datasets(spark):
    rng = np.random.default_rng(8)
    data = {n: spark.createDataFrame([(1, k, float(v), int(v > 2)) for k, v in enumerate(rng.normal(size=300))], "stream_id long, seq long, a double, label int") for n in ("x", "y")}
    detectors = {"plain": lambda train, rows: rows.withColumn("score", F.col("a")), "minus": lambda train, rows: rows.withColumn("score", -F.col("a"))}
    got = runner.run_all(data, ["a"], detectors, overrides={"y": {"percentile": 90.0, "without": ("minus",)}})
    rows = {(r.dataset, r.model): r for r in got.collect()}
    assert set(rows) == {("x", "plain"), ("x", "minus"), ("x", "ensemble"), ("y", "plain")}
    assert rows["x", "plain"].roc_auc == 1.0 and rows["x", "minus"].roc_auc == 0.0 and rows["y", "plain"].f1_best == 1.0
    assert rows["y", "plain"].threshold < rows["x", "plain"].threshold
    with pytest.raises(ValueError, match="unknown"):
        runner.run_all(data, ["a"], detectors, overrides={"z": {}})
    ladder = metrics.protocol_ladder(data["x"].selectExpr("stream_id", "seq", "label label_any", "label label_last", "cast(a > 1 as int) pred"), published=2.0)
    assert {r.protocol: r.control_ok for r in ladder.collect()} == {"any_adjusted": False, "last_adjusted": True, "last_pointwise": True}
