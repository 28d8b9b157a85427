"""Windows cut inside tasks and the two-phase window model, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens import views
from plantlens.catalog import QUERIES
from plantlens.operators import frames, models, window_models, windows
from plantlens.views import CHANNELS


@pytest.fixture(scope="module")
def gaps(spark):
    """Three streams of two channels; rows with label 1, and some others, can be removed."""
    rng = np.random.default_rng(4)
    rows = [(s, q, float(rng.normal()), float(q) if q % 7 else None, int(rng.random() < 0.2)) for s in (1, 2, None) for q in range(n)] if (n := 90) else []
    df = spark.createDataFrame(rows, "stream_id long, seq long, a double, b double, label int").withColumn("ts", F.timestamp_seconds("seq"))
    return df.repartition(5, "a")


def brute_windows(rows, size, stride, contiguous):
    """Windows by plain loops: of consecutive seq, or of the rows as they are left."""
    out = {}
    for s in {r.stream_id for r in rows}:
        left = sorted((r for r in rows if r.stream_id == s), key=lambda r: r.seq)
        for k in range(len(left) - size + 1):
            part = left[k : k + size]
            if contiguous and part[-1].seq - part[0].seq != size - 1:
                continue
            first = part[0].seq if contiguous else k
            if first % stride == 0:
                out[s, first // stride] = part
    return out


@pytest.mark.parametrize("contiguous", [True, False])
@pytest.mark.parametrize(("size", "stride", "bucket"), [(5, 1, 13), (1, 2, 7), (4, 3, 1000), (20, 1, 5)])
def test_cut_in_tasks(gaps, contiguous, size, stride, bucket):
    df = gaps.filter("label = 0")
    want = brute_windows(df.collect(), size, stride, contiguous)
    plain = lambda x: None if x is None or x != x else x
    got = frames.sliding_windows(df, ["a", "b"], size, stride, contiguous=contiguous, bucket=bucket).collect()
    assert len(got) == len(want)
    for r in got:
        part = want[r.stream_id, r.window_id]
        assert [[plain(v) for v in row] for row in r["values"]] == [[x.a, x.b] for x in part]
        assert r.labels == [x.label for x in part] and (r.window_start, r.window_end) == (part[0].ts, part[-1].ts)
    keyed = windows.sliding_windows(df.filter("stream_id is not null"), ["a", "b"], size, stride, contiguous=contiguous).collect()
    assert {(r.stream_id, r.window_id, r.window_start, r.window_end) for r in keyed} == {(s, k, p[0].ts, p[-1].ts) for (s, k), p in want.items() if s is not None}


def test_history_and_target(gaps):
    df = gaps.filter("stream_id = 1")
    want = brute_windows(df.collect(), 6, 1, True)
    for r in windows.history_targets(windows.sliding_windows(df, ["a", "b"], 6)).collect():
        part = want[1, r.window_id]
        assert r.history == [[x.a, x.b] for x in part[:-1]] and r.target == [part[-1].a, part[-1].b]


def fitted(x, k):
    """Mean, components and usual errors of windows as rows of x."""
    mean = x.mean(0)
    z = x - mean
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    basis = vt[:k].T
    return mean, basis, ((z - z @ basis @ basis.T) ** 2).mean(0)


def two_phases(w, mean, basis, usual):
    """One window, by the normal equations of a weighted least-squares problem."""
    z = w - mean
    first = basis @ (basis.T @ z)
    weight = np.sqrt(1 / (1 + (z - first) ** 2 / usual))
    coefficients = np.linalg.lstsq(basis * weight[:, None], z * weight, rcond=None)[0]
    return first + mean, basis @ coefficients + mean


def test_score_windows(spark, sf):
    """The registered query, whole, against windows cut by loops and problems solved one by one."""
    rows = views.li(spark, sf).orderBy("stream_id", "seq").collect()
    x, label = np.array([[r[c] for c in CHANNELS] for r in rows]), np.array([r.label for r in rows])
    normal = x[label == 0]
    x = (x - normal.mean(0)) / np.where(normal.std(0) == 0, 1, normal.std(0))
    stream, seq = np.array([r.stream_id for r in rows]), np.array([r.seq for r in rows])
    keep = np.flatnonzero(label == 0)
    train = np.array([x[part].ravel() for k in range(len(keep) - 9) if stream[(part := keep[k : k + 10])[0]] == stream[part[-1]]])
    model = fitted(train, 8)
    got = {(r.stream_id, r.window_id): r for r in QUERIES["score_windows"](spark, sf).collect()}
    ends = np.flatnonzero(seq >= 9)
    assert len(got) == len(ends)
    unlike = 0
    for k in ends:
        w = x[k - 9 : k + 1]
        a, b = (y.reshape(10, -1) for y in two_phases(w.ravel(), *model))
        errors = 0.5 * (a - w) ** 2 + 0.5 * (b - w) ** 2
        r = got[stream[k], seq[k] - 9]
        assert r.anomaly_score == pytest.approx(errors[-1].mean(), rel=1e-4, abs=1e-8) and r.window_error == pytest.approx(errors.mean(), rel=1e-4, abs=1e-8)
        assert np.allclose(r.feature_errors, errors[-1], rtol=1e-4, atol=1e-8)
        unlike += np.abs(a - b).max() > 1e-3
    assert unlike > 0.9 * len(ends)


def waves(spark, n=4000, noise=0.02, seed=0):
    """One long stream of two channels that swing together a quarter of a turn apart, with small noise."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) * 0.4
    x = np.stack([np.sin(t), np.cos(t)], 1) + noise * rng.normal(size=(n, 2))
    return x, lambda y: spark.createDataFrame([(0, k, float(a), float(b), 0) for k, (a, b) in enumerate(y)], "stream_id int, seq long, a double, b double, label int").withColumn("ts", F.timestamp_seconds("seq"))


def test_window_model_sees_what_rows_hide(spark):
    """Samples that stand still are usual one by one, and unlike the waves of normal windows."""
    x, frame = waves(spark)
    model = window_models.WindowReconstructor(["a", "b"], 12, 2).fit(frame(x), bucket=500)
    rows = models.PCAReconstructor(["a", "b"], 2).fit(frame(x))
    y = x.copy()
    y[2000:2008] = y[2000]
    scored = {r.seq: r for r in window_models.score_windows(frame(y), ["a", "b"], 12, model.reconstruct(), bucket=500).collect()}
    usual = np.quantile([r.window_error for s, r in scored.items() if s < 1900], 0.999)
    assert all(scored[s].window_error > 10 * usual for s in range(2006, 2014))
    # The last sample alone is scored higher than ever while the frozen samples lie early in its window.
    assert scored[2010].anomaly_score > max(r.anomaly_score for s, r in scored.items() if s < 1900)
    single = {r.seq: r.score for r in rows.score(frame(y)).collect()}
    assert max(single[s] for s in range(2000, 2008)) <= np.quantile(list(single.values()), 0.999) + 1e-9


def test_early_samples_matter_and_the_second_phase_is_conditioned(spark):
    x, frame = waves(spark, 600)
    model = window_models.WindowReconstructor(["a", "b"], 8, 2).fit(frame(x))
    run = model.reconstruct()
    w = x[100:108][None]
    a, b = run(w)
    moved = w.copy()
    moved[0, 1, 0] += 3
    c, d = run(moved)
    assert np.abs(c[0, -1] - a[0, -1]).max() > 0.05
    # The second phase leaves the odd value outside: it is much nearer to the reconstruction of the clean window than the first one.
    assert np.abs(d - b).max() < 0.2 * np.abs(c - a).max() and np.abs(d - c).max() > 0.1
    # A window made of components alone is its own reconstruction in both phases.
    exact = (model.mean + model.basis @ np.array([1.0, -2.0])).reshape(1, 8, 2)
    assert all(np.allclose(y, exact) for y in run(exact))


def test_window_fit_refuses_nothing_and_bad_models(spark):
    x, frame = waves(spark, 20)
    with pytest.raises(ValueError, match="no window"):
        window_models.WindowReconstructor(["a", "b"], 30, 2).fit(frame(x))
    with pytest.raises(Exception, match="the model gave"):
        window_models.score_windows(frame(x), ["a", "b"], 5, lambda w: (w[:, -1], w[:, -1])).collect()
    assert window_models.score_windows(frame(x).limit(0), ["a", "b"], 5, lambda w: (w, w)).collect() == []


def test_forest_of_small_tables(spark):
    """Where a table has fewer rows than subsample, path lengths are set against those of its own size."""
    rows = spark.createDataFrame([(k, float(np.sin(k)), float(np.cos(k))) for k in range(40)] + [(99, 30.0, 30.0)], "key long, a double, b double")
    forest = models.IsolationForest(["a", "b"], "key", n_trees=60).fit(rows)
    scores = {r.key: r.score for r in forest.score(rows).collect()}
    assert scores[99] == max(scores.values()) > 0.7 and 0.3 < np.median(list(scores.values())) < 0.55


def test_missing_values_and_labels(spark):
    x, frame = waves(spark, 60)
    model = window_models.WindowReconstructor(["a", "b"], 5, 2).fit(frame(x))
    holed = frame(x).withColumns({"a": F.when(F.col("seq") != 30, F.col("a")), "label": F.when(F.col("seq") != 40, F.lit(0))})
    got = {r.seq: r for r in window_models.score_windows(holed, ["a", "b"], 5, model.reconstruct()).collect()}
    assert len(got) == 56 and [s for s, r in got.items() if r.window_error != r.window_error] == list(range(30, 35))
    assert all(r.label_any == 0 for r in got.values()) and got[40].label_last is None
