"""The runner's measures from counted scores against those of whole frames, and what a run leaves on disk."""

from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.catalog import QUERIES
from plantlens.functions.cells import over_threshold
from plantlens.operators import frames, metrics, thresholds, window_models
from plantlens.plans import runner
from plantlens.settled import Held, sweep


@pytest.fixture(scope="module")
def odd(spark):
    """Three streams with ties, null and NaN scores, signed zeros, missing labels and a label that is neither 0 nor 1."""
    rng = np.random.default_rng(6)
    some = lambda: [None, float("nan"), -0.0, 0.0][rng.integers(4)] if rng.random() < 0.1 else float(rng.integers(-20, 40)) / 4
    labels = [0, 0, 0, 1, 1, None, 2]
    rows = [(s, q, labels[rng.integers(7)] if rng.random() < 0.5 else int(q // 5 % 3 == 0), ["train", "val", None][rng.integers(3)], some()) for s in (1, 2, 3) for q in range(200)]
    return spark.createDataFrame(rows, "stream_id long, seq long, label int, split string, x double").repartition(4)


@pytest.mark.parametrize("apart", [False, True])
def test_measures_from_counted_scores(odd, apart):
    """Equal to the operators on whole frames, which count a run by each of its rows."""
    held_out = odd.filter("seq % 3 = 0").select("x") if apart else None
    got = runner.evaluate(odd, "x", 95.0, validation=held_out, threads=3, parts=1 + apart).first()
    thr = thresholds.threshold_value(odd.filter("split = 'val'") if held_out is None else held_out, "x", 95.0)
    fixed = metrics.prf(odd.withColumn("pred", over_threshold("x", thr).cast("int")), point_adjusted=True).first()
    best, area = thresholds.best_f1(odd, "x").first(), metrics.auc(odd, "x").first()
    assert got.threshold == thr or np.isnan(thr) and np.isnan(got.threshold)
    assert (got.f1_fixed, got.f1_best) == (fixed["f1"], best["f1"])
    assert (got.roc_auc, got.average_precision) == pytest.approx((area["roc_auc"], area["average_precision"]), abs=1e-12)
    counts = thresholds.score_counts(odd, "x", validation=held_out).localCheckpoint()
    for p in (0.0, 80.0):
        t = thresholds.threshold_of_counts(counts, p, "n")
        assert t == thresholds.threshold_value(odd, "x", p)
        want = metrics.prf(odd.withColumn("pred", over_threshold("x", t).cast("int")), point_adjusted=True).first()
        assert thresholds.f1_of_counts(counts, t).first()["f1"] == want["f1"]


def test_frames_without_scores(odd):
    """Without any score there is no best threshold and so no row; without validation scores no fixed threshold."""
    nothing = odd.withColumn("x", F.lit(None).cast("double"))
    assert runner.evaluate(nothing, "x").collect() == [] and runner.evaluate(odd.limit(0), "x").collect() == []
    got = runner.evaluate(odd.filter("split = 'train'"), "x").first()
    assert got.threshold is None and got.f1_fixed == 0.0 and got.f1_best > 0


def test_short_streams_are_shuffled_once(odd):
    """Windows over removed rows: streams that are a bucket each are numbered and cut after one shuffle, with the results of buckets with halos."""
    rows = odd.withColumn("x", F.coalesce(F.nanvl("x", F.lit(1.0)), F.lit(2.0))).filter("label = 0")
    apply = lambda parts: (b for f in parts for b in f.rows.select(["stream_id", "seq"]).take(f.last).to_batches())
    one, more = (frames.map_windows(rows, ["x"], 4, apply, "stream_id long, seq long", contiguous=False, bucket=n) for n in (100_000, 16))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, more.collect()))


def shuffled(spark) -> int:
    """Bytes of the shuffle files that are there."""
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    found = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")]
    return sum(os.path.getsize(f) for f in found if os.path.exists(f))


def written(spark) -> int:
    """Bytes that have been shuffled."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_run_all_frees_its_disk(spark, sf, monkeypatch):
    """While it runs, most of what it has shuffled is gone; in the end nothing is held."""
    sweep(spark)
    time.sleep(1)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = lambda: {n for _, names, _ in os.walk(folder) for n in names if len(n) == 32}
    before, start, folders, kept, left = shuffled(spark), written(spark), held(), len(spark.sparkContext._jsc.getPersistentRDDs()), []
    keep = Held.keep

    def watched(self, df):
        frame = keep(self, df)
        time.sleep(1)  # files go behind the program's back
        left.append(shuffled(spark) - before)
        return frame

    monkeypatch.setattr(Held, "keep", watched)
    assert len(QUERIES["run_all"](spark, sf).collect()) == 6
    assert len(left) >= 10 and max(left) < 0.5 * (written(spark) - start), (left, written(spark) - start)
    assert held() == folders and len(spark.sparkContext._jsc.getPersistentRDDs()) == kept


def test_windows_are_scored_without_times(odd):
    model = lambda x: (x * 0.0, x * 0.5)
    rows = odd.withColumn("x", F.coalesce(F.nanvl("x", F.lit(1.0)), F.lit(2.0))).filter("label is not null")
    plain = window_models.score_by_models(rows, ["x"], 3, {"m": model})
    timed = window_models.score_by_models(rows.withColumn("ts", F.timestamp_seconds("seq")), ["x"], 3, {"m": model})
    assert plain.columns == ["stream_id", "seq", "label", "m"] and sorted(map(tuple, plain.collect())) == sorted(map(tuple, timed.drop("ts").collect()))


def test_streams_in_turn(spark, monkeypatch):
    """A table over the rows of a part is dealt by streams, each part in turn, with equal results."""
    rng = np.random.default_rng(9)
    rows = [(s, q, float(rng.normal()), float(rng.normal()), int(q % 17 > 13)) for s in [*range(7), None] for q in range(60)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, a double, b double, label int")
    plain = {"a": lambda train, rows: rows.withColumn("score", F.col("a")), "b": lambda train, rows: rows.withColumn("score", F.abs("b"))}
    by_window = {"w": lambda train, size: lambda x: (x * 0.0, x * 0.5)}
    run = lambda: {(r.model, r.labelling): r[2:] for r in runner.run_all(df, ["a", "b"], plain, overrides={"size": 5}, window_models=by_window).collect()}
    whole = run()
    monkeypatch.setattr(runner, "ROWS", 200)
    split = [p.select("stream_id").distinct().count() for p in runner.in_parts(df, 3)]
    assert sum(split) == 8 and min(split) > 0
    parted = run()
    assert set(parted) == set(whole) and len(whole) == 4
    for k, v in whole.items():
        assert parted[k] == pytest.approx(v, abs=1e-9)
