"""Spans of segments joined to rows by buckets."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.operators import segments as seg


@pytest.fixture(scope="module")
def long(spark):
    """A long and a short stream with segments of 1 to 40 rows; scores tie and some are missing."""
    rng = np.random.default_rng(3)
    rows = []
    for s, n in ((1, 3000), (2, 50)):
        label = np.repeat(rng.integers(0, 2, n), rng.integers(1, 41, n))[:n]
        rows += [(s, q, int(v), [None, float("nan")][q % 2] if q % 11 == 0 else float(rng.integers(0, 6))) for q, v in enumerate(label)]
    return spark.createDataFrame(rows, "stream_id long, seq long, label int, score double").withColumn("ts", F.timestamp_seconds("seq"))


def by_hand(rows):
    out = {}
    for s in {r.stream_id for r in rows}:
        mine = sorted((r for r in rows if r.stream_id == s), key=lambda r: r.seq)
        starts = [r.seq for k, r in enumerate(mine) if r.label and not (k and mine[k - 1].label)]
        for number, a in enumerate(starts):
            b = next((r.seq for r in mine[a:] if not r.label), len(mine))
            out[s, number] = (a, b, mine)
    return out


@pytest.mark.parametrize("bucket", [3, 64, 10_000])
def test_rows_and_peaks(long, bucket):
    segs, want = seg.segments(long), by_hand(long.collect())
    got = {}
    for r in seg.segment_rows(long, seg.with_warmup(segs, 9), bucket=bucket).collect():
        got.setdefault((r.stream_id, r.segment_id), []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(max(0, a - 9), b)) for k, (a, b, _) in want.items()}
    ranked = seg.rank_segments(long, segs, 3, bucket=bucket).collect()
    peaks = {}
    for k, (a, b, mine) in want.items():
        probed = [(-r.score, r.seq) for r in mine[a : min(b, a + 3)] if r.score is not None and r.score == r.score]
        if probed:
            peaks[k] = min(probed)
    assert {(r.stream_id, r.segment_id): (-r.peak, r.peak_seq) for r in ranked} == peaks
    for s in (1, 2):
        order = [r.segment_id for r in sorted((r for r in ranked if r.stream_id == s), key=lambda r: r["rank"])]
        assert order == [k for _, k in sorted((p[0], k) for (t, k), p in peaks.items() if t == s)]
    best = {r.stream_id: (r.segment_id, r.peak, r.peak_seq) for r in seg.best_segment(long, segs, 3, bucket=bucket).collect()}
    assert best == {r.stream_id: (r.segment_id, r.peak, r.peak_seq) for r in ranked if r["rank"] == 1}


def test_empty_spans_and_bad_probes(spark, long):
    none = spark.createDataFrame([(1, 5, 5), (1, 9, 2)], "stream_id long, from_seq long, stop_seq long")
    assert seg.in_spans(long, none, "from_seq", "stop_seq").count() == 0
    with pytest.raises(ValueError):
        seg.segment_peaks(long, seg.segments(long), 0)


def test_joins_by_bucket_only(long):
    """No join of rows with segments has the stream as its only key."""
    for made in (seg.segment_rows(long, seg.with_warmup(seg.segments(long), 9)), seg.rank_segments(long, seg.segments(long), 3)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[([^\]]*)\]", plan)
        assert joins and all("_bucket" in keys for keys in joins)
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_work_is_linear_in_rows_and_overlaps(spark):
    """One stream of a million rows and a hundred thousand segments: the rows that meet a span's bucket stay near the rows inside spans."""
    rows = spark.range(1_000_000).select(F.lit(1).alias("stream_id"), F.col("id").alias("seq"))
    spans = spark.range(100_000).select(F.lit(1).alias("stream_id"), F.col("id").alias("segment_id"), (F.col("id") * 10).alias("from_seq"), (F.col("id") * 10 + 5).alias("stop_seq"))
    assert seg.segment_rows(rows, spans, bucket=20).count() == 500_000
