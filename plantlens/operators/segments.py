"""Runs of equal condition (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.operators.order import STREAM, by_stream

#: Rows of a bucket of sequence numbers in joins with spans.
BUCKET = 1000


def with_run(df: DataFrame, new_run: Column, stream: list[str] = STREAM, out: str = "run_id") -> DataFrame:
    """Number the runs of a stream; new_run is true where one begins."""
    return df.withColumn(out, F.sum(new_run.cast("int")).over(by_stream(stream).rowsBetween(Window.unboundedPreceding, 0)))


def label_runs(df: DataFrame, label: str = "label", stream: list[str] = STREAM) -> DataFrame:
    """Column run_id: the runs of equal labels of each stream."""
    return with_run(df, F.coalesce(F.lag(label).over(by_stream(stream)), F.lit(-1)) != F.col(label), stream)


def segments(df: DataFrame, condition: Column | None = None, stream: list[str] = STREAM) -> DataFrame:
    """Half-open runs [start_seq, stop_seq) of rows that meet the condition (label 1), with times and length."""
    hit = (F.col("label") == 1) if condition is None else condition
    flagged = df.withColumn("_hit", hit.cast("int"))
    changed = F.coalesce(F.lag("_hit").over(by_stream(stream)), F.lit(-1)) != F.col("_hit")
    runs = with_run(flagged, changed, stream).filter("_hit = 1")
    made = runs.groupBy(*stream, "run_id").agg(F.min("seq").alias("start_seq"), (F.max("seq") + 1).alias("stop_seq"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("length"))
    number = F.row_number().over(Window.partitionBy(*stream).orderBy("start_seq")) - 1
    return made.withColumn("segment_id", number).drop("run_id")


def longest_segment(segs: DataFrame, stream: list[str] = STREAM) -> DataFrame:
    """The longest run of each stream, the first on ties."""
    best = F.min_by(F.struct("start_seq", "stop_seq", "length"), F.struct(-F.col("length"), F.col("start_seq"))).alias("b")
    return segs.groupBy(*stream).agg(best).select(*stream, "b.*")


def first_normal_range(df: DataFrame, least: int, stream: list[str] = STREAM, strict: bool = False) -> DataFrame:
    """The first run of at least `least` normal rows of each stream; strict: a stream without one is an error."""
    runs = segments(df, F.col("label") == 0, stream).filter(F.col("length") >= least)
    found = runs.groupBy(*stream).agg(F.min(F.struct("start_seq", "stop_seq")).alias("b")).select(*stream, "b.*")
    if strict and df.select(*stream).distinct().join(found, stream, "left_anti").limit(1).count():
        raise ValueError(f"a stream has no normal run of {least} rows")
    return found


def with_warmup(segs: DataFrame, warmup: int) -> DataFrame:
    """Segments with up to `warmup` rows before them."""
    return segs.withColumn("from_seq", F.greatest(F.col("start_seq") - warmup, F.lit(0)))


def in_spans(df: DataFrame, spans: DataFrame, start: str, stop: str, stream: list[str] = STREAM, bucket: int = BUCKET) -> DataFrame:
    """Rows with start <= seq < stop of each span of their stream, and the spans' columns.

    Spans are dealt to the buckets of sequence numbers that they touch, so rows and spans meet by (stream, bucket): the work is that of the rows
    and of the rows in spans, however long a stream is.
    """
    touched = F.sequence(F.expr(f"{start} div {bucket}"), F.expr(f"({stop} - 1) div {bucket}"))
    dealt = spans.filter(F.col(stop) > F.col(start)).withColumn("_bucket", F.explode(touched))
    rows = df.withColumn("_bucket", F.expr(f"seq div {bucket}"))
    return rows.join(dealt, [*stream, "_bucket"]).filter((F.col("seq") >= F.col(start)) & (F.col("seq") < F.col(stop))).drop("_bucket")


def segment_rows(df: DataFrame, segs: DataFrame, stream: list[str] = STREAM, bucket: int = BUCKET) -> DataFrame:
    """The rows from from_seq to stop_seq of each segment."""
    return in_spans(df, segs.select(*stream, "segment_id", "from_seq", "stop_seq"), "from_seq", "stop_seq", stream, bucket)


def centre_window(segs: DataFrame, size: int, stream: list[str] = STREAM) -> DataFrame:
    """A window around the middle of each stream's longest run."""
    middle = F.expr("(start_seq + stop_seq) div 2")
    return longest_segment(segs, stream).select(*stream, F.greatest(middle - size // 2, F.lit(0)).alias("window_seq"))


def segments_by_gap(df: DataFrame, seconds: float, stream: list[str] = STREAM, ts: str = "ts") -> DataFrame:
    """Runs of positive rows with no two neighbours more than `seconds` apart."""
    hits = df.filter("label = 1")
    apart = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(by_stream(stream)).cast("timestamp")) > int(seconds * 1e6), F.lit(True))
    runs = with_run(hits, apart, stream)
    return runs.groupBy(*stream, "run_id").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n")).drop("run_id")


def segment_peaks(scores: DataFrame, segs: DataFrame, probe: int = 3, stream: list[str] = STREAM, score: str = "score", bucket: int = BUCKET) -> DataFrame:
    """The highest score over the first `probe` rows of each segment (peak) and where it is first reached (peak_seq). NaN and null are no scores."""
    if probe < 1:
        raise ValueError("probe must be at least 1")
    spans = segs.select(*stream, "segment_id", "start_seq", "stop_seq", F.least("stop_seq", F.col("start_seq") + probe).alias("_probed"))
    near = in_spans(scores.filter(F.col(score).isNotNull() & ~F.isnan(score)), spans, "start_seq", "_probed", stream, bucket)
    best = F.min(F.struct((-F.col(score)).alias("less"), F.col("seq").alias("seq"))).alias("_best")
    made = near.groupBy(*stream, "segment_id", "start_seq", "stop_seq").agg(best)
    return made.select(*stream, "segment_id", "start_seq", "stop_seq", (-F.col("_best.less")).alias("peak"), F.col("_best.seq").alias("peak_seq"))


def rank_segments(scores: DataFrame, segs: DataFrame, probe: int = 3, stream: list[str] = STREAM, score: str = "score", bucket: int = BUCKET) -> DataFrame:
    """Segments of each stream by their peak, the most detectable first (rank 1); the earlier one on ties."""
    order = Window.partitionBy(*stream).orderBy(F.desc("peak"), "start_seq")
    return segment_peaks(scores, segs, probe, stream, score, bucket).withColumn("rank", F.row_number().over(order))


def best_segment(scores: DataFrame, segs: DataFrame, probe: int = 3, stream: list[str] = STREAM, score: str = "score", bucket: int = BUCKET) -> DataFrame:
    """The segment of rank 1 of each stream, by an aggregate that combines on the map side."""
    peaks = segment_peaks(scores, segs, probe, stream, score, bucket)
    best = F.min_by(F.struct("segment_id", "start_seq", "stop_seq", "peak", "peak_seq"), F.struct(-F.col("peak"), F.col("start_seq"))).alias("_b")
    return peaks.groupBy(*stream).agg(best).select(*stream, "_b.*")
