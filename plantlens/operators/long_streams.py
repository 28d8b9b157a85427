"""Order-dependent operators that choose between streams as partitions (keyed) and buckets of them (bucketed).

mode "keyed" partitions by stream, "bucketed" never does (see operators/bucketed.py), "auto" counts the longest stream
first. Results are equal in all modes; only how many rows one task may get differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.cells import is_finite, ratio
from plantlens.operators import bucketed, clean, frames, health, incidents as inc, metrics, order, scale, segments as seg, thresholds, windows
from plantlens.operators.order import STREAM

#: Rows of a bucket.
BUCKET = 100_000


def is_keyed(df: DataFrame, mode: str, stream: list[str]) -> bool:
    if mode not in ("auto", "keyed", "bucketed"):
        raise ValueError("mode is auto, keyed or bucketed")
    return (bucketed.pick_mode(df, stream) if mode == "auto" else mode) == "keyed"


def with_seq(df: DataFrame, order_by: list[str], stream: list[str] = STREAM, mode: str = "auto", part: Column | None = None) -> DataFrame:
    """Position of each row in its stream, from 0; part: as in bucketed.with_global_seq."""
    if is_keyed(df, mode, stream):
        return order.with_seq(df, stream, order_by)
    return bucketed.with_global_seq(df, order_by, stream, part)


def _numbered(runs: DataFrame, by: list[str], stream: list[str], bucket: int) -> DataFrame:
    """Runs with open_seq from 1 in the order of `by`, whose first column is a sequence number."""
    made = bucketed.with_global_seq(runs, by, stream, F.expr(f"{by[0]} div {bucket}"))
    return made.withColumn("open_seq", (F.col("seq") + 1).cast("int")).drop("seq")


def segments(df: DataFrame, condition: Column | None = None, stream: list[str] = STREAM, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As segments.segments."""
    if is_keyed(df, mode, stream):
        return seg.segments(df, condition, stream)
    hit = (F.col("label") == 1) if condition is None else condition
    made = _numbered(bucketed.segments(df, F.coalesce(hit, F.lit(False)), bucket, stream), ["start_seq"], stream, bucket)
    return made.withColumn("segment_id", F.col("open_seq") - 1).drop("open_seq")


def incidents(scores: DataFrame, threshold: float, score: str = "score", stream: list[str] = STREAM, start: str = "ts", end: str = "ts", top: str | None = None, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As incidents.incidents."""
    if is_keyed(scores, mode, stream):
        return inc.incidents(scores, threshold, score, stream, start, end, top)
    flagged = inc.flagged(scores, threshold, score, stream, start, end, top)
    runs = bucketed.run_starts(flagged, F.col("_hit"), bucket, stream).filter("_hit")
    made = inc.peaks(runs.withColumnRenamed("run_start", "_run"), [*stream, "_run"], bool(top)).drop("_run")
    after = flagged.select(*stream, (F.col("seq") - 1).alias("end_seq"), F.struct(F.coalesce("_end", "_start").alias("at")).alias("_after"))
    made = _numbered(made.join(after, [*stream, "end_seq"], "left"), ["start_seq"], stream, bucket)
    return inc.records(made, threshold, stream, bool(top))


def unchanged_runs(long: DataFrame, stream: list[str] = STREAM, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As health.unchanged_runs."""
    key = [*stream, "channel"]
    if is_keyed(long, mode, key):
        return health.unchanged_runs(long, stream)
    ok = is_finite("value")
    made = bucketed.run_lengths(long.withColumn("_ok", ok), F.when(F.col("_ok"), F.col("value")), bucket, key)
    return made.withColumn("run_length", F.when(F.col("_ok"), F.col("run_length")).otherwise(0).cast("long")).drop("_ok", "run_start")


def fault_incidents(stuck: DataFrame, verdicts: DataFrame, stream: list[str] = STREAM, from_seq: int = 0, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As incidents.fault_incidents; its runs need no order, only the numbers of its incidents do."""
    if is_keyed(stuck, mode, stream):
        return inc.fault_incidents(stuck, verdicts, stream, from_seq)
    made = _numbered(inc.fault_runs(stuck, verdicts, stream, from_seq), ["start_seq", "pos"], stream, bucket)
    return inc.fault_records(made, stream)


def point_adjust(df: DataFrame, truth: str = "label", pred: str = "pred", stream: list[str] = STREAM, out: str = "adjusted", mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As metrics.point_adjust; the hits of long runs come back by a join, which adaptive execution can split."""
    if is_keyed(df, mode, stream):
        return metrics.point_adjust(df, truth, pred, stream, out)
    runs = bucketed.run_starts(df, F.col(truth), bucket, stream)
    hit = runs.filter(F.col(truth) == 1).groupBy(*stream, "run_start").agg(F.max(pred).alias("_hit"))
    made = runs.join(hit, [*stream, "run_start"], "left")
    return made.withColumn(out, F.when(F.col(truth) == 1, F.col("_hit")).otherwise(F.col(pred))).select(*df.columns, out)


def temporal_split(df: DataFrame, frac: float, stream: list[str] = STREAM, label: str = "label", mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As scale.temporal_split; ranks are counted inside buckets, whose sums are added through one row for each."""
    if is_keyed(df, mode, stream):
        return scale.temporal_split(df, frac, stream, label)
    normal = (F.col(label) == 0).cast("int")
    parts = df.withColumns({"_bucket": F.expr(f"seq div {bucket}"), "_normal": normal})
    sums = parts.groupBy(*stream, "_bucket").agg(F.sum("_normal").alias("_sum"))
    ahead = Window.partitionBy(*stream).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*stream, "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_sum").over(Window.partitionBy(*stream)).alias("_n"))
    upto = Window.partitionBy(*stream, "_bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    made = parts.withColumn("_own", F.sum("_normal").over(upto)).join(sums, [*stream, "_bucket"])
    late = F.col("_ahead") + F.col("_own") > F.col("_n") - F.floor(F.col("_n") * frac)
    return made.withColumn("split", F.when(F.col("_normal") == 1, F.when(late, "val").otherwise("train"))).select(*df.columns, "split")


def window_labels(df: DataFrame, size: int, stride: int = 1, stream: list[str] = STREAM, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As windows.window_labels."""
    if is_keyed(df, mode, stream):
        return windows.window_labels(df, size, stride, stream)
    made = bucketed.over_windows(df.select(*stream, "seq", F.col("label").alias("label_last")), size, {"label_any": lambda w: F.max("label_last").over(w)}, max(bucket, size), stream)
    return made.filter(windows.ends(size, stride)).withColumn("window_id", F.expr(f"(seq - {size - 1}) div {stride}")).select(*stream, "label_any", "label_last", "window_id")


def transitions(df: DataFrame, pred: str = "pred", stream: list[str] = STREAM, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As metrics.transitions."""
    if is_keyed(df, mode, stream):
        return metrics.transitions(df, pred, stream)
    before = {"_before": lambda w: F.lag(pred).over(Window.partitionBy(*stream, "bucket").orderBy("seq"))}
    made = bucketed.over_windows(df, 2, before, bucket, stream).withColumn("_before", F.coalesce("_before", F.lit(0))).filter(F.col("_before") != F.col(pred))
    return made.select(*stream, "seq", "ts", F.when(F.col(pred) == 1, "onset").otherwise("recovery").alias("transition"))


def ffill_zero(df: DataFrame, features: list[str], stream: list[str] = STREAM, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As clean.ffill_zero."""
    return clean.ffill_zero(df, features, stream) if is_keyed(df, mode, stream) else bucketed.ffill_zero(df, features, bucket, stream)


def label_runs(df: DataFrame, label: str = "label", stream: list[str] = STREAM, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As segments.label_runs; run_id is the run's first seq in the bucketed form."""
    if is_keyed(df, mode, stream):
        return seg.label_runs(df, label, stream)
    return bucketed.run_starts(df, F.col(label), bucket, stream).withColumnRenamed("run_start", "run_id")


def _runs_by(label: str, stream: list[str], mode: str, bucket: int):
    return lambda df: label_runs(df, label, stream, mode, bucket)


def f1_grid(df: DataFrame, score: str = "score", n_grid: int = 200, stream: list[str] = STREAM, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As thresholds.f1_grid."""
    return thresholds.f1_grid(df, score, n_grid, stream, _runs_by("label", stream, mode, bucket))


def best_f1(df: DataFrame, score: str = "score", n_grid: int = 200, stream: list[str] = STREAM, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As thresholds.best_f1."""
    return thresholds.best_f1(df, score, n_grid, stream, _runs_by("label", stream, mode, bucket))


def segment_recall(df: DataFrame, truth: str = "label", pred: str = "pred", stream: list[str] = STREAM, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As metrics.segment_recall."""
    return metrics.segment_recall(df, truth, pred, stream, _runs_by(truth, stream, mode, bucket))


def protocol_ladder(scored: DataFrame, stream: list[str] = STREAM, published: float | None = None, tolerance: float = 0.05, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As metrics.protocol_ladder; a run of true rows counts whole by its number of rows and its highest prediction, so nothing is joined back to rows."""
    if is_keyed(scored, mode, stream):
        return metrics.protocol_ladder(scored, stream, published, tolerance)
    rungs = []
    for label, names in (("label_any", {"any_adjusted": True}), ("label_last", {"last_adjusted": True, "last_pointwise": False})):
        runs = bucketed.run_starts(scored.select(*stream, "seq", label, "pred"), F.col(label), bucket, stream)
        runs = runs.groupBy(*stream, "run_start", label).agg(F.count("*").alias("n"), F.sum("pred").alias("hits"))
        for name, adjusted in names.items():
            true, hits = F.col(label) == 1, F.col("hits")
            found = F.when(hits > 0, F.col("n")).otherwise(0) if adjusted else hits
            of = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
            rungs.append(runs.agg(of(true, found).alias("tp"), of(~true, hits).alias("fp"), of(true, F.col("n") - found).alias("fn"), of(~true, F.col("n") - hits).alias("tn")).withColumn("protocol", F.lit(name)))
    return metrics.ladder_rates(rungs[0].unionByName(rungs[1]).unionByName(rungs[2]), published, tolerance)


def running_recall(df: DataFrame, every: int, pred: str = "pred", truth: str = "label", stream: list[str] = STREAM, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As metrics.running_recall."""
    if is_keyed(df, mode, stream):
        return metrics.running_recall(df, every, pred, truth, stream)
    t, p = F.col(truth) == 1, F.col(pred) == 1
    made = bucketed.running_sums(df.select(*stream, "seq", truth, pred), {"attack": t.cast("int"), "detected": (t & p).cast("int")}, bucket, stream)
    made = made.filter((F.col("seq") + 1) % every == 0)
    return made.select(*stream, "seq", "attack", "detected", ratio(F.col("detected"), F.col("attack")).alias("recall"))


def segments_by_gap(df: DataFrame, seconds: float, stream: list[str] = STREAM, ts: str = "ts", mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As segments.segments_by_gap; positive rows are numbered anew, and each looks at the one before, also across buckets."""
    if is_keyed(df, mode, stream):
        return seg.segments_by_gap(df, seconds, stream, ts)
    hits = bucketed.with_global_seq(df.filter("label = 1").withColumnRenamed("seq", "_seq"), ["_seq"], stream, F.expr(f"_seq div {bucket}"))
    before = {"_before": lambda w: F.lag(ts).over(Window.partitionBy(*stream, "bucket").orderBy("seq"))}
    hits = bucketed.over_windows(hits, 2, before, bucket, stream)
    apart = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp")) > int(seconds * 1e6), F.lit(True))
    runs = bucketed.starts_of(hits, apart, bucket, stream)
    return runs.groupBy(*stream, "run_start").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n")).drop("run_start")


def window_kind(df: DataFrame, kind: str, priority: list[str], size: int, stream: list[str] = STREAM, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As windows.window_kind."""
    if is_keyed(df, mode, stream):
        return windows.window_kind(df, kind, priority, size, stream)
    names = F.array(*map(F.lit, priority))
    rank = F.coalesce(F.nullif(F.array_position(names, F.col(kind)), F.lit(0)), F.lit(len(priority) + 1))
    made = bucketed.over_windows(df.select(*stream, "seq", rank.alias("_rank")), size, {"_r": lambda w: F.min("_rank").over(w)}, max(bucket, size), stream)
    made = made.filter(windows.ends(size))
    return made.select(*stream, (F.col("seq") - (size - 1)).alias("window_id"), F.coalesce(F.get(names, F.col("_r").cast("int") - 1), F.lit("none")).alias("kind"))


def window_bounds(df: DataFrame, size: int, stride: int = 1, stream: list[str] = STREAM, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As windows.window_bounds."""
    if is_keyed(df, mode, stream):
        return windows.window_bounds(df, size, stride, stream)
    made = bucketed.over_windows(df.select(*stream, "seq", "ts"), size, {"window_start": lambda w: F.first("ts").over(w)}, max(bucket, size), stream)
    made = made.filter(windows.ends(size, stride))
    return made.select(*stream, "window_start", F.col("ts").alias("window_end"), F.expr(f"(seq - {size - 1}) div {stride}").alias("window_id"))


def alert_history(ml: DataFrame, faults: DataFrame, stream: list[str] = STREAM, mode: str = "auto") -> DataFrame:
    """As incidents.alert_history; alerts are numbered by parts of a day."""
    whole = ml.unionByName(faults, allowMissingColumns=True)
    if is_keyed(whole, mode, stream):
        return inc.alert_history(ml, faults, stream)
    ranked = whole.withColumn("_rank", F.when(F.col("category") == inc.ML, 0).otherwise(1))
    made = bucketed.with_global_seq(ranked, ["opened_at", "_rank", "open_seq"], stream)
    return made.withColumn("history_seq", (F.col("seq") + 1).cast("int")).drop("seq", "_rank")


def sliding_windows(df: DataFrame, features: list[str], size: int, stride: int = 1, stream: list[str] = STREAM, contiguous: bool = True, mode: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """As windows.sliding_windows; the bucketed form cuts arrays inside tasks."""
    if is_keyed(df, mode, stream):
        return windows.sliding_windows(df, features, size, stride, stream, contiguous=contiguous)
    return frames.sliding_windows(df, features, size, stride, stream, contiguous, bucket)
