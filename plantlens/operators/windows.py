"""Sliding windows of W samples. What needs only the last, least or any value never makes arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.operators.order import STREAM, by_stream


def frame(size: int, stream: list[str] = STREAM):
    return by_stream(stream).rowsBetween(-(size - 1), 0)


def ends(size: int, stride: int = 1):
    """Rows at which a window ends."""
    return (F.col("seq") >= size - 1) & ((F.col("seq") - (size - 1)) % stride == 0)


def sliding_windows(df: DataFrame, features: list[str], size: int, stride: int = 1, stream: list[str] = STREAM, strict: bool = False, contiguous: bool = True) -> DataFrame:
    """window_id, bounds, values (array of rows, oldest first) and labels of each full window.

    contiguous: windows are of consecutive seq, so none goes across removed rows; else rows are counted anew and windows straddle them.
    frames.sliding_windows cuts the same windows of long streams in buckets.
    """
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be at least 1")
    if strict and df.groupBy(*stream).count().filter(F.col("count") < size).limit(1).count():
        raise ValueError(f"a stream is shorter than a window of {size}")
    if not contiguous:
        df = df.withColumn("seq", F.row_number().over(by_stream(stream)).cast("long") - 1)
    w = frame(size, stream)
    made = df.select(
        *stream, "seq", F.expr(f"(seq - {size - 1}) div {stride}").alias("window_id"), F.first("ts").over(w).alias("window_start"), F.col("ts").alias("window_end"),
        F.collect_list(F.array(*features)).over(w).alias("values"), F.collect_list("label").over(w).alias("labels"), F.first("seq").over(w).alias("_first"),
    )
    return made.filter(ends(size, stride) & (F.size("values") == size) & (F.col("_first") == F.col("seq") - (size - 1))).drop("seq", "_first")


def window_labels(df: DataFrame, size: int, stride: int = 1, stream: list[str] = STREAM) -> DataFrame:
    """label_any and label_last of each window."""
    made = df.select(*stream, "seq", F.max("label").over(frame(size, stream)).alias("label_any"), F.col("label").alias("label_last"))
    return made.filter(ends(size, stride)).withColumn("window_id", F.expr(f"(seq - {size - 1}) div {stride}")).drop("seq")


def label_inflation(df: DataFrame, size: int, stream: list[str] = STREAM) -> DataFrame:
    made = window_labels(df, size, stream=stream)
    return made.agg(F.sum("label_any").alias("n_any"), F.sum("label_last").alias("n_last"), F.sum(F.col("label_any") - F.col("label_last")).alias("inflation"))


def window_kind(df: DataFrame, kind: str, priority: list[str], size: int, stream: list[str] = STREAM) -> DataFrame:
    """The kind of highest priority (first in the list) in each window."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(kind)), F.lit(0))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    made = df.select(*stream, "seq", F.min(rank).over(frame(size, stream)).alias("_r")).filter(ends(size))
    return made.select(*stream, (F.col("seq") - (size - 1)).alias("window_id"), F.coalesce(F.get(F.array(*map(F.lit, priority)), F.col("_r").cast("int") - 1), F.lit("none")).alias("kind"))


def window_bounds(df: DataFrame, size: int, stride: int = 1, stream: list[str] = STREAM) -> DataFrame:
    w = frame(size, stream)
    made = df.select(*stream, "seq", F.first("ts").over(w).alias("window_start"), F.col("ts").alias("window_end"))
    return made.filter(ends(size, stride)).withColumn("window_id", F.expr(f"(seq - {size - 1}) div {stride}")).drop("seq")


def flatten_window(windows: DataFrame) -> DataFrame:
    """Column flat: values row by row (index t * features + f)."""
    return windows.withColumn("flat", F.flatten("values"))


def history_target(df: DataFrame, feature: str, size: int, stream: list[str] = STREAM) -> DataFrame:
    """The size - 1 values before each window's last sample (as their mean and first) and that sample's value."""
    before = by_stream(stream).rowsBetween(-(size - 1), -1)
    made = df.select(*stream, "seq", F.avg(feature).over(before).alias("history_mean"), F.first(feature).over(before).alias("history_first"), F.col(feature).alias("target"))
    return made.filter(F.col("seq") >= size - 1)


def history_targets(windows: DataFrame) -> DataFrame:
    """history (the samples before the last one) and target (the last one) of windows, for all features."""
    size = F.size("values")
    return windows.withColumns({"history": F.slice("values", F.lit(1), size - 1), "target": F.element_at("values", -1)})


def preprocess(df: DataFrame, features: list[str], standard: DataFrame, minmax: DataFrame, size: int, stride: int = 1) -> DataFrame:
    """Scale once (affine scaling commutes with windowing), cut windows, flatten, min-max scale."""
    from plantlens.operators.scale import apply_minmax, apply_standard

    return apply_minmax(flatten_window(sliding_windows(apply_standard(df, standard, "float"), features, size, stride)), minmax)

