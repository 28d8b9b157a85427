"""Sequence numbers and order-dependent selection inside streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

STREAM = ["stream_id"]


def by_stream(stream: list[str] = STREAM, order: list[str] | str = "seq") -> WindowSpec:
    return Window.partitionBy(*stream).orderBy(*([order] if isinstance(order, str) else order))


def with_seq(df: DataFrame, stream: list[str] = STREAM, order: list[str] | str = "ts") -> DataFrame:
    """Position of each row in its stream, from 0."""
    return df.withColumn("seq", F.row_number().over(by_stream(stream, order)).cast("long") - 1)


def subsample(df: DataFrame, step: int, stream: list[str] = STREAM) -> DataFrame:
    """Every step-th row of each stream, numbered anew."""
    if step < 1:
        raise ValueError("step must be at least 1")
    if step == 1:
        return df
    return df.filter(F.col("seq") % step == 0).withColumn("seq", F.expr(f"seq div {step}"))


def slice_seq(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows with start <= seq < stop."""
    if not 0 <= start <= stop:
        raise ValueError(f"[{start}, {stop}) is no range")
    return df.filter((F.col("seq") >= start) & (F.col("seq") < stop))


def sample_at(df: DataFrame, seq: int) -> DataFrame:
    return slice_seq(df, seq, seq + 1)


def head_of_source(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in the given order (a top-n, never a full sort)."""
    return df.orderBy(*order).limit(n)


def merge_sources(*sources: DataFrame, order: list[str], stream: list[str] = STREAM) -> DataFrame:
    """One frame of all sources in stable order: by `order`, then by source, numbered by stream."""
    ranked = [s.withColumn("source_rank", F.lit(k)) for k, s in enumerate(sources)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return with_seq(whole, stream, [*order, "source_rank"])
