"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.settled import forget, settle, settled, shared_folder  # noqa: F401  the operators import them from here

#: A side of at most this many bytes may be broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Mark a frame of a counted size for broadcast if it is proven small; else leave it to a shuffle join."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which a deployment sets by its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_bytes(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Cut an Arrow column of texts into consecutive slices of at most `limit` bytes (UTF-8); a longer text stands alone."""
    start = size = 0
    for at, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if at > start and size + n > limit:
            yield start, at
            start, size = at, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def sliced(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, list[str]]]:
    """The slices of by_bytes with their texts (null: empty), so that no more than a slice is held as Python strings."""
    for start, stop in by_bytes(texts, limit):
        yield start, stop, [t or "" for t in texts.slice(start, stop - start).to_pylist()]
