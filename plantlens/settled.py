"""Frames that are written into the folder that driver and executors share, and read back."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Where the session names none, a master inside one process (tests) gets a local folder, once for each
    application; a cluster is refused, as its executors couldn't see such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _local_folders.get(context.applicationId) or _local_folders.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="plantlens-"))
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a reread and never a recomputation, and keeps
    column pruning, which RDD checkpoints lose.
    """
    return settled(df)[0]


def settled(df: DataFrame, more: Iterable[DataFrame] = ()) -> tuple[DataFrame, str]:
    """As settle, with the folder, so that it can be forgotten once nothing reads it any more.

    more: frames of the same columns whose rows are added one frame after the other; the shuffle files of one can go before the next is computed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plantlens/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for part in more:
        sweep(spark)
        part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete settled folders through Spark's file systems."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nobody holds any more; it does so once the driver's garbage is collected, which may take long."""
    gc.collect()
    spark._jvm.System.gc()


class Held:
    """Frames that are kept on disk while they are used, as Parquet in the shared folder; on a cluster whose session names no such folder they are persisted on disk."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: list[tuple[DataFrame, Callable[[], object]]] = []

    def __enter__(self) -> Held:
        return self

    def __exit__(self, *_: object) -> None:
        self.free(*(frame for frame, _ in self.frames))

    def keep(self, frames: DataFrame | Iterator[DataFrame]) -> DataFrame:
        """The frame's rows, computed now, or those of frames of the same columns, one frame after the other. What was shuffled for them can go then."""
        frames = iter([frames]) if isinstance(frames, DataFrame) else frames
        try:
            shared_folder(self.spark)
        except ValueError:
            frame = reduce(lambda a, b: a.unionByName(b), frames).persist(StorageLevel.DISK_ONLY)
            self.frames.append((frame, frame.unpersist))
            return frame
        frame, path = settled(next(frames), frames)
        self.frames.append((frame, lambda: forget(self.spark, path)))
        sweep(self.spark)
        return frame

    def free(self, *frames: DataFrame) -> None:
        for frame, end in [x for x in self.frames if any(x[0] is f for f in frames)]:
            end()
            self.frames = [x for x in self.frames if x[0] is not frame]
        sweep(self.spark)
