"""Connected components of a link table, by contraction inside tasks and pointer jumping between them.

Links point from a node to a lesser one. Each round deals links by their nodes, so that all of a node's links meet in one
task; a task replaces its links by stars with the same components (so a node has few links, and hubs are only pointed
at). Then every link to a node that itself points on is moved to that node's least target, which halves the length
of chains. Nodes that point on while they are pointed at are few and reach the links by a broadcast if their counted size
allows, else by a join. Each round's links are written to the shared folder, and the round before is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import forget, settled, small

#: Links that a task contracts at a time.
CHUNK = 1 << 19


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 .. n - 1 the least one reachable by links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (root[a], root[b]):  # roots take the least root across a link, then all nodes their root's root
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _stars(links: DataFrame) -> DataFrame:
    """Links (a, b) with b < a that have the same components, fewer than the nodes of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def contracted() -> pa.RecordBatch:
            node, place = np.unique(np.concatenate([np.stack([h.column(0).to_numpy(), h.column(1).to_numpy()]) for h in held], 1), return_inverse=True)
            place = place.reshape(2, -1)
            root = least_reachable(place[0], place[1], len(node))
            moved = root != np.arange(len(node))
            return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= CHUNK:
                yield contracted()
                held, rows = [], 0
        if held:
            yield contracted()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and component (the least node reachable) of every node that has a link.

    Links may repeat, go either way and join a node with itself; nulls are ignored. No links: no rows.
    """
    spark = links.sparkSession
    found = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    links, used = _stars(found), []
    while True:
        links, path = settled(_stars(links.repartition("a")))
        nodes = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        aimed = links.select(F.col("b").alias("a")).distinct().withColumn("aimed", F.lit(True))
        open_, open_path = settled(nodes.join(aimed, "a", "left").filter("n > 1 or aimed").select("a", "m", F.coalesce("aimed", F.lit(False)).alias("aimed")))
        forget(spark, *used)
        number = open_.count()
        if not number:
            break
        used = [path, open_path]
        jump = open_.filter("aimed").select(F.col("a").alias("b"), "m")
        links = links.join(small(jump, number, 16), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
