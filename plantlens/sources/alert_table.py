"""A table of alerts by key, kept as Parquet in buckets and changed bucket by bucket.

    data/<version>/bucket=<b>/   the rows of the buckets that a version changed
    manifest/<version>           which version has each bucket's rows, the schema, and the last epoch of each writer

An upsert reads and writes the buckets of its keys only, then commits by creating the next manifest, which fails if there is one
already. What a crash leaves behind is not in any manifest and is overwritten by the next attempt. The two newest manifests
and what they name are kept, so a reader that began with the last but one can finish.

A writer is a streaming query (its id stays the same for a checkpoint) or a name. An epoch that a writer has committed is never applied again.
A writer must be the only one at a time; a second one fails at its commit.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantlens.operators.alerts import upsert_alerts

BUCKETS, KEPT = 64, 2


class AlertTable:
    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = ("stream_id", "alert_id"), buckets: int = BUCKETS):
        """buckets: of a new table; an old one keeps its number. Rows of a batch's changed buckets are what an upsert rewrites."""
        if buckets < 1:
            raise ValueError("buckets must be positive")
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), tuple(key), buckets
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """Committed versions that are still there."""
        folder = self._hadoop(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """A version's manifest, the newest by default; None for a table without any."""
        there = self.versions()
        if not there or version is not None and version not in there:
            return None
        at = there[-1] if version is None else version
        stream = self._fs.open(self._hadoop(f"{self.path}/manifest/{at:012d}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Create the manifest under its own name at once: written aside, then renamed, which never replaces a file."""
        name = self._hadoop(f"{self.path}/manifest/{manifest['version']:012d}")
        aside = self._hadoop(f"{self.path}/manifest/.{manifest['version']:012d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(aside, name):
            self._fs.delete(aside, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} was committed by another writer")

    def _folders(self, manifest: dict, buckets: list[int]) -> list[str]:
        return [f"{self.path}/data/{manifest['buckets'][str(b)]}/bucket={b}" for b in buckets if str(b) in manifest["buckets"]]

    def _rows(self, manifest: dict, buckets: list[int]) -> DataFrame:
        schema, folders = StructType.fromJson(manifest["schema"]), self._folders(manifest, buckets)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All alerts; an error if nothing was ever written."""
        manifest = self.manifest()
        if manifest is None:
            raise FileNotFoundError(f"no table of alerts in {self.path}")
        return self._rows(manifest, list(range(manifest["n_buckets"])))

    def upsert(self, batch: DataFrame, writer: str = "batch", epoch: int | None = None, version_col: str = "version") -> int:
        """Put the newest version of each alert of the batch into the table; how many buckets were rewritten.

        epoch: the batch's number of this writer, which must follow on its last one (None: the next). A writer's first epoch may be any only if
        it is 0 or the table is new to it by intention (epoch None): a later one means that what it wrote before has gone, which is an error.
        """
        now = self.manifest()
        last = (now or {"writers": {}})["writers"].get(writer)
        if epoch is None:
            epoch = 0 if last is None else last + 1
        if last is not None and epoch <= last:
            return 0
        if epoch != (0 if last is None else last + 1):
            raise RuntimeError(f"{self.path} has no epoch {epoch - 1} of writer {writer}: its last is {last}")
        fresh = {"version": 0, "n_buckets": self.buckets, "buckets": {}, "writers": {}, "schema": StructType().jsonValue()}
        now = now or fresh
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(now["n_buckets"])).cast("int")
        dealt = batch.withColumn("_bucket", bucket).persist()
        try:
            changed = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())  # at most n_buckets rows
            made = dict(now, version=now["version"] + 1, writers=now["writers"] | {writer: epoch})
            if changed:
                before = self._rows(now, changed)
                rows = dealt.drop("_bucket")
                # The first batch gives the columns; later ones may add some.
                whole = upsert_alerts(before, rows, version_col, list(self.key)) if before.columns else upsert_alerts(rows.limit(0), rows, version_col, list(self.key))
                whole.withColumn("bucket", bucket).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{made['version']}")
                made["buckets"] = now["buckets"] | {str(b): made["version"] for b in changed}
                made["schema"] = whole.schema.jsonValue()
            self._commit(made)
        finally:
            dealt.unpersist()
        self._clean()
        return len(changed)

    def _clean(self) -> None:
        """Delete manifests but the newest KEPT, and the buckets' rows that none of these names."""
        there = self.versions()
        kept = [self.manifest(v) for v in there[-KEPT:]]
        named = {(v, b) for m in kept for b, v in m["buckets"].items()}
        for version in there[:-KEPT]:
            for b, v in self.manifest(version)["buckets"].items():
                if (v, b) not in named:
                    self._fs.delete(self._hadoop(f"{self.path}/data/{v}/bucket={b}"), True)
            self._fs.delete(self._hadoop(f"{self.path}/manifest/{version:012d}"), False)


def upsert_sink(path: str, key: tuple[str, ...] = ("stream_id", "alert_id"), buckets: int = BUCKETS, writer: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest version of each alert in an AlertTable.

    The query's id is the writer, so that a batch that is run again after a failure changes nothing, a query with a fresh checkpoint adds to what the
    table holds, and a query whose earlier batches the table doesn't know is stopped. `writer` names it outside of streaming queries.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        name = writer or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        AlertTable(spark, path, key, buckets).upsert(batch, name, epoch)

    return write
