"""Telemetry files in, results out."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions.cells import normalise_label, parse_ts

#: Names that mark time and label columns where no schema is given, first hit first, case ignored.
TIME_NAMES = ("timestamp", "time", "date", "row", "datetime")
LABEL_NAMES = ("normal/attack", "label", "y", "attack", "class")

#: Up to so many files their ranks are broadcast; beyond, they are joined by a shuffle.
BROADCAST_FILES = 100_000


def _pick(names: list[str], wanted: tuple[str, ...]) -> str | None:
    lower = {n.lower(): n for n in reversed(names)}
    return next((lower[w] for w in wanted if w in lower), None)


def _files(spark: SparkSession, pattern: str, exclude: str | None) -> list[tuple[str, str]]:
    """Files of a Hadoop glob in name order: address and first line that isn't blank (only the file's beginning is read)."""
    from fnmatch import fnmatch

    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(conf)
    found = sorted((str(f.getPath().toUri().toString()), f.getPath()) for f in system.globStatus(path) or [])
    out = []
    for name, place in found:
        if exclude and fnmatch(place.getName(), exclude):
            continue
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(system.open(place), "UTF-8"))
        try:
            line = lines.readLine()
            while line is not None and not line.strip():
                line = lines.readLine()
        finally:
            lines.close()
        out.append((name, line or ""))
    return out


def read_telemetry_csv(spark: SparkSession, pattern: str, exclude: str | None = None, time: str | None = None, label: str | None = None, mode: str = "reject", needle: str = "attack", ts_format: str | None = None):
    """One frame of all files of a glob, by name: ts, features as double, label, source and its rank.

    Header names are trimmed. Without names, time and label columns are found by TIME_NAMES and LABEL_NAMES. Rows with
    another number of fields than the header are an error (mode="reject", raised when they are read) or come back
    as a second frame (mode="quarantine"). Files with one header are one scan, however many they are.
    """
    if mode not in ("reject", "quarantine"):
        raise ValueError("mode is reject or quarantine")
    files = _files(spark, pattern, exclude)
    if not files:
        raise FileNotFoundError(pattern)
    by_header: dict[tuple, list[str]] = {}
    for name, line in files:
        by_header.setdefault(tuple(h.strip() for h in next(csv.reader(io.StringIO(line)), [])), []).append(name)
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  file:/x and file:///x are one
    ranks = spark.createDataFrame([(name, rank) for rank, (name, _) in enumerate(files)], "source string, source_rank int").withColumn("_file", plain("source"))
    good, bad = [], []
    for header, paths in by_header.items():
        names = list(header)
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", "_bad").schema(", ".join(f"`c{k}` string" for k in range(len(names))) + ", _bad string").csv(paths)
        raw = raw.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)), "_bad", plain("_metadata.file_path").alias("_file"))
        raw = raw.join(F.broadcast(ranks) if len(files) <= BROADCAST_FILES else ranks, "_file").drop("_file")  # a row for each file
        t, y = time or _pick(names, TIME_NAMES), label or _pick(names, LABEL_NAMES)
        features = [n for n in names if n not in (t, y)]
        # Filters, so that no projection can prune the check; they also need a field besides the raw row.
        some = F.length(F.concat(F.coalesce("_bad", F.lit("")), F.coalesce(F.col(f"`{names[0]}`"), F.lit("")))) >= 0
        if mode == "reject":
            fail = F.raise_error(F.concat(F.col("source"), F.lit(f": a row has not {len(names)} fields: "), F.col("_bad"))).cast("boolean")
            raw = raw.filter(F.when(F.col("_bad").isNotNull() & some, fail).otherwise(some))
        else:
            bad.append(raw.filter(F.col("_bad").isNotNull() & some).select("source", F.col("_bad").alias("row")))
            raw = raw.filter(F.col("_bad").isNull() & some)
        columns = [(parse_ts(f"`{t}`", ts_format) if ts_format else F.col(f"`{t}`").try_cast("timestamp")).alias("ts")] if t else []
        columns += [F.expr(f"try_cast(trim(`{f}`) as double)").alias(f) for f in features]
        columns += [normalise_label(F.col(f"`{y}`"), needle, numeric=True).alias("label")] if y else []
        good.append(raw.select(*columns, "source", "source_rank"))
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return (union(good), union(bad)) if mode == "quarantine" else union(good)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", files: int | None = None, mode: str = "error") -> None:
    """Write a frame as parquet, csv or json; nested columns become JSON text in csv."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"no sink for {fmt}")
    if fmt == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
        df = df.withColumns({c: F.to_json(c) for c in nested})
    if files:
        df = df.coalesce(files)
    writer = df.write.mode(mode)
    (writer.option("header", True).csv if fmt == "csv" else getattr(writer, fmt))(path)


def read_alerts(spark: SparkSession, url: str, table: str = "alerts", **options: str) -> DataFrame:
    """The alert table from a database (jdbc:...; filters and limits are pushed down), an AlertTable's folder or a folder of Parquet files."""
    from plantlens.sources.alert_table import AlertTable

    if url.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    kept = AlertTable(spark, url)
    return kept.read() if kept.versions() else spark.read.parquet(url)
