"""Streams of samples: ordered input, stateful windows, channel health and incidents per stream.

State is small and bounded per stream (the last W - 1 samples, one run per channel, one open incident, what is held back); it lives in
typed variables of Spark's state store, so a restart from the checkpoint goes on with open incidents and running numbers. A fresh checkpoint can
start from stored alerts (seed). A sample is late if it is older than the last one processed of its stream, or, where tie columns are given, not
after it; samples of equal time are kept in the order of their arrival, nulls in tie columns come first. Late samples never change state: the stateful operators drop them,
and ordered_stream, put before them in a query of its own, waits for stragglers and hands late ones out marked.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantlens.operators.incidents import FAULT, ML
from plantlens.streaming import state


def stream_telemetry(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 1, ts: str = "ts", fmt: str = "parquet") -> DataFrame:
    """Samples from files as they arrive, oldest first; times become TIMESTAMP, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def _places(sdf: DataFrame, ts: str, ties: tuple[str, ...]) -> StructType:
    return StructType([sdf.schema[c] for c in (ts, *ties)])


def _run(sdf: DataFrame, key: str, output: str, held: str, step, delay: str = "1 hour", ts: str = "ts", ties: tuple[str, ...] = (), reset: str | None = None, seed: DataFrame | None = None) -> DataFrame:
    """Apply step(held, row) -> list of output tuples to each stream's new samples in order of time.

    held: the fields of the state. reset: a column that is true at a sample before which the stream's state is cleared, its numbers
    included. seed: first states by `key`, taken by a fresh checkpoint.
    """
    state.need_rocksdb(sdf)
    places, names = _places(sdf, ts, ties), [c.strip().split(" ")[0] for c in output.split(",")]
    processor = state.InOrder(step, StructType.fromDDL(held), places, ts, ties, reset, names)
    if seed is not None:
        last = F.struct(*(F.col("_last").cast("timestamp").alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in places))
        seed = seed.withColumn("last", F.when(F.col("_last").isNotNull(), last)).drop("_last").groupBy(key)
    rows = sdf.withWatermark(ts, delay).groupBy(key)
    return rows.transformWithState(processor, output, "append", "None", seed)


def ordered_stream(sdf: DataFrame, delay: float, on_late: str = "mark", key: str = "stream_id", ts: str = "ts", ties: tuple[str, ...] = (), idle: float = 3600.0) -> DataFrame:
    """The samples of each stream in order of time, with seq and late.

    A sample is held back until one of its stream is more than `delay` seconds newer, and then let out in its place; so the
    result doesn't hang on how samples fall into batches. A sample that is older than one already let out is late: it
    comes out at once with late = true and no seq (on_late="mark"), or not at all ("drop").

    The last samples of a stream are let out by a timer once the watermark passes them: the newest sample of any stream, less delay + idle
    seconds. Spark itself drops samples older than the watermark.
    """
    if on_late not in ("mark", "drop"):
        raise ValueError("on_late is mark or drop")
    if delay < 0 or idle < 0:
        raise ValueError("delay and idle must not be negative")
    state.need_rocksdb(sdf)
    wait = datetime.timedelta(seconds=delay)
    kinds = StructType(list(sdf.schema.fields))
    processor = state.Reorder(kinds, _places(sdf, ts, ties), key, ts, ties, wait, on_late == "mark")
    output = StructType([*kinds.fields, *StructType.fromDDL("seq long, late boolean")])
    return sdf.withWatermark(ts, f"{int((delay + idle) * 1000)} milliseconds").groupBy(key).transformWithState(processor, output, "append", "EventTime")


def stream_windows(sdf: DataFrame, features: list[str], size: int, key: str = "stream_id", ties: tuple[str, ...] = (), reset: str | None = None) -> DataFrame:
    """Each full window of `size` samples as it completes: window_id, bounds and flat values."""

    def step(held: dict, row: Row) -> list[tuple]:
        rows = held["rows"] = held.get("rows") or []
        rows.append({"at": row["ts"], "values": [row[f] for f in features]})
        if len(rows) < size:
            return []
        made = (held["seq"] - size + 1, rows[0]["at"], row["ts"], [v for x in rows for v in x["values"]])
        del rows[0]
        return [made]

    kind = sdf.schema[key].dataType.simpleString()
    return _run(sdf, key, f"{key} {kind}, window_id long, window_start timestamp, window_end timestamp, flat array<double>", "rows array<struct<at: timestamp, values: array<double>>>", step, ties=ties, reset=reset)


#: The state's field for the runs of all channels, in their order.
_RUNS = "runs array<struct<value: double, n: long>>"


def _count_runs(held: dict, row: Row, channels: list[str]) -> dict[str, int]:
    """Take a sample into the state's runs of equal finite values; how long each channel's is now."""
    runs = held["runs"] = held.get("runs") or [{"value": None, "n": 0} for _ in channels]
    for k, c in enumerate(channels):
        value, before = None if row[c] is None else float(row[c]), runs[k]
        ok = value is not None and value == value and abs(value) != float("inf")
        runs[k] = {"value": value, "n": before["n"] + 1 if before["n"] and before["value"] == value else 1} if ok else {"value": None, "n": 0}
    return {c: run["n"] for c, run in zip(channels, runs, strict=True)}


def stream_health(sdf: DataFrame, channels: list[str], max_unchanged: int, key: str = "stream_id", ties: tuple[str, ...] = (), reset: str | None = None) -> DataFrame:
    """One verdict per sample: seq, healthy and the stuck channels in monitored order."""
    if max_unchanged < 2:
        raise ValueError("max_unchanged must be at least 2")

    def step(held: dict, row: Row) -> list[tuple]:
        stuck = [c for c, n in _count_runs(held, row, channels).items() if n >= max_unchanged]
        return [(held["seq"], row["ts"], not stuck, stuck)]

    kind = sdf.schema[key].dataType.simpleString()
    return _run(sdf, key, f"{key} {kind}, seq long, ts timestamp, healthy boolean, stuck array<string>", _RUNS, step, ties=ties, reset=reset)


def _seeds(alerts: DataFrame, key: str, category: str) -> DataFrame:
    """Per stream what stored alerts of a category leave: n (the highest number), seq (after the last version), _last (the last time said)."""
    has = set(alerts.columns)
    rows = alerts.filter((F.col("category") == category) if "category" in has else F.lit(True))
    later = [c for c in ("version", "end_seq") if c in has]
    # A table by J4's numbers may lack open_seq; the id has it.
    number = F.coalesce(*([F.col("open_seq").cast("long")] if "open_seq" in has else []), F.regexp_extract("alert_id", "-([0-9]+)-", 1).cast("long"))
    times = [F.col(c).cast("timestamp") for c in ("opened_at", "window_end", "closed_at") if c in has]
    at = F.greatest(*times) if len(times) > 1 else times[0]
    seq = F.coalesce(*(F.col(c).cast("long") + 1 for c in later), F.lit(0))
    return rows.withColumns({"_n": number, "_seq": seq, "_at": at})


def _text(alerts: DataFrame, c: str, kind: str = "string"):
    return (F.col(c) if c in alerts.columns else F.lit(None)).cast(kind)


def incident_seeds(alerts: DataFrame, key: str = "stream_id") -> DataFrame:
    """First states of stream_incidents from stored alerts: numbers go on behind all of them, and the newest open incident of each stream goes on."""
    rows = _seeds(alerts, key, ML)
    now = F.struct(F.col("alert_id").alias("id"), F.col("_n").alias("open_seq"), F.col("anomaly_count").cast("long").alias("count"), F.col("anomaly_score").cast("double").alias("peak"), _text(rows, "top_features").alias("top"), F.col("opened_at").cast("timestamp").alias("opened"), _text(rows, "window_end", "timestamp").alias("ended"))
    return rows.groupBy(key).agg(F.max("_n").alias("n"), F.max("_seq").alias("seq"), F.max("_at").alias("_last"), F.max_by(now, F.when(F.col("status") == "OPEN", F.col("_n"))).alias("open"))


def fault_seeds(alerts: DataFrame, key: str = "stream_id") -> DataFrame:
    """First states of stream_faults: numbers go on, and open faults close or go on with the first verdict. Runs of channels begin anew."""
    rows = _seeds(alerts, key, FAULT)
    now = F.struct("channel", F.col("alert_id").alias("id"), F.col("_n").alias("n"), F.col("anomaly_count").cast("long").alias("count"), _text(rows, "start_seq", "long").alias("start"), _text(rows, "end_seq", "long").alias("end"), F.regexp_extract(F.coalesce(_text(rows, "reason"), F.lit("")), "unchanged for ([0-9]+)", 1).try_cast("long").alias("unchanged"), F.col("opened_at").cast("timestamp").alias("opened"))
    newest = F.row_number().over(Window.partitionBy(key, "channel", "status").orderBy(F.desc("_n"))) == 1
    opened = F.when((F.col("status") == "OPEN") & F.col("_newest"), now)
    return rows.withColumn("_newest", newest).groupBy(key).agg(F.max("_n").alias("n"), F.max("_seq").alias("seq"), F.max("_at").alias("_last"), F.collect_list(opened).alias("faults"))


def stream_faults(sdf: DataFrame, channels: list[str], max_unchanged: int, key: str = "stream_id", ties: tuple[str, ...] = (), from_seq: int = 0, seed: DataFrame | None = None) -> DataFrame:
    """Changes of the incidents of stuck channels, one for each run, as incidents.fault_incidents has them; version orders the rows of an alert_id.

    Verdicts before from_seq open nothing. Numbers go on after a restart, beside those of stream_incidents. seed: stored alerts from which a fresh
    checkpoint goes on.
    """
    if max_unchanged < 2:
        raise ValueError("max_unchanged must be at least 2")

    def step(held: dict, row: Row) -> list[tuple]:
        at, out, open_ = row["ts"], [], {f["channel"]: f for f in held.get("faults") or []}
        for c, n in _count_runs(held, row, channels).items():
            now, closed = open_.get(c), None
            if n >= max_unchanged and held["seq"] >= from_seq:
                if now is None:
                    held["n"] = (held.get("n") or 0) + 1
                    now = open_[c] = {"channel": c, "id": f"tfault-{held['n']:04d}-{c}-{at:%Y-%m-%d %H:%M:%S}", "n": held["n"], "count": 0, "start": held["seq"], "opened": at}
                now |= {"count": now["count"] + 1, "end": held["seq"], "unchanged": n}
            elif now is None:
                continue
            else:
                closed = at
                del open_[c]
            out.append((now["id"], now["n"], FAULT, held["seq"], "CLOSED" if closed else "OPEN", "MEDIUM", c, now["count"], now["start"], now["end"], now["opened"], closed, f"{c} unchanged for {now['unchanged']} samples"))
        held["faults"] = list(open_.values())
        return out

    kind = sdf.schema[key].dataType.simpleString()
    output = f"{key} {kind}, alert_id string, open_seq long, category string, version long, status string, severity string, channel string, anomaly_count long, start_seq long, end_seq long, opened_at timestamp, closed_at timestamp, reason string"
    fault = "struct<channel: string, id: string, n: long, count: long, start: long, end: long, unchanged: long, opened: timestamp>"
    return _run(sdf, key, output, f"{_RUNS}, n long, faults array<{fault}>", step, ties=ties, seed=None if seed is None else fault_seeds(seed, key))


def stream_incidents(sdf: DataFrame, threshold: float, score: str = "score", key: str = "stream_id", ties: tuple[str, ...] = (), top: str | None = None, seed: DataFrame | None = None) -> DataFrame:
    """Changes of incidents: a row when one opens, grows or closes; version orders the rows of an alert_id.

    top: a column whose value at the highest window, the first on ties, is kept as top_features (JSON).
    Numbers go on after a restart, so ids never collide and an open incident is not opened twice. seed: stored alerts from which a fresh
    checkpoint goes on: numbers behind theirs, versions after theirs, and the incident that is open in them.
    """
    from plantlens.functions.cells import HIGH_RATIO, MEDIUM_RATIO

    def step(held: dict, row: Row) -> list[tuple]:
        value, at = row[score], row["ts"]
        hit = value is not None and value == value and value > threshold
        now = held.get("open")
        if hit and now is None:
            held["n"] = (held.get("n") or 0) + 1
            now = {"id": f"alert-{held['n']:04d}-{at:%Y-%m-%d %H:%M:%S}", "open_seq": held["n"], "count": 0, "peak": None, "top": None, "opened": at}
        if now is None:
            return []
        closed = None
        if hit:
            now |= {"count": now["count"] + 1, "ended": at}
            if now["peak"] is None or value > now["peak"]:
                now |= {"peak": float(value), "top": state.as_json(row[top]) if top else None}
            held["open"] = now
        else:
            closed = at
            held["open"] = None
        ratio = float("inf") if threshold <= 0 else now["peak"] / threshold
        level = "HIGH" if ratio >= HIGH_RATIO else "MEDIUM" if ratio >= MEDIUM_RATIO else "LOW"
        return [(now["id"], now["open_seq"], ML, held["seq"], "CLOSED" if closed else "OPEN", level, now["peak"], now["count"], now["opened"], now["ended"], closed, *([now["top"]] if top else []))]

    kind = sdf.schema[key].dataType.simpleString()
    output = f"{key} {kind}, alert_id string, open_seq long, category string, version long, status string, severity string, anomaly_score double, anomaly_count long, opened_at timestamp, window_end timestamp, closed_at timestamp" + (", top_features string" if top else "")
    held = "n long, open struct<id: string, open_seq: long, count: long, peak: double, top: string, opened: timestamp, ended: timestamp>"
    return _run(sdf, key, output, held, step, ties=ties, seed=None if seed is None else incident_seeds(seed, key))


def session_incidents(sdf: DataFrame, threshold: float, gap: str, score: str = "score", key: str = "stream_id", delay: str = "1 hour") -> DataFrame:
    """Incidents closed by a gap without anomalous samples, from session windows (no code with state of its own)."""
    from plantlens.functions.cells import over_threshold

    hits = sdf.filter(over_threshold(score, threshold)).withWatermark("ts", delay)
    made = hits.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("anomaly_count"), F.max(score).alias("anomaly_score"))
    return made.select(key, F.col("session_window.start").alias("opened_at"), F.col("session_window.end").alias("closed_at"), "anomaly_count", "anomaly_score")
