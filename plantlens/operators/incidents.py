"""Incidents: consecutive anomalous windows and stuck channels folded into deduplicated alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.cells import over_threshold, severity
from plantlens.operators.order import STREAM, by_stream

#: Fixed values of the alert records.
OPEN, CLOSED = "OPEN", "CLOSED"
ML, FAULT = "PROCESS_ANOMALY", "TELEMETRY_FAULT"
LEVELS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}


def _id(prefix: str, seq: Column, *parts: Column) -> Column:
    shown = [F.coalesce(p.cast("string"), F.lit("na")) for p in parts]
    return F.concat_ws("-", F.lit(prefix), F.format_string("%04d", seq), *shown)


def flagged(scores: DataFrame, threshold: float, score: str, stream: list[str], start: str, end: str, top: str | None) -> DataFrame:
    """Scored windows in the columns that incidents are made of, with _hit."""
    return scores.select(*stream, "seq", F.col(score).alias("_score"), F.col(start).alias("_start"), F.col(end).alias("_end"), *([F.col(top).alias("_top")] if top else []), over_threshold(score, threshold).alias("_hit"))


def peaks(hits: DataFrame, by: list[str], top: bool, *more: Column) -> DataFrame:
    """One row per run of anomalous windows with its count, bounds and highest window, the first on ties."""
    return hits.groupBy(*by).agg(
        F.count("*").alias("anomaly_count"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.max_by(F.struct("_score", *(["_top"] if top else [])), F.struct("_score", -F.col("seq"))).alias("_peak"),
        F.min_by(F.coalesce("_end", "_start"), "seq").alias("opened_at"), F.min_by("_start", "seq").alias("window_start"), F.max_by("_end", "seq").alias("window_end"), F.min_by("_end", "seq").alias("_first_end"), *more,
    )


def records(made: DataFrame, threshold: float, stream: list[str], top: bool) -> DataFrame:
    """Incident records of numbered runs; _after: a struct with the time of the window after the run, null if there is none.

    An incident is closed once any window follows its run; if that window has no time, closed_at is the run's last end.
    """
    made = made.withColumn("closed_at", F.when(F.col("_after").isNotNull(), F.coalesce("_after.at", "window_end")))
    return made.select(
        *stream, _id("alert", F.col("open_seq"), F.date_format("_first_end", "yyyy-MM-dd HH:mm:ss")).alias("alert_id"), "open_seq", F.lit(ML).alias("category"),
        F.when(F.col("_after").isNull(), OPEN).otherwise(CLOSED).alias("status"), severity("_peak._score", threshold).alias("severity"), F.col("_peak._score").alias("anomaly_score"),
        F.lit(threshold).alias("threshold"), "anomaly_count", "start_seq", "end_seq", "opened_at", "window_start", "window_end", "closed_at", *([F.col("_peak._top").alias("top_features")] if top else []),
    )


def incidents(scores: DataFrame, threshold: float, score: str = "score", stream: list[str] = STREAM, start: str = "ts", end: str = "ts", top: str | None = None) -> DataFrame:
    """One row per run of anomalous windows: opened at the first, closed at the first normal one after it.

    Peak score (and the top features there) are of the highest window, the first on ties. All window functions
    and the aggregate share one exchange by stream.
    """
    rows, w = flagged(scores, threshold, score, stream, start, end, top), by_stream(stream)
    rows = rows.withColumn("_new", F.col("_hit") & ~F.coalesce(F.lag("_hit").over(w), F.lit(False)))
    rows = rows.withColumns({"open_seq": F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead(F.struct(F.coalesce("_end", "_start").alias("at"))).over(w)})
    return records(peaks(rows.filter("_hit"), [*stream, "open_seq"], bool(top), F.max_by("_next", "seq").alias("_after")), threshold, stream, bool(top))


def fault_runs(stuck: DataFrame, verdicts: DataFrame, stream: list[str], from_seq: int) -> DataFrame:
    """One row per run of verdicts in which a channel is stuck, with _after as in records.

    run_length grows by one from row to row of a run and starts anew after it, so seq - run_length tells the runs apart.
    """
    runs = stuck.filter(F.col("seq") >= from_seq).withColumn("_run", F.col("seq") - F.col("run_length"))
    made = runs.groupBy(*stream, "channel", "pos", "_run").agg(
        F.count("*").alias("anomaly_count"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.min("ts").alias("opened_at"), F.max("ts").alias("last_at"), F.max("run_length").alias("unchanged_samples")
    ).drop("_run")
    after = verdicts.select(*stream, (F.col("seq") - 1).alias("end_seq"), F.struct(F.col("ts").alias("at")).alias("_after"))
    return made.join(after, [*stream, "end_seq"], "left")


def fault_records(made: DataFrame, stream: list[str]) -> DataFrame:
    made = made.withColumn("closed_at", F.when(F.col("_after").isNotNull(), F.coalesce("_after.at", "last_at")))
    text = F.concat(F.col("channel"), F.lit(" unchanged for "), F.col("unchanged_samples").cast("string"), F.lit(" samples"))
    return made.select(
        *stream, _id("tfault", F.col("open_seq"), F.col("channel"), F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss")).alias("alert_id"), "open_seq", F.lit(FAULT).alias("category"),
        F.when(F.col("_after").isNull(), OPEN).otherwise(CLOSED).alias("status"), F.lit("MEDIUM").alias("severity"), "channel", "anomaly_count", "start_seq", "end_seq", "opened_at", "closed_at", text.alias("reason"),
    )


def fault_incidents(stuck: DataFrame, verdicts: DataFrame, stream: list[str] = STREAM, from_seq: int = 0) -> DataFrame:
    """One incident per run of verdicts in which a channel is stuck; stuck: rows (stream, seq, ts, channel, pos, run_length).

    verdicts: (stream, seq, ts) of all verdicts, for the time of closing. from_seq: verdicts before it (while
    windows fill) never reach the alert track.
    """
    made = fault_runs(stuck, verdicts, stream, from_seq)
    return fault_records(made.withColumn("open_seq", F.row_number().over(Window.partitionBy(*stream).orderBy("start_seq", "pos"))), stream)


def validate_health(verdicts: DataFrame, quarantine: bool = False):
    """Verdicts must be healthy exactly without stuck channels, whose entries are named, counted and distinct."""
    stuck = F.col("stuck_channels")
    named = F.forall(stuck, lambda s: s["feature"].isNotNull() & (F.length(s["feature"]) > 0) & (s["unchanged_samples"] >= 1))
    distinct = F.size(F.array_distinct(F.transform(stuck, lambda s: s["feature"]))) == F.size(stuck)
    ok = F.coalesce((F.col("healthy") == (F.size(stuck) == 0)) & named & distinct, F.lit(False))
    if quarantine:
        return verdicts.filter(ok), verdicts.filter(~ok)
    return verdicts.withColumn("healthy", F.when(ok, F.col("healthy")).otherwise(F.raise_error(F.lit("invalid health verdict")).cast("boolean")))


def alert_history(ml: DataFrame, faults: DataFrame, stream: list[str] = STREAM) -> DataFrame:
    """Both tracks in one history, numbered by opening time, anomalies first, then number."""
    whole = ml.unionByName(faults, allowMissingColumns=True)
    order = Window.partitionBy(*stream).orderBy("opened_at", F.when(F.col("category") == ML, 0).otherwise(1), "open_seq")
    return whole.withColumn("history_seq", F.row_number().over(order))


def notifications(alerts: DataFrame, least: str = "LOW", stream: list[str] = STREAM) -> DataFrame:
    """One row for each newly opened anomaly incident of enough severity, with subject and body."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), F.col("severity"))
    subject = F.format_string("[%s] anomaly %s", "severity", "alert_id")
    body = F.concat_ws("\n", F.concat(F.lit("severity: "), "severity"), F.concat(F.lit("opened: "), F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss")), F.concat(F.lit("windows: "), F.col("anomaly_count").cast("string")))
    return alerts.filter((F.col("category") == ML) & (rank >= LEVELS[least])).select(*stream, "alert_id", subject.alias("subject"), body.alias("body"))


def to_json_rows(alerts: DataFrame) -> DataFrame:
    return alerts.select("alert_id", F.to_json(F.struct("*")).alias("payload"))
