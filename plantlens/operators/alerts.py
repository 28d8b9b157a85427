"""The alert table: upserts, reads and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantlens.operators.order import STREAM


def upsert_alerts(existing: DataFrame, delta: DataFrame, version: str = "version", key: list[str] = ("stream_id", "alert_id")) -> DataFrame:
    """The newest version of each alert; the order in which alerts were first opened is kept (least open_seq)."""
    whole = existing.unionByName(delta, allowMissingColumns=True)
    latest = whole.groupBy(*key).agg(F.max_by(F.struct(*(c for c in whole.columns if c not in key)), version).alias("_a"), F.min("open_seq").alias("_open"))
    return latest.select(*key, "_a.*", "_open").withColumn("open_seq", F.col("_open")).drop("_open")


def read_json_alerts(lines: DataFrame, schema: StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Readable alerts, and the raw rows that aren't (skipped, not fatal)."""
    parsed = lines.withColumn("_a", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    ok = F.col("_a").isNotNull() & F.coalesce(F.col("_a.alert_id").isNotNull(), F.lit(False))
    return parsed.filter(ok).select("_a.*"), parsed.filter(~ok).select(column)


def query_alerts(alerts: DataFrame, category: str | None = None, status: str | None = None, limit: int | None = None, stream: list[str] = STREAM) -> DataFrame:
    """By category and status in opening order; a negative limit counts as 0."""
    if category is not None:
        alerts = alerts.filter(F.col("category") == category)
    if status is not None:
        alerts = alerts.filter(F.col("status") == status)
    alerts = alerts.orderBy("opened_at", *stream, "open_seq", "alert_id")
    return alerts if limit is None else alerts.limit(max(0, limit))


def list_alerts(alerts: DataFrame, category: str | None = None, status: str | None = None, limit: int = 50, stream: list[str] = STREAM) -> DataFrame:
    """Most recent first; filters ignore case."""
    for c, v in (("category", category), ("status", status)):
        if v is not None:
            alerts = alerts.filter(F.upper(c) == v.upper())
    return alerts.orderBy(F.desc("opened_at"), *stream, F.desc("open_seq"), "alert_id").limit(max(0, limit))


def active(alerts: DataFrame) -> DataFrame:
    return alerts.filter("status = 'OPEN'")


def status(scores: DataFrame, alerts: DataFrame, stream: list[str] = STREAM, score: str = "score", pred: str = "pred") -> DataFrame:
    """Per stream the last score and decision, and counts of alerts."""
    last = scores.groupBy(*stream).agg(F.max_by(F.struct(F.col(score).alias("last_score"), F.col(pred).alias("last_pred"), F.col("ts").alias("last_ts")), "seq").alias("l")).select(*stream, "l.*")
    is_open, fault = F.col("status") == "OPEN", F.col("category") == "TELEMETRY_FAULT"
    counts = alerts.groupBy(*stream).agg(F.count("*").alias("total_alerts"), F.count_if(is_open & ~fault).alias("active_alerts"), F.count_if(is_open & fault).alias("active_faults"))
    return last.join(counts, stream, "left").fillna(0, ["total_alerts", "active_alerts", "active_faults"])
