"""Stuck channels: runs of equal finite values in long frames (stream, seq, ts, channel, pos, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.cells import classify_channel, is_finite
from plantlens.operators.order import STREAM

#: Fixed value: the type of fault that a verdict names.
FAULT_TYPE = "TELEMETRY_FAULT"


def long_frame(df: DataFrame, channels: list[str], keep: list[str] = ("stream_id", "seq", "ts", "label")) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.lit(k).alias("pos"), F.col(c).alias("value")) for k, c in enumerate(channels))))
    return df.select(*keep, cells.alias("c")).select(*keep, "c.*")


def monitored(channels: list[str], chosen: list[str] | None = None) -> list[str]:
    """The channels to watch: the continuous ones, or a validated list."""
    import re

    from plantlens.functions.cells import CONTINUOUS

    if chosen is None:
        found = [c for c in channels if re.match("[A-Za-z]*", c)[0] in CONTINUOUS]
        if not found:
            raise ValueError("no continuous channel to monitor")
        return found
    if not chosen:
        raise ValueError("an empty list of channels")
    if len(set(chosen)) < len(chosen):
        raise ValueError("a channel is listed twice")
    if unknown := [c for c in chosen if c not in channels]:
        raise ValueError(f"unknown channels: {unknown}")
    return [c for c in channels if c in chosen]


def unchanged_runs(long: DataFrame, stream: list[str] = STREAM) -> DataFrame:
    """run_length: how many rows up to here had this very value; 0 at a value that isn't finite, which breaks runs."""
    order = Window.partitionBy(*stream, "channel").orderBy("seq")
    ok = is_finite("value")
    same = ok & F.coalesce(F.lag(ok).over(order), F.lit(False)) & F.coalesce(F.lag("value").over(order) == F.col("value"), F.lit(False))
    made = long.withColumn("_run", F.sum((~same).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*stream, "channel", "_run").orderBy("seq")
    return made.withColumn("run_length", F.when(ok, F.row_number().over(within)).otherwise(0).cast("long")).drop("_run")


def stuck_channels(runs: DataFrame, max_unchanged: int = 2880, interval: float | None = None) -> DataFrame:
    """Rows at which a channel is stuck, with staleness in seconds (null without an interval)."""
    if max_unchanged < 2:
        raise ValueError("max_unchanged must be at least 2")
    staleness = ((F.col("run_length") - 1) * interval) if interval is not None else F.lit(None)
    return runs.filter(F.col("run_length") >= max_unchanged).withColumn("staleness_seconds", staleness.cast("double"))


def health(runs: DataFrame, max_unchanged: int = 2880, interval: float | None = None, stream: list[str] = STREAM) -> DataFrame:
    """One verdict per sample with the stuck channels in monitored order."""
    if max_unchanged < 2:
        raise ValueError("max_unchanged must be at least 2")
    staleness = ((F.col("run_length") - 1) * interval) if interval is not None else F.lit(None)
    entry = F.struct("pos", F.col("channel").alias("feature"), F.col("run_length").alias("unchanged_samples"), staleness.cast("double").alias("staleness_seconds"), F.col("value").alias("last_value"))
    stuck = F.array_sort(F.collect_list(F.when(F.col("run_length") >= max_unchanged, entry)))
    made = runs.groupBy(*stream, "seq", "ts").agg(stuck.alias("stuck_channels"))
    n = F.size("stuck_channels")
    text = F.concat_ws("; ", F.transform("stuck_channels", lambda s: F.concat(s["feature"], F.lit(" unchanged for "), s["unchanged_samples"].cast("string"), F.lit(" samples"))))
    return made.withColumns({"n_seen": F.col("seq") + 1, "healthy": n == 0, "fault_type": F.when(n > 0, FAULT_TYPE), "reason": F.when(n > 0, text)})


def health_payload(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumn("payload", F.to_json(F.struct("healthy", "n_seen", "fault_type", "reason", "stuck_channels")))


def attach_health(scores: DataFrame, verdicts: DataFrame, stream: list[str] = STREAM) -> DataFrame:
    """Each score row with the verdict on its last sample; score columns stay as they are."""
    return scores.join(verdicts.select(*stream, "seq", "healthy", "fault_type", "stuck_channels"), [*stream, "seq"], "left")


def longest_constant_run(runs: DataFrame) -> DataFrame:
    """Per class of channel and channel the longest run of one value."""
    return runs.groupBy(classify_channel("channel").alias("kind"), "channel").agg(F.max("run_length").alias("longest"))
