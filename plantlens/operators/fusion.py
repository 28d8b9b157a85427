"""Modalities joined by time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.cells import over_threshold
from plantlens.operators import metrics
from plantlens.operators.quantiles import exact_quantiles


def align_modalities(a: DataFrame, b: DataFrame, unit: str = "second", ts: str = "ts") -> DataFrame:
    """Inner join of two frames on the time floored to the unit."""
    return a.withColumn(ts, F.date_trunc(unit, ts)).join(b.withColumn(ts, F.date_trunc(unit, ts)), ts)


def interval_features(events: DataFrame, unit: str = "hour", seconds: int = 3600, size: str = "value", src: str = "user_id", dst: str = "event_type", ts: str = "ts", ties: tuple[str, ...] = ("event_id",), port: str | None = None, ics_ports: tuple = ()) -> DataFrame:
    """Traffic features of each interval; inter-arrival times are those inside the interval (null below two rows).

    With a column `port` of destination ports also n_dst_ports and the packets to and not to one of `ics_ports` (n_ics, n_other;
    a null port is no control port).
    """
    at = events.withColumn("interval", F.date_trunc(unit, ts))
    order = Window.partitionBy("interval").orderBy(ts, *ties)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))) / 1e6
    made = at.withColumn("_gap", gap).groupBy("interval")
    ics = F.coalesce(F.col(port).isin(*ics_ports), F.lit(False)) if port else None
    ports = [F.countDistinct(port).alias("n_dst_ports"), F.count_if(ics).alias("n_ics"), F.count_if(~ics).alias("n_other")] if port else []
    return made.agg(
        F.count("*").alias("pkt_count"), F.sum(size).alias("byte_count"), (F.count("*") / F.lit(seconds)).alias("pkt_rate"), F.avg("_gap").alias("mean_iat"), F.stddev_pop("_gap").alias("std_iat"),
        F.countDistinct(src).alias("n_src"), F.countDistinct(dst).alias("n_dst"), F.countDistinct(src, dst).alias("n_conn"), *ports,
    )


def asof_attach(left: DataFrame, right: DataFrame, columns: list[str], ts: str = "ts", stream: list[str] = (), ties: list[str] = ()) -> DataFrame:
    """For each left row the right columns of the latest row at or before it (union and last non-null; no range join).

    Without a stream the right frame decides: its rows are dealt by day with the last row of each day before
    carried over, so that no task gets the whole frame.
    """
    day = F.date_trunc("day", F.col(ts))
    packed = F.struct(*columns)
    values = right.select(*stream, F.col(ts), packed.alias("_v"))
    # The value in force at each day's begin, for every day that has left rows.
    last = values.groupBy(*stream, day.alias("_d")).agg(F.max(F.struct(F.col(ts), F.col("_v"))).alias("_l"))
    days = left.select(*stream, day.alias("_d")).distinct().unionByName(last.select(*stream, "_d")).distinct()
    before = Window.partitionBy(*stream).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.join(last, [*stream, "_d"], "left").withColumn("_c", F.last("_l", ignorenulls=True).over(before)).select(*stream, "_d", F.col("_c._v").alias("_before"))
    both = left.withColumns({"_side": F.lit(1), "_d": day}).unionByName(values.withColumns({"_side": F.lit(0), "_d": day}), allowMissingColumns=True)
    w = Window.partitionBy(*stream, "_d").orderBy(ts, "_side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_v", F.last(F.when(F.col("_side") == 0, F.col("_v")), ignorenulls=True).over(w)).filter("_side = 1")
    both = both.join(carried, [*stream, "_d"], "left")
    value = F.coalesce("_v", "_before")
    return both.select(*left.columns, *(value[c].alias(c) for c in columns))


def branch_evaluation(df: DataFrame, branches: dict[str, str], validation: Column, percentile: float = 93.0, truth: str = "label", kind: str | None = None, kinds: list[str] = (), fused: str = "fused") -> DataFrame:
    """One row for each branch (name: column of its scores) and one for their fusion.

    A branch decides by its own threshold, the percentile of its scores on `validation` rows. The fusion's decision is that any
    branch decides so; its score, for roc_auc and average_precision, is the greatest of the branches' z-scores by the validation rows. Rows have threshold
    (null for the fusion), counts, precision, recall, f1 and fpr, both areas, and recall_<kind> for each of `kinds` (null without rows of it).

    All branches are evaluated together: one aggregate counts decisions, one curve by branch has the areas.
    """
    ref = df.filter(validation)
    limits = exact_quantiles(ref, list(branches.values()), [percentile / 100])
    if missing := [n for n, c in branches.items() if limits[c][0] is None]:
        raise ValueError(f"no validation score of {missing}")
    row = ref.agg(*(f(c).alias(f"{n}{k}") for k, c in enumerate(branches.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    z = [(F.col(c) - F.lit(float(row[f"m{k}"]))) / F.lit(float(row[f"s{k}"]) + 1e-8) for k, c in enumerate(branches.values())]
    decided = {n: over_threshold(c, limits[c][0]) for n, c in branches.items()}
    entry = lambda name, limit, score, pred: F.struct(F.lit(name).alias("branch"), F.lit(limit).cast("double").alias("threshold"), score.cast("double").alias("_score"), pred.cast("int").alias("_pred"))
    entries = [entry(n, limits[c][0], F.col(c), decided[n]) for n, c in branches.items()]
    entries.append(entry(fused, None, F.greatest(*z) if len(z) > 1 else z[0], reduce(lambda a, b: a | b, decided.values())))
    kept = [F.col(truth).alias("_truth"), *([F.col(kind).alias("_kind")] if kind else [])]
    long = df.select(*kept, F.inline(F.array(*entries)))
    t, p = F.col("_truth") == 1, F.col("_pred") == 1
    counts = [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]
    found = [F.avg(F.when(F.col("_kind") == k, F.col("_pred"))).alias(f"recall_{k}") for k in kinds]
    rates = metrics.with_rates(long.groupBy("branch").agg(F.max("threshold").alias("threshold"), *counts, *found))
    return rates.join(F.broadcast(metrics.auc(long, "_score", "_truth", by=["branch"])), "branch")  # a row for each branch
