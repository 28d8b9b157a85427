"""Detection metrics under explicit protocols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.cells import over_threshold, ratio
from plantlens.operators.order import STREAM, by_stream
from plantlens.operators.segments import label_runs, with_run


def confusion(df: DataFrame, truth: str = "label", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and false-positive rate; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2.0 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn),
        "predicted_positives": tp + fp, "actual_positives": tp + fn,
    })


def point_adjust(df: DataFrame, truth: str = "label", pred: str = "pred", stream: list[str] = STREAM, out: str = "adjusted") -> DataFrame:
    """A true run counts as predicted whole if any of its rows is; other rows keep their prediction."""
    changed = F.coalesce(F.lag(truth).over(by_stream(stream)), F.lit(-1)) != F.col(truth)
    runs = with_run(df, changed, stream, "_run")
    hit = F.max(pred).over(Window.partitionBy(*stream, "_run"))
    return runs.withColumn(out, F.when(F.col(truth) == 1, hit).otherwise(F.col(pred))).drop("_run")


def prf(df: DataFrame, truth: str = "label", pred: str = "pred", point_adjusted: bool = False, by: list[str] = (), stream: list[str] = STREAM) -> DataFrame:
    if point_adjusted:
        df, pred = point_adjust(df, truth, pred, stream), "adjusted"
    return with_rates(confusion(df, truth, pred, by)).withColumn("point_adjusted", F.lit(point_adjusted))


def score_metrics(df: DataFrame, score: str, threshold: float, truth: str = "label", point_adjusted: bool = False) -> DataFrame:
    return prf(df.withColumn("pred", over_threshold(score, threshold).cast("int")), truth, "pred", point_adjusted)


def curve(df: DataFrame, score: str = "score", truth: str = "label", buckets: int = 64, by: list[str] = ()) -> DataFrame:
    """Per distinct score (of each key in `by`), from the highest: tp and fp at "score or higher", with totals.

    Scores are aggregated first; prefix sums then run inside ranges between approximate quantiles (literals, so
    every evaluation cuts alike) with the sums of the ranges before, so distinct scores of any number never
    meet in one task. Keys are branches, models or datasets: a row of cuts for each reaches the driver.
    """
    by = list(by)
    by_score = df.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    return curve_of_counts(by_score, df.select(*by, F.col(score).alias("score")), buckets, by)


def curve_of_counts(by_score: DataFrame, scores: DataFrame, buckets: int = 64, by: list[str] = ()) -> DataFrame:
    """The same from a row (by..., score, pos, neg) for each distinct score; the ranges come from quantiles of the column score of `scores`."""
    by = list(by)
    found = scores.groupBy(*by).agg(F.percentile_approx("score", [k / buckets for k in range(1, buckets)], 1000).alias("cuts"))
    cuts = [(*(r[c] for c in by), sorted({float(x) for x in r["cuts"] or []})) for r in found.collect()]
    kinds = [f"{c} {by_score.schema[c].dataType.simpleString()}" for c in by]
    if by:
        held = by_score.sparkSession.createDataFrame(cuts, ", ".join([*kinds, "_cuts array<double>"]))
        same = [by_score[c].eqNullSafe(held[c]) for c in by]
        parts = by_score.join(F.broadcast(held), same).select(*(by_score[c] for c in by_score.columns), "_cuts")  # a row for each key
    else:
        parts = by_score.withColumn("_cuts", F.array(*map(F.lit, cuts[0][-1] if cuts else [])).cast("array<double>"))
    # No score comes after all scores, wherever the cuts are, as in the order of a part.
    parts = parts.withColumn("_part", F.when(F.col("score").isNull(), F.size("_cuts")).otherwise(F.size(F.filter("_cuts", lambda c: c >= F.col("score"))))).drop("_cuts")
    sums = parts.groupBy(*by, "_part").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sums = sums.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_part").alias("_k_part"), *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("_pos", "_neg")), *(F.sum(c).over(Window.partitionBy(*by)).alias(f"all{c}") for c in ("_pos", "_neg")))
    w = Window.partitionBy(*by, "_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    met = F.col("_part") == F.col("_k_part")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    made = parts.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)}).join(sums, met)
    return made.select(*by, "score", "pos", "neg", (F.col("tp") + F.col("_pos_before")).alias("tp"), (F.col("fp") + F.col("_neg_before")).alias("fp"), F.col("all_pos").alias("all_pos"), F.col("all_neg").alias("all_neg"))


def roc_curve(df: DataFrame, score: str = "score", truth: str = "label") -> DataFrame:
    return curve(df, score, truth).select(F.col("score").alias("threshold"), F.try_divide("fp", "all_neg").alias("fpr"), F.try_divide("tp", "all_pos").alias("tpr"))


def pr_curve(df: DataFrame, score: str = "score", truth: str = "label") -> DataFrame:
    return curve(df, score, truth).select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "all_pos").alias("recall"))


def auc(df: DataFrame, score: str = "score", truth: str = "label", by: list[str] = ()) -> DataFrame:
    """roc_auc (ties count half) and average_precision (step-wise) of each key; null if a class is missing."""
    return areas(curve(df, score, truth, by=by), by)


def areas(c: DataFrame, by: list[str] = ()) -> DataFrame:
    """roc_auc and average_precision of curves, as in auc."""
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    area = F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + 0.5 * F.col("pos") * F.col("neg")), F.max("all_pos").cast("double") * F.max("all_neg"))
    steps = F.try_divide(F.sum(F.col("pos") * F.try_divide("tp", F.col("tp") + F.col("fp"))), F.max("all_pos"))
    return c.groupBy(*by).agg(F.when(both, area).alias("roc_auc"), F.when(both, steps).alias("average_precision"))


def recall_by_kind(df: DataFrame, kinds: DataFrame, kind: str = "kind", pred: str = "pred") -> DataFrame:
    """Recall of each listed kind; null for a kind without rows."""
    return kinds.join(df.groupBy(kind).agg(F.avg(pred).alias("recall"), F.count("*").alias("n")), kind, "left").select(kind, "recall", F.coalesce("n", F.lit(0)).alias("n"))


def protocol_ladder(scored: DataFrame, stream: list[str] = STREAM, published: float | None = None, tolerance: float = 0.05) -> DataFrame:
    """F1 of one scored frame (label_any, label_last, pred) under three protocols, and a control if a value is published.

    The frame is walked once: both labels' runs share one order, and one aggregate counts for all protocols.
    """
    w = by_stream(stream)
    runs = scored.select(*stream, "seq", "label_any", "label_last", "pred")
    for c in ("label_any", "label_last"):
        runs = runs.withColumn(f"_new_{c}", (F.coalesce(F.lag(c).over(w), F.lit(-1)) != F.col(c)).cast("int"))
    for c in ("label_any", "label_last"):
        runs = runs.withColumn(f"_run_{c}", F.sum(f"_new_{c}").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    for c in ("label_any", "label_last"):
        hit = F.max("pred").over(Window.partitionBy(*stream, f"_run_{c}"))
        runs = runs.withColumn(f"_adjusted_{c}", F.when(F.col(c) == 1, hit).otherwise(F.col("pred")))
    kinds = [("any_adjusted", "label_any", "_adjusted_label_any"), ("last_adjusted", "label_last", "_adjusted_label_last"), ("last_pointwise", "label_last", "pred")]
    cells = []
    for name, truth, pred in kinds:
        t, p = F.col(truth) == 1, F.col(pred) == 1
        counts = {"tp": t & p, "fp": ~t & p, "fn": t & ~p, "tn": ~t & ~p}
        cells.append(F.struct(F.lit(name).alias("protocol"), *(F.count_if(v).alias(k) for k, v in counts.items())))
    return ladder_rates(runs.agg(F.array(*cells).alias("rows")).select(F.inline("rows")), published, tolerance)


def ladder_rates(counts: DataFrame, published: float | None = None, tolerance: float = 0.05) -> DataFrame:
    """Rates of counted rungs, and the control of the first one against a published F1."""
    out = with_rates(counts).select("protocol", "tp", "fp", "fn", "tn", "precision", "recall", "f1")
    if published is not None:
        out = out.withColumn("control_ok", (F.col("protocol") != "any_adjusted") | (F.abs(F.col("f1") - published) <= tolerance))
    return out


def leaderboard(results: DataFrame, metric: str = "average_precision") -> DataFrame:
    return results.orderBy(F.desc(metric), "model")


def compare(results: DataFrame, datasets: list[str], metric: str = "average_precision") -> DataFrame:
    return results.groupBy("model").pivot("dataset", datasets).agg(F.first(metric))


def robustness(results: DataFrame, metric: str = "average_precision") -> DataFrame:
    return results.groupBy("model").agg(F.round(F.avg(metric), 3).alias("mean"), F.round(F.stddev_samp(metric), 3).alias("std"))


def run_summary(df: DataFrame, pred: str = "pred", truth: str = "label") -> DataFrame:
    p, t = F.col(pred) == 1, F.col(truth) == 1
    made = df.agg(F.count("*").alias("total"), F.count_if(p).alias("anomalous"), F.count_if(t).alias("attack"), F.count_if(p & t).alias("detected"), F.count_if(p & ~t).alias("false_positives"))
    return made.withColumns({"recall": ratio(F.col("detected"), F.col("attack")), "fpr": ratio(F.col("false_positives"), F.col("total") - F.col("attack"))})


def running_recall(df: DataFrame, every: int, pred: str = "pred", truth: str = "label", stream: list[str] = STREAM) -> DataFrame:
    w = by_stream(stream).rowsBetween(Window.unboundedPreceding, 0)
    t, p = F.col(truth) == 1, F.col(pred) == 1
    made = df.select(*stream, "seq", F.sum(t.cast("int")).over(w).alias("attack"), F.sum((t & p).cast("int")).over(w).alias("detected"))
    return made.filter((F.col("seq") + 1) % every == 0).withColumn("recall", ratio(F.col("detected"), F.col("attack")))


def transitions(df: DataFrame, pred: str = "pred", stream: list[str] = STREAM) -> DataFrame:
    """Rows at which the state changes: onset or recovery (streams begin normal)."""
    before = F.coalesce(F.lag(pred).over(by_stream(stream)), F.lit(0))
    made = df.withColumn("_before", before).filter(F.col("_before") != F.col(pred))
    return made.select(*stream, "seq", "ts", F.when(F.col(pred) == 1, "onset").otherwise("recovery").alias("transition"))


def segment_recall(df: DataFrame, truth: str = "label", pred: str = "pred", stream: list[str] = STREAM, runs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Segments of true rows, how many of them have a predicted row, and their share. runs: as in thresholds.f1_grid."""
    numbered = label_runs(df, truth, stream) if runs is None else runs(df)
    hits = numbered.filter(F.col(truth) == 1).groupBy(*stream, "run_id").agg(F.max(pred).alias("hit"))
    return hits.agg(F.count("*").alias("segments"), F.sum("hit").alias("detected")).withColumn("segment_recall", ratio(F.col("detected"), F.col("segments")))
