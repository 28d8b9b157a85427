"""Choosing thresholds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.operators.order import STREAM
from plantlens.operators.quantiles import exact_quantiles, from_counts
from plantlens.operators.segments import label_runs
from plantlens.functions.cells import over_threshold, ratio


def percentile_threshold(df: DataFrame, score: str, p: float, where: Column | None = None, approx: int | None = None) -> DataFrame:
    """One row, threshold: the p-th percentile (0 to 100, linear interpolation) of the scores, say of normal validation rows."""
    rows = df if where is None else df.filter(where)
    return rows.agg((F.percentile(score, p / 100) if approx is None else F.percentile_approx(score, p / 100, approx)).alias("threshold"))


def threshold_value(df: DataFrame, score: str, p: float, where: Column | None = None) -> float:
    """The same threshold as a number, however many distinct scores there are."""
    return exact_quantiles(df if where is None else df.filter(where), [score], [p / 100])[score][0]


def f1_grid(df: DataFrame, score: str = "score", n_grid: int = 200, stream: list[str] = STREAM, runs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Point-adjusted counts and F1 at n_grid quantiles (0.5 to 0.9995) of the scores.

    The quantiles are exact, by exact_quantiles. A positive segment counts whole once its highest score is over a threshold, so segment maxima and normal
    scores are enough: they are bucketed by the grid and summed from above, without a pass for each threshold. runs: adds run_id, the runs of equal
    labels, to a frame (by default by a window function over each stream; long_streams has another).
    """
    found = exact_quantiles(df, [score], _grid_shares(n_grid))[score]
    numbered = label_runs(df, "label", stream) if runs is None else runs(df)
    positive = numbered.filter("label = 1").groupBy(*stream, "run_id").agg(F.max(score).alias("v"), F.count("*").alias("pos")).select("v", "pos", F.lit(0).cast("long").alias("neg"))
    negative = numbered.filter("label = 0").select(F.col(score).alias("v"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("neg"))
    return _f1_at(positive.unionByName(negative), found)


def _grid_shares(n_grid: int) -> list[float]:
    return [0.5 + (0.9995 - 0.5) * k / (n_grid - 1) for k in range(n_grid)]


def _f1_at(both: DataFrame, thresholds: list[float | None]) -> DataFrame:
    """Counts and F1 at each threshold, from rows (v, pos, neg): a positive segment's highest score and rows, a number of normal rows of a score."""
    grid = F.array(*map(F.lit, sorted({x for x in thresholds if x is not None}))).cast("array<double>")
    level = F.size(F.filter(grid, lambda g: g < F.col("v")))  # thresholds 0 .. level - 1 are passed
    by_level = both.groupBy(level.alias("level")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    levels = by_level.agg(F.collect_list(F.struct("level", "pos", "neg")).alias("levels"), F.sum("pos").alias("all_pos"))
    above = lambda name, k: F.aggregate(F.filter("levels", lambda x: x["level"] > k), F.lit(0).cast("long"), lambda s, x: s + x[name])
    made = levels.select("levels", "all_pos", F.posexplode(grid).alias("k", "threshold"))
    made = made.select("threshold", "all_pos", above("pos", F.col("k")).alias("tp"), above("neg", F.col("k")).alias("fp"))
    made = made.withColumn("fn", F.col("all_pos") - F.col("tp"))
    return made.select("threshold", "tp", "fp", "fn", ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def best_f1(df: DataFrame, score: str = "score", n_grid: int = 200, stream: list[str] = STREAM, runs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The lowest threshold of the grid with the best point-adjusted F1."""
    return f1_grid(df, score, n_grid, stream, runs).orderBy(F.desc("f1"), "threshold").limit(1)


def segment_tops(df: DataFrame, score: str = "score", stream: list[str] = STREAM) -> DataFrame:
    """The highest scores of positive segments, with the segments' rows of label 1: at the highest of all (top) and at the highest that isn't NaN (best).

    As in metrics.point_adjust, rows without a label behind a positive one belong to its segment, but only `best` sees their scores.
    Rows are shuffled by stream, with their labels and scores only.
    """
    rows = df.select(*stream, "seq", "label", F.col(score).cast("double").alias("score"))
    one, zero = F.col("label") == 1, F.lit(0).cast("long")
    runs = label_runs(rows, "label", stream).filter("label = 1 or label is null").groupBy(*stream, "run_id")
    runs = runs.agg(F.max(F.when(one, F.col("score"))).alias("top"), F.max(F.when(~F.isnan("score"), F.col("score"))).alias("best"), F.count_if(one).alias("rows")).filter("rows > 0")
    return runs.select(F.inline(F.array(F.struct(F.col("top").alias("score"), F.col("rows").alias("top"), zero.alias("best")), F.struct(F.col("best").alias("score"), zero.alias("top"), F.col("rows").alias("best")))))


def score_counts(df: DataFrame, score: str = "score", stream: list[str] = STREAM, validation: DataFrame | None = None, tops: DataFrame | None = None) -> DataFrame:
    """All that thresholds and areas need of a labelled frame, a row for each distinct score: numbers of its rows (n), of those with label 1
    (pos), 0 (neg) and any but 1 (normal), of validation scores (val: those of `validation`, else of the rows of split val), and
    of the rows in positive segments that have it as their highest (top, best: as in segment_tops, whose rows are `tops` if they are known).
    """
    names = ("n", "pos", "neg", "normal", "val", "top", "best")
    hit = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    full = lambda c, **has: [F.col(c).cast("double").alias("score"), *(has.get(k, F.lit(0).cast("long")).alias(k) for k in names)]
    label, once = F.col("label"), F.lit(1).cast("long")
    held_out = {"val": hit(F.col("split") == "val")} if validation is None else {}
    parts = [df.select(*full(score, n=once, pos=hit(label == 1), neg=hit(label == 0), normal=hit(label != 1), **held_out))]
    if validation is not None:
        parts.append(validation.select(*full(score, val=once)))
    tops = segment_tops(df, score, stream) if tops is None else tops
    parts.append(tops.select(*full("score", top=F.col("top"), best=F.col("best"))))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("score").agg(*(F.sum(c).alias(c) for c in names))


def _counted(counts: DataFrame, column: str) -> DataFrame:
    return counts.filter(F.col("score").isNotNull() & (F.col(column) > 0)).select(F.lit(0).alias("c"), F.col("score").alias("v"), F.col(column).alias("n"))


def threshold_of_counts(counts: DataFrame, p: float, column: str = "val") -> float | None:
    """threshold_value of the scores that a column of score_counts counts."""
    return from_counts(_counted(counts, column), ["score"], [p / 100])["score"][0]


def f1_of_counts(counts: DataFrame, threshold: float | None) -> DataFrame:
    """One row, f1: point-adjusted, at a threshold."""
    over = over_threshold("score", threshold)
    of = lambda c, where=F.lit(True): F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    found = counts.agg(of("best", over).alias("tp"), of("normal", over).alias("fp"), of("pos").alias("positive"))
    return found.select(ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positive")).alias("f1"))


def best_f1_of_counts(counts: DataFrame, n_grid: int = 200) -> DataFrame:
    """best_f1 of a frame from its score_counts."""
    found = from_counts(_counted(counts, "n"), ["score"], _grid_shares(n_grid))["score"]
    both = counts.select(F.col("score").alias("v"), F.col("top").alias("pos"), "neg").filter("pos + neg > 0")
    return _f1_at(both, found).orderBy(F.desc("f1"), "threshold").limit(1)


def evaluate(df: DataFrame, score: str = "score", mode: str = "best_f1", p: float = 99.0, normal: Column | None = None, stream: list[str] = STREAM) -> DataFrame:
    """One row: mode, threshold, and point-adjusted counts, precision, recall and F1 there; f1_fixed is always that of the fixed percentile.

    mode "fixed" takes the p-th percentile of the normal rows' scores (of label 0, if not said), "best_f1" searches the grid.
    """
    from plantlens.operators.metrics import prf

    if mode not in ("best_f1", "fixed"):
        raise ValueError("mode is best_f1 or fixed")
    kept = df.select(*stream, "seq", "label", score, (F.col("label") == 0 if normal is None else normal).alias("_normal")).persist()
    try:  # what is returned is one row, so the frame is walked while it is held and no more
        fixed = threshold_value(kept, score, p, F.col("_normal"))
        chosen = fixed if mode == "fixed" else best_f1(kept, score, stream=stream).first()["threshold"]
        at = lambda t: prf(kept.withColumn("pred", over_threshold(score, t).cast("int")), point_adjusted=True, stream=stream).first()
        best = at(chosen)
        row = (mode, chosen, *(best[c] for c in ("tp", "fp", "fn", "tn", "precision", "recall", "f1")), best["f1"] if mode == "fixed" else at(fixed)["f1"])
    finally:
        kept.unpersist()
    return df.sparkSession.createDataFrame([row], "mode string, threshold double, tp long, fp long, fn long, tn long, precision double, recall double, f1 double, f1_fixed double")


def fp_sweep(runs: DataFrame, grid: list[int], run: str = "run_length") -> DataFrame:
    """Per threshold: features triggered by a run of at least that length, and the share of rows that trigger.

    One aggregate by channel has the longest run and the counts of all thresholds; channels are added up from it.
    """
    counts = [F.count_if(F.col(run) >= t).alias(f"fp{k}") for k, t in enumerate(grid)]
    by_channel = runs.groupBy("channel").agg(F.max(run).alias("longest"), F.count("*").alias("n"), *counts)
    rows = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("longest") >= t).alias("triggered"), F.sum(f"fp{k}").alias("fp")) for k, t in enumerate(grid)]
    return by_channel.agg(F.array(*rows).alias("rows"), F.sum("n").alias("n")).select("n", F.inline("rows")).select("threshold", "triggered", "fp", (F.col("fp") / F.col("n")).alias("fp_rate"))
