"""Splits and population scalers.

Parameters are frames of one row per feature (bounded by the contract); they are collected as literals, so
transforms are plain projections inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.operators.order import STREAM, by_stream
from plantlens.operators.profile import wide_aggregate
from plantlens.operators.quantiles import exact_quantiles


def temporal_split(df: DataFrame, frac: float, stream: list[str] = STREAM, label: str = "label") -> DataFrame:
    """Column split: val for the last int(n * frac) normal rows of a stream, train for earlier ones, else null."""
    normal = (F.col(label) == 0).cast("int")
    w = by_stream(stream)
    df = df.withColumn("_rank", F.sum(normal).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum(normal).over(Window.partitionBy(*stream)))
    split = F.when(normal == 1, F.when(F.col("_rank") > F.col("_n") - F.floor(F.col("_n") * frac), "val").otherwise("train"))
    return df.withColumn("split", split).drop("_rank", "_n")


def fit_standard(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population deviation; a deviation of 0 scales by 1."""
    made = wide_aggregate(df, features, mean=F.avg, std=F.stddev_pop)
    return made.withColumn("scale", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def enrich_standard(df: DataFrame, params: DataFrame, features: list[str], by: list[str], precision: str = "double") -> DataFrame:
    """Scale by parameters that differ by key (`by`, as a stream): a join with one row for each key, on streams a stream-static one.

    params: one row for each key and feature (by..., feature, mean, scale). Keys without parameters give nulls.
    """
    wide = params.groupBy(*by).agg(*(F.max(F.when(F.col("feature") == f, F.struct("mean", "scale"))).alias(f"_p_{f}") for f in features))
    made = df.join(wide, by, "left")
    return made.withColumns({f: ((F.col(f) - F.col(f"_p_{f}.mean")) / F.col(f"_p_{f}.scale")).cast(precision).cast("double") for f in features}).drop(*(f"_p_{f}" for f in features))


def apply_standard(df: DataFrame, params: DataFrame, precision: str = "double") -> DataFrame:
    rows = {r["feature"]: r for r in params.collect()}
    return df.withColumns({f: ((F.col(f) - r["mean"]) / r["scale"]).cast(precision).cast("double") for f, r in rows.items()})


def fit_minmax_windows(df: DataFrame, features: list[str], size: int, stream: list[str] = STREAM) -> DataFrame:
    """Bounds of each (step, feature) column of all sliding windows, without making the windows.

    Step t of a window runs over the rows from t on to size - 1 - t before the stream's end.
    """
    # A stream's rows meet its number by a join, so that a long stream isn't gathered for it.
    numbers = df.groupBy(*(F.col(c).alias(f"_k_{c}") for c in stream)).agg(F.count("*").alias("_n")).filter(F.col("_n") >= size)
    same = F.lit(True)
    for c in stream:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    placed = df.join(numbers, same)
    step = F.explode(F.sequence(F.greatest(F.lit(0), F.col("seq") - (F.col("_n") - size)), F.least(F.lit(size - 1), F.col("seq")))).alias("t")
    # Low and high steps only differ near the ends; each row meets its steps once.
    rows = placed.select(*features, step).groupBy("t").agg(*(g(f).alias(f"{n_}_{f}") for f in features for n_, g in (("low", F.min), ("high", F.max))))
    cells = F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(k).alias("pos"), F.col(f"low_{f}").alias("low"), F.col(f"high_{f}").alias("high")) for k, f in enumerate(features))))
    made = rows.select("t", cells)
    return made.withColumn("scale", F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.try_divide(F.lit(1.0), F.col("high") - F.col("low"))))


def apply_minmax(windows: DataFrame, params: DataFrame, values: str = "flat", clip: bool = False) -> DataFrame:
    """(x - low) * scale on flattened windows (index t * features + f); never clipped."""
    if clip:
        raise ValueError("clipping would hide values outside the fitted range")
    rows = params.orderBy("t", "pos").collect()
    low, scale = (F.array(*(F.lit(float(r[c])) for r in rows)) for c in ("low", "scale"))
    shifted = F.zip_with(values, low, lambda x, a: x - a)
    return windows.withColumn(values, F.zip_with(shifted, scale, lambda x, s: x * s))


def zscore(df: DataFrame, column: str, reference: Column | None = None, out: str = "z") -> DataFrame:
    """(x - mean) / (population deviation + 1e-8), by all rows or by those of `reference`."""
    picked = F.col(column) if reference is None else F.when(reference, F.col(column))
    stats = df.agg(F.avg(picked).alias("_m"), F.stddev_pop(picked).alias("_s"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, (F.col(column) - F.col("_m")) / (F.col("_s") + 1e-8)).drop("_m", "_s")


def robust_params(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median and interquartile range + 1e-2 of each column, exact for any number of distinct values."""
    found = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = [(c, k, q[1], None if q[1] is None else q[2] - q[0] + 1e-2) for k, (c, q) in enumerate(found.items())]
    return df.sparkSession.createDataFrame(rows, "feature string, pos int, median double, iqr double")


def robust_scale(df: DataFrame, columns: list[str], reference: DataFrame) -> DataFrame:
    """abs(x - median) / (interquartile range + 1e-2), by a reference frame."""
    rows = robust_params(reference, columns).collect()
    return df.withColumns({r["feature"]: F.abs(F.col(r["feature"]) - r["median"]) / r["iqr"] for r in rows})


def save_params(params: DataFrame, path: str, window: int) -> None:
    params.withColumn("window", F.lit(window)).write.mode("overwrite").parquet(path)


def load_params(spark, path: str, features: list[str], window: int) -> DataFrame:
    """Parameters from a folder; their features and window must be the ones asked for."""
    params = spark.read.parquet(path)
    found = params.select("feature", "pos", "window").distinct().orderBy("pos").collect()
    names = list(dict.fromkeys(r["feature"] for r in found))
    if names != features:
        raise ValueError(f"parameters are of {names}, not {features}")
    if {r["window"] for r in found} != {window}:
        raise ValueError(f"parameters are of windows of {found[0]['window']}, not {window}")
    return params.drop("window")
