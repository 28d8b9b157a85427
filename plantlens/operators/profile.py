"""Profiles and feature selection. Each is one aggregate over the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.cells import is_finite
from plantlens.operators.order import STREAM, by_stream


def melted(df: DataFrame, features: list[str], keep: list[Column | str] = ()) -> DataFrame:
    """Long form: feature and value of each cell."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(k).alias("pos"), F.col(f).cast("double").alias("value")) for k, f in enumerate(features))))
    return df.select(*keep, cells.alias("c")).select(*[k if isinstance(k, str) else k for k in keep], "c.*")


def wide_aggregate(df: DataFrame, features: list[str], **functions) -> DataFrame:
    """One pass of column aggregates, turned to one row per feature."""
    one = df.agg(*(f(c).alias(f"{name}_{k}") for k, c in enumerate(features) for name, f in functions.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(k).alias("pos"), *(F.col(f"{name}_{k}").alias(name) for name in functions)) for k, c in enumerate(features)))
    return one.select(F.inline(rows))


def feature_std(df: DataFrame, features: list[str]) -> DataFrame:
    return wide_aggregate(df, features, std=F.stddev_samp)


def drop_near_constant(df: DataFrame, features: list[str], eps: float = 1e-8) -> DataFrame:
    keep = {r["feature"] for r in feature_std(df, features).filter(F.col("std") > eps).collect()}
    return df.drop(*(f for f in features if f not in keep))


def top_k_variance(df: DataFrame, features: list[str], k: int) -> DataFrame:
    return wide_aggregate(df, features, variance=F.var_samp).orderBy(F.desc("variance"), "pos").limit(k)


def constant_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Features whose least and greatest value are equal; one with a NaN or infinite value isn't constant."""
    finite = wide_aggregate(df, features, low=F.min, high=F.max)
    return finite.filter(is_finite("low") & is_finite("high") & (F.col("low") == F.col("high"))).select("feature", F.col("low").alias("value"))


def frozen_report(df: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """Distinct values of each feature in each split."""
    return melted(df, features, [split]).groupBy("feature").pivot(split, ["train", "val"]).agg(F.countDistinct("value"))


def base_rate(df: DataFrame, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg("label").alias("base_rate"))


def label_profile(df: DataFrame, n_features: int, stream: list[str] = STREAM) -> DataFrame:
    """Per stream: rows, share and number of label runs, and what looks wrong."""
    starts = (F.col("label") == 1) & (F.coalesce(F.lag("label").over(by_stream(stream)), F.lit(0)) == 0)
    made = df.withColumn("start", starts.cast("int")).groupBy(*stream).agg(F.count("*").alias("n"), F.avg("label").alias("share"), F.sum("start").alias("segments"))
    warning = F.when(F.col("share") == 0, "no positive").when(F.col("share") > 0.9, "mostly positive").when(F.col("segments") < 2, "few segments").otherwise("ok")
    return made.withColumns({"features": F.lit(n_features), "warning": warning})


def duplicate_profile(df: DataFrame, features: list[str], ts: str = "ts") -> DataFrame:
    """Rows that repeat another one's features, timestamps that repeat, and the repeated share of normal rows."""
    rows = df.groupBy(*features).agg(F.count("*").alias("c"), F.count_if(F.col("label") == 0).alias("normal"))
    rows = rows.agg(F.sum(F.col("c") - 1).alias("dup_rows"), F.sum(F.when(F.col("c") > 1, F.col("normal")).otherwise(0)).alias("dup_normal"), F.sum("normal").alias("normal"))
    times = df.groupBy(ts).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("dup_times"))
    return rows.crossJoin(times).select("dup_rows", "dup_times", F.try_divide("dup_normal", "normal").alias("dup_normal_share"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
