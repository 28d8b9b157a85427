"""Contracts, labels, missing values and types of telemetry frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.cells import is_finite
from plantlens.operators.order import STREAM, by_stream


@dataclass(frozen=True)
class TelemetrySchema:
    features: list[str]
    stream: list[str] = field(default_factory=lambda: list(STREAM))
    time: str = "ts"
    ties: list[str] = field(default_factory=list)
    label: str | None = "label"


def enforce_contract(df: DataFrame, features: list[str], order: str = "strict", others: list[str] | None = None) -> DataFrame:
    """Features selected in contract order. strict: the frame's features must have that order already."""
    if len(set(features)) < len(features):
        raise ValueError(f"duplicate features: {sorted({f for f in features if features.count(f) > 1})}")
    others = [c for c in (others or []) if c in df.columns]
    have = [c for c in df.columns if c not in others]
    if len(set(have)) < len(have):
        raise ValueError(f"duplicate columns: {sorted({c for c in have if have.count(c) > 1})}")
    if missing := [f for f in features if f not in have]:
        raise ValueError(f"missing features: {missing}")
    if order == "strict":
        if unknown := [c for c in have if c not in features]:
            raise ValueError(f"unknown features: {unknown}")
        if have != features:
            raise ValueError(f"features out of order: {have}")
    return df.select(*others, *features)


def map_to_vector(readings: str, features: list[str]) -> Column:
    """Values of a map in contract order; any other set of keys fails the row."""
    want = F.array(*map(F.lit, features))
    keys = F.map_keys(readings)
    ok = (F.size(F.array_except(keys, want)) == 0) & (F.size(F.array_except(want, keys)) == 0)
    values = F.transform(want, lambda f: F.element_at(F.col(readings), f))
    return F.when(ok, values).otherwise(F.raise_error(F.concat(F.lit("keys differ from the contract: "), F.array_join(keys, ","))).cast("array<double>"))


def label_by_ranges(df: DataFrame, ranges: list[tuple[str, str]] | DataFrame, ts: str = "ts", most: int = 1000) -> DataFrame:
    """label 1 where ts lies in an inclusive range (range_start, range_end).

    Up to `most` ranges become a predicate. More are joined: a range meets the days that it touches, so rows and
    ranges are matched by an equi-join on the day, over distinct times only.
    """
    if isinstance(ranges, DataFrame):
        few = ranges.select("range_start", "range_end").limit(most + 1).collect()
        if len(few) > most:
            spans = ranges.select("range_start", "range_end", F.explode(F.sequence(F.to_date("range_start"), F.to_date("range_end"))).alias("_day"))
            times = df.select(ts).distinct().withColumn("_day", F.to_date(ts))
            hits = times.join(spans, "_day").filter(F.col(ts).between(F.col("range_start"), F.col("range_end"))).select(ts, F.lit(1).alias("label")).distinct()
            return df.drop("label").join(hits, ts, "left").fillna(0, ["label"])
        ranges = [(str(r["range_start"]), str(r["range_end"])) for r in few]
    inside = F.lit(False)
    for start, end in ranges:
        inside = inside | F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return df.withColumn("label", F.coalesce(inside, F.lit(False)).cast("int"))


def write_counted(df: DataFrame, n: int, path: str, fmt: str = "parquet", mode: str = "error") -> int:
    """Write a frame that must have n rows; they are counted on the way, without a pass of their own. Fails after the write otherwise."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).format(fmt).save(path)
    if (got := seen.get["n"]) != n:
        raise ValueError(f"{got} rows, not {n}")
    return got


def assert_count(df: DataFrame, n: int) -> DataFrame:
    """The frame itself, if it has n rows (a job of its own; write_counted counts on the write path)."""
    if (got := df.count()) != n:
        raise ValueError(f"{got} rows, not {n}")
    return df


def nonfinite_scan(df: DataFrame, features: list[str], stream: list[str] = STREAM) -> DataFrame:
    """Per feature the number of null, NaN or infinite cells and the first place of one, in one pass."""
    each = df.select(*stream, "seq", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), is_finite(f).alias("ok")) for f in features))).alias("c"))
    bad = each.filter(~F.col("c.ok"))
    return bad.groupBy(F.col("c.feature").alias("feature")).agg(F.count("*").alias("n_bad"), F.min(F.struct(*stream, "seq")).alias("first")).select("feature", "n_bad", "first.*")


def reject_nonfinite(df: DataFrame, features: list[str], quarantine: bool = False):
    """Fails on the first bad cell by name and place; with quarantine=True gives (good, bad) frames."""
    good = is_finite(features[0])
    for f in features[1:]:
        good = good & is_finite(f)
    if quarantine:
        return df.filter(good), df.filter(~good)
    if worst := nonfinite_scan(df, features).orderBy("seq").first():
        raise ValueError(f"{worst['feature']}: {worst['n_bad']} cells aren't finite, first in {worst.asDict()}")
    return df


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double (what isn't a number becomes null); columns without any number are dropped."""
    made = df.withColumns({c: F.expr(f"try_cast(trim(`{c}`) as double)") for c in columns})
    counts = made.agg(*(F.count(c).alias(c) for c in columns)).first()
    return made.drop(*(c for c in columns if not counts[c]))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: number of values, nulls and numbers after coercion."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in columns))).alias("c")
    return df.select(cells).groupBy(F.col("c.feature").alias("feature")).agg(
        F.count("*").alias("n"), F.count_if(F.col("c.v").isNull()).alias("n_null"), F.count(F.expr("try_cast(c.v as double)")).alias("n_numeric")
    )


def encode_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Codes by sorted distinct value, -1 for missing. The table of a column's values is aggregated first and joined back.

    Values are ranked inside parts by their first three characters, whose counts give the offsets, so the values of a
    column with many of them don't meet in one task.
    """
    from plantlens.operators.bucketed import with_global_seq

    for c in columns:
        values = df.filter(F.col(c).isNotNull()).select(c).distinct()
        codes = with_global_seq(values, [c], [], F.substring(F.col(c).cast("string"), 1, 3) if dict(values.dtypes)[c] == "string" else F.floor(F.col(c).cast("double") / 4096)).select(c, F.col("seq").cast("int").alias(f"{c}_code"))
        df = df.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return df


def align_clock(df: DataFrame, hours: int, ts: str = "ts") -> DataFrame:
    """Local time to UTC, floored to the second."""
    return df.withColumn(ts, F.date_trunc("second", F.col(ts) - F.expr(f"make_interval(0, 0, 0, 0, {hours})")))


def ffill_zero(df: DataFrame, features: list[str], stream: list[str] = STREAM) -> DataFrame:
    """The last valid observation, 0 before the first one."""
    w = by_stream(stream).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f: F.coalesce(F.last(F.when(~F.isnan(f), F.col(f)), ignorenulls=True).over(w), F.lit(0.0)) for f in features})
