"""Bucketed forms for few, very long streams: nothing is partitioned by the stream alone.

A global sequence number comes from parts of time and their counts; windows run inside buckets of it that
carry a halo of the rows before them; runs are found inside buckets and stitched through one small row for each.
All results equal those of the keyed forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.operators.order import STREAM


def with_global_seq(df: DataFrame, order: list[str], stream: list[str] = STREAM, part: Column | None = None) -> DataFrame:
    """seq as in with_seq; a window gets the rows of one part (by default a day of the first order column) of a stream.

    `part` must be a function of the row that grows with the order. Only counts per stream and part meet otherwise.
    """
    parts = df.withColumn("_part", F.date_trunc("day", F.col(order[0])) if part is None else part)
    counts = parts.groupBy(*stream, "_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*stream).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(c).alias(f"_k_{c}") for c in stream), F.col("_part").alias("_k_part"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy(*stream, "_part").orderBy(*order)) - 1
    same = F.col("_part").eqNullSafe(F.col("_k_part"))
    for c in stream:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    numbered = parts.withColumn("_own", own).join(counts, same)
    return numbered.withColumn("seq", (F.col("_ahead") + F.col("_own")).cast("long")).select(*(c for c in df.columns if c != "seq"), "seq")


def with_halo(df: DataFrame, bucket: int, halo: int, seq: str = "seq") -> DataFrame:
    """Rows with column bucket; the last `halo` rows of a bucket are also there in the next one, marked by column is_halo."""
    if halo >= bucket:
        raise ValueError("a bucket must be longer than its halo")
    own = F.expr(f"{seq} div {bucket}")
    copies = F.when(F.col(seq) % bucket >= bucket - halo, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_shift", F.explode(copies)).withColumn("bucket", own + F.col("_shift")).withColumn("is_halo", F.col("_shift") == 1).drop("_shift")


def over_windows(df: DataFrame, size: int, columns: dict, bucket: int = 100_000, stream: list[str] = STREAM) -> DataFrame:
    """Add columns (functions of a window specification) over frames of the last `size` rows."""
    w = Window.partitionBy(*stream, "bucket").orderBy("seq").rowsBetween(-(size - 1), 0)
    made = with_halo(df, bucket, size - 1).withColumns({name: f(w) for name, f in columns.items()})
    return made.filter(~F.col("is_halo")).drop("bucket", "is_halo")


def starts_of(df: DataFrame, new: Column, bucket: int = 100_000, stream: list[str] = STREAM) -> DataFrame:
    """Column run_start: the seq of the last row up to here at which `new` is true (null before the first), from buckets and one row for each."""
    dealt = df.withColumns({"_new": F.coalesce(new, F.lit(False)), "bucket": F.expr(f"seq div {bucket}")})
    w = Window.partitionBy(*stream, "bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("_run_start", F.max(F.when(F.col("_new"), F.col("seq"))).over(w))
    before = Window.partitionBy(*stream).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = dealt.groupBy(*stream, "bucket").agg(F.max("_run_start").alias("_last")).select(*stream, "bucket", F.max("_last").over(before).alias("_carry"))
    return dealt.join(carry, [*stream, "bucket"]).withColumn("run_start", F.coalesce("_run_start", "_carry")).drop("bucket", "_new", "_run_start", "_carry")


def running_sums(df: DataFrame, columns: dict[str, Column], bucket: int = 100_000, stream: list[str] = STREAM) -> DataFrame:
    """Columns of running sums over each stream: sums inside buckets, and those of the buckets before through one row for each."""
    dealt = df.withColumns({f"_x_{n}": c for n, c in columns.items()} | {"bucket": F.expr(f"seq div {bucket}")})
    before = Window.partitionBy(*stream).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*stream, "bucket").agg(*(F.sum(f"_x_{n}").alias(f"_s_{n}") for n in columns))
    carry = sums.select(*stream, "bucket", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in columns))
    w = Window.partitionBy(*stream, "bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    made = dealt.withColumns({n: F.sum(f"_x_{n}").over(w) for n in columns}).join(carry, [*stream, "bucket"])
    return made.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in columns}).drop("bucket", *(f"_{k}_{n}" for n in columns for k in "xc"))


def run_starts(df: DataFrame, state: Column, bucket: int = 100_000, stream: list[str] = STREAM) -> DataFrame:
    """Column run_start: the seq at which the run of equal `state` that a row is in began (nulls equal each other).

    A halo of one row tells whether a bucket's first run goes on; buckets that are one run pass on the start
    that reached them, through one row per bucket.
    """
    marked = with_halo(df.withColumn("_run_state", state), bucket, 1)
    w = Window.partitionBy(*stream, "bucket").orderBy("seq")
    new = ~F.coalesce(F.lag("_run_state").over(w).eqNullSafe(F.col("_run_state")) & F.lag("seq").over(w).isNotNull(), F.lit(False))
    marked = marked.withColumn("_run_new", new)
    marked = marked.withColumn("_run_start", F.last(F.when(F.col("_run_new") & ~F.col("is_halo"), F.col("seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.filter(~F.col("is_halo"))
    # Per bucket the last start inside it (null: the run comes from before); carried forward over buckets.
    last = marked.groupBy(*stream, "bucket").agg(F.max("_run_start").alias("_run_last"))
    before = Window.partitionBy(*stream).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*stream, "bucket", F.last("_run_last", ignorenulls=True).over(before).alias("_run_carry"))
    made = marked.join(carry, [*stream, "bucket"])
    return made.withColumn("run_start", F.coalesce("_run_start", "_run_carry")).drop("_run_state", "_run_new", "_run_start", "_run_carry", "bucket", "is_halo")


def run_lengths(df: DataFrame, state: Column, bucket: int = 100_000, stream: list[str] = STREAM) -> DataFrame:
    """Column run_length: rows of the run up to here."""
    return run_starts(df, state, bucket, stream).withColumn("run_length", F.col("seq") - F.col("run_start") + 1)


def segments(df: DataFrame, condition: Column, bucket: int = 100_000, stream: list[str] = STREAM) -> DataFrame:
    """As segments.segments."""
    runs = run_starts(df.withColumn("_hit", condition), F.col("_hit"), bucket, stream).filter("_hit")
    return runs.groupBy(*stream, F.col("run_start").alias("start_seq")).agg((F.max("seq") + 1).alias("stop_seq"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("length"))


def ffill_zero(df: DataFrame, features: list[str], bucket: int = 100_000, stream: list[str] = STREAM) -> DataFrame:
    """As clean.ffill_zero: each bucket's last value is carried on through one row per bucket."""
    df = df.withColumn("bucket", F.expr(f"seq div {bucket}"))
    w = Window.partitionBy(*stream, "bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    valid = {f: F.when(~F.isnan(f), F.col(f)) for f in features}
    last = df.groupBy(*stream, "bucket").agg(*(F.max_by(v, F.when(v.isNotNull(), F.col("seq"))).alias(f"_l_{f}") for f, v in valid.items()))
    before = Window.partitionBy(*stream).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*stream, "bucket", *(F.last(f"_l_{f}", ignorenulls=True).over(before).alias(f"_c_{f}") for f in features))
    made = df.join(carry, [*stream, "bucket"])
    return made.withColumns({f: F.coalesce(F.last(v, ignorenulls=True).over(w), F.col(f"_c_{f}"), F.lit(0.0)) for f, v in valid.items()}).drop("bucket", *(f"_c_{f}" for f in features))


def longest(df: DataFrame, stream: list[str] = STREAM) -> int:
    """Rows of the longest stream."""
    return df.groupBy(*stream).count().agg(F.max("count")).first()[0] or 0


def pick_mode(df: DataFrame, stream: list[str] = STREAM, limit: int = 20_000_000) -> str:
    """keyed or bucketed, by the longest stream's number of rows."""
    return "keyed" if longest(df, stream) <= limit else "bucketed"
