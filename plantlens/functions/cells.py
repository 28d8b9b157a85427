"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity factors and the families of channel tags.
HIGH_RATIO, MEDIUM_RATIO = 10.0, 2.0
CONTINUOUS, DISCRETE = ("FIT", "LIT", "AIT", "DPIT", "PIT"), ("MV", "P", "UV")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """Neither null nor NaN nor infinite; never null itself."""
    c = col(c)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def normalise_label(c: str | Column, needle: str = "attack", numeric: bool = False) -> Column:
    """1 if the text contains the needle once case and blanks are ignored; with numeric also for 1 and 1.0."""
    plain = F.replace(F.lower(F.trim(col(c))), F.lit(" "), F.lit(""))
    hit = F.contains(plain, F.lit(needle))
    if numeric:
        hit = hit | plain.isin("1", "1.0")
    return F.coalesce(hit, F.lit(False)).cast("int")


def parse_ts(c: str | Column, pattern: str = "dd/MM/yyyy h:mm:ss a") -> Column:
    return F.try_to_timestamp(F.trim(col(c)), F.lit(pattern))


def over_threshold(score: str | Column, threshold: Column | float) -> Column:
    """Strictly over the threshold; NaN and null are not."""
    s = col(score)
    return F.coalesce(~F.isnan(s) & (s > threshold), F.lit(False))


def severity(score: str | Column, threshold: str | Column | float) -> Column:
    s, t = col(score), F.lit(threshold) if isinstance(threshold, int | float) else col(threshold)
    times = F.try_divide(s, t)
    return F.when((t <= 0) | (times >= HIGH_RATIO), "HIGH").when(times >= MEDIUM_RATIO, "MEDIUM").otherwise("LOW")


def classify_channel(c: str | Column) -> Column:
    """continuous, discrete or unknown, by all leading letters of the tag."""
    family = F.regexp_extract(col(c), "^[A-Za-z]+", 0)
    return F.when(family.isin(*CONTINUOUS), "continuous").when(family.isin(*DISCRETE), "discrete").otherwise("unknown")


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))
