"""Exact order statistics of any number of distinct values, without a buffer that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values between approximate quantiles; no task ranks more than one of them.
RANGES = 64


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], ranges: int = RANGES) -> dict[str, list[float | None]]:
    """For each column its quantiles by linear interpolation (nulls are left out; None without values).

    Values are counted in one pass over the frame; the counts are persisted meanwhile. Approximate quantiles of the distinct
    values cut each column into ranges, whose counts tell which ranges hold the wanted ranks; only those are ranked. The
    driver gets the ranges' counts and two values for each quantile.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for k, c in enumerate(columns)))).alias("x")
    counts = df.select(cells).select("x.*").filter("v is not null").groupBy("c", "v").agg(F.count("*").alias("n")).persist()
    try:
        return from_counts(counts, columns, shares, ranges)
    finally:
        counts.unpersist()


def from_counts(counts: DataFrame, columns: list[str], shares: list[float], ranges: int = RANGES) -> dict[str, list[float | None]]:
    """The same from values that are counted: a row (c: place among the columns, v, n) for each distinct value of a column; read several times."""
    steps = [k / ranges for k in range(1, ranges)]
    found = {r["c"]: sorted(set(r["q"])) for r in counts.groupBy("c").agg(F.percentile_approx("v", steps, 1000).alias("q")).collect()}
    cuts = F.array(*(F.array(*map(F.lit, found.get(k, []))).cast("array<double>") for k in range(len(columns))))
    parts = counts.withColumn("part", F.size(F.filter(F.get(cuts, "c"), lambda x: x < F.col("v"))))
    sizes: dict[int, dict[int, int]] = {k: {} for k in range(len(columns))}
    for r in parts.groupBy("c", "part").agg(F.sum("n").alias("n")).collect():
        sizes[r["c"]][r["part"]] = r["n"]
    wanted = []  # column, rank, range and rows before the range
    places: dict[int, list[tuple[int, int, float]]] = {}
    for k in sizes:
        total = sum(sizes[k].values())
        places[k] = [(int(share * (total - 1)), min(total - 1, int(share * (total - 1)) + 1), share * (total - 1) % 1.0) for share in shares] if total else []
        ahead = 0
        for part in sorted(sizes[k]):
            wanted += [(k, rank, part, ahead) for rank in sorted({x for p in places[k] for x in p[:2]}) if ahead <= rank < ahead + sizes[k][part]]
            ahead += sizes[k][part]
    if not wanted:
        return {c: [None] * len(shares) for c in columns}
    ranks = counts.sparkSession.createDataFrame(wanted, "c int, rank long, part int, ahead long")
    upto = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = parts.join(F.broadcast(ranks.select("c", "part").distinct()), ["c", "part"]).withColumn("upto", F.sum("n").over(upto))
    hit = inside.join(F.broadcast(ranks), ["c", "part"]).filter((F.col("rank") - F.col("ahead") < F.col("upto")) & (F.col("rank") - F.col("ahead") >= F.col("upto") - F.col("n")))
    value = {(r["c"], r["rank"]): r["v"] for r in hit.select("c", "rank", "v").collect()}
    return {c: [value[k, a] + (value[k, b] - value[k, a]) * f for a, b, f in places[k]] or [None] * len(shares) for k, c in enumerate(columns)}
