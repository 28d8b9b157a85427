"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

A pair collides on a projection if one vector lies in the window of a fixed half-width around the other. Two
vectors at the least cosine collide on each projection with a known probability, so a count that such a pair
reaches with probability RECALL is calibrated from the binomial law; pairs that reach it are verified by their
cosine in double precision.

Single windows let a fixed share of all pairs through (at cosine 0.9 the distances of close and unrelated pairs
differ by a factor of 3.2 only), so counting over all rows would take time with the square of their number. Therefore
each of several tables first parts the rows by the signs of some lead projections, and windows are counted
inside the parts; the number of lead projections follows the logarithm of the number of rows, and the number of
tables is what TABLE_RECALL needs at the least cosine. A pair counts in the first table in which it meets.
Parts of more than TILE vectors are dealt as pairs of tiles, so no task gets more than two tiles.

Equal vectors are one vector with a weight. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length neither. Each row is a vector of its own, so rows that repeat
an id or a vector (ties) link with each other, and all rows of an id that is the least of its component are kept. Empty
tables give no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import settle, small
from plantlens.llm.components import components

#: Least cosine; projections whose collisions are counted; half-width in standard deviations of a pair at the least cosine.
COSINE, PROJECTIONS, HALF_WIDTH = 0.9, 16, 2.0
#: Chances that such a pair reaches the count, and that it meets in some table.
RECALL, TABLE_RECALL = 0.9995, 0.995
#: Vectors that a part has on average, and in a tile at most (by the number of tiles; hashing spreads them).
PART, TILE = 256, 1024
#: Pairs verified at a time.
PAIRS = 200_000
SEED = 11


def least_count(projections: int, half_width: float, recall: float) -> int:
    """The largest count that a pair at the least cosine reaches with probability `recall`."""
    p = math.erf(half_width / math.sqrt(2))
    tail, count = 1.0, 0
    for k in range(projections + 1):
        less = tail - math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if less < recall:
            return k
        tail, count = less, k + 1
    return count


def layout(rows: int, cosine: float = COSINE, part: int = PART, recall: float = TABLE_RECALL) -> tuple[int, int]:
    """Lead projections of a table and number of tables."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / part)))
    if not bits:
        return 0, 1
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _directions(length: int, number: int) -> np.ndarray:
    return np.random.default_rng([SEED, length]).normal(size=(length, number))


def _usable(vector: str):
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _codes(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """Per vector the part in each table (packed 32-bit words for each 32 signs) and its projections."""
    words = max(1, -(-bits // 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            lengths = np.array([len(v) for v in vectors.to_pylist()], np.int64)
            codes, shadows = [b""] * len(lengths), [b""] * len(lengths)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                x = np.array(vectors.take(pa.array(rows)).to_pylist(), np.float64)
                x /= np.sqrt((x * x).sum(1, keepdims=True)) if np.isfinite((x * x).sum()) else np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                p = x @ _directions(length, tables * bits + PROJECTIONS)
                signs = np.zeros((len(rows), tables, 32 * words), np.uint8)
                signs[:, :, :bits] = (p[:, : tables * bits] > 0).reshape(len(rows), tables, bits)
                own = np.packbits(signs, axis=2, bitorder="little")
                shadow = p[:, tables * bits :].astype("<f4")
                for k, row in enumerate(rows.tolist()):
                    codes[row], shadows[row] = own[k].tobytes(), shadow[k].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(shadows, pa.binary())], names=["rep", "vector", "weight", "codes", "shadow"])

    kind = reps.schema["vector"].dataType.simpleString()
    return reps.select("rep", "vector", "weight").mapInArrow(run, f"rep long, vector {kind}, weight long, codes binary, shadow binary")


def collisions(shadow: np.ndarray, half: float) -> np.ndarray:
    """Number of projections (columns) on which each pair of rows collides.

    Each projection is sorted; a query's window is a run of the order, marked by its ends and summed up.
    """
    n = len(shadow)
    count = np.zeros((n, n), np.int8)
    me = np.arange(n)
    for value in shadow.T:
        order = np.argsort(value)
        ranked = value[order]
        edges = np.zeros((n, n + 1), np.int8)
        edges[me, np.searchsorted(ranked, value - half, "left")] = 1
        edges[me, np.searchsorted(ranked, value + half, "right")] = -1
        rank = np.empty(n, np.int64)
        rank[order] = me
        count += np.cumsum(edges[:, :n], 1, dtype=np.int8)[:, rank]
    return count


def _links_inside(cosine: float):
    half = HALF_WIDTH * math.sqrt(2 - 2 * cosine)
    least = least_count(PROJECTIONS, HALF_WIDTH, RECALL)

    def run(group: pa.Table) -> pa.Table:
        n = group.num_rows
        table, i, j = (group[c][0].as_py() for c in ("table", "i", "j"))
        rep, weight, own = (group[c].to_numpy() for c in ("rep", "weight", "own"))
        codes = np.stack([np.frombuffer(c, "<u4") for c in group["codes"].to_pylist()])
        tables = group["tables"][0].as_py()
        codes = codes.reshape(n, tables, -1)
        shadow = np.stack([np.frombuffer(s, "<f4") for s in group["shadow"].to_pylist()])
        x = np.array(group["vector"].to_pylist(), np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        a, b = np.nonzero(np.triu(collisions(shadow, half) >= least, 1))
        if i != j:
            apart = own[a] != own[b]
            a, b = a[apart], b[apart]
        if table:
            fresh = np.ones(len(a), bool)
            for start in range(0, len(a), PAIRS):
                part = slice(start, start + PAIRS)
                fresh[part] = ~(codes[a[part], :table] == codes[b[part], :table]).all(2).any(1)
            a, b = a[fresh], b[fresh]
        near = np.concatenate([np.zeros(0, bool), *((np.einsum("ij,ij->i", x[a[s : s + PAIRS]], x[b[s : s + PAIRS]]) >= cosine) for s in range(0, len(a), PAIRS))])
        a, b = a[near], b[near]
        gained = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        root = np.arange(n)
        while True:  # least row reachable inside the tile
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        has = gained > 0
        return pa.table({"rep": rep[has], "gained": gained[has].astype(np.int64), "root": rep[root[has]]})

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per input row: id_col, n_links, component_id (least id reachable), kept (id_col = component_id). Ids are integers."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).withColumn("ok", _usable("vector"))
    hashes = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2")]
    named = settle(rows.select("id", F.col("ok") & F.col("id").isNotNull() & F.lit(True), *hashes).toDF("id", "ok", "h1", "h2"))
    kept = rows.filter("ok and id is not null").select("id", "vector", *hashes)
    reps = settle(kept.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector")))
    bits, tables = layout(reps.count(), cosine)
    coded = _codes(reps, bits, tables)
    width = 4 * max(1, -(-bits // 32))
    each = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.substring("codes", t * width + 1, F.lit(width))))
    coded = settle(coded.withColumn("tables", F.lit(tables)).withColumn("size", F.size("vector")))
    placed = coded.select("rep", "size", each.alias("table", "code"))
    crowded = settle(placed.groupBy("size", "table", "code").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).drop("n"))
    dealt = coded.select("*", each.alias("table", "code")).join(small(crowded, crowded.count(), 64), ["size", "table", "code"], "left")
    dealt = dealt.withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), "tiles").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("rep", "vector", "weight", "codes", "shadow", "tables", "size", "table", "code", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = settle(dealt.groupBy("size", "table", "code", "i", "j").applyInArrow(_links_inside(cosine), "rep long, gained long, root long"))
    gained = found.groupBy("rep").agg(F.sum("gained").alias("gained"))
    parts = components(found, "rep", "root")
    whole = reps.select("h1", "h2", "rep", "weight").join(gained, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    whole = whole.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("gained", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    linked = named.filter("ok").join(whole, ["h1", "h2"]).select("id", "links", "component")
    alone = named.filter("not ok").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
