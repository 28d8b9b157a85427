"""Best-fit packing of token runs into sequences by the linear grouping scheme.

Documents are cut into pieces of at most `capacity` tokens; what remains is bin packing of integer sizes. Large
sizes are rounded up within groups of equal cardinality, the few-size problem is optimised by column generation
over fill patterns (a linear programme, rounded down, the rest packed best-fit), actual pieces take the places
of the rounded ones, largest first, and small pieces are then put where they fit best.

The plan needs nothing but the number of pieces of each size, which is at most `capacity` rows however large the
corpus is; pieces of one size are interchangeable, so the plan speaks of ranks among the pieces of a size and
has at most a few thousand runs of ranks. Ranks are dealt in Spark: pieces are numbered inside salted parts of
a size, and the parts' counts give the offsets, so a size that a third of all pieces has is never in one task. Ranks meet runs by
stretches of ranks, so a piece of a size with thousands of runs is held against few of them.

Null and empty texts are a document of one token, the end mark. Rows are packed one by one, so repeated rows and ties take
different places; rows that repeat an id, even one that a third of all rows have, are dealt like any others. Empty tables give no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm.bpe import coder
from plantlens.llm.common import settle, shuffle_width, sliced, small

#: Bytes of text coded at a time inside a task: a word that repeats in them is looked up once.
SLICE_BYTES = 4 << 20
#: Tokens in a sequence, and the id that ends a document.
CAPACITY, END_ID = 2048, 0
#: Groups of large sizes, and the size up to which pieces count as small (a share of the capacity).
GROUPS, SMALL = 192, 1 / 3
#: Column generation goes on until no pattern improves the programme; it also ends where so many steps for each size in
#: a row leave the value as it is (degenerate steps), as the plan is feasible after each.
IDLE = 8


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, spaced: bool = False) -> DataFrame:
    """Tokenised documents cut into pieces: id, piece, start, length, ids_crc32."""
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = coder(vocabulary, "ids", spaced), struct.pack("<I", end_id)
        for batch in batches:
            for first, _, texts in sliced(batch.column(1), SLICE_BYTES):
                rows, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(code(texts, b"".join), first):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=names)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


def _best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes in one sequence (unbounded knapsack, by number of pieces)."""
    n = capacity // int(sizes.min())
    best, picks = np.zeros(capacity + 1), []
    for _ in range(n):  # best with at most one piece more
        more = np.full((len(sizes), capacity + 1), -1.0)
        for k, size in enumerate(sizes.tolist()):
            more[k, size:] = best[: capacity + 1 - size] + value[k]
        pick = more.argmax(0)
        top = more[pick, np.arange(capacity + 1)]
        picks.append(np.where(top > best + 1e-12, pick, -1))
        better = np.maximum(best, top)
        if np.array_equal(better, best):
            break
        best = better
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            counts[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(counts @ value), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Fill patterns and how often each is used; together they hold at least the demand of each size."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.linalg.inv(basis)
    use = inverse @ demand
    least, idle, step = use.sum(), 0, 0
    while idle < IDLE * m:
        value = inverse.sum(0)
        worth, column = _best_pattern(sizes, value, capacity)
        if worth <= 1 + 1e-7:
            break
        move = inverse @ column
        ratio = np.where(move > 1e-9, use / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        step += 1
        if step % 50 == 0:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / move[out]
            inverse = inverse - np.outer(move, row)
            inverse[out] = row
        use = np.maximum(inverse @ demand, 0)
        least, idle = (use.sum(), 0) if use.sum() < least * (1 - 1e-9) else (least, idle + 1)
    whole = np.floor(use + 1e-6).astype(np.int64)
    made = [(basis[:, k].astype(np.int64), int(whole[k])) for k in range(m) if whole[k]]
    left = np.maximum(demand - sum((p * c for p, c in made), np.zeros(m, np.int64)), 0)
    while left.any():  # fewer than one sequence a pattern: best fit, largest first
        pattern, room = np.zeros(m, np.int64), capacity
        for k in np.argsort(-sizes, kind="stable"):
            n = min(int(left[k]), room // int(sizes[k]))
            pattern[k] += n
            room -= n * int(sizes[k])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        made.append((pattern, max(1, times)))
        left = np.maximum(left - pattern * max(1, times), 0)
    return made


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Places for counts[size] pieces of each size, as runs (size, first rank, number, first sequence, offset).

    The pieces of a run go to consecutive sequences, all at the same offset.
    """
    small = max(1, int(capacity * SMALL))
    large = np.array(sorted((s for s in counts if s > small and counts[s]), reverse=True), np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    bins: list[tuple[int, int, int]] = []  # (used, first sequence, number)
    nexts = 0
    if len(large):
        each = np.array([counts[s] for s in large.tolist()], np.int64)
        ends = np.cumsum(each)
        total = int(ends[-1])
        # Groups of equal cardinality by falling size; a size that spans several groups makes them one.
        heads = sorted({int(large[np.searchsorted(ends, k * total // groups, "right")]) for k in range(groups)}, reverse=True)
        sizes = np.array(heads, np.int64)
        group = np.searchsorted(-sizes, -large, "right") - 1
        demand = np.bincount(group, each, minlength=len(sizes)).astype(np.int64)
        # The group's pieces in falling size: (size, rank in that size) as steps of a queue.
        queue = [[[int(s), 0, int(c)] for s, c, g in zip(large, each, group, strict=True) if g == k] for k in range(len(sizes))]

        def take(k: int, n: int) -> list[tuple[int, int, int]]:
            got = []
            while n and queue[k]:
                size, rank, left = queue[k][0]
                some = min(n, left)
                got.append((size, rank, some))
                queue[k][0] = [size, rank + some, left - some]
                if some == left:
                    queue[k].pop(0)
                n -= some
            return got

        for pattern, times in patterns(sizes, demand, capacity):
            used = [(0, nexts, times)]
            for k in np.repeat(np.arange(len(sizes)), pattern).tolist():
                fresh, pending = [], take(k, times)
                at = 0
                while pending and at < len(used):
                    size, rank, n = pending[0]
                    level, first, room = used[at]
                    some = min(n, room)
                    runs.append((size, rank, some, first, level))
                    fresh.append((level + size, first, some))
                    pending[0] = (size, rank + some, n - some)
                    used[at] = (level, first + some, room - some)
                    if some == n:
                        pending.pop(0)
                    if some == room:
                        at += 1
                used = fresh + [u for u in used[at:] if u[2]]
            nexts += times
            bins += used
    # Small pieces, largest first, each to the fullest sequences that can take it.
    by_room: dict[int, list[tuple[int, int]]] = {}
    rest: dict[int, list[int]] = {}  # size: first rank and number that found no place
    for level, first, n in bins:
        by_room.setdefault(capacity - level, []).append((first, n))
    for size in sorted((s for s in counts if s <= small and counts[s]), reverse=True):
        rank, left = 0, counts[size]
        for room in sorted(r for r in by_room if r >= size):
            each = room // size
            while left and by_room[room]:
                # A sequence takes all it has room for before the next one is opened; the last takes what is left.
                first, n = by_room[room].pop()
                deep, some = (each, min(n, left // each)) if left >= each else (left, 1)
                for k in range(deep):
                    runs.append((size, rank + k * some, some, first, capacity - room + k * size))
                rank, left = rank + deep * some, left - deep * some
                if some < n:
                    by_room[room].append((first + some, n - some))
                by_room.setdefault(room - deep * size, []).append((first, some))
        if left:
            rest[size] = [rank, left]
    # What no open sequence can take fills sequences of its own: best fit, largest first, many alike at a time.
    while rest:
        pattern, room = {}, capacity
        for size, (_, left) in rest.items():
            if n := min(left, room // size):
                pattern[size] = n
                room -= n * size
        times, level = min(rest[size][1] // n for size, n in pattern.items()), 0
        for size, n in pattern.items():
            for _ in range(n):
                runs.append((size, rest[size][0], times, nexts, level))
                level += size
                rest[size] = [rest[size][0] + times, rest[size][1] - times]
            if not rest[size][1]:
                del rest[size]
        nexts += times
    return runs


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, spaced: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    # Salted row by row, so that rows which repeat an id or a piece don't meet; what is written is salted once and for all.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(shuffle_width(spark))).cast("int")
    items = settle(pieces(df, vocabulary, id_col, text_col, capacity, end_id, spaced).withColumn("salt", salt))
    # At most capacity * salts rows; the driver gets `capacity` of them at most.
    parts = settle(items.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(counts, capacity, groups))
    if not runs:
        return items.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")
    ranked = items.withColumn("own", F.row_number().over(own) - 1).join(offsets.hint("merge"), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("own"))
    # The plan's runs: their number follows from the sizes, groups and patterns, not from the documents. They are counted all the same.
    # Ranks and runs of a size meet by stretches of ranks, of which a size has about as many as runs.
    width, pairs = stretches(runs, counts)
    places = spark.createDataFrame([(size, rank, rank + n, first, offset, width[size]) for size, rank, n, first, offset in runs], "length long, low long, high long, first long, offset long, width long")
    places = places.withColumn("stretch", F.explode(F.sequence(F.expr("low div width"), F.expr("(high - 1) div width")))).drop("width")
    widths = spark.createDataFrame(list(width.items()), "length long, width long")  # `capacity` rows at most
    ranked = ranked.join(F.broadcast(widths), "length").withColumn("stretch", F.expr("rank div width"))
    there = (ranked["length"] == places["length"]) & (ranked["stretch"] == places["stretch"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(small(places, pairs, 56), there)
    return placed.select(F.col("id").alias(id_col), "piece", "start", ranked["length"], "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def stretches(runs: list[tuple], counts: dict[int, int]) -> tuple[dict[int, int], int]:
    """For each size the ranks to a stretch, so that it has no more stretches than runs; and how many pairs of a run and a stretch meet (under two for each run)."""
    many: dict[int, int] = {}
    for size, *_ in runs:
        many[size] = many.get(size, 0) + 1
    width = {size: -(-counts[size] // n) for size, n in many.items()}
    return width, sum((rank + n - 1) // width[size] - rank // width[size] + 1 for size, rank, n, _, _ in runs)
