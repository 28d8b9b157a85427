"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Two documents link if 100 * |intersection| >= percent * |union| of their sets of distinct word n-grams.

1. One scan makes each document's set of 64-bit n-gram hashes (numpy over byte buffers) and deals the lower part
   of its hashes (a prefix in hash order) to column blocks, as packed arrays. In a block, columns with one
   distinct set can't add to any overlap; a set whose prefix has fewer shared columns than its size demands
   (the size-derived bound) can't link and is discarded. Equal sets count as one throughout.
   The sets that are left go through the same blocks once more with all their columns: of a set that links, at least
   `percent` must be shared.
2. Sets that link share a column of both their prefixes in one order of all columns, the rarest first, so sets joined
   by such columns form families that hold all links.
3. Families are row blocks of the product: the incidence matrix of a family's sets is multiplied with its
   transpose, a block of columns at a time, overlaps are accumulated, and pairs below the size-derived bound are
   discarded. A family of at most TILE sets is one block. In a larger one each set is first held against the least and
   the greatest set of its columns; if that leaves several components, the family's sets are multiplied in pairs of
   tiles. So no link between components is missed, and no pair leaves a task but those that join components.

A column of any number of documents costs one entry for each document and column block, and at most one for
each map task where several sets of the task share it. Texts are whole; long ones are hashed in parts. Results are
exact but for equal hashes of unlike n-grams (64 bits) and for linked pairs of sets with one 31-bit tag in step 1.

Null or empty texts and texts without words have empty sets and link with nothing, as do rows without an id. Rows
that repeat an id are rows of their own: each gets the component of its own text, named by the least id in it (its
own row's or another's), so rows of one id with unlike texts don't join their components. Texts with fewer words
than n have one n-gram, the whole sequence. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import by_bytes, forget, settle, settled, shuffle_width, sliced, small
from plantlens.llm.components import components

#: Words in an n-gram and the least similarity, in percent.
WORDS, PERCENT = 5, 75
#: Share of a set beyond the shortest exact prefix that the first pass also looks at.
EXTRA = 0.10
#: Column blocks for each shuffle partition; bytes hashed at a time; prefix entries (8 bytes) gathered before they are dealt.
BLOCKS, SLICE_BYTES, FLUSH = 2, 1 << 19, 400_000
#: Sets in a tile, and columns multiplied at a time.
TILE, COLUMNS = 512, 4096
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2 ** 64; kept for the next call."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        made = np.full(max(n, SLICE_BYTES + 2), base, np.uint64)
        made[0] = 1
        _powers[key] = np.multiply.accumulate(made)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lowered bytes, and where they start."""
    data = np.frombuffer(raw, np.uint8)
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64)), starts


def _parts(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end behind white space (a longer word stays whole)."""
    start = 0
    while start < len(raw):
        stop = start + SLICE_BYTES // 2
        while stop < len(raw) and not _SPACE[raw[stop - 1]]:
            stop += 1
        yield raw[start:stop]
        start = stop


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams of lower-cased (A-Z) words."""
    raws = [t.encode().lower() for t in texts]
    if len(raws) == 1 and len(raws[0]) > SLICE_BYTES:
        hashed = np.concatenate([_word_hashes(p)[0] for p in _parts(raws[0])])
        first = np.array([0, len(hashed)])
    else:
        hashed, starts = _word_hashes(b"\n".join([*raws, b""]))
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]))
    with np.errstate(over="ignore"):
        n = max(0, len(hashed) - words + 1)
        grams = np.zeros(n, np.uint64)
        for k in range(words):
            grams = mix(grams * np.uint64(0x2545F4914F6CDD1D) + hashed[k : k + n])
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    one = mix(one * np.uint64(0x2545F4914F6CDD1D) + hashed[k])
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n, percent: int = PERCENT):
    """The fewest n-grams that a set of n (number or column) must share with any set that it links with."""
    return F.ceil(n * percent / F.lit(100.0)) if isinstance(n, Column) else -(-n * percent // 100)


def _digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


_DEALT = "block int, flush long, tokens binary, tags binary, ids binary, sizes binary, digests binary"


def _deal(source: DataFrame, blocks: int, sets_of: Callable, length_of: Callable) -> DataFrame:
    """Map side of a screen over (id, content): blobs of entries by column block, and one blob of documents for each flush.

    sets_of makes sets of n-grams of a slice of contents; length_of tells how many of a set's n columns are dealt.

    An entry is a column's hash inside its block (32 bits) and its set's tag (32 bits of the digest). Columns with
    several sets in this flush are sent once, with tag 0, and credited here: those credits go with the documents.
    """

    def flushed(ids: list[int], sizes: list[int], digests: list[bytes], parts: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        table = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        flush = int(xxhash.xxh3_64_intdigest(table.tobytes() + np.array(ids, np.int64).tobytes()) >> 1)
        tags = (table[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
        rows = []
        none = dict.fromkeys(("tokens", "tags", "ids", "sizes", "digests"))
        # Mixed again, as the prefixes hold only the low hashes.
        token, owner = mix(np.concatenate([*parts, np.zeros(0, np.uint64)])), np.concatenate([*owners, np.zeros(0, np.int64)])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        new = np.concatenate([[True], token[1:] != token[:-1]])[: len(token)]
        column = np.cumsum(new) - 1
        shared = np.bincount(column, minlength=0)[column] > 1 if len(column) else np.zeros(0, bool)
        local = np.bincount(owner[shared], minlength=len(ids)).astype("<u4")
        keep = ~shared | new
        block = ((token[keep] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        rest, tag = token[keep].astype("<u4"), np.where(shared[keep], np.uint32(0), tags[owner[keep]]).astype("<u4")
        cuts = np.searchsorted(block, np.arange(blocks + 1))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            part = slice(cuts[b], cuts[b + 1])
            rows.append(none | {"block": b, "flush": flush, "tokens": rest[part].tobytes(), "tags": tag[part].tobytes()})
        rows.append(none | {"block": flush % blocks, "flush": flush, "tags": local.tobytes(), "ids": np.array(ids, "<i8").tobytes(), "sizes": np.array(sizes, "<i8").tobytes(), "digests": b"".join(digests)})
        return pa.RecordBatch.from_pylist(rows, schema=_dealt_schema())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, digests, parts, owners, seen, held = [], [], [], [], [], set(), 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start, stop in by_bytes(batch.column(1), SLICE_BYTES):
                for key, grams in zip(keys[start:stop], sets_of(batch.column(1).slice(start, stop - start).to_pylist()), strict=True):
                    n, digest = len(grams), _digest(grams)
                    if n and digest not in seen:
                        seen.add(digest)
                        length = min(n, length_of(n))
                        parts.append(grams[:length])
                        owners.append(np.full(length, len(ids), np.int64))
                        held += length
                    ids.append(key)
                    sizes.append(n)
                    digests.append(digest)
                if held > FLUSH:
                    yield flushed(ids, sizes, digests, parts, owners)
                    ids, sizes, digests, parts, owners, seen, held = [], [], [], [], [], set(), 0
        if ids:
            yield flushed(ids, sizes, digests, parts, owners)

    return source.mapInArrow(run, _DEALT)


def _dealt_schema() -> pa.Schema:
    return pa.schema([("block", pa.int32()), ("flush", pa.int64()), *((c, pa.binary()) for c in ("tokens", "tags", "ids", "sizes", "digests"))])


def _credit(group: pa.Table) -> pa.Table:
    """One column block: the number of shared columns by flush and tag; blobs of documents pass."""
    rows = group.to_pylist()
    passed = [r for r in rows if r["ids"] is not None]
    rows = [r for r in rows if r["ids"] is None]
    out = list(passed)
    if rows:
        token = np.concatenate([np.frombuffer(r["tokens"], "<u4") for r in rows])
        tag = np.concatenate([np.frombuffer(r["tags"], "<u4") for r in rows])
        flush = np.repeat(np.arange(len(rows)), [len(r["tokens"]) // 4 for r in rows])
        order = np.argsort(token.astype(np.uint64) << np.uint64(32) | tag, kind="stable")
        token, tag, flush = token[order], tag[order], flush[order]
        new = np.concatenate([[True], token[1:] != token[:-1]])
        column = np.cumsum(new) - 1
        # Sorted by tag inside a column: it is shared if a map task said so (tag 0 comes first) or the tags differ.
        last = np.concatenate([new[1:], [True]])
        shared = ((tag[new] == 0) | (tag[new] != tag[last]))[column] & (tag != 0)
        tag, flush = tag[shared], flush[shared]
        pair, count = np.unique(flush.astype(np.uint64) << np.uint64(32) | tag, return_counts=True)
        whose = (pair >> np.uint64(32)).astype(np.int64)
        for k in np.unique(whose).tolist():
            own = whose == k
            out.append({"block": None, "flush": rows[k]["flush"], "tokens": count[own].astype("<u4").tobytes(), "tags": pair[own].astype("<u4").tobytes(), "ids": None, "sizes": None, "digests": None})
    return pa.Table.from_pylist(out, schema=_dealt_schema())


def _gather(group: pa.Table) -> pa.Table:
    """One flush: its documents with all credits."""
    rows = group.to_pylist()
    tags, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    docs = []
    for r in rows:
        if r["ids"] is None:
            tags.append(np.frombuffer(r["tags"], "<u4"))
            counts.append(np.frombuffer(r["tokens"], "<u4"))
        else:
            docs.append(r)
    unique, where = np.unique(np.concatenate(tags), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts), minlength=len(unique)).astype(np.int64)
    out = []
    for r in docs:
        digests = np.frombuffer(r["digests"], "<u8").reshape(-1, 2)
        tag = (digests[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
        at = np.minimum(np.searchsorted(unique, tag), max(0, len(unique) - 1))
        credit = np.frombuffer(r["tags"], "<u4").astype(np.int64)
        if len(unique):
            credit = credit + np.where(unique[at] == tag, total[at], 0)
        out.append(pa.table({
            "id": np.frombuffer(r["ids"], "<i8"), "n": np.frombuffer(r["sizes"], "<i8"), "credit": credit,
            "digest": pa.array([r["digests"][k : k + 16] for k in range(0, len(r["digests"]), 16)], pa.binary()),
        }))
    return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "credit": pa.array([], pa.int64()), "digest": pa.array([], pa.binary())})


def _screened(source: DataFrame, sets_of: Callable, length_of: Callable) -> DataFrame:
    blocks = BLOCKS * shuffle_width(source.sparkSession)
    credits = _deal(source, blocks, sets_of, length_of).groupBy("block").applyInArrow(_credit, _DEALT)
    return credits.groupBy("flush").applyInArrow(_gather, "id long, n long, credit long, digest binary")


def screen(source: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """First screen of (id, text): one row per input row with id, n, digest and credit (shared columns in its prefix)."""
    return _screened(source, lambda texts: shingle_sets([t or "" for t in texts], words), lambda n: n - least_overlap(n, percent) + 1 + int(EXTRA * n))


def screen_sets(sets: DataFrame) -> DataFrame:
    """Second screen of distinct sets (id, grams): id, n, digest and credit (shared columns)."""
    return _screened(sets.select("id", "grams"), lambda packed: [np.frombuffer(g, "<u8") for g in packed], lambda n: n)


def _sets(source: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in sliced(batch.column(3), SLICE_BYTES):
                sets = shingle_sets(texts, words)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([_digest(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    names=["id", "wanted", "once", "digest", "n", "grams"],
                )

    return source.mapInArrow(run, "id long, wanted binary, once boolean, digest binary, n long, grams binary")


def _entries(sets: DataFrame) -> DataFrame:
    """(id, gram): one row for each column of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, stop in by_bytes(batch.column(1), SLICE_BYTES):
                packed = batch.column(1).slice(start, stop - start).to_pylist()
                grams = np.frombuffer(b"".join(packed), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[start:stop], [len(g) // 8 for g in packed])), pa.array(grams)], names=["id", "gram"])

    return sets.select("id", "grams").mapInArrow(run, "id long, gram long")


def _fits(na: str, nb: str, percent: int):
    """Size bound: the smaller set has at least percent of the larger one's n-grams."""
    return F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) among distinct sets (id, n, grams) that join all that belong together, not all that there are."""
    spark = sets.sparkSession
    entries = _entries(sets)
    counted = entries.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    rare = F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("c")
    ranked = entries.join(counted, "gram").groupBy("id").agg(rare).join(sets.select("id", "n"), "id")
    # As many of the rarest columns as a link can't avoid; those of one set come first and need no rows.
    own = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0)) + 1 - (F.col("n") - F.size("c"))
    ranked = ranked.withColumn("m", own.cast("int")).filter("m > 0").select("id", "n", F.explode(F.slice("c", F.lit(1), F.col("m"))).alias("c"))
    kept, kept_at = settled(ranked.select("id", "n", F.col("c.gram").alias("gram")))
    me = F.struct("id", "n")
    ends = kept.groupBy("gram").agg(F.min(me).alias("lo"), F.max(me).alias("hi")).filter("lo <> hi")
    ends = ends.select("gram", F.array("lo", "hi").alias("p"))
    near = kept.join(ends, "gram").select("id", "n", F.explode("p").alias("p")).filter("id <> p.id")
    near, near_at = settled(near.select("id", "n", F.col("p.id").alias("pid"), F.col("p.n").alias("pn")).distinct())
    family, family_at = settled(components(near.select("id", "pid"), "id", "pid").toDF("id", "family"))
    sizes = family.groupBy("family").agg(F.count("*").alias("members"))
    whole = family.join(sizes, "family")

    # Families of one tile, several of them to a task's group.
    one = whole.filter(F.col("members") <= TILE)
    groups = shuffle_width(spark) * 8
    one = one.select("id", "family", F.col("id").alias("part"), F.pmod(F.xxhash64("family"), F.lit(groups)).cast("int").alias("i"))
    inside, _ = settled(one.join(sets.select("id", "grams"), "id").groupBy("i").applyInArrow(_products(percent), "a long, b long"))

    # Larger ones: first by the pivots of the columns; then, where components are left, by pairs of tiles.
    large, large_at = settled(whole.filter(F.col("members") > TILE))
    if not large.limit(1).count():
        forget(spark, kept_at, near_at, family_at, large_at)
        return inside
    first = near.join(large.select("id"), "id", "left_semi").filter(_fits("n", "pn", percent)).select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct()
    found = settle(_held_against(first, sets, percent))
    parts = large.join(components(found).toDF("id", "component"), "id", "left").select("id", "family", "members", F.coalesce("component", "id").alias("part"))
    parts = settle(parts)
    mixed = parts.groupBy("family").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("family")
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    members = parts.join(mixed, "family").select("id", "family", "part", tiles.alias("tiles"), F.pmod(F.xxhash64("id"), tiles).cast("int").alias("own"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("id", "family", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    across = dealt.join(sets.select("id", "grams"), "id").groupBy("family", "i", "j").applyInArrow(_products(percent), "a long, b long")
    across = settle(across.distinct())
    forget(spark, kept_at, near_at, family_at, large_at)
    return inside.union(found).union(across)


def _held_against(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps of each pivot's set with the sets paired with it, TILE of them at a time."""
    tiles = pairs.groupBy("a").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    partners = pairs.join(tiles, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), "tiles").cast("int").alias("salt"), F.lit(False).alias("pivot"))
    pivots = tiles.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("salt"), F.lit(True).alias("pivot"))
    rows = partners.union(pivots)

    def run(group: pa.Table) -> pa.Table:
        grams, pivot, ids = group["grams"].to_pylist(), group["pivot"].to_pylist(), group["id"].to_numpy()
        me = np.frombuffer(grams[pivot.index(True)], "<u8")
        ok = []
        for k, raw in enumerate(grams):
            gram = np.frombuffer(raw, "<u8")
            o = int((me[np.minimum(np.searchsorted(me, gram), len(me) - 1)] == gram).sum())
            ok.append(not pivot[k] and 100 * o >= percent * (len(me) + len(gram) - o))
        return pa.table({"a": group["a"].to_numpy()[ok], "b": ids[ok]})

    return rows.join(sets.select("id", "grams"), "id").groupBy("a", "salt").applyInArrow(run, "a long, b long")


def _products(percent: int):
    """Links between parts among the sets of each family in a group, by products of incidence matrices."""

    def run(group: pa.Table) -> pa.Table:
        family, part = group["family"].to_numpy(), group["part"].to_numpy()
        grams = group["grams"].to_pylist()
        order = np.argsort(family, kind="stable")
        cuts = np.flatnonzero(np.diff(family[order])) + 1
        pairs = [np.zeros((0, 2), np.int64)]
        for rows in np.split(order, cuts):
            x, y = _overlapping([np.frombuffer(grams[k], "<u8") for k in rows], percent)
            own = part[rows]
            apart = own[x] != own[y]
            pairs.append(np.unique(np.sort(np.stack([own[x[apart]], own[y[apart]]], 1), 1), axis=0))
        made = np.concatenate(pairs)
        return pa.table({"a": made[:, 0], "b": made[:, 1]})

    return run


def _overlapping(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose overlap, accumulated over blocks of columns, reaches the similarity."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], dense[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        block = np.zeros((len(sets), min(COLUMNS, width - start)), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        overlap += block @ block.T
    x, y = np.nonzero(np.triu(overlap, 1))
    o = overlap[x, y].astype(np.int64)
    ok = 100 * o >= percent * (size[x] + size[y] - o)
    return x[ok], y[ok]


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (least id reachable by links). Ids are integers."""
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = settle(screen(source.filter("id is not null"), words, percent))
    rows = seen.filter("n > 0").groupBy("digest", "id").agg(F.count("*").alias("copies"), F.max("n").alias("n"), F.max("credit").alias("credit"))
    by_set = rows.groupBy("digest").agg(F.min(F.struct("id", "copies")).alias("rep"), F.max("n").alias("n"), F.max("credit").alias("credit"))
    # Of a pair, the set whose prefix ends first shares EXTRA of its own size and one column more, and it has at least `percent` of the other's size.
    bound = F.floor(F.lit(EXTRA) * F.ceil(F.col("n") * percent / F.lit(100.0))) + 1
    by_set = settle(by_set.select("digest", F.col("rep.id").alias("rep"), (F.col("rep.copies") == 1).alias("once"), (F.col("credit") >= bound).alias("open")))
    wanted = by_set.filter("open").select(F.col("rep").alias("id"), F.col("digest").alias("wanted"), "once")
    chosen = source.join(small(wanted, wanted.count(), 64), "id").select("id", "wanted", "once", "text")
    sets = _sets(chosen, words).filter("digest = wanted")
    # A set is taken from one row; rows that repeat both id and text are few or none, and only those need a shuffle.
    sets = sets.filter("once").union(sets.filter("not once").dropDuplicates(["id", "digest"]))
    # Two sets of one id are two rows of the incidence matrix, so sets are named by their digests.
    sets, sets_at = settled(sets.select(_name("digest").alias("id"), "n", "grams"))
    tight = settle(screen_sets(sets).filter(F.col("credit") >= least_overlap(F.col("n"), percent)).select("id"))
    sets = settle(sets.join(small(tight, tight.count(), 16), "id", "left_semi"))
    forget(df.sparkSession, sets_at)
    parts = components(links(sets, percent)).toDF("name", "part")
    named = by_set.withColumn("name", _name("digest")).join(parts, "name", "left").select("digest", "rep", F.coalesce("part", "name").alias("part"))
    named = settle(named)
    first = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = named.join(first, "part").select("digest", "component_id")
    whole = seen.join(named, "digest", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    nameless = source.filter("id is null")
    if nameless.limit(1).count():
        empty = nameless.select("id", F.lit(None).cast("binary").alias("wanted"), F.lit(True).alias("once"), "text")
        whole = whole.unionByName(_sets(empty, words).select("id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
    return whole.withColumnRenamed("id", id_col)


def _name(digest: str):
    """A set's number: 64 bits of its digest."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")
