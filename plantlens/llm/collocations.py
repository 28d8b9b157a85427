"""Collocations of two and three words, mined through weighted acyclic automata.

Texts are coded block by block (blocks.py); a word gets an id in the order of its language and bytes if it occurs often enough to be part of a candidate. Each block
builds a count transducer from its sorted n-grams: an acyclic automaton over word ids whose accepted phrases are numbered in order by
the counts of paths on its arcs, with one weight for each number. States with equal continuations are shared. Transducers are cut by
prefix ranges: a range is a stretch of the order of phrases, chosen so that ranges are about even if words were independent, the stretch of
a frequent prefix being divided by its second and third word. The union of a range's transducers sums up their weights, one range to a
task. For the parts of phrases, the phrases in question are sent to the range of the part and composed with its transducer.

Only words of at least `least` occurrences can be in a candidate, so n-grams of other words are never built. All counts are exact.

Null and empty texts have no words; a null language is `und`. Texts are read whole. Rows that repeat an id are documents of
their own. Equal scores are told apart by count and phrase, so results never hang on the order of rows. Empty tables give no rows. Only
the text and the language are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm.blocks import coded, numbers
from plantlens.llm.common import forget, settled

#: A candidate occurs so often; a longer candidate with this share of its occurrences (of 100) swallows it; results of a language.
LEAST, SWALLOW, BEST = 10, 50, 2000

#: Occurrences to a prefix range; new n-grams that a block holds before they are added to its transducer.
RANGE_TOKENS, RUN = 1 << 20, 1 << 19

#: What ends a piece, and the code of that end.
_PIECES = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"\n" * 10 + b" ")
_GAP, _END = b"", b"\n"


def _tokens(text: bytes) -> list[bytes]:
    """Words of all pieces, with a newline for each end of a piece and empty strings for more than one space."""
    return text.translate(_PIECES).replace(b"\n", b" \n ").split(b" ")


@dataclass
class Transducer:
    """Phrases of up to three word ids with their counts, as an acyclic automaton.

    `pairs` are the arcs to the second state, in order (first id, second id); `state` is the shared third state that each leads to; the arcs of state s
    are third[arcs[s] : arcs[s + 1]]. `n_pairs` are the weights of pairs, `n_triples` those of triples in order of their paths: the number
    of a path is the number of paths through earlier pairs plus the place of its last arc.
    """

    pairs: np.ndarray
    n_pairs: np.ndarray
    state: np.ndarray
    arcs: np.ndarray
    third: np.ndarray
    n_triples: np.ndarray

    @staticmethod
    def empty() -> Transducer:
        return Transducer(*(np.zeros(n, t) for n, t in ((0, np.uint64), (0, np.int64), (0, np.int64), (1, np.int64), (0, np.int64), (0, np.int64))))

    @staticmethod
    def of(pairs: np.ndarray, n_pairs: np.ndarray, owner: np.ndarray, third: np.ndarray, n_triples: np.ndarray) -> Transducer:
        """From sorted distinct pairs and sorted triples (owner: the triple's place among the pairs)."""
        many = np.bincount(owner, minlength=len(pairs))
        # States with the same arcs are one: told apart by their number of arcs and a sum of hashes, and then compared arc by arc.
        mixed = (third.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        begin = np.cumsum(many) - many
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)])
        sign = total[begin + many] - total[begin]
        order = np.lexsort((sign, many))
        same = (many[order][1:] == many[order][:-1]) & (sign[order][1:] == sign[order][:-1])
        a, b = order[:-1][same], order[1:][same]
        same[np.flatnonzero(same)[_differ(third, begin[a], begin[b], many[a])]] = False
        state = np.empty(len(pairs), np.int64)
        state[order] = np.cumsum(np.concatenate([[0], ~same])) if len(pairs) else 0
        first = order[np.concatenate([[True], ~same])] if len(pairs) else order
        arcs = np.concatenate([[0], np.cumsum(many[first])]).astype(np.int64)
        return Transducer(pairs, n_pairs, state, arcs, third[_spans(begin[first], many[first])], n_triples)

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """The pair's place and the third id of every path, in order."""
        many = np.diff(self.arcs)[self.state]
        return np.repeat(np.arange(len(self.pairs)), many), self.third[_spans(self.arcs[self.state], many)]

    def plus(self, pairs: np.ndarray, n_pairs: np.ndarray, triple_pairs: np.ndarray, third: np.ndarray, n_triples: np.ndarray) -> Transducer:
        """The union with weighted pairs and triples in any order, equal phrases adding up."""
        owner, mine = self.triples()
        pairs, n_pairs = _summed(np.concatenate([self.pairs, pairs]), None, np.concatenate([self.n_pairs, n_pairs]))[::2]
        heads, third, n_triples = _summed(np.concatenate([self.pairs[owner], triple_pairs]), np.concatenate([mine, third]), np.concatenate([self.n_triples, n_triples]))
        return Transducer.of(pairs, n_pairs, np.searchsorted(pairs, heads), third, n_triples)

    def compose(self, pairs: np.ndarray) -> np.ndarray:
        """The weights of the given pairs, 0 where a pair isn't accepted."""
        if not len(self.pairs):
            return np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.n_pairs[at], 0)

    def cut(self, start: int, stop: int, first_triple: int, last_triple: int, many: np.ndarray) -> list[bytes]:
        """The pairs start to stop and their triples, packed; arcs go by state, so only states in use are written."""
        used, state = np.unique(self.state[start:stop], return_inverse=True)
        wide = many[used]
        pairs = self.pairs[start:stop]
        heads = np.diff(pairs >> np.uint64(32), prepend=np.uint64(0))
        return [_packed(x) for x in (heads, pairs & np.uint64(0xFFFFFFFF), self.n_pairs[start:stop], state, wide, self.third[_spans(self.arcs[used], wide)], self.n_triples[first_triple:last_triple])]


#: A transducer's columns: steps of the first ids, second ids, weights of pairs, states, arcs of each state, third ids, weights of triples.
NAMES = ["heads", "seconds", "n_pairs", "state", "wide", "third", "n_triples"]
COLUMNS = ", ".join(f"{c} binary" for c in NAMES)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest bytes that hold the greatest, after a byte that tells how many."""
    size = np.min_scalar_type(int(numbers.max(initial=0))).itemsize
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def _unpacked(column: pa.ChunkedArray | pa.Array, row: int) -> np.ndarray:
    held = column[row].as_buffer()
    return np.frombuffer(held, f"<u{memoryview(held)[0]}", offset=1)


def _spans(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every span, one span after the other."""
    ends = np.cumsum(many)
    return np.repeat(begin - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)


def _differ(third: np.ndarray, a: np.ndarray, b: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of the paired spans hold unlike arcs."""
    unlike = third[_spans(a, many)] != third[_spans(b, many)]
    out = np.zeros(len(a), bool)
    out[np.repeat(np.arange(len(a)), many)[unlike]] = True
    return out


def _summed(pairs: np.ndarray, third: np.ndarray | None, n: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Equal phrases as one with the sum of their weights, in order."""
    order = np.argsort(pairs, kind="stable") if third is None else np.lexsort((third, pairs))
    pairs, n, third = pairs[order], n[order], None if third is None else third[order]
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    if third is not None:
        new[1:] |= third[1:] != third[:-1]
    first = np.flatnonzero(new)
    return pairs[first], None if third is None else third[first], np.add.reduceat(n, first) if len(first) else n


def _of_row(table: pa.Table | pa.RecordBatch, row: int) -> Transducer:
    heads, seconds, n_pairs, state, wide, third, n_triples = (_unpacked(table.column(c), row) for c in NAMES)
    pairs = (np.cumsum(heads, dtype=np.uint64) << np.uint64(32)) | seconds.astype(np.uint64)
    arcs = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
    return Transducer(pairs, n_pairs.astype(np.int64), state.astype(np.int64), arcs, third.astype(np.int64), n_triples.astype(np.int64))


@dataclass
class _Words:
    """What a block knows of its words, by code: id, and where the word's stretch of the order begins and how long it is, and both as shares of its language."""

    ids: np.ndarray
    start: np.ndarray
    length: np.ndarray
    share_start: np.ndarray
    share: np.ndarray

    def place(self, a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
        inner = self.share_start[b] if c is None else self.share_start[b] + self.share[b] * self.share_start[c]
        return self.start[a] + self.length[a] * inner


def _ordered_words(entries: DataFrame, least: int) -> tuple[DataFrame, dict]:
    """part, word, n, id, start (occurrences of words before) of all words of `least` occurrences; and for each part all occurrences and theirs.

    Words are sorted by ranges of part and word; the driver gets a row of sums for each range of at least a million words.
    """
    spark = entries.sparkSession
    counts, path = settled(entries.groupBy("part", "word").agg(F.sum("n").alias("n")))
    parts = {r["part"]: (r["n"], r["f"]) for r in counts.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") >= least, F.col("n")).otherwise(0)).alias("f")).collect()}
    often = counts.filter(F.col("n") >= least)
    ranges = max(1, often.count() >> 20)
    cut, cut_path = settled(often.repartitionByRange(ranges, "part", "word").withColumn("range", F.spark_partition_id()))
    before_id, before = {}, {}
    n_id = n = 0
    for r in sorted(cut.groupBy("range").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect(), key=lambda r: r["range"]):
        before_id[r["range"]], before[r["range"]] = n_id, n
        n_id, n = n_id + r["k"], n + r["n"]
    offsets = spark.createDataFrame([(k, before_id[k], before[k]) for k in before], "range int, ids long, occurrences long")
    upto = Window.partitionBy("range").orderBy("part", "word").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("id", F.count("*").over(upto)).withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    rows = rows.join(F.broadcast(offsets), "range").select("part", "word", "n", (F.col("id") + F.col("ids")).alias("id"), (F.col("start") + F.col("occurrences")).alias("start"))
    made, _ = settled(rows)
    if n_id >= 1 << 32:
        raise ValueError(f"{n_id} frequent words: ids go up to 2**32")
    forget(spark, path, cut_path)
    return made, parts


def collocations(df: DataFrame, text_col: str = "text", part_col: str = "lang", least: int = LEAST, swallow: int = SWALLOW, best: int = BEST, range_tokens: int = RANGE_TOKENS, run_tokens: int = RUN) -> DataFrame:
    """part_col, rank, phrase, a, l, r, n, score: the `best` candidates of each part; see the module."""
    spark = df.sparkSession
    texts = df.select(F.lit(0).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("und")).alias("part"))
    corpus = coded(texts, _tokens, "id", "text", "part", unseen=(_GAP, _END))
    often, parts = _ordered_words(corpus.entries, least)
    total = sum(f for _, f in parts.values())
    ranges = max(1, -(-total // range_tokens))
    # A part has a row here; the parts, such as languages, are names in a column of the corpus, so their rows go by a join.
    ends, firsts = {}, 0
    for part in sorted(parts):
        ends[part], firsts = firsts, firsts + parts[part][1]
    sizes = spark.createDataFrame([(p, ends[p], max(parts[p][1], 1), parts[p][0]) for p in parts], "part string, part_start long, part_size long, part_n long")
    placed = often.join(sizes, "part").select("part", "word", "id", "start", "n", "part_n", ((F.col("start") - F.col("part_start")) / F.col("part_size")).alias("share_start"), (F.col("n") / F.col("part_size")).alias("share"))
    placed, _ = settled(placed)
    known = corpus.entries.select("block", "code", "part", "word").join(placed, ["part", "word"]).select("block", "code", "id", "start", "n", "share_start", "share")
    # Shards go to their ranges straight from the tasks that make them; a lost executor costs its blocks anew.
    shards = corpus.blocks.select("block", "lengths", "codes").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_shards(total, ranges, run_tokens), f"range long, kind int, {COLUMNS}")
    unions, _ = settled(shards.groupBy("range", "kind").applyInArrow(_union(least), f"range long, kind int, {COLUMNS}"))
    forget(spark, corpus.path)
    out = _ranked(unions, placed, total, ranges, swallow, best)
    return out.withColumnRenamed("part", part_col)


def _shards(total: int, ranges: int, run_tokens: int):
    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        """A block's transducers: of pairs (kind 2) and of triples (kind 3), cut by prefix ranges."""
        rows: list[tuple] = []
        if blocks.num_rows and words.num_rows:
            code = words["code"].to_numpy()
            size = int(code.max()) + 1
            spread = lambda name, kind: _at(code, words[name].to_numpy(), size, kind)
            known = _Words(_at(code, words["id"].to_numpy() + 1, size, np.int64) - 1, *(spread(c, np.float64) for c in ("start", "n", "share_start", "share")))
            codes, lengths = numbers(blocks["codes"], 0, "<i4"), np.array(blocks["lengths"][0].as_py())
            # Ends of pieces stay in the sequence as -1, as do words that aren't frequent: no phrase goes across. Gaps go, unless a text ends with one.
            last = np.zeros(len(codes), bool)
            last[np.cumsum(lengths) - 1] = True
            frequent = np.concatenate([known.ids >= 0, np.zeros(max(0, int(codes.max(initial=0)) + 1 - size), bool)])
            stays = (codes != -1) | last
            sequence, closing = np.where((codes >= 0) & frequent[codes], codes, -1)[stays], last[stays]
            rows = list(_cut_ranges(sequence, closing, known, total, ranges, run_tokens))
            del sequence, closing, frequent, stays, last, codes
            pa.default_memory_pool().release_unused()
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), *[pa.binary()] * 7], strict=True)], names=["range", "kind", *NAMES])

    return run


def _at(code: np.ndarray, values: np.ndarray, size: int, kind: type) -> np.ndarray:
    out = np.zeros(size, kind)
    out[code] = values
    return out


def _cut_ranges(sequence: np.ndarray, closing: np.ndarray, known: _Words, total: int, ranges: int, run_tokens: int) -> Iterator[tuple]:
    """Rows of a block: the transducer is built run by run of the sequence, each run adding its sorted n-grams."""
    pair_weights, triple_weights = Transducer.empty(), Transducer.empty()
    code_of = np.argsort(known.ids, kind="stable")[np.count_nonzero(known.ids < 0) :]
    ordered = known.ids[code_of]
    for at in range(0, len(sequence), run_tokens):
        part = sequence[at : at + run_tokens + 2]
        open_ = ~closing[at : at + run_tokens + 2]
        here = min(run_tokens, len(part))
        two = np.flatnonzero((part[:-1] >= 0) & (part[1:] >= 0) & open_[:-1])
        two = two[two < here]
        three = two[(two + 2 < len(part))]
        three = three[(part[three + 2] >= 0) & open_[three + 1]]
        pair = _pair(known.ids, part[:-1], part[1:])
        nothing = np.zeros(0, np.int64)
        pair_weights = pair_weights.plus(pair[two], np.ones(len(two), np.int64), np.zeros(0, np.uint64), nothing, nothing)
        heads = np.unique(pair[three])
        triple_weights = triple_weights.plus(heads, np.zeros(len(heads), np.int64), pair[three], known.ids[part[three + 2]], np.ones(len(three), np.int64))
    for kind, made in ((2, pair_weights), (3, triple_weights)):
        if not len(made.pairs):
            continue
        a, b = (code_of[np.searchsorted(ordered, x.astype(np.int64))] for x in (made.pairs >> np.uint64(32), made.pairs & np.uint64(0xFFFFFFFF)))
        owner, third = made.triples()
        many = np.diff(made.arcs)
        if kind == 2:
            yield from _rows(made, np.minimum(known.place(a, b) * (ranges / total), ranges - 1).astype(np.int64), kind, many)
        else:
            c = code_of[np.searchsorted(ordered, third)]
            place = np.minimum(known.place(a[owner], b[owner], c) * (ranges / total), ranges - 1).astype(np.int64)
            # A pair whose triples go to several ranges stands in each of them.
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])])
            first = np.flatnonzero(new)
            split = Transducer.of(made.pairs[owner[first]], np.zeros(len(first), np.int64), np.cumsum(new) - 1, third, made.n_triples)
            yield from _rows(split, place[first], kind, np.diff(split.arcs))


def _pair(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (ids[a].astype(np.uint64) << np.uint64(32)) | (ids[b].astype(np.uint64) & np.uint64(0xFFFFFFFF))


def _rows(made: Transducer, place: np.ndarray, kind: int, many: np.ndarray) -> Iterator[tuple]:
    """A row for each stretch of pairs in one range."""
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    paths = np.concatenate([[0], np.cumsum(many[made.state])])
    for start, stop in zip(first, [*first[1:], len(place)], strict=True):
        yield (int(place[start]), kind, *made.cut(start, stop, paths[start], paths[stop], many))


def _union(least: int):
    def run(table: pa.Table) -> pa.Table:
        """The union of a range's transducers, without phrases of fewer than `least` occurrences."""
        kind = table["kind"][0].as_py()
        parts = [_of_row(table, k) for k in range(table.num_rows)]
        paths = [p.triples() for p in parts]
        join = lambda each, t: np.concatenate([np.asarray(x, t) for x in each])
        if kind == 2:
            pairs, _, n = _summed(join([p.pairs for p in parts], np.uint64), None, join([p.n_pairs for p in parts], np.int64))
            kept = n >= least
            made = Transducer.of(pairs[kept], n[kept], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        else:
            heads, third, n = _summed(join([p.pairs[o] for p, (o, _) in zip(parts, paths, strict=True)], np.uint64), join([t for _, t in paths], np.int64), join([p.n_triples for p in parts], np.int64))
            heads, third, n = (x[n >= least] for x in (heads, third, n))
            pairs = np.unique(heads)
            made = Transducer.of(pairs, np.zeros(len(pairs), np.int64), np.searchsorted(pairs, heads), third, n)
        many = np.diff(made.arcs)
        columns = [[table["range"][0].as_py()], [kind], *([c] for c in made.cut(0, len(made.pairs), 0, len(made.n_triples), many))]
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), *[pa.binary()] * 7], strict=True)], names=["range", "kind", *NAMES])

    return run


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All phrases of transducers, as rows of ids."""
    for batch in batches:
        for k in range(batch.num_rows):
            made = _of_row(batch, k)
            owner, third = made.triples()
            triples = batch.column("kind")[k].as_py() == 3
            pairs, n = (made.pairs[owner], made.n_triples) if triples else (made.pairs, made.n_pairs)
            ids = [pa.array((pairs >> np.uint64(32)).astype(np.int64)), pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(third, pa.int64()) if triples else pa.nulls(len(n), pa.int64()), pa.array(n.astype(np.int64))], names=["w1", "w2", "w3", "a"])


def _looked_up(transducers: pa.Table, asked: pa.Table) -> pa.Table:
    """The questions with the weight of their pair, by composition with the range's transducer."""
    made = _of_row(transducers, 0) if transducers.num_rows else Transducer.empty()
    pairs = (asked["p1"].to_numpy().astype(np.uint64) << np.uint64(32)) | asked["p2"].to_numpy().astype(np.uint64)
    return asked.select(["w1", "w2", "w3", "a", "cut"]).append_column("n", pa.array(made.compose(pairs), pa.int64()))


def _ranked(unions: DataFrame, placed: DataFrame, total: int, ranges: int, swallow: int, best: int) -> DataFrame:
    phrases, _ = settled(unions.mapInArrow(_phrases, "w1 long, w2 long, w3 long, a long"))
    words, pairs = placed.select("part", "id", "word", F.col("n").alias("f"), "part_n", "start", "share_start", "share"), phrases.filter("w3 is null").drop("w3")
    triples = phrases.filter("w3 is not null")
    # The parts of three words: the first two and the last two, each asked of the range where that pair is kept.
    questions = F.array(F.struct(F.lit(1).alias("cut"), F.col("w2").alias("p1"), F.col("w3").alias("p2")), F.struct(F.lit(2).alias("cut"), F.col("w1").alias("p1"), F.col("w2").alias("p2")))
    asked = triples.select("w1", "w2", "w3", "a", F.inline(questions))
    first, second = words.select(F.col("id").alias("p1"), "start", "f"), words.select(F.col("id").alias("p2"), "share_start")
    place = F.least((F.col("start") + F.col("f") * F.col("share_start")) * F.lit(ranges / total if total else 0.0), F.lit(ranges - 1.0)).cast("long")
    asked = asked.join(first, "p1").join(second, "p2").select(place.alias("range"), "w1", "w2", "w3", "a", "cut", "p1", "p2")
    answers = unions.filter("kind = 2").groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(_looked_up, "w1 long, w2 long, w3 long, a long, cut int, n long")
    cuts = answers.groupBy("w1", "w2", "w3", "a").agg(F.max(F.when(F.col("cut") == 1, F.col("n"))).alias("behind"), F.max(F.when(F.col("cut") == 2, F.col("n"))).alias("front"))
    # A pair goes if one of the triples around it has enough of its occurrences.
    around = triples.select("a", F.inline(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    left = pairs.join(around, ["w1", "w2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < swallow * F.col("a")))
    rows = left.select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a", F.lit(None).cast("long").alias("behind"), F.lit(None).cast("long").alias("front")).unionByName(cuts)
    for k in (1, 2, 3):
        known = words.select(F.col("id").alias(f"w{k}"), F.col("word").cast("string").alias(f"t{k}"), F.col("f").alias(f"f{k}"), *(["part", "part_n"] if k == 1 else []))
        rows = rows.join(known, f"w{k}", "left" if k == 3 else "inner")
    rows = rows.select("part", "part_n", "a", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), F.col("f1").alias("l1"), F.coalesce("behind", "f2").alias("r1"), F.col("front").alias("l2"), F.when(F.col("w3").isNotNull(), F.col("f3")).alias("r2"))
    for k in (1, 2):
        rows = rows.withColumn(f"s{k}", F.expr(f"(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000000BD) div (cast(l{k} as decimal(19,0)) * cast(r{k} as decimal(19,0)))"))
    second = F.col("s2") < F.col("s1")
    rows = rows.select("part", "phrase", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.col("part_n").alias("n"), F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))
    order = Window.partitionBy("part").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select("part", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
