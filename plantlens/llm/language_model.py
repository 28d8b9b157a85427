"""Log-bilinear language model: trained in numpy with noise-contrastive estimation on all training tokens, scores all texts.

A token belongs to a class: each of the SHORT most frequent words and the end are classes of their own, all other words share TAILS classes by
their last two bytes. With classes a and b of the two tokens before (or the start), the model's representation is
q = C1 * r_a + C2 * r_b (element by element), and the next class c has the score q . v_c + b_c. Scores are
normalised over all classes: products of the matrix of a block's distinct contexts with the matrix of all classes give the logarithms of the sums.
A word's probability is its class's times its share of the class, by smoothed counts of the whole corpus:
(n + 0.1) / (N + 0.1 * (V + 1)), where N and V are the tokens and distinct words of the class and an unknown word has n = 0.
So the probabilities of all known words, and one unknown word for each class of rare words, add up to one.

Training starts in one task on about WARM_TOKENS tokens of documents drawn by a hash of their ids. Then every task goes once over all training
tokens of its blocks from there, and the parameters are averaged by tokens, in rounds of FAN_IN models, so that neither the driver nor a task holds
more. The noise is the classes' counted distribution; a step's positions share NOISE noise classes.

Null and empty texts are the end alone. Texts are scored whole. A null id counts as training. Rows that repeat an id are documents of their own, equal
texts get equal scores. Without training documents nothing is known: N and V are 0 and every class equally likely. Empty tables give no rows.
Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.blocks import coded, numbers
from plantlens.llm.common import forget, settled

#: Classes: words of their own, classes of the rest by their last bytes; the end is class 0.
SHORT, TAILS = 383, 128
CLASSES = 1 + SHORT + TAILS
#: In contexts, the start of a text.
START = CLASSES

#: Width of the embeddings, positions to a step, noise classes to a step and noise samples to a position that they stand for.
WIDTH, STEP, NOISE, RATIO = 32, 4096, 64, 16.0
#: Tokens and passes of the start in one task; learning rates there and afterwards; models averaged at a time.
WARM_TOKENS, WARM_PASSES, WARM_RATE, RATE, FAN_IN = 1_000_000, 3, 0.15, 0.03, 64
SMOOTH = 0.1


def held_out(name: object) -> bool:
    """Documents that are never learned from."""
    return name is not None and zlib.crc32(str(name).encode()) % 10 == 0


def _tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, then the end: the empty word."""
    return [*text.split(), b""]


@dataclass
class Model:
    """The matrices of a log-bilinear model. Contexts have one row more than classes: the start."""

    read: np.ndarray
    mix: np.ndarray
    write: np.ndarray
    bias: np.ndarray
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(class_counts: np.ndarray, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        share = (class_counts + 0.5) / (class_counts + 0.5).sum()
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return Model(small(CLASSES + 1, WIDTH), np.ones((2, WIDTH), np.float32), small(CLASSES, WIDTH), np.log(share).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.read, self.mix, self.write, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        shapes = [(CLASSES + 1, WIDTH), (2, WIDTH), (CLASSES, WIDTH), (CLASSES,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return Model(*(p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)))

    def train(self, context: np.ndarray, target: np.ndarray, noise_share: np.ndarray, rate: float, seed: int, passes: int = 1) -> None:
        """Steps of noise-contrastive estimation over all positions, in a random order, with rates by the squared gradients so far."""
        rng = np.random.default_rng(seed)
        noise_log = np.log(RATIO * noise_share).astype(np.float32)
        sums = np.cumsum(noise_share)
        squares = [np.full(p.shape, 1e-2, np.float32) for p in self.parts()]
        for _ in range(passes):
            order = rng.permutation(len(target))
            for at in range(0, len(order), STEP):
                picked = order[at : at + STEP]
                (a, b), c = context[:, picked].astype(np.int64), target[picked].astype(np.int64)
                noise = np.minimum(np.searchsorted(sums, rng.random(NOISE) * sums[-1]), CLASSES - 1)
                ra, rb, v, vn = self.read[a], self.read[b], self.write[c], self.write[noise]
                q = ra * self.mix[0] + rb * self.mix[1]
                # How far the odds of data against noise are off, for the data and for the noise.
                off = 1 / (1 + np.exp(noise_log[c] - np.einsum("ij,ij->i", q, v) - self.bias[c])) - 1
                false = (RATIO / NOISE) / (1 + np.exp(noise_log[noise] - self.bias[noise] - q @ vn.T))
                dq = off[:, None] * v + false @ vn
                d_read = _rows(np.concatenate([a, b]), np.concatenate([dq * self.mix[0], dq * self.mix[1]]), CLASSES + 1)
                d_mix = np.stack([(dq * ra).sum(0), (dq * rb).sum(0)])
                d_write = _rows(np.concatenate([c, noise]), np.concatenate([off[:, None] * q, false.T @ q]), CLASSES)
                d_bias = np.bincount(c, off, CLASSES) + np.bincount(noise, false.sum(0), CLASSES)
                for p, d, s in zip(self.parts(), (d_read, d_mix, d_write, d_bias), squares, strict=True):
                    d = (d * (1 / 64)).astype(np.float32)
                    s += d * d
                    p -= np.float32(rate) * d / np.sqrt(s)

    def log10(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The normalised log10 probability of each position's class, each distinct context being normalised once."""
        pair = context[0].astype(np.int64) * (CLASSES + 1) + context[1]
        used = np.zeros((CLASSES + 1) ** 2, bool)
        used[pair] = True
        distinct = np.flatnonzero(used)
        place = np.cumsum(used, dtype=np.int32) - 1
        q = self.read[distinct // (CLASSES + 1)] * self.mix[0] + self.read[distinct % (CLASSES + 1)] * self.mix[1]
        out = np.empty(len(target))
        norm = np.empty(len(distinct), np.float32)
        for at in range(0, len(distinct), STEP):
            scores = q[at : at + STEP] @ self.write.T + self.bias
            top = scores.max(1)
            norm[at : at + STEP] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        for at in range(0, len(target), 16 * STEP):
            where, c = place[pair[at : at + 16 * STEP]], target[at : at + 16 * STEP]
            out[at : at + 16 * STEP] = np.einsum("ij,ij->i", q[where], self.write[c]) + self.bias[c] - norm[where]
        return out / np.log(10)


def _rows(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of `values` by their place."""
    order = np.argsort(where, kind="stable")
    there = where[order]
    first = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]]))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[there[first]] = np.add.reduceat(values[order], first)
    return out


def contexts(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each position the classes one and two tokens before, START before the beginning of its text."""
    out = np.full((2, len(classes)), START, np.int16)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(classes)) - np.repeat(begins, lengths)
    out[0, 1:], out[1, 2:] = classes[:-1], classes[:-2]
    out[0, place < 1], out[1, place < 2] = START, START
    return out


def _averaged(models: DataFrame) -> np.ndarray | None:
    """The mean of the flat models by their tokens: FAN_IN models to a task, in rounds, until one is left."""
    spark = models.sparkSession
    now, path = settled(models)
    n = now.count()  # a row for each task of the pass
    while n > 1:
        groups = -(-n // FAN_IN)

        def mean(table: pa.Table) -> pa.Table:
            weight = np.array(table["tokens"].to_pylist(), np.float64)
            total = sum(w * numbers(table["flat"], k, "<f4").astype(np.float64) for k, w in enumerate(weight)) / weight.sum()
            return pa.table({"number": table["number"][:1], "tokens": pa.array([int(weight.sum())]), "flat": pa.array([total.astype("<f4").tobytes()], pa.binary())})

        dealt = now.groupBy(F.pmod(F.xxhash64("number"), F.lit(groups)).alias("group"))
        more, last = settled(dealt.applyInArrow(mean, "number long, tokens long, flat binary"))
        forget(spark, path)
        now, path, n = more, last, more.count()
    row = now.first()
    forget(spark, path)
    return np.frombuffer(row["flat"], "<f4") if row else None


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; see the module."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    corpus = coded(df, _tokens, id_col, text_col, counted=lambda name: not held_out(name))
    # Of the tokens counted: their number, the distinct ones, and both for each class of rare words.
    tail = 1 + SHORT + F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAILS)).cast("int")
    counts, counts_path = settled(corpus.entries.groupBy("word").agg(F.sum("n").alias("n")))
    top = counts.filter("n > 0 and octet_length(word) > 0").orderBy(F.desc("n"), "word").limit(SHORT).select("word").collect()
    own = spark.createDataFrame([(b"", 0), *((r["word"], 1 + k) for k, r in enumerate(top))], "word binary, own int")
    classed = counts.join(F.broadcast(own), "word", "left").withColumn("class", F.coalesce("own", tail))
    sums = {r["class"]: (r["n"], r["v"]) for r in classed.groupBy("class").agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v")).collect()}
    class_n, class_v = (np.array([sums.get(c, (0, 0))[k] for c in range(CLASSES)], np.float64) for k in (0, 1))
    total, distinct = int(class_n.sum()), int(class_v.sum())
    known = corpus.entries.select("block", "code", "word").join(classed.select("word", "n", "class"), "word").select("block", "code", "n", "class")

    def classes_of(blocks: pa.Table, words: pa.Table) -> pa.Table:
        """A block's tokens as classes, and for each document what only counts say."""
        if not blocks.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(kinds.names, kinds.types, strict=True)})
        code, n, cls = words["code"].to_numpy(), words["n"].to_numpy().astype(np.float64), words["class"].to_numpy()
        size = int(code.max()) + 1 if len(code) else 0
        count, group = np.zeros(size), np.zeros(size, np.int16)
        count[code], group[code] = n, cls
        share = np.where(group > SHORT, np.log10((count + SMOOTH) / (class_n[group] + SMOOTH * (class_v[group] + 1))), 0.0)
        base = np.log10((count + SMOOTH) / (total + SMOOTH * (distinct + 1)))
        tokens, lengths = numbers(blocks["codes"], 0, "<i4"), np.array(blocks["lengths"][0].as_py())
        begins = np.cumsum(lengths) - lengths
        known = np.add.reduceat((count > 0)[tokens].astype(np.int64), begins)
        columns = [[blocks["block"][0].as_py()], blocks["ids"].combine_chunks(), blocks["counted"].combine_chunks(), blocks["lengths"].combine_chunks(), [group[tokens].astype("<i2").tobytes()]]
        columns += [[known], [np.add.reduceat(base[tokens], begins)], [np.add.reduceat(share[tokens], begins)]]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    schema = f"block long, ids array<{id_type}>, counted array<boolean>, lengths array<int>, classes binary, known array<long>, base array<double>, share array<double>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    ready, ready_path = settled(corpus.blocks.drop("parts").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(classes_of, schema))
    forget(spark, corpus.path, counts_path)

    noise = (class_n + 0.5) / (class_n + 0.5).sum()
    model = Model.new(class_n)
    if total:
        model = _train(ready, model, noise, total)
    sent = spark.sparkContext.broadcast(model.flat())

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(sent.value)
        for batch in batches:
            for k in range(batch.num_rows):
                classes, lengths = numbers(batch.column("classes"), k, "<i2"), batch.column("lengths")[k].values.to_numpy()
                values = model.log10(contexts(classes, lengths), classes)
                lists = {c: batch.column(c)[k].values for c in ("ids", "counted", "known", "base", "share")}
                score = np.add.reduceat(values, np.cumsum(lengths) - lengths) + lists["share"].to_numpy()
                apart = [not c for c in lists["counted"].to_pylist()]
                columns = [lists["ids"], pa.array(apart), pa.array(lengths.astype(np.int64)), lists["known"], pa.array(np.full(len(lengths), total)), lists["base"], pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = ready.mapInArrow(scores, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def _positions(batch: pa.RecordBatch, k: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and classes of a block's training documents (of the `wanted` ones)."""
    classes, lengths = numbers(batch.column("classes"), k, "<i2"), batch.column("lengths")[k].values.to_numpy()
    kept = batch.column("counted")[k].values.to_numpy(zero_copy_only=False).astype(bool)
    kept = np.repeat(kept if wanted is None else kept & wanted, lengths)
    return contexts(classes, lengths)[:, kept], classes[kept]


def _train(ready: DataFrame, model: Model, noise: np.ndarray, total: int) -> Model:
    start, share = model.flat(), WARM_TOKENS / total

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids")[k].values.to_pylist()
                context, target = _positions(batch, k, np.array([zlib.crc32(f"warm{i}".encode()) < share * 2**32 for i in ids]))
                if len(target):
                    yield pa.RecordBatch.from_arrays([batch.column("block")[k : k + 1], pa.array([context.astype("<i2").tobytes()], pa.binary()), pa.array([target.astype("<i2").tobytes()], pa.binary())], names=["block", "context", "target"])

    def warm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)) or [(0, b"", b"")]
        context = np.concatenate([np.frombuffer(c, "<i2").reshape(2, -1) for _, c, _ in held], 1)
        target = np.concatenate([np.frombuffer(t, "<i2") for _, _, t in held])
        model = Model.of(start)
        model.train(context, target, noise, WARM_RATE, 5, WARM_PASSES)
        yield pa.RecordBatch.from_arrays([pa.array([model.flat().astype("<f4").tobytes()], pa.binary())], names=["flat"])

    first = np.frombuffer(ready.mapInArrow(drawn, "block long, context binary, target binary").repartition(1).mapInArrow(warm, "flat binary").first()["flat"], "<f4")
    sent = ready.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens, number = Model.of(sent.value), 0, None
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column("block")[k].as_py()
                context, target = _positions(batch, k)
                model.train(context, target, noise, RATE, block % 2**31)
                tokens, number = tokens + len(target), block if number is None else number
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([tokens]), pa.array([model.flat().astype("<f4").tobytes()], pa.binary())], names=["number", "tokens", "flat"])

    flat = _averaged(ready.mapInArrow(run, "number long, tokens long, flat binary"))
    return Model.of(first if flat is None else flat)
