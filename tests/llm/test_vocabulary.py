"""Spelling variants, collocations and the language model against versions without Spark."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_queries import documents, empty, folder, lower, rows  # noqa: F401  fixtures

from plantlens.llm import blocks, collocations, language_model, spelling
from plantlens.llm.catalog import QUERIES


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected_variants(words, ratio=5):
    around = defaultdict(set)
    shapes = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            shapes[w[:k] + "*" + w[k + 1 :]].add(w)
            if (shorter := w[:k] + w[k + 1 :]) in words:
                around[w].add(shorter)
                around[shorter].add(w)
    for group in shapes.values():
        for w in group:
            around[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n, len(around[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def test_op11(spark, folder, documents):  # noqa: F811
    counts = Counter()
    for i, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            word = lower(run)
            crc = zlib.crc32(f"{i}:{word}".encode())
            counts[word if crc % 199 else word[: crc % len(word)] + word[crc % len(word) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = rows(spark, folder, "op11_spelling_variants", "word", "form", "root", "n", "n_near", "form_n")
    assert got == expected_variants(words) and any(r[1] for r in got)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_variants_of_dense_words(spark, letters):
    """Words over few letters: nearly all are near others, runs of letters repeat, counts tie, and chains are long."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list(letters), rng.integers(6, 9))): int(5 ** rng.integers(1, 6)) for _ in range(150)}
    words |= {"éàüößÿ": 5, "éàüößÿÿ": 25, "éàüöß×ÿ": 125}
    counts = spark.createDataFrame(list(words.items()) + [("short", 99), ("seldomly", 4)], "word string, n long")
    assert Counter(tuple(r) for r in spelling.variants(counts).collect()) == expected_variants(words)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5), min_size=2, max_size=12, unique=True))
def test_near_words_by_hand(words):
    known = dict.fromkeys(words, 5)
    assert all(r[4] == sum(near(r[0], w) for w in words) for r in expected_variants(known))


def test_symbols_grow_with_the_vocabulary():
    assert [spelling.symbol_count(n, 6) for n in (10, 10**5, 10**7, 10**9)] == [4, 5, 11, 23]


def expected_collocations(texts, least=10, swallow=50, best=2000):
    out = Counter()
    by_part = defaultdict(list)
    for part, text in texts:
        by_part[part or "und"] += [re.findall("[^ \t]+", piece) for piece in re.split("[.,;:!?\n-\r]", lower(text or ""))]
    for part, pieces in by_part.items():
        f = Counter(p for words in pieces for k in (1, 2, 3) for p in zip(*(words[i:] for i in range(k)), strict=False))
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in kept.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        ranked = []
        for p, a in kept.items():
            if not (longer[p] and 100 * longer[p] >= swallow * a):
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(map(len, pieces))
        out.update((part, k + 1, p.decode(), -a, left, right, n, -score) for k, (score, a, p, left, right) in enumerate(sorted(ranked)[:best]))
    return out


def test_op12(spark, folder):  # noqa: F811
    texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text").collect()]
    got = rows(spark, folder, "op12_collocations", "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert got == expected_collocations(texts) and len({r[0] for r in got}) > 2


def test_collocations_over_many_ranges_and_runs(spark, monkeypatch):
    """Pieces, languages, null languages, runs of spaces, overlaps, and transducers built and cut in many parts."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    rng = np.random.default_rng(1)
    texts = []
    for k in range(120):
        words = rng.choice([*"abcdefgh", "a", "a", "\x01b", "é", "New  York", "x.y", "Q\tq", "c d e", " z"], rng.integers(0, 60))
        texts.append((["en", "de", None, "und"][k % 4], rng.choice([" ", "  ", "\n", ", "]).join(words)))
    texts += [("en", None), ("en", ""), ("en", " "), ("xx", "never often enough"), ("en", "a a a a " * 300)]
    df = spark.createDataFrame([(*t, 1, 2.0) for t in texts], "lang string, text string, id int, part double").repartition(3)
    got = Counter(tuple(r) for r in collocations.collocations(df, least=3, range_tokens=100, best=40, run_tokens=50).collect())
    assert got == expected_collocations(texts, least=3, best=40)


def test_exact_beyond_64_bits(spark):
    """The score's products at counts of 1e13."""
    a, left, right = 9_000_000_000_001, 9_876_543_210_987, 9_999_999_999_999
    row = spark.range(1).selectExpr(f"(cast({a} as decimal(19,0)) * cast({a} as decimal(19,0)) * 1000000BD) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0))) s").first()
    assert row.s == 1_000_000 * a * a // (left * right)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3)), max_size=30), min_size=1, max_size=4))
def test_transducer(shards):
    """Unions of transducers hold the sums of all phrases, share states with equal arcs, and survive being cut and written."""
    made, want, pair_want = collocations.Transducer.empty(), Counter(), Counter()
    for shard in shards:
        want.update(shard)
        pair_want.update(t[:2] for t in shard)
        rows = np.array(shard, np.uint64).reshape(-1, 3)
        pairs = (rows[:, 0] << np.uint64(32)) | rows[:, 1]
        made = made.plus(pairs, np.ones(len(rows), np.int64), pairs, rows[:, 2].astype(np.int64), np.ones(len(rows), np.int64))
    owner, third = made.triples()
    split = lambda p: (int(p) >> 32, int(p) & 0xFFFFFFFF)
    assert {(*split(made.pairs[o]), int(t)): int(n) for o, t, n in zip(owner, third, made.n_triples, strict=True)} == want
    assert {split(p): int(n) for p, n in zip(made.pairs, made.n_pairs, strict=True)} == pair_want
    arcs = [tuple(made.third[a:b]) for a, b in zip(made.arcs[:-1], made.arcs[1:], strict=True)]
    assert len(set(arcs)) == len(arcs)
    whole = made.cut(0, len(made.pairs), 0, len(made.n_triples), np.diff(made.arcs))
    again = collocations._of_row(pa.table({c: pa.array([x], pa.binary()) for c, x in zip(collocations.NAMES, whole, strict=True)}), 0)
    assert all(np.array_equal(getattr(again, f), getattr(made, f)) for f in ("pairs", "n_pairs", "n_triples")) and np.array_equal(again.triples(), made.triples())
    asked = [(a, b) for a in range(5) for b in range(5)]
    assert made.compose(np.array([(a << 32) | b for a, b in asked], np.uint64)).tolist() == [pair_want[p] for p in asked]


def tokens(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())] + [None]


def test_op13(spark, folder, documents):  # noqa: F811
    apart = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in documents if not apart(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in documents:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens(t))
        want[i, apart(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(base, 3)] += 1
    got = QUERIES["op13_language_model"](spark, folder).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    held = [r for r in got if r.held_out and r.doc_id < 10_000_000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # Equal texts have equal scores.
    texts, scores = defaultdict(set), defaultdict(set)
    for i, t in documents:
        texts[t].add(i)
    for r in got:
        scores[r.doc_id].add(round(r.score, 4))
    ids = Counter(i for i, _ in documents)
    assert all(len(set.union(*(scores[i] for i in group if ids[i] == 1), set())) <= 1 for group in texts.values())


def test_language_model_is_a_distribution():
    """Class probabilities add up to one after any context; the score of a text is the product by the formulas, place by place."""
    m = language_model
    model = m.Model.new(np.arange(m.CLASSES, dtype=float), seed=8)
    model.mix = np.random.default_rng(2).standard_normal(model.mix.shape).astype(np.float32)
    for pair in ((0, 5), (m.START, m.START), (7, m.START)):
        context = np.tile(np.array(pair, np.int16)[:, None], m.CLASSES)
        assert (10 ** model.log10(context, np.arange(m.CLASSES))).sum() == pytest.approx(1, abs=1e-5)
    classes, lengths = np.array([3, 4, 0, 0, 9, 9, 0], np.int16), np.array([3, 1, 3])
    want = []
    for text in ([3, 4, 0], [0], [9, 9, 0]):
        a = b = m.START
        for c in text:
            q = model.read[a].astype(float) * model.mix[0] + model.read[b].astype(float) * model.mix[1]
            s = model.write.astype(float) @ q + model.bias
            want.append((s[c] - np.log(np.exp(s).sum())) / np.log(10))
            a, b = c, a
    assert model.log10(m.contexts(classes, lengths), classes) == pytest.approx(want, abs=1e-4)


def test_noise_contrastive_training_learns_a_grammar():
    """In sequences where each class has one of two successors, training nears the entropy of one bit."""
    m = language_model
    rng = np.random.default_rng(0)
    classes = [0]
    for _ in range(60_000):
        classes.append((classes[-1] * 2 + 1 + int(rng.integers(2))) % 16)
    classes = np.array(classes, np.int16)
    counts = np.bincount(classes, minlength=m.CLASSES)
    share = (counts + 0.5) / (counts + 0.5).sum()
    model, at = m.Model.new(counts), m.contexts(classes, np.array([len(classes)]))
    before = -model.log10(at, classes).mean() / np.log10(2)
    model.train(at, classes, share, m.WARM_RATE, 1, passes=8)
    after = -model.log10(at, classes).mean() / np.log10(2)
    assert before > 3.5 and after < 1.3


def test_models_are_averaged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(language_model, "FAN_IN", 3)
    models = [(k, k + 1, np.full(4, k, "<f4").tobytes()) for k in range(20)]
    got = language_model._averaged(spark.createDataFrame(models, "number long, tokens long, flat binary"))
    assert got == pytest.approx(np.full(4, sum(k * (k + 1) for k in range(20)) / sum(range(1, 21))), rel=1e-5)


def test_null_ids_and_only_held_out_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in language_model.score_texts(df).collect()) == [(False, 1, 1, 4), (False, 3, 3, 4)]
    apart = next(i for i in range(100) if language_model.held_out(i))
    row = language_model.score_texts(spark.createDataFrame([(apart, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0) and math.isfinite(row.score)
    words = spelling.count_words(spark.createDataFrame([(None, "abcdef ABCDEF"), (1, None)], "doc_id long, text string")).collect()
    assert sum(r.n for r in words) == 2


def test_blocks_meet_their_dictionaries(spark, monkeypatch):
    """Texts come back from codes and entries, whatever the blocks."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20)
    texts = [(k, t, p) for k, (t, p) in enumerate([("a b a", "x"), ("a", "y"), (None, None), ("A cé " * 30, "x"), ("", "y")])]
    made = blocks.coded(spark.createDataFrame(texts, "doc_id int, text string, part string"), lambda t: t.split(), part_col="part", counted=lambda i: i != 1)
    words = {(r.block, r.code): (r.part, bytes(r.word)) for r in made.entries.collect()}
    back = {}
    for r in made.blocks.collect():
        at = 0
        for i, part, n in zip(r.ids, r.parts, r.lengths, strict=True):
            codes = np.frombuffer(r.codes, "<i4")[at : at + n]
            back[i], at = [words[r.block, c] for c in codes], at + n
            assert all(p == part for p, _ in back[i])
    assert {i: [w for _, w in v] for i, v in back.items()} == {i: (t or "").encode().lower().split() for i, t, _ in texts}
    assert sum(r.n for r in made.entries.collect()) == 3 + 60
