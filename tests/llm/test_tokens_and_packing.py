from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from plantlens.llm import bpe, packing

RANKS, JSON, WORD = (P.path(f) for f in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(3)
    letters = "ab cD.,'ts\n\t é日 0<|endoftext|>!-İ \x1c"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    words = ["the", "The", "end.", "stop,", "don't", "it's", "x.y", "<|endoftext|>.", "naïve", "é.", "..", "a,b"]
    return made + [" ".join(rng.choice(words) for _ in range(12)).replace(" x", "\nx") for _ in range(1000)]


def test_encoding_equals_tiktoken(strings):
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.PieceCoder(bpe.load_tokenizer(RANKS), bpe.packed, True)(strings, b"".join)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [exact.encode_ordinary(t) for t in strings]


@pytest.mark.parametrize(("path", "spaced"), [(JSON, True), (WORD, False)])
def test_pieces_equal_whole_texts(strings, path, spaced):
    whole = [e.ids for e in Tokenizer.from_file(path).encode_batch(strings, add_special_tokens=False)]
    tokenizer = bpe.load_tokenizer(path)
    got = bpe.PieceCoder(tokenizer, bpe.packed, spaced)(strings, b"".join)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == whole
    assert bpe.PieceCoder(tokenizer, len, spaced)(strings, sum) == [len(w) for w in whole]


def test_cuts_at_letters_equal_whole_texts():
    """All pairs of Latin-1 characters, alone and inside words, and short texts full of contractions, accents and odd white space."""
    rng, latin = random.Random(7), list(map(chr, range(256)))
    texts = [a + b for a in latin for b in latin] + [" ".join(f"s{a}{b}t" for b in latin) for a in latin]
    letters = "'''  \n\t\x1c\x85\xa0aAsStTrReEvVmMlLdDéÉµªº²½×÷ß.,&<|>1-_"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    texts += ["", "", "é<|endoftext|>É", "<|ENDOFTEXT|>", "don\u2019t", "e\u0301A", "İS", "ΣΑΣ.", "x" * 5000 + "Y" * 5000]
    coder = bpe.PieceCoder(bpe.load_tokenizer(WORD), bpe.packed, False)
    whole = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert coder.by_words and [np.frombuffer(g, "<u4").tolist() for g in coder(texts, b"".join)] == whole
    assert coder([], b"".join) == [] and coder([""], b"".join) == [b""] and max(map(len, coder.later)) <= bpe.MEMO_CHARS


def test_a_word_is_one_piece_in_any_guise():
    coder = bpe.PieceCoder(bpe.load_tokenizer(WORD), bpe.packed, False)
    coder(["Été, ÉTÉ!! (été) été&&&", "1.Été's"], b"".join)
    assert set(coder.later) == {"été", ",", "!!", "(", ")", "&&&", "1.", "'s"}


def test_other_splittings_are_not_cut_at_letters(strings):
    from tokenizers import Regex, pre_tokenizers

    tokenizer = bpe.load_tokenizer(WORD)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"\S+"), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    coder = bpe.PieceCoder(tokenizer, bpe.packed, False)
    texts = ["don't it's (now) é&&& 1a", *(s for s in strings if not any(m in s for m in ".,"))]
    whole = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert not coder.by_words and [np.frombuffer(g, "<u4").tolist() for g in coder(texts, b"".join)] == whole


def test_memo_is_bounded(strings, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    coder = bpe.PieceCoder(bpe.load_tokenizer(JSON), bpe.packed, True)
    once = coder(strings[:200], b"".join)
    assert coder(strings[:200], b"".join) == once and len(coder.later) < 2000


def test_round_trip_and_offsets(spark, odd_docs, no_docs):
    coded = bpe.encode(odd_docs, RANKS, offsets=True)
    rows = coded.collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id != 7}
    for r in rows:
        if r.doc_id in texts:
            text, spans = texts[r.doc_id] or "", np.frombuffer(r.offsets, "<u4").reshape(-1, 2)
            assert len(spans) == len(r.ids) // 4
            if len(spans):
                assert spans[0, 0] == 0 and spans[-1, 1] == len(text) and (spans[:, 1] > spans[:, 0]).all()
    back = {r.doc_id: r for r in bpe.decode(coded, RANKS, text=True).collect()}
    assert all(bytes(back[k].decoded) == (t or "").encode() and back[k].decoded_text == (t or "") for k, t in texts.items())
    assert len(rows) == odd_docs.count() and bpe.encode(no_docs, RANKS).count() == 0
    cut = spark.createDataFrame([(1, bytes(bpe.packed(bpe.load_tokenizer(RANKS).encode("日"))[:4]))], "doc_id long, ids binary")
    assert "�" in bpe.decode(cut, RANKS, text=True).first().decoded_text


def test_counts(odd_docs, no_docs):
    exact = Tokenizer.from_file(JSON)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = Counter((k, len((t or "").encode()), len(exact.encode(t or "", add_special_tokens=False).ids)) for k, t in rows)
    assert Counter(map(tuple, bpe.count_tokens(odd_docs, JSON).select("doc_id", "n_bytes", "n_tokens").collect())) == want
    assert bpe.count_tokens(no_docs, JSON).count() == 0
    assert bpe.count_tokens(odd_docs, P.path("piece_bpe_32k.model")).count() == odd_docs.count()


def filled(runs):
    bins = defaultdict(list)
    for size, _, n, first, at in runs:
        for k in range(n):
            bins[first + k].append((at, size))
    return bins


@pytest.mark.parametrize("kind", ["wide", "small", "one size", "large", "single"])
def test_plan(kind):
    rng = np.random.default_rng(4)
    sizes = {"wide": rng.integers(1, 2049, 5000), "small": rng.integers(1, 90, 4000), "one size": np.full(3000, 700), "large": rng.integers(1100, 2049, 500), "single": np.array([2048])}[kind]
    counts = Counter(sizes.tolist())
    bins = filled(packing.plan(dict(counts)))
    assert Counter(s for b in bins.values() for _, s in b) == counts
    for b in bins.values():
        ends = [a + s for a, s in sorted(b)]
        assert [a for a, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048
    bound = {"one size": 1500, "large": 500}.get(kind, -(-int(sizes.sum()) // 2048))
    assert len(bins) <= 1.02 * bound + 2


@pytest.mark.parametrize(("counts", "most"), [({1400: 1000, 150: 4000}, 1000), ({1400: 1000, 150: 4002, 40: 999}, 1001), ({2000: 300, 7: 1803}, 301), ({700: 999, 1300: 500, 90: 5000}, 899)])
def test_plan_with_a_hot_small_size(counts, most):
    bins = filled(packing.plan(counts))
    assert Counter(s for b in bins.values() for _, s in b) == counts
    for b in bins.values():
        ends = [a + s for a, s in sorted(b)]
        assert [a for a, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= most


def test_pack(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs, WORD).collect()
    exact = Tokenizer.from_file(WORD)
    want = Counter((r.doc_id, len(exact.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in odd_docs.collect() if r.doc_id != 7)
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert all(total[k] == n for k, n in want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = [a + s for a, s in sorted(b)]
        assert [a for a, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert packing.pack(no_docs, WORD).count() == 0


def test_hot_sizes_meet_few_runs():
    """With as many empty documents as there can be, a piece is still held against about one run: comparisons follow the pieces."""
    rng = np.random.default_rng(2)
    sizes = np.clip(rng.lognormal(5.5, 1.2, 100_000).astype(int), 1, 2048)
    counts = Counter(sizes.tolist())
    counts[1] += 60_000
    runs = sorted(packing.plan(dict(counts)))
    width, pairs = packing.stretches(runs, counts)
    assert sum(size == 1 for size, *_ in runs) > 1000 and pairs < 2 * len(runs)
    held = Counter()
    for size, rank, n, _, _ in runs:
        for k in range(rank // width[size], (rank + n - 1) // width[size] + 1):
            held[size, k] += 1
    compared = sum(n * min(width[size], counts[size] - k * width[size]) for (size, k), n in held.items())
    assert compared <= 3 * sum(counts.values())


def test_pack_rows_that_repeat_an_id(spark):
    """A hot id: all its rows are placed, also beside thousands of equal and of empty ones."""
    df = spark.range(6000).selectExpr("1 doc_id", "case when id % 3 = 0 then null when id % 3 = 1 then 'the same text' else repeat('a few more words ', cast(id % 50 as int)) end text", "'x' salt", "2 width")
    rows = packing.pack(df, WORD).collect()
    assert len(rows) == 6000
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = [a + n for a, n in sorted(b)]
        assert [a for a, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= sum(r.length for r in rows) / 2048 * 1.02 + 2


def test_plain_words_are_encoded_many_at_a_time():
    """Joined words come apart as the library encodes them one by one, whatever stands between them."""
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyzßàéîõüÿ")
    words = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(6000)] + ["don't", "naïve.", "ÀÉ", "ﬁ", "İ", "<|startoftext|>", "x<|endoftext|>y", "öx", "zz" * 60]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(400)] + words[-9:] + [""]
    exact = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    coder = bpe.PieceCoder(bpe.load_tokenizer(WORD), bpe.packed, False)
    assert coder.ends is not None
    assert coder(texts, b"".join) == [np.array(e, "<u4").tobytes() for e in exact]
    assert bpe.PieceCoder(bpe.load_tokenizer(WORD), len, False)(texts, sum) == list(map(len, exact))
