from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from plantlens.llm import ngram_join, vector_dedup
from plantlens.llm.components import components


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + k, 401 + k) for k in range(60)] + [(5, 5)]
    nodes = {x for ab in links for x in ab if ab[0] != ab[1]}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(nodes, [ab for ab in links if ab[0] != ab[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return set(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else ({tuple(words)} if words else set())


@pytest.mark.parametrize("tile", [512, 8])
def test_jaccard_equals_brute_force(spark, odd_docs, no_docs, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 150))]
        if rng.random() < 0.5:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rows = [(1000 + k, t) for k, t in enumerate(texts)] + [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id not in (None, 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], "doc_id long, text string, grams string, digest binary").repartition(5)
    sets = {i: grams(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = {i: (len(sets[i]), c) for i, c in roots(list(sets), links).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == want and len(links) > 50


def test_jaccard_odd_rows(odd_docs, no_docs):
    got = ngram_join.jaccard_components(odd_docs)
    assert got.count() == odd_docs.count() and got.filter("doc_id is null and component_id is null").count() == 1
    assert ngram_join.jaccard_components(no_docs).count() == 0


@pytest.mark.parametrize("part", [256, 16])
def test_vectors_equal_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(vector_dedup, "PART", part)
    monkeypatch.setattr(vector_dedup.layout, "__defaults__", (0.9, part, 0.999))
    monkeypatch.setattr(vector_dedup, "TILE", 40)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 24))
    x = np.concatenate([base, base[:40] + 0.2 * rng.normal(size=(40, 24)), np.repeat(base[:1], 60, 0) + 0.1 * rng.normal(size=(60, 24)), base[:15], base[15:20] * 3]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] * 24), (905, [float("inf")] * 24), (906, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows + odd], "vec_id long, embedding array<float>, label int, rep string")
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = roots(range(len(x)), list(zip(*map(lambda v: v.tolist(), np.nonzero(near)))))
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    links = sum(got[k].n_links for k in want)
    assert links >= 0.97 * near.sum() and all(got[k].n_links <= near[k].sum() for k in want)
    assert sum(got[k].component_id == c for k, c in want.items()) >= 0.97 * len(want)
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k, _ in odd)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_collisions_and_calibration():
    rng = np.random.default_rng(4)
    shadow = rng.normal(size=(50, 7)).astype("<f4")
    brute = (np.abs(shadow[:, None].astype(float) - shadow[None]) <= 0.4).sum(2)
    assert (np.abs(vector_dedup.collisions(shadow, 0.4) - brute) <= 1).all()
    assert vector_dedup.layout(100) == (0, 1) and vector_dedup.layout(10**6)[0] == 12
    least = vector_dedup.least_count(16, 2.0, 0.9995)
    p = 0.9545
    hits = (rng.random((200_000, 16)) < p).sum(1)
    assert (hits >= least).mean() >= 0.999 and least > 8
    assert defaultdict(int) == {}
