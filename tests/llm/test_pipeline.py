"""The corpus pipeline against a version without Spark."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
from compare import duck
from test_joins import grams, roots
from tokenizers import Tokenizer

import corpus_pipeline
from plantlens.llm import pii, quality, toxicity


def test_pipeline_equals_brute_force(spark, sf):
    names, verdicts = duck(sf, quality.ORACLE)
    good = {r[names.index("doc_id")] for r in verdicts if r[names.index("kept")]}
    docs = {i: t for i, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall() if i in good}
    labels = dict(duckdb.sql(f"select doc_id, max(toxic) from '{sf}/labels.parquet' where toxic is not null group by 1").fetchall())
    crc = lambda x: zlib.crc32(str(x).encode())
    open_ = sorted((i for i in labels if crc(i) % 3 != 1), key=lambda i: (crc(f"sample{i}"), i))
    sample = [i for c, n in ((1, toxicity.SAMPLE), (0, 3 * toxicity.SAMPLE)) for i in [j for j in open_ if labels[j] == c][:n] if docs.get(i) is not None]
    sample.sort(key=lambda i: (i, docs[i]))
    assert sum(len(docs[i].encode()) for i in sample) <= toxicity.SAMPLE_BYTES
    model = toxicity.fit([docs[i] for i in sample], [labels[i] for i in sample])
    scores = toxicity.Scorer(model)([t or "" for t in docs.values()]) if model else np.zeros(len(docs))
    assert (np.abs(scores - toxicity.CUTOFF) > 1e-4).all()
    docs = {i: t for (i, t), s in zip(docs.items(), scores, strict=True) if s < toxicity.CUTOFF}
    sets = {i: grams(t) for i, t in docs.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    first = roots(list(sets), links)
    docs = {i: pii.redacted(t, pii.spans(t)) for i, t in docs.items() if first[i] == i}
    assert not any(re.search(r"[a-z]@[a-z]+\.[a-z]", t) for t in docs.values())
    exact = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in docs.items():
        ids = np.array([*exact.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[i, k] = (at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = [a + n for a, n in sorted(b)]
        assert [a for a, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= 1.05 * sum(v[1] for v in want.values()) / 2048 + 2


def test_stages_keep_columns_and_odd_rows(spark, sf, odd_docs):
    docs = odd_docs.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        made = stage(spark, docs, sf)
        assert made.columns == list(corpus_pipeline.COLUMNS) and made.count() > 0
    assert corpus_pipeline.pack(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.keep_good(spark, docs, sf).columns == list(corpus_pipeline.COLUMNS)
