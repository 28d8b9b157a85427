"""The named methods decide: ablations, brute force of fuzzy matches, held-out figures, rows that repeat ids."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from plantlens.llm import html_text, license_scan, toxicity, vector_dedup


def plain(page):
    """A page without semantic elements, classes, ids and roles."""
    page = re.sub(r"<(/?)(?:article|main|nav|footer|aside|header|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_html_tree_reads_words_links_and_neighbours(spark, sf):
    tree = html_text.train()
    used = {html_text.FEATURES[f] for f in tree.feature if f >= 0}
    assert {"words", "link_share", "words_before", "words_after"} <= used
    pages = [plain(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    inside = lambda page: "\n\n".join(b.text for b in html_text.blocks(page) if b.marks[0])
    gold = [inside(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sum(html_text.main_text(p, tree) == g for p, g in zip(pages, gold, strict=True)) >= 0.95 * len(pages)

    def ablated(names):
        columns = [html_text.FEATURES.index(n) for n in names]
        out = []
        for page in pages:
            x = html_text.features(html_text.blocks(page))
            whole = tree.predict(x) >= 0.5
            x[:, columns] = 0
            out.append((whole != (tree.predict(x) >= 0.5)).any())
        return sum(out)

    assert ablated(["link_share"]) > 0.9 * len(pages)
    assert ablated(["words_before", "link_share_before", "words_after", "link_share_after"]) > 0.9 * len(pages)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_notices_equal_edit_distance():
    scanner, rng = license_scan.Scanner(), random.Random(8)
    for _ in range(150):
        label, notice, errors = rng.choice([n for n in license_scan.NOTICES if len(n[1]) < 40])
        letters = list(notice)
        for _ in range(rng.randint(0, errors + 2)):
            at = rng.randrange(len(letters))
            letters[at : at + rng.randint(0, 1)] = [rng.choice("abz ")] if rng.random() < 0.7 else []
        words = (" ".join(rng.choice(["of", "use", "it", "gen"]) for _ in range(3)) + " " + "".join(letters) + " the end").split()
        got = {h["label"] for h in scanner.scan(" ".join(words))["hits"]}
        want = {n[0] for n in license_scan.NOTICES for a in range(len(words)) for b in range(a + 1, len(words) + 1) if abs(len(" ".join(words[a:b])) - len(n[1])) <= n[2] and distance(" ".join(words[a:b]), n[1]) <= n[2]}
        assert got == want, " ".join(words)


def test_license_spans_and_time():
    scanner = license_scan.Scanner()
    hits = scanner.scan("generl pubic license x general public license")["hits"]
    assert [(h["label"], h["start"], h["end"], h["errors"]) for h in hits] == [("gpl", 0, 3, 2), ("gpl", 4, 7, 0)]
    took = []
    for n in (4_000, 32_000):
        began = time.process_time()
        assert scanner.scan("mit license general public " * n)["n_base"] == n
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0]  # eight times the text; a quadratic scan takes 64 times as long


def test_toxicity_needs_words_and_characters():
    rng = random.Random(9)
    common = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    bad = ["grumbo", "zaxxil", "worblet"]
    make = lambda toxic, more: " ".join(rng.choice(more) if toxic and rng.random() < 0.05 else rng.choice(common) for _ in range(rng.randint(40, 300)))
    data = [(make(k % 4 == 0, bad), int(k % 4 == 0)) for k in range(800)]
    model = toxicity.fit([t for t, _ in data], [y for _, y in data])
    held = [(make(k % 4 == 0, bad), int(k % 4 == 0)) for k in range(200)]

    def figures(m):
        hit = toxicity.Scorer(m)([t for t, _ in held]) >= toxicity.CUTOFF
        y = np.array([y for _, y in held])
        return hit[y == 1].mean(), hit[y == 0].mean()

    recall, false = figures(model)
    assert recall >= 0.9 and false <= 0.02
    without = toxicity.Model({}, model.weights)  # no word has an embedding of its own
    assert figures(without)[0] < recall
    grams = toxicity.Model(model.words, model.weights | {"gram_rows": model.weights["gram_rows"] * 0})
    texts = [t for t, _ in held]
    assert np.abs(toxicity.Scorer(model)(texts) - toxicity.Scorer(grams)(texts)).max() > 0.01
    assert "odds" not in open(toxicity.__file__).read()


def test_shared_folder_and_settled_frames(spark, tmp_path):
    from types import SimpleNamespace

    from plantlens.llm import common

    none = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master=master, applicationId="a")))
    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    frame, path = common.settled(spark.range(5))
    assert frame.count() == 5
    common.forget(spark, path)
    with pytest.raises(Exception, match="(?i)not.*exist|PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_cut_between():
    logit, y = np.array([-3.0, -2.0, -1.0, 1.0, 2.0]), np.array([0, 0, 0, 1, 1])
    assert toxicity.cut_between(logit, y) == pytest.approx(0.0)
    assert toxicity.cut_between(logit, y * 0) == pytest.approx(np.log(0.7 / 0.3))


def test_rows_that_repeat_an_id(spark, sf):
    a = " ".join(f"w{k}" for k in range(60))
    near, other, third = a.replace("w3 ", "x "), " ".join(f"v{k}" for k in range(70)), " ".join(f"u{k}" for k in range(80))
    rows = [(1, a), (2, near), (2, other), (3, third), (3, third), (4, ""), (4, ""), (None, near)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_distinct(spark, docs, sf).collect())
    assert kept == Counter({(None, near): 1, (2, other): 1, (3, third): 1, (4, ""): 2})
    vectors = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.1]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = Counter(tuple(r) for r in vector_dedup.near_duplicates(vectors).collect())
    assert got == Counter({(5, 2, 5, True): 2, (6, 2, 5, False): 1, (7, 0, 7, True): 1})


def test_stages_on_odd_rows(spark, sf, odd_docs):
    docs = odd_docs
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:4], (None, 0, None, 0), strict=True):
        made = stage(spark, docs, sf)
        assert made.columns == list(corpus_pipeline.COLUMNS), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        if gone is not None:
            assert made.count() == odd_docs.count() - gone, name
    assert {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, sf).collect()} <= {5}
    redacted = {r.doc_id: r.text for r in corpus_pipeline.hide_personal(spark, docs, sf).collect() if r.doc_id in (0, 1, 5)}
    assert redacted == {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id in (0, 1, 5)}
