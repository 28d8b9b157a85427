"""License scans: exact phrases and fuzzy short notices.

A text is lower-cased (A-Z) and reduced to its words, joined by single spaces. Exact phrases are looked up word
by word. A fuzzy notice may have up to its number of errors (insertions, deletions, substitutions): it is split
into one more seed than that, so at least one seed occurs unchanged in any hit (pigeonhole); an Aho-Corasick
automaton finds the seeds of all notices in one pass, and the regex library's bounded-error matching decides
inside the window around each cluster of seeds, which is little longer than the notice, and gives the span and the
number of errors. Of a notice's matches that overlap the one with fewest errors stays, the first on ties, so a text's time
grows with its length and its number of seeds, whatever it repeats.

Null texts are empty; texts without words have no hits; whole texts are searched, and rows one by one, so
repeated rows and ties get equal results and empty tables no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import sliced

#: Bytes of texts handled at a time inside a task.
SLICE_BYTES = 4 << 20
#: Windows of text whose matches a worker remembers.
MEMO = 20_000
#: Exact phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices: label, words, errors allowed.
NOTICES = (
    ("mit", "mit license", 1),
    ("apache", "apache license", 2),
    ("gpl", "general public license", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    ("apache", "licensed under the apache license version 2 0", 5),
    ("gpl", "under the terms of the gnu general public license as published by", 7),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 8),
    ("mpl", "subject to the terms of the mozilla public license", 5),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 7),
    ("cc", "licensed under a creative commons attribution", 4),
    ("epl", "eclipse public license", 2),
    ("unlicense", "free and unencumbered software released into the public domain", 6),
)

#: Bytes of a text as words and single breaks: letters lowered, digits and bytes of other characters kept.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(text: str) -> str:
    """The words of a text, each preceded by a space, and a space at the end; empty without words."""
    words = text.encode().translate(_WORDS).split(b" ")
    joined = b" ".join(w for w in words if w)
    return f" {joined.decode()} " if joined else ""


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 parts of nearly equal length with their places."""
    cuts = [len(notice) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def breaks_before(words: str, places: list[int]) -> dict[int, int]:
    """Number of spaces before each place, counted in one pass over the text."""
    out, at, number = {}, 0, 0
    for place in sorted(set(places)):
        number += words.count(" ", at, place)
        at = place
        out[place] = number
    return out


def clusters(places: list[int], width: int):
    """The first and last of each run of sorted places that begin within `width` of the run's first."""
    k = 0
    while k < len(places):
        j = bisect.bisect(places, places[k] + width) - 1
        yield places[k], places[j]
        k = j + 1


class Scanner:
    """Finds exact phrases and notices; one for each worker."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices=NOTICES):
        self.phrases, self.notices, self.memo = phrases, notices, {}
        self.letters = [Counter(notice) for _, notice, _ in notices]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, notice, errors) in enumerate(notices):
            for at, seed in seeds(notice, errors):
                places.setdefault(seed, []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for seed, where in places.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?<= )(?:{regex.escape(notice)}){{e<={errors}}}(?= )", regex.BESTMATCH) for _, notice, errors in notices]

    def exact(self, words: str) -> list[tuple[str, int]]:
        """(label, first word) of all places of the phrases; places may overlap."""
        found = []
        for phrase, label in self.phrases.items():
            at = words.find(f" {phrase} ")
            while at >= 0:
                found.append((at, label))
                at = words.find(f" {phrase} ", at + 1)
        number = breaks_before(words, [at for at, _ in found])
        return [(label, number[at]) for at, label in found]

    def fuzzy(self, words: str) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, word after the last, errors, score) of the notices' hits."""
        begins: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(words):
            for number, at in where:
                begins.setdefault(number, set()).add(last + 1 - size - at)
        spans = []
        for number, places in begins.items():
            _, notice, errors = self.notices[number]
            matches: dict[tuple[int, int], int] = {}
            for first, last in clusters(sorted(places), errors):
                a, b = max(0, first - errors), min(len(words), last + len(notice) + errors + 1)
                if (m := self._match(number, words, a, b)) is not None:
                    matches[a + m[0], a + m[1]] = m[2]
            taken: list[tuple[int, int]] = []
            for (start, end), wrong in sorted(matches.items(), key=lambda x: (x[1], x[0])):
                k = bisect.bisect(taken, (start, end))
                if (not k or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
                    taken.insert(k, (start, end))
                    spans.append((number, start, end, wrong))
        word = breaks_before(words, [x for _, start, end, _ in spans for x in (start, end)])
        return [(self.notices[n][0], word[start] - 1, word[end], wrong, 1 - wrong / len(self.notices[n][1])) for n, start, end, wrong in sorted(spans)]

    def _match(self, number: int, words: str, a: int, b: int) -> tuple[int, int, int] | None:
        """Start and end, from a on, and errors of the best match between a and b; windows met lately are remembered."""
        key = (number, words[max(0, a - 1) : b], a > 0)
        if key not in self.memo:
            if len(self.memo) > MEMO:
                self.memo.clear()
            found = None
            # As many letters as there may be errors can be missing from the window at most.
            if (self.letters[number] - Counter(words[a:b])).total() <= self.notices[number][2]:
                m = self.patterns[number].search(words, a, b)
                found = m and (m.start() - a, m.end() - a, sum(m.fuzzy_counts))
            self.memo[key] = found
        return self.memo[key]

    def scan(self, text: str) -> dict:
        words = normalised(text)
        base = self.exact(words)
        hits = self.fuzzy(words) if words else []
        starts = [at for _, at in base]
        own = {label for label, _ in base}
        return {
            "n_words": max(0, words.count(" ") - 1), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": sorted(own), "labels": sorted(own | {h[0] for h in hits}), "score": 1.0 if base else max((h[4] for h in hits), default=0.0),
            "hits": [dict(zip(("label", "start", "end", "errors"), h, strict=False)) for h in hits],
        }


_RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
    ("score", pa.float64()), ("hits", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int64())]))),
])
_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, hits array<struct<label:string,start:bigint,end:bigint,errors:bigint>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score and hits (spans in words, with errors)."""
    made: dict[str, Scanner] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = made.setdefault("it", Scanner())
        for batch in batches:
            for start, stop, texts in sliced(batch.column(1), SLICE_BYTES):
                found = pa.array([scanner.scan(t) for t in texts], _RESULT)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *found.flatten()], names=["id", *(f.name for f in _RESULT)])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, {_SCHEMA}")
    return out.withColumnRenamed("id", id_col)
