"""Spelling variants among the words of a corpus, found by neighbourhoods over a reduced alphabet.

The letters of the vocabulary are hashed to a few symbols, so that every word has a reduced word of its own length. An edit of one letter changes the
reduced word by one edit at most, so each word generates the full neighbourhood of one edit around its reduced word, the
neighbourhoods are joined to the reduced words of the vocabulary, and the pairs that meet are verified on the original words. Up to symmetry
the neighbourhood is full: an insertion is the deletion of the longer word of a pair, and of two replacements that undo
each other the one that leads to the greater reduced word is generated; every pair so meets exactly once and counts for both words.

The number of symbols grows with the counted vocabulary: few symbols make short neighbourhoods and many pairs to verify, many symbols the
reverse. Letters are dealt to symbols by their counted frequency, so that symbols, and with them reduced words, are even.

Null texts count as empty and give no words; texts are read whole, whatever their length. A null id is the empty text in the check sum. Rows that repeat an id
are documents of their own. Of near words with equal counts the least in code-point order is the form. Empty tables give no rows. Only
the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import forget, settled, sliced

#: What a word is made of once A-Z are lower, and the check sum that damages one occurrence in so many.
LETTERS = "[a-zÀ-ÿ]+"
DAMAGE_EVERY = 199

#: A word needs so many code points and occurrences; a form has so many times the occurrences.
MIN_CHARS, MIN_COUNT, FORM_RATIO = 6, 5, 5

#: Words to a reduced word of the least length that choose the number of symbols; texts are cut and counts handed on by these sizes.
WORDS_A_KEY, SLICE_BYTES, HELD_WORDS = 8, 4 << 20, 400_000

SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, A-Z in lower case."""
    return re.findall(LETTERS, text.encode().lower().decode())


def damaged(word: str, crc: int) -> str:
    """A word without the letter that the check sum names, if it names one."""
    return word[: crc % len(word)] + word[crc % len(word) + 1 :] if crc % DAMAGE_EVERY == 0 else word


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n over all texts. Counts are summed up inside tasks before words are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for start, stop, texts in sliced(batch.column(1), SLICE_BYTES):
                for name, text in zip(batch.column(0).slice(start, stop - start).to_pylist(), texts, strict=True):
                    head = zlib.crc32(f"{name or ''}:".encode())
                    for word, n in Counter(words_of(text)).items():
                        crc = zlib.crc32(word.encode(), head)
                        held[word if crc % DAMAGE_EVERY else damaged(word, crc)] += n
                    if len(held) >= HELD_WORDS:
                        yield given()
        if held:
            yield given()

    rows = df.select(F.col(id_col).cast("string"), F.col(text_col))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbol_count(n_words: int, shortest: int) -> int:
    """The least number of symbols for which the words, were they all of the least length, come to WORDS_A_KEY on each reduced word."""
    return next((s for s in range(4, len(SYMBOLS)) if WORDS_A_KEY * s**shortest >= n_words), len(SYMBOLS))


def alphabet(words: DataFrame, symbols: int) -> dict[str, str]:
    """A symbol for each letter of the words: the most frequent letter left goes to the symbol of fewest occurrences.

    The rows that come to the driver are the letters, a hundred at most by the pattern of words.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter != ''").groupBy("letter").count().collect()
    load = dict.fromkeys(SYMBOLS[:symbols], 0)
    out = {}
    for r in sorted(letters, key=lambda r: (-r["count"], r["letter"])):
        out[r["letter"]] = min(load, key=lambda s: (load[s], s))
        load[out[r["letter"]]] += r["count"]
    return out


def neighbourhood(reduced: Column, symbols: int) -> Column:
    """The reduced words at no edit, one deletion, or one replacement that leads to a greater word; no word twice."""
    head, tail, at = (lambda i: F.substring(reduced, F.lit(1), i - 1)), (lambda i: F.substring(reduced, i + 1, F.length(reduced))), (lambda i: F.substring(reduced, i, F.lit(1)))
    places = F.sequence(F.lit(1), F.length(reduced))
    # Of a run of equal symbols the first is deleted: the others give the same word.
    shorter = F.transform(F.filter(places, lambda i: (i == 1) | (at(i) != at(i - 1))), lambda i: F.concat(head(i), tail(i)))
    greater = F.flatten(F.transform(places, lambda i: F.transform(F.filter(F.array(*map(F.lit, SYMBOLS[:symbols])), lambda s: s > at(i)), lambda s: F.concat(head(i), s, tail(i)))))
    return F.concat(F.array(reduced), shorter, greater)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: all pairs of words one inserted, deleted or replaced code point apart, in both directions.

    `words` (word, n; distinct, not empty) is read several times, so it should be settled.
    """
    size = words.agg(F.count("*"), F.min(F.length("word"))).first()
    symbols = symbol_count(size[0], size[1] or 1)
    letters = alphabet(words, symbols)
    reduced = words.withColumn("key", F.translate("word", "".join(letters), "".join(letters.values())))
    around = reduced.select("word", "n", "key", F.explode(neighbourhood(F.col("key"), symbols)).alias("near"))
    there = reduced.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("key").alias("near"))
    # Equal reduced words would meet from both sides; the lesser word is taken as the first.
    one_sided = (F.col("key") != F.col("near")) | (F.col("word") < F.col("other"))
    met = around.join(there, "near").filter(one_sided & (F.levenshtein("word", "other", 1) == 1))
    ways = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return met.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the end of the chain of forms (word, form) from each word.

    Links are doubled until none changes: an n of a chain is FORM_RATIO times the last one, so 64-bit counts allow five doublings.
    """
    spark = forms.sparkSession
    now, path = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        more, last = settled(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forget(spark, path)
        now, path = more.select("word", "root"), last
        if not more.filter("moved").limit(1).count():
            return now


def variants(counts: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of enough code points and occurrences among `counts` (word, n)."""
    words, _ = settled(counts.filter((F.length("word") >= min_chars) & (F.col("n") >= min_count)))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near, path = settled(near_pairs(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")))
    enough = -F.col("best.less") >= ratio * F.col("n")
    near = near.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    ends = roots(near.filter("form is not null"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
