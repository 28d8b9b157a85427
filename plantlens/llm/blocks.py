"""Texts as codes, block by block, with a dictionary for each block.

A task cuts its texts into blocks of bounded bytes and numbers the words that a block holds. What the whole corpus knows of a word (a count, an id, a class)
is joined to the dictionaries, of which there are far fewer rows than words in texts, and meets the codes of
its block again. No vocabulary is broadcast, and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import settled, sliced

#: Bytes of text to a block (a longer text is a block of its own) and to a slice that is held as Python strings.
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 1 << 20


@dataclass
class Coded:
    """Blocks (block, ids, parts, counted, lengths, codes) and their dictionaries (block, code, part, word, n)."""

    blocks: DataFrame
    entries: DataFrame
    path: str


def coded(df: DataFrame, tokens: Callable[[bytes], list[bytes]], id_col: str = "doc_id", text_col: str = "text", part_col: str | None = None, counted: Callable[[object], bool] = lambda _: True, unseen: tuple[bytes, ...] = ()) -> Coded:
    """Code every text of `df` (null: empty) and settle the blocks.

    tokens: the tokens of a text, given as UTF-8 bytes with A-Z in lower case. Words of unlike `part_col` (null: null) are unlike. n is the number
    of occurrences in the documents for whose id `counted` holds. Tokens in `unseen` have the codes -1, -2, ... and no entry.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(unseen)
        for batch in batches:
            names, parts = batch.column(0), batch.column(2)
            for start, stop, texts in sliced(batch.column(1), SLICE_BYTES):
                for name, part, text in zip(names.slice(start, stop - start).to_pylist(), parts.slice(start, stop - start).to_pylist(), texts, strict=True):
                    block.add(name, part, tokens(text.encode().lower()), counted(name))
                    block.size += len(text)
                    if block.size >= BLOCK_BYTES:
                        yield block.batch(number, types)
                        number, block = number + 1, _Block(unseen)
        if block.ids:
            yield block.batch(number, types)

    schema = f"block long, ids array<{id_type}>, parts array<string>, counted array<boolean>, lengths array<int>, codes binary, words array<binary>, word_parts array<string>, counts array<long>"
    rows = df.select(F.col(id_col), F.col(text_col), (F.col(part_col).cast("string") if part_col else F.lit(None).cast("string")).alias("part"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_schema(_parse_datatype_string(schema))
    made, path = settled(rows.mapInArrow(run, schema))
    words = made.select("block", F.posexplode(F.arrays_zip("words", "word_parts", "counts")).alias("code", "entry"))
    entries = words.select("block", "code", F.col("entry.word_parts").alias("part"), F.col("entry.words").alias("word"), F.col("entry.counts").alias("n"))
    # Read anew, so that columns of the blocks and of the entries are told apart where both meet.
    blocks = df.sparkSession.read.schema(made.schema).parquet(path).drop("words", "word_parts", "counts")
    return Coded(blocks, entries, path)


class _Block:
    def __init__(self, unseen: tuple[bytes, ...]):
        self.unseen = {w: -1 - k for k, w in enumerate(unseen)}
        self.size, self.numbers, self.words, self.word_parts = 0, {}, [], []
        self.ids, self.parts, self.counted, self.codes = [], [], [], []

    def add(self, name: object, part: str | None, words: list[bytes], counted: bool) -> None:
        if part not in self.numbers:
            self.numbers[part] = dict(self.unseen)
        numbers = self.numbers[part]
        if new := set(words).difference(numbers):
            numbers.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
            self.words += new
            self.word_parts += [part] * len(new)
        self.codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.ids.append(name)
        self.parts.append(part)
        self.counted.append(counted)

    def batch(self, number: int, types: pa.Schema) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        lengths = [len(c) for c in self.codes]
        kept = codes[np.repeat(self.counted, lengths)] if codes.size else codes
        counts = np.bincount(kept[kept >= 0], minlength=len(self.words))
        columns = [number, self.ids, self.parts, self.counted, lengths, codes.astype("<i4").tobytes(), self.words, self.word_parts, counts]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types.types, strict=True)], schema=types)


def numbers(column: pa.ChunkedArray | pa.Array, row: int, kind: str) -> np.ndarray:
    """The numbers in a binary column's row, as the writer stored them."""
    return np.frombuffer(column[row].as_buffer(), kind)
