"""Byte-level BPE encoding, decoding and token counts.

All work happens in Arrow functions. A text is cut at boundaries at which no token of the vocabulary can
start before and end after ("safe" boundaries), equal pieces of a batch are encoded once by the tokenizers
library's batch call, and a bounded memo keeps the short pieces met lately. Whole texts are always encoded.

Cutting is sound only if no token crosses a cut; `cuts_hold` proves that from the vocabulary itself when it is
loaded, and texts of a vocabulary for which it doesn't hold are encoded uncut. Where a vocabulary parts letters from
anything else before it merges (`parts_words`), texts of Latin-1 characters are cut there too, so that a word is one
piece in whatever case and beside whatever marks it stands.

Nulls are empty texts; empty texts have no tokens; rows are independent, so repeated rows, ties and empty
tables need no care; only the id and text columns are read, so further columns may have any names.
"""

from __future__ import annotations

import base64
import gc
import json
import os
import re
import struct
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import sliced

#: Bytes of text handled at a time inside a task.
SLICE_BYTES = 1 << 20
#: Bytes of a worker's memo (pieces, their values and the table's slots), and the longest piece that is kept.
MEMO_BYTES, MEMO_CHARS = 160 << 20, 48

#: Words of one run of letters, of which a vocabulary with word ends makes one word each; so many are encoded at a time.
_PLAIN, JOINED = re.compile("[a-zß-öø-ÿ]+"), 2000

#: The pre-tokeniser and normaliser of vocabularies that part letters from anything else and lower all of them.
_WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Latin-1, byte by byte: its small letters, and the kinds of lowered bytes (0: between pieces, 1: letters, 2: anything else).
_LOWER = "".join(map(chr, range(256))).lower().encode("latin-1")
_KIND = np.array([0 if c in " \n" else 1 if c.isalpha() else 2 for c in map(chr, range(256))], np.uint8)

_SPACES = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_CROSSED, _BLANK_INSIDE = re.compile(r"\S |\S\n|\n\S"), re.compile(r"\s.|.\s", re.S)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that print as themselves keep their character; the others take the code points from 256 on.
    """
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes `token`: merge its bytes by rank as long as a better rank is there."""
    parts, own = [bytes([b]) for b in token], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            raise ValueError(f"{token!r} can't be made by merges of lower rank")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def load_tokenizer(path: str):
    """A tokenizers.Tokenizer from a .json file, or from the ranks of a .tiktoken file (then without special tokens)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, models, pre_tokenizers

    if path.endswith(".json"):
        made = Tokenizer.from_file(path)
        if hasattr(made.model, "_resize_cache"):
            made.model._resize_cache(0)  # the memo below does its work
        return made
    ranks, letters = read_ranks(path), byte_alphabet()
    shown = lambda raw: "".join(letters[b] for b in raw)
    merges = [tuple(map(shown, _last_merge(t, ranks))) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    made = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return made


def cut_before_spaces(text: str) -> list[list[str]]:
    """Lines of pieces for vocabularies whose tokens may begin, but not go on after, with one space.

    A line break between characters that aren't white space is a token of its own, and a boundary lies before each
    single space between such characters. Lines joined by breaks and their pieces by spaces give the text; all
    but a line's first piece are meant to begin with the space. Texts with other white space are cut at safe
    spaces only.
    """
    if text[:1].isspace() or text[-1:].isspace() or _SPACES.search(text):
        return [_SAFE.split(text)]
    return [line.split(" ") for line in text.split("\n")]


def cut_at_spaces(text: str) -> list[str]:
    """Pieces for vocabularies that drop white space: between any two spaces or line breaks."""
    return text.replace("\n", " ").split(" ")


def cuts_hold(tokenizer, spaced: bool) -> bool:
    """Whether the cuts above, and PieceCoder's treatment of marks and capitals, can't change any id of this vocabulary.

    Byte-pair merges never cross a place that no token covers. So no token may hold a letter before a full stop or
    comma; with `spaced`, nor a space after, or a line break beside, what isn't white space, and the text must reach the
    merges unchanged; otherwise, no token may hold white space beside anything, white space must have no ids, and the
    normaliser must lower all ASCII letters.
    Special tokens must begin with "<|", which is looked for before capitals are lowered, and hold no white space.
    """
    back = {c: b for b, c in enumerate(byte_alphabet())}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    if any(not t.startswith("<|") or any(c.isspace() for c in t) for t in special):
        return False
    for token in tokenizer.get_vocab(with_added_tokens=False):
        text = bytes(back[c] for c in token.removesuffix("</w>") if c in back).decode(errors="replace")
        if re.search(r"[A-Za-z][.,]", text) or (_CROSSED if spaced else _BLANK_INSIDE).search(text):
            return False
    if spaced:
        return tokenizer.normalizer is None
    capitals, ids = "".join(map(chr, range(65, 91))), lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    return tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str(capitals) == capitals.lower() and ids("a \n \n b") == ids("a") + ids("b")


def word_ends(tokenizer) -> np.ndarray | None:
    """Which ids end a word, for vocabularies that mark them by </w>; None for others."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if suffix != "</w>":
        return None
    vocabulary = tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
    return out


def parts_words(tokenizer) -> bool:
    """Whether the vocabulary's own splitting is `_WORDS` over `_LOWERED`, on which the cuts of `latin_pieces` rest."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return False
    split = json.loads(tokenizer.pre_tokenizer.__getstate__()).get("pretokenizers", [{}])
    return split[0] == _WORDS and [s["type"] for s in split[1:]] == ["ByteLevel"] and json.loads(tokenizer.normalizer.__getstate__()).get("normalizers") == _LOWERED


def plain_words(tokenizer):
    """The same model for lowered words between single spaces, which need neither the normaliser nor the pattern."""
    from tokenizers import Tokenizer, pre_tokenizers

    made = Tokenizer(tokenizer.model)
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


def is_latin(text: str) -> bool:
    """Whether latin_pieces may cut a text: Latin-1 characters only, and no special token."""
    if "<|" in text:
        return False
    try:
        return text.isascii() or text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


def latin_pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lowered pieces, the number among them of each piece of all texts, and where each text's pieces end.

    A piece is a run of letters or a run of anything else but spaces and line breaks. Letters behind an apostrophe
    stay with it ('s and the like); at any other end of a run of letters `_WORDS` ends a match, and the composed form of
    Latin-1 characters, each by each, is themselves.
    """
    raw = np.frombuffer(("\n" + "\n".join(texts)).encode("latin-1").translate(_LOWER), np.uint8)
    kind = _KIND[raw]
    heads = np.zeros(len(raw), bool)
    heads[1:] = (kind[1:] != kind[:-1]) & (kind[1:] != 0) & ((kind[1:] != 1) | (raw[:-1] != ord("'")))
    kept = kind != 0
    starts = np.flatnonzero(heads[kept])
    data = raw[kept]
    offsets = np.append(starts, len(data)).astype("<i4")
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    last = np.cumsum([len(t) + 1 for t in texts])
    return [p.decode("latin-1") for p in found.dictionary.to_numpy(zero_copy_only=False).tolist()], found.indices.to_numpy(), np.searchsorted(np.flatnonzero(heads), last)


class PieceCoder:
    """Encodes texts through their pieces. `make` turns a piece's encoding into what is kept and joined."""

    def __init__(self, tokenizer, make: Callable, spaced: bool):
        self.tokenizer, self.make, self.spaced, self.weight = tokenizer, make, spaced, 0
        self.cut = cuts_hold(tokenizer, spaced)
        self.marks = {m: make(tokenizer.encode(m, add_special_tokens=False)) for m in ".,"}
        self.line_break = make(tokenizer.encode("\n", add_special_tokens=False))
        self.first: dict = {}
        self.later: dict = {}
        self.ends = word_ends(tokenizer) if self.cut and not spaced and make in (packed, len) else None
        self.by_words = self.ends is not None and make is packed and parts_words(tokenizer)
        self.plain = plain_words(tokenizer) if self.ends is not None and parts_words(tokenizer) else tokenizer

    def _learn(self, memo: dict, missing: list[str], prefix: str) -> None:
        """Add the values of missing pieces to the memo.

        One full stop or comma after an ASCII letter is a token of its own, so such pieces are put together from
        two parts; where the vocabulary lowers letters anyway, ASCII pieces are lowered first (unless they may hold
        a special token).
        """
        marks, lower = self.marks, not self.spaced
        parts, stems = [], set()
        for piece in missing:
            stem, mark = piece, piece[-1:]
            if mark in marks and (before := piece[-2:-1]).isalpha() and before.isascii():
                stem = piece[:-1]
            else:
                mark = ""
            if lower and stem.isascii() and "<|" not in stem:
                stem = stem.lower()
            if stem not in memo:
                stems.add(stem)
            if mark or stem != piece:
                parts.append((piece, stem, mark))
        self._add(memo, list(stems), prefix)
        for piece, stem, mark in parts:
            memo[piece] = memo[stem] + marks[mark] if mark else memo[stem]
        self.weight += self._weigh([p for p, _, _ in parts], [memo[p] for p, _, _ in parts])

    def _add(self, memo: dict, todo: list[str], prefix: str) -> None:
        """Encode distinct pieces and add them to the memo."""
        if self.ends is not None:  # plain words go many at a time
            plain = list(filter(_PLAIN.fullmatch, todo))
            for start in range(0, len(plain), JOINED):
                some = plain[start : start + JOINED]
                if (values := self._joined(some)) is not None:
                    memo.update(zip(some, values, strict=True))
                    self.weight += self._weigh(some, values)
            todo = [s for s in todo if s not in memo]
        for start in range(0, len(todo), 20_000):
            some = todo[start : start + 20_000]
            encoded = self.tokenizer.encode_batch_fast([prefix + s for s in some] if prefix else some, add_special_tokens=False)
            values = list(map(self.make, encoded))
            memo.update(zip(some, values, strict=True))
            self.weight += self._weigh(some, values)

    def _joined(self, words: list[str]) -> list | None:
        """The values of plain words, encoded as one text and told apart by the tokens that end words; None if these aren't as many as the words."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return None
        if self.make is len:
            return np.diff(stops, prepend=0).tolist()
        raw, at = ids.tobytes(), [0, *(4 * stops).tolist()]
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that latin_pieces may cut: each distinct piece is looked up once, and its ids are dealt to its places."""
        if not texts:
            return []
        pieces, which, last = latin_pieces(texts)
        memo = self.later
        values = list(map(memo.get, pieces))
        holes = [k for k, v in enumerate(values) if v is None]
        missing = [pieces[k] for k in holes]
        self._add(memo, missing, "")
        for k, piece in zip(holes, missing, strict=True):
            values[k] = memo[piece]
        self._bound(memo, missing)
        known = np.frombuffer(b"".join(values), "<u4")
        sizes = np.array(list(map(len, values)), np.int64) // 4
        firsts = np.cumsum(sizes) - sizes
        counts = sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        raw = known[np.repeat(firsts[which] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
        stops = (4 * ends[last]).tolist()
        return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    @staticmethod
    def _weigh(pieces: list[str], values: list) -> int:
        """Bytes that entries of the memo take: both objects and about 100 of the table."""
        return sum(map(sys.getsizeof, pieces)) + sum(map(sys.getsizeof, values)) + 100 * len(pieces)

    def _look_up(self, memo: dict, lists: list[list[str]], prefix: str) -> list[list]:
        values = [list(map(memo.get, pieces)) for pieces in lists]
        holes = [k for k, got in enumerate(values) if None in got]
        missing = {p for k in holes for p, v in zip(lists[k], values[k], strict=True) if v is None}
        if not missing:
            return values
        self._learn(memo, list(missing), prefix)
        for k in holes:
            values[k] = list(map(memo.__getitem__, lists[k]))
        self._bound(memo, missing)
        return values

    def _bound(self, memo: dict, learnt: Iterable[str]) -> None:
        """Forget long pieces and their stems, and everything once the memos are too heavy."""
        for piece in [p for p in learnt if len(p) > MEMO_CHARS]:
            for known in (piece, piece[:-1]):
                if known in memo:
                    self.weight -= self._weigh([known], [memo.pop(known)])
        if self.weight > MEMO_BYTES:
            self.first, self.later, self.weight = {}, {}, 0

    def __call__(self, texts: list[str], join: Callable) -> list:
        """join(values of a text's pieces) for each text."""
        gc.disable()  # many lists of strings and no cycles: passes of the collector find nothing
        try:
            return self._encode(texts, join)
        finally:
            gc.enable()

    def _encode(self, texts: list[str], join: Callable) -> list:
        if not self.cut:
            return [join([self.make(e)]) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if not self.spaced:
            latin = [self.by_words and is_latin(t) for t in texts]
            words = iter(self._by_words(list(compress(texts, latin))))
            rest = iter(self._look_up(self.later, [cut_at_spaces(t) for t, easy in zip(texts, latin, strict=True) if not easy], ""))
            return [join([next(words)] if easy else next(rest)) for easy in latin]
        cut = [cut_before_spaces(t) for t in texts]
        lines = [line for text in cut for line in text]
        heads = self._look_up(self.first, [[line.pop(0)] for line in lines], "")
        values = [join(h + v) for h, v in zip(heads, self._look_up(self.later, lines, " "), strict=True)]
        out, at, pause = [], 0, self.line_break
        for text in cut:
            own = values[at : at + len(text)]
            at += len(text)
            out.append(own[0] if len(own) == 1 else join([x for v in own for x in (pause, v)][1:]))
        return out


def packed(encoding) -> bytes:
    """An encoding's ids as little-endian unsigned 32-bit integers."""
    ids = encoding.ids
    return struct.pack(f"<{len(ids)}I", *ids)


_coders: dict[tuple, PieceCoder] = {}


def coder(path: str, what: str, spaced: bool) -> PieceCoder:
    """This worker's coder; what: "ids" keeps packed ids, "count" numbers of tokens."""
    key = (path, what, spaced)
    if key not in _coders:
        _coders[key] = PieceCoder(load_tokenizer(path), packed if what == "ids" else len, spaced)
    return _coders[key]


def text_offsets(text: str, lengths: np.ndarray) -> np.ndarray:
    """Start and end, in characters, of tokens of the given byte lengths (a token inside a character covers it)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    number = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return np.stack([number[ends - lengths], number[ends - 1] + 1], 1) if len(lengths) else np.zeros((0, 2), np.int64)


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Encode every whole text.

    Returns id_col, ids (binary: little-endian unsigned 32-bit) and, if asked for, offsets (binary: pairs of
    such integers, the first and past-the-last character of each token) and decoded (binary: the bytes that the
    ids stand for, for a check of the round trip in the same pass).
    """
    id_type = df.schema[id_col].dataType.simpleString()
    more = ["offsets"] * offsets + ["decoded"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary, "ids", True)
        table = token_bytes(vocabulary) if more else []
        sizes = token_lengths(vocabulary) if offsets else None
        for batch in batches:
            for start, stop, texts in sliced(batch.column(1), SLICE_BYTES):
                ids = code(texts, b"".join)
                out = [batch.column(0).slice(start, stop - start), pa.array(ids, pa.binary())]
                if offsets:
                    out.append(pa.array([text_offsets(t, sizes[np.frombuffer(i, "<u4")]).astype("<u4").tobytes() for t, i in zip(texts, ids, strict=True)], pa.binary()))
                if decoded:
                    out.append(pa.array([join_bytes(table, i) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["id", "ids", *more])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    coded = source.mapInArrow(run, ", ".join([f"id {id_type}, ids binary", *(f"{c} binary" for c in more)]))
    return coded.withColumnRenamed("id", id_col)


_tables: dict[str, list[bytes]] = {}


def token_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of each id, by the reversed byte alphabet (special tokens: their text)."""
    if vocabulary not in _tables:
        if vocabulary.endswith(".json"):
            tokenizer, back = load_tokenizer(vocabulary), {c: b for b, c in enumerate(byte_alphabet())}
            found = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in tokenizer.get_vocab().items()}
        else:
            found = {r: t for t, r in read_ranks(vocabulary).items()}
        _tables[vocabulary] = [found.get(i, b"") for i in range(max(found) + 1)]
    return _tables[vocabulary]


def join_bytes(table: list[bytes], ids: bytes | None) -> bytes:
    """The bytes that packed ids stand for, joined before any character is read."""
    return b"".join(map(table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def token_lengths(vocabulary: str) -> np.ndarray:
    return np.array([len(t) for t in token_bytes(vocabulary)], np.int64)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids", text: bool = False) -> DataFrame:
    """Decode packed ids (null: none) by joining the bytes of all tokens before any character is read.

    So characters split over tokens come out whole. Returns id_col and decoded (binary), with text=True also
    decoded_text, where bytes that form no character (ids cut inside one) become U+FFFD.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(vocabulary)
        for batch in batches:
            raw = [join_bytes(known, x) for x in batch.column(1).to_pylist()]
            out = [*batch.columns[:1], pa.array(raw, pa.binary())]
            if text:
                out.append(pa.array([x.decode(errors="replace") for x in raw], pa.string()))
            out += batch.columns[2:]
            yield pa.RecordBatch.from_arrays(out, names=names)

    extra = [c for c in df.columns if c not in (id_col, ids_col)]
    kept = [F.col(c).alias(f"extra_{k}") for k, c in enumerate(extra)]
    names = ["id", "decoded", *["decoded_text"] * text, *(f"extra_{k}" for k in range(len(extra)))]
    kinds = [id_type, "binary", *["string"] * text, *(df.schema[c].dataType.simpleString() for c in extra)]
    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), *kept)
    out = source.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return out.withColumnsRenamed({"id": id_col} | {f"extra_{k}": c for k, c in enumerate(extra)})


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", spaced: bool = True) -> DataFrame:
    """Number of tokens and bytes of every whole text: id_col, n_bytes, n_tokens.

    Only lengths leave the batch encoding. `spaced` tells how the vocabulary treats spaces: True, if a token may
    begin with one (byte-level vocabularies); False, if white space is dropped. A .model file is read by the
    sentencepiece library, whose normalisation spans spaces, so such texts are encoded uncut.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def lengths(texts: list[str]) -> list[int]:
        if vocabulary.endswith(".model"):
            return [len(x) for x in pieces_model(vocabulary).encode(texts, num_threads=1)]
        return coder(vocabulary, "count", spaced)(texts, sum)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in sliced(batch.column(1), SLICE_BYTES):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lengths(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), size.alias("n_bytes"))
    return source.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


_models: dict = {}


def pieces_model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]
