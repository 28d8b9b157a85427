"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, digits, plus signs, schemes and identifier cues, these two in
upper, lower or mixed case); parsers then expand each anchor to the left and right by fixed rules and validate what
they found. Per kind, spans are leftmost and don't overlap; a candidate that fails validation is dropped and not
tried again from inside.

Base kinds: email, ip, card, phone. Kinds that the anchors add: url_login (a scheme whose address carries user
and password), iban (valid check digits), ssn (three groups after a cue), secret (a cue, = or :, and a token).

Null texts are empty; texts without anchors have no spans; whole texts are searched, and rows one by one, so
repeated rows and ties get equal spans and empty tables no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import by_bytes

#: Bytes of texts handled at a time inside a task.
SLICE_BYTES = 4 << 20
#: The base kinds in the order in which spans at one place are listed, then the added kinds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url_login", "iban", "ssn", "secret")
RANK = {kind: k for k, kind in enumerate(BASE + ADDED)}
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://", "mongodb://")
CUES = {"ssn": "ssn", "social security": "ssn", "iban": "iban", "api_key": "secret", "api key": "secret", "apikey": "secret", "password": "secret", "passwd": "secret", "secret": "secret", "token": "secret"}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/:@]+:[^\s/@]+@[A-Za-z0-9.-]+")
_SSN = re.compile(r"[\s:#.-]{0,4}(?:number|no\.?)?[\s:#.-]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])", re.I)
_IBAN = re.compile(r"[\s:#.-]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Z0-9])")
_SECRET = re.compile(r"[\x20\"']{0,2}[:=][\x20\"']{0,2}([A-Za-z0-9_+/=.-]{12,})")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def _automaton():
    made = ahocorasick.Automaton()
    for digit in "0123456789":
        made.add_word(digit, (1, "digit"))
    made.add_word("@", (1, "@"))
    made.add_word("+", (1, "+"))
    for scheme in SCHEMES:
        made.add_word(scheme, (len(scheme), "scheme"))
    for cue, kind in CUES.items():
        made.add_word(cue, (len(cue), kind))
    made.make_automaton()
    return made


_AUTOMATON = _automaton()


def luhn(digits: list[int]) -> bool:
    twice = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


def _digits(text: str) -> list[int]:
    return [int(c) for c in _DIGITS.findall(text)]


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in text.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        digits = _digits(text)
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(_digits(text)) <= 15


def _lowered(text: str) -> str:
    """The text with A-Z as a-z and all else as it is, so that places stay the same."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def spans(text: str) -> list[Span]:
    """All spans of a text as (kind, start, end), by start and then kind."""
    ends = dict.fromkeys(RANK, 0)
    found: list[Span] = []
    for last, (size, anchor) in _AUTOMATON.iter(_lowered(text)):
        at = last - size + 1
        if anchor == "digit":
            if at >= ends["ip"] and (m := _IP.match(text, at)):
                ends["ip"] = m.end()
                if _valid("ip", m[0]):
                    found.append(("ip", at, m.end()))
            elif at >= ends["ip"]:
                ends["ip"] = at + 1
                while ends["ip"] < len(text) and "0" <= text[ends["ip"]] <= "9":
                    ends["ip"] += 1  # the rest of a run of digits fails like its beginning
            if at >= ends["card"] and (m := _CARD.match(text, at)):
                ends["card"] = m.end()
                if _valid("card", m[0]):
                    found.append(("card", at, m.end()))
        elif anchor == "@":
            if at >= ends["email"] and (e := _email(text, at, ends["email"])):
                found.append(("email", *e))
                ends["email"] = e[1]
        elif anchor == "+":
            if at >= ends["phone"] and (m := _PHONE.match(text, at)):
                ends["phone"] = m.end()
                if _valid("phone", m[0]):
                    found.append(("phone", at, m.end()))
        elif anchor == "scheme":
            if at >= ends["url_login"] and (m := _LOGIN.match(text, last + 1)):
                found.append(("url_login", at, m.end()))
                ends["url_login"] = m.end()
        else:
            pattern = {"ssn": _SSN, "iban": _IBAN, "secret": _SECRET}[anchor]
            if at >= ends[anchor] and (m := pattern.match(text, last + 1)) and (anchor != "iban" or iban(m[1])):
                found.append((anchor, m.start(1), m.end(1)))
                ends[anchor] = m.end(1)
    return sorted(found, key=lambda s: (s[1], RANK[s[0]]))


def iban(text: str) -> bool:
    """Check digits of an account number."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by the name of its first kind."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, spans (array of kind, start, end in code points), with redact=True also redacted; and the columns `keep`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in by_bytes(batch.column(1), SLICE_BYTES):
                part = batch.slice(start, stop - start)
                texts = part.column(1).to_pylist()
                each = [spans(t) if t else [] for t in texts]
                column = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in each], _SPANS)
                out = [part.column(0), column]
                if redact:
                    out.append(pa.array([t if not s else redacted(t, s) for t, s in zip(texts, each, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*out, *part.columns[2:]], names=names)

    names = ["id", "spans", *["redacted"] * redact, *(f"extra_{k}" for k in range(len(keep)))]
    kinds = [df.schema[id_col].dataType.simpleString(), "array<struct<kind:string,start:bigint,end:bigint>>", *["string"] * redact, *(df.schema[c].dataType.simpleString() for c in keep)]
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"extra_{k}") for k, c in enumerate(keep)))
    out = source.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return out.withColumnsRenamed({"id": id_col} | {f"extra_{k}": c for k, c in enumerate(keep)})


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda x: F.array_join(F.transform(x, shown), ",")
    return found.select(id_col, *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
