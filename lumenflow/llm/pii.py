"""PII: offset-preserving deobfuscation, detection, and spans in source characters.

Three transducers rewrite a text, each with a record of its edits: characters (homoglyphs, full-width forms
and other scripts' digits to ASCII, zero-width characters to nothing), spelled digits ('five five' to '55'), and
disguises of signs ('(at)', '[dot]', 'name at host dot com'). Identifiers are detected in the normalised text and their spans
are mapped back through the edits, last transducer first.

A text is rewritten only if it has something that an identifier can't be without (TRIGGER, one linear pass
over the whole text); whole texts are rewritten and searched, never parts.

Defined results
---------------
* Spans are in Unicode characters of the source, end exclusive; `found` is the source's text there, `value` the normalised one.
* Null or blank texts have none. A null doc_id is reported as null. Repeated rows are reported each.
* Overlapping identifiers: the first kind of KINDS wins, then the earlier start. An empty table gives no rows.
* Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import batch, lean

DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_LOOKALIKES = dict(zip("АВЕКМНОРСТУХЅІЈаеорсухіјѕԁһӏɡαοιρνυτκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEKMHOPCTYXSIJaeopcyxijsdhlgaoipvutkABEZHIKMNOPTYX"))
_GONE = "​‌‍⁠﻿­"
_SIGNS = dict(zip("．。․＠﹫＿－‐‑‒–＋（）", ".." + ".@@_-----+()"))


@lru_cache(1)
def characters() -> dict[int, str]:
    """Character -> what it stands for: '' for invisible ones, one ASCII character else."""
    found = {**{c: "" for c in _GONE}, **_LOOKALIKES, **_SIGNS}
    for code in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.isascii() and plain != chr(code):
            found.setdefault(chr(code), plain)
    for code in range(0x660, 0x11000):
        if unicodedata.category(chr(code)) == "Nd":
            found.setdefault(chr(code), str(unicodedata.digit(chr(code))))
    return {ord(k): v for k, v in found.items()}


_W = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:{_W})|\d)(?:[\s.-]{{1,3}}(?:(?:{_W})(?![^\W_])|\d))+", re.I)
_FOLDED = str.maketrans("İıſ", "iis")  # what re.I takes for i and s, lower() doesn't
_DIGIT_WORD = re.compile(rf"(?<![^\W\d_])({_W})(?![^\W\d_])", re.I)
# All of these begin at a literal, or where a run begins, and repeat possessively: no run is read again from each of its characters.
_BRACKETED = re.compile(r"[\[({<]\s*+(at|dot|@|\.)\s*+[\])}>]\s*+", re.I)
_AT = re.compile(r"(?<=[\w.+%-])\s++at\s++", re.I)
_LABEL = re.compile(r"[\w-]++")
_LAST = re.compile(r"[a-z]{2,}+(?![^\W_])", re.I)
_SEPARATOR = re.compile(r"\s*+(?:\.|(?<=\s)dot(?=\s))\s*+", re.I)
_DOT = re.compile(r"(?<=[\w-])\s++dot\s++(?=[\w-])", re.I)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
KINDS = {
    "email": re.compile(r"(?<![\w.+%-])[a-z0-9][\w.+%-]*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}(?![\w-])", re.I | re.A),
    "ip": re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)", re.A),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)", re.A),
    "ssn": re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])", re.A),
    "phone": re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|\d{10,11})(?![\w]|-\d)", re.A),
}
#: Python's white space, of which RE2's \s has the ASCII part only, and the spelled digits as re.I reads them.
_S = "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace())
_ANY = "|".join(DIGIT_WORDS).replace("i", "[iİı]").replace("s", "[sſ]")
#: What every identifier has, disguised or not, for RE2 on whole texts.
TRIGGER = (
    rf"(?i)@|[+(][{_S}]*\d|\d[{_S}().-]{{0,3}}\d[{_S}().-]{{0,3}}\d[{_S}().-]{{0,3}}\d|\d[{_S}]*\.[{_S}]*\d|[\[({{<][{_S}]*(at|dot|\.)[{_S}]*[\])}}>]|\bdot\b"
    rf"|({_ANY})[{_S}.-]{{1,3}}({_ANY}|\p{{Nd}})|\p{{Nd}}[{_S}.-]{{1,3}}({_ANY})|[{_S}]at[{_S}]+[a-z0-9-]+\.[a-z0-9]"
)


def _trigger() -> str:
    return TRIGGER + "|[" + "".join(f"\\x{{{c:x}}}" for c in sorted(characters())) + "]"


class Text:
    """A text under rewriting; `edits` of each transducer: (start, end) before, (start, end) after, in order."""

    def __init__(self, source: str):
        self.source = self.now = source
        self.layers: list[tuple[list[int], list[tuple[int, int, int, int]]]] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint, ascending spans of the text as it is now."""
        edits = [e for e in edits if self.now[e[0] : e[1]] != e[2]]
        if not edits:
            return
        out, record, at, length = [], [], 0, 0
        for start, end, new in edits:
            out.append(self.now[at:start])
            length += start - at
            out.append(new)
            record.append((start, end, length, length + len(new)))
            length += len(new)
            at = end
        out.append(self.now[at:])
        self.now = "".join(out)
        self.layers.append(([r[2] for r in record], record))

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Source characters of a span of the text as it is now: all that any of its characters came from."""
        for starts, record in reversed(self.layers):
            start, end = _before(starts, record, start, False), _before(starts, record, end - 1, True)
        return start, end


def _before(starts: list[int], record: list[tuple[int, int, int, int]], at: int, last: bool) -> int:
    """Where the character at `at` began, or (last) ended, before a layer of edits."""
    k = bisect_right(starts, at) - 1
    while k >= 0 and record[k][2] == record[k][3]:  # deletions leave no character
        if record[k][2] <= at and (k == 0 or record[k - 1][3] <= at):
            break
        k -= 1
    if k < 0:
        return at + last
    old_start, old_end, new_start, new_end = record[k]
    if new_start <= at < new_end:
        if old_end - old_start == new_end - new_start:
            return old_start + at - new_start + last
        return old_end if last else old_start
    return old_end + at - new_end + last


def normalise(source: str) -> Text:
    text = Text(source)
    table = characters()
    if not source.isascii():
        text.rewrite([(i, i + 1, table[ord(c)]) for i, c in enumerate(source) if ord(c) in table])
    spelled = []
    for m in _SPELLED.finditer(text.now):
        if not _DIGIT_WORD.search(m.group()):
            continue
        at = m.start()
        words = list(_DIGIT_WORD.finditer(m.group()))
        for k, w in enumerate(words):
            start, end = at + w.start(), at + w.end()
            # the gap between two spelled digits, or to a digit, goes with it
            if k + 1 < len(words) and not any(c.isalnum() for c in text.now[end : at + words[k + 1].start()]):
                end = at + words[k + 1].start()
            spelled.append((start, end, DIGIT_WORDS[w.group().translate(_FOLDED).lower()]))
    text.rewrite(spelled)
    sign, edits, until = {"at": "@", "@": "@", "dot": ".", ".": "."}, [], 0
    for m in _BRACKETED.finditer(text.now):
        start = m.start()
        while start > until and text.now[start - 1].isspace():
            start -= 1
        until = m.end()
        edits.append((start, until, sign[m.group(1).lower()]))
    text.rewrite(edits)
    edits, until = [], 0
    for m in _AT.finditer(text.now):
        if m.start() > until and (end := _host_end(text.now, m.end())):
            edits.append((*m.span(), "@"))
            until = end
    text.rewrite(edits)
    text.rewrite(_dots(text.now))
    return text


def _host_end(text: str, at: int) -> int:
    """Where the host that begins at `at` ends, its labels parted by '.' or ' dot '; 0 if none does."""
    end = 0
    while (label := _LABEL.match(text, at)) and (sep := _SEPARATOR.match(text, label.end())):
        at = sep.end()
        if last := _LAST.match(text, at):
            end = last.end()
    return end


def _dots(text: str) -> list[tuple[int, int, str]]:
    """The ' dot 's within an address: digits on either side, or an '@' in the words that it and other 'dot's join."""
    found = list(_DOT.finditer(text))
    before, after = set(), set()  # ends of words that continue one with an '@', starts of words that lead to one
    if found and "@" in text:
        words = list(re.finditer(r"\S+", text))
        joins = [w.group().lower() == "dot" for w in words]
        for k, w in enumerate(words):
            if "@" in w.group() or (k > 1 and joins[k - 1] and words[k - 2].end() in before):
                before.add(w.end())
        for k in range(len(words) - 1, -1, -1):
            w = words[k]
            name = re.match(r"[\w-]+", w.group())
            if name and (w.group()[name.end() :][:1] == "@" or (name.end() == len(w.group()) and k + 2 < len(words) and joins[k + 1] and words[k + 2].start() in after)):
                after.add(w.start())
    return [(m.start(), m.end(), ".") for m in found if (text[m.start() - 1].isdigit() and text[m.end()].isdigit()) or m.start() in before or m.end() in after]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find(source: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of a text's identifiers, by start."""
    text = normalise(source)
    starts, ends, found = [], [], []  # of what is found, disjoint and ascending
    for kind, pattern in KINDS.items():
        for m in pattern.finditer(text.now):
            if kind == "card" and not luhn(re.sub(r"\D", "", m.group())):
                continue
            k = bisect_right(starts, m.start())
            if (k and ends[k - 1] > m.start()) or (k < len(starts) and starts[k] < m.end()):
                continue
            starts.insert(k, m.start())
            ends.insert(k, m.end())
            found.append((kind, *text.span(*m.span()), m.group()))
    return sorted(found, key=lambda f: f[1:])


SPANS = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("found", pa.string()), ("value", pa.string())])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trigger = _trigger()
    for b in batches:
        for at, texts in K.slices(b.column(1)):
            some = np.flatnonzero(pc.match_substring_regex(texts, trigger).to_numpy(zero_copy_only=False))
            ids = b.column(0).slice(at, len(texts)).take(pa.array(some)).to_pylist()
            rows = [(i, *f[:3], t[f[1] : f[2]], f[3]) for i, t in zip(ids, texts.take(pa.array(some)).to_pylist()) for f in find(t)]
            if rows:
                yield batch(SPANS, *zip(*rows))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, found, value: every identifier of every text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(lean(_spans), "doc_id long, kind string, start int, end int, found string, value string")
