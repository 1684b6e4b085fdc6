"""Vectorised text kernels shared by the corpus operators.

They work on Arrow string arrays inside ``mapInArrow`` and touch every byte of
every text: tokens, n-grams and sketches are computed with numpy over the Arrow
buffers, in slices of about a megabyte so that temporaries stay in cache and a
worker's memory doesn't depend on the batch size.

A *word* is a maximal run of ASCII letters, digits, underscores or non-ASCII
characters of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20
#: Documents in a slice: their index and a 52-bit n-gram share one sort key.
SLICE_DOCS = 4096
GRAM_BITS = 52
_GRAM_MASK = U((1 << GRAM_BITS) - 1)
_BASE = 0x100000001B3
_C = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

_ENDING = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_SPACED = np.ones(256, bool)
_SPACED[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    return tuple(np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(x), U)]), dtype=U) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(21, int(size).bit_length()))


def slices(texts: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES, max_docs: int = SLICE_DOCS) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive slices; a longer text is a slice of its own; nulls become ''."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(texts)
    while at < n:
        base = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, base + max_bytes, "right")), at + 1), at + max_docs, n)
        yield at, texts.slice(at, to - at)
        at = to


class Slice:
    """The words of a slice: hashes, the document of each, and where each starts and ends in `data`."""

    def __init__(self, texts: pa.Array, lower: bool = True, table: np.ndarray = _WORD):
        joined = pc.binary_join_element_wise(pc.utf8_lower(texts) if lower else texts, *_ENDING)
        offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
        raw = joined.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
        self.n_docs = len(texts)
        self.offsets = offsets - offsets[0]
        inside = table[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.doc = np.searchsorted(self.offsets, self.starts, "right").astype(np.int64) - 1
        self.first = np.searchsorted(self.starts, self.offsets)  # of each document's words

    @property
    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U)
        up, down = powers(len(self.data))
        sums = np.concatenate([[U(0)], np.cumsum((self.data.astype(U) + U(1)) * up[: len(self.data)], dtype=U)])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def words(self, which: np.ndarray) -> list[str]:
        whole = self.data.tobytes()
        return [whole[s:e].decode("utf-8", "replace") for s, e in zip(self.starts[which].tolist(), self.ends[which].tolist())]


def ngrams(words: np.ndarray, doc: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams and their documents. A document of 1 to n-1 words has one gram of them all."""
    grams, of = np.zeros(0, U), np.zeros(0, np.int64)
    if len(words) >= n:
        total = words[: len(words) - n + 1] * _C[0]
        for i in range(1, n):
            total = total + words[i : len(words) - n + 1 + i] * _C[i % 8]
        whole = doc[: len(doc) - n + 1] == doc[n - 1 :]
        grams, of = mix(total[whole]), doc[: len(doc) - n + 1][whole]
    count = np.diff(first)
    for k in range(1, n):
        if len(short := np.flatnonzero(count == k)):
            total = words[first[short]] * _C[0] + U(k)
            for i in range(1, k):
                total = total + words[first[short] + i] * _C[i % 8]
            grams, of = np.concatenate([grams, mix(total)]), np.concatenate([of, short])
    return grams, of


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams (52-bit hashes, ascending within a document) of a slice and where each document's begin."""
    words = Slice(texts)
    grams, of = ngrams(words.hashes, words.doc, words.first, n)
    keys = np.sort((of.astype(U) << U(GRAM_BITS)) | (grams & _GRAM_MASK))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    first = np.searchsorted(keys, np.arange(words.n_docs + 1, dtype=U) << U(GRAM_BITS)) if words.n_docs < SLICE_DOCS else np.searchsorted((keys >> U(GRAM_BITS)).astype(np.int64), np.arange(words.n_docs + 1))
    return keys & _GRAM_MASK, first


@lru_cache(8)
def multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 63, count, dtype=np.int64).astype(U) * U(2) + U(1)
    return draw(), draw()


def minhash(grams: np.ndarray, first: np.ndarray, count: int, seed: int, block: int = 1 << 15) -> np.ndarray:
    """[documents, count] minima; documents without grams keep the maximum."""
    sketch = np.full((len(first) - 1, count), ~U(0), U)
    a, b = multipliers(count, seed)
    at = 0
    full = np.flatnonzero(np.diff(first))
    while at < len(full):  # blocks of whole documents, in cache
        to = max(at + 1, int(np.searchsorted(first[full], first[full[at]] + block, "left")))
        docs = full[at:to]
        lo, hi = first[docs[0]], first[docs[-1] + 1]
        part, starts = mix(grams[lo:hi] + _C[0]), first[docs] - lo
        for k in range(count):
            sketch[docs, k] = np.minimum.reduceat(part * a[k] + b[k], starts)
        at = to
    return sketch
