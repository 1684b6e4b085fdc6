"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The unit is the word (see `kernels`). The random walk of Chakraborty, Goldenberg and
Koucky reads a string from a position on: at step j it outputs the current word and
moves on if a random bit of (j, word) is 1. Strings at a small edit distance get
embeddings at a small Hamming distance. Every STRIDE-th word position of every text starts
a walk over an item-sized window, and every item is embedded from each of its first STRIDE
words: whatever word an occurrence begins at, one of its windows is aligned with one of the
item's. A table samples a few coordinates; windows that agree on all coordinates of a table
are a candidate. Candidates are verified by the exact edit distance between the item and
its best placement in the text.

Windows of similar length share tables; how many there are follows from RECALL, the share of items with as many edits as the bound
allows that must become candidates (`tables_for`, by simulation). Items of fewer than SHORT words are searched from every position,
those whose bound allows no edit by their words themselves. An item of more than MAX_WINDOW words is searched by its consecutive
pieces: within the edit bound, some piece keeps within its own share of it.

Defined results
---------------
* A document is contaminated by an item if a passage of it is within floor(max_edit * words) word edits.
* Null or blank items match nothing; one of a single word is in every text that has the word. Equal items (ties) each give a row.
* Null or blank texts match nothing and are kept by `decontaminate`, whatever their doc_id.
* A null doc_id is reported as null by `contaminated` and filtered like any other.
* Repeated rows are each searched; `contaminated` reports (doc_id, item_id) once, with the least edits, then
  the least position. Empty tables give empty results. Other columns are ignored, and pass through `decontaminate`.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import batch, lean

MAX_EDIT = 0.2
MAX_WINDOW = 64
STRIDE = 4
#: Items of fewer words are searched from every position, in a pass of their own: offset windows of them would be too short to tell.
SHORT = 12
WALKS = 3
#: Recall of the candidates at the edit bound, from which the number of tables of each walk and class of lengths follows; coordinates of each table.
RECALL = 0.92
MOST_TABLES = 40
COORDINATES = 3
#: Edited items that are simulated for each class.
TRIALS = 400
#: Steps of a class, as a multiple of its least window: a walk moves on at every other step.
REACH = 1.55
SEED = 1
BLOCK = 1 << 14
#: Words of items that one pass over the documents carries; more take several passes.
PASS_WORDS = 4_000_000

HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("position", pa.int32()), ("edits", pa.int32())])


@lru_cache(256)
def coordinates(least: int) -> list[tuple[int, list[np.ndarray]]]:
    """(steps, for each walk [MOST_TABLES, coordinates]) of windows of `least` words and more."""
    steps = max(COORDINATES + 1, int(REACH * least))
    rng = np.random.default_rng([SEED, least])
    parts = np.linspace(0, steps, COORDINATES + 1).astype(int)  # one coordinate of each third: neighbours often output the same word
    return steps, [np.stack([rng.integers(lo, hi, MOST_TABLES) for lo, hi in zip(parts[:-1], parts[1:])], axis=1) for _ in range(WALKS)]


def least_of_class(length: int) -> int:
    least = 1
    while (more := -(-least * 3 // 2)) <= length:
        least = more
    return least


def step_bits(words: np.ndarray, walk: int, steps: int) -> list[np.ndarray]:
    """The bits of 64 steps each; the word 0, past the end of a text, never moves on."""
    return [np.where(words == 0, K.U(0), K.mix(words ^ K.mix(np.array([SEED + 1000 * walk + k + 1], K.U) * K._C[5]))) for k in range(-(-steps // 64))]


@lru_cache(256)
def tables_for(least: int, stride: int, max_edit: float, recall: float = RECALL) -> int:
    """Tables of each walk of a class: how many find `recall` of simulated items of `least` words, each with the most edits allowed at random places."""
    rng = np.random.default_rng([SEED, least, 2])
    word = lambda n: rng.integers(1 << 20, 1 << 62, n).astype(K.U)
    items, texts = [], []
    for _ in range(TRIALS):
        item = word(least)
        edited = list(item)
        for _ in range(int(max_edit * least + 1e-9)):
            at, kind = int(rng.integers(0, len(edited))), rng.integers(0, 3)
            edited[at : at + (kind != 0)] = [] if kind == 1 else [word(1)[0]]
        text = np.concatenate([word(int(rng.integers(0, stride))), np.array(edited, K.U), word(2 * least)])
        items += [item[o:] for o in range(stride)]
        texts += [text[at:] for at in range(0, 3 * stride, stride)]
    steps, sampled = coordinates(least)
    first = np.full(TRIALS, MOST_TABLES)
    for walk in range(WALKS):
        a = Search._embed(items, walk, steps).reshape(steps, TRIALS, stride, 1)
        b = Search._embed(texts, walk, steps).reshape(steps, TRIALS, 1, 3)
        for t, table in enumerate(sampled[walk]):
            hit = (a[table] == b[table]).all(axis=0).any(axis=(1, 2))
            first[hit] = np.minimum(first[hit], t)
    return min(MOST_TABLES, int(np.sort(first)[math.ceil(recall * TRIALS) - 1]) + 1)


class Exact:
    """Items of so few words that no edit is allowed: looked up by all their words."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.tables = {}  # length: (sorted keys, their items)
        for n in {len(w) for _, w in items}:
            members = np.array([k for k, (_, w) in enumerate(items) if len(w) == n])
            keys = self._keys(np.concatenate([items[k][1] for k in members]).reshape(-1, n))
            order = np.argsort(keys, kind="stable")
            self.tables[n] = keys[order], members[order]

    @staticmethod
    def _keys(words: np.ndarray) -> np.ndarray:
        key = np.zeros(len(words), K.U)
        for k in range(words.shape[1]):
            key = K.mix(key * K._C[1] + words[:, k])
        return key

    def matches(self, padded: np.ndarray, doc: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """As Search.matches."""
        for n, (keys, members) in self.tables.items():
            if len(padded) < n:
                continue
            window = np.lib.stride_tricks.sliding_window_view(padded, n)
            key = self._keys(window)
            left, right = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            some = np.flatnonzero((right > left) & (window != 0).all(axis=1))
            for shift in range(int((right - left)[some].max()) if len(some) else 0):
                at = some[left[some] + shift < right[some]]
                item = members[left[at] + shift]
                for i in np.unique(item):
                    here = at[item == i]
                    here = here[(window[here] == self.items[i][1]).all(axis=1)]
                    yield doc[here], int(i), here - bound[doc[here]], np.zeros(len(here), np.int64)


class Search:
    """The tables of a set of items: arrays of words by item id."""

    def __init__(self, items: list[tuple[int, np.ndarray]], max_edit: float = MAX_EDIT):
        self.items, self.max_edit = items, max_edit
        self.stride = 1 if any(len(w) < SHORT for _, w in self.items) else STRIDE
        windows = []
        for k, (_, w) in enumerate(self.items):
            pieces = max(1, round(len(w) / MAX_WINDOW))
            bounds = np.linspace(0, len(w), pieces + 1).astype(int)
            windows += [(k, lo + o, hi) for lo, hi in zip(bounds[:-1], bounds[1:]) for o in range(self.stride)]
        by_class: dict[int, list[int]] = defaultdict(list)
        for x, (_, lo, hi) in enumerate(windows):
            by_class[least_of_class(hi - lo)].append(x)
        self.windows = np.array(windows, np.int64).reshape(-1, 3)
        self.steps = max((coordinates(c)[0] for c in by_class), default=0)
        self.tables = []  # (walk, class, coordinates, sorted keys, their windows, filter)
        for least, members in sorted(by_class.items()):
            _, sampled = coordinates(least)
            for walk in range(WALKS):
                embedded = self._embed([self.items[windows[x][0]][1][windows[x][1] : windows[x][2]] for x in members], walk, coordinates(least)[0])
                for table in sampled[walk][: tables_for(least, self.stride, max_edit)]:
                    keys = self._key(embedded[table])
                    order = np.argsort(keys, kind="stable")
                    size = 1 << max(16, int(8 * len(keys)).bit_length())
                    hit = np.zeros(size, bool)
                    hit[keys & K.U(size - 1)] = True
                    self.tables.append((walk, least, table, keys[order], np.array(members)[order], hit))

    @staticmethod
    def _key(outputs: np.ndarray) -> np.ndarray:
        key = outputs[0] * K._C[0]
        for k in range(1, len(outputs)):
            key = (key ^ (key >> K.U(29))) + outputs[k] * K._C[k % 8]
        return key ^ (key >> K.U(31))

    @staticmethod
    def _embed(windows: list[np.ndarray], walk: int, steps: int) -> np.ndarray:
        """[steps, windows]: what the walk outputs over each window, 0 past its end."""
        padded = np.concatenate([np.append(w, K.U(0)) for w in windows])
        bits, at = step_bits(padded, walk, steps), np.cumsum([0, *(len(w) + 1 for w in windows[:-1])])
        out = np.zeros((steps, len(windows)), K.U)
        for j in range(steps):
            out[j] = padded[at]
            at = at + ((bits[j >> 6][at] >> K.U(j & 63)) & K.U(1)).astype(np.int64)
        return out

    def candidates(self, padded: np.ndarray, walks: int = WALKS) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) where a table agrees; `padded` holds texts, each followed by a 0."""
        found: list[np.ndarray] = []
        for walk in range(walks):
            own = [t for t in self.tables if t[0] == walk]
            bits = step_bits(padded, walk, self.steps)
            wanted: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for t, (_, _, table, *_) in enumerate(own):
                for k, j in enumerate(table):
                    wanted[int(j)].append((t, k))
            for lo in range(0, len(padded), BLOCK * self.stride):
                at = np.arange(lo, min(lo + BLOCK * self.stride, len(padded)), self.stride, dtype=np.int64)
                start = padded[at] != 0
                keys: list[np.ndarray | None] = [None] * len(own)
                for j in range(self.steps):
                    if j in wanted:
                        out = padded[at]
                        for t, k in wanted[j]:
                            if k == 0:
                                keys[t] = out * K._C[0]
                            else:
                                x = keys[t]
                                keys[t] = (x ^ (x >> K.U(29))) + out * K._C[k % 8]
                    at += ((bits[j >> 6][at] >> K.U(j & 63)) & K.U(1)).astype(np.int64)
                for t, (_, _, _, sorted_keys, members, hit) in enumerate(own):
                    key = keys[t] ^ (keys[t] >> K.U(31))
                    some = np.flatnonzero(hit[key & K.U(len(hit) - 1)] & start)
                    if len(some):
                        left, right = np.searchsorted(sorted_keys, key[some]), np.searchsorted(sorted_keys, key[some], "right")
                        count = right - left
                        if count.any():
                            which = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                            found.append(np.stack([np.repeat(some, count) * self.stride + lo, members[which]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]

    def matches(self, padded: np.ndarray, doc: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(documents, item, positions, edits) within the edit bound. doc: of each position; bound: where each document's words begin, then the end."""
        position, window = self.candidates(padded)
        of = self.windows[window, 0]
        order = np.argsort(of, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
            item = int(of[group[0]])
            words = self.items[item][1]
            most = int(self.max_edit * len(words) + 1e-9)
            at, in_doc = position[group] - self.windows[window[group], 1], doc[position[group]]
            begins, ends = bound[in_doc], bound[in_doc + 1] - 1
            at = np.unique(np.stack([in_doc, np.maximum(at - most, begins), np.minimum(at + len(words) + 2 * most, ends)]), axis=1)
            for part in range(0, at.shape[1], 4096):
                docs, lo, hi = at[:, part : part + 4096]
                edits, end = best_placement(words, padded, lo, hi, most)
                good = np.flatnonzero(edits <= most)
                if len(good):
                    yield docs[good], item, (end - len(words) - bound[docs])[good].clip(0), edits[good]


def best_placement(item: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between the item and any part of text[lo:hi], and where the first best part ends. Parts that share too few words get most + 1."""
    width = int((hi - lo).max()) if len(lo) else 0
    edits, end = np.full(len(lo), most + 1), hi.copy()
    if not width:
        return edits, end
    cells = lo[:, None] + np.arange(width)
    window = np.where(cells < hi[:, None], text[np.minimum(cells, len(text) - 1)], K.U(0))
    ordered = np.unique(item)
    there = ordered[np.minimum(np.searchsorted(ordered, window), len(ordered) - 1)] == window
    able = np.flatnonzero(there.sum(axis=1) >= len(item) - most)
    if not len(able):
        return edits, end
    window = window[able]
    column = np.arange(width + 1)
    row = np.zeros((len(able), width + 1), np.int32)
    for k, word in enumerate(item):
        now = np.minimum(row + 1, k + 1)
        now[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (window != word))
        row = np.minimum.accumulate(now - column, axis=1) + column
    # cells past a window's end hold the word 0, which no item has: reaching them never costs less
    best = row.argmin(axis=1)
    edits[able], end[able] = row[np.arange(len(able)), best], lo[able] + best
    return edits, end


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice, each document followed by a 0; the document of each; where each begins, then the end."""
    words = K.Slice(texts)
    hashes = words.hashes
    padded = np.zeros(len(hashes) + words.n_docs, K.U)
    padded[np.arange(len(hashes)) + words.doc] = hashes | K.U(1)
    bound = words.first + np.arange(words.n_docs + 1)
    return padded, np.repeat(np.arange(words.n_docs), np.diff(bound)), bound


def searches(benchmark: DataFrame, max_edit: float) -> list[Search | Exact]:
    """The items, read to the driver: few-worded, short and other ones, in passes of PASS_WORDS words."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and item_id is not null").distinct().orderBy("item_id", "text").toLocalIterator()
    found, kinds = [], {k: ([], 0) for k in (Exact, True, False)}  # few words, short, others
    search = lambda kind, items: Exact(items) if kind is Exact else Search(items, max_edit)
    for item, text in rows:
        padded, _, _ = words_of(pa.array([text], pa.large_string()))
        if (n := len(padded) - 1) < 1:
            continue
        kind = Exact if int(max_edit * n + 1e-9) < 1 else n < SHORT
        items, held = kinds[kind]
        items.append((item, padded[:-1]))
        held += len(padded)
        if held > PASS_WORDS:
            found.append(search(kind, items))
            items, held = [], 0
        kinds[kind] = items, held
    return [*found, *(search(kind, items) for kind, (items, _) in kinds.items() if items)]


def _report(search: Search | Exact) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in K.slices(b.column(1)):
                ids = b.column(0).slice(at, len(texts))
                for docs, item, position, edits in search.matches(*words_of(texts)):
                    yield batch(HITS, ids.take(pa.array(docs)), np.full(len(docs), search.items[item][0]), position.astype(np.int32), edits.astype(np.int32))

    return run


def _keep(search: Search | Exact, column: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for at, texts in K.slices(b.column(column)):
                for docs, *_ in search.matches(*words_of(texts)):
                    clean[at + docs] = False
            yield b.filter(pa.array(clean))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT) -> DataFrame:
    """doc_id, item_id, position (word where the passage begins, as if it had the item's length), edits: every document that holds an item."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for search in searches(benchmark, max_edit):
        part = narrow.mapInArrow(lean(_report(search)), "doc_id long, item_id long, position int, edits int")
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, position int, edits int")
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "position")).alias("__best")).select("doc_id", "item_id", "__best.position", "__best.edits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT) -> DataFrame:
    """The documents that hold no item."""
    for search in searches(benchmark, max_edit):
        docs = docs.mapInArrow(lean(_keep(search, docs.columns.index("text"))), docs.schema)
    return docs
