"""Toxicity: a lexicon induced from a word graph by random walks, and documents scored with it.

1. Seeds: words that a bounded sample of labelled documents (MAX_LABELLED, by hash of doc_id; one of each
   group of near copies, so that a copied text doesn't speak for its words many times) ties to toxic
   documents (likelihood ratio, at a level that FALSE_SEEDS words would reach by chance), and frequent words that it doesn't.
2. Graph: nodes are all words of at least MIN_DOCS documents, whatever the corpus's size; edges are their positive,
   discounted pointwise mutual information within WINDOW words, counted over the whole corpus.
3. Walks with restart, one from the toxic and one from the neutral seeds: a word's polarity is the
   log ratio of the two walks' visits, each plus SMOOTH of the word's share of the graph and of what a toxic seed gets by
   restarts: a rare word beside one seed isn't polar by that. Labels give the seeds and nothing else of it.
4. A document's score is the sum of the polarities of the distinct lexicon words it has. The least polarity of
   the lexicon and the score that rejects are calibrated together on the labelled sample, each document
   scored without the seeds that only its own label makes: best F1, then the fewest rejections.

Counts of pairs are held as packed rows of tiles (SIDE words by SIDE words), so what is shuffled is some two bytes a
pair; rows of a tile are merged FAN_IN tasks at a time. Node numbers and the walks' vectors, 8 and 16 bytes a word, are broadcast
up to BROADCAST_WORDS words; with more of them the same walk is a join of edges and nodes (`wide_walk`), and the lexicon is joined too.

Defined results
---------------
* Null or blank text: score 0, kept. Null doc_id: scored and filtered like any other; it can't carry a label.
* Null labels and labels of absent documents are ignored. A doc_id with several labels is toxic if one of them is.
* Without toxic labels (or an empty corpus) the lexicon is empty and nothing is rejected. Repeated rows are scored each.
* Ties between words: by hash. Other columns are ignored, and pass through `reject`.
* `induce` and `reject` run jobs when they are called: the lexicon is in the plan they return.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import batch, cut, fresh, lean, release

MAX_LABELLED = 10_000
MIN_DOCS = 3
WINDOW = 2
#: Seeds that chance alone would give, and least odds ratio of a seed.
FALSE_SEEDS = 0.1
MIN_ODDS = 8.0
NEUTRAL_SHARE = 0.02
#: Documents of the sample count as copies if they share one of so many bands of so many minima of word pairs.
COPY_BANDS, COPY_ROWS = 10, 6
RESTART = 0.3
STEPS = 5
SMOOTH = 0.1
#: Calibration tries the least polarity of the 1, 2, 3, ... most polar words of the sample, in steps of this ratio.
RANKS = 1.05
#: Pairs that a task gathers before it merges them.
MERGE_PAIRS = 3_000_000
#: Words on a side of a tile, whose pairs are one packed row.
SIDE = 1 << 15
#: Tiles are held together in squares of a side of 1 / SQUARES of the words, so that a task's part of a vector is that long.
SQUARES = 5
#: Tasks whose rows of a tile are merged at a time.
FAN_IN = 256
#: Words up to which their numbers and the walks' vectors are broadcast, and bytes of the parts of a vector that the driver adds up.
BROADCAST_WORDS = 8_000_000
DRIVER_BYTES = 256 << 20


@dataclass
class Lexicon:
    """Hashes (ascending) and polarities of the lexicon's words, and the score from which a document is rejected.
    A lexicon that can't be broadcast is in `table` (h, polarity)."""

    hashes: np.ndarray
    polarity: np.ndarray
    threshold: float
    table: DataFrame | None = None

    def scores(self, words: K.Slice) -> np.ndarray:
        out = np.zeros(words.n_docs)
        hashes = word_ids(words)
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            pairs = np.unique(words.doc[hit] * len(self.hashes) + at[hit])
            np.add.at(out, pairs // len(self.hashes), self.polarity[pairs % len(self.hashes)])
        return out


def word_ids(words: K.Slice) -> np.ndarray:
    """52 bits of each word's hash: with a document's index they are one sort key."""
    return words.hashes & K._GRAM_MASK


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text")).where("text is not null")


def _doc_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each word, as far as this task sees."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])
    held, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        return h[order][starts], np.add.reduceat(n[order], starts)

    for b in batches:
        for _, texts in K.slices(b.column(0)):
            words = K.Slice(texts)
            keys = np.sort((words.doc.astype(K.U) << K.U(K.GRAM_BITS)) | word_ids(words))
            if len(keys):
                u, n = np.unique(keys[np.concatenate([[True], keys[1:] != keys[:-1]])] & K._GRAM_MASK, return_counts=True)
                held.append((u.view(np.int64), n))
                size += len(u)
            if size > MERGE_PAIRS:
                held = [merged()]
                size = len(held[0][0])
                if size > MERGE_PAIRS // 2:
                    yield batch(schema, *held[0])
                    held, size = [], 0
    if held:
        yield batch(schema, *merged())


def word_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h, n: documents of each word of at least min_docs; checkpointed."""
    counts = _texts(docs).mapInArrow(lean(_doc_counts), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return cut(counts.where(F.col("n") >= min_docs))


def vocabulary(counts: DataFrame) -> np.ndarray:
    """The words' hashes, ascending: a word's number is its place."""
    return np.sort(counts.select("h").toArrow().column(0).to_numpy().view(K.U))


ROWS = pa.schema([("square", pa.int32()), ("tile", pa.int64()), ("task", pa.int32()), ("pairs", pa.binary()), ("n", pa.binary())])
_ROWS = "square int, tile long, task int, pairs binary, n binary"


class Tiles:
    """Numbers of tiles and squares for so many words, and their packed rows."""

    def __init__(self, size: int):
        self.size, self.side, self.sides = size, SIDE, -(-size // SIDE)

    def keys(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Keys of pairs of words, ascending by tile."""
        x, y = np.minimum(x, y), np.maximum(x, y)
        return ((x // self.side * self.sides + y // self.side) * self.side + x % self.side) * self.side + y % self.side

    def pack(self, key: np.ndarray, n: np.ndarray, task: int) -> pa.RecordBatch:
        """A row for each tile of ascending keys."""
        tile = key // self.side**2
        starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        ends = np.append(starts[1:], len(key))
        compress = pa.Codec("zstd", 1).compress
        gap = np.diff(key, prepend=0)
        gap[starts] = key[starts] % self.side**2
        tile = tile[starts]
        a, b = (x * SQUARES // self.sides for x in (tile // self.sides, tile % self.sides))
        return batch(ROWS, (a * SQUARES + b).astype(np.int32), tile, np.full(len(tile), task, np.int32), [_packed(gap[s:e], compress) for s, e in zip(starts, ends)], [_packed(n[s:e], compress) for s, e in zip(starts, ends)])

    def edges(self, rows: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first word, of either side; its words and those of the other side, from there; counts) of each row."""
        for tile, pairs, n in zip(*(rows.column(k).to_pylist() for k in (1, 3, 4))):
            key = np.cumsum(_unpacked(pairs))
            yield tile // self.sides * self.side, tile % self.sides * self.side, key // self.side, key % self.side, _unpacked(n)


def _packed(x: np.ndarray, compress) -> bytes:
    width = 1 if x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4 if x.max() < 1 << 32 else 8
    raw = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()  # high bytes together: mostly 0
    small = compress(raw, asbytes=True)
    return bytes([width]) + len(raw).to_bytes(4, "little") + (small if len(small) < len(raw) else raw)


def _unpacked(x: bytes) -> np.ndarray:
    width, size, body = x[0], int.from_bytes(x[1:5], "little"), x[5:]
    raw = body if len(body) == size else pa.Codec("zstd").decompress(body, size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and the sums of their counts."""
    key, n = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(n[order], starts, dtype=n.dtype)


def _near(ids: np.ndarray, doc: np.ndarray, known: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids of known words at most `window` apart in a document."""
    both = [(ids[:-gap], ids[gap:], known[:-gap] & known[gap:] & (doc[:-gap] == doc[gap:])) for gap in range(1, window + 1)]
    return np.concatenate([x[k] for x, _, k in both]), np.concatenate([y[k] for _, y, k in both])


def _pair_counts(vocabulary: np.ndarray, tiles: Tiles, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of graph words at most `window` apart, as packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for b in batches:
            for _, texts in K.slices(b.column(0), max_docs=1 << 20):
                words = K.Slice(texts)
                h = word_ids(words)
                if not len(h):
                    continue
                at = np.minimum(np.searchsorted(vocabulary, h), tiles.size - 1)
                key, n = np.unique(tiles.keys(*_near(at, words.doc, vocabulary[at] == h, window)), return_counts=True)
                if len(key):
                    held.append((key, n.astype(np.uint32)))
                    count += len(key)
                if count > MERGE_PAIRS:
                    held.append(_added(held))
                    count = len(held[0][0])
                    if count > MERGE_PAIRS // 2:
                        yield tiles.pack(*held[0], task)
                        held, count = [], 0
        if held:
            yield tiles.pack(*_added(held), task)

    return run


def _add_rows(size: int) -> Callable[[pa.Table], pa.Table]:
    """One packed row of packed rows of a tile."""
    tiles = Tiles(size)

    def run(t: pa.Table) -> pa.Table:
        tile, task = t.column("tile")[0].as_py(), t.column("task")[0].as_py()
        pairs = [(np.cumsum(_unpacked(x)), _unpacked(n)) for x, n in zip(t.column("pairs").to_pylist(), t.column("n").to_pylist())]
        key, n = _added(pairs)
        return pa.Table.from_batches([tiles.pack(key + tile * tiles.side**2, n, task)])

    return run


def pair_table(docs: DataFrame, vocabulary: np.ndarray, window: int = WINDOW) -> DataFrame:
    """square, tile, task, pairs, n: how often two graph words stand at most `window` words apart; a packed row a tile. Checkpointed."""
    held, tiles = docs.sparkSession.sparkContext.broadcast(vocabulary), Tiles(len(vocabulary))  # BROADCAST_WORDS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pair_counts(held.value, tiles, window)(batches)

    texts = _texts(docs)
    part, tasks = texts.mapInArrow(lean(run), _ROWS), texts.rdd.getNumPartitions()
    while tasks > FAN_IN:  # no task gets the rows of a tile from all tasks
        tasks = -(-tasks // FAN_IN)
        part = part.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("tile", "task").applyInArrow(_add_rows(len(vocabulary)), _ROWS)
    squares = SQUARES * SQUARES
    return cut(part.repartition(2 * squares, "square").groupBy("square", "tile").applyInArrow(_add_rows(len(vocabulary)), _ROWS))


VECTOR = pa.schema([("first", pa.int64()), ("x", pa.binary())])


def _over(rows: DataFrame, size: int, columns: int, what: Callable[..., tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """[words, columns]: the sums over tiles of what(first a, first b, a, b, n) gives for the words of either side."""
    tiles = Tiles(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for part in batches:
            for i, j, a, b, n in tiles.edges(part):
                to_a, to_b = what(i, j, a, b, n)
                for first, where, weight in ((i, a, to_a), (j, b, to_b)):
                    total = out.setdefault(first, np.zeros((columns, tiles.side)))
                    for k in range(columns):
                        total[k] += np.bincount(where, weight[k], tiles.side)
        for first, total in out.items():
            yield batch(VECTOR, [first], [total.tobytes()])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, float) for x in t.column("x").to_pylist())
        return pa.table([t.column("first")[:1], pa.array([total.tobytes()], pa.binary())], VECTOR)

    parts = rows.mapInArrow(lean(run), "first long, x binary")
    if SQUARES * size * 8 * columns > DRIVER_BYTES:
        parts = parts.groupBy("first").applyInArrow(add, "first long, x binary")
    out = np.zeros((tiles.sides * SIDE, columns))
    found = parts.toArrow()
    for first, x in zip(found.column(0).to_pylist(), found.column(1)):
        out[first : first + SIDE] += np.frombuffer(x.as_buffer(), float).reshape(columns, SIDE).T
    return out[:size]


def _weights(a: np.ndarray, b: np.ndarray, n: np.ndarray, total: float) -> np.ndarray:
    """Positive pointwise mutual information of words of degrees a and b, discounted for small counts."""
    least = np.minimum(a, b)
    return np.maximum(np.log(n * total / (a * b)), 0) * (n / (n + 1)) * (least / (least + 1))


def walk(rows: DataFrame, toxic: np.ndarray, neutral: np.ndarray, size: int, restart: float = RESTART, steps: int = STEPS) -> np.ndarray:
    """Polarity of each word, from the visits of the walks from the two sets of seeds."""
    context = rows.sparkSession.sparkContext
    degree = _over(rows, size, 1, lambda i, j, a, b, n: ([n], [n]))[:, 0]
    total, held = degree.sum(), context.broadcast(np.maximum(degree, 1))

    def moved(vector: np.ndarray) -> np.ndarray:
        now = context.broadcast(vector)  # BROADCAST_WORDS at most, like the degrees

        def what(i: int, j: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[list, list]:
            w = _weights(held.value[i + a], held.value[j + b], n, total)
            other = np.where(i + a != j + b, w, 0)
            v = now.value
            return [w * v[j + b, k] for k in range(v.shape[1])], [other * v[i + a, k] for k in range(v.shape[1])]

        out = _over(rows, size, vector.shape[1], what)
        now.unpersist()
        return out

    strength = moved(np.ones((size, 1)))
    start = np.zeros((size, 2))
    start[toxic, 0], start[neutral, 1] = 1 / max(len(toxic), 1), 1 / max(len(neutral), 1)
    at = start
    for _ in range(steps):
        at = restart * start + (1 - restart) * moved(at / np.maximum(strength, 1e-12))
    more = SMOOTH * (strength[:, 0] / max(strength.sum(), 1e-12) + restart / max(len(toxic), 1))
    return np.log((at[:, 0] + more) / (at[:, 1] + more))


def wide_pairs(docs: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """a, b, n of graph words (hashes) at most `window` apart, by joins: for more words than can be broadcast. Checkpointed."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in K.slices(b.column(0), max_bytes=8 << 20):
                words = K.Slice(texts)
                h = word_ids(words).view(np.int64)
                x, y = _near(h, words.doc, np.ones(len(h), bool), window)
                pairs = np.sort(np.rec.fromarrays([np.minimum(x, y), np.maximum(x, y)], names="a,b"), order=["a", "b"])
                if len(pairs):
                    starts = np.flatnonzero(np.concatenate([[True], (pairs.a[1:] != pairs.a[:-1]) | (pairs.b[1:] != pairs.b[:-1])]))
                    yield batch(schema, pairs.a[starts], pairs.b[starts], np.diff(np.append(starts, len(pairs))))

    pairs = _texts(docs).mapInArrow(lean(run), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    known = counts.select("h")
    return cut(pairs.join(known.withColumnRenamed("h", "a"), "a", "left_semi").join(known.withColumnRenamed("h", "b"), "b", "left_semi").select("a", "b", "n"))


def wide_walk(pairs: DataFrame, seeds: DataFrame, restart: float = RESTART, steps: int = STEPS) -> DataFrame:
    """h, polarity of every word of pairs(a, b, n), from seeds(h, toxic, neutral: where the walks start); `walk` by joins. Checkpointed."""
    both = pairs.union(pairs.where("a <> b").select("b", "a", "n"))
    degree = cut(both.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n"))).cast("double").alias("d")))
    total = degree.agg(F.sum("d")).first()[0] or 0.0
    w = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    least = F.least("d", "e")
    edge = cut(w.select("a", "b", (F.greatest(F.log(F.col("n") * total / (F.col("d") * F.col("e"))), F.lit(0.0)) * (F.col("n") / (F.col("n") + 1)) * (least / (least + 1))).alias("w")))
    strength = cut(edge.groupBy("a").agg(F.sum("w").alias("s")))
    start = strength.join(seeds.withColumnRenamed("h", "a"), "a", "full").select("a", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("toxic", F.lit(0.0)).alias("t0"), F.coalesce("neutral", F.lit(0.0)).alias("n0"))
    at = cut(start.withColumns({"t": F.col("t0"), "n": F.col("n0")}))
    for _ in range(steps):
        out = edge.join(at.select(F.col("a").alias("b"), *[(F.col(c) / F.greatest("s", F.lit(1e-12))).alias(c) for c in ("t", "n")]), "b")
        moved = out.groupBy("a").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"{c}1") for c in ("t", "n")])
        at = cut(at.join(moved, "a", "left").select("a", "s", "t0", "n0", *[(restart * F.col(f"{c}0") + (1 - restart) * F.coalesce(f"{c}1", F.lit(0.0))).alias(c) for c in ("t", "n")]))
    all_, highest = strength.agg(F.sum("s")).first()[0] or 0.0, seeds.agg(F.max("toxic")).first()[0] or 0.0
    more = SMOOTH * (F.col("s") / max(all_, 1e-12) + restart * highest)
    return cut(at.select(F.col("a").alias("h"), F.log((F.col("t") + more) / (F.col("n") + more)).alias("polarity")))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(toxic, distinct word hashes, MinHash bands of word pairs) of the sample."""
    label = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__id is not null and __toxic is not null").groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    few = cut(label.orderBy(F.xxhash64("__id"), "__id").limit(most))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(few), F.col("doc_id") == F.col("__id")).select("__toxic", "text")  # `most` rows at most
    schema = pa.schema([("toxic", pa.int32()), ("words", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in K.slices(b.column(1)):
                words = K.Slice(texts)
                h = word_ids(words).view(np.int64)
                sketch = K.minhash(*K.gram_sets(texts, 2), COPY_BANDS * COPY_ROWS, 6).reshape(len(texts), COPY_BANDS, COPY_ROWS)
                bands = np.zeros((len(texts), COPY_BANDS), K.U)
                for r in range(COPY_ROWS):
                    bands = K.mix(bands * K._C[1] + sketch[:, :, r])
                yield batch(schema, b.column(0).slice(at, len(texts)), [np.unique(h[s:e]) for s, e in zip(words.first[:-1], words.first[1:])], list(bands.view(np.int64)))

    return [(r["toxic"], np.array(r["words"], np.int64).view(K.U), np.array(r["bands"])) for r in found.mapInArrow(lean(run), "toxic int, words array<long>, bands array<long>").toLocalIterator()]


def _one_of_copies(bands: list[np.ndarray]) -> list[int]:
    """The first of each group of documents that share a band."""
    parent = list(range(len(bands)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for place in range(COPY_BANDS):
        seen: dict[int, int] = {}
        for k in range(len(bands)):
            a, b = root(k), root(seen.setdefault(int(bands[k][place]), k))
            parent[max(a, b)] = min(a, b)
    return [k for k in range(len(bands)) if parent[k] == k]


def _log_odds(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Difference of the log-odds of words in count[label] of n[label] documents."""
    odds = [np.log((count[k] + 0.5) / (n[k] - count[k] + 0.5)) for k in (0, 1)]
    return odds[1] - odds[0]


def _is_seed(count: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """The words (of so many that are tested) that toxic documents have much more often, by the G statistic of the 2 x 2 table."""
    seen, all_ = count.sum(axis=0), max(n.sum(), 1)
    g = np.zeros(count.shape[1])
    for k in (0, 1):
        for observed, expected in ((count[k], n[k] * seen / all_), (n[k] - count[k], n[k] * (1 - seen / all_))):
            g += 2 * observed * np.log(np.maximum(observed, 1e-300) / np.maximum(expected, 1e-300))
    most = NormalDist().inv_cdf(1 - min(FALSE_SEEDS / max(words, 1), 0.5))
    return (np.sqrt(np.maximum(g, 0)) >= most) & (_log_odds(count, n) >= math.log(MIN_ODDS))


def induce(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, min_docs: int = MIN_DOCS, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS) -> Lexicon:
    """The lexicon and threshold of this corpus and these labels."""
    none = Lexicon(np.zeros(0, K.U), np.zeros(0), math.inf)
    sample = _labelled(docs, labels, max_labelled)
    sample = [sample[k][:2] for k in _one_of_copies([b for _, _, b in sample])]
    toxic = np.array([t for t, _ in sample], bool)
    if not toxic.any():
        return none
    counts = word_counts(docs, min_docs)
    size, spark = counts.count(), docs.sparkSession
    wide = size > broadcast_words
    asked = np.unique(np.concatenate([w for _, w in sample]))  # words of the sample, which is bounded
    if wide:
        held = spark.createDataFrame(pa.table({"h": asked.view(np.int64)}))
        known = np.sort(counts.select("h").join(held, "h", "left_semi").toArrow().column(0).to_numpy().view(K.U))
    else:
        words = vocabulary(counts)
        known = asked[np.isin(asked, words)]
    if not len(known):
        return none
    in_doc = [np.searchsorted(known, w[np.isin(w, known, assume_unique=True)]) for _, w in sample]
    count = np.zeros((2, len(known)))
    for t, x in zip(toxic, in_doc):
        count[int(t), x] += 1
    n = np.array([(~toxic).sum(), toxic.sum()], float)
    seed = _is_seed(count, n, len(known))
    neutral = (_log_odds(count, n) <= math.log(2)) & (count[0] >= NEUTRAL_SHARE * n[0])
    if not seed.any():
        return none
    if wide:
        which = seed | neutral
        seeds = spark.createDataFrame(pa.table({"h": known[which].view(np.int64), "toxic": seed[which] / seed.sum(), "neutral": neutral[which] / max(neutral.sum(), 1)}))
        found = wide_walk(wide_pairs(docs, counts, window), seeds)
        rows = found.join(spark.createDataFrame(pa.table({"h": known.view(np.int64)})), "h", "left_semi").toArrow()
        walked = np.zeros(len(known))
        walked[np.searchsorted(known, rows.column(0).to_numpy().view(K.U))] = rows.column(1).to_numpy()
        least, threshold = _calibrated(walked, seed, count, n, in_doc, toxic)
        return Lexicon(none.hashes, none.polarity, threshold, cut(found.where(F.col("polarity") >= least)))
    place = np.searchsorted(words, known)
    walked = walk(pair_table(docs, words, window), place[seed], place[neutral], size)
    release()  # the driver has to serve what comes after, too
    least, threshold = _calibrated(walked[place], seed, count, n, in_doc, toxic)
    chosen = walked >= least
    return Lexicon(words[chosen], walked[chosen], threshold)


def _calibrated(walked: np.ndarray, seed: np.ndarray, count: np.ndarray, n: np.ndarray, in_doc: list[np.ndarray], toxic: np.ndarray) -> tuple[float, float]:
    """The least polarity and the threshold of the best F1 on the sample; a word that is a seed by a document's own label only doesn't count for it."""
    weights = []
    for x, t in zip(in_doc, toxic.astype(int)):
        w = walked[x].copy()
        w[seed[x] & ~_is_seed(count[:, x] - np.array([[1 - t], [t]]), n - np.array([1 - t, t]), len(seed))] = 0
        weights.append(w)
    doc, weight = np.repeat(np.arange(len(weights)), [len(x) for x in weights]), np.concatenate(weights)
    positive = np.unique(walked[walked > 0])[::-1]
    if not len(positive):
        return math.inf, math.inf
    ranks = np.unique(np.append(RANKS ** np.arange(math.log(len(positive), RANKS)), len(positive)).astype(int)) - 1
    best = (0.0, 0, math.inf, math.inf)
    for least in positive[ranks]:
        score = np.bincount(doc, np.where(weight >= least, weight, 0), len(weights))
        order = np.argsort(-score, kind="stable")
        s, hit = score[order], np.cumsum(toxic[order])
        last = np.flatnonzero(np.append(s[1:] != s[:-1], True) & (s > 0))
        if len(last):
            f = 2 * hit[last] / (last + 1 + toxic.sum())
            k = int(f.argmax())
            lower = s[last[k] + 1] if last[k] + 1 < len(s) else 0.0
            best = max(best, (float(f[k]), -int(last[k]), float(least), float((s[last[k]] + max(lower, 0)) / 2)))
    return best[2:] if best[0] else (math.inf, math.inf)


def _scored(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """__row, __score of the rows that have words of a lexicon that isn't broadcast; texts: __row, text."""
    schema = pa.schema([("__row", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in K.slices(b.column(1)):
                words = K.Slice(part)
                keys = np.unique((words.doc.astype(K.U) << K.U(K.GRAM_BITS)) | word_ids(words))
                yield batch(schema, b.column(0).slice(at, len(part)).take(pa.array((keys >> K.U(K.GRAM_BITS)).astype(np.int64))), (keys & K._GRAM_MASK).view(np.int64))

    return texts.mapInArrow(lean(run), "__row long, h long").join(lexicon.table, "h").groupBy("__row").agg(F.sum("polarity").alias("__score"))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, toxicity, toxic of every row of docs."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if lexicon.table is not None:
        rows = narrow.withColumn("__row", F.monotonically_increasing_id())
        value = F.coalesce("__score", F.lit(0.0))
        return rows.join(_scored(rows.select("__row", "text"), lexicon), "__row", "left").select("doc_id", value.alias("toxicity"), (value >= lexicon.threshold).alias("toxic"))
    schema = pa.schema([("doc_id", pa.int64()), ("toxicity", pa.float64()), ("toxic", pa.bool_())])
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # BROADCAST_WORDS at most
    release()  # what the sample and the walks took of the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in K.slices(b.column(1)):
                s = held.value.scores(K.Slice(texts))
                yield batch(schema, b.column(0).slice(at, len(texts)), s, s >= held.value.threshold)

    return narrow.mapInArrow(lean(run), "doc_id long, toxicity double, toxic boolean")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score as toxic."""
    lexicon, column = induce(docs, labels), docs.columns.index("text")
    if lexicon.table is not None:
        row = fresh(docs, "__row")
        rows = docs.withColumn(row, F.monotonically_increasing_id())
        bad = _scored(rows.select(F.col(row).alias("__row"), F.col("text").cast("string").alias("text")), lexicon).where(F.col("__score") >= lexicon.threshold)
        return rows.join(bad.select(F.col("__row").alias(row)), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # BROADCAST_WORDS at most
    release()  # what the sample and the walks took of the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for at, texts in K.slices(b.column(column)):
                keep[at : at + len(texts)] = held.value.scores(K.Slice(texts)) < held.value.threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
