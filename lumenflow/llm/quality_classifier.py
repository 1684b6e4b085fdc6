"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w x): one weight vector over hashed text features is shared by
all grades, whose thresholds are ordered. Features are the hashed words and the hashed shapes of the space-
separated tokens (runs of lower, upper, digit and each sign; 'same as before' for a repeated token), each
group as the square roots of its shares, so that both have length 1 whatever the text's length.

Grades come from `labels`: 0 for low quality, 1 for good but toxic, 2 for good and clean. The model is fitted on
at most MAX_LABELLED graded documents, those of the least hashes; every document is scored.

Defined results
---------------
* Null or blank texts have no features: they are never selected, their scores are null.
* A null in quality or toxic, a grade of an absent document: not used. Several labels of a doc_id: the least grade.
* Without graded documents there is no model: scores are null, and all but blank texts are selected.
* A null doc_id is scored; repeated rows are scored each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import batch, cut, lean

MAX_LABELLED = 10_000
BITS = 18
#: Least grade that counts as good, and its tail probability from which a document is selected.
TAIL_GRADE, MIN_TAIL = 1, 0.5
EPOCHS, RATE, RIDGE = 200, 0.1, 1e-5

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, buckets, values) of a slice: the features of document d are first[d]:first[d + 1]."""
    tokens = K.Slice(texts, lower=False, table=K._SPACED)
    shapes, n = _shapes(tokens), tokens.n_docs
    words = K.Slice(texts)
    out = [_shares(words.doc, words.hashes, n, 0), _shares(tokens.doc, shapes, n, 1)]
    doc, bucket, value = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(doc, kind="stable")
    return np.searchsorted(doc[order], np.arange(n + 1)), bucket[order], value[order]


def _shapes(tokens: K.Slice) -> np.ndarray:
    if not len(tokens.starts):
        return np.zeros(0, K.U)
    kind = _CLASS[tokens.data]
    kept = np.concatenate([[True], kind[1:] != kind[:-1]])
    kept[tokens.starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    runs = kind[kept].astype(K.U) + K.U(1)
    up, down = K.powers(len(runs))
    sums = np.concatenate([[K.U(0)], np.cumsum(runs * up[: len(runs)], dtype=K.U)])
    at, to = place[tokens.starts], place[tokens.ends]
    shape = K.mix((sums[to] - sums[at]) * down[at])
    h = tokens.hashes
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (tokens.doc[1:] == tokens.doc[:-1])])
    shape[same] = K.U(1)
    return shape


def _shares(doc: np.ndarray, hashes: np.ndarray, n: int, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bucket = (K.mix(hashes + K._C[group]) >> K.U(64 - BITS)).astype(np.int64)
    key, count = np.unique((doc << BITS) | bucket, return_counts=True)
    total = np.bincount(doc, minlength=n)
    return key >> BITS, (key & ((1 << BITS) - 1)).astype(np.int32) + (group << BITS), np.sqrt(count / total[key >> BITS]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, first: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[bucket] * value)])
        return sums[first[1:]] - sums[first[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """[documents, grades - 1]: P(grade > k)."""
        return 1 - _sigmoid(self.thresholds - scores[:, None])


def fit(grades: np.ndarray, first: np.ndarray, bucket: np.ndarray, value: np.ndarray, n_grades: int, epochs: int = EPOCHS) -> Model:
    """Maximum likelihood with a ridge, by Adam over all rows. Thresholds: the first, then logs of the gaps."""
    size = 2 << BITS
    row = np.repeat(np.arange(len(grades)), np.diff(first))
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, epochs + 1):
        gaps = np.exp(p[size + 1 :])
        cuts = np.concatenate([p[size : size + 1], p[size] + np.cumsum(gaps)])
        f = np.bincount(row, p[bucket] * value, len(grades))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        a, b = _sigmoid(edges[grades + 1] - f), _sigmoid(edges[grades] - f)
        a, b = np.where(grades == n_grades - 1, 1.0, a), np.where(grades == 0, 0.0, b)
        likely = np.maximum(a - b, 1e-9)
        by_cut = np.bincount(grades, -a * (1 - a) / likely, n_grades)[:-1] + np.bincount(grades, b * (1 - b) / likely, n_grades)[1:]
        g = np.empty_like(p)
        g[:size] = np.bincount(bucket, (1 - a - b)[row] * value, size) / len(grades) + RIDGE * p[:size]
        g[size] = by_cut.sum() / len(grades)
        g[size + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * gaps / len(grades)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(p[:size].astype(np.float32), np.concatenate([p[size : size + 1], p[size] + np.cumsum(np.exp(p[size + 1 :]))]))


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade of the labels without nulls."""
    good = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return good.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2)).alias("grade"))


def train(docs: DataFrame, graded: DataFrame, n_grades: int = 3, max_labelled: int = MAX_LABELLED) -> Model | None:
    """A model of graded(doc_id, grade), or None if no graded document has text."""
    few = cut(graded.select(F.col("doc_id").alias("__id"), F.col("grade").cast("int").alias("__grade")).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("trim(text) <> ''").join(F.broadcast(few), F.col("doc_id") == F.col("__id")).select("__grade", "text")  # max_labelled rows at most
    schema = pa.schema([("grade", pa.int32()), ("bucket", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in K.slices(b.column(1)):
                first, bucket, value = features(part)
                offsets = pa.array(first, pa.int32())
                yield batch(schema, b.column(0).slice(at, len(part)), pa.ListArray.from_arrays(offsets, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(value, pa.float32())))

    rows = texts.mapInArrow(lean(run), "grade int, bucket array<int>, value array<float>").toArrow().combine_chunks()
    if not rows.num_rows:
        return None
    bucket, value = rows.column("bucket").combine_chunks(), rows.column("value").combine_chunks()
    first = bucket.offsets.to_numpy().astype(np.int64)
    return fit(rows.column("grade").to_numpy().astype(np.int64), first - first[0], bucket.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(), n_grades)


def score(docs: DataFrame, model: Model | None, tail_grade: int = TAIL_GRADE, min_tail: float = MIN_TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of tail_grade or more), selected, of every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("selected", pa.bool_())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** (BITS + 1) weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            for at, part in K.slices(b.column(1)):
                first, bucket, value = features(part)
                some = np.diff(first) > 0
                if own is None:
                    nothing = pa.nulls(len(part), pa.float64())
                    yield batch(schema, b.column(0).slice(at, len(part)), nothing, nothing, some)
                else:
                    tails = own.tails(own.scores(first, bucket, value))
                    tail = tails[:, tail_grade - 1]
                    yield batch(schema, b.column(0).slice(at, len(part)), pa.array(tails.sum(axis=1), mask=~some), pa.array(tail, mask=~some), some & (tail >= min_tail))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, expected_grade double, tail_probability double, selected boolean")
