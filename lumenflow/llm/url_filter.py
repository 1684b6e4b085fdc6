"""URL filters: the ratio of two character language models.

Variable-order Markov models of accepted and of rejected URLs, both interpolated from order ORDER down
to the uniform distribution with Witten-Bell weights. A URL's score is the mean over its characters of the difference of
log probabilities; the cut is calibrated on URLs held out of the training: the score that parts them best (Youden's J), at
equal merit the one that keeps more.

Training URLs come labelled, as a table of (url, rejected). Where there is none, `listed` labels the pages' own URLs: a host
is rejected if REJECTED lists one of its terms (what '.', '-' and digits part, or several of them in a row). All distinct
labelled URLs count, one in HOLD_OUT of them, by hash, held out for the cut. Every URL of the table is scored; the models
judge the whole URL, so that they reject look-alikes that no list has (kasino) and may accept what a list catches by a term.

A character's probability depends on the gram of it and the ORDER characters before it alone, and the counts of all orders
are sums of those of grams. So grams are counted by aggregation, each distinct gram is valued once (lower orders meet
higher ones by joins), and URLs add up the values of their grams: broadcast up to BROADCAST_GRAMS, joined by shuffle beyond.

Defined results
---------------
* URLs are lower-cased and trimmed; characters beyond ASCII count as their UTF-8 bytes.
* A null or blank URL has no score and isn't accepted; it doesn't train, nor does one without a label. A URL labelled both ways is rejected. Without examples of both classes there is no model: scores are null
  and every URL that isn't blank is accepted.
* A null page_id is kept; repeated URLs weigh once in training, and each row is scored. Empty tables give no rows.
* Columns besides page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import batch, checked, cut, lean

REJECTED = ("casino", "bets", "pills", "ads-track", "poker", "viagra", "xxx", "porn", "lottery", "payday")
ORDER = 5
HOLD_OUT = 5
ALPHABET = 257  # bytes and the end
BITS = 9  # of a character in a gram: 54 for ORDER + 1
BROADCAST_GRAMS = 1_000_000
#: Grams that a task gathers before it merges them.
MERGE_GRAMS = 2_000_000
#: Ranges of scores for the prefix sums of the calibration.
RANGES = 4096


def contexts(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` characters before each position; positions of one URL follow a run of 0s."""
    h = np.full(len(at), K._C[order % 8], K.U)
    for back in range(1, order + 1):
        h = K.mix(h * K._C[7] + data[at - back].astype(K.U) + K.U(1))
    return h


def layout(urls: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters + 1, each URL after `order` 0s and before its end, 256 + 1; positions to predict; the URL of each)."""
    lengths = np.array([len(u) for u in urls], np.int64)
    starts = np.cumsum(lengths + order + 1) - (lengths + 1)
    data = np.zeros(int((lengths + order + 1).sum()), np.int64)
    of = np.repeat(np.arange(len(urls)), lengths + 1)
    at = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths + 1)
    flat = np.full(len(of), ALPHABET, np.int64)
    inner = np.ones(len(of), bool)
    inner[np.cumsum(lengths + 1) - 1] = False
    flat[inner] = np.frombuffer(b"".join(urls), np.uint8).astype(np.int64) + 1
    data[at] = flat
    return data, at, of


class Markov:
    """Counts by order, in memory: of contexts, of their distinct successors, and of context and successor."""

    def __init__(self, urls: list[bytes], order: int = ORDER):
        self.order = order
        data, at, _ = layout(urls, order)
        self.levels = []
        for k in range(order + 1):
            context = contexts(data, at, k)
            pair = K.mix(context + data[at].astype(K.U) * K._C[1])
            pairs, first, n = np.unique(pair, return_index=True, return_counts=True)
            known, inverse = np.unique(context[first], return_inverse=True)
            self.levels.append((pairs, n, known, np.bincount(inverse, n), np.bincount(inverse)))

    def log_probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        p = np.full(len(at), 1 / ALPHABET)
        for k, (pairs, n, known, total, kinds) in enumerate(self.levels):
            if not len(pairs):
                continue
            context = contexts(data, at, k)
            pair = K.mix(context + data[at].astype(K.U) * K._C[1])
            i = np.minimum(np.searchsorted(known, context), len(known) - 1)
            j = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            there = known[i] == context
            count = np.where(pairs[j] == pair, n[j], 0)
            p = np.where(there, (count + kinds[i] * p) / (total[i] + kinds[i]), p)
        return np.log(p)


@dataclass
class Filter:
    """Two models in memory, for lists of URLs."""

    accepted: Markov
    rejected: Markov
    cut: float

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Mean difference of log probabilities, the end included."""
        if not urls:
            return np.zeros(0)
        data, at, of = layout(urls, self.accepted.order)
        difference = self.accepted.log_probabilities(data, at) - self.rejected.log_probabilities(data, at)
        return np.bincount(of, difference, len(urls)) / np.bincount(of, minlength=len(urls))


def calibrated(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut, midway between two scores, of the most good at or above less bad at or above."""
    scores = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[scores[0] - 1e-9], (scores[1:] + scores[:-1]) / 2])
    good, bad = np.sort(good), np.sort(bad)
    merit = (1 - np.searchsorted(good, cuts) / len(good)) - (1 - np.searchsorted(bad, cuts) / len(bad))
    return float(cuts[int(merit.argmax())])


def _clean(url) -> F.Column:
    return F.lower(F.trim(url.cast("string")))


def grams(urls: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each position's gram, its own character in the lowest bits; the URL of each."""
    data, at, of = layout(urls, order)
    gram = np.zeros(len(at), np.int64)
    for back in range(order + 1):
        gram |= data[at - back] << (BITS * back)
    return gram, of


GRAMS = pa.schema([("gram", pa.int64()), ("good", pa.int64()), ("bad", pa.int64())])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of rows (url, good, bad), as far as this task sees; good and bad are what each of the URL's grams counts."""
    held, size = [], 0

    def merged() -> tuple[np.ndarray, ...]:
        gram, good, bad = (np.concatenate(x) for x in zip(*held))
        u, inverse = np.unique(gram, return_inverse=True)
        return u, *(np.bincount(inverse, n, len(u)).astype(np.int64) for n in (good, bad))

    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            part = b.slice(lo, 4096)
            gram, of = grams([u.encode() for u in part.column(0).to_pylist()])
            held.append((gram, *(part.column(k).to_numpy(zero_copy_only=False).astype(np.int64)[of] for k in (1, 2))))
            size += len(gram)
            if size > MERGE_GRAMS:
                held = [merged()]
                size = len(held[0][0])
                if size > MERGE_GRAMS // 2:
                    yield batch(GRAMS, *held[0])
                    held, size = [], 0
    if held:
        yield batch(GRAMS, *merged())


def gram_counts(urls: DataFrame) -> DataFrame:
    """gram, good, bad of rows (url, good, bad)."""
    part = urls.select("url", "good", "bad").mapInArrow(lean(_gram_counts), "gram long, good long, bad long")
    return part.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def values(counts: DataFrame) -> DataFrame:
    """gram, value: the difference of log probabilities of each gram of counts(gram, good, bad), those that count 0 included."""
    levels = [counts.select("gram", "good", "bad")]
    for k in range(ORDER, 0, -1):
        lower = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
        levels.append(cut(levels[-1].groupBy(lower.alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))))
    found = None
    for k, level in enumerate(reversed(levels)):
        of = Window.partitionBy(F.shiftright("gram", BITS))  # a context's successors: ALPHABET at most
        level = level.withColumns({f"{c}_{what}": f.over(of) for c in ("good", "bad") for what, f in (("all", F.sum(c)), ("kinds", F.sum((F.col(c) > 0).cast("long"))))})
        if found is None:
            level = level.withColumns({f"{c}_p": F.lit(1 / ALPHABET) for c in ("good", "bad")})
        else:
            below = cut(found.select(F.col("gram").alias("lower"), "good_p", "bad_p"))
            level = level.join(checked(below), F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)) == F.col("lower"))
        found = level.select("gram", *[F.when(F.col(f"{c}_all") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_p")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_p")).alias(f"{c}_p") for c in ("good", "bad")])
    return cut(found.select("gram", (F.log("good_p") - F.log("bad_p")).alias("value")))


def _means(urls: list[bytes], gram: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Mean value of each URL's grams, all of which are in `gram` (ascending)."""
    if not urls:
        return np.zeros(0)
    g, of = grams(urls)
    return np.bincount(of, value[np.searchsorted(gram, g)], len(urls)) / np.bincount(of, minlength=len(urls))


def url_scores(urls: DataFrame, found: DataFrame) -> DataFrame:
    """url, score of the distinct, checkpointed `urls`, from the values `found` of their grams."""
    if found.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        table = found.orderBy("gram").toPandas()
        held = urls.sparkSession.sparkContext.broadcast((table["gram"].to_numpy(np.int64), table["value"].to_numpy(np.float64)))
        schema = pa.schema([("url", pa.string()), ("score", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 4096):
                    url = b.column(0).slice(lo, 4096).cast(pa.string())
                    yield batch(schema, url, _means([u.encode() for u in url.to_pylist()], *held.value))

        return urls.select("url").mapInArrow(lean(run), "url string, score double")
    schema = pa.schema([("id", pa.int64()), ("gram", pa.int64())])

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                g, of = grams([u.encode() for u in part.column(1).to_pylist()])
                yield batch(schema, part.column(0).to_numpy()[of], g)

    named = cut(urls.select(F.monotonically_increasing_id().alias("id"), "url"))
    sums = named.mapInArrow(lean(positions), "id long, gram long").join(found, "gram").groupBy("id").agg(F.avg("value").alias("score"))
    return named.join(sums, "id").select("url", "score")


@dataclass
class Model:
    """counts: gram, good, bad of the training URLs, checkpointed; cut: the score from which a URL is accepted."""

    counts: DataFrame
    cut: float

    def of(self, urls: DataFrame) -> DataFrame:
        """url, score of distinct, checkpointed `urls`, none blank."""
        asked = gram_counts(urls.select("url", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad")))
        return url_scores(urls, values(cut(self.counts.union(asked).groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))))

    def scores(self, urls: list[bytes]) -> np.ndarray:
        if not urls:
            return np.zeros(0)
        texts = [u.decode() for u in urls]
        rows = self.counts.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(texts)], "url string")
        found = {r["url"]: r["score"] for r in self.of(cut(rows)).collect()}
        return np.array([found[t] for t in texts])


def best_cut(scored: DataFrame) -> float:
    """calibrated() of rows (bad, score): prefix sums within RANGES ranges of scores, and over them."""
    s = cut(scored.groupBy("score").agg(F.sum((~F.col("bad")).cast("long")).alias("good"), F.sum(F.col("bad").cast("long")).alias("bad")))
    low, high = s.agg(F.min("score"), F.max("score")).first()
    s = s.withColumn("range", F.least(F.floor((F.col("score") - low) / max(high - low, 1e-300) * RANGES), F.lit(RANGES)).cast("int"))
    ranges = s.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last")).orderBy("range").collect()  # RANGES + 1 rows at most
    before, good, bad, last = [], 0, 0, None
    for r in ranges:
        before.append((r["range"], good, bad, last))
        good, bad, last = good + r["good"], bad + r["bad"], r["last"]
    offsets = F.broadcast(s.sparkSession.createDataFrame(before, "range int, good_before long, bad_before long, last double"))
    w = Window.partitionBy("range").orderBy("score")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    less = lambda c: (F.sum(c).over(so_far) - F.col(c) + F.col(f"{c}_before")) / F.lit(float({"good": good, "bad": bad}[c]))
    each = s.join(offsets, "range").select("score", ((1 - less("good")) - (1 - less("bad"))).alias("merit"), F.coalesce(F.lag("score").over(w), "last").alias("previous"))
    best = each.orderBy(F.desc("merit"), "score").limit(1).first()
    return best["score"] - 1e-9 if best["previous"] is None else (best["score"] + best["previous"]) / 2


def listed(pages: DataFrame, terms: tuple[str, ...] = REJECTED) -> DataFrame:
    """url, rejected: the pages' URLs, labelled by whether a list has a term of the host."""
    host = F.regexp_extract(_clean(F.col("url")), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1)
    found = host.rlike(f"(^|[.0-9-])({'|'.join(terms)})([.0-9:-]|$)") if terms else F.lit(False)
    return pages.select("url", found.alias("rejected"))


def train(labelled: DataFrame) -> Model | None:
    """The filter of labelled(url, rejected), or None without examples of both classes."""
    urls = labelled.select(_clean(F.col("url")).alias("url"), F.col("rejected").cast("boolean").alias("bad")).where("url <> '' and bad is not null")
    urls = cut(urls.groupBy("url").agg(F.max("bad").alias("bad")).withColumn("held", F.pmod(F.xxhash64("url"), F.lit(HOLD_OUT)) == 0))
    sizes = {(r["bad"], r["held"]): r["count"] for r in urls.groupBy("bad", "held").count().collect()}
    if {b for b, _ in sizes} != {False, True}:
        return None
    # a class with no URL on one of the sides has all of its URLs on both
    whole = [b for b in (False, True) if len([1 for x, _ in sizes if x == b]) < 2]
    both = F.col("bad").isin(whole) if whole else F.lit(False)
    trained = urls.where(~F.col("held") | both).select("url", (~F.col("bad")).cast("long").alias("good"), F.col("bad").cast("long").alias("bad"))
    model = Model(cut(gram_counts(trained)), 0.0)
    held = cut(urls.where(F.col("held") | both))
    model.cut = best_cut(model.of(held).join(held, "url").select("bad", "score"))
    return model


def score(pages: DataFrame, model: Model | None) -> DataFrame:
    """page_id, url, score, accepted of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _clean(F.col("url")).alias("clean"))
    if model is None:
        return rows.select("page_id", "url", F.lit(None).cast("double").alias("score"), F.coalesce(F.col("clean") != "", F.lit(False)).alias("accepted"))
    found = model.of(cut(rows.where("clean <> ''").select(F.col("clean").alias("url")).distinct()))
    scored = rows.join(found.withColumnRenamed("url", "known"), F.col("clean") == F.col("known"), "left")
    return scored.select("page_id", "url", "score", F.coalesce(F.col("score") >= model.cut, F.lit(False)).alias("accepted"))
