"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each document becomes a vector of transformed statistics (NAMES). For each language and source, the minimum-
covariance-determinant estimate of location and scatter is found by concentration steps from several starts
(coordinate-wise robust, classical, small samples), the least determinant of them taken on to convergence; documents beyond the chi-square cutoff of the Mahalanobis distance are rejected.

Shares are shrunk to the corpus's own by a prior of PRIOR_CHARS or PRIOR_WORDS, so that short texts aren't outliers
by chance. FLOOR only bounds the scatter's eigenvalues from below, for groups (nearly) without spread. A step is an aggregation of
moments by group over the vectors: no task holds a group, and hot sources don't matter. Estimates are made of every group, every
language and the corpus; a language's is averaged with the corpus's, which weighs PRIOR_ROWS documents, and a
group's with its language's. So small groups lean on wider ones by degrees, and no size switches the method.

Defined results
---------------
* Null or blank texts have no statistics and are rejected: they aren't in the result.
* Null lang or source is a group of its own. A null doc_id is judged like any other; repeated rows are judged each.
* A group without spread has the floor's scatter. Ties at a step's quantile are all in. An empty table gives no rows.
* Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import batch, checked, cut, lean

NAMES = ("word_length", "upper", "digit", "sign", "repeated", "distinct")
PRIOR_CHARS, PRIOR_WORDS = 300.0, 60.0
#: Least standard deviations.
FLOOR = (0.005,) * 6
#: Documents that the wider estimate weighs in a group's or a language's.
PRIOR_ROWS = 60.0
COVERAGE = 0.75
#: Small samples to start from, beside the robust and the classical start; their rows.
SAMPLES, SAMPLE_ROWS = 2, 14
#: Steps of every start; of the best one at most, ended when no group's log determinant falls by TOLERANCE.
STEPS, MOST_STEPS, TOLERANCE = 2, 20, 1e-3
CUTOFF = 0.9999

_COUNTS = pa.schema([(c, pa.int64()) for c in ("chars", "words", "upper", "digit", "sign", "repeated", "distinct")])
_TABLES = {c: np.zeros(256, np.int32) for c in ("upper", "digit", "sign")}
_TABLES["upper"][ord("A") : ord("Z") + 1] = 1
_TABLES["digit"][ord("0") : ord("9") + 1] = 1
for _k in range(33, 127):
    _TABLES["sign"][_k] = not chr(_k).isalnum()


def counts(texts: pa.Array) -> list[np.ndarray]:
    """The columns of _COUNTS: bytes that aren't white space, tokens, ASCII upper-case, digits, signs, tokens that repeat the one before, distinct tokens."""
    t = K.Slice(texts, lower=False, table=K._SPACED)
    per_doc = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[t.offsets])
    h = t.hashes
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (t.doc[1:] == t.doc[:-1])]) if len(h) else np.zeros(0, bool)
    keys = np.unique((t.doc.astype(K.U) << K.U(K.GRAM_BITS)) | (h & K._GRAM_MASK))
    distinct = np.bincount((keys >> K.U(K.GRAM_BITS)).astype(np.int64), minlength=t.n_docs)
    chars = np.bincount(t.doc, t.ends - t.starts, t.n_docs).astype(np.int64)
    return [chars, np.diff(t.first), *(per_doc(_TABLES[c][t.data]) for c in ("upper", "digit", "sign")), np.bincount(t.doc[same], minlength=t.n_docs), distinct]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *_COUNTS])
    for b in batches:
        for at, texts in K.slices(b.column(3)):
            c = counts(texts)
            some = pa.array(c[1] > 0)
            yield batch(schema, *(b.column(k).slice(at, len(texts)).cast(schema.field(k).type) for k in range(3)), *c).filter(some)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n (of the group), x (vector of NAMES) of every text that isn't blank; checkpointed."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    raw = cut(narrow.where("text is not null").mapInArrow(lean(_count), "doc_id long, lang string, source string, " + ", ".join(f"{f.name} long" for f in _COUNTS)))
    s = raw.agg(*[F.sum(c).cast("double").alias(c) for c in _COUNTS.names], F.sum(F.log("words")).alias("log_words"), F.sum(F.log("distinct")).alias("log_distinct")).first().asDict()
    chars, words = s["chars"] or 1.0, s["words"] or 1.0

    def share(part: str, whole: str, prior: float, all_: float) -> Column:
        return F.asin(F.sqrt((F.col(part) + prior * (s[part] or 0.0) / all_) / (F.col(whole) + prior)))

    x = [
        F.log((F.col("chars") + PRIOR_WORDS * chars / words) / (F.col("words") + PRIOR_WORDS)),
        share("upper", "chars", PRIOR_CHARS, chars), share("digit", "chars", PRIOR_CHARS, chars), share("sign", "chars", PRIOR_CHARS, chars),
        share("repeated", "words", PRIOR_WORDS, words),
        F.log((F.col("distinct") + PRIOR_WORDS) / F.pow(F.col("words") + PRIOR_WORDS, F.lit(0.85))),
    ]
    return cut(raw.select("doc_id", "lang", "source", F.array(*x).alias("x")))


def chi2(p: float, k: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * (2 / (9 * k)) ** 0.5) ** 3


def _distance(x: str = "x", mean: str = "mean", inverse: str = "inverse") -> Column:
    k = len(NAMES)
    d = [F.col(x)[i] - F.col(mean)[i] for i in range(k)]
    total = None
    for i in range(k):
        for j in range(i, k):
            term = d[i] * d[j] * F.col(inverse)[i * k + j] * (1 if i == j else 2)
            total = term if total is None else total + term
    return total


def _moments(rows: DataFrame) -> DataFrame:
    k = len(NAMES)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(k)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    return rows.groupBy("key").agg(F.count("*").alias("n"), *sums)


def _inverse(scatter: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log determinant (in units of FLOOR) of the scatter, its eigenvalues bounded from below."""
    unit = np.outer(FLOOR, FLOOR)
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2 / unit)
    values = np.maximum(values, 1)
    return (vectors / values) @ vectors.T / unit, float(np.log(values).sum())


def _fitted(moments: DataFrame, coverage: float) -> DataFrame:
    """key, mean, inverse, logdet, scatter of each group's moments; scatter made consistent for the share `coverage` of nearest rows."""
    k = len(NAMES)
    # E of the truncated chi-square: P(chi2_{k+2} <= q) / coverage
    q = chi2(coverage, k) if coverage < 1 else None
    shrink = _below(q, k + 2) / coverage if q else 1.0

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                mean = np.array([r[f"s{i}"] / r["n"] for i in range(k)])
                second = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] / r["n"] for j in range(k)] for i in range(k)])
                scatter = (second - np.outer(mean, mean)) / shrink
                inverse, logdet = _inverse(scatter)
                out.append((r["key"], mean.tolist(), inverse.ravel().tolist(), logdet, scatter.ravel().tolist()))
            yield pd.DataFrame(out, columns=["key", "mean", "inverse", "logdet", "scatter"])

    return cut(moments.mapInPandas(run, "key string, mean array<double>, inverse array<double>, logdet double, scatter array<double>"))


def _below(q: float, k: int) -> float:
    """P(chi-square of k degrees <= q) (Wilson and Hilferty)."""
    return NormalDist().cdf(((q / k) ** (1 / 3) - (1 - 2 / (9 * k))) / (2 / (9 * k)) ** 0.5)


def _started(rows: DataFrame) -> DataFrame:
    """Medians and squared median deviations of each coordinate, as key, mean, inverse."""
    k = len(NAMES)
    middle = rows.groupBy("key").agg(F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(k)]).alias("mean"))
    off = rows.join(middle, "key").groupBy("key", "mean").agg(*[F.percentile_approx(F.abs(F.col("x")[i] - F.col("mean")[i]), 0.5, 1000).alias(f"d{i}") for i in range(k)])
    inverse = [1 / F.pow(F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOOR[i])), F.lit(2)) if i == j else F.lit(0.0) for i in range(k) for j in range(k)]
    return cut(off.select("key", "mean", F.array(*inverse).alias("inverse")))


def _step(rows: DataFrame, now: DataFrame, coverage: float) -> DataFrame:
    """The estimate of the share `coverage` of rows that are nearest by the estimate `now`."""
    far = rows.join(checked(now.select("key", "mean", "inverse")), "key").select("key", "x", _distance().alias("d"))
    edge = far.groupBy("key").agg(F.percentile_approx("d", coverage, 10_000).alias("edge"))
    return _fitted(_moments(far.join(edge, "key").where("d <= edge")), coverage)


def _sampled(rows: DataFrame, seed: int) -> DataFrame:
    """SAMPLE_ROWS rows of each key, by hash."""
    w = Window.partitionBy("key").orderBy(F.xxhash64("x", F.lit(seed)))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= SAMPLE_ROWS).drop("place")


def _started_all(rows: DataFrame) -> DataFrame:
    """The starts of each key; a start's number is put before the key."""
    starts = [_started(rows), _fitted(_moments(rows), 1.0), *(_fitted(_moments(_sampled(rows, seed)), 1.0) for seed in range(SAMPLES))]
    named = [s.select(F.concat(F.lit(str(k)), "key").alias("key"), "mean", "inverse") for k, s in enumerate(starts)]
    return cut(reduce(DataFrame.union, named))


def concentrated(rows: DataFrame, steps: int = STEPS, coverage: float = COVERAGE) -> DataFrame:
    """key, mean, inverse, logdet, scatter by minimum covariance determinant of the checkpointed rows(key, x)."""
    now = _started_all(rows)
    each = rows.select(F.explode(F.array(*[F.concat(F.lit(str(k)), "key") for k in range(2 + SAMPLES)])).alias("key"), "x")
    for _ in range(steps):
        now = _step(each, now, coverage)
    best = ["mean", "inverse", "logdet", "scatter"]
    now = cut(now.groupBy(F.expr("substr(key, 2)").alias("key")).agg(F.min_by(F.struct(*best), "logdet").alias("best")).select("key", "best.*"))
    for _ in range(MOST_STEPS):
        then, now = now, _step(rows, now, coverage)
        if now.join(then.select("key", F.col("logdet").alias("was")), "key").where(F.col("was") - F.col("logdet") > TOLERANCE).isEmpty():
            break
    return now


def estimates(rows: DataFrame, steps: int = STEPS, coverage: float = COVERAGE) -> DataFrame:
    """key, n, mean, inverse, scatter by minimum covariance determinant of rows(key, x), reweighted; n: all rows of the key."""
    rows = cut(rows)
    now = concentrated(rows, steps, coverage).drop("logdet")
    # reweighting: the rows within the 97.5 % ellipsoid of the estimate
    near = rows.join(checked(now.drop("scatter")), "key").where(_distance() <= chi2(0.975, len(NAMES)))
    again = _fitted(_moments(near), 0.975).drop("logdet")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    mine = [F.coalesce(F.col(c), F.col(f"{c}0")).alias(c) for c in ("mean", "inverse", "scatter")]
    return cut(sizes.join(now.select("key", *[F.col(c).alias(f"{c}0") for c in ("mean", "inverse", "scatter")]), "key").join(again, "key", "left").select("key", "n", *mine))


def shrunk(groups: DataFrame, fitted: DataFrame, prior: float = PRIOR_ROWS) -> DataFrame:
    """key, mean, inverse of each of groups(key, wide): its estimate averaged with its language's (wide), that with the corpus's ({})."""
    wide = lambda c, k: fitted.select(F.col("key").alias(k), *[F.col(x).alias(f"{x}{c}") for x in ("n", "mean", "scatter")])
    rows = groups.join(wide(1, "wide"), "wide").join(wide(2, "key"), "key")
    corpus = fitted.where("key = '{}'").first()  # one row, or none of an empty table

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                mean, scatter = np.array(corpus["mean"]), np.array(corpus["scatter"])
                for c in (1, 2):
                    own = r[f"n{c}"] / (r[f"n{c}"] + prior)
                    mean, scatter = own * np.array(r[f"mean{c}"]) + (1 - own) * mean, own * np.array(r[f"scatter{c}"]) + (1 - own) * scatter
                out.append((r["key"], mean.tolist(), _inverse(scatter.reshape(len(mean), -1))[0].ravel().tolist()))
            yield pd.DataFrame(out, columns=["key", "mean", "inverse"])

    return cut(rows.select("key", *[f"{x}{c}" for c in (1, 2) for x in ("n", "mean", "scatter")]).mapInPandas(run, "key string, mean array<double>, inverse array<double>"))


def judge(docs: DataFrame, prior: float = PRIOR_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, lang, source, distance (Mahalanobis), kept, of every text that isn't blank."""
    stats = statistics(docs)
    name = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    of_lang = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    named = stats.withColumns({"key": name, "wide": of_lang})
    fitted = estimates(named.select(F.explode(F.array("key", "wide", F.lit("{}"))).alias("key"), "x"))
    groups = shrunk(named.select("key", "wide").distinct(), fitted, prior)
    return named.join(checked(groups), "key").select("doc_id", "lang", "source", F.sqrt(_distance()).alias("distance"), (_distance() <= chi2(cutoff, len(NAMES))).alias("kept"))
