"""From frame scores to chunk scores, and how deep to pool."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.vectors import bound, power_mean, topk_mean
from .videos import Choice, Frames

EMPTY = -1e9
#: Sums that a bootstrap task holds before it sends them on.
HELD_SUMS = 1 << 22
GRID = tuple(sorted({2**i for i in range(6)} | {3 * 2**i for i in range(4)}))


def chunked(frames: DataFrame, width: float, n_chunks: Column | str) -> DataFrame:
    """Frames with chunk: the last chunk that starts at or before ts, within the video's. An equi-key, no range join."""
    n = F.col(n_chunks) if isinstance(n_chunks, str) else n_chunks
    return frames.withColumn("chunk", F.greatest(F.lit(0), F.least(F.floor(F.col("ts") / width), n - 1)).cast("int"))


def estimate(values: Column, mode: str, param: float = 0.0, video_min: Column | None = None) -> Column:
    """One score of an array of scores: max, mean, topk (k), adaptive (k = n / f), softmax (tau), power (p), varpen and varbonus (lambda)."""
    avg = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    spread = bound(avg, lambda m: F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(values)))
    top = F.array_max(values)
    if mode == "max":
        return top
    if mode == "mean":
        return avg
    if mode == "topk":
        return topk_mean(values, int(param))
    if mode == "adaptive":
        return topk_mean(values, F.greatest(F.lit(1), F.bround(F.size(values) / F.lit(float(param))).cast("int")))
    if mode == "softmax":
        weight = lambda x, m: F.exp(F.lit(float(param)) * (x - m))
        return bound(top, lambda m: F.aggregate(values, F.lit(0.0), lambda s, x: s + weight(x, m) * x) / F.aggregate(values, F.lit(0.0), lambda s, x: s + weight(x, m)))
    if mode == "power":
        least = F.array_min(values) if video_min is None else video_min
        return power_mean(values, float(param), F.lit(1e-6) - least)
    if mode == "varpen":
        return top - F.lit(float(param)) * spread
    if mode == "varbonus":
        return avg + F.lit(float(param)) * spread
    raise ValueError(f"unknown aggregation {mode!r}")


def score_chunks(scored: DataFrame, chunks: DataFrame, mode: str = "topk", param: float = 4, keys: tuple[str, ...] = ("query_id", "video")) -> DataFrame:
    """keys, chunk, score: scored(keys, chunk, sim) pooled; chunks(keys, chunk) without a frame get EMPTY and rank last."""
    least = F.min("sim").over(Window.partitionBy(*keys))
    packed = scored.withColumn("__least", least).groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.col("sim").cast("double"))).alias("v"), F.first("__least").alias("least"))
    pooled = packed.select(*keys, "chunk", estimate(F.col("v"), mode, param, F.col("least")).alias("score"))
    return chunks.join(pooled, [*keys, "chunk"], "left").withColumn("score", F.coalesce("score", F.lit(EMPTY)))


def estimates(x: np.ndarray, mode: str, param: float, least: np.ndarray) -> np.ndarray:
    """`estimate` of the last axis, sorted ascending, in its order of summation; least: [rows] of the video."""
    n = x.shape[-1]

    def total(y: np.ndarray) -> np.ndarray:
        s = np.zeros(y.shape[:-1])
        for k in range(y.shape[-1]):
            s += y[..., k]
        return s

    def top(k: int) -> np.ndarray:
        k = max(1, min(k, n))
        return total(x[..., ::-1][..., :k]) / k

    avg = total(x) / n
    if mode == "max":
        return x[..., -1]
    if mode == "mean":
        return avg
    if mode == "topk":
        return top(int(param))
    if mode == "adaptive":
        return top(round(n / param))
    if mode == "softmax":
        weight = np.exp(param * (x - x[..., -1:]))
        return total(weight * x) / total(weight)
    if mode == "power":
        shift = 1e-6 - least
        return (total((x + shift[:, None, None]) ** param) / n) ** (1 / param) - shift[:, None]
    if mode in ("varpen", "varbonus"):
        spread = param * np.sqrt(total((x - avg[..., None]) ** 2) / n)
        return x[..., -1] - spread if mode == "varpen" else avg + spread
    raise ValueError(f"unknown aggregation {mode!r}")


def _chunk_scores(rows: Frames, sim: np.ndarray, ok: np.ndarray, mode: str, param: float) -> np.ndarray:
    """[queries, chunks] of frames sorted by chunk, n chunks; EMPTY without a score."""
    n = rows.numbers("n")[0]
    out = np.full((len(sim), 0 if np.isnan(n) else int(n)), EMPTY)
    chunk, sim = rows.numbers("chunk")[ok].astype(int), sim[:, ok]
    if not sim.size:
        return out
    least, starts = sim.min(axis=1), np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    sizes = np.diff(np.r_[starts, len(chunk)])
    for size in np.unique(sizes):
        at = starts[sizes == size]
        out[:, chunk[at]] = estimates(np.sort(sim[:, at[:, None] + np.arange(size)], axis=2), mode, param, least)
    return out


def scored_chunks(mode: str = "topk", param: float = 4) -> Choice:
    """chunk, score of each query and video: `score_chunks` of frames(chunk, n) sorted by chunk, for `videos.per_video`."""

    def choose(rows: Frames, sim: np.ndarray, ok: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, list[pa.Array]]:
        score = _chunk_scores(rows, sim, ok, mode, param)
        of, chunk = np.divmod(np.arange(score.size), max(1, score.shape[1]))
        return of, [pa.array(chunk), pa.array(score.ravel())]

    return choose


def standardised_chunks(mode: str = "topk", param: float = 4) -> Choice:
    """chunk, z: the scores of chunks with frames against their mean and spread in the query and video."""

    def choose(rows: Frames, sim: np.ndarray, ok: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, list[pa.Array]]:
        z, some, _ = _standardised(_chunk_scores(rows, sim, ok, mode, param))
        of, chunk = np.nonzero(some)
        return of, [pa.array(chunk), pa.array(z[of, chunk])]

    return choose


def _standardised(score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, where there are frames, how many) of [queries, chunks]."""
    some = ~(score <= -1e8)
    n = some.sum(axis=1)
    count = np.maximum(n, 1)[:, None]
    away = np.where(some, score - np.where(some, score, 0.0).sum(axis=1, keepdims=True) / count, 0.0)
    return away / (np.sqrt((away**2).sum(axis=1, keepdims=True) / count) + 1e-9), some, n


def peaks(mode: str = "topk", param: float = 4) -> Choice:
    """peakedness: how far the best chunk is above the mean, in spreads."""

    def choose(rows: Frames, sim: np.ndarray, ok: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, list[pa.Array]]:
        z, some, n = _standardised(_chunk_scores(rows, sim, ok, mode, param))
        of = np.flatnonzero(n)
        return of, [pa.array(np.where(some, z, -np.inf)[of].max(axis=1, initial=-np.inf))]

    return choose


def signals(mode: str = "topk", param: float = 4) -> Choice:
    """n, margin, gap5, entropy, near_top: `confidence` of the chunks with frames."""

    def choose(rows: Frames, sim: np.ndarray, ok: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, list[pa.Array]]:
        score = _chunk_scores(rows, sim, ok, mode, param)
        z, some, n = _standardised(score)
        of = np.flatnonzero(n)
        made = []
        for q in of:
            s, own = score[q, some[q]], z[q, some[q]]
            if len(s) < 3:
                made.append((0.0, 0.0, 0.0, 1.0))
                continue
            head = own[np.argsort(-s, kind="stable")[:5]]
            p = np.exp(own - own.max())
            p /= p.sum()
            made.append((head[0] - head[1], head[0] - head[1:].mean(), -(p * np.log(p + 1e-12)).sum() / np.log(len(s)), (s >= s.max() - 0.1 * (s.max() - s.min())).mean()))
        return of, [pa.array(n[of]), *(pa.array(np.array([m[k] for m in made], float)) for k in range(4))]

    return choose


def true_ranks(every: int, mode: str = "topk", param: float = 4) -> Choice:
    """rank: how many other chunks are above the best of each `every`-th, which are the true ones."""

    def choose(rows: Frames, sim: np.ndarray, ok: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, list[pa.Array]]:
        score = _chunk_scores(rows, sim, ok, mode, param)
        of, true = np.arange(len(score) if score.shape[1] else 0), np.arange(score.shape[1]) % every == 0
        above = [int((score[q, ~true] > score[q, true].max()).sum()) for q in of]
        return of, [pa.array(above, pa.int64())]

    return choose


def matching_units(groups: DataFrame, min_examples: int = 10) -> DataFrame:
    """m of groups(relevant ARRAY<BOOLEAN>): the median count of matching sub-units of examples with any; null under min_examples."""
    m = groups.select(F.size(F.filter("relevant", lambda x: x)).alias("m")).where("m > 0")
    return m.agg(F.count("*").alias("n_examples"), F.percentile("m", 0.5).alias("m")).select("n_examples", F.when(F.col("n_examples") >= min_examples, F.col("m")).alias("m"))


def recommended_k(m: Column | str) -> Column:
    """Half of m, rounded half to even, at least 1."""
    c = F.col(m) if isinstance(m, str) else m
    return F.greatest(F.lit(1), F.bround(c * 0.5).cast("int"))


def k_range(m: Column | str) -> Column:
    """Depths worth trying for m matching units, ascending."""
    c = F.ceil(F.col(m) if isinstance(m, str) else m).cast("int")
    most = F.greatest(F.lit(2), c)
    own = F.array(c, F.greatest(F.lit(1), F.floor(c / 2).cast("int")))
    return F.array_sort(F.filter(F.array_union(F.array(*[F.lit(k) for k in GRID]), own), lambda k: (k <= most) & (k >= 1)))


def sweep_k(candidates: DataFrame, ks: list[int], metric: str = "head") -> DataFrame:
    """k, score, n_groups: candidates(group, item, is_positive, scores) ranked in their group by the mean of the k best.

    'head': is the best a positive? 'auc': the share of (positive, negative) pairs in order, ties by item. Groups of one kind only are out.
    """
    grid = candidates.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    mixed = Window.partitionBy("group")
    rows = candidates.withColumns({"__p": F.sum(F.col("is_positive").cast("int")).over(mixed), "__n": F.count("*").over(mixed)}).where("__p > 0 and __p < __n").drop("__p", "__n")
    pooled = rows.crossJoin(F.broadcast(grid)).select("k", "group", "item", "is_positive", topk_mean(F.col("scores"), F.col("k")).alias("s"))
    if metric == "head":
        per = pooled.groupBy("k", "group").agg(F.max(F.struct("s", (-F.col("item")).alias("i"), F.col("is_positive").cast("double").alias("hit"))).alias("b")).select("k", F.col("b.hit").alias("v"))
    elif metric == "auc":
        per = auc(pooled.withColumnRenamed("s", "score"), ("k", "group"), "item").select("k", F.col("auc").alias("v"))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return per.groupBy("k").agg(F.avg("v").alias("score"), F.count("*").alias("n_groups"))


def best_k(sweep: DataFrame) -> DataFrame:
    """The first k of the highest score, and whether the sweep is flat (within 0.01)."""
    return sweep.agg(F.max(F.struct("score", (-F.col("k")).alias("neg"))).alias("b"), (F.max("score") - F.min("score") < 0.01).alias("flat")).select((-F.col("b.neg")).alias("best_k"), F.col("b.score").alias("score"), "flat")


def auc(rows: DataFrame, keys: tuple[str, ...], tie: str) -> DataFrame:
    """keys, auc by rank sums of rows(keys, score, is_positive); ties by `tie`. Null for keys of one kind only."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("score", tie)).cast("double")
    g = rows.withColumn("__r", rank).groupBy(*keys).agg(F.sum(F.when(F.col("is_positive"), F.col("__r"))).alias("s"), F.count_if("is_positive").cast("double").alias("a"), F.count_if(~F.col("is_positive")).cast("double").alias("b"))
    return g.select(*keys, F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("s") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b"))).alias("auc"))


def win_probability(beaten: Column, others: Column, drawn: int) -> Column:
    """The chance that all of `drawn` of `others` rivals, without replacement, are among the beaten: C(b, s) / C(N, s) by logs."""
    terms = F.transform(F.sequence(F.lit(0), F.lit(drawn - 1)), lambda i: F.ln((beaten - i) / (others - i)))
    return F.when(beaten < drawn, F.lit(0.0)).otherwise(F.exp(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def confidence(chunk_scores: DataFrame, keys: tuple[str, ...] = ("query_id", "video")) -> DataFrame:
    """Routing signals of a ranking: margin of the first two, gap of the first to the mean of the next four, normalised entropy, share within 10 % of the top. Under 3 rows: 0, 0, 0, 1."""
    all_ = Window.partitionBy(*keys)
    order = all_.orderBy(F.desc("score"), "chunk")
    sd = F.stddev_pop("score").over(all_)
    z = (F.col("score") - F.avg("score").over(all_)) / (sd + 1e-9)
    r = chunk_scores.withColumns({"rn": F.row_number().over(order), "z": z, "top": F.max("score").over(all_), "low": F.min("score").over(all_)})
    r = r.withColumn("e", F.exp(F.col("z") - F.max("z").over(all_))).withColumn("p", F.col("e") / F.sum("e").over(all_))
    g = r.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("rn") == 1, F.col("z"))).alias("z1"), F.max(F.when(F.col("rn") == 2, F.col("z"))).alias("z2"),
        F.avg(F.when(F.col("rn").between(2, 5), F.col("z"))).alias("z5"),
        (-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12))).alias("h"),
        F.avg((F.col("score") >= F.col("top") - 0.1 * (F.col("top") - F.col("low"))).cast("double")).alias("near"),
    )
    some = F.col("n") >= 3
    return g.select(*keys, "n", F.when(some, F.col("z1") - F.col("z2")).otherwise(0.0).alias("margin"), F.when(some, F.col("z1") - F.col("z5")).otherwise(0.0).alias("gap5"), F.when(some, F.col("h") / F.ln(F.col("n").cast("double"))).otherwise(0.0).alias("entropy"), F.when(some, F.col("near")).otherwise(1.0).alias("near_top"))


def bootstrap(values: DataFrame, column: str, n_boot: int = 1000, seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, mean, low, high: a mean with its 95 % percentile interval over `n_boot` resamples; nulls and NaN are out.

    Poisson bootstrap: every row draws its weight in each resample from a hash, so its result doesn't depend on
    partitions or order. Weights are made a batch at a time and summed before the shuffle: a partition sends `n_boot`
    pairs of sums for each of its keys.
    """
    good = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    own = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in good.columns])
    rows = good.select(*keys, F.col(column).cast("double").alias("__v"), own.alias("__h"))
    steps = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])  # quantiles of Poisson(1)
    schema = to_arrow_schema(rows.select(*keys).schema).append(pa.field("b", pa.int32())).append(pa.field("x", pa.float64())).append(pa.field("w", pa.int64()))
    shift = _mixed(np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, (x, w) in held.items():
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * n_boot, f.type) for v, f in zip(key, schema)), pa.array(np.arange(n_boot, dtype=np.int32)), pa.array(x), pa.array(w)], schema=schema)
            held.clear()

        for whole in batches:
            for start in range(0, whole.num_rows, step):
                part = whole.slice(start, step)
                v, h = part.column(len(keys)).to_numpy(zero_copy_only=False), part.column(len(keys) + 1).to_numpy(zero_copy_only=False).view(np.uint64)
                w = np.searchsorted(steps, (_mixed(h[:, None] ^ shift[None, :]) >> np.uint64(11)) / float(1 << 53))
                of = list(zip(*(part.column(k).to_pylist() for k in range(len(keys))))) if keys else [()] * len(v)
                places: dict[tuple, list[int]] = {}
                for at, key in enumerate(of):
                    places.setdefault(key, []).append(at)
                for key, at in places.items():
                    total = held.setdefault(key, [np.zeros(n_boot), np.zeros(n_boot, np.int64)])
                    total[0] += v[at] @ w[at]
                    total[1] += w[at].sum(axis=0)
                if len(held) * n_boot > HELD_SUMS:
                    yield from flush()
        yield from flush()

    step = max(1, (1 << 20) // n_boot)
    kinds = StructType([*rows.select(*keys).schema, StructField("b", IntegerType()), StructField("x", DoubleType()), StructField("w", LongType())])
    draws = rows.mapInArrow(run, kinds).groupBy("b", *keys).agg((F.sum("x") / F.sum("w")).alias("m"))
    bounds = draws.groupBy(*keys).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    means = good.groupBy(*keys).agg(F.avg(column).alias("mean"))
    return means.join(bounds, list(keys)) if keys else means.crossJoin(F.broadcast(bounds))  # one row each


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paired_bootstrap(values: DataFrame, a: str, b: str, **options) -> DataFrame:
    """The bootstrap of b - a by row."""
    return bootstrap(values.withColumn("__d", F.col(b) - F.col(a)), "__d", **options)
