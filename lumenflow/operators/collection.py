"""Search over many videos: filter, exact or approximate top-k, collapse of runs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames as fr
from .arrow import Vectors, dots, matrix, nearest
from .videos import best, per_video as of_videos, spaced

#: Vectors that an approximate index is fitted to (every frame is then indexed), and those of them that calibrate its probes.
TRAIN_ROWS, PROBE_QUERIES = 50_000, 500
#: Recall that the probes are calibrated for.
RECALL = 0.95


def videos(frames: DataFrame) -> DataFrame:
    return frames.select("video").distinct()


def collapse(hits: DataFrame, k: int | None, min_gap_s: float, per_video: int | None = None) -> DataFrame:
    """Best first: a hit goes if its video has `per_video` kept hits, or one closer than min_gap_s (strictly); the k best stay.

    What is kept of a video depends on that video alone, so the fold runs by (query, video) and only its results are
    ranked across videos. No more than k of a video can be among the k best, so its fold stops there; without a gap a
    ranking by (query, video) is enough.
    """
    most = min((x for x in (k, per_video) if x is not None), default=None)
    if min_gap_s <= 0 and most is not None:
        inside = F.row_number().over(Window.partitionBy("query_id", "video").orderBy(F.desc("sim"), "ts"))
        kept = hits.select("query_id", "video", F.col("ts").cast("double").alias("ts"), "sim").withColumn("__n", inside).where(F.col("__n") <= most).drop("__n")
        return _ranked(kept, k)
    packed = hits.groupBy("query_id", "video").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("neg"), F.col("ts").cast("double").alias("ts"), "sim"))).alias("rows"))
    kind = "array<struct<neg:double,ts:double,sim:double>>"

    def step(out: Column, r: Column) -> Column:
        skip = F.exists(out, lambda o: F.abs(o["ts"] - r["ts"]) < min_gap_s) if min_gap_s > 0 else F.lit(False)
        if most is not None:
            skip = (F.size(out) >= most) | skip
        return F.when(skip, out).otherwise(F.concat(out, F.array(r)))

    kept = packed.select("query_id", "video", F.explode(F.aggregate(F.col("rows").cast(kind), F.array().cast(kind), step)).alias("r")).select("query_id", "video", "r.ts", "r.sim")
    return _ranked(kept, k)


def _ranked(kept: DataFrame, k: int | None) -> DataFrame:
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "video", "ts")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def search(frames: DataFrame, queries: DataFrame, k: int = 20, video: str | None = None, min_gap_s: float = 30.0, per_video: int | None = None) -> DataFrame:
    """query_id, video, ts, sim, rank. `video` is bound as a literal and reaches the scan."""
    if video is not None:
        frames = frames.where(F.col("video") == F.lit(video))
    return _collapsed(frames, queries, k, min_gap_s, per_video)


def _collapsed(frames: DataFrame, queries: DataFrame, k: int | None, min_gap_s: float, per_video: int | None, lists: Callable[[Vectors], np.ndarray] | None = None) -> DataFrame:
    """`collapse` of frames against queries, a video in one task: what is kept of it leaves the task, its scores don't."""
    most = min((x for x in (k, per_video) if x is not None), default=None)
    choice = spaced(most, lambda _: min_gap_s, False, "ts") if min_gap_s > 0 else best(1 << 62 if most is None else most, "ts")
    rows = frames.select("video", F.col("ts").cast("double").alias("ts"), *(["list_id"] if lists else []), "emb")
    return _ranked(of_videos(rows, queries, choice, "ts double, sim double, pick int", ("ts",), lists).drop("pick"), k)


def best_per_video(frames: DataFrame, queries: DataFrame) -> DataFrame:
    """Each video's best frame, videos ranked by it."""
    top = of_videos(frames.select("video", "frame_idx", F.col("ts").cast("double").alias("ts"), "emb"), queries, best(1, "ts"), "ts double, sim double, pick int").drop("pick")
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "video")))


def n_lists(n: int) -> int:
    """Coarse partitions of an approximate index: about the root of the rows."""
    return max(1, min(round(n**0.5), TRAIN_ROWS // 4))


def _sample(frames: DataFrame) -> np.ndarray:
    """TRAIN_ROWS vectors of length 1 at most, of the least hashes of (video, frame)."""
    h = F.md5(F.concat_ws(":", "video", F.col("frame_idx").cast("string")))
    picked = frames.where("size(emb) > 0").select(F.transform("emb", lambda x: x.cast("float")).alias("emb"), h.alias("h")).orderBy("h").limit(TRAIN_ROWS).select("emb").toArrow().column(0).combine_chunks()
    x = np.array(picked.to_pylist(), np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else x


def centroids(frames: DataFrame, lists: int, iterations: int = 12) -> DataFrame:
    """list_id, c: `lists` centres (fewer in smaller tables) by spherical k-means of a bounded sample (TRAIN_ROWS)."""
    x = _sample(frames)
    c = x[: max(1, lists)].copy()
    for _ in range(iterations if len(x) else 0):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return frames.sparkSession.createDataFrame([(k, v.astype(float).tolist()) for k, v in enumerate(c)], "list_id int, c array<double>")


def calibrated_probes(frames: DataFrame, centres: DataFrame, k: int = 20, recall: float = RECALL) -> int:
    """The fewest probes by which PROBE_QUERIES vectors of the sample find the share `recall` of their k nearest of the sample.

    Neighbours are closer in the whole table than in a sample of it, so its recall is rather higher.
    """
    x, c = _sample(frames), np.array([r["c"] for r in centres.orderBy("list_id").collect()], np.float32)
    if not len(x):
        return 1
    q = x[:: max(1, len(x) // PROBE_QUERIES)]
    near, order = (x @ c.T).argmax(axis=1), np.argsort(-(q @ c.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :], axis=1)
    best = np.argpartition(-(q @ x.T), min(k, len(x)) - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(place, near[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def inverted_index(frames: DataFrame, centres: DataFrame) -> DataFrame:
    """Every frame with list_id, of the nearest centre: a map of Arrow batches, no shuffle. Write it partitioned by list_id: a search then reads its probes only."""
    return nearest(frames.select("video", "frame_idx", "ts", "emb"), centres)


def approximate_search(index: DataFrame, centres: DataFrame, queries: DataFrame, k: int, nprobes: int, min_gap_s: float = 30.0, per_video: int | None = None) -> DataFrame:
    """As `search`, in the nprobes lists of the centres nearest to each query."""
    found = centres.select("list_id", "c").orderBy("list_id").toArrow()
    ids, c = found.column(0).to_numpy(), found.column(1).combine_chunks()

    def lists(queries: Vectors) -> np.ndarray:
        near = np.zeros((len(queries.keys), min(nprobes, len(ids))), ids.dtype)
        for dim, at, x in queries.parts:
            near[at] = ids[np.argsort(-dots(x, matrix(c, dim)[0]), axis=1, kind="stable")[:, :nprobes]]
        return near

    return _collapsed(index, queries, k, min_gap_s, per_video, lists)


def overlap(exact: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, recall: the share of the exact hits (video, ts) that were found."""
    both = exact.select("query_id", "video", "ts").join(found.select("query_id", "video", "ts", F.lit(1).alias("hit")), ["query_id", "video", "ts"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
