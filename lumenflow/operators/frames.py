"""Frame tables: scores against query vectors, adjacency, segmentation.

A frame table has (video, frame_idx, ts, emb). Everything is partitioned by video: a video's frames are sorted in
one task, videos run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import dot, normalised
from .arrow import emitted, folded, products
from .videos import Choice, Frames, best, per_video


def by_time(*keys: str):
    return Window.partitionBy(*(keys or ("video",))).orderBy("frame_idx")


def query_vector(values: list[float], dim: int) -> list[float]:
    """A query as a unit vector; the dimension must be the index's."""
    v = np.asarray(values, float).ravel()
    if len(v) != dim:
        raise ValueError(f"the query has {len(v)} dimensions, the index has {dim}")
    size = float(np.linalg.norm(v))
    return (v / size if size > 0 else v).tolist()


def similarity(frames: DataFrame, queries: DataFrame) -> DataFrame:
    """Every frame's score against every query(query_id, q): the frame columns without emb, query_id, sim."""
    return products(frames, queries)


def adjacent_similarity(frames: DataFrame) -> DataFrame:
    """frames with adj, the similarity to the frame before; null for the first."""
    return frames.withColumn("adj", dot("emb", F.lag("emb").over(by_time())))


def motion(scored: DataFrame, weight: float, keys: tuple[str, ...] = ("video",)) -> DataFrame:
    """sim plus a motion term: 1 - adj, standardised in the video (0 for the first frame), on the scale of sim's spread."""
    w = Window.partitionBy(*keys)
    d = F.coalesce(1 - F.col("adj"), F.lit(0.0))
    z = (d - F.avg(d).over(w)) / (F.stddev_pop(d).over(w) + F.lit(1e-9))
    return scored.withColumn("sim", F.col("sim") + F.lit(weight) * z * F.stddev_pop("sim").over(w))


def _all(rows: Frames, value: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """frame_idx, value of every query and frame."""
    of, at = np.divmod(np.arange(value.size), max(1, len(rows)))
    return of, [rows.take("frame_idx", at), pa.array(value.ravel(), mask=~np.broadcast_to(known, value.shape).ravel())]


def motion_of(frames: DataFrame, queries: DataFrame, weight: float) -> DataFrame:
    """query_id, video, frame_idx, sim: `motion` of frames with adj against queries."""

    def choose(rows: Frames, sim: np.ndarray, ok: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, list[pa.Array]]:
        adj = rows.numbers("adj")
        d = np.where(rows.table.column("adj").combine_chunks().is_valid().to_numpy(zero_copy_only=False), 1 - adj, 0.0)
        spread = sim[:, ok].std(axis=1, keepdims=True) if ok.any() else np.zeros((len(sim), 1))
        return _all(rows, sim + weight * ((d - d.mean()) / (d.std() + 1e-9)) * spread, ok)

    return per_video(frames, queries, choose, "frame_idx int, sim double")


def cut_into(adjacent: DataFrame, n: int | Column) -> DataFrame:
    """Rows with adj -> with seg_id: the n - 1 least similar neighbours are cuts; n is clipped to 1 .. frames."""
    n = F.lit(n) if isinstance(n, int) else n
    all_ = Window.partitionBy("video")
    order = all_.orderBy(F.col("adj").asc_nulls_last(), "frame_idx")
    cuts = F.least(F.greatest(n, F.lit(1)), F.count("*").over(all_)) - 1
    marked = adjacent.withColumn("__cut", F.when(F.col("adj").isNotNull() & (F.row_number().over(order) <= cuts), 1).otherwise(0))
    return marked.withColumn("seg_id", F.sum("__cut").over(by_time()).cast("int")).drop("__cut")


def cut_where_changed(frames: DataFrame, value: str = "seg_id") -> DataFrame:
    """With boundary: does the value differ from the frame's before?"""
    before = F.lag(value).over(by_time())
    return frames.withColumn("boundary", F.coalesce(F.col(value) != before, F.lit(False)))


def segments(frames: DataFrame) -> DataFrame:
    """video, seg_id, first and (exclusive) last frame, times and size of each segment."""
    g = frames.groupBy("video", "seg_id")
    return g.agg(F.min("frame_idx").alias("frame_start"), (F.max("frame_idx") + 1).alias("frame_end"), F.min("ts").alias("t_start"), F.max("ts").alias("t_end"), F.count("*").alias("n_frames"))


def mean_vector(column: str) -> Column:
    """Aggregate: the mean of the vectors, as array<double>; summed before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.transform(column, lambda x: x.cast("double")))))


def segment_representatives(frames: DataFrame, eps: float = 1e-8) -> DataFrame:
    """video, seg_id, rep: the mean vector of a segment, scaled to length 1."""
    means = frames.where("emb is not null").groupBy("video", "seg_id").agg(mean_vector("emb").alias("v"))
    return means.select("video", "seg_id", normalised("v", eps).alias("rep"))


def first_of_segments(frames: DataFrame) -> DataFrame:
    """One frame, the first, of each segment."""
    order = Window.partitionBy("video", "seg_id").orderBy("ts", "frame_idx")
    return frames.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def greedy_segments(frames: DataFrame, tau: float) -> DataFrame:
    """video, frame_idx, ts, seg_id: a frame joins the current segment if its similarity to the normalised sum of that segment reaches tau.

    tau <= 0 makes each frame a segment. Sequential in a video by definition: a fold over its sorted frames.
    """
    if tau <= 0:
        return frames.select("video", "frame_idx", "ts", (F.row_number().over(by_time()) - 1).cast("int").alias("seg_id"))

    schema = pa.schema([("video", pa.string()), ("frame_idx", pa.int32()), ("ts", pa.float64()), ("seg_id", pa.int32())])

    def run(stretches: Iterator) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last = state = None
            for key, c in stretches:
                state, last = state if key == last else None, key
                for video, frame, ts, e in zip(c["video"], c["frame_idx"], c["ts"], c["emb"]):
                    state, seg = greedy_step(state, np.asarray(e, float), tau)
                    yield video, frame, ts, seg

        yield from emitted(schema, rows())

    narrow = frames.select(F.col("video").cast("string").alias("video"), F.col("frame_idx").cast("int").alias("frame_idx"), F.col("ts").cast("double").alias("ts"), "emb")
    return folded(narrow, ("video",), ["frame_idx"], run, "video string, frame_idx int, ts double, seg_id int")


def greedy_step(state: tuple[np.ndarray, int] | None, e: np.ndarray, tau: float) -> tuple[tuple[np.ndarray, int], int]:
    """(sum of the segment, its id) after a frame."""
    if state is None:
        return (e, 0), 0
    total, seg = state
    if float(e @ total) / (float(np.linalg.norm(total)) + 1e-12) >= tau:
        return (total + e, seg), seg
    return (e, seg + 1), seg + 1


def gated(samples: DataFrame, value: str, tau: float, keys: tuple[str, ...] = ("video",)) -> DataFrame:
    """Samples with kept: the first, and each whose value differs from the last kept one's by tau or more.

    A fold over each key's sorted samples that holds the last kept value only; `value` is a number (the mean difference of thumbnails, a signal).
    """
    typed = samples.select(*keys, F.col("ts").cast("double").alias("ts"), F.col("frame_idx").cast("bigint").alias("frame_idx"), F.col(value).cast("double").alias(value))

    def run(stretches: Iterator) -> Iterator[pa.RecordBatch]:
        owner = last = None
        for key, c in stretches:
            if key != owner:
                owner, last = key, None
            kept = []
            for v in c[value]:
                # a null value is kept only where nothing was before it
                keep = last is None or (v is not None and abs(v - last) >= tau)
                last = v if keep else last
                kept.append(keep)
            c["kept"] = kept
            yield pa.RecordBatch.from_pydict(c, schema=to_arrow_schema(schema))

    schema = typed.withColumn("kept", F.lit(True)).schema
    return folded(typed, keys, ["ts", "frame_idx"], run, schema)


def filled(samples: DataFrame, value: str, keys: tuple[str, ...] = ("video",)) -> DataFrame:
    """With filled: the value of the last kept sample up to this one."""
    w = Window.partitionBy(*keys).orderBy("ts", "frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("filled", F.last(F.when(F.col("kept"), F.col(value)), ignorenulls=True).over(w))


def sampled(frames: DataFrame, fps: float) -> DataFrame:
    """The first frame, then each at least 1 / fps after the last kept: true times, not a grid."""
    typed = frames.select("video", F.col("ts").cast("double").alias("ts"), F.col("frame_idx").cast("bigint").alias("frame_idx"))

    def run(stretches: Iterator) -> Iterator[pa.RecordBatch]:
        owner = last = None
        for key, c in stretches:
            if key != owner:
                owner, last = key, None
            picked = []
            for k, t in enumerate(c["ts"]):
                if last is None or t - last >= 1 / fps:
                    last = t
                    picked.append(k)
            yield pa.RecordBatch.from_pydict({x: [v[k] for k in picked] for x, v in c.items()}, schema=to_arrow_schema(schema))

    schema = typed.schema
    return folded(typed.where("ts is not null"), ("video",), ["ts", "frame_idx"], run, schema)


def smoothed(scored: DataFrame, width: int, kind: str = "box", keys: tuple[str, ...] = ("video",)) -> DataFrame:
    """sim averaged over `width` frames around each, zeros beyond the ends; kind 'box' or 'triangle'."""
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    back, ahead = width // 2, (width - 1) // 2
    if kind == "box":
        return scored.withColumn("smooth", F.sum("sim").over(w.rowsBetween(-back, ahead)) / width)
    if kind != "triangle":
        raise ValueError(f"unknown kind {kind!r}")
    weights = np.bartlett(width + 2)[1:-1]
    weights = weights / weights.sum()
    total = F.lit(0.0)
    for k, x in zip(range(-back, ahead + 1), weights):
        total = total + F.lit(float(x)) * F.coalesce(F.lag("sim", -k).over(w), F.lit(0.0))
    return scored.withColumn("smooth", total)


def smoothed_of(frames: DataFrame, queries: DataFrame, width: int, kind: str = "box") -> DataFrame:
    """query_id, video, frame_idx, smooth: `smoothed` of frames against queries."""
    if kind not in ("box", "triangle"):
        raise ValueError(f"unknown kind {kind!r}")
    back, ahead = width // 2, (width - 1) // 2
    weights = np.ones(width) if kind == "box" else np.bartlett(width + 2)[1:-1] / np.bartlett(width + 2)[1:-1].sum()

    def choose(rows: Frames, sim: np.ndarray, ok: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, list[pa.Array]]:
        n, x, known = len(rows), np.where(ok, sim, 0.0), np.zeros(len(rows), bool)
        total = np.zeros_like(x)
        for k, w in zip(range(-back, ahead + 1), weights.tolist()):
            to, of = slice(max(0, -k), max(0, n - max(0, k))), slice(max(0, k), max(0, n + min(0, k)))
            total[:, to] += w * x[:, of]
            known[to] |= ok[of]
        return _all(rows, total / width if kind == "box" else total, known | (kind == "triangle"))

    return per_video(frames, queries, choose, "frame_idx int, smooth double")


def statistics(frames: DataFrame, fps: float) -> DataFrame:
    """One row a video: frames, duration, segments, share of frames skipped by the gate (if `kept` is there)."""
    extra = [F.count_distinct("seg_id").alias("n_segments")] if "seg_id" in frames.columns else []
    extra += [F.avg((~F.col("kept")).cast("double")).alias("skipped")] if "kept" in frames.columns else []
    return frames.groupBy("video").agg(F.count("*").alias("n_frames"), (F.max("ts") + 1 / fps).alias("duration_s"), *extra)


def best_of(frames: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, video, frame_idx, sim, rank: each query's k best frames of all videos; no video has more than k of them."""
    found = per_video(frames.select("video", "frame_idx", "emb"), queries, best(k, "frame_idx"), "frame_idx int, sim double, pick int").drop("pick")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "video", "frame_idx"))).where(F.col("rank") <= k)


def feedback(frames: DataFrame, queries: DataFrame, k: int, weight: float) -> DataFrame:
    """Pseudo-relevance feedback: queries(query_id, q) moved towards the mean of their k best frames, length 1."""
    top = best_of(frames, queries, k)
    means = frames.join(top.select("query_id", "video", "frame_idx"), ["video", "frame_idx"]).groupBy("query_id").agg(mean_vector("emb").alias("v"))
    moved = queries.join(means, "query_id").select("query_id", F.zip_with("q", "v", lambda a, b: a.cast("double") * (1 - weight) + b * weight).alias("q"))
    return moved.select("query_id", normalised("q").alias("q"))


