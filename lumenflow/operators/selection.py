"""Choosing a budget of candidate frames: five strategies over scored frames (query_id, video, frame_idx, ts, sim).

Budgets are per query and video. Each returns the chosen rows with pick, their order from 1. Ties: higher sim, then the earlier frame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import frames as fr
from .videos import Choice, best, by_segment, per_video, spaced

STRATEGIES = ("segment_adaptive", "segment", "topk", "nms", "uniform")
SEGMENT_FACTOR = 8.0
KEYS = ("query_id", "video")


def _best_first():
    return Window.partitionBy(*KEYS).orderBy(F.desc("sim"), "frame_idx")


def topk(scored: DataFrame, budget: int) -> DataFrame:
    return scored.withColumn("pick", F.row_number().over(_best_first())).where(F.col("pick") <= budget)


def _picked(frames: DataFrame, queries: DataFrame, choice: Callable[..., Choice], *order: str) -> DataFrame:
    """What is chosen of each query and video, in its task: query_id, the columns of frames without emb, sim, pick."""
    names = [c for c in frames.columns if c not in ("video", "emb")]
    columns = StructType([*frames.select(*names).schema, StructField("sim", DoubleType()), StructField("pick", IntegerType())])
    return per_video(frames, queries, choice(*names), columns, order or ("frame_idx",))


def topk_of(frames: DataFrame, queries: DataFrame, budget: int) -> DataFrame:
    """`topk` of frames against queries."""
    return _picked(frames, queries, partial(best, budget))


def offset(seed: int, video: Column, i: Column) -> Column:
    """A number in [0, 1) that only the seed, the video and the stratum decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), video, i.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(scored: DataFrame, budget: int, seed: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One frame at a random offset of each of `budget` equal strata of a video; in time order."""
    sized = scored.withColumns({"__at": F.row_number().over(Window.partitionBy(*keys).orderBy("frame_idx")) - 1, "__n": F.count("*").over(Window.partitionBy(*keys))})
    width = F.col("__n") / F.least(F.lit(budget), F.col("__n")).cast("double")
    stratum = F.least(F.floor((F.col("__at") + 0.5) / width), F.least(F.lit(budget), F.col("__n")) - 1)
    chosen = lambda i: F.floor(i * width + offset(seed, F.col("video"), i.cast("int")) * width)
    # a frame may be the choice of its own stratum or, at a fractional edge, of the one before or after
    hit = F.lit(False)
    for d in (-1, 0, 1):
        i = stratum + d
        hit = hit | ((i >= 0) & (i < F.least(F.lit(budget), F.col("__n"))) & (chosen(i) == F.col("__at")))
    return sized.where(hit).withColumn("pick", F.row_number().over(Window.partitionBy(*keys).orderBy("frame_idx"))).drop("__at", "__n")


def uniform_of(frames: DataFrame, queries: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """`uniform` of frames against queries: neither query nor score decides, so the frames are chosen before they are scored."""
    return fr.similarity(uniform(frames, budget, seed, ("video",)), queries)


def nms(scored: DataFrame, budget: int, window_s: float | None = None) -> DataFrame:
    """Best first; a frame within `window_s` (inclusive) of a chosen one is suppressed. By default the video's span / (2 budget).

    Greedy by definition: an ordered fold over each query and video, in the JVM.
    """
    packed = scored.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("neg"), "frame_idx", "ts", "sim"))).alias("rows"), (F.max("ts") - F.min("ts")).alias("span"), F.count("*").alias("n"))
    w = F.lit(float(window_s)) if window_s is not None else F.when(F.col("n") > 1, F.col("span")).otherwise(F.lit(1.0)) / F.lit(2.0 * max(1, budget))
    kind = "array<struct<neg:double,frame_idx:int,ts:double,sim:double>>"
    rows = packed.withColumns({"w": w, "rows": F.col("rows").cast(kind)})
    step = lambda out, r: F.when((F.size(out) >= budget) | F.exists(out, lambda o: F.abs(o["ts"] - r["ts"]) <= F.col("w")), out).otherwise(F.concat(out, F.array(r)))
    kept = F.aggregate("rows", F.array().cast(kind), step)
    return rows.select(*KEYS, F.posexplode(kept).alias("at", "r")).select(*KEYS, "r.frame_idx", "r.ts", "r.sim", (F.col("at") + 1).alias("pick"))


def nms_of(frames: DataFrame, queries: DataFrame, budget: int, window_s: float | None = None) -> DataFrame:
    """`nms` of frames against queries; missing scores go last."""

    def window(ts: np.ndarray) -> float:
        return float(window_s) if window_s is not None else (float(np.nanmax(ts) - np.nanmin(ts)) if len(ts) > 1 else 1.0) / (2.0 * max(1, budget))

    return _picked(frames, queries, partial(spaced, budget, window, True))


def segment(scored: DataFrame, budget: int) -> DataFrame:
    """Scored frames with seg_id: every segment's best frame, best segments first, then every second best, and so on."""
    depth = F.row_number().over(Window.partitionBy(*KEYS, "seg_id").orderBy(F.desc("sim"), "frame_idx"))
    best = F.max("sim").over(Window.partitionBy(*KEYS, "seg_id"))
    ranked = scored.withColumns({"depth": depth, "best": best})
    pick = F.row_number().over(Window.partitionBy(*KEYS).orderBy("depth", F.desc("best"), "seg_id"))
    return ranked.withColumn("pick", pick).where(F.col("pick") <= budget).drop("depth", "best")


def segment_of(frames: DataFrame, queries: DataFrame, budget: int) -> DataFrame:
    """`segment` of frames with seg_id against queries."""
    return _picked(frames, queries, partial(by_segment, budget), "seg_id", "frame_idx")


def segment_adaptive(frames: DataFrame, queries: DataFrame, budget: int, factor: float = SEGMENT_FACTOR) -> DataFrame:
    """Segments are cut for the budget: round(factor * budget) of them, at the least similar neighbours."""
    cut = fr.cut_into(fr.adjacent_similarity(frames), round(factor * budget)).drop("adj")
    return segment_of(cut, queries, budget)


def select(frames: DataFrame, queries: DataFrame, budget: int, strategy: str = "segment_adaptive", window_s: float | None = None, seed: int = 0, factor: float = SEGMENT_FACTOR) -> DataFrame:
    """Candidates by one of STRATEGIES. 'segment' needs frames with seg_id."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; have {STRATEGIES}")
    if budget < 1:
        raise ValueError("the budget must be at least 1")
    if strategy == "segment_adaptive":
        return segment_adaptive(frames, queries, budget, factor)
    return {"uniform": lambda: uniform_of(frames, queries, budget, seed), "topk": lambda: topk_of(frames, queries, budget), "nms": lambda: nms_of(frames, queries, budget, window_s), "segment": lambda: segment_of(frames, queries, budget)}[strategy]()
