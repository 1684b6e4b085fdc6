"""The sequential operators as Structured Streaming: state by video, whatever batches the frames arrive in."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.frames import greedy_step


def events(scores: DataFrame, threshold: float, merge_gap: str, lateness: str, keys: tuple[str, ...] = ("video", "query_id")) -> DataFrame:
    """Events of a stream scores(keys, time TIMESTAMP, score): positives merged over gaps up to merge_gap, final once the watermark has passed."""
    positive = scores.where(F.col("score") > threshold).withWatermark("time", lateness)
    g = positive.groupBy(F.session_window("time", merge_gap).alias("s"), *keys)
    return g.agg(F.min("time").alias("t_start"), F.max("time").alias("t_end"), F.count("*").alias("n_frames"), F.max("score").alias("peak")).select(*keys, "t_start", "t_end", "n_frames", "peak")


def tumbling_maxima(scores: DataFrame, width: str, lateness: str, keys: tuple[str, ...] = ("video", "query_id")) -> DataFrame:
    """The best score of each fixed chunk."""
    g = scores.withWatermark("time", lateness).groupBy(F.window("time", width).alias("w"), *keys)
    return g.agg(F.max("score").alias("score"), F.count("*").alias("n_frames")).select(*keys, F.col("w.start").alias("t_start"), F.col("w.end").alias("t_end"), "score", "n_frames")


def greedy_segments(frames: DataFrame, tau: float) -> DataFrame:
    """Segments of a stream frames(video, frame_idx, ts, emb) whose batches come in time order; the state is one vector and one id a video."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else None
        part = pd.concat(parts).sort_values("frame_idx")
        ids = []
        for e in part["emb"]:
            now, seg = greedy_step(now, np.asarray(e, float), tau)
            ids.append(seg)
        state.update((pickle.dumps(now),))
        yield pd.DataFrame({"video": key[0], "frame_idx": part["frame_idx"].astype("int32"), "ts": part["ts"], "seg_id": np.array(ids, np.int32)})

    rows = frames.select("video", "frame_idx", "ts", "emb").groupBy("video")
    return rows.applyInPandasWithState(run, "video string, frame_idx int, ts double, seg_id int", "state binary", "append", GroupStateTimeout.NoTimeout)


def gated(samples: DataFrame, value: str, tau: float) -> DataFrame:
    """Of a stream samples(video, frame_idx, ts, value), those that differ from the last kept one by tau or more."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        part = pd.concat(parts).sort_values(["ts", "frame_idx"])
        kept = []
        for v in part[value]:
            keep = last is None or abs(v - last) >= tau
            last = float(v) if keep else last
            kept.append(keep)
        state.update((last,))
        good = part[np.array(kept, bool)]
        yield pd.DataFrame({"video": key[0], "frame_idx": good["frame_idx"].astype("int64"), "ts": good["ts"].astype(float), value: good[value].astype(float)})

    return samples.groupBy("video").applyInPandasWithState(run, f"video string, frame_idx long, ts double, {value} double", "last double", "append", GroupStateTimeout.NoTimeout)
