"""A library of indexed videos: open, index, search one or all of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import timecode
from .operators import collection as co
from .operators import frames as fr
from .operators import merge as me
from .operators import selection as se
from .sources import tables


@dataclass
class Results:
    """Ranked hits with what was asked."""

    hits: DataFrame
    query: str
    budget: int
    strategy: str
    confirmed: bool
    timings: dict[str, float] = field(default_factory=dict)

    def above(self, threshold: float) -> DataFrame:
        return me.above(self.hits, threshold, self.confirmed)

    def top(self, n: int) -> Results:
        return Results(self.hits.where(F.col("rank") <= n), self.query, self.budget, self.strategy, self.confirmed, self.timings)

    def to_json(self) -> DataFrame:
        return self.hits.select(F.to_json(F.struct("*")).alias("hit"))


class Library:
    """Frame tables under one root: <root>/frames by video, <root>/timed_text by kind, <root>/stats."""

    def __init__(self, spark: SparkSession, root: str, encoder=None):
        self.spark, self.root, self.encoder = spark, root.rstrip("/"), encoder

    def index(self, frames: DataFrame, fps: float, segment_tau: float = 0.0, mode: str = "append") -> None:
        """Add frames(video, frame_idx, ts, emb); videos that are there already are skipped."""
        if mode == "append" and self._there("frames"):
            new = tables.missing_videos(frames.select("video").distinct(), self.frames())
            frames = frames.join(new, "video", "left_semi")
        seg = fr.greedy_segments(frames, segment_tau).select("video", "frame_idx", "seg_id")
        indexed = frames.drop("seg_id").join(seg, ["video", "frame_idx"])
        tables.write_frames(indexed, f"{self.root}/frames", mode)
        fr.statistics(indexed, fps).write.mode(mode).parquet(f"{self.root}/stats")

    def add_text(self, spans: DataFrame) -> None:
        """Add timed text(video, kind, start, end, text, emb, meta)."""
        tables.write_timed_text(me.closed_spans(spans), f"{self.root}/timed_text", "append")

    def _there(self, name: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.root}/{name}")
            return True
        except Exception:  # not written yet
            return False

    def frames(self, video: str | None = None) -> DataFrame:
        return tables.read_frames(self.spark, f"{self.root}/frames", video)

    def videos(self) -> DataFrame:
        return co.videos(self.frames())

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/stats")

    def sources(self) -> list[str]:
        return ["visual", *tables.text_kinds(self.spark, f"{self.root}/timed_text")]

    def _query(self, query: str | list[float], dim: int) -> DataFrame:
        if isinstance(query, str):
            if self.encoder is None:
                raise ValueError("a text query needs an encoder")
            query = self.encoder.encode([query], True)[0].tolist()
        vector = fr.query_vector(query, dim)
        return self.spark.createDataFrame([("q", [float(x) for x in vector])], "query_id string, q array<float>")

    def _dimension(self, df: DataFrame) -> int:
        row = df.select(F.size("emb")).first()
        if row is None:
            raise LookupError("no such video in the library")
        return row[0]

    def search(self, video: str, query: str | list[float], k: int = 32, source: str | list[str] | None = None, strategy: str = "segment_adaptive", seed: int = 0, gap_s: float = 10.0) -> Results:
        """The best moments of a video over its sources, merged by rank and nearness."""
        if k < 1:
            raise ValueError("k must be at least 1")
        wanted = me.resolve_sources(source, self.sources())
        lists = []
        for kind in wanted:
            if kind == "visual":
                frames = self.frames(video)
                picked = se.select(frames, self._query(query, self._dimension(frames)), k, strategy, seed=seed)
                lists.append(picked.select("query_id", F.lit("visual").alias("source"), F.col("ts").alias("time"), F.col("sim").alias("score"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("vlm_score")))
            else:
                spans = tables.read_timed_text(self.spark, f"{self.root}/timed_text", kind).where(F.col("video") == F.lit(video))
                scored = fr.similarity(spans.select("video", "start", "text", "emb"), self._query(query, self._dimension(spans)))
                lists.append(scored.select("query_id", F.lit(kind).alias("source"), F.col("start").alias("time"), F.col("sim").alias("score"), "text", F.lit(None).cast("double").alias("vlm_score")))
        union = lists[0]
        for other in lists[1:]:
            union = union.unionByName(other)
        merged = me.merge(me.ranked_list(union, k), k, gap_s)
        return Results(merged.withColumn("timecode", timecode("time")), str(query), k, strategy, False)

    def search_all(self, query: str | list[float], k: int = 20, video: str | None = None, min_gap_s: float = 30.0, per_video: int | None = None) -> DataFrame:
        """The best moments of all videos, runs collapsed."""
        frames = self.frames(video)
        return co.search(frames, self._query(query, self._dimension(frames)), k, None, min_gap_s, per_video).withColumn("timecode", timecode("ts"))
