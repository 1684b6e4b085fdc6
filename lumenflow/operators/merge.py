"""Timed text and the merge of independently ranked sources."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import emitted, folded

HITS = "query_id string, time double, score double, source string, text string, vlm_score double"


def span_ends(spans: DataFrame, keys: tuple[str, ...], start: str = "start", fps: float = 1.0, duration: str | None = None) -> DataFrame:
    """With end: the next span's start; the last ends 1 / fps later, at most at the duration. To be taken before empty texts go."""
    last = F.col(start) + 1 / fps
    if duration is not None:
        last = F.least(last, F.col(duration))
    return spans.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(start)), last))


def closed_spans(spans: DataFrame, open_s: float = 30.0) -> DataFrame:
    """Spans with text; an open end is open_s after the start."""
    return spans.where("trim(text) <> ''").withColumn("end", F.coalesce("end", F.col("start") + open_s))


def lines_text(lines: str, min_conf: float, min_chars: int):
    """Column: the texts of an array of (text, conf) lines that are sure and long enough, joined by spaces."""
    good = F.filter(F.col(lines), lambda x: (x["conf"] >= min_conf) & (F.length(F.trim(x["text"])) >= min_chars))
    return F.array_join(F.transform(good, lambda x: F.trim(x["text"])), " ")


def resolve_sources(source: str | list[str] | None, available: list[str]) -> list[str]:
    """The sources to search: all for None; an error names what is unknown or missing."""
    known = ("visual", "speech", "text")
    asked = available if source is None else source
    wanted = [asked] if isinstance(asked, str) else [*asked]
    for s in wanted:
        if s not in known:
            raise ValueError(f"unknown source {s!r}; have {known}")
        if s not in available:
            raise ValueError(f"this index has no {s!r}; it has {available}")
    if not wanted:
        raise ValueError("no source to search")
    return wanted


def ranked_list(hits: DataFrame, k: int) -> DataFrame:
    """hits(query_id, source, time, score, ...) with rank from 0 in each query and source: the k best, ties by time."""
    order = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "time")
    return hits.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def merge(ranked: DataFrame, k: int, gap_s: float = 10.0) -> DataFrame:
    """One ranking of several sources' by rank and nearness in time, never by score.

    Hits are taken by (rank, time). Each joins the first group that lacks its source and has a member within gap_s
    (inclusive), else starts one. A group's value is its best rank less one for each further source. A visual hit
    gives the group its time, score and expert score, else the leader does; the first text that isn't empty is kept.
    At most sources * k rows of a query meet in one task.
    """

    names = ("rank", "time", "score", "source", "text", "vlm_score")

    def run(stretches: Iterator) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            owner, held = None, []
            for key, c in chain(stretches, [(None, {n: [] for n in names})]):
                if key != owner and held:
                    for place, row in enumerate(_merged(held, k, gap_s), 1):
                        yield owner[0], place, *row
                if key != owner:
                    owner, held = key, []
                held.extend(zip(*(c[n] for n in names)))

        yield from emitted(_MERGED, rows())

    typed = ranked.select(F.col("query_id").cast("string").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("time").cast("double").alias("time"), F.col("score").cast("double").alias("score"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), F.col("vlm_score").cast("double").alias("vlm_score"))
    return folded(typed, ("query_id",), ["rank", "time", "source"], run, "query_id string, rank int, time double, score double, source string, text string, vlm_score double")


_MERGED = pa.schema([("query_id", pa.string()), ("rank", pa.int32()), ("time", pa.float64()), ("score", pa.float64()), ("source", pa.string()), ("text", pa.string()), ("vlm_score", pa.float64())])


def _merged(hits: list[tuple], k: int, gap_s: float) -> list[tuple]:
    """(time, score, sources, text, expert score) of the k best groups of one query's hits (rank, time, score, source, text, expert score), in order."""
    groups: list[list[tuple]] = []
    for hit in hits:
        for g in groups:
            if all(o[3] != hit[3] for o in g) and any(abs(o[1] - hit[1]) <= gap_s for o in g):
                g.append(hit)
                break
        else:
            groups.append([hit])
    out = []
    for g in groups:
        names, lead = sorted({o[3] for o in g}), min(g, key=lambda o: o[0])
        visual = next((o for o in g if o[3] == "visual"), None)
        face = visual or lead
        out.append((lead[0] - (len(names) - 1), face[1], face[2], "+".join(names), next((o[4] for o in g if o[4]), None), visual[5] if visual else None))
    return [r[1:] for r in sorted(out, key=lambda r: r[0])[:k]]


def above(hits: DataFrame, threshold: float, confirmed: bool) -> DataFrame:
    """Hits whose expert score exceeds the threshold; a missing one counts as 0. An error if none was asked for."""
    if not confirmed:
        raise ValueError("these results carry no expert scores; search with confirm")
    return hits.where(F.coalesce("vlm_score", F.lit(0.0)) > threshold)


def reranked(ranked: DataFrame, head: int, score: str) -> DataFrame:
    """rows(query_id, rank, score): the first `head` by their new score, then the others as they were; with new_rank."""
    inside = F.col("rank") <= head
    order = Window.partitionBy("query_id").orderBy(F.desc(inside), F.desc(F.when(inside, F.col(score))), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(order))
