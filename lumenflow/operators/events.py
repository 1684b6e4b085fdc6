"""Events from score streams, and how well a selection finds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("video", "query_id")


def events_from_scores(scores: DataFrame, threshold: float = 0.0, gap_s: float = 3.0, min_frames: int = 1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """scores(keys, ts, score) -> runs of positives merged over gaps up to gap_s (inclusive): t_start, t_end, n_frames, peak."""
    w = Window.partitionBy(*keys).orderBy("ts")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= gap_s, 0).otherwise(1)
    runs = scores.where(F.col("score") > threshold).withColumn("__new", new).withColumn("event", F.sum("__new").over(w))
    g = runs.groupBy(*keys, "event").agg(F.min("ts").alias("t_start"), F.max("ts").alias("t_end"), F.count("*").alias("n_frames"), F.max("score").alias("peak"))
    return g.where(F.col("n_frames") >= min_frames)


def found_events(events: DataFrame, hits: DataFrame, tol_s: float = 0.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """events with found: is a hit in [t_start - tol, t_end + tol]?

    Both sides meet by key and coarse time cell (as wide as the longest typical event: an hour), so no range join
    compares all pairs of a key.
    """
    met = _within(events, hits.select(*keys, F.col("ts").alias("hit")), tol_s, keys).select(*keys, "event").distinct().withColumn("found", F.lit(True))
    return events.join(met, [*keys, "event"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _within(events: DataFrame, hits: DataFrame, tol_s: float, keys: tuple[str, ...], start: str = "t_start", end: str = "t_end", width: float = 3600.0) -> DataFrame:
    """keys, event with each row of hits(keys, hit, ...) in [start - tol, end + tol]; joined by key and time cell."""
    cell = lambda c: F.floor(c / width)
    spread = events.select(*keys, "event", (F.col(start) - tol_s).alias("lo"), (F.col(end) + tol_s).alias("hi")).withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    return spread.join(hits.withColumn("cell", cell(F.col("hit"))), [*keys, "cell"]).where(F.col("hit").between(F.col("lo"), F.col("hi"))).drop("lo", "hi", "cell")


def closed_slice(spans: DataFrame, frames: DataFrame, keys: tuple[str, ...] = ("video",), width: float = 60.0) -> DataFrame:
    """spans(keys, event, t_start, t_end) with each frame(keys, hit, ...) from the start to the end, both inclusive: a frame on a border is in both its spans."""
    return _within(spans, frames, 0.0, keys, width=width)


def runs_above(scores: DataFrame, share: float, gap_s: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Events of the scores above their key's percentile `share` (interpolated), as `events_from_scores`."""
    edge = scores.groupBy(*keys).agg(F.percentile("score", share).alias("__edge"))
    return events_from_scores(scores.join(edge, list(keys)).withColumn("score", F.col("score") - F.col("__edge")), 0.0, gap_s, 1, keys).drop("peak")


def event_recall(events: DataFrame, hits: DataFrame, tol_s: float = 0.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, event_recall, n_events. Keys without events have no row: their recall is undefined."""
    return found_events(events, hits, tol_s, keys).groupBy(*keys).agg(F.avg(F.col("found").cast("double")).alias("event_recall"), F.count("*").alias("n_events"))


def frame_recall(positives: DataFrame, hits: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, frame_recall: the share of positives (keys, frame_idx) that are hits."""
    hit = hits.select(*keys, "frame_idx").distinct().withColumn("hit", F.lit(1))
    return positives.join(hit, [*keys, "frame_idx"], "left").groupBy(*keys).agg((F.count("hit") / F.count("*")).alias("frame_recall"))


def nearest(wanted: DataFrame, table: DataFrame, keys: tuple[str, ...], tolerance: float | None = None, columns: tuple[str, ...] = (), side: str = "both") -> DataFrame:
    """wanted(keys, ts) with the nearest row of table(keys, ts) as near_ts (and columns as near_*); equally near: the later.

    side "forward" takes the first row at or after ts only.

    One union and two running windows: the last row before and the first after, no pairs. Beyond the tolerance: nulls.
    """
    right = table.select(*keys, "ts", F.struct(F.col("ts").alias("ts"), *columns).alias("r")).withColumn("side", F.lit(0))
    left = wanted.withColumn("w", F.struct(*[F.col(c) for c in wanted.columns])).select(*keys, "ts", "w").withColumn("side", F.lit(1))
    both = right.unionByName(left, allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    before = F.last("r", ignorenulls=True).over(w.orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("r", ignorenulls=True).over(w.orderBy("ts", F.desc("side")).rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumns({"b": before, "a": after}).where("side = 1")
    take_left = F.col("a").isNull() | (F.abs(F.col("b.ts") - F.col("ts")) < F.abs(F.col("a.ts") - F.col("ts")))
    pick = F.when(take_left, F.col("b")).otherwise(F.col("a")) if side == "both" else F.col("a")
    if tolerance is not None:
        pick = F.when(F.abs(pick["ts"] - F.col("ts")) <= tolerance, pick)
    return seen.withColumn("p", pick).select("w.*", F.col("p.ts").alias("near_ts"), *[F.col(f"p.{c}").alias(f"near_{c}") for c in columns])


def backward(wanted: DataFrame, table: DataFrame, keys: tuple[str, ...], column: str) -> DataFrame:
    """wanted(keys, ts) with the column of the last row of table at or before ts."""
    both = table.select(*keys, "ts", F.col(column).alias("r")).withColumn("side", F.lit(0)).unionByName(wanted.select(*keys, "ts", F.struct(*[F.col(c) for c in wanted.columns]).alias("w")).withColumn("side", F.lit(1)), allowMissingColumns=True)
    last = F.last("r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(column, last).where("side = 1").select("w.*", column)


def evaluate_selection(truth: DataFrame, selected: DataFrame, threshold: float = 0.0, gap_s: float = 3.0, max_snap_s: float = 1.5, keys: tuple[str, ...] = KEYS, tol_s: float = 0.0) -> DataFrame:
    """keys, n_selected, n_confirmed, precision, event_recall, frame_recall of selected(keys, ts) against truth(keys, frame_idx, ts, score).

    A selected time snaps to the nearest truth row; it is an error if that is farther than max_snap_s. Recalls are null
    for keys without events.
    """
    near = nearest(selected, truth, keys, None, ("frame_idx", "score"))
    far = F.abs(F.col("near_ts") - F.col("ts")) > max_snap_s
    error = F.raise_error(F.lit(f"a selected time is more than {max_snap_s} s from any truth row"))
    near = near.withColumn("ok", F.when(far | F.col("near_ts").isNull(), error).otherwise(F.col("near_score") > threshold))
    counts = near.groupBy(*keys).agg(F.count("*").alias("n_selected"), F.count_if("ok").alias("n_confirmed"), F.avg(F.col("ok").cast("double")).alias("precision"))
    hits = near.where("ok").select(*keys, F.col("near_ts").alias("ts"), F.col("near_frame_idx").alias("frame_idx"))
    events = events_from_scores(truth, threshold, gap_s, 1, keys)
    positives = truth.where(F.col("score") > threshold).select(*keys, "frame_idx")
    out = counts.join(event_recall(events, hits, tol_s, keys).drop("n_events"), list(keys), "left")
    return out.join(frame_recall(positives, hits, keys), list(keys), "left")


def depth_to_first_hit(ranked: DataFrame, keys: tuple[str, ...] = KEYS, threshold: float = 0.0) -> DataFrame:
    """keys, depth: the least rank of a positive row."""
    return ranked.where(F.col("score") > threshold).groupBy(*keys).agg(F.min("rank").alias("depth"))


def best_rank_per_event(events: DataFrame, ranked: DataFrame, slack: float = 1e-6, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each event with best_rank, the least rank of a frame within it."""
    inside = _within(events, ranked.select(*keys, F.col("ts").alias("hit"), "rank"), slack, keys)
    return inside.groupBy(*keys, "event").agg(F.min("rank").alias("best_rank"))


def topk_ceiling(best_ranks: DataFrame, budgets: list[int], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """budget, ceiling: the share of events whose best rank is within the budget, mean of keys."""
    grid = best_ranks.sparkSession.createDataFrame([(b,) for b in budgets], "budget int")
    per_key = best_ranks.crossJoin(F.broadcast(grid)).groupBy("budget", *keys).agg(F.avg((F.col("best_rank") <= F.col("budget")).cast("double")).alias("c"))
    return per_key.groupBy("budget").agg(F.avg("c").alias("ceiling"))


def recall_by_peak(found: DataFrame, floors: list[float]) -> DataFrame:
    """floor, n_events, recall of events whose peak reaches each floor."""
    grid = found.sparkSession.createDataFrame([(float(f),) for f in floors], "floor double")
    return found.crossJoin(F.broadcast(grid)).where("peak >= floor").groupBy("floor").agg(F.count("*").alias("n_events"), F.avg(F.col("found").cast("double")).alias("recall"))


def uniform_recall(events: DataFrame, budget: Column | int, frames: Column | str) -> DataFrame:
    """events with p, the chance that uniform sampling hits each: min(1, budget * length / frames)."""
    n = F.col(frames) if isinstance(frames, str) else frames
    b = F.lit(budget) if isinstance(budget, int) else budget
    return events.withColumn("p", F.least(F.lit(1.0), b * F.col("n_frames") / n))


def deduplicated_times(rows: DataFrame, keys: tuple[str, ...], eps: float = 1e-6) -> DataFrame:
    """Union of shards without near-equal times: a row stays if it is more than eps after the one before."""
    before = F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts"))
    return rows.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("ts") - F.col("__b") > eps)).drop("__b")


def gap_audit(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, median and largest step between neighbouring times."""
    step = F.col("ts") - F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts"))
    return rows.withColumn("step", step).groupBy(*keys).agg(F.percentile("step", 0.5).alias("median_step"), F.max("step").alias("max_step"))
