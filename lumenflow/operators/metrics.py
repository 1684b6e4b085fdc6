"""Ranking quality: rows (keys, rn, ...) with rn from 1, best first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import iou
from .arrow import emitted, folded

IOU_THRESHOLD = 0.3
#: Parts in which the points of a key are folded first.
PARTS = 32


def overlaps(start: Column, end: Column, truths: Column | str, threshold: float = IOU_THRESHOLD) -> Column:
    """Does any interval (a, b) of the array reach the threshold?"""
    g = F.col(truths) if isinstance(truths, str) else truths
    return F.exists(g, lambda t: iou(start, end, t["a"], t["b"]) >= threshold)


def coverage(start: Column, end: Column, truths: Column | str) -> Column:
    """The largest share of the chunk that one interval covers."""
    g = F.col(truths) if isinstance(truths, str) else truths
    return F.coalesce(F.array_max(F.transform(g, lambda t: F.greatest(F.lit(0.0), F.least(end, t["b"]) - F.greatest(start, t["a"])) / (end - start))), F.lit(0.0))


def recall_at(ranked: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, recall: 1 if a true row is among the first k."""
    return ranked.groupBy(*keys).agg(F.max(F.when((F.col("rn") <= k) & F.col("is_true"), 1.0).otherwise(0.0)).alias("recall"))


def graded_precision(ranked: DataFrame, keys: tuple[str, ...], k: int = 5) -> DataFrame:
    """keys, ap of rows with iou (with the hull of the truths): the sum over the first k of (running sum / rank) * iou."""
    run = F.sum("iou").over(Window.partitionBy(*keys).orderBy("rn"))
    return ranked.where(F.col("rn") <= k).withColumn("run", run).groupBy(*keys).agg(F.sum(F.col("run") / F.col("rn") * F.col("iou")).alias("ap"))


def matched_precision(ranked: DataFrame, keys: tuple[str, ...], k: int = 5, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """keys, ap of rows (rn, t_start, t_end, truths): greedy one-to-one matching with the truths, the later of equal overlaps; the mean precision at the hits."""
    packed = ranked.where(F.col("rn") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", F.col("t_start").cast("double").alias("s"), F.col("t_end").cast("double").alias("e")))).alias("rows"), F.first("truths").alias("truths"))
    rows = packed.withColumn("left0", F.transform("truths", lambda t, i: F.struct(i.alias("i"), t["a"].cast("double").alias("a"), t["b"].cast("double").alias("b"))))

    def step(state: Column, r: Column) -> Column:
        scored = F.transform(F.filter(state["left"], lambda t: iou(r["s"], r["e"], t["a"], t["b"]) >= threshold), lambda t: F.struct(iou(r["s"], r["e"], t["a"], t["b"]).alias("v"), t["i"].alias("i")))
        best = F.array_max(scored)
        hit = best.isNotNull()
        return F.struct(
            F.when(hit, F.filter(state["left"], lambda t: t["i"] != best["i"])).otherwise(state["left"]).alias("left"),
            (state["hits"] + hit.cast("int")).alias("hits"),
            (state["total"] + F.when(hit, (state["hits"] + 1) / r["rn"].cast("double")).otherwise(0.0)).alias("total"),
        )

    zero = F.struct(F.col("left0").alias("left"), F.lit(0).alias("hits"), F.lit(0.0).alias("total"))
    end = F.aggregate("rows", zero, step)
    return rows.select(*keys, end.alias("z")).select(*keys, F.when(F.col("z.hits") > 0, F.col("z.total") / F.col("z.hits")).otherwise(0.0).alias("ap"))


def ndcg(ranked: DataFrame, keys: tuple[str, ...], k: int = 10, gain: str = "rel") -> DataFrame:
    """keys, ndcg: linear gains, log2 discounts; 0 where nothing is relevant."""
    ideal = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(gain)))
    at = lambda n: F.when(n <= k, F.col(gain) / F.log2(n + 1)).otherwise(0.0)
    g = ranked.withColumn("__i", ideal).groupBy(*keys).agg(F.sum(at(F.col("rn"))).alias("dcg"), F.sum(at(F.col("__i"))).alias("best"))
    return g.select(*keys, F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"))


def all_metrics(ranked: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, r1, r5, r20, mrr, ndcg10, map, auc of rows (rn, is_positive), in one pass over each ranking."""
    w = Window.partitionBy(*keys).orderBy("rn")
    rows = ranked.withColumns({"__hits": F.sum(F.col("is_positive").cast("int")).over(w), "__ideal": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("is_positive"), "rn"))})
    pos = F.col("is_positive")
    first = F.min(F.when(pos, F.col("rn")))
    gain = lambda n: F.sum(F.when(pos & (n <= 10), 1 / F.log2(n + 1)).otherwise(0.0))
    g = rows.groupBy(*keys).agg(first.alias("f"), gain(F.col("rn")).alias("dcg"), gain(F.col("__ideal")).alias("best"), F.avg(F.when(pos, F.col("__hits") / F.col("rn"))).alias("map"), F.count_if(pos).cast("double").alias("a"), F.count_if(~pos).cast("double").alias("b"), F.sum(F.when(pos, F.col("rn"))).cast("double").alias("s"))
    at = lambda k: (F.col("f") <= k).cast("double")
    good = g.where("a > 0 and b > 0")
    # ranks from the top: a positive at rn beats all negatives below it
    area = 1 - (F.col("s") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b"))
    return good.select(*keys, at(1).alias("r1"), at(5).alias("r5"), at(20).alias("r20"), (1 / F.col("f")).alias("mrr"), (F.col("dcg") / F.col("best")).alias("ndcg10"), "map", area.alias("auc"))


def spearman(rows: DataFrame, a: str, b: str, tie: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, rho: the correlation of ranks, ties by `tie`, which tells rows of a key apart.

    No key is one task's work: rows are sorted in ranges by (keys, a), then by (keys, b), and keep the number of their
    range and their place in it. What the places of a key in a range begin with follows from the counts of pairs of ranges.
    """
    placed = rows.select(*keys, F.col(a).alias("__x"), F.col(b).alias("__y"), F.col(tie).alias("__t"))
    for value, name in (("__x", "a"), ("__y", "b")):
        order = [*keys, value, "__t"]
        placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
        placed = placed.withColumns({f"part_{name}": F.shiftright("__id", 33), f"at_{name}": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).cast("double")}).drop("__id")
    cells = placed.groupBy(*keys, "part_a", "part_b").agg(F.count("*").cast("double").alias("n"), F.sum("at_a").alias("sum_a"), F.sum("at_b").alias("sum_b"), F.sum(F.col("at_a") * F.col("at_b")).alias("sum_ab"), F.min("at_a").alias("min_a"), F.min("at_b").alias("min_b"))
    for name in "ab":
        key = Window.partitionBy(*keys)
        before = F.coalesce(F.sum("n").over(key.orderBy(f"part_{name}").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        cells = cells.withColumn(f"add_{name}", before + 1 - F.min(f"min_{name}").over(Window.partitionBy(*keys, f"part_{name}")))
    total = F.sum(F.col("sum_ab") + F.col("add_a") * F.col("sum_b") + F.col("add_b") * F.col("sum_a") + F.col("n") * F.col("add_a") * F.col("add_b"))
    g = (cells.groupBy(*keys) if keys else cells.groupBy()).agg(F.sum("n").alias("n"), total.alias("ab"))
    n = F.col("n")
    return g.select(*keys, F.when(n > 1, (F.col("ab") - n * F.pow((n + 1) / 2, F.lit(2.0))) / (n * (n * n - 1) / 12)).alias("rho"))


def sign_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.agg(F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("agreement"), F.avg((F.col(a) > 0).cast("double")).alias("positive_rate"))


def accuracy(rows: DataFrame, predicted: str, gold: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, accuracy, n: a null prediction is wrong."""
    right = F.coalesce(F.col(predicted) == F.col(gold), F.lit(False)).cast("double")
    return rows.groupBy(*keys).agg(F.avg(right).alias("accuracy"), F.count("*").alias("n"))


def log_correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rho: the correlation of logs, 0 without spread."""
    return rows.where((F.col(a) > 0) & (F.col(b) > 0)).agg(F.coalesce(F.nanvl(F.corr(F.ln(a), F.ln(b)), F.lit(0.0)), F.lit(0.0)).alias("rho"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The upper concave envelope of points by rising x: no chord of two others passes above one of it."""
    out: list[tuple[float, float]] = []
    for x, y in points:
        if out and out[-1][0] == x:
            if y <= out[-1][1]:
                continue
            out.pop()
        while len(out) > 1 and out[-1][1] < out[-2][1] + (y - out[-2][1]) * (out[-1][0] - out[-2][0]) / (x - out[-2][0]):
            out.pop()
        out.append((x, y))
    return out


def envelope(curve: DataFrame, keys: tuple[str, ...], cost: str = "cost", gain: str = "gain") -> DataFrame:
    """The upper concave envelope of each key's (cost, gain) points, as the distinct points on it.

    A fold over the sorted points. The envelope of parts' envelopes is the envelope of all, so a key's points are first
    folded in PARTS parts and no key, however many points it has, is one task's work.
    """
    p = curve.select(*keys, F.col(cost).cast("double").alias("x"), F.col(gain).cast("double").alias("y")).where("x is not null and y is not null").distinct()
    for key in ((*keys, "part"), keys):
        names = [*key, "x", "y"]
        rows = (p.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(PARTS)).cast("int")) if "part" in key else p).select(*names)
        if not key:
            rows, key, names = rows.withColumn("part", F.lit(0)), ("part",), [*names, "part"]
        p = folded(rows, key, ["x", "y"], _hulls(key, to_arrow_schema(rows.schema)), rows.schema).select(*keys, "x", "y")
    return p.withColumnsRenamed({"x": cost, "y": gain})


def _hulls(key: tuple[str, ...], schema: pa.Schema) -> Callable[[Iterator], Iterator[pa.RecordBatch]]:
    def run(stretches: Iterator) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            owner, held = None, []
            for of, c in chain(stretches, [(None, {"x": [], "y": []})]):
                if of != owner:
                    for x, y in held:
                        row = {**dict(zip(key, owner)), "x": x, "y": y}
                        yield tuple(row[n] for n in schema.names)
                    owner, held = of, []
                held = hull(held + list(zip(c["x"], c["y"])))

        yield from emitted(schema, rows())

    return run

