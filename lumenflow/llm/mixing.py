"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order (MD5 of seed and doc_id). A
document's virtual finish time is its source's tokens up to and with it, divided by the source's weight. All
documents are served by finish time, and the service stops at the first that would exceed the token budget,
a share of all tokens. Until a source runs dry, each gets tokens in proportion to its weight.

No task ever holds a whole source: the running sums are prefix sums in two levels, over
ranges of the (uniform) hash within a source and over ranges of finish time between them. The ranges follow from the number of rows.
What is chosen of a source is a prefix of its queue, so `mix` needs only one cut a source
and filters the documents where they lie; no text is shuffled.

Defined results
---------------
* Tokens are maximal runs without white space; a null or blank text has 0 tokens and takes its turn.
* Null sources are one queue of their own, with the default weight. Sources without a weight have the default weight;
  a weight of 0 or less leaves a source out.
* Repeated rows of a doc_id in a source are one entry of their tokens together: they are taken or left together. Null doc_ids likewise.
* Ties in finish time: by hash, then doc_id, then source, nulls first. An empty table gives no rows.
* Other columns are ignored, and pass through `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, cut, fresh

#: Weights of the production mix; any other source has the default.
WEIGHTS = {"src0": 2.0, "src1": 4.0, "src2": 4.0, "src3": 3.0, "src4": 2.0, "src5": 2.0}
DEFAULT_WEIGHT = 1.0
BUDGET_SHARE = 0.8
SEED = "mix-1"
#: Rows, about, of a range of a source's hash, within which one task sums; the sums of ranges are carried between them.
RANGE_ROWS = 50_000
#: Finish times are parted evenly into so many times more ranges, as they are densest where all sources have documents; most ranges.
DENSER, MOST_RANGES = 16, 1 << 20


def n_tokens(text: Column | str) -> Column:
    """Maximal runs without (ASCII) white space."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\s]+")), F.lit(0)).cast("long")


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    cases = None
    for k, w in weights.items():
        cases = (F.when if cases is None else cases.when)(source == k, F.lit(float(w)))
    return F.lit(float(default)) if cases is None else cases.otherwise(F.lit(float(default)))


def _shuffled(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _entries(docs: DataFrame, weights: dict[str, float], default: float, seed: str) -> DataFrame:
    entry = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text").cast("string")).alias("n"))
    entry = entry.groupBy("source", "doc_id").agg(F.sum("n").alias("n_tokens"))
    return entry.withColumn("weight", _weight(F.col("source"), weights, default)).where("weight > 0").withColumn("h", _shuffled(F.col("doc_id"), seed))


def schedule(docs: DataFrame, weights: dict[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, budget_share: float = BUDGET_SHARE, seed: str = SEED) -> DataFrame:
    """doc_id, source, n_tokens, finish_time, total_tokens (served up to and with it) of the documents within the budget."""
    entry = cut(_entries(docs, weights, default_weight, seed))
    ranges = entry.count() // RANGE_ROWS + 1
    entry = entry.withColumn("part", F.substring("h", 1, (ranges.bit_length() + 3) // 4))
    parts = entry.groupBy("source", "part").agg(F.sum("n_tokens").alias("s"))
    before = parts.select("source", "part", (F.sum("s").over(Window.partitionBy("source").orderBy("part")) - F.col("s")).alias("before"))
    own = Window.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    e = entry.withColumn("run", F.sum("n_tokens").over(own))
    e = e.join(before.toDF("__source", "__part", "before"), F.col("source").eqNullSafe(F.col("__source")) & (F.col("part") == F.col("__part")))
    timed = cut(e.select("doc_id", "source", "n_tokens", "h", ((F.col("before") + F.col("run")) / F.col("weight")).alias("finish_time")))
    total, last = timed.agg(F.sum("n_tokens"), F.max("finish_time")).first()
    budget, ranges = int((total or 0) * budget_share), min(ranges * DENSER, MOST_RANGES)
    ranged = timed.withColumn("range", F.floor(F.col("finish_time") / F.lit((last or 1.0) / ranges)))
    sums = ranged.groupBy("range").agg(F.sum("n_tokens").alias("s"))
    offset = sums.select(F.col("range").alias("__range"), (F.sum("s").over(Window.orderBy("range")) - F.col("s")).alias("before"))
    within = Window.partitionBy("range").orderBy("finish_time", "h", "doc_id", "source").rowsBetween(Window.unboundedPreceding, 0)
    served = ranged.withColumn("run", F.sum("n_tokens").over(within)).join(F.broadcast(offset), F.col("range") == F.col("__range"))  # MOST_RANGES rows at most
    return served.select("doc_id", "source", "n_tokens", "finish_time", (F.col("before") + F.col("run")).alias("total_tokens"), "h").where(F.col("total_tokens") <= budget)


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, budget_share: float = BUDGET_SHARE, seed: str = SEED) -> DataFrame:
    """The rows of `docs` that `schedule` serves, with their columns."""
    # a chosen document's place in its queue: at or before the last one chosen of its source
    own = fresh(docs, "__last")
    source, last_h, last_id = (f"{own}{c}" for c in ("source", "h", "id"))
    last = schedule(docs, weights, default_weight, budget_share, seed).groupBy("source").agg(F.max(F.struct("h", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("last")).select(F.col("source").alias(source), F.col("last.h").alias(last_h), F.col("last.id").alias(last_id))
    key, h = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))), _shuffled(docs["doc_id"].cast("long"), seed)
    return docs.join(checked(cut(last)), docs["source"].cast("string").eqNullSafe(F.col(source)) & ((h < F.col(last_h)) | ((h == F.col(last_h)) & (key <= F.col(last_id)))), "left_semi")
