"""Documents as passages: windows of sentences or words, pooled scores, loaders' shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sentences, windows
from ..functions.vectors import topk_mean


def passages(docs: DataFrame, size: int = 2, stride: int = 1) -> DataFrame:
    """doc_id, passage, text: windows of `size` sentences every `stride`."""
    return docs.select("doc_id", F.posexplode(windows(sentences(F.col("text")), size, stride)).alias("passage", "text"))


def pooled(scores: DataFrame, k: int, keys: tuple[str, ...] = ("query_id", "doc_id")) -> DataFrame:
    """keys, score: each document's mean of its k best passages."""
    return scores.groupBy(*keys).agg(F.collect_list("score").alias("v")).select(*keys, topk_mean("v", k).alias("score"))


def lexical_score(text: Column, terms: list[str]) -> Column:
    """A deterministic stand-in for a text encoder: the share of a passage's words that are query terms."""
    words = F.filter(F.split(F.lower(text), r"[^\w]+"), lambda w: w != "")
    hits = F.filter(words, lambda w: w.isin(terms))
    return F.when(F.size(words) > 0, F.size(hits) / F.size(words)).otherwise(F.lit(0.0))


def counts(passages_: DataFrame) -> DataFrame:
    """Documents, and the median number of passages of one."""
    per = passages_.groupBy("doc_id").count()
    return per.agg(F.count("*").alias("n_docs"), F.percentile("count", 0.5).alias("median_passages"))


def judged_first(corpus: DataFrame, judged: DataFrame, limit: int) -> DataFrame:
    """A subsample of the corpus: judged documents first, then the others by id."""
    flag = judged.select("doc_id").distinct().withColumn("is_judged", F.lit(1))
    return corpus.join(flag, "doc_id", "left").withColumn("is_judged", F.coalesce("is_judged", F.lit(0))).orderBy(F.desc("is_judged"), "doc_id").limit(limit)
