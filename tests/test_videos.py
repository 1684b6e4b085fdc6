"""Searches and pools over whole videos: results as by pairs, and no pairs that leave a task."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.operators import arrow as ar
from lumenflow.operators import collection as co
from lumenflow.operators import frames as fr
from lumenflow.operators import selection as se
from lumenflow.operators import videos as vi
from lumenflow.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

#: Fewer rows than pairs leave the Python tasks.
CHOSEN = [
    "topk_frames",
    "nms_frames",
    "segment_frames",
    "segment_adaptive_frames",
    "uniform_frames",
    "collection_search",
    "hits_as_json",
    "per_video_cap",
    "best_per_video",
    "ann_search",
    "ann_recall",
    "feedback_search",
    "chunk_scores_topk",
    "chunk_scores_adaptive",
    "chunk_scores_max",
    "chunk_scores_power",
    "chunk_scores_mean",
    "chunk_scores_softmax",
    "chunk_scores_varbonus",
    "chunk_scores_varpen",
    "confidence_signals",
    "peakedness",
    "zscore_descriptors",
    "best_true_rank",
]
#: Every pair is a row of the result, but no pair is shuffled or joined.
PAIRS = [
    "smoothed_scores",
    "triangle_smoothed_scores",
    "motion_scores",
    "vector_norms",
]


def rows_by_node(df):
    """Rows out of Python tasks and into shuffles, and the plan, of a query that has run."""
    python = shuffled = 0
    todo = [df._jdf.queryExecution().executedPlan()]
    text = todo[0].toString()
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        metrics = node.metrics()
        for name in ("pythonNumRowsReceived", "shuffleRecordsWritten"):
            if metrics.contains(name):
                n = metrics.apply(name).value()
                python, shuffled = python + n * (name[0] == "p"), shuffled + n * (name[0] == "s")
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return python, shuffled, text


def run(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    df.collect()
    frames = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    return *rows_by_node(df), frames.count() * frames.where("vec_id % 20 = 0").count()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_no_pairs_leave_a_task(spark, name):
    python, _, _, pairs = run(spark, name)
    assert 0 < python < pairs / 2


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", PAIRS)
def test_no_pairs_are_shuffled(spark, name):
    _, shuffled, plan, pairs = run(spark, name)
    assert shuffled < pairs / 2 and "Join" not in plan


@pytest.fixture(scope="module")
def odd(spark):
    """Frames with equal vectors and times, vectors that are missing, of another length or hold a null; and such queries."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(120):
        e = r.integers(-2, 3, size=6).astype(float).tolist()
        e = None if i % 11 == 0 else e[:4] if i % 13 == 0 else [None, *e[1:]] if i % 17 == 0 else e
        rows.append(("a" if i % 3 else "b", i, float(i // 2), e))
    frames = spark.createDataFrame(rows, "video string, frame_idx int, ts double, emb array<double>").repartition(3).cache()
    queries = spark.createDataFrame([(k, r.integers(-2, 3, size=n).astype(float).tolist() if n else None) for k, n in enumerate((6, 6, 4, 0, 6))], "query_id int, q array<double>").cache()
    return frames, queries


def told(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize(("block", "cells"), [(2, 1), (10_000, 1 << 21)])
def test_choices_are_those_of_pairs(odd, monkeypatch, block, cells):
    monkeypatch.setattr(ar, "BROADCAST_QUERIES", block)
    monkeypatch.setattr(vi, "CELLS", cells)
    frames, queries = odd
    frames = frames.withColumn("seg_id", F.floor(F.col("frame_idx") / 7).cast("int"))
    pairs, columns = fr.similarity(frames, queries), ("query_id", "video", "frame_idx", "sim", "pick")
    for budget in (5, 500):
        assert told(se.topk_of(frames, queries, budget), *columns) == told(se.topk(pairs, budget), *columns)
        assert told(se.segment_of(frames, queries, budget), *columns) == told(se.segment(pairs, budget), *columns)
        assert told(se.uniform_of(frames, queries, budget), *columns) == told(se.uniform(pairs, budget), *columns)
    hit = ("query_id", "video", "ts", "sim", "rank")
    for k, gap, cap in ((7, 0.0, 2), (9, 3.0, None)):
        got, want = co.search(frames, queries, k, None, gap, cap).where("sim is not null"), co.collapse(pairs.where("sim is not null"), k, gap, cap)
        assert told(got, *hit) == told(want, *hit)
    got, want = se.nms_of(frames, queries, 9).where("sim is not null"), se.nms(pairs.where("sim is not null"), 9, 59 / 18)
    assert told(got.where("video = 'a'"), *columns) == told(want.where("video = 'a'"), *columns)


def test_products_are_summed_in_order():
    r = np.random.default_rng(1)
    for dim in (1, 2, 7, 64):
        for n in (1, 2, 3, 8, 9, ar.TILE + 1):
            for m in (1, 2, 5):
                a, b = r.normal(size=(m, dim)) * 10.0 ** r.integers(-3, 3, size=(m, 1)), r.normal(size=(n, dim))
                want = np.zeros((m, n))
                for k in range(dim):
                    want += a[:, k : k + 1] * b[:, k]
                assert (ar.dots(a, b) == want).all() and (ar.dots(b, a) == want.T).all()
