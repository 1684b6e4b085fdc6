import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.functions.vectors import dot
from lumenflow.operators import arrow as ar
from lumenflow.operators import collection as co
from lumenflow.operators import frames as fr
from lumenflow.operators import selection as se
from lumenflow.sources import adapters as ad


def blocks(n=240, dim=8, seed=0):
    """Runs of 5 to 20 similar unit vectors."""
    r = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base = r.normal(size=dim)
        for _ in range(int(r.integers(5, 20))):
            v = base + 0.05 * r.normal(size=dim)
            out.append(v / np.linalg.norm(v))
    return np.array(out[:n], np.float32)


@pytest.fixture(scope="module")
def emb():
    return blocks()


@pytest.fixture(scope="module")
def frames(spark, emb):
    return spark.createDataFrame([("v", i, float(i), e.tolist()) for i, e in enumerate(emb)], "video string, frame_idx int, ts double, emb array<float>").cache()


@pytest.fixture(scope="module")
def queries(spark, emb):
    return spark.createDataFrame([("q", emb[100].tolist())], "query_id string, q array<float>").cache()


def picks(df):
    return [r["frame_idx"] for r in df.orderBy("pick").collect()]


@pytest.mark.parametrize("budget", [1, 7, 40, 1000])
@pytest.mark.parametrize("strategy", se.STRATEGIES)
def test_budget_unique_and_in_the_index(frames, queries, strategy, budget):
    source = frames.withColumn("seg_id", F.floor(F.col("frame_idx") / 12).cast("int"))
    got = picks(se.select(source, queries, budget, strategy))
    assert len(got) == len(set(got)) <= min(budget, 240) and set(got) <= set(range(240))
    if strategy != "nms":
        assert len(got) == min(budget, 240) or strategy == "uniform"


def test_single_frame_segments_are_topk(frames, queries):
    source = fr.greedy_segments(frames, 0.0).select("video", "frame_idx", "seg_id").join(frames, ["video", "frame_idx"])
    scored = fr.similarity(source, queries)
    for budget in (1, 5, 25, 100):
        assert picks(se.segment(scored, budget)) == picks(se.topk(scored, budget))
    assert set(picks(se.segment_adaptive(frames, queries, 60))) == set(picks(se.topk(fr.similarity(frames, queries), 60)))


def test_nms_against_a_loop(frames, queries, emb):
    sim = emb.astype(float) @ emb[100].astype(float)
    for window in (None, 5.0, 30.0):
        w = 239 / 32 if window is None else window
        kept: list[int] = []
        for i in np.argsort(-sim, kind="stable"):
            if len(kept) < 16 and all(abs(i - k) > w for k in kept):
                kept.append(int(i))
        assert picks(se.nms(fr.similarity(frames, queries), 16, window)) == kept


def test_segment_round_robin_against_a_loop(frames, queries, emb):
    cut = fr.cut_into(fr.adjacent_similarity(frames), 10).drop("adj")
    scored = fr.similarity(cut, queries)
    rows = scored.collect()
    by: dict = {}
    for r in sorted(rows, key=lambda r: (-r["sim"], r["frame_idx"])):
        by.setdefault(r["seg_id"], []).append(r)
    order = sorted(by, key=lambda s: (-by[s][0]["sim"], s))
    want = [by[s][d]["frame_idx"] for d in range(240) for s in order if d < len(by[s])][:35]
    assert picks(se.segment(scored, 35)) == want


def test_cuts_are_at_the_least_similar(frames, emb):
    adj = (emb[1:].astype(float) * emb[:-1].astype(float)).sum(axis=1)
    for n in (1, 2, 9, 240, 10_000):
        seg = [r["seg_id"] for r in fr.cut_into(fr.adjacent_similarity(frames), n).orderBy("frame_idx").collect()]
        cuts = set(np.argsort(adj, kind="stable")[: min(n, 240) - 1] + 1)
        assert seg == np.cumsum([i in cuts for i in range(240)]).tolist()


def test_greedy_segments_against_a_loop(frames, emb):
    for tau in (0.3, 0.9):
        seg, total, want = 0, emb[0].astype(float), [0]
        for e in emb[1:].astype(float):
            if e @ total / (np.linalg.norm(total) + 1e-12) >= tau:
                total = total + e
            else:
                seg, total = seg + 1, e
            want.append(seg)
        assert [r["seg_id"] for r in fr.greedy_segments(frames, tau).orderBy("frame_idx").collect()] == want


def test_segment_bounds_and_representatives(frames, emb):
    cut = fr.cut_into(fr.adjacent_similarity(frames), 6)
    reps = {r["seg_id"]: np.array(r["rep"]) for r in fr.segment_representatives(cut).collect()}
    for r in fr.segments(cut).collect():
        mean = emb[r["frame_start"] : r["frame_end"]].astype(float).mean(axis=0)
        assert np.allclose(reps[r["seg_id"]], mean / np.linalg.norm(mean), atol=1e-6)
        assert (r["t_start"], r["t_end"], r["n_frames"]) == (r["frame_start"], r["frame_end"] - 1, r["frame_end"] - r["frame_start"])


def test_gate_and_fill(spark):
    values = [0, 1, 2, 6, 7, 1, 1, 9]
    rows = spark.createDataFrame([("v", float(i), i, float(x)) for i, x in enumerate(values)], "video string, ts double, frame_idx long, x double")
    out = fr.filled(fr.gated(rows, "x", 5.0), "x").orderBy("ts").collect()
    assert [r["kept"] for r in out] == [True, False, False, True, False, True, False, True]
    assert [r["filled"] for r in out] == [0, 0, 0, 6, 6, 1, 1, 9]


def test_sampling_keeps_true_times(spark):
    times = [0.0, 0.4, 0.9, 1.1, 1.9, 2.2, 5.0, 5.5, 6.0]
    rows = spark.createDataFrame([("v", i, t) for i, t in enumerate(times)], "video string, frame_idx int, ts double")
    assert [r["ts"] for r in fr.sampled(rows, 1.0).orderBy("ts").collect()] == [0.0, 1.1, 2.2, 5.0, 6.0]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5])
def test_smoothing_is_a_same_size_convolution(frames, queries, emb, width):
    sim = emb.astype(float) @ emb[100].astype(float)
    for kind, kernel in (("box", np.ones(width) / width), ("triangle", np.bartlett(width + 2)[1:-1] / np.bartlett(width + 2)[1:-1].sum())):
        got = [r["smooth"] for r in fr.smoothed(fr.similarity(frames, queries), width, kind).orderBy("frame_idx").collect()]
        want = np.convolve(sim, kernel, "full")[(width - 1) // 2 :][:240]
        assert np.allclose(got, want, atol=1e-9)


def test_query_vectors():
    assert fr.query_vector([3, 4], 2) == [0.6, 0.8] and fr.query_vector([0, 0], 2) == [0, 0]
    with pytest.raises(ValueError, match="3 dimensions.* 2"):
        fr.query_vector([1, 2, 3], 2)


def test_scale_of_the_query_changes_nothing(spark, frames, emb):
    both = spark.createDataFrame([("a", fr.query_vector(emb[3].tolist(), 8)), ("b", fr.query_vector((17 * emb[3]).tolist(), 8))], "query_id string, q array<double>")
    got = {q: [r["frame_idx"] for r in se.topk(fr.similarity(frames, both), 50).where(F.col("query_id") == q).orderBy("pick").collect()] for q in "ab"}
    assert got["a"] == got["b"]


def test_collapse_golden(spark):
    hits = spark.createDataFrame([("q", "a", 100.0, 0.9), ("q", "a", 110.0, 0.8), ("q", "b", 5.0, 0.7), ("q", "a", 900.0, 0.6), ("q", "a", 130.0, 0.5)], "query_id string, video string, ts double, sim double")
    get = lambda *a: [(r["video"], r["ts"]) for r in co.collapse(hits, *a).orderBy("rank").collect()]
    assert get(10, 30.0) == [("a", 100), ("b", 5), ("a", 900), ("a", 130)]  # exactly the gap apart is apart
    assert get(3, 31.0) == [("a", 100), ("b", 5), ("a", 900)]
    assert get(10, 0.0, 1) == [("a", 100), ("b", 5)]


def test_one_video_search_with_a_quote(spark, emb):
    rows = [(v, i, float(40 * i), emb[i].tolist()) for v in ("it's", "b") for i in range(50)]
    f = spark.createDataFrame(rows, "video string, frame_idx int, ts double, emb array<float>")
    q = spark.createDataFrame([("q", emb[7].tolist())], "query_id string, q array<float>")
    out = co.search(f, q, 5, video="it's").collect()
    assert len(out) == 5 and {r["video"] for r in out} == {"it's"}


def test_all_probes_are_exact(frames, queries):
    c = co.centroids(frames, 12)
    index = co.inverted_index(frames, c)
    exact = co.search(frames, queries, 10, min_gap_s=0)
    assert co.overlap(exact, co.approximate_search(index, c, queries, 10, 12, 0)).first()["recall"] == 1.0
    assert co.overlap(exact, co.approximate_search(index, c, queries, 10, 4, 0)).first()["recall"] >= 0.7
    assert index.count() == 240 and co.n_lists(10_000) == 100


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_approximate_recall_against_brute_force(spark, folder):
    path = f"/root/testdata/{folder}"
    if not os.path.isdir(path):
        pytest.skip("no tables")
    f, q = ad.collection(spark, path), ad.queries(spark, path)
    c = co.centroids(f, co.n_lists(f.count()))
    index, probes = co.inverted_index(f, c), co.calibrated_probes(f, c)
    assert index.count() == f.count() and index.where("list_id is null").count() == 0
    for gap in (0.0, 30.0):
        found = co.overlap(co.search(f, q, 20, min_gap_s=gap), co.approximate_search(index, c, q, 20, probes, gap))
        assert found.agg(F.avg("recall")).first()[0] >= 0.9


def test_products_are_the_column_expression(spark, monkeypatch):
    rows = spark.createDataFrame([("v", 0, [1.0, 2.0]), ("v", 1, None), ("v", 2, [1.0]), ("v", 3, [1.0, None]), ("v", 4, [])], "video string, frame_idx int, emb array<double>")
    qs = spark.createDataFrame([("a", [3.0, 4.0]), ("b", None), ("c", [2.0])], "query_id string, q array<double>")
    want = {(r[0], r[1]): r[2] for r in rows.crossJoin(qs).select("query_id", "frame_idx", dot("emb", "q")).collect()}
    want[("b", 4)] = None
    got = {(r["query_id"], r["frame_idx"]): r["sim"] for r in fr.similarity(rows, qs).collect()}
    assert got == want and len(got) == 15
    monkeypatch.setattr(ar, "BROADCAST_QUERIES", 1)  # in blocks
    assert {(r["query_id"], r["frame_idx"]): r["sim"] for r in fr.similarity(rows, qs).collect()} == want
    assert fr.similarity(rows, qs.limit(0)).count() == 0


def test_a_capped_fold_is_the_whole_one(spark):
    r = np.random.default_rng(5)
    hits = spark.createDataFrame([(f"q{i % 3}", f"v{i % 2}", float(t), float(x)) for i, (t, x) in enumerate(zip(r.integers(0, 500, 400), r.random(400).round(2)))], "query_id string, video string, ts double, sim double")
    for gap, cap in ((30.0, None), (0.0, None), (0.0, 3), (30.0, 2)):
        whole = co.collapse(hits, None, gap, cap).where("rank <= 7")
        assert sorted(map(tuple, co.collapse(hits, 7, gap, cap).collect())) == sorted(map(tuple, whole.collect()))
