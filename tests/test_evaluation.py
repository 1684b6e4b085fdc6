import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenflow.operators import events as ev
from lumenflow.operators import merge as me
from lumenflow.operators import metrics as mt
from lumenflow.operators import pooling as po


def stream(spark, positives, n=20, value=1.0):
    return spark.createDataFrame([("v", "q", i, float(i), value if i in positives else -1.0) for i in range(n)], "video string, query_id string, frame_idx long, ts double, score double")


def spans(df):
    return sorted((r["t_start"], r["t_end"], r["n_frames"]) for r in df.collect())


def test_events_golden(spark):
    assert spans(ev.events_from_scores(stream(spark, {3, 4, 6, 7}))) == [(3, 7, 4)]
    assert spans(ev.events_from_scores(stream(spark, {3, 4, 15, 16}))) == [(3, 4, 2), (15, 16, 2)]
    assert spans(ev.events_from_scores(stream(spark, {3, 6}))) == [(3, 6, 2)]  # the gap itself merges
    assert spans(ev.events_from_scores(stream(spark, {3, 9, 10}), min_frames=2)) == [(9, 10, 2)]
    assert spans(ev.events_from_scores(stream(spark, set()))) == []


def test_event_and_frame_recall_golden(spark):
    truth = stream(spark, {*range(10, 50), 80}, 100)
    events = ev.events_from_scores(truth)
    for hits, recall in (([11], 0.5), ([11, 12, 13], 0.5), ([11, 80], 1.0), ([], 0.0)):
        h = spark.createDataFrame([("v", "q", float(t)) for t in hits], "video string, query_id string, ts double")
        assert ev.event_recall(events, h).first()["event_recall"] == recall
    one = spark.createDataFrame([("v", "q", 11)], "video string, query_id string, frame_idx long")
    positives = stream(spark, set(range(10, 50)), 100).where("score > 0")
    assert ev.frame_recall(positives, one).first()["frame_recall"] == 1 / 40


def test_evaluate_selection_golden(spark):
    truth = stream(spark, set(range(10, 20)), 100)
    pick = lambda *t: spark.createDataFrame([("v", "q", float(x)) for x in t], "video string, query_id string, ts double")
    for times, n, precision, recall in (((90,), 0, 0.0, 0.0), ((12,), 1, 1.0, 1.0), ((12, 90), 1, 0.5, 1.0)):
        r = ev.evaluate_selection(truth, pick(*times)).first()
        assert (r["n_confirmed"], r["precision"], r["event_recall"]) == (n, precision, recall)
    with pytest.raises(Exception, match="more than 1.5 s"):
        ev.evaluate_selection(truth, pick(150.0)).collect()


def test_nearest_ties_and_ends(spark):
    table = spark.createDataFrame([("v", t) for t in (0.0, 2.0, 10.0)], "video string, ts double")
    wanted = spark.createDataFrame([("v", t) for t in (-5.0, 0.9, 1.0, 1.1, 2.0, 30.0)], "video string, ts double")
    got = {r["ts"]: r["near_ts"] for r in ev.nearest(wanted, table, ("video",)).collect()}
    assert got == {-5.0: 0.0, 0.9: 0.0, 1.0: 2.0, 1.1: 2.0, 2.0: 2.0, 30.0: 10.0}  # equally near: the later
    assert {r["ts"]: r["near_ts"] for r in ev.nearest(wanted, table, ("video",), 3.0).collect()}[30.0] is None


HIT = "query_id string, rank int, time double, score double, source string, text string, vlm_score double"


def merged(spark, rows, gap=10.0, k=32):
    df = spark.createDataFrame([("q", *r, None) if len(r) == 5 else ("q", *r) for r in rows], HIT)
    return me.merge(df, k, gap).orderBy("rank").collect()


def test_merge_goldens(spark):
    out = merged(spark, [(0, 100.0, 0.3, "visual", None), (1, 500.0, 0.2, "visual", None), (0, 104.0, 0.9, "speech", "said"), (1, 900.0, 0.8, "speech", "else")])
    assert len(out) == 3 and (out[0]["source"], out[0]["time"], out[0]["text"]) == ("speech+visual", 100, "said")
    out = merged(spark, [(0, 10.0, 0.3, "visual", None), (0, 500.0, 0.9, "speech", "x")])
    assert [r["source"] for r in out] == ["visual", "speech"]
    out = merged(spark, [(0, 90.0, 0.5, "visual", None), (1, 42.0, 0.2, "visual", None), (0, 44.0, 0.9, "speech", "s"), (0, 43.0, 0.7, "text", "t")])
    assert (out[0]["source"], out[0]["time"], out[0]["score"]) == ("speech+text+visual", 42, 0.2)
    out = merged(spark, [(0, 100.0, 0.5, "visual", None), (1, 103.0, 0.4, "visual", None), (0, 101.0, 0.9, "speech", "s")])
    assert sorted(r["source"] for r in out) == ["speech+visual", "visual"]


def test_above(spark):
    hits = spark.createDataFrame([(0.0, 2.0), (1.0, -1.0), (2.0, 0.5), (3.0, None)], "time double, vlm_score double")
    assert [r["time"] for r in me.above(hits, 0.0, True).orderBy("time").collect()] == [0, 2]
    with pytest.raises(ValueError, match="confirm"):
        me.above(hits, 0.0, False)


def test_sources():
    have = ["visual", "speech"]
    assert me.resolve_sources(None, have) == have and me.resolve_sources("speech", have) == ["speech"]
    for bad, what in (("text", "no 'text'"), ("smell", "unknown source")):
        with pytest.raises(ValueError, match=what):
            me.resolve_sources(bad, have)


def test_empty_chunk_ranks_last(spark):
    scored = spark.createDataFrame([("q", "v", t, s) for t, s in ((0.0, 0.1), (1.0, 0.2), (2.0, 0.3), (25.0, 0.1), (26.0, 0.9))], "query_id string, video string, ts double, sim double")
    grid = spark.createDataFrame([("q", "v", c) for c in range(3)], "query_id string, video string, chunk int")
    out = {r["chunk"]: r["score"] for r in po.score_chunks(po.chunked(scored, 10.0, F.lit(3)), grid, "topk", 2).collect()}
    assert out[1] < -1e8 and math.isclose(out[0], 0.25) and math.isclose(out[2], 0.5)
    with pytest.raises(ValueError, match="unknown aggregation"):
        po.score_chunks(po.chunked(scored, 10.0, F.lit(3)), grid, "nope", 2)


def test_matching_units_goldens(spark):
    def m(counts):
        return po.matching_units(spark.createDataFrame([([True] * c + [False] * 3,) for c in counts], "relevant array<boolean>")).select("m", po.recommended_k("m").alias("k"), po.k_range("m").alias("r")).first()

    first = m([1] * 6 + [2] * 5 + [4])
    assert (first["m"], first["k"]) == (1.5, 1)
    second = m([8] * 20)
    assert second["k"] == 4 and second["r"][0] == 1 and second["r"][-1] == 8
    assert m([0, 1])["m"] is None


def test_sweep_finds_the_planted_depth(spark):
    r = np.random.default_rng(5)
    rows = []
    for g in range(120):
        for i in range(30):
            s = r.normal(size=32)
            if i == 0:
                s[:8] += 1.6
            rows.append((g, i, i == 0, s.tolist()))
    c = spark.createDataFrame(rows, "group int, item int, is_positive boolean, scores array<double>").cache()
    sweep = po.sweep_k(c, [1, 2, 4, 8, 16, 32])
    by = {x["k"]: x["score"] for x in sweep.collect()}
    best = po.best_k(sweep).first()
    assert 4 <= best["best_k"] <= 16 and by[best["best_k"]] > max(by[1], by[32]) and not best["flat"]


def test_bootstrap(spark):
    v = spark.createDataFrame([(i, float(i % 2)) for i in range(400)] + [(900, None), (901, float("nan"))], "i int, x double")
    r = po.bootstrap(v, "x", 300).first()
    assert r["mean"] == 0.5 and 0.43 < r["low"] < 0.5 < r["high"] < 0.57
    assert po.bootstrap(v, "x", 300).first() == r  # seeded
    assert po.bootstrap(v.repartition(7), "x", 300).first()["low"] == pytest.approx(r["low"])


def test_matched_precision_takes_the_later_of_equals(spark):
    t = [(0.0, 10.0), (0.0, 10.0), (40.0, 50.0)]
    rows = spark.createDataFrame([("q", 1, 0.0, 10.0, t), ("q", 2, 100.0, 110.0, t), ("q", 3, 0.0, 10.0, t), ("q", 4, 0.0, 10.0, t)], "query_id string, rn int, t_start double, t_end double, truths array<struct<a:double,b:double>>")
    assert mt.matched_precision(rows, ("query_id",)).first()["ap"] == pytest.approx((1 + 2 / 3) / 2)


def test_auc_and_win_probability(spark):
    rows = spark.createDataFrame([("g", i, i >= 7, float(i)) for i in range(10)] + [("h", 1, True, 0.0)], "group string, item int, is_positive boolean, score double")
    assert {r["group"]: r["auc"] for r in po.auc(rows, ("group",), "item").collect()} == {"g": 1.0, "h": None}
    p = spark.range(1).select(po.win_probability(F.lit(40), F.lit(49), 5).alias("p"), po.win_probability(F.lit(3), F.lit(49), 5).alias("z")).first()
    assert p["p"] == pytest.approx(math.comb(40, 5) / math.comb(49, 5)) and p["z"] == 0


def test_merging_shards(spark):
    from lumenflow.sources import tables

    a = stream(spark, {3})
    assert tables.merge_shards(a, a, ("video", "query_id", "frame_idx"), 1e-6).count() == 20
    with pytest.raises(ValueError, match="differ"):
        tables.merge_shards(a, stream(spark, {4}), ("video", "query_id", "frame_idx"), 1e-6)


def test_next_frame_only(spark):
    w = spark.createDataFrame([("v", 5.0), ("v", 9.5)], "video string, ts double")
    t = spark.createDataFrame([("v", 4.9), ("v", 6.0), ("v", 9.0)], "video string, ts double")
    near = {r["ts"]: r["near_ts"] for r in ev.nearest(w, t, ("video",), 2.0, side="forward").collect()}
    assert near == {5.0: 6.0, 9.5: None}


def test_a_border_frame_is_in_both_closed_slices(spark):
    spans = spark.createDataFrame([("v", 0, 0.0, 10.0), ("v", 1, 10.0, 20.0)], "video string, event int, t_start double, t_end double")
    hits = spark.createDataFrame([("v", x) for x in (0.0, 10.0, 20.0, 20.1)], "video string, hit double")
    assert sorted((r["event"], r["hit"]) for r in ev.closed_slice(spans, hits).collect()) == [(0, 0.0), (0, 10.0), (1, 10.0), (1, 20.0)]


def test_best_ranks_in_cells_against_all_pairs(spark):
    r = np.random.default_rng(3)
    events = [("v", "q", k, float(a), float(a + d)) for k, (a, d) in enumerate(zip(r.integers(0, 20_000, 30), r.integers(0, 9_000, 30)))]
    ranked = [("v", "q", float(t), k + 1) for k, t in enumerate(r.integers(0, 30_000, 200))]
    want = {e[2]: min((x[3] for x in ranked if e[3] <= x[2] <= e[4]), default=None) for e in events}
    e, x = spark.createDataFrame(events, "video string, query_id string, event int, t_start double, t_end double"), spark.createDataFrame(ranked, "video string, query_id string, ts double, rank int")
    assert {r["event"]: r["best_rank"] for r in ev.best_rank_per_event(e, x).collect()} == {k: v for k, v in want.items() if v is not None}


def test_envelope_without_keys_and_with_ties(spark):
    points = [(0.0, 0.0), (1.0, 2.0), (1.0, 1.0), (2.0, 1.0), (3.0, 4.0), (2.0, 3.0), (3.0, 4.0)]
    p = spark.createDataFrame([("k", *x) for x in points], "k string, cost double, gain double")
    want = [(0.0, 0.0), (1.0, 2.0), (2.0, 3.0), (3.0, 4.0)]
    assert sorted((r["cost"], r["gain"]) for r in mt.envelope(p, ("k",)).collect()) == want
    assert sorted((r["cost"], r["gain"]) for r in mt.envelope(p, ()).collect()) == want


def test_bootstrap_by_key(spark):
    v = spark.createDataFrame([(k, i, float(i % 2 + 10 * k)) for k in range(3) for i in range(200)], "k int, i int, x double")
    got = {r["k"]: r for r in po.bootstrap(v, "x", 200, keys=("k",)).collect()}
    assert all(10 * k + 0.4 < got[k]["low"] < got[k]["mean"] == 10 * k + 0.5 < got[k]["high"] < 10 * k + 0.6 for k in range(3))


def test_spearman_ranks_a_key_in_many_tasks(spark):
    """No task gets all rows of a key, equal values and few keys included."""
    rows = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") % 5).alias("a"), F.when(F.col("id") % 7 > 0, F.hash("id") % 100).alias("b"), "id").cache()
    got = mt.spearman(rows, "a", "b", "id", ("k",))
    rank = lambda c: F.row_number().over(Window.partitionBy("k").orderBy(c, "id")).cast("double")
    want = {r["k"]: r["rho"] for r in rows.withColumns({"x": rank("a"), "y": rank("b")}).groupBy("k").agg(F.corr("x", "y").alias("rho")).collect()}
    assert {r["k"]: r["rho"] for r in got.collect()} == pytest.approx(want)
    whole = rows.withColumns({"x": F.row_number().over(Window.orderBy("a", "id")).cast("double"), "y": F.row_number().over(Window.orderBy("b", "id")).cast("double")})
    assert mt.spearman(rows, "a", "b", "id").first()["rho"] == pytest.approx(whole.agg(F.corr("x", "y")).first()[0])
    assert mt.spearman(rows.where("id = 3"), "a", "b", "id", ("k",)).first()["rho"] is None
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and "row_number" not in plan
