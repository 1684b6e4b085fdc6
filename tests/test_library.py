import glob
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow import providers
from lumenflow.library import Library
from lumenflow.sources import tables
from lumenflow.streaming import stateful

from .test_frames import blocks


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    lib = Library(spark, str(tmp_path_factory.mktemp("library")), providers.HashedText(8))
    emb = blocks(100)
    rows = [(v, i, float(i), emb[i].tolist()) for v in ("a", "b") for i in range(50 if v == "b" else 100)]
    frames = spark.createDataFrame(rows, "video string, frame_idx int, ts double, emb array<float>")
    lib.index(frames, 1.0, 0.9, "overwrite")
    lib.index(frames, 1.0, 0.9)  # again: nothing is new
    enc = providers.HashedText(8)
    spans = [("a", "speech", 10.0 * k, None, t, enc.encode([t])[0].tolist(), {"model": "x"}) for k, t in enumerate(["good morning", "  ", "a red car"])]
    lib.add_text(spark.createDataFrame(spans, tables.TIMED_TEXT))
    return lib, emb


def test_round_trip(library):
    lib, emb = library
    assert lib.frames().count() == 150 and [r[0] for r in lib.videos().orderBy("video").collect()] == ["a", "b"]
    one = lib.frames("a").where("frame_idx = 7").first()
    assert np.allclose(one["emb"], emb[7]) and lib.sources() == ["visual", "speech"]
    assert {r["video"]: r["n_frames"] for r in lib.stats().collect()} == {"a": 100, "b": 50}


def test_search_reads_one_video(library):
    lib, _ = library
    plan = lib.frames("a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(video" in plan


def test_search(library):
    lib, emb = library
    out = lib.search("a", emb[42].tolist(), 5, "visual", "topk").hits.orderBy("rank").collect()
    assert out[0]["time"] == 42.0 and out[0]["timecode"] == "0:00:42" and len(out) == 5
    both = lib.search("a", "a red car", 4)
    assert both.hits.where("source like '%speech%' and text = 'a red car'").count() == 1
    with pytest.raises(ValueError, match="no expert scores"):
        both.above(0)
    with pytest.raises(ValueError, match="at least 1"):
        lib.search("a", "x", 0)
    with pytest.raises(ValueError, match="unknown strategy"):
        lib.search("a", "x", 3, "visual", "nope")
    assert json.loads(both.top(1).to_json().first()[0])["rank"] == 1
    hits = lib.search_all(emb[10].tolist(), 3, min_gap_s=0, per_video=1).collect()
    assert {(r["video"], r["ts"]) for r in hits} == {("a", 10.0), ("b", 10.0)}


def test_dimension_check(spark, library):
    lib, _ = library
    with pytest.raises(ValueError, match="3 dimensions"):
        lib.search("a", [1.0, 2.0, 3.0])
    with pytest.raises(Exception, match="dimensions, not 9"):
        tables.checked_dimension(lib.frames(), 9).collect()


def test_loaders(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"qry_text": "a dog", "src_video_path": "x/v1.mp4", "task": "action", "answering_time_interval": [[1, 2], [5.5, 6]]}]))
    videos = spark.createDataFrame([("v2", "/v2.mp4")], "video string, path string")
    q = tables.moment_queries(spark, str(tmp_path / "q.json"), videos).first()
    assert q["video"] == "v1" and q["path"] is None and q["truths"][1]["a"] == 5.5
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(x) for x in (
        {"input": "What? Step 1: one. ки Step 2: two. ки", "label": "What? Step 1: one. + Step 2: two. +"},
        {"input": "What? Step 1: one. ки Step 2: bad. ки", "label": "What? Step 1: one. + Step 2: bad. -"},
        {"input": "Alone? Step 1: one. ки", "label": "Alone? Step 1: one. +"})))
    s = tables.step_solutions(spark, str(tmp_path / "s.jsonl")).orderBy("n_bad").collect()
    assert [(r["problem"], r["steps"][0], r["tags"], r["correct"], r["n_bad"]) for r in s] == [("What?", "Step 1: one.", ["+", "+"], True, 0), ("What?", "Step 1: one.", ["+", "-"], False, 1)]
    (tmp_path / "spec.json").write_text(json.dumps({"queries": [{"id": "1", "question": "is it?", "caption": "it", "expect": "x"}]}))
    asked = spark.createDataFrame([("is it?",), ("other",)], "question string")
    assert sorted(r["caption"] for r in tables.captions(asked, tables.query_specs(spark, str(tmp_path / "spec.json"))).collect()) == ["it", "other"]
    np.savez(tmp_path / "old.npz", ts=np.arange(3), emb=np.eye(3))
    assert tables.from_npz(spark, str(tmp_path / "old.npz"), "o").count() == 3


def test_providers(spark):
    df = spark.createDataFrame([("red car",), ("RED car",), (None,)], "text string")
    out = [r[0] for r in df.select(providers.embed_text(providers.HashedText, F.col("text"))).collect()]
    assert out[0] == out[1] and sum(x * x for x in out[0]) == pytest.approx(1, abs=1e-5) and not any(out[2])
    with pytest.raises(LookupError, match="no expert provider"):
        providers.get("expert", "none")


def run_stream(spark, rows, schema, build, tmp_path, batches):
    """Feed the rows as files, one batch each, and collect what comes out."""
    src = tmp_path / "in"
    for k in range(batches):
        part = rows[k * len(rows) // batches : (k + 1) * len(rows) // batches]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    q = build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert glob.glob(str(tmp_path / "out" / "*.parquet"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_streamed_segments_equal_batch_segments(spark, tmp_path):
    from lumenflow.operators.frames import greedy_segments

    emb = blocks(60)
    rows = [("v", i, float(i), e.tolist()) for i, e in enumerate(emb)]
    schema = "video string, frame_idx int, ts double, emb array<float>"
    got = run_stream(spark, rows, schema, lambda s: stateful.greedy_segments(s, 0.9), tmp_path, 3)
    want = greedy_segments(spark.createDataFrame(rows, schema), 0.9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streamed_gate(spark, tmp_path):
    rows = [("v", i, float(i), float(x)) for i, x in enumerate([0, 1, 2, 6, 7, 1, 1, 9])]
    got = run_stream(spark, rows, "video string, frame_idx long, ts double, x double", lambda s: stateful.gated(s, "x", 5.0), tmp_path, 2)
    assert sorted(r["frame_idx"] for r in got.collect()) == [0, 3, 5, 7]


def test_streamed_events(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [("v", "q", t0 + timedelta(seconds=s), x) for s, x in ((0, 1.0), (2, 3.0), (4, -1.0), (5, 1.0), (60, 2.0), (600, 1.0), (9000, -1.0))]
    got = run_stream(spark, rows, "video string, query_id string, time timestamp, score double", lambda s: stateful.events(s, 0.0, "3 seconds", "10 seconds"), tmp_path, 4)
    ends = sorted(((r["t_start"] - t0).seconds, (r["t_end"] - t0).seconds, r["n_frames"], r["peak"]) for r in got.collect())
    assert ends[:2] == [(0, 5, 3, 3.0), (60, 60, 1, 2.0)]
