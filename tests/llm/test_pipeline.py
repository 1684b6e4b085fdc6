import random

import corpus_pipeline as C
from lumenflow.llm import decontaminate, kernels, mixing, queries, sharding

from .conftest import SCHEMA, clashing, words
from .test_mixing import brute as brute_mix
from .test_ngram_join import grams, jaccard
from .test_sharding import brute as brute_shards


def planted(spark, folder):
    r = random.Random(4)
    rows, toxic, copies, leaks = [], set(), {}, set()
    bench = [(i, " ".join(words(7000 + i, 30))) for i in range(10)]
    for i in range(700):
        w = words(i, r.randint(60, 160), 500)
        if i % 9 == 0:
            toxic.add(i)
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["grub", "vile", "crud"]))
        elif i % 9 == 1:
            leaks.add(i)
            w = w[:40] + bench[i % 10][1].split() + w[40:]
        rows.append((i, " ".join(w), "en", f"src{i % 4}"))
    for k in range(700, 800):
        base = rows[r.choice([i for i in range(700) if i % 9 > 1])]
        w = base[1].split()
        if k % 2:
            w[5] = "edit"
        copies[k] = base[0]
        rows.append((k, " ".join(w), "en", "src1"))
    spark.createDataFrame(clashing(rows), SCHEMA).drop("shard_id").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 700, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, toxic, copies, leaks


def test_stages_on_planted_cases(spark, tmp_path):
    """Each stage alone on its input, against what was planted and against brute force."""
    rows, toxic, copies, leaks = planted(spark, str(tmp_path))
    assert [n for n, _ in C.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids, seen = docs.columns, [], docs
    for k, (_, stage) in enumerate(C.STAGES):
        before = [(x["doc_id"], x["text"], None, x["source"]) for x in seen.collect()]
        stage(spark, seen, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        seen = spark.read.parquet(str(tmp_path / f"out{k}"))
        ids.append({x["doc_id"] for x in seen.collect()})
        assert k == 4 or seen.columns == columns
        if k == 3:
            assert ids[3] == {e[0] for e in brute_mix(before, mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, mixing.BUDGET_SHARE, mixing.SEED)}
        if k == 4:
            got = {x["doc_id"]: (x["shard_id"], x["shard_bytes"]) for x in seen.collect()}
            assert got == brute_shards(before, sharding.LIMIT_BYTES)
    assert ids[0] == {r[0] for r in rows} - toxic
    assert ids[1] == ids[0] - set(copies)
    assert ids[2] == ids[1] - leaks
    text = {r[0]: grams(r[1]) for r in rows}
    assert all(jaccard(text[k], text[b]) > 0.5 for k, b in copies.items())
    assert {r["doc_id"] for r in C.run(spark, str(tmp_path)).collect()} == ids[4]


def test_empty_tables(spark, tmp_path):
    rows, *_ = planted(spark, str(tmp_path / "full"))
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(str(tmp_path / "full" / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert C.run(spark, str(tmp_path / "none")).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert kernels.SLICE_DOCS <= 1 << (64 - kernels.GRAM_BITS) and decontaminate.MAX_EDIT < 0.5
