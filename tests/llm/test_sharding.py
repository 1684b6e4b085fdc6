import hashlib

from lumenflow.llm import sharding as S

from .conftest import SCHEMA, clashing, words


def bits(i):
    return bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60)


def brute(rows, limit):
    def split(prefix, docs):
        if sum(n for _, n in docs) <= limit or len(prefix) == 60:
            return {i: (prefix, sum(n for _, n in docs)) for i, _ in docs}
        return {k: v for b in "01" for k, v in split(prefix + b, [d for d in docs if bits(d[0])[len(prefix)] == b]).items()}

    return split("", [(i, len((t or "").encode())) for i, t, *_ in rows])


def test_against_brute_force(spark):
    rows = [(i, " ".join(words(i, i % 70)), "en", "s") for i in range(900)]
    df = spark.createDataFrame(clashing(rows), SCHEMA)
    for limit in (10**9, 5000, 700, 300):
        got = {r["doc_id"]: (r["shard_id"], r["shard_bytes"]) for r in S.assign(df, limit).collect()}
        assert got == brute(rows, limit)


def test_skew_splits_deeper(spark, monkeypatch):
    monkeypatch.setattr(S, "SLACK_BITS", 0)
    monkeypatch.setattr(S, "ROUND_BITS", 2)
    rows = [(i, "x" * (2000 if i < 3 else 5), "en", "s") for i in range(300)]
    got = {r["doc_id"]: (r["shard_id"], r["shard_bytes"]) for r in S.assign(spark.createDataFrame(clashing(rows), SCHEMA), 2100).collect()}
    assert got == brute(rows, 2100) and max(b for _, b in got.values()) <= 2100


def test_one_document_above_the_limit(spark):
    got = {r["doc_id"]: r for r in S.assign(spark.createDataFrame(clashing([(1, "x" * 500, "en", "s"), (2, "y", "en", "s")]), SCHEMA), 100).collect()}
    assert len(got[1]["shard_id"]) == 60 and got[1]["shard_bytes"] == 500 and got[2]["shard_bytes"] == 1


def test_edge_cases(messy, nothing, tmp_path, spark):
    out = S.assign(messy, 1000)
    assert set(out.columns) == {*messy.columns, "shard_bytes"} and out.count() == messy.count()
    assert out.where("shard_id is null").count() == 0
    by_id = out.where("doc_id is not null").groupBy("doc_id").agg(S.F.count_distinct("shard_id").alias("n"))
    assert by_id.where("n > 1").count() == 0
    assert S.assign(nothing).count() == 0
    S.write(messy.select("doc_id", "text"), str(tmp_path / "shards"), 1000)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == messy.count()
