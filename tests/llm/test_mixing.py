import hashlib

from lumenflow.llm import mixing as M

from .conftest import SCHEMA, clashing, words

WEIGHTS = {"s1": 3.0, "s2": 1.0, "s0": 0.0}


def brute(rows, weights, default, share, seed):
    entries = {}
    for i, t, _, s in rows:
        entries[s, i] = entries.get((s, i), 0) + len((t or "").split())
    queue = []
    for (s, i), n in entries.items():
        w = weights.get(s, default) if s is not None else default
        if w > 0:
            queue.append((s, hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i, n, w))
    queue.sort(key=lambda e: (e[0] or "", e[1], -1 if e[2] is None else e[2]))
    run, timed = {}, []
    for s, h, i, n, w in queue:
        run[s] = run.get(s, 0) + n
        timed.append((run[s] / w, h, -1 if i is None else i, s or "", n))
    budget, total, out = int(sum(e[3] for e in queue) * share), 0, []
    for finish, h, i, s, n in sorted(timed):
        total += n
        if total <= budget:
            out.append((i, s, n, round(finish, 6), total))
    return sorted(out)


def test_against_brute_force(spark):
    rows = [(i, " ".join(words(i, i % 90)), "en", f"s{i % 5}") for i in range(700)]
    df = spark.createDataFrame(clashing(rows), SCHEMA)
    got = sorted((r["doc_id"], r["source"], r["n_tokens"], round(r["finish_time"], 6), r["total_tokens"]) for r in M.schedule(df, WEIGHTS, 0.5, 0.6, "t").collect())
    assert got == brute(rows, WEIGHTS, 0.5, 0.6, "t")
    mixed = M.mix(df, WEIGHTS, 0.5, 0.6, "t")
    assert mixed.columns == df.columns and sorted(r["doc_id"] for r in mixed.collect()) == sorted(r[0] for r in got)


def test_shares_follow_the_weights(spark):
    rows = [(i, "a b c d e", "en", f"s{1 + i % 2}") for i in range(4000)]
    n = {r["source"]: r["n"] for r in M.schedule(spark.createDataFrame(clashing(rows), SCHEMA), WEIGHTS, 1.0, 0.5).groupBy("source").agg(M.F.sum("n_tokens").alias("n")).collect()}
    assert abs(n["s1"] / n["s2"] - 3) < 0.02


def test_edge_cases(spark, messy, nothing):
    rows = [tuple(r)[:4] for r in messy.collect()]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["source"] or "", r["n_tokens"], round(r["finish_time"], 6), r["total_tokens"]) for r in M.schedule(messy, WEIGHTS, 1.0, 1.0, "t").collect())
    assert got == brute(rows, WEIGHTS, 1.0, 1.0, "t")
    assert M.mix(messy, WEIGHTS, 1.0, 1.0).count() == len(rows)
    assert M.schedule(nothing).count() == 0 and M.mix(nothing).count() == 0
    half = M.mix(messy, {}, 1.0, 0.001)
    assert half.columns == messy.columns and half.where("doc_id = 5").count() in (0, 2)
