import random

import numpy as np
import pyarrow as pa

from lumenflow.llm import decontaminate as D

from .conftest import SCHEMA, clashing, words


def levenshtein(a, b):
    """Least edits of a to any part of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        now = [row[0] + 1]
        for j, y in enumerate(b):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[j] + 1))
        row = now
    return min(row)


def edited(w, n, r):
    w = list(w)
    for _ in range(n):
        at, kind = r.randrange(len(w)), r.randrange(3)
        if kind == 0:
            w[at] = f"e{r.randrange(999)}"
        elif kind == 1:
            w.insert(at, f"e{r.randrange(999)}")
        elif len(w) > 1:
            del w[at]
    return w


def test_recall_at_every_distance(spark):
    r = random.Random(1)
    items = {i: words(i, (6, 12, 20, 35, 60, 150)[i % 6], 3000) for i in range(60)}
    docs, planted = [], {}
    for k in range(480):
        item = r.randrange(60)
        most = int(D.MAX_EDIT * len(items[item]) + 1e-9)
        n = r.randint(0, most)
        planted[k] = item, n, most
        docs.append((k, " ".join(words(5000 + k, r.randint(0, 90), 3000) + edited(items[item], n, r) + words(9000 + k, r.randint(0, 90), 3000)), "en", "s"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]): x["edits"] for x in D.contaminated(spark.createDataFrame(clashing(docs), SCHEMA), bench).collect()}
    assert all((k, item) in found for k, (item, n, _) in planted.items() if n == 0)  # every exact passage
    assert sum((k, item) in found for k, (item, *_) in planted.items()) >= 0.95 * len(planted)
    hardest = [(k, item) for k, (item, n, most) in planted.items() if n == most and most]
    assert sum(x in found for x in hardest) >= 0.9 * len(hardest)
    for (k, item), edits in list(found.items())[:60]:
        assert edits == levenshtein(items[item], docs[k][1].split()) <= D.MAX_EDIT * len(items[item])


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(k, " ".join(words(k + 100, 200))) for k in range(100)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(words(9999 + i, 30))) for i in range(20)], "item_id long, text string")
    assert D.decontaminate(docs, bench).count() == 100


def test_exact_placement():
    r = np.random.default_rng(0)
    for _ in range(100):
        item, text = r.integers(1, 6, 8).astype(np.uint64), r.integers(1, 6, 40).astype(np.uint64)
        edits, _ = D.best_placement(item, text, np.array([0]), np.array([40]), 8)
        assert edits[0] == levenshtein(item.tolist(), text.tolist())


def test_several_passes_are_one_result(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(words(k, 40))) for k in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(words(k, 40)[5:30])) for k in range(30)], "item_id long, text string")
    once = {tuple(r) for r in D.contaminated(docs, bench).collect()}
    monkeypatch.setattr(D, "PASS_WORDS", 60)
    assert len(D.searches(bench, D.MAX_EDIT)) > 3
    assert {tuple(r) for r in D.contaminated(docs, bench).collect()} == once and len(once) >= 30


def test_edge_cases(spark, messy, nothing):
    w = words(1, 80)
    bench = spark.createDataFrame([(1, " ".join(w[20:50]), "x"), (1, " ".join(w[20:50]), "x"), (2, " ".join(w[20:50]), "x"), (3, None, "x"), (4, "", "x"), (5, "word", "x"), (None, "w1 w2 w3 w4 w5 w6", "x")], "item_id long, text string, edits string")
    found = sorted((r["doc_id"], r["item_id"], r["position"], r["edits"]) for r in D.contaminated(messy, bench).collect())
    assert found == [(5, 1, 20, 0), (5, 2, 20, 0), (6, 5, 0, 0)]
    kept = D.decontaminate(messy, bench)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 3
    empty = bench.limit(0)
    assert D.decontaminate(messy, empty).count() == messy.count() and D.contaminated(messy, empty).count() == 0
    assert D.contaminated(nothing, bench).count() == 0 and D.decontaminate(nothing, bench).count() == 0


def test_whole_texts(spark):
    item = words(7, 40)
    text = " ".join(words(1, 50_000, 9000) + item)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    row = D.contaminated(docs, bench).first()
    assert row["position"] == 50_000 and row["edits"] == 0
    assert pa.array([text])  # beyond one slice


def test_items_of_one_to_four_words(spark):
    """No edit is allowed: their words in a row, wherever; against a plain search."""
    items = {n * 10 + k: words(n * 10 + k, n, 60) for n in (1, 2, 3, 4) for k in range(3)}
    docs = [(i, " ".join(words(100 + i, 30, 60))) for i in range(80)] + [(80, " ".join(items[40])), (81, ""), (82, " ".join(items[42][:3]))]
    truth = {}
    for i, text in docs:
        w = text.split()
        for item, own in items.items():
            at = [k for k in range(len(w) - len(own) + 1) if w[k : k + len(own)] == own]
            if at:
                truth[i, item] = at[0], 0
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["position"], r["edits"]) for r in D.contaminated(frame, bench).collect()}
    assert found == truth and {len(items[i]) for _, i in found} == {1, 2, 3, 4}
    assert {r["doc_id"] for r in D.decontaminate(frame, bench).collect()} == {i for i, _ in docs} - {i for i, _ in truth}


def test_tables_follow_from_the_recall():
    assert [D.tables_for(18, 4, 0.2, r) for r in (0.7, 0.9, 0.95)] == sorted({D.tables_for(18, 4, 0.2, r) for r in (0.7, 0.9, 0.95)})
    assert D.tables_for(18, 4, 0.0) == 1
