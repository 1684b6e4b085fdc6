import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lumenflow.llm import kernels as K
from lumenflow.llm import toxicity as X

from .conftest import SCHEMA, clashing, words

BAD = {"en": ["grub", "vile", "oafish", "crud"], "fr": ["zut", "mufle", "goujat", "butor"]}


@pytest.fixture(scope="module")
def labelled(spark):
    """Two languages, each with its own bad words; half of the documents labelled."""
    r = random.Random(2)
    rows, truth = [], {}
    for i in range(1200):
        lang = r.choice(["en", "fr"])
        w = [("" if lang == "en" else "le") + x for x in words(i, r.randint(20, 120), 300)]
        truth[i] = i % 6 == 0
        if truth[i]:
            for _ in range(r.randint(1, 6)):
                w.insert(r.randrange(len(w)), r.choice(BAD[lang]))
        rows.append((i, " ".join(w), lang, "s"))
    docs = spark.createDataFrame(clashing(rows), SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(truth[i])) for i in range(0, 1200, 2)], "doc_id long, quality int, toxic int")
    return docs, labels, truth


def test_held_out_documents(spark, labelled):
    docs, labels, truth = labelled
    found = {r["doc_id"] for r in X.score(docs, X.induce(docs, labels)).where("toxic").collect()}
    unseen = {i for i in truth if i % 2}
    bad = {i for i, t in truth.items() if t}
    assert len(found & bad) >= 0.95 * len(bad)
    assert len(found & unseen - bad) <= 0.01 * len(unseen)
    kept = {r["doc_id"] for r in X.reject(docs, labels).collect()}
    assert kept == set(truth) - found


def test_the_driver_hands_back_what_induction_took(spark, labelled, monkeypatch):
    """Freed arrays below others that live on stay with the process unless it is told to give them back."""
    docs, labels, _ = labelled
    mb = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    alive, induce, full = [], X.induce, []

    def wasteful(*args):
        lexicon = induce(*args)
        arrays = [np.ones(8000) for _ in range(3000)]  # 64 KB each
        alive.extend(arrays[::100])
        full.append(mb())
        return lexicon

    monkeypatch.setattr(X, "induce", wasteful)
    X.reject(docs, labels)
    assert mb() < full[0] - 120


def test_the_walk_finds_words_without_labels(spark):
    """A bad word that no labelled document has is induced from its company."""
    r = random.Random(5)
    rows = []
    for i in range(900):
        w = words(i, 60, 200)
        if i % 5 == 0:
            at = r.randrange(50)
            w[at:at] = ["grub", "vile", "hidden"] if i % 2 else ["grub", "vile", "oafish"]
        rows.append((i, " ".join(w), "en", "s"))
    docs = spark.createDataFrame(clashing(rows), SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 900, 2)], "doc_id long, quality int, toxic int")
    vocabulary = X.vocabulary(X.word_counts(docs))
    at = {w: int(np.searchsorted(vocabulary, X.word_ids(K.Slice(pa.array([w], pa.large_string())))[0])) for w in ("grub", "vile", "hidden", "w1", "w5")}
    polarity = X.walk(X.pair_table(docs, vocabulary), np.array([at["grub"], at["vile"]]), np.array([at["w1"]]), len(vocabulary))
    assert polarity[at["hidden"]] > polarity[at["w5"]] + 0.5


def dense(texts, window, toxic, neutral):
    """Words and their polarities by a dense matrix, word by word."""
    docs_of: dict = {}
    for t in texts:
        for w in set(t):
            docs_of[w] = docs_of.get(w, 0) + 1
    nodes = sorted(w for w, n in docs_of.items() if n >= X.MIN_DOCS)
    index = {w: k for k, w in enumerate(nodes)}
    count = np.zeros((len(nodes),) * 2)
    for t in texts:
        for i, a in enumerate(t):
            for b in t[i + 1 : i + 1 + window]:
                if a in index and b in index:
                    count[index[a], index[b]] += 1
                    if a != b:
                        count[index[b], index[a]] += 1
    degree = count.sum(axis=1) + np.diag(count)
    safe = np.maximum(degree, 1)
    least = np.minimum(safe[:, None], safe[None])
    with np.errstate(divide="ignore"):
        w = np.maximum(np.log(count * degree.sum() / np.outer(safe, safe)), 0) * count / (count + 1) * least / (least + 1)
    strength = w.sum(axis=1)
    out = []
    for seeds in (toxic, neutral):
        start = np.array([(x in seeds) / len(seeds) for x in nodes])
        at = start
        for _ in range(X.STEPS):
            at = X.RESTART * start + (1 - X.RESTART) * w @ (at / np.maximum(strength, 1e-12))
        out.append(at)
    more = X.SMOOTH * (strength / strength.sum() + X.RESTART / len(toxic))
    return nodes, count, np.log((out[0] + more) / (out[1] + more))


def number(w):
    return int(X.word_ids(K.Slice(pa.array([w], pa.large_string())))[0])


@pytest.mark.parametrize("small", [False, True])
def test_graph_and_walk_against_a_dense_matrix(spark, labelled, monkeypatch, small):
    docs, *_ = labelled
    if small:  # many merges, partial rows, tiles and rounds; parts of vectors meet by shuffle
        for name, value in (("MERGE_PAIRS", 2000), ("SIDE", 64), ("FAN_IN", 2), ("DRIVER_BYTES", 0)):
            monkeypatch.setattr(X, name, value)
    texts = [r["text"].split() for r in docs.collect()]
    toxic, neutral = ["grub", "zut"], ["w1", "w2", "lew1"]
    nodes, count, truth = dense(texts, X.WINDOW, toxic, neutral)
    counts = X.word_counts(docs)
    assert {r["h"]: r["n"] for r in counts.collect()} == {number(w): sum(w in t for t in map(set, texts)) for w in nodes}
    vocabulary = X.vocabulary(counts)
    place = {w: int(np.searchsorted(vocabulary, np.uint64(number(w)))) for w in nodes}
    rows = X.pair_table(docs, vocabulary)
    got, tiles = np.zeros((len(nodes),) * 2), X.Tiles(len(nodes))
    for i, j, a, b, n in (e for part in rows.toArrow().to_batches() for e in tiles.edges(part)):
        assert not got[i + a, j + b].any()
        got[i + a, j + b] = n
        got[j + b, i + a] = n
    order = [place[w] for w in nodes]
    assert (got[np.ix_(order, order)] == count).all()
    walked = X.walk(rows, np.array([place[w] for w in toxic]), np.array([place[w] for w in neutral]), len(nodes))
    assert np.abs(walked[order] - truth).max() < 1e-9
    if not small:  # by joins
        seeds = spark.createDataFrame([(number(w), (w in toxic) / len(toxic), (w in neutral) / len(neutral)) for w in toxic + neutral], "h long, toxic double, neutral double")
        wide = {r["h"]: r["polarity"] for r in X.wide_walk(X.wide_pairs(docs, counts), seeds).collect()}
        linked = count.any(axis=1)
        assert {number(w) for w, some in zip(nodes, linked) if some} == set(wide)
        assert max(abs(wide.get(number(w), 0.0) - p) for w, p in zip(nodes, truth)) < 1e-9


def test_the_walk_decides(spark, labelled, monkeypatch):
    docs, labels, truth = labelled
    found = {r["doc_id"] for r in X.score(docs, X.induce(docs, labels)).where("toxic").collect()}
    wide = X.induce(docs, labels, broadcast_words=0)
    assert wide.table is not None and {r["doc_id"] for r in X.score(docs, wide).where("toxic").collect()} == found
    monkeypatch.setattr(X, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(X.induce, "__defaults__", (*X.induce.__defaults__[:-1], 0))
    assert {r["doc_id"] for r in X.reject(docs, labels).collect()} == set(truth) - found
    monkeypatch.undo()
    monkeypatch.setattr(X, "walk", lambda rows, toxic, neutral, size: np.zeros(size))
    assert X.score(docs, X.induce(docs, labels)).where("toxic").count() == 0 < len(found)


def test_edge_cases(spark, messy, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(5, 1, None), (5, 1, 1), (5, 1, 0), (None, 1, 1), (77, 0, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        kept = X.reject(messy, labels)
        assert kept.columns == messy.columns
        assert kept.where("doc_id in (1, 2, 3) or text is null").count() == 4
        assert X.score(messy, X.induce(messy, labels)).count() == messy.count()
        assert X.reject(nothing, labels).count() == 0
    assert X.reject(messy, none).count() == messy.count()
