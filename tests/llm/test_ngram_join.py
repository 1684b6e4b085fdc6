import collections
import itertools
import random
import re

from lumenflow.llm import ngram_join as J

from .conftest import clashing, SCHEMA, words


def grams(text):
    w = re.findall(r"[a-z0-9_\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def corpus():
    r = random.Random(3)
    rows, i = [], 0
    for base in range(25):
        text = words(base, r.randint(30, 200))
        for rate in (0, 0, 0.01, 0.03, 0.06, 0.1):
            rows.append((i, " ".join(w if r.random() > rate else f"z{r.randint(0, 999)}" for w in text), "en", "s"))
            i += 1
    return rows + [(i + k, " ".join(words(1000 + k, 50)), "en", "s") for k in range(60)]


def found_pairs(docs):
    """All pairs of ids, copies expanded, and the join's rows."""
    sketch, reps, pairs = J.jaccard_pairs(docs)
    of = {}
    for r in sketch.collect():
        of.setdefault(r["node"], set()).add(r["id"])
    out = {}
    for r in pairs.collect():
        for a, b in itertools.product(of[r["a"]], of[r["b"]]):
            out[min(a, b), max(a, b)] = r["jaccard"]
    for ids in of.values():
        out |= {p: 1.0 for p in itertools.combinations(sorted(ids), 2)}
    return out


def classes(pairs):
    root = {i: i for p in pairs for i in p}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_bands_reach_the_recall():
    for t, recall in ((0.5, 0.9), (0.6, 0.95), (0.8, 0.99)):
        bands, rows = J.choose_bands(t, recall)
        assert 1 - (1 - t**rows) ** bands >= recall and bands * rows <= J.MAX_HASHES


def test_all_pairs_against_brute_force(spark):
    rows = corpus()
    sets = {i: grams(t) for i, t, *_ in rows}
    truth = {(a, b): jaccard(sets[a], sets[b]) for a, b in itertools.combinations(sets, 2)}
    truth = {k: v for k, v in truth.items() if v >= J.THRESHOLD}
    docs = spark.createDataFrame(clashing(rows), SCHEMA)
    found = found_pairs(docs)
    assert set(found) <= set(truth)
    assert all(abs(found[k] - truth[k]) < 1e-9 for k in found)
    assert len(found) >= 0.9 * len(truth) and len(truth) > 100
    joined = {r["doc_id"]: r for r in J.jaccard_join(docs).collect()}
    assert {i: r["class_id"] for i, r in joined.items()} == classes(found)
    assert {i: r["links"] for i, r in joined.items()} == collections.Counter(i for p in found for i in p)
    for i, r in joined.items():
        same = [j for j in sets if sets[j] == sets[i]]
        assert (r["copy_of"], r["copies"]) == (min(same), len(same))


def test_parts_of_buckets_and_hot_keys_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(clashing(corpus()), SCHEMA)
    whole, kept = sorted(map(tuple, J.jaccard_join(docs).collect())), sorted(r["doc_id"] for r in J.deduplicate(docs).collect())
    reps = J.cut(J.equal_sets(J.sketches(docs)))
    assert {tuple(r) for r in J.candidates(reps).collect()} == {tuple(r) for r in J.candidates(reps, part_docs=2).collect()}
    monkeypatch.setattr(J.with_hot, "__defaults__", ("docs", 1))
    monkeypatch.setattr(J.candidates, "__defaults__", (J.THRESHOLD, 2))
    monkeypatch.setattr(J.blocks, "__defaults__", (3,))
    assert sorted(map(tuple, J.jaccard_join(docs).collect())) == whole
    assert sorted(r["doc_id"] for r in J.deduplicate(docs).collect()) == kept


def test_stars_leave_few_pairs_and_lose_no_group(spark):
    """A thousand near copies of a text: deduplication verifies some stars, the join all pairs."""
    docs = spark.createDataFrame([(i, " ".join(words(5, 100)) + f" x{i}", "en", "s") for i in range(1000)], "doc_id long, text string, lang string, source string")
    reps = J.cut(J.equal_sets(J.sketches(docs)))
    assert J.candidates(reps).count() > 400_000 and J.stars(reps).count() < 23_000
    assert [r["doc_id"] for r in J.deduplicate(docs).collect()] == [0]


def test_one_of_each_group_stays(spark):
    rows = corpus()
    sets = {i: grams(t) for i, t, *_ in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if jaccard(sets[a], sets[b]) >= J.THRESHOLD and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    kept = {r["doc_id"] for r in J.deduplicate(spark.createDataFrame(clashing(rows), SCHEMA)).collect()}
    assert set(root.values()) <= kept and set(range(150, 210)) <= kept  # of each group the least, all that is unrelated
    assert len(kept - set(root.values())) <= 3  # the search may miss a few


def test_tiles_find_what_one_block_finds(spark):
    docs = spark.createDataFrame([(i, " ".join(words(5, 100)[: 100 - i % 3]) + f" x{i}", "en", "s") for i in range(60)], "doc_id long, text string, lang string, source string")
    reps = J.cut(J.equal_sets(J.sketches(docs)))
    cand = J.cut(J.candidates(reps))
    assert cand.count() > 1000
    old, J.blocks.__defaults__ = J.blocks.__defaults__, (4,)
    try:
        tiled = {tuple(r) for r in J.verified(docs, reps, cand).collect()}
    finally:
        J.blocks.__defaults__ = old
    assert tiled == {tuple(r) for r in J.verified(docs, reps, cand).collect()} and tiled


def test_buffers_end_between_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BUFFER_BYTES", 1)
    docs = spark.createDataFrame([(i, " ".join(words(i // 5, 50)) + f" x{i}", "en", "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert len(found_pairs(docs)) >= 390
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in J.components(edges).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_components_settle_in_one_task_or_in_rounds(spark, monkeypatch):
    """Few edges take no rounds, each of which plans a dozen exchanges in the driver; many give the same."""
    r = random.Random(11)
    pairs = [(r.randrange(900), r.randrange(900)) for _ in range(500)] + [(1000 + i, 1001 + i) for i in range(60)] + [(-7, 3000), (3000, -7), (5, 5)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    cuts, cut = [], J.cut
    monkeypatch.setattr(J, "cut", lambda df: cuts.append(1) or cut(df))
    truth = classes([p for p in pairs if p[0] != p[1]])
    assert sorted(map(tuple, J.components(edges).collect())) == sorted(truth.items())
    assert len(cuts) == 2
    for task_edges in (0, 7, 50):
        cuts.clear()
        assert sorted(map(tuple, J.components(edges, task_edges).collect())) == sorted(truth.items())
        assert len(cuts) > 2
    assert J.components(edges.limit(0)).count() == J.components(edges.limit(0), 0).count() == 0


def test_edge_cases(spark, messy, nothing):
    rows = J.jaccard_join(messy).collect()
    assert rows == []  # repeated rows of an id are one document, and no two documents here are near
    kept = J.deduplicate(messy)
    assert kept.columns == messy.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert [i for null, i in ids if not null] == [1, 2, 3, 4, 5, 6, 7, 8] and sum(null for null, _ in ids) == 2
    assert J.jaccard_join(nothing).count() == 0 and J.deduplicate(nothing).count() == 0
