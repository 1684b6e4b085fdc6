import numpy as np

from lumenflow.llm import quality_classifier as Q

from .conftest import SCHEMA, clashing, words


def text(i, grade):
    w = words(i, 60)
    if grade == 0:
        return " ".join(x + "&&&" for x in w)
    return " ".join(w[:30] + (["sneer", "jeer"] * 3 if grade == 1 else []) + w[30:])


def test_held_out_accuracy_and_order(spark):
    rows = [(i, text(i, i % 3), "en", "s") for i in range(900)]
    docs = spark.createDataFrame(clashing(rows), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 1)) for i in range(0, 450)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, Q.grades(labels))
    assert np.all(np.diff(model.thresholds) > 0)
    got = {r["doc_id"]: r for r in Q.score(docs, model).collect()}
    assert sum(round(got[i]["expected_grade"]) == i % 3 for i in range(450, 900)) >= 0.95 * 450
    assert all(got[i]["selected"] == (i % 3 > 0) for i in range(450, 900))
    means = [np.mean([got[i]["expected_grade"] for i in range(k, 900, 3)]) for k in range(3)]
    assert means == sorted(means)


def test_gradient_reaches_the_best_thresholds():
    """Without features, the fitted thresholds are the logits of the cumulative shares."""
    y = np.repeat([0, 1, 2], [20, 30, 50])
    m = Q.fit(y, np.zeros(101, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), 3, 400)
    assert np.allclose(m.thresholds, [np.log(0.2 / 0.8), 0.0], atol=0.02)


def test_features_have_length_one():
    import pyarrow as pa

    first, _, value = Q.features(pa.array(["One two TWO 22 !!", "", "x " * 5000], pa.large_string()))
    sums = [float((value[a:b] ** 2).sum()) for a, b in zip(first[:-1], first[1:])]
    assert np.allclose(sums, [2, 0, 2], atol=1e-4)


def test_edge_cases(spark, messy, nothing):
    odd = spark.createDataFrame([(5, 1, None), (5, None, 1), (4, 1, 0), (4, 0, 0), (None, 1, 1), (6, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in Q.grades(odd).collect()} == {4: 0, 6: 1, 1: 2}
    model = Q.train(messy, Q.grades(odd))
    rows = Q.score(messy, model).collect()
    assert len(rows) == messy.count()
    assert all(not r["selected"] and r["expected_grade"] is None for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(r["expected_grade"] is not None for r in rows if r["doc_id"] in (4, 5, 6, 7, 8))
    assert Q.train(messy, Q.grades(odd.limit(0))) is None
    bare = Q.score(messy, None).collect()
    assert sum(r["selected"] for r in bare) == 8 and all(r["tail_probability"] is None for r in bare)
    assert Q.score(nothing, model).count() == 0 and Q.train(nothing, Q.grades(odd)) is None
