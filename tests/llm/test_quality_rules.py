import itertools

import numpy as np
from pyspark.sql import functions as F

from lumenflow.llm import quality_rules as R

from .conftest import SCHEMA, clashing, words


def test_recovers_the_clean_part(spark):
    """Location and scatter of contaminated normal data against the clean rows' own."""
    r = np.random.default_rng(0)
    k = len(R.NAMES)
    mix = np.eye(k) + 0.3 * r.normal(size=(k, k))
    clean, bad = r.normal(size=(3000, k)) @ mix + 2, r.normal(size=(500, k)) * 0.5 + 15
    rows = spark.createDataFrame([("g", x.tolist()) for x in np.concatenate([clean, bad])], "key string, x array<double>")
    est = R.estimates(rows).first()
    truth = np.cov(clean.T, bias=True) + np.diag(np.square(R.FLOOR))
    assert np.allclose(est["mean"], clean.mean(axis=0), atol=0.1)
    scatter = np.linalg.inv(np.array(est["inverse"]).reshape(k, k))
    assert np.linalg.norm(scatter - truth) < 0.2 * np.linalg.norm(truth)
    d = np.einsum("ij,jk,ik->i", bad - est["mean"], np.array(est["inverse"]).reshape(k, k), bad - est["mean"])
    assert (d > R.chi2(R.CUTOFF, k)).all()


def test_distance_against_numpy(spark):
    k = len(R.NAMES)
    r = np.random.default_rng(1)
    a = r.normal(size=(k, k))
    inverse, mean, x = a @ a.T, r.normal(size=k), r.normal(size=k)
    df = spark.createDataFrame([(x.tolist(), mean.tolist(), inverse.ravel().tolist())], "x array<double>, mean array<double>, inverse array<double>")
    assert np.isclose(df.select(R._distance()).first()[0], (x - mean) @ inverse @ (x - mean))


def test_quantiles():
    assert abs(R.chi2(0.975, 6) - 14.449) < 0.05 and abs(R._below(5.348, 6) - 0.5) < 0.01


def test_junk_goes_clean_stays(spark):
    rows = []
    for i in range(1500):
        w = words(i, 40 + i % 150)
        junk = i % 10 == 0
        t = " ".join(x + "&&&" for x in w) if junk and i % 20 else " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)
        rows.append((i, t, ("en", "de")[i % 2], f"s{i % 3 if i % 2 else 0}"))
    kept = {r["doc_id"] for r in R.judge(spark.createDataFrame(clashing(rows), SCHEMA)).where("kept").collect()}
    assert not any(i % 10 == 0 for i in kept)
    assert len(kept) >= 0.99 * 1350


def test_small_groups_lean_on_wider_ones(spark):
    rows = [(i, " ".join(words(i, 80)), "en", "big" if i < 300 else f"small{i}") for i in range(330)] + [(1000 + i, " ".join(words(i, 80)), f"rare{i}", None) for i in range(5)]
    out = R.judge(spark.createDataFrame(clashing(rows), SCHEMA))
    assert out.count() == 335 and out.where("kept").count() >= 330


def test_counts():
    import pyarrow as pa

    c = dict(zip(R._COUNTS.names, R.counts(pa.array(["Ab 12 12 c&!", "", "  "], pa.large_string()))))
    assert {k: v.tolist() for k, v in c.items()} == {"chars": [9, 0, 0], "words": [4, 0, 0], "upper": [1, 0, 0], "digit": [4, 0, 0], "sign": [2, 0, 0], "repeated": [1, 0, 0], "distinct": [3, 0, 0]}


def test_edge_cases(messy, nothing):
    out = R.judge(messy)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert got == [(False, 4), (False, 5), (False, 5), (False, 6), (False, 7), (False, 7), (False, 8), (True, 0)]
    assert out.where(F.col("distance").isNull() | F.isnan("distance")).count() == 0
    assert R.judge(nothing).count() == 0


def test_the_scatter_decides_not_the_floor(spark):
    """Outliers of ten deviations where the spread is as small as that of real texts."""
    r = np.random.default_rng(2)
    k = len(R.NAMES)
    sd = np.array([0.03, 0.015, 0.01, 0.02, 0.03, 0.03])
    clean = r.normal(size=(1000, k)) * sd
    bad = np.concatenate([clean[:100] * 0.3 + np.eye(k)[i % k] * 10 * sd for i in range(2)])
    rows = spark.createDataFrame([("g", x.tolist()) for x in np.concatenate([clean, bad])], "key string, x array<double>")
    est = R.estimates(rows).first()
    inverse = np.array(est["inverse"]).reshape(k, k)
    d = lambda x: np.einsum("ij,jk,ik->i", x - est["mean"], inverse, x - est["mean"])
    assert (d(bad) > R.chi2(R.CUTOFF, k)).all() and (d(clean) <= R.chi2(R.CUTOFF, k)).mean() >= 0.99


def test_the_least_determinant_of_all_subsets(spark):
    """20 points, every subset of 15 of them."""
    r = np.random.default_rng(4)
    k = len(R.NAMES)
    x = np.concatenate([r.normal(size=(15, k)) * 0.05, r.normal(size=(5, k)) * 0.05 + 1])
    subsets = np.array(list(itertools.combinations(range(20), 15)))
    logdet = np.array([np.linalg.slogdet(np.cov(x[list(c)].T, bias=True))[1] for c in subsets])
    best = x[subsets[logdet.argmin()]]
    rows = R.cut(spark.createDataFrame([("g", v.tolist()) for v in x], "key string, x array<double>"))
    got = R.concentrated(rows).first()
    assert np.allclose(got["mean"], best.mean(axis=0))
    scatter = np.array(got["scatter"]).reshape(k, k) * R._below(R.chi2(R.COVERAGE, k), k + 2) / R.COVERAGE
    assert np.allclose(scatter, np.cov(best.T, bias=True))


def test_shrinking_by_hand(spark):
    k = len(R.NAMES)
    eye = lambda v: (np.eye(k) * v).ravel().tolist()
    fitted = spark.createDataFrame([("{}", 1000, [0.0] * k, eye(1.0)), ("l", 60, [1.0] * k, eye(2.0)), ("g", 20, [4.0] * k, eye(4.0))], "key string, n long, mean array<double>, scatter array<double>")
    got = R.shrunk(spark.createDataFrame([("g", "l")], "key string, wide string"), fitted, 60.0).first()
    assert np.allclose(got["mean"], 0.25 * 4 + 0.75 * 0.5)
    assert np.allclose(np.linalg.inv(np.array(got["inverse"]).reshape(k, k)), np.eye(k) * (0.25 * 4 + 0.75 * 1.5))
