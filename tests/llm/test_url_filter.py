import math
import random

import numpy as np

from lumenflow.llm import url_filter as U


def urls(n, seed=0):
    r = random.Random(seed)
    good = [f"https://{r.choice(['news', 'blog', 'docs', 'wiki'])}.{r.choice(['river', 'garden', 'museum', 'library'])}{r.randint(1, 99)}.example.org/{r.choice(['en', 'fr'])}/{r.randint(1, 9999)}" for _ in range(n)]
    bad = [f"http://{r.choice(['best', 'cheap', 'win'])}-{r.choice(['casino', 'pills', 'bets'])}{r.randint(1, 99)}.example.com/{r.choice(['bonus', 'offer'])}?id={r.randint(1, 9999)}" for _ in range(n // 3)]
    return good, bad


def brute(train, url, order):
    """Witten-Bell interpolation, one character at a time, from plain dictionaries."""
    counts: dict = {}
    for u in train:
        s = "\0" * order + u + "\1"
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(s[i - k : i], {}).setdefault(s[i], 0)
                counts[s[i - k : i]][s[i]] += 1
    s, total = "\0" * order + url + "\1", 0.0
    for i in range(order, len(s)):
        p = 1 / U.ALPHABET
        for k in range(order + 1):
            seen = counts.get(s[i - k : i])
            if seen:
                p = (seen.get(s[i], 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
        total += math.log(p)
    return total / (len(url) + 1)


def test_probabilities_against_brute_force():
    good, bad = urls(60)
    model = U.Filter(U.Markov([u.encode() for u in good], 3), U.Markov([u.encode() for u in bad], 3), 0.0)
    tests = [*urls(10, 1)[0], *urls(10, 1)[1], "x", "http://never.seen/§"[:18]]
    got = model.scores([u.encode() for u in tests])
    want = [brute(good, u, 3) - brute(bad, u, 3) for u in tests]
    assert np.allclose(got, want, atol=1e-9)


def test_held_out_urls(spark):
    good, bad = urls(900)
    rows = [(i, u, "x", 1.0) for i, u in enumerate(good + bad)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, score double")
    model = U.train(U.listed(pages))
    new_good, new_bad = urls(200, 9)
    # a rejected look without a listed term
    new_bad = [u.replace("casino", "kasino").replace("pills", "pilz").replace("bets", "betz") for u in new_bad]
    scores = model.scores([u.encode() for u in new_good + new_bad])
    assert (scores[: len(new_good)] >= model.cut).mean() >= 0.98
    assert (scores[len(new_good) :] < model.cut).mean() >= 0.95
    out = U.score(pages, model)
    assert out.count() == len(rows) and abs(out.where("accepted").count() - len(good)) <= 5


def test_calibration():
    assert 1 < U.calibrated(np.array([2.0, 3, 4]), np.array([0.0, 1])) < 2
    assert U.calibrated(np.array([1.0]), np.array([1.0])) <= 1.0


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "   ", "a"), (None, "HTTP://News.Example.org/1", "a"), (4, "http://news.example.org/1", "a"), (4, "http://news.example.org/1", "a"), (5, "http://x.casino.com/" + "é" * 5000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = U.train(U.listed(pages))
    out = U.score(pages, model).collect()
    assert len(out) == 7 and [r["accepted"] for r in out[:3]] == [False] * 3 and all(r["score"] is None for r in out[:3])
    assert out[3]["score"] == out[4]["score"] == out[5]["score"] and out[3]["url"] == "HTTP://News.Example.org/1"
    one = pages.where("page_id = 4")
    assert U.train(U.listed(one)) is None and U.score(one, None).where("accepted").count() == 2
    assert U.train(U.listed(pages.limit(0))) is None and U.score(pages.limit(0), model).count() == 0


def test_all_urls_count(spark, monkeypatch):
    """More URLs than were once counted, against both models in memory over all of them; the scores joined instead of broadcast."""
    good, bad = urls(24_000)
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad)], "page_id long, url string")
    side = {r["url"]: r["held"] for r in rows.selectExpr("url", f"pmod(xxhash64(url), {U.HOLD_OUT}) = 0 AS held").collect()}
    trained, held = ([sorted(u.encode() for u in set(c) if side[u] == h) for c in (good, bad)] for h in (False, True))
    assert len(trained[0]) + len(held[0]) > 20_000
    want = U.Filter(U.Markov(trained[0]), U.Markov(trained[1]), 0.0)
    model = U.train(U.listed(rows))
    tests = [u.encode() for u in [*urls(50, 5)[0], *urls(50, 5)[1], "never seen \u00a7"]]
    assert np.allclose(model.scores(tests), want.scores(tests), atol=1e-9)
    assert np.isclose(model.cut, U.calibrated(want.scores(held[0]), want.scores(held[1])), atol=1e-9)
    few = rows.limit(300)
    broadcast = sorted(U.score(few, model).collect())
    monkeypatch.setattr(U, "BROADCAST_GRAMS", 0)
    joined = sorted(U.score(few, model).collect())
    assert [r[:2] + r[3:] for r in broadcast] == [r[:2] + r[3:] for r in joined]
    assert np.allclose([r["score"] for r in broadcast], [r["score"] for r in joined], atol=1e-9)


def test_the_model_is_not_the_list(spark):
    """Labels from a table that follow the look of a URL, not a term: the model takes them up, and differs from the list both ways."""
    r = random.Random(8)
    plain = lambda: f"https://{r.choice(['news', 'blog', 'docs'])}.{r.choice(['river', 'garden', 'museum'])}.example.org/{r.choice(['poker', 'bets', 'read'])}/{r.randint(1, 9999)}"
    spam = lambda: f"http://{r.choice(['best', 'cheap', 'win'])}-{r.choice(['kasino', 'pilz', 'loot'])}{r.randint(1, 99)}.example.com/{r.choice(['bonus', 'offer'])}?id={r.randint(1, 9999)}"
    labelled = [(plain(), False) for _ in range(600)] + [(spam(), True) for _ in range(300)]
    model = U.train(spark.createDataFrame([*labelled, (None, True), ("", False), ("http://no.label", None)], "url string, rejected boolean"))
    kasino = "http://best-kasino7.example.com/bonus?id=1"
    poker = "https://news.poker.example.org/read/77"
    pages = spark.createDataFrame([(1, kasino), (2, poker), (3, "http://alphabets.example.org/")], "page_id long, url string")
    accepted = {x["page_id"]: x["accepted"] for x in U.score(pages, model).collect()}
    on_list = [x["rejected"] for x in U.listed(pages).collect()]
    assert on_list == [False, True, False] and not accepted[1] and accepted[2]
