import os
import random

import pytest

from lumenflow.llm import token_counts as T
from lumenflow.llm.queries import VOCABULARY


def brute(word, v):
    """Best segmentation of one pre-token by itself; among equals the longer last piece."""
    text = T.MARK + word
    best, tokens = [0.0], [0]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(end):
            if text[start:end] in v.scores:
                options.append((best[start] + v.scores[text[start:end]], end - start, tokens[start] + 1))
        c = text[end - 1]
        if c not in v.scores:
            options.append((best[end - 1] + v.least - T.UNKNOWN, 0, tokens[end - 1] + (len(c.encode()) if v.bytes else 1)))
        s, _, n = max(options)
        best.append(s)
        tokens.append(n)
    return tokens[-1]


def test_small_vocabulary_against_brute_force():
    r = random.Random(0)
    pieces = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): -r.random() * 5 for _ in range(40)} | {T.MARK: -1.0, "a": -6.0, "b": -6.5}
    v = T.Vocabulary(pieces, min(pieces.values()), True)
    vocabulary = sorted({"".join(r.choice("abcé漢") for _ in range(r.randint(0, 12))) for _ in range(600)})
    trie = T.Trie(v)
    r.shuffle(vocabulary)
    for part in range(0, 600, 150):  # over several batches
        batch = vocabulary[part : part + 150]
        assert trie.of(batch) == [brute(w, v) for w in batch]
    assert trie.nodes < sum(len(w) + 1 for w in vocabulary)  # shared prefixes were scored once


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_documents(spark, messy, nothing, monkeypatch):
    v = T.load(VOCABULARY)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in T.token_counts(messy, VOCABULARY).collect())
    seen: dict = {}
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, sum(seen.setdefault(w, brute(w, v)) for w in (r["text"] or "").split())) for r in messy.collect())
    assert got == want
    assert T.token_counts(nothing, VOCABULARY).count() == 0
    trie = T.Trie(v)
    first = trie.of(["alpha", "beta"])
    monkeypatch.setattr(T, "MAX_HELD", 1)
    assert trie.of(["gamma"]) and "alpha" not in trie.counts and trie.of(["alpha", "beta"]) == first


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_frequent_pieces_are_one_token():
    v = T.load(VOCABULARY)
    trie = T.Trie(v)
    assert trie.of(["the", "and"]) == [1, 1] and trie.of(["\U0001f642"])[0] >= 2
