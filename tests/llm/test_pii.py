import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenflow.llm import pii as P

CASES = [
    ("mail john.doe@mail.example.com now", "email", "john.doe@mail.example.com", "john.doe@mail.example.com"),
    ("write john (at) mail [dot] com!", "email", "john (at) mail [dot] com", "john@mail.com"),
    ("jane doe at mail dot example dot com ok", "email", "doe at mail dot example dot com", "doe@mail.example.com"),
    ("jоhn@mаil.com", "email", "jоhn@mаil.com", "john@mail.com"),
    ("j​ohn@mail.com,", "email", "j​ohn@mail.com", "john@mail.com"),
    ("call five five five one two three four five six seven today", "phone", "five five five one two three four five six seven", "5551234567"),
    ("tel +1 (017) 555-7713.", "phone", "+1 (017) 555-7713", "+1 (017) 555-7713"),
    ("+1 five five five 123 four five six seven", "phone", "+1 five five five 123 four five six seven", "+1 555 123 4567"),
    ("at 192 dot 168 dot 1 dot 77 end", "ip", "192 dot 168 dot 1 dot 77", "192.168.1.77"),
    ("ip 8.8.8.8, yes", "ip", "8.8.8.8", "8.8.8.8"),
    ("card 4111 1111 1111 1111.", "card", "4111 1111 1111 1111", "4111 1111 1111 1111"),
    ("４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１", "4111111111111111"),
    ("ssn 123-45-6789", "ssn", "123-45-6789", "123-45-6789"),
]


@pytest.mark.parametrize(("text", "kind", "found", "value"), CASES)
def test_disguises(text, kind, found, value):
    assert [(k, text[a:b], v) for k, a, b, v in P.find(text)] == [(kind, found, value)]


@pytest.mark.parametrize("text", ["two three times", "version 2.0. and 4.0.", 'token = "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa"', "4111 1111 1111 1112", "look at the hat", "300.1.1.1", "in 1999 and 2024, 12 of 30", ""])
def test_nothing_to_find(text):
    assert P.find(text) == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab1 @.(at)dot​о５é")), max_size=40), st.integers(0, 10**6))
def test_spans_lie_in_the_source_and_map_back(prefix, seed):
    text, kind, found, value = CASES[seed % len(CASES)]
    source = prefix + "\n\n" + text
    for k, a, b, v in P.find(source):
        assert 0 <= a < b <= len(source)
    assert any(source[a:b] == found and v == value for _, a, b, v in P.find(source))


def test_offsets_of_single_characters():
    """Without deletions and with edits of equal length, every character maps to itself."""
    t = P.normalise("аеос plain ４２")
    assert t.now == "aeoc plain 42" and all(t.span(i, i + 1) == (i, i + 1) for i in range(len(t.now)))
    t = P.Text("one​two")
    t.rewrite([(3, 4, "")])
    assert t.now == "onetwo" and t.span(0, 6) == (0, 7) and t.span(3, 4) == (4, 5)


def test_the_trigger_misses_nothing(spark):
    """Every case has it, and full search of texts without it finds nothing."""
    r = random.Random(0)
    texts = [c[0] for c in CASES] + ["".join(r.choice(["a", " ", "7", ".", "dot", " at ", "@", "five ", "-", "("]) for _ in range(60)) for _ in range(2000)]
    found = {(x["doc_id"], x["start"], x["end"]) for x in P.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {(i, a, b) for i, t in enumerate(texts) for _, a, b, _ in P.find(t)}


def test_edge_cases(spark, messy, nothing):
    assert P.spans(messy).count() == 0 and P.spans(nothing).count() == 0
    rows = [(None, "x@y.com"), (1, "x@y.com"), (1, "x@y.com"), (2, None), (3, "a " * 100_000 + "z@y.com 1.2.3.4")]
    got = sorted((r["doc_id"] or 0, r["kind"], r["start"], r["found"]) for r in P.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "email", 0, "x@y.com"), (1, "email", 0, "x@y.com"), (1, "email", 0, "x@y.com"), (3, "email", 200_000, "z@y.com"), (3, "ip", 200_008, "1.2.3.4")]


ALONE = [
    ("write to jane.doe at example.com today", "jane.doe@example.com"),
    ("write to jane.doe\u00a0at\u2003example.com today", "jane.doe@example.com"),
    ("host 8[.]8[.]8[.]8 is up", "8.8.8.8"),
    ("host 8 (.) 8 (.) 8 (.) 8 is up", "8.8.8.8"),
    ("jane [\u00a0at\u00a0] example.com", "jane@example.com"),
    ("call " + "\u00a0".join("five five five one two three four five six seven".split()), "5551234567"),
    ("call \u017feven \u017fix five one two three four five six seven", "7651234567"),
    ("jane@" + " dot ".join(["a" * 60] * 5 + ["com"]), "jane@" + ".".join(["a" * 60] * 5 + ["com"])),
    (" dot ".join(["b" * 60] * 5) + "@mail.com", ".".join(["b" * 60] * 5) + "@mail.com"),
]


def test_each_disguise_in_a_text_of_its_own(spark):
    """Nothing else in the text has the trigger, and no address is too long for it."""
    texts = [t for t, _ in ALONE] + [c[0] for c in CASES]
    got = P.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["value"]) for r in got) == sorted(enumerate([v for _, v in ALONE] + [c[3] for c in CASES]))


def test_long_runs_take_linear_time():
    """A megabyte of each: what retries a run at each of its characters takes hours."""
    for run in ("-", ".", " ", "7", "_", "a", "@", "(", "\n", " at ", " dot ", "one ", "a.", "a ", "[ ", "1 ", "x at y dot ", "a@b.example ", "4-", "- at "):
        text = run * (1_000_000 // len(run))
        began = time.process_time()
        found = P.find(text + " joe@example.com")
        assert time.process_time() - began < 30, run
        assert "joe" in found[-1][3] or run in "-._7a@", run


def test_parts_of_an_address_may_be_far_apart():
    for gap in (1, 230, 100_000):
        text = "write to jane at " + "mail" * gap + " dot example" + " " * gap + "dot com today"
        (kind, start, end, value), = P.find(text)
        assert kind == "email" and text[start:end].startswith("jane at") and text[start:end].endswith("dot com") and value == "jane@" + "mail" * gap + ".example.com"
        (kind, start, end, value), = P.find("joe" + " " * gap + "(at)" + " " * gap + "example.com")
        assert (kind, start, value) == ("email", 0, "joe@example.com")
