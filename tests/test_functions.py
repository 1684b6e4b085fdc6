import pytest
from pyspark.sql import functions as F

from lumenflow.functions import scalars as s
from lumenflow.functions import vectors as v


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("seconds", "text"), [(0, "0:00:00"), (61.9, "0:01:01"), (3725, "1:02:05"), (-5, "0:00:00"), (360000, "100:00:00")])
def test_timecode(spark, seconds, text):
    assert value(spark, s.timecode(F.lit(float(seconds)))) == text


def test_topk_mean_goldens(spark):
    rows = spark.createDataFrame([([1.0, 5.0, 3.0],), ([2.0, 2.0],), ([9.0],), ([],)], "x array<double>")
    assert [r[0] for r in rows.select(v.topk_mean("x", 2)).collect()] == [4.0, 2.0, 9.0, None]
    assert [r[0] for r in rows.select(v.topk_mean("x", 1)).collect()] == [5.0, 2.0, 9.0, None]
    assert [r[0] for r in rows.select(v.topk_mean("x", 99)).collect()] == [3.0, 2.0, 9.0, None]
    assert [r[0] for r in rows.select(v.bottomk_mean("x", 2)).collect()] == [2.0, 2.0, 9.0, None]


def test_interval_overlap_uses_the_hull(spark):
    f = lambda *x: value(spark, v.iou(*[F.lit(float(i)) for i in x]))
    assert f(0, 10, 5, 15) == pytest.approx(5 / 15) and f(0, 1, 9, 10) == 0 and f(3, 3, 3, 3) == 0 and f(0, 10, 0, 10) == 1


def test_normalised(spark):
    assert value(spark, v.normalised(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert value(spark, v.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]


def test_maxsim(spark):
    rows = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.5], [1.0, 0.0]])], "q array<array<double>>, d array<array<double>>")
    assert rows.select(v.maxsim("q", "d")).first()[0] == 1.5


@pytest.mark.parametrize(("reply", "letter"), [("A", "A"), ("(b) yes", "B"), ("The answer is C.", "C"), ("d. none", "D"), ("nothing", ""), ("A cat, so B", "A")])
def test_answer_letters(spark, reply, letter):
    assert value(spark, s.answer_letter(F.lit(reply))) == letter


def test_sentences_and_windows(spark):
    text = "This is a sentence that is long enough. Short. Another sentence that is long enough! Is this one a question, too?"
    parts = value(spark, s.sentences(F.lit(text)))
    assert parts == ["This is a sentence that is long enough. Short.", "Another sentence that is long enough!", "Is this one a question, too?"]
    assert value(spark, s.windows(F.array(*[F.lit(c) for c in "abcde"]), 3, 2)) == ["a b c", "c d e"]
    assert value(spark, s.windows(F.array(F.lit("a")), 3, 2)) == ["a"]
    assert value(spark, s.token_windows(F.lit("a b c d e"), 3, 1)) == ["a b c", "c d e"]
    assert value(spark, s.token_windows(F.lit("  "), 3, 1)) == [] and value(spark, s.sentences(F.lit(""))) == []


def test_small_ones(spark):
    assert value(spark, s.rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=1e-3)
    assert value(spark, s.rate(F.lit("0/0"))) == 0 and value(spark, s.rate(F.lit("x"))) is None and value(spark, s.rate(F.lit("25"))) == 25
    assert value(spark, s.stem(F.lit("/a/b/film.v1.mp4"))) == "film.v1" and value(spark, s.stem(F.lit("plain"))) == "plain"
    assert value(spark, s.sidecar_name(F.lit("/a/film.mp4"), F.lit("enc"), F.lit(1.0))) == "film-enc-1fps"
    assert value(spark, s.meta_task(F.lit("Caption"))) == "caption" and value(spark, s.meta_task(F.lit("zzz"))) == "other"
    assert value(spark, s.is_question(F.lit("so? "))) and not value(spark, s.is_question(F.lit("so.")))
    assert value(spark, s.is_aggregate_question(F.lit("And How Many cats?"))) and not value(spark, s.is_aggregate_question(F.lit("Where is the cat?")))
    chunks = value(spark, s.chunks(F.lit(25.0), 10.0))
    assert [(c["t_start"], c["t_end"]) for c in chunks] == [(0, 10), (10, 20), (20, 25)] and len(value(spark, s.chunks(F.lit(0.0), 10.0))) == 1
    assert value(spark, s.log_odds(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0)))) == pytest.approx(0.6931, abs=1e-4)
    assert value(spark, s.visual_tokens(F.lit(28), F.lit(28))) == 4 and value(spark, s.visual_tokens(F.lit(99999), F.lit(99999))) == 1280


def test_sentences_keep_digits_and_lose_unicode_spaces(spark):
    text = "The part at place zero has some words. 1 is how the part at place one begins. The part at place two ends in 192.168.0.2"
    assert value(spark, s.sentences(F.lit(text))) == ["The part at place zero has some words.", "1 is how the part at place one begins.", "The part at place two ends in 192.168.0.2"]
    assert value(spark, s.sentences(F.lit(" a part with spaces of Unicode around it　"))) == ["a part with spaces of Unicode around it"]
