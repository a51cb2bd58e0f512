"""Text and score expressions on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from mnemo.functions import score as S
from mnemo.functions import text as X


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_terms_and_overlap(spark):
    q = "Where IS the (blue) house, of Anna?"
    assert one(spark, X.query_terms(F.col("q")), q=q) == ["(blue)", "house,", "anna?"]
    assert one(spark, X.content_terms(F.col("q")), q=q) == ["blue", "house", "anna"]
    overlap = X.term_overlap(X.content_terms(F.col("q")), F.col("c"))
    assert one(spark, overlap, q=q, c="A BLUE housekeeper") == pytest.approx(2 / 3)
    assert one(spark, overlap, q="the of", c="x") == 0


def test_graded_relevance(spark):
    grade = X.graded_relevance(F.col("q"), F.col("c"))
    assert one(spark, grade, q="bundle the apples", c="bundling pears") == 0.5
    assert one(spark, grade, q="the of", c="x") == 0.5
    assert one(spark, grade, q="oil對關節有用嗎", c="這對關節有用") == 0.0
    assert one(spark, grade, q="關節", c="保護關節") == 1.0


def test_speakers_and_names(spark):
    talk = "Anna: I like tea\nBob: no\nthis is not: a name because the prefix is long\n assistant: ok"
    assert [r["speaker"] for r in one(spark, X.speaker_lines(F.col("c")), c=talk)] == ["Anna", "Bob", "this is not", "assistant"]
    assert one(spark, X.query_names(F.col("q")), q="What did Anna Smith say to The Bob?") == ["anna", "smith", "bob"]
    assert one(spark, X.person_mention(F.array(F.lit("anna")), F.col("c")), c=talk) == 0.25
    assert one(spark, X.preference_score(F.col("c")), c="I like it, I love my cat") == pytest.approx(3 / 5)


def test_windows_and_intents(spark):
    assert one(spark, X.temporal_window(F.col("q")), q="what about last week")["from_hours"] == 288
    assert one(spark, X.temporal_window(F.col("q")), q="whatever") is None
    assert one(spark, X.is_update(F.col("q")), q="now") and not one(spark, X.is_update(F.col("q")), q="now?")
    assert one(spark, X.wants_preference(F.col("q")), q="any tips?")
    prox = S.window_proximity(F.col("a"), F.lit(48), F.lit(12))
    assert one(spark, prox, a=20) == 1.0 and one(spark, prox, a=66) == 0.5


def test_cjk(spark):
    assert one(spark, X.cjk_bigrams(F.col("c")), c="我喜歡 tea 水") == ["我喜", "喜歡", "水"]
    assert set(one(spark, X.distinctive_tokens(F.col("c")), c="Roses by 2024 喜歡 ok")) == {"roses", "2024", "喜歡"}


def test_scores(spark):
    assert one(spark, S.rrf(F.lit(1))) == pytest.approx(1 / 21)
    assert one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, S.relevance_gate(F.lit(0.15))) == 0.05 and one(spark, S.relevance_gate(F.lit(0.5))) == 1.0
    assert one(spark, S.ease(F.lit(100))) == 4.0
    assert one(spark, S.hebbian(F.lit(0.5), F.lit(2))) == pytest.approx(1 - 0.5 * 0.95**2)
    full = S.composite(F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(99), F.lit("semantic"), F.lit("stm"))
    assert one(spark, full) == pytest.approx(0.8 * (0.5 * 0.45 + 0.10 + 0.30 + 0.15))
    exact = S.activation_exact(F.lit(4.0), F.array(F.lit(1.0)))
    assert one(spark, exact) == pytest.approx(1 / (1 + math.exp(-math.log(4**-0.5 + 1))))
