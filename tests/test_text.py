"""Text functions against plain Python and fixed expectations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import polarity
from tidemark.functions import text as tx
from tidemark.operators import aspects


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_sentences_keep_abbreviations_together(spark):
    got = one(spark, "Mr. Smith joined Acme Inc. Then he left! \"Why?\" She asked.\nA new line", tx.sentences)
    assert got == ["Mr. Smith joined Acme Inc. Then he left!", '"Why?', "She asked.", "A new line"]


@pytest.mark.parametrize(
    ("text", "mask"),
    [
        ("we do not expect any material big impact", [0, 0, 0, 1, 1, 1, 1, 0]),
        ("not good, bad", [0, 1, 0, 0]),
        ("never not a b c d e", [0, 0, 1, 1, 1, 1, 0]),
        ("", []),
    ],
)
def test_negation_reaches_four_tokens(spark, text, mask):
    assert one(spark, text, lambda t: tx.negated(tx.tokens(t))) == [bool(x) for x in mask]


def test_numbers_and_words(spark):
    assert set(one(spark, "Revenue grew 12% to 1,200.5 million", tx.numbers)) == {"12", "1200.5"}
    assert one(spark, "Demand held up, but orders declined; costs fell", tx.clauses) == ["Demand held up", "orders declined", "costs fell"]
    assert one(spark, "margins were strong", tx.flip_polarity) == "margins were weak"
    assert one(spark, "no pair here", tx.flip_polarity) is None
    assert one(spark, None, tx.tokens) is None


def test_content_hash_ignores_case_and_blanks(spark):
    assert one(spark, " A  b\nC", tx.content_hash) == one(spark, "a B c", tx.content_hash)


def test_hashed_embedding_is_normalised(spark):
    got = one(spark, "gross margin expanded", lambda t: tx.hashed_embedding(t, 64))
    assert sum(v * v for v in got.values()) == pytest.approx(1.0)
    assert one(spark, "", lambda t: tx.hashed_embedding(t, 64)) == {}


@pytest.mark.parametrize(
    ("text", "aspect", "label"),
    [
        ("Costs decreased 8% in the quarter", "margins", "positive"),
        ("Gross margin decreased 8% in the quarter", "margins", "negative"),
        ("We do not expect any material impact from litigation", "litigation", "positive"),
        ("The company has several legal matters", "litigation", "neutral"),
    ],
)
def test_directional_model(spark, text, aspect, label):
    got = one(spark, text, lambda t: polarity.predict("lm_directional", t, F.lit(aspect)))
    assert got["label"] == label
    assert sum(got["probs"].values()) == pytest.approx(1.0)


def test_model_names():
    assert polarity.resolve_model() == "lm_directional"
    assert polarity.resolve_model(serving="lm_lexicon") == "lm_lexicon"
    with pytest.raises(ValueError, match="unknown model"):
        polarity.resolve_model("nope")


def test_analyze_scores_each_aspect_of_each_clause(spark):
    df = spark.createDataFrame([(1, "Demand was strong but gross margin declined. Nothing else.")], "id long, text string")
    got = {r["aspect"]: r for r in aspects.analyze(df, "lm_directional").collect()}
    assert set(got) == {"demand", "margins"}
    assert got["demand"]["label"] == "positive" and got["margins"]["label"] == "negative"
    assert got["margins"]["trigger"] == "gross margin" and "declined" in got["margins"]["opinion_words"]
