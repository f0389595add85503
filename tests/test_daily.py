"""The daily run, and the operators around replies, pairs, evidence and audits."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import polarity
from tidemark.functions import text as tx
from tidemark.operators import aspects, grounding
from tidemark.operators.daily import daily

DOCUMENTS = "ticker string, doc_type string, doc_date date, title string, text string, source string, source_url string, segments array<struct<speaker:string,text:string>>"


def test_the_second_daily_run_adds_nothing(spark, tmp_path):
    good = "Operating margins expanded strongly this quarter. We raised our full-year guidance. Demand remains weak in Europe."
    rows = [("AAA", "news", date(2024, 5, 1), "t", good, "s", "u1", None), ("BBB", "news", date(2024, 5, 2), "t", good + " Liquidity improved.", "s", "u2", None), ("BBB", "news", date(2024, 5, 2), "t", None, "s", "u3", None)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    first = daily(docs, str(tmp_path))
    n = first.scores.count()
    assert first.stats["new"] == 2 and n > 0 and {r["ticker"] for r in first.briefs.collect()} == {"AAA", "BBB"}
    assert first.drift.count() == 3 and first.moves.count() == 0
    again = daily(docs, str(tmp_path))
    assert again.stats["new"] == 0 and again.scores.count() == n


@pytest.mark.parametrize(("text", "k"), [('x ```json\n{"k": 1}\n``` y', 1), ('so {"k": 2} end', 2), ("none", None), ("{broken", None), (None, None)])
def test_json_block(spark, text, k):
    got = spark.createDataFrame([(text,)], "t string").select(tx.json_block(F.col("t"), "k long")["k"].alias("k")).first()["k"]
    assert got == k


def test_unknown_aspects_are_not_scored(spark):
    rows = spark.createDataFrame([("Margins expanded strongly.", "margins"), ("Margins expanded.", "weather"), (None, "margins"), ("x", None)], "text string, aspect string")
    got = [(r["known"], r["label"]) for r in aspects.score_pairs(rows, "lm_directional").collect()]
    assert got == [(True, "positive"), (False, None), (True, "neutral"), (False, None)]


def test_sense_score_turns_under_negation_and_keeps_empty_texts(spark):
    chunks = spark.createDataFrame([(1, "good thing"), (2, "not good thing"), (3, ""), (4, None)], "id int, text string")
    senses = spark.createDataFrame([("good", 1, 0.5), ("good", 2, 0.2), ("good", 9, -1.0)], "word string, rank int, value double")
    got = {r["id"]: r["score"] for r in polarity.sense_score(chunks, senses, ("id",)).collect()}
    v = (0.5 + 0.5 * 0.2) / 1.5
    assert got == {1: pytest.approx(4 * v / 2 if 2 * v < 1 else 1.0), 2: pytest.approx(-4 * v / 3), 3: 0.0, 4: 0.0}


def test_evidence_retrieval_pool_and_summaries(spark):
    s = spark.createDataFrame([(1, 1, "a", 0.9, 0.5, date(2024, 1, 2), "m", "T", "x" * 30), (2, 1, "b", 0.8, 0.5, date(2024, 1, 2), "m", "T", "x" * 30), (3, 2, "a", 0.1, 0.5, date(2024, 1, 9), "m", "T", "y")],
                              "score_id int, chunk_id int, aspect string, score double, confidence double, doc_date date, model_name string, ticker string, text string")
    v = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([("a", [0.5, 0.5])], "aspect string, query_vector array<double>")
    got = {r["score_id"]: r["similarity"] for r in grounding.retrieve(s, v, q, model="m").collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0}
    assert grounding.retrieve(s, v, q, end="2024-01-05").count() == 2
    assert [r["score_id"] for r in grounding.evidence_pool(s).collect()] == [1]
    claims = spark.createDataFrame([("T", "c1", "bull", "t", "supported", [1]), ("T", "c2", "bull", "t", "rejected", [2])], "ticker string, claim_id string, side string, text string, status string, cited array<int>")
    texts = spark.createDataFrame([("T", ["c1"]), ("T", ["c1", "c2"]), ("T", []), ("U", ["c1"])], "ticker string, cited array<string>")
    assert sorted((r["ticker"], len(r["cited"]), r["accepted"]) for r in grounding.accept_summary(texts, claims).collect()) == [("T", 0, False), ("T", 1, True), ("T", 2, False), ("U", 1, False)]
    sheet = grounding.audit_export(claims, s)
    assert sheet.count() == 2 and sheet.where("evidence IS NULL").count() == 0 and grounding.audit_export(claims, s, n=1).count() == 1
