"""Ties that the last bits of sums decided, and plans that grew faster than their input."""

from __future__ import annotations

import itertools
import time
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import polarity, valence
from tidemark.operators import aspects, signals, textbayes, wordvectors
from tidemark.plans.adapters import SYLLABLES
from tidemark.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


def test_equally_strong_clauses_go_by_position(spark):
    # in tenths 8 + 8 + 8 - 8 both, but the second sum of doubles ends in another bit
    first, second = "that of the the the", "that the the the of"
    chunks = spark.createDataFrame([(1, f"{first}; {second}"), (2, f"{second}; {first}")], "chunk_id int, text string")
    got = aspects.score_sentences(aspects.mentions(chunks, SYLLABLES), "lm_directional", SYLLABLES).where("aspect = 'guidance'").collect()
    assert {r["chunk_id"]: r["clause"] for r in got} == {1: first, 2: second}


def test_means_do_not_depend_on_the_order_of_rows(spark):
    # 0.02375 exactly; sums of doubles fall on both sides of the tie
    values = [0.08, 0.0, 0.08, 0.02, 0.08, 0.07, 0.04, 0.06]
    orders = list(itertools.islice(itertools.permutations(values), 0, 40_320, 97))
    rows = [(k, i, v) for k, vs in enumerate(orders) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k int, i int, v double").repartition(3, "i")
    got = {r["m"] for r in df.groupBy("k").agg(tx.exact_mean(F.col("v") - 0.03).alias("m")).collect()}
    assert got == {0.0238}
    odd = spark.createDataFrame([(1, None), (1, 1.0), (2, float("inf")), (3, None)], "k int, v double")
    assert {r["k"]: r["m"] for r in odd.groupBy("k").agg(tx.exact_mean(F.col("v")).alias("m")).collect()}.get(1) == 1.0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sentences_are_scored_in_their_row(spark):
    texts = ["That with was not good; but that fell at the is. And this", "the", "", None, "of the don't the that, of by; that that of the; no", "Of the de and dex. With la, on the that are"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    plain = aspects.score_sentences(aspects.mentions(chunks, SYLLABLES), "lm_directional", SYLLABLES)
    got = aspects.score_chunks(chunks, "lm_directional", SYLLABLES)
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) != []
    # a shuffle of each text for each of its aspects before
    assert "Exchange" not in plan(got) and "Exchange" in plan(plain)


def without_small_tables(spark, make):
    """The plan where Spark itself takes no table for small, as none is at size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = make()
        return df.collect(), plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vectors_do_not_travel_with_the_words_of_a_key(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "the not by and by"), (1, "of"), (2, "xyz"), (3, None)], "d int, text string")
    vectors = spark.createDataFrame([("the", [1.0, 0.0]), ("by", [0.0, 2.0]), ("of", None)], "word string, vector array<float>")
    make = lambda: wordvectors.pooled_vectors(chunks, vectors, ["d"], SYLLABLES)
    rows, how = without_small_tables(spark, make)
    assert "SortMergeJoin" not in how
    monkeypatch.setattr(wordvectors, "BROADCAST", 0)
    large, how = without_small_tables(spark, make)
    assert "SortMergeJoin" in how and sorted(map(str, rows)) == sorted(map(str, large))
    assert {r["d"]: (r["n_tokens"], r["n_found"], r["vector"]) for r in rows} == {1: (6, 3, [1 / 3, -2 / 3]), 2: (1, 0, None)}


def test_words_do_not_travel_to_a_small_dictionary(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "The not by and by."), (1, "the"), (2, "xyz"), (3, None), (4, "by-law 3")], "d int, text string")
    senses = spark.createDataFrame([("The", 1, 0.25), ("by", 1, 0.5), ("and", 1, -0.25)], "word string, rank int, value double")
    make = lambda: polarity.sense_score(chunks, senses, ("d",), SYLLABLES)
    rows, how = without_small_tables(spark, make)
    assert "SortMergeJoin" not in how
    monkeypatch.setattr(polarity, "BROADCAST_WORDS", 0)
    large, how = without_small_tables(spark, make)
    assert "SortMergeJoin" in how and sorted(map(str, rows)) == sorted(map(str, large))
    # the two rows of a key count as one text of six tokens, as ever: the longer one's number
    assert {r["d"]: r["score"] for r in rows} == {1: 4 * (0.25 + 0.25 + 0.25) / 6, 2: 0.0, 3: 0.0, 4: 0.0}


def test_context_makes_each_sentence_once(spark):
    chunks = spark.createDataFrame([("a", i, f"s{i}") for i in (0, 1, 2, 5)] + [("b", 1, "t"), ("b", 1, "u"), (None, 1, "v"), ("c", None, "w")], "document_id string, idx long, text string")
    rows, how = without_small_tables(spark, lambda: signals.context(chunks, 2, F.col("idx") != 5))
    how = how.split("Initial Plan")[0]
    assert "Join" not in how and how.count("Scan") == 1
    got = sorted((r["document_id"], r["target_idx"], r["idx"], r["text"], r["is_target"]) for r in rows)
    known = [tuple(r) for r in chunks.where("document_id IS NOT NULL AND idx IS NOT NULL").collect()]
    assert got == sorted((d, i, j, t, i == j) for d, i, _ in known if i != 5 for e, j, t in known if d == e and abs(i - j) <= 2)


def test_valence_of_long_texts_is_not_quadratic(spark):
    # the place of the contrast word was looked up again at each word: twice the words, four times the work
    words = "the of by or xx der " * 40
    long = spark.createDataFrame([(words * 64,)] * 4, "t string").repartition(4)
    began = time.time()
    got = {r["s"] for r in long.select(valence.valence_score(F.col("t"), valence.of_lexicon(SYLLABLES)).alias("s")).collect()}
    assert len(got) == 1 and time.time() - began < 40


def test_clauses_with_and_without_separators(spark):
    texts = [" , a b, ", ";", "a but b", "a, but b;c", "abut but", "", " ;, ", "a\tBUT\tb", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.clauses(F.col("t"), ["but"]).alias("c")).collect()
    assert [r["c"] for r in sorted(rows)] == [["a b"], [";"], ["a", "b"], ["a", "b", "c"], ["abut"], [""], [" ;, "], ["a", "b"], None]


def test_terms_are_counted_in_their_row_and_meet_the_vocabulary_unsorted(spark, monkeypatch):
    texts = ["The sales don't rise, NOT on 3.5% or que KKa İx; it's a-b' no. 12", "", None, "no a b c d e f on , x", "the the the the", "no", "é noé a"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("label", F.when(F.col("k") % 3 == 0, "x").otherwise("y"))
    toks = tx.tokens(F.coalesce("text", F.lit("")))
    lead = F.when(F.col("k") % 2 == 0, "côst")
    got = {}
    for k, m in docs.select("k", tx.marked_tokens(toks, tx.negated(toks, SYLLABLES.cues, SYLLABLES.breaks))).collect():
        m = [*(["asp_côst"] if k % 2 == 0 else []), *m]
        got[k] = Counter([*m, *(f"{a} {b}" for a, b in zip(m, m[1:]))])
    monkeypatch.setattr(textbayes, "FLUSH", 20)
    counted = textbayes.counted_terms(docs, ["k"], aspect=lead, lexicon=SYLLABLES)
    assert "Exchange" not in plan(counted)
    assert {r["k"]: dict((t["term"], t["tf"]) for t in r["terms"]) for r in counted.collect()} == got
    monkeypatch.setattr(textbayes, "TASK_TERMS", 5)
    model = textbayes.fit(docs, ["k"], lexicon=SYLLABLES)
    assert model.size == model.table.count() > 20
    found = model.predict(docs, ["k"], lexicon=SYLLABLES)
    asked = textbayes._met(textbayes.terms(docs, ["k"], lexicon=SYLLABLES), model.table, model.size)
    assert found.count() == len(texts) and "SortMergeJoin" not in plan(asked) and asked.rdd.getNumPartitions() >= model.size / 5


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_bayes_report_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA / name}.parquet'")
    cur = con.execute(SQL["nb_tfidf_report"])
    columns = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r) for r in QUERIES["nb_tfidf_report"](spark, str(DATA)).select(*columns).collect()) == want


def test_only_clauses_with_an_aspect_are_read_for_its_words(spark):
    rows = [(1, "That is on THE way, was it not so; nothing here; de-facto no"), (2, "nothing"), (3, ""), (4, None), (5, "a this-x isn't du den à la."), (6, "This is; this")]
    chunks = spark.createDataFrame(rows, "chunk_id int, text string")
    got = aspects.mentions(chunks, SYLLABLES)
    read = [x for x in plan(got).splitlines() if "Filter" in x and "RLIKE" in x and "clause" in x]
    assert read
    rows = [(r["chunk_id"], r["clause_idx"], r["aspect"], r["trigger"], r["opinion_words"], r["negated"], r["hedge"]) for r in got.collect()]
    third = 1 / 3
    assert sorted(x for x in rows if x[0] in (1, 6)) == [
        (1, 0, "demand", "is", ["that", "on", "the", "way", "was", "it"], True, third * 2),
        (1, 0, "guidance", "That", ["is", "on", "the", "way", "was"], True, third * 2),
        (1, 2, "management_tone", "de", [], False, 0.0),
        (6, 0, "demand", "is", ["this"], False, 0.0),
        (6, 0, "guidance", "This is", [], False, 0.0),
        (6, 1, "guidance", "this", [], False, 0.0),
    ]


def test_lists_with_patterns_or_empty_terms_are_read_as_before(spark):
    df = spark.createDataFrame([("The Cat sat",), ("a dog-ear",), ("bird",), ("",), (None,)], "t string")
    terms = {"a": ["cat", "dog-ear"], "b": [], "c": ["(?:b|s)[ia]\\w+", "x"]}
    got = [r[0] and [(h["aspect"], h["trigger"]) for h in r[0]] for r in df.select(aspects.triggers(F.col("t"), terms)).collect()]
    assert got[:4] == [[("a", "Cat"), ("c", "sat")], [("a", "dog-ear")], [("c", "bird")], []]


def test_abbreviations_join_sentences_by_their_last_letters(spark):
    texts = ["Mr. A met (Dr.) B at Foo Inc. Then it ended. no. It (est.) 9 rose...", "U.S. No. 9. x No... Y", "xinc. Y. etc.", " e.g. \n\n A. b\tInc.\tB.", "", None, "No."]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.sentences(F.col("t"))).collect()]
    assert got == [["Mr. A met (Dr. B at Foo Inc. Then it ended. no. It (est. 9 rose..."], ["U.S. No. 9. x No... Y"], ["xinc.", "Y. etc."], ["e.g. A. b\tInc. B."], [], None, ["No."]]
    assert "?<!" not in plan(spark.createDataFrame([("a",)], "t string").select(tx.sentences(F.col("t"))))


def test_a_label_makes_no_table_of_probabilities(spark):
    assert "map_from_arrays" not in plan(QUERIES["lm_score"](spark, str(DATA)))


def test_words_without_cues_score_as_with_them(spark):
    texts = ["the by of", "not the by of", "the", "of not x, the", "nothing", "", None, "isn't the of of"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(polarity.counted_score(F.col("t"), None, SYLLABLES)).collect()]
    assert got == [1 / 3, -1 / 3, 0.7, 0.0, 0.0, 0.0, None, 1 / 3]
