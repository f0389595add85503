"""Valence, word vectors, entailment and adversarial cases against plain loops."""

from __future__ import annotations

import math
import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions import polarity, valence
from tidemark.functions.lexicons import FINANCE
from tidemark.operators import grounding, wordvectors

V = valence.Valences({"good": 1.9, "great": 3.1, "bad": -2.5, "loss": -1.3}, negations=("not", "no", "never", "without"), contrast=("but",))


def plain_valence(text, v=V):
    """The published rules, word by word."""
    strip = lambda t: t if len(t.strip(string.punctuation)) <= 2 else t.strip(string.punctuation)
    words = [strip(t) for t in (text or "").split()]
    low = [w.lower() for w in words]
    capitals = sum(w.isupper() for w in words)
    mixed = 0 < capitals < len(words)
    negative = lambda w: w in v.negations or "n't" in w
    values = []
    for i, w in enumerate(low):
        if w in v.boosters or w not in v.words:
            values.append(0.0)
            continue
        x = v.words[w]
        if words[i].isupper() and mixed:
            x += math.copysign(valence.CAPITALS, x)
        for d in (1, 2, 3):
            if i < d or low[i - d] in v.words:
                continue
            p = low[i - d]
            if p in v.boosters:
                s = v.boosters[p] if x >= 0 else -v.boosters[p]
                if words[i - d].isupper() and mixed:
                    s += valence.CAPITALS if x > 0 else -valence.CAPITALS
                x += s * valence.DISTANCE[d - 1]
            between = [low[i - k] for k in range(1, d)]
            if p == "never" and {"so", "this"} & set(between):
                x *= valence.NEVER_SO
            elif p == "without" and "doubt" in between:
                pass
            elif negative(p):
                x *= valence.NEGATION
        if i >= 1 and low[i - 1] == "least" and "least" not in v.words and not (i >= 2 and low[i - 2] in ("at", "very")):
            x *= valence.NEGATION
        values.append(x)
    at = next((i for i, w in enumerate(low) if w in v.contrast), None)
    if at is not None:
        values = [x * (0.5 if i < at else 1.5 if i > at else 1.0) for i, x in enumerate(values)]
    total = sum(values)
    marks, questions = min((text or "").count("!"), 4) * 0.292, (text or "").count("?")
    emphasis = marks + (0 if questions < 2 else questions * 0.18 if questions <= 3 else 0.96)
    total += math.copysign(emphasis, total) if total else 0.0
    return total / math.sqrt(total * total + 15) if total else 0.0


def test_valence_equals_the_plain_rules(spark):
    rng = random.Random(8)
    vocabulary = ["good", "GOOD", "great", "bad", "BAD", "loss.", "very", "VERY", "slightly", "not", "never", "so", "this", "without", "doubt", "but", "least", "at", "isn't", "plan", "x", "(good)", "a", "--", "quarter,"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 14))) + rng.choice(["", "!", "!!!!!!", "?", "??", "?????", " !?"]) for _ in range(1500)]
    texts += [None, "", "   ", "GOOD GREAT", "never so good", "without a doubt great", "good\n\tbad  great"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["s"] for r in df.select("i", valence.valence_score(F.col("text"), V).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_valence(t), abs=1e-9), t
    assert got[texts.index("GOOD GREAT")] == pytest.approx(5 / math.sqrt(40))  # all capitals are none


def test_valence_is_a_model_like_the_others(spark):
    df = spark.createDataFrame([("Revenue growth was strong!",), ("A severe loss.",), ("The call begins.",)], "text string")
    got = [r["p"] for r in df.select(polarity.predict("valence", F.col("text"), F.lit("demand")).alias("p")).collect()]
    assert [p["label"] for p in got] == ["positive", "negative", "neutral"]
    assert "valence" in polarity.MODELS and valence.of_lexicon(FINANCE).words


def test_vectors_from_text(spark, tmp_path):
    (tmp_path / "v.txt").write_text("good 1 0 2\nbad -1 0.5 0\nshort 1 2\nwide 1 2 3 4\nodd 1 x 3\nnan 1 nan 3\ngood 2 0 2\n")
    got = {r["word"]: r["vector"] for r in wordvectors.read_vectors(spark, f"file://{tmp_path}/v.txt", 3).collect()}
    assert got == {"good": [2.0, 0.0, 2.0], "bad": [-1.0, 0.5, 0.0]}


def test_pooled_vectors_equal_a_plain_loop(spark):
    from tidemark.functions import text as tx

    rng = random.Random(3)
    vocabulary = ["good", "Bad", "not", "plan", "never", "but", ",", "12%", "growth", "unseen"]
    chunks = [(d, i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 15)))) for d in range(20) for i in range(3)] + [(99, 0, None), (98, 0, "unseen unseen")]
    vectors = {"good": [1.0, 2.0], "bad": [-1.0, 0.5], "plan": [0.0, 3.0], "growth": [2.0, 2.0], "12%": [5.0, 5.0], "not": [0.25, 0.0]}
    df = spark.createDataFrame(chunks, "d int, i int, text string")
    got = {r["d"]: r for r in wordvectors.pooled_vectors(df, spark.createDataFrame(list(vectors.items()), "word string, vector array<float>"), ["d"]).collect()}
    toks = {(r["d"], r["i"]): list(zip(r["t"] or [], r["m"] or [])) for r in df.withColumn("t", tx.tokens(F.col("text"))).select("d", "i", "t", tx.negated(F.col("t")).alias("m")).collect()}
    for d in {c[0] for c in chunks}:
        uses = Counter((t.lower(), m and t.isalpha()) for (k, _), some in toks.items() if k == d for t, m in some)
        n = sum(k for (w, _), k in uses.items() if w in vectors)
        if d == 99:
            assert d not in got
            continue
        assert (got[d]["n_tokens"], got[d]["n_found"]) == (sum(uses.values()), n)
        want = [sum(k * (-0.5 if neg else 1) * vectors[w][x] for (w, neg), k in uses.items() if w in vectors) / n for x in (0, 1)] if n else None
        assert got[d]["vector"] == (pytest.approx(want) if n else None)


def test_entailment_decides(spark):
    def stub():
        """Entailment as the premise says it: 'e=0.7 c=0.1'."""
        return lambda premises, hypotheses: [tuple(float(x.split("=")[1]) for x in p.split()[:2]) for p in premises]

    same = "demand was strong and orders grew across regions"
    cases = {"supported": "e=0.5 c=0.1", "unverified": "e=0.49 c=0.59", "rejected": "e=0.9 c=0.6"}
    evidence = spark.createDataFrame([(i, f"{probs} {same}", -0.9) for i, probs in enumerate(cases.values())], "chunk_id long, text string, score double")
    claims = spark.createDataFrame([("T", f"c{i}", "bull", "demand", same, [i], i) for i in range(3)] + [("T", "c9", "bull", "demand", same, [77], 9), ("T", "c8", "bull", "demand", same + " by 12", [0], 8)],
                                   "ticker string, claim_id string, side string, aspect string, text string, cited array<long>, ord int")
    hook = grounding.entailment_hook(stub)
    got = {r["claim_id"]: r for r in grounding.verify(claims, evidence, entailment=hook).repartition(5).collect()}
    assert [got[f"c{i}"]["status"] for i in range(3)] == list(cases)
    assert got["c2"]["reason"] == "contradicted by cited evidence"
    # citations and numbers still come first; without the hook the scores decide
    assert got["c9"]["reason"] == "no valid citation" and got["c8"]["reason"] == "numbers not in cited text"
    assert {r["claim_id"]: r["status"] for r in grounding.verify(claims, evidence).collect()}["c0"] == "rejected"
    # a worker loads a scorer once
    assert grounding._loaded(grounding.shared_words) is grounding._loaded(grounding.shared_words)
    scorer = grounding.shared_words()
    assert scorer(["sales did not grow", "sales grew well"], ["sales did grow", "sales grew"]) == [(0.0, 1.0), (1.0, 0.0)]


def test_adversarial_cases_miss_no_row(spark):
    rows = [(i, "T", "big", 0.5, f"Sales rose by {i} percent.") for i in range(3000)] + [(5000, "T", "small", -0.5, "Costs fell by 3 percent.")]
    df = spark.createDataFrame(rows, "chunk_id long, ticker string, aspect string, score double, text string")
    kinds = Counter(r["kind"] for r in grounding.adversarial_cases(df, ["A merger.", "A buyback."]).collect())
    assert kinds["wrong_citation"] == kinds["fabrication"] == kinds["faithful"] == kinds["no_citation"] == 3001
    aspect = {r[0]: r[2] for r in rows}
    for r in grounding.adversarial_cases(df, ["A merger."]).where("kind = 'wrong_citation'").collect():
        assert aspect[r["cited"][0]] != r["aspect"]
    one = grounding.adversarial_cases(df.where("aspect = 'big'"), ["A merger."])
    assert {r["kind"] for r in one.select("kind").distinct().collect()} == {"faithful", "number_swap", "no_citation"} | ({"polarity_flip"} if one.where("kind = 'polarity_flip'").count() else set())
    assert grounding.adversarial_cases(df.limit(0), ["A merger."]).count() == 0
