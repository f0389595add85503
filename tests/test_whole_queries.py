"""Queries without SQL against brute force over all rows, and at production size."""

from __future__ import annotations

import inspect
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import evaluation, models
from tidemark.plans import adapters as ad
from tidemark.plans.queries import _L, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def test_context_of_every_sentence(spark):
    texts = {(r["document_id"], r["idx"]): r["text"] for r in ad.corpus_chunks(spark, str(DATA)).collect()}
    want = Counter((d, t, i, len(texts[d, i]), i == t) for d, t in texts for i in range(t - 3, t + 4) if (d, i) in texts)
    got = QUERIES["chunk_context"](spark, str(DATA)).select("document_id", "target_idx", "idx", "n", "is_target")
    assert Counter(tuple(r) for r in got.collect()) == want
    assert len({(d, t) for d, t, *_ in want}) == len(texts)


def found(terms, clause):
    """The earliest mention of a term between word bounds, the longest of those; \\w is ASCII, bounds are not."""
    for at in range(len(clause)):
        for term in sorted(terms, key=len, reverse=True):
            stem = term.rstrip("*")
            if clause[at : at + len(stem)].lower() == stem and not (at and (clause[at - 1].isalnum() or clause[at - 1] == "_")):
                end = at + len(stem)
                if term.endswith("*"):
                    return clause[at:end] + re.match("[A-Za-z0-9_]*", clause[end:])[0]
                if not (end < len(clause) and (clause[end].isalnum() or clause[end] == "_")):
                    return clause[at:end]
    return ""


def test_triggers_of_every_clause(spark):
    chunks = ad.corpus_chunks(spark, str(DATA))
    rows = chunks.select("document_id", "idx", F.posexplode(tx.clauses(F.col("text"), _L.contrast)).alias("k", "clause")).collect()
    hits = [(r["document_id"], r["idx"], r["k"], a, found(t, r["clause"]), r["clause"].isascii()) for r in rows for a, t in _L.terms.items()]
    got = QUERIES["trigger_hits"](spark, str(DATA)).select("document_id", "idx", "clause_idx", "aspect", "trigger")
    assert Counter(tuple(r) for r in got.collect()) == Counter(x[:5] for x in hits if x[4])
    assert any(x[4] and not x[5] for x in hits)


def test_studies_run_at_production_size(spark, monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def spy(name, of):
        def call(*args, **kwargs):
            bound = inspect.signature(of).bind(*args, **kwargs)
            bound.apply_defaults()
            seen[name] = bound.arguments["samples" if name == "bootstrap" else "n"]
            raise Stop

        return call

    monkeypatch.setattr(evaluation, "bootstrap_ci", spy("bootstrap", evaluation.bootstrap_ci))
    with pytest.raises(Stop):
        QUERIES["bootstrap_interval"](spark, str(DATA))
    assert seen == {"bootstrap": 2000}
    assert inspect.signature(models.weak_labels).parameters["n"].default == 4000
    # model reports learn from the tables: a label for each labelled document
    assert sum(r["n"] for r in QUERIES["weak_label_report"](spark, str(DATA)).collect()) == spark.read.parquet(str(DATA / "labels.parquet")).count()
