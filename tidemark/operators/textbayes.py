"""Multinomial naive Bayes over TF-IDF of one and two tokens, as joins and sums.

Term weights: 1 + ln(count), times ln((1 + n) / (1 + df)) + 1, to unit length per
text; classes: sums of those weights, smoothed.  Texts meet the vocabulary by a
join on the term, dealt so that neither has to fit anywhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidemark.functions.lexicons import FINANCE, NEGATION_WINDOW, Lexicon
from tidemark.operators.scratch import written


#: Terms of a vocabulary that one task holds while texts' terms stream by.
TASK_TERMS = 500_000
#: Letters of text after which a task hands on its rows.
FLUSH = 1 << 22
_TOKEN = re.compile(rb"[a-z][a-z'\-]*|[0-9]+(?:\.[0-9]+)?%?|[.,;:!?]")


def _marked(text: str, cues: frozenset[bytes], breaks: frozenset[bytes]) -> list[bytes]:
    """``text.marked_tokens`` of one text; tokens are ASCII, so only ASCII letters are lowered."""
    out, reach = [], 0
    for w in _TOKEN.findall(text.encode().lower()):
        if w in cues or w.endswith(b"n't"):
            reach = NEGATION_WINDOW
        elif w in breaks:
            reach = 0
        elif reach:
            reach -= 1
            w = b"NEG_" + w if w.isalpha() else w
        out.append(w)
    return out


def counted_terms(docs: DataFrame, keys: list[str], text: str = "text", aspect: Column | None = None, lexicon: Lexicon = FINANCE) -> DataFrame:
    """(``keys``, terms: array of (term, tf)): marked tokens and pairs of neighbours, counted in each text's row without a shuffle."""
    cues, breaks = (frozenset(w.encode() for w in ws) for ws in (lexicon.cues, lexicon.breaks))
    rows = docs.select(*keys, (aspect if aspect is not None else F.lit(None)).cast("string").alias("asp_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, leads, done = batch.column("text_"), batch.column("asp_"), 0
            sizes, words, tfs, read = [], [], [], 0
            for i in range(batch.num_rows):
                t, lead = texts[i].as_py(), leads[i].as_py()
                m = _marked(t, cues, breaks)
                if lead is not None:
                    m.insert(0, b"asp_" + lead.encode())
                found = Counter(m)
                found.update(map(b" ".join, zip(m, m[1:])))
                sizes.append(len(found))
                words += found.keys()
                tfs += found.values()
                read += len(t)
                if read >= FLUSH or i + 1 == batch.num_rows:
                    each = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(tfs, pa.int64())], ["term", "tf"])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), each)
                    kept = [batch.column(k).slice(done, i + 1 - done) for k in keys]
                    yield pa.RecordBatch.from_arrays([*kept, lists], names=[*keys, "terms"])
                    done, sizes, words, tfs, read = i + 1, [], [], [], 0

    out = StructType([*[rows.schema[k] for k in keys], StructField("terms", ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())])))])
    return rows.mapInArrow(count, out)


def terms(docs: DataFrame, keys: list[str], text: str = "text", aspect: Column | None = None, lexicon: Lexicon = FINANCE) -> DataFrame:
    """(``keys``, term, tf), a row each."""
    return counted_terms(docs, keys, text, aspect, lexicon).select(*keys, F.inline("terms"))


def _met(each: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """Terms of texts joined with a table of ``size`` distinct terms: a task holds TASK_TERMS of them in a hash map,
    whatever the size, and the texts' terms pass by unsorted."""
    parts = max(int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_TERMS))
    return each.repartition(parts, "term").join(table.repartition(parts, "term").hint("shuffle_hash"), "term")


@dataclass(frozen=True)
class TextBayes:
    """A fitted model: ``table`` (term, idf, logs: one per label), the labels in order, their log priors and the table's size."""

    table: DataFrame
    labels: list[str]
    priors: list[float]
    size: int = 0

    def predict(self, docs: DataFrame, keys: list[str], text: str = "text", aspect: Column | None = None, lexicon: Lexicon = FINANCE) -> DataFrame:
        """``docs`` with ``predicted`` and ``logs``, the joint log likelihood per label; ties go to the first label.

        Terms out of the vocabulary count for nothing; a text without any known
        one gets the commonest label.  ``keys`` name a text."""
        met = _met(terms(docs, keys, text, aspect, lexicon), self.table, self.size)
        w = (1 + F.ln("tf")) * F.col("idf")
        each = [F.sum(w * F.get("logs", F.lit(i))).alias(f"s{i}") for i in range(len(self.labels))]
        sums = met.groupBy(*keys).agg(F.sqrt(F.sum(w * w)).alias("norm"), *each)
        logs = F.array(*[F.coalesce(F.col(f"s{i}") / F.col("norm"), F.lit(0.0)) + F.lit(p) for i, p in enumerate(self.priors)])
        best = F.array_max(F.transform(F.col("logs"), lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))
        names = F.array(*map(F.lit, self.labels))
        got = docs.join(sums, keys, "left").withColumn("logs", logs).withColumn("predicted", F.get(names, -best["i"]))
        return got.drop("norm", *[f"s{i}" for i in range(len(self.labels))])


def fit(docs: DataFrame, keys: list[str], label: str = "label", text: str = "text", aspect: Column | None = None, lexicon: Lexicon = FINANCE, smoothing: float = 0.3) -> TextBayes:
    """Learns from rows with a label; ``keys`` name a text.  Of the sums only those per label reach the driver."""
    known = docs.where(F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(label).agg(F.count("*")).collect()}
    if not sizes:
        raise ValueError("no labelled texts")
    labels, n = sorted(sizes), sum(sizes.values())
    counted = written(counted_terms(known, [*keys, label], text, aspect, lexicon))
    each = counted.select(*keys, F.inline("terms"))
    idf_of = lambda df: F.ln(F.lit(1.0 + n) / (1 + df)) + 1
    idf = written(each.groupBy("term").agg(idf_of(F.count("*")).alias("idf")))
    w = (1 + F.ln("tf")) * F.col("idf")
    norms = _met(each, idf, idf.count()).groupBy(*keys).agg(F.sqrt(F.sum(w * w)).alias("norm"))
    # a term's idf is the same in all its rows: only sums per term travel, and get it afterwards
    shares = counted.join(norms, keys).select(label, "norm", F.inline("terms")).withColumn("w", (1 + F.ln("tf")) / F.col("norm"))
    sums = shares.groupBy("term").agg(idf_of(F.count("*")).alias("idf"), *[F.sum(F.when(F.col(label) == x, F.col("w"))).alias(f"s{i}") for i, x in enumerate(labels)])
    per = sums.select("term", "idf", *[F.coalesce(F.col("idf") * F.col(f"s{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(len(labels))])
    per = written(per)
    totals = per.agg(F.count("*").alias("v"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(len(labels))]).first()
    below = [(totals[f"t{i}"] or 0.0) + smoothing * totals["v"] for i in range(len(labels))]
    logs = F.array(*[F.ln((F.col(f"s{i}") + smoothing) / F.lit(b)) for i, b in enumerate(below)])
    return TextBayes(per.select("term", "idf", logs.alias("logs")), labels, [math.log(sizes[x] / n) for x in labels], totals["v"])
