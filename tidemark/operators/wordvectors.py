"""Pretrained word vectors: read from text, joined by distinct word, pooled per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.lexicons import FINANCE, Lexicon
from tidemark.operators.scratch import written

#: A negated token starts from its word's vector, damped and turned round.
NEGATED = -0.5
#: Bytes of vectors up to which each task gets all of them.
BROADCAST = 64 << 20


def read_vectors(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """(word, vector) of text lines ``word v1 ... vd``.

    Lines with another number of fields, or a field that is no number, are left
    out; of a word that stands twice the last line of the last file counts."""
    raw = spark.read.text(path).select(F.split(F.rtrim("value"), " ").alias("p"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"))
    numbers = F.transform(F.slice("p", 2, dimensions), lambda x: x.try_cast("double"))
    rows = raw.where(F.size("p") == dimensions + 1).select(F.col("p")[0].alias("word"), numbers.alias("vector"), "at")
    fit = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    return fit.groupBy("word").agg(F.max_by("vector", "at").alias("vector"))


def combined(weighted: Column) -> Column:
    """The sum of an array of (weight, vector) structs."""
    add = lambda acc, x: F.when(F.size(acc) == 0, F.transform(x["vector"], lambda v: v.cast("double") * x["weight"])).otherwise(F.zip_with(acc, x["vector"], lambda a, v: a + v.cast("double") * x["weight"]))
    return F.aggregate(weighted, F.array().cast("array<double>"), add)


def pooled_vectors(chunks: DataFrame, vectors: DataFrame, keys: list[str], lexicon: Lexicon = FINANCE, text: str = "text") -> DataFrame:
    """(``keys``, n_tokens, n_found, vector): the mean over a key's tokens that have a vector, negated ones at NEGATED times it.

    A key may have several rows of ``chunks`` (sentences).  Words are counted per
    key and sign before they meet the vectors, and those without one only count
    as tokens.  The vectors are written once to learn their size: up to
    BROADCAST bytes each task gets them, so that vectors never travel with the
    words of a key; more are joined by word, and travel.  The vector is null
    where none is found."""
    table = written(vectors.select("word", "vector"))
    known = table.agg(F.coalesce(F.sum(F.octet_length("word") + 8 * F.size("vector") + 64), F.lit(0))).first()[0]
    near = F.broadcast if known <= BROADCAST else lambda df: df
    toks = chunks.select(*keys, tx.tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks"))
    pairs = F.arrays_zip(F.transform("toks", F.lower).alias("word"), tx.negated(F.col("toks"), lexicon.cues, lexicon.breaks).alias("off"))
    words = toks.where(F.size("toks") > 0).select(*keys, F.inline(pairs)).join(near(table.select("word").distinct().withColumn("known", F.lit(True))), "word", "left")
    # unknown words are one row a key; "word" of a known one with letters alone can be turned round
    plain = F.col("off") & F.col("word").rlike("^[a-z]+$")
    kept = words.select(*keys, F.when(F.col("known"), F.col("word")).alias("word"), F.when(F.col("known"), plain).otherwise(False).alias("negated"))
    counted = kept.groupBy(*keys, "word", "negated").agg(F.count("*").alias("n"))
    # all of a key's counts in one row: the join with broadcast vectors then needs no shuffle after it
    whole = counted.groupBy(*keys).agg(F.sum("n").alias("n_tokens"), F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "negated", "n"))).alias("counts"))
    met = whole.select(*keys, "n_tokens", F.inline_outer("counts")).join(near(table), "word", "left")
    weight = F.col("n") * F.when(F.col("negated"), NEGATED).otherwise(1.0)
    # sorted, so the order of the sum, and with it its last digits, is the same each time
    some = F.array_sort(F.collect_list(F.when(F.col("vector").isNotNull(), F.struct("word", "negated", weight.alias("weight"), "vector"))))
    sums = met.groupBy(*keys).agg(F.max("n_tokens").alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("vector").isNotNull(), F.col("n"))), F.lit(0)).alias("n_found"), some.alias("found"))
    mean = tx.let(combined(F.col("found")), lambda total: F.transform(total, lambda x: x / F.col("n_found")))
    return sums.select(*keys, "n_tokens", "n_found", F.when(F.col("n_found") > 0, mean).alias("vector"))
