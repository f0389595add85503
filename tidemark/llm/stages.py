"""The pipeline's stages: each takes the rows that the one before kept and
returns rows with the same columns (the last: packed pieces).

All keep null ids, and rows that repeat an id with another text, as rows of their
own; an empty table stays empty.  Columns that a stage needs for itself get names
that the input doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, repeats
from tidemark.llm.common import numbered, table
from tidemark.llm.mixing import mix_units
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import THRESHOLD, learn_quality, with_statistics



def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't use, in any case."""
    used = {c.lower() for c in docs.columns}
    while name in used:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality rules score below the threshold.

    A score equal to it stays.  Null and empty texts are scored by their
    statistics (all 0) like any other, long ones whole; repeated rows share
    their fate.  Without usable labels all rows score 0.5 and stay.
    """
    stats = _free(docs, "stats")
    model = learn_quality(docs, table(spark, sf_dir, "labels"))
    return with_statistics(docs, "text", stats).where(model.score(f"`{stats}`") >= THRESHOLD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: the smallest id, of several rows with it the least hash of text.

    Texts without words (null and empty ones too) are no duplicates and all stay.
    Of repeated rows one stays.  A null id comes before all others.
    """
    row = _free(docs, "row")
    rows = numbered(docs, row)
    found = jaccard_join.jaccard_join(rows, row=row)
    hashes = rows.select(F.col(row).alias("row"), F.xxhash64("text").alias("of_text"))
    best = found.where("root IS NOT NULL").join(hashes, "row").groupBy("root").agg(F.min(F.struct("doc_id", "of_text", "row")).alias("least"))
    kept = best.select(F.col("least.row").alias(row)).unionByName(found.where("root IS NULL").select(F.col("row").alias(row)))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings that occur again out of the texts, at each place; every row stays, ``n_chars`` follows the text.

    Null, empty and short texts stay as they are; a text that repeats another one
    whole becomes empty, as both are repeats.
    """
    row, kept = _free(docs, "row"), _free(docs, "kept")
    rows = numbered(docs, row)
    cut = repeats.repeat_spans(rows, cut_text=True, row=row).where("n_removed > 0").select(F.col("row").alias(row), F.col("kept").alias(kept))
    joined = rows.join(cut, row, "left")
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        chars = F.length(kept).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col(kept).isNotNull(), chars).otherwise(F.col("n_chars"))
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; documents that it takes no copy of go.

    Null and empty texts have size 0, which the rates leave at one copy (two where
    a source is at its cap).  Rows with equal id, source and text share their
    copies: one of them, the first by number, stands for all.
    """
    row, copies = _free(docs, "row"), _free(docs, "copies")
    rows = numbered(docs, row)
    of_text = F.xxhash64("text", F.lit(3))
    taken = mix_units(docs, by=of_text).where("copies > 0").select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("by").alias("b"), F.col("copies").cast("int").alias("c"))
    firsts = rows.groupBy(F.col("doc_id").alias("i"), F.col("source").alias("s"), of_text.alias("b")).agg(F.min(row).alias("first"))
    same = F.col("f.i").eqNullSafe(F.col("t.i")) & F.col("f.s").eqNullSafe(F.col("t.s")) & (F.col("f.b") == F.col("t.b"))
    wanted = firsts.alias("f").join(taken.alias("t"), same).select(F.col("first").alias(row), F.col("c").alias(copies))
    repeated = rows.join(wanted, row)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return repeated.select(*columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(row)).drop(row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document; see ``pack_documents``.  Returns pieces, not documents."""
    return pack_documents(docs)
