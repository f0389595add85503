"""Blocked search plumbing: valid vectors, blocks of queries against blocks of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_width


def valid_vectors(df: DataFrame, id_col: str, vector: str, nonzero: bool = False) -> DataFrame:
    """Distinct ``vec_id``, ``v`` of rows with an id and a finite, non-empty vector.

    ``v`` stays an array of float where it is one, which halves what is moved; it
    is read as double.  Repeated rows meet in partial aggregates."""
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector).cast(kind)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & (F.size(v) > 0) & finite
    if nonzero:
        ok &= F.exists(v, lambda x: x != 0)
    return df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).distinct()


def stacked(column: pd.Series, width: int) -> np.ndarray:
    return np.vstack(column.to_list()).astype(float) if len(column) else np.empty((0, width))


#: Of queries and rows of one length, with matrices of their vectors: query_id, vec_id, score,
#: and over, which ranks scores that their type can't hold (else 0).
Scorer = Callable[[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray], pd.DataFrame]


def blocked_topk(queries: DataFrame, rows: DataFrame, blocks: int, k: int, scorer: Scorer, kind: str) -> DataFrame:
    """Top k per query over keyed blocks: the rows of a key meet its queries in one task.

    Both sides carry ``key`` (the block's number); a query stands under each
    block that it visits.  Blocks are of bounded size, each yields at most k
    rows per query, and those meet in a window per query.  Vectors of different
    lengths never match.
    """
    n = shuffle_width(rows.sparkSession, blocks, 1)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for width in left["w"].unique() if len(left) and len(right) else []:
            q, r = left[left["w"] == width], right[right["w"] == width]
            if len(r):
                found.append(scorer(q, stacked(q["v"], width), r, stacked(r["v"], width)))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "over": []})

    part = lambda d: d.withColumn("w", F.size("v")).repartition(n, "key").groupBy("key")
    partial = part(queries).cogroup(part(rows)).applyInPandas(search, f"query_id long, vec_id long, score {kind}, over double")
    # a repeated row is the same neighbour
    best = partial.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "over")).alias("best")).select("query_id", "vec_id", "best.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("over"), F.asc("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def hashed(n: int) -> Column:
    """A number below n from id and vector, so that the vectors of one id are dealt apart."""
    return F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("long")
