"""Hard negatives by a full sort of each anchor's scores.

Blocks of anchors meet blocks of rows.  The first meeting finds each anchor's
best rows of its own label, the positives.  In the second, all scores of an
anchor against the block's rows of other labels are sorted, best first, ties by
id; the highest score that a positive admits is found by binary search, and the
entries from there on are read until enough stand above its lowest one.  A
block yields a few rows for each positive, of which the best are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, shuffle_width, stored
from tidemark.llm.exact_search import quantised, wide_scores
from tidemark.llm.vectors import stacked

ROWS_PER_BLOCK = 16_384
ANCHORS_PER_BLOCK = 8_192
#: Anchors scored at once, so that a matrix of scores stays at a few MB.
AT_ONCE = 32


def labelled_vectors(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """``vec_id``, ``v``, ``label``, ``row`` of rows with an id, a label and a finite, non-empty vector; every row stands for itself."""
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector).cast(kind)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(v) > 0) & finite
    return numbered(df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.col(label).cast("long").alias("label")), "row")


def score_sets(anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each anchor's integer scores against all rows: exact, those beyond a long held at its ends."""
    with np.errstate(over="ignore"):
        q, r = quantised(anchors), quantised(rows)
        widest, length = np.linalg.norm(r, axis=1).max(initial=0.0), np.linalg.norm(q, axis=1)
    narrow = length * max(widest, 1.0) < 2.0**53
    for first in range(0, len(q), AT_ONCE):
        some = slice(first, first + AT_ONCE)
        if narrow[some].all():
            yield from enumerate((q[some] @ r.T).astype(np.int64), first)
        else:
            yield from ((i, wide_scores(anchors[i], rows)[0]) for i in range(first, min(first + AT_ONCE, len(q))))


def best_of(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The k places with the highest scores; among equals those that come first."""
    s = scores[places]
    if len(s) > 4 * k:
        near = s >= np.partition(s, len(s) - k)[len(s) - k]
        places, s = places[near], s[near]
    return places[np.argsort(~s, kind="stable")[:k]]


def score_limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the highest n with ``low * score <= 100 * n <= high * score``."""
    return -((-low * score) // 100), (high * score) // 100


def _blocks(anchors: DataFrame, rows: DataFrame, rows_per_block: int, anchors_per_block: int) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with the key of each block pair that they stand in (key = turn * stripes + stripe), and the number of keys."""
    stripes, turns = max(1, -(-rows.count() // rows_per_block)), max(1, -(-anchors.count() // anchors_per_block))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("long")
    each = lambda first, times, of: F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda i: of(first, i)))
    a = anchors.withColumn("key", each(dealt(turns), stripes, lambda turn, i: turn * stripes + i))
    return a, rows.withColumn("key", each(dealt(stripes), turns, lambda stripe, i: i * stripes + stripe)), stripes * turns


def _met(anchors: DataFrame, rows: DataFrame, keys: int, mine, schema: str) -> DataFrame:
    """Runs ``mine(anchors, matrix, rows, matrix)`` on each block pair and vector length, rows ordered by id."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for width in left["w"].unique() if len(left) and len(right) else []:
            q, r = left[left["w"] == width], right[right["w"] == width].sort_values(["vec_id", "row"])
            if len(r):
                found += mine(q, stacked(q["v"], width), r, stacked(r["v"], width))
        return pd.DataFrame(found, columns=[x.split()[0] for x in schema.split(", ")])

    n = shuffle_width(rows.sparkSession, keys, 1)
    part = lambda d: d.withColumn("w", F.size("v")).repartition(n, "key").groupBy("key")
    return part(anchors).cogroup(part(rows)).applyInPandas(meet, schema)


def hard_negatives(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    anchor_modulus: int = 50,
    rows_per_block: int = ROWS_PER_BLOCK,
    anchors_per_block: int = ANCHORS_PER_BLOCK,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are rows whose id is divisible by ``anchor_modulus``.  Components
    become floor(256 * x); a score is the integer inner product, higher is
    nearer, ties go to smaller ids.  An anchor's positives are its nearest
    ``positives`` other rows of its label, those of a positive's negatives the
    nearest ``negatives`` rows of other labels whose score lies between
    ``low`` and ``high`` hundredths of the positive's; a positive below zero
    has none.  Rows with a null id or label, or a vector that is null, empty or
    holds null or non-finite components take no part.  Every other row stands
    for itself, repeated rows too: they are each other's positives.  Vectors of
    different lengths never meet.  Scores beyond a long are held at its ends.
    An empty table gives an empty result; other columns are not read.
    """
    rows = labelled_vectors(df, id_col, vector, label)
    anchors = rows.where(F.col("vec_id") % anchor_modulus == 0)

    def near(q: pd.DataFrame, left: np.ndarray, r: pd.DataFrame, right: np.ndarray) -> list[tuple]:
        ids, numbers, labels = r["vec_id"].to_numpy(), r["row"].to_numpy(), r["label"].to_numpy()
        own = q["row"].to_numpy()
        of = {x: np.flatnonzero(labels == x) for x in q["label"].unique()}
        mine, out = q["label"].to_numpy(), []
        for i, scores in score_sets(left, right):
            # one more than asked for: the anchor itself may be among them
            at = best_of(scores, of[mine[i]], positives + 1)
            out += [(own[i], ids[j], numbers[j], scores[j]) for j in at[numbers[at] != own[i]][:positives]]
        return out

    a, r, keys = _blocks(anchors, rows, rows_per_block, anchors_per_block)
    first = _met(a, r, keys, near, "anchor long, positive_id long, row long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "row")
    best = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    found = best.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("positives"))
    asked = stored(anchors.join(found, "row").select("row", "vec_id", "v", "label", F.col("positives.positive_id").alias("ids"), F.col("positives.score").alias("scores")))

    def mined(q: pd.DataFrame, left: np.ndarray, r: pd.DataFrame, right: np.ndarray) -> list[tuple]:
        ids, labels = r["vec_id"].to_numpy(), r["label"].to_numpy()
        of = {x: np.flatnonzero(labels != x) for x in q["label"].unique()}
        own, names, mine, theirs, theirs_score = (q[c].to_numpy() for c in ("row", "vec_id", "label", "ids", "scores"))
        out = []
        for i, scores in score_sets(left, right):
            other = of[mine[i]]
            falling = np.lexsort((ids[other], ~scores[other]))
            ranked, places = scores[other][falling], other[falling]
            rising = ranked[::-1]
            for n, (positive, score) in enumerate(zip(theirs[i], theirs_score[i])):
                least, most = score_limits(int(score), low, high)
                at = len(ranked) - np.searchsorted(rising, most, side="right")
                for j in range(at, min(at + negatives, len(ranked))):
                    if ranked[j] < least:
                        break
                    out.append((own[i], names[i], n, positive, score, ids[places[j]], ranked[j]))
        return out

    a, r, keys = _blocks(asked, rows, rows_per_block, anchors_per_block)
    second = _met(a, r, keys, mined, "anchor long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
