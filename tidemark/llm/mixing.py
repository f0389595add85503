"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``max_copies`` that give each source its
target number of words, take those closest in relative entropy to the even rate
``max_copies / 2``.  Their dual has one multiplier per source, and the optimum
tilts exponentially: ``rate = max_copies / (1 + exp(-multiplier * size))``.
Newton iterations solve all duals together.  Each iteration is one aggregation
over the table of distinct (source, size) pairs with their counts, and only one
row per source reaches the driver.  Rates are then rounded to whole copies by
error diffusion, largest documents first, inside salted buckets of a source, so
that a source's rounding error is about its smallest documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kind_of, shuffle_width, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
BUCKET_DOCS = 4_000
SALTS = 64
CHUNK = 4_096
_UNIT_COLUMNS = ["i", "key", "size", "by", "n", "source_size", "target", "rate", "copies"]
NEWTON_STEPS = 40
TOLERANCE = 1e-9


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, max_copies: float = MAX_COPIES) -> np.ndarray:
    """Shares of ``total`` by weight; what stands above ``max_copies`` times a
    source's size is shared again among the others by weight.

    Sources reach their caps in the order of cap over weight, so one sort finds them."""
    caps, weights = max_copies * sizes.astype(float), weights.astype(float)
    order = np.argsort(caps / weights, kind="stable")
    c, w = caps[order], weights[order]
    level = (total - np.append(0.0, np.cumsum(c)[:-1])) / np.cumsum(w[::-1])[::-1]
    below = np.flatnonzero(level * w < c)
    first = below[0] if len(below) else len(c)
    out = np.empty(len(c))
    out[order] = np.append(c[:first], level[first] * w[first:] if first < len(c) else [])
    return out


def _rate(z, multiplier, max_copies):
    return F.lit(float(max_copies)) / (1 + F.exp(-multiplier * z))


def solve_rates(histogram: DataFrame, stats: pd.DataFrame, max_copies: float) -> np.ndarray:
    """Multipliers per source by distributed, bracketed Newton steps on the dual.

    ``histogram``: key, size, n.  ``stats``: key, words, target, mean.  The
    multiplier is infinite where the target is the cap.
    """
    spark = histogram.sparkSession
    n = len(stats)
    words, target = stats["words"].to_numpy(float), stats["target"].to_numpy(float)
    at = np.zeros(n)
    low, high = np.full(n, -700.0), np.full(n, 700.0)
    full = target >= max_copies * words * (1 - 1e-12)
    done = full | (words == 0)
    for _ in range(NEWTON_STEPS):
        if done.all():
            break
        step = spark.createDataFrame(pd.DataFrame({"key": stats["key"], "mean": stats["mean"], "at": at})[~done])
        z = F.col("size") / F.col("mean")
        rate = _rate(z, F.col("at"), max_copies)
        weight = F.col("size") * F.col("n")
        sums = (
            histogram.join(step, "key")
            .groupBy("key")
            .agg(F.sum(weight * rate).alias("got"), F.sum(weight * z * rate * (1 - rate / max_copies)).alias("slope"))
            .toPandas()
            .set_index("key")
            .reindex(stats["key"])
        )
        got, slope = sums["got"].to_numpy(), sums["slope"].to_numpy()
        gap = np.where(done, 0.0, got - target)
        done = done | (np.abs(gap) <= TOLERANCE * np.maximum(target, 1)) | (high - low < 1e-12)
        high, low = np.where(gap > 0, at, high), np.where(gap < 0, at, low)
        with np.errstate(divide="ignore", invalid="ignore"):
            newton = at - gap / slope
        inside = np.isfinite(newton) & (newton > low) & (newton < high)
        at = np.where(done, at, np.where(inside, newton, (low + high) / 2))
    return np.where(full, np.inf, at)


def _copies(bucket: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of each unit's ``n`` rows by error diffusion, largest first; ties by hash, then id."""
    bucket = bucket.sort_values(["size", "salt", "i"], ascending=[False, True, True], kind="stable", na_position="last")
    size, rate, n = (bucket[c].to_numpy() for c in ("size", "rate", "n"))
    whole = np.floor(rate + 1e-9)
    part = np.clip(rate - whole, 0, None)
    owed, extra = 0.0, np.zeros(len(bucket))
    for i, (s, p, m) in enumerate(zip(size.tolist(), part.tolist(), n.tolist())):
        if p > 0 and s > 0:
            owed += m * s * p
            extra[i] = min(max(np.floor(owed / s + 0.5), 0), m)
            owed -= s * extra[i]
    return bucket.assign(copies=(n * whole + extra).astype(np.int64))[_UNIT_COLUMNS]


def mix_units(
    df: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    by: Column | None = None,
) -> DataFrame:
    """The mix per unit of equal rows: ``id_col``, ``source``, ``by``, ``size``, ``n`` (rows), ``source_size``,
    ``target``, ``rate``, ``copies`` (of all n rows together).

    Rows are equal if their id, source, size and ``by`` (a long, such as a hash
    of the text) are; they are counted before anything is dealt, so no group of
    repeated rows or null ids meets in one task.  Hashes of the distinct units
    decide the rounding, whatever the order of the input.
    """
    spark = df.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    # a null source gets the key '', any other the key '=' + its name
    key = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    rows = df.select(F.col(id_col).alias("i"), key.alias("key"), size.alias("size"), (F.lit(0).cast("long") if by is None else by).alias("by"))
    units = stored(rows.groupBy("i", "key", "size", "by").agg(F.count("*").alias("n")))
    histogram = units.groupBy("key", "size").agg(F.sum("n").alias("n")).persist()
    try:
        # one row a source from here on, on the driver too
        stats = histogram.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs")).toPandas()
        stats = stats.assign(order=[(k == "", k) for k in stats["key"]]).sort_values("order").drop(columns="order").reset_index(drop=True)
        weight = np.resize(np.array(weights, float), len(stats))
        stats["target"] = targets(stats["words"].to_numpy(), weight, share * float(stats["words"].sum()), max_copies)
        stats["mean"] = np.maximum(stats["words"] / stats["docs"].clip(lower=1), 1.0)
        stats["at"] = solve_rates(histogram, stats, max_copies)
    finally:
        histogram.unpersist()
    stats["buckets"] = -(-stats["docs"] // BUCKET_DOCS)
    plan = spark.createDataFrame(
        stats[["key", "words", "target", "mean", "at", "buckets"]].astype({"words": "int64", "buckets": "int64", "target": float, "mean": float, "at": float}),
        "key string, source_size long, target double, mean double, at double, buckets long",
    )
    rate = F.when(F.col("at") == float("inf"), F.lit(float(max_copies))).otherwise(_rate(F.col("size") / F.col("mean"), F.col("at"), max_copies))
    # a source may hold most rows: its units meet its plan under many salts
    plan = plan.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    turned = units.withColumn("turn", F.pmod(F.xxhash64("i", "size", "by", F.lit(3)), F.lit(SALTS)).cast("int"))
    rated = turned.join(plan, ["key", "turn"]).select(
        F.col("i").cast("string").alias("i"), "key", "size", "by", "n", "source_size", "target", rate.alias("rate"),
        F.xxhash64("i", "size", "by").alias("salt"), F.pmod(F.xxhash64("size", "i", "by"), F.col("buckets")).alias("bucket"),
    )
    schema = "i string, key string, size long, by long, n long, source_size long, target double, rate double, copies long"
    out = rated.groupBy("key", "bucket").applyInPandas(_copies, schema)
    name = F.when(F.col("key") == "", F.lit(None)).otherwise(F.expr("substring(key, 2)")).cast(kind_of(df, source))
    return out.select(F.col("i").cast(kind_of(df, id_col)).alias(id_col), name.alias(source), "by", "size", "n", "source_size", "target", "rate", "copies")


def mix_sources(
    df: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """Per row: ``id_col``, ``source``, ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken``.

    Sources in code-point order, null last, weigh ``weights`` in rotation and
    share ``share`` times all words.  A null or empty text has size 0 and takes 0
    words; a long one counts like any other, as a whole.  A source without words
    has target 0.  A null source is a source of its own.  Null ids and repeated
    rows are kept, as rows of their own; of documents of one size those with the
    smaller hash of their id are rounded first.  An empty table gives an empty
    result.  Other columns of ``df`` are not read.
    """
    units = stored(mix_units(df, text, id_col, source, weights, share, max_copies))
    # a unit of many rows is dealt in chunks before its rows are written out
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK).cast("int"))).alias("chunk")
    many = units.where(F.col("n") > CHUNK).select("*", chunk).repartition(shuffle_width(df.sparkSession, 1, 1))
    dealt = units.where(F.col("n") <= CHUNK).select("*", F.lit(0).alias("chunk")).unionByName(many)
    last = F.least((F.col("chunk") + 1) * CHUNK, F.col("n")).cast("long") - 1
    rows = dealt.select("*", F.explode(F.sequence(F.col("chunk").cast("long") * CHUNK, last)).alias("row"))
    copies = (F.floor(F.col("copies") / F.col("n")) + (F.col("row") < F.col("copies") % F.col("n")).cast("long")).alias("copies")
    return rows.select(id_col, source, "size", "source_size", "target", "rate", copies).withColumn("taken", F.col("copies") * F.col("size"))
