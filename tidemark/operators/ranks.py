"""Ranks of any number of values, correlations of ranks, and their resampling; no window without a key.

Distinct values with their counts are dealt by range and written, so each slice
of the order is known by number.  A value's rank is what the slices before it
hold, plus what stands before it in its own: two windows, one over the slices of
a cell and one inside a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import half_up
from tidemark.operators.scratch import written

#: Distinct values in a slice of resampled ranks, and replicates whose offsets are summed together.
SLICE, REPLICATES = 1_000, 100


def average_ranks(rows: DataFrame, value: str, keys: list[str], weight: str | None = None) -> DataFrame:
    """(``keys``, value, rank) per distinct value of a cell; equal values share the mean of their places.

    ``weight``: how often a row counts.  Null values have no rank.  ``keys`` name the cells, at least one column."""
    if not keys:
        raise ValueError("ranks need a key; give all rows the same one if they are one cell")
    n = F.count("*") if weight is None else F.sum(weight)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.cast("long").alias("n"))
    ranged = written(counted.repartitionByRange(*keys, value).withColumn("slice", F.spark_partition_id()))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy(*keys, "slice").agg(F.sum("n").alias("size")).withColumn("before", before).drop("size")
    upto = F.sum("n").over(Window.partitionBy(*keys, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", upto).join(offsets, [*keys, "slice"])
    return placed.select(*keys, value, (F.col("before") + F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def rank_correlations(rows: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(``keys``, n, pearson, spearman) per cell, over rows where both are known, unrounded; null where either is constant."""
    known = rows.select(*keys, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna(subset=["a", "b"])
    pairs = written(known.groupBy(*keys, "a", "b").agg(F.count("*").alias("c")))
    ranked = pairs.join(average_ranks(pairs, "a", keys, "c").withColumnRenamed("rank", "ra"), [*keys, "a"])
    ranked = ranked.join(average_ranks(pairs, "b", keys, "c").withColumnRenamed("rank", "rb"), [*keys, "b"])
    product = lambda x, y: F.sum(F.col("c") * F.col(x) * F.col(y))
    sums = ranked.groupBy(*keys).agg(F.sum("c").alias("n"), product("ra", "rb").alias("ab"), product("ra", "ra").alias("aa"), product("rb", "rb").alias("bb"))
    mean = (F.col("n") + 1) / 2
    about = lambda x: F.col(x) / F.col("n") - mean * mean
    spread = about("aa") * about("bb")
    spearman = sums.select(*keys, "n", F.when(spread > 1e-9, about("ab") / F.sqrt(spread)).alias("spearman"))
    # these aggregates keep running means, so large offsets don't cancel; corr() would divide by 0 for constants
    pearson = F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))
    return spearman.join(known.groupBy(*keys).agg(pearson.alias("pearson")), keys).select(*keys, "n", "pearson", "spearman")


# --- resampling ------------------------------------------------------------


def poisson_weights(hashes: np.ndarray, counts: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """[row, replicate]: how often a resample takes each row; a row that stands c times is drawn Poisson(c) times.

    Follows from the row's own hash and the seed, so every task and every rerun draws the same."""
    return np.array([np.random.default_rng((seed, int(h) & (2**64 - 1))).poisson(c, samples) for h, c in zip(hashes, counts)], np.int32).reshape(len(hashes), samples)


def _resampled_ranks(pairs: DataFrame, value: str, samples: int, seed: int) -> DataFrame:
    """(value, ranks): of each distinct value the doubled average ranks in all replicates, as int64 bytes."""

    def marginals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), SLICE):
                some = batch.iloc[first : first + SLICE]
                values, place = np.unique(some[value].to_numpy(), return_inverse=True)
                total = np.zeros((len(values), samples), np.int64)
                np.add.at(total, place, poisson_weights(some["h"].to_numpy(), some["c"].to_numpy(), samples, seed))
                yield pd.DataFrame({value: values, "w": [x.tobytes() for x in total]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = None, np.zeros(samples, np.int64)
        for batch in batches:
            out = []
            for v, w in zip(batch[value].tolist(), batch["w"]):
                if last is not None and v != last:
                    out.append((last, total.tobytes()))
                    total = np.zeros(samples, np.int64)
                last, total = v, total + np.frombuffer(w, np.int64)
            yield pd.DataFrame(out, columns=[value, "w"])
        if last is not None:
            yield pd.DataFrame([(last, total.tobytes())], columns=[value, "w"])

    schema = f"{value} double, w binary"
    slices = max(1, -(-pairs.select(value).distinct().count() // SLICE))
    dealt = pairs.mapInPandas(marginals, schema).repartitionByRange(slices, value).sortWithinPartitions(value)
    ranged = written(dealt.mapInPandas(merged, schema).withColumn("slice", F.spark_partition_id()))

    def sizes(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(w, np.int64) for w in group["w"]], axis=0)
        blocks = range(0, samples, REPLICATES)
        return pd.DataFrame({"slice": int(group["slice"].iloc[0]), "block": list(blocks), "w": [total[b : b + REPLICATES].tobytes() for b in blocks]})

    def offsets(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("slice")
        held = np.array([np.frombuffer(w, np.int64) for w in group["w"]])
        return group.assign(w=[x.tobytes() for x in np.cumsum(held, axis=0) - held])[["slice", "block", "w"]]

    totals = ranged.groupBy("slice").applyInPandas(sizes, "slice int, block int, w binary")
    before = totals.groupBy("block").applyInPandas(offsets, "slice int, block int, w binary")

    def ranked(own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        own, start = own.sort_values(value), start.sort_values("block")
        upto = np.concatenate([np.frombuffer(w, np.int64) for w in start["w"]]) if len(start) else np.zeros(samples, np.int64)
        out = []
        for w in own["w"]:
            here = np.frombuffer(w, np.int64)
            out.append((2 * upto + here + 1).tobytes())
            upto = upto + here
        return pd.DataFrame({value: own[value], "ranks": out})

    return ranged.groupBy("slice").cogroup(before.groupBy("slice")).applyInPandas(ranked, f"{value} double, ranks binary")


def resampled_spearman(df: DataFrame, x: str, y: str, samples: int = 2000, seed: int = 0) -> DataFrame:
    """(replicate, r): the rank correlation in each of ``samples`` Poisson resamples; degenerate ones are left out.

    All replicates are drawn and ranked anew in one pass over slices of the
    order; a row's weight in each follows from its own hash.  Nothing reaches the
    driver but counts."""
    known = df.select(F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b")).dropna()
    pairs = written(known.groupBy("a", "b").agg(F.count("*").alias("c")).withColumn("h", F.xxhash64("a", "b")))
    ranks = [_resampled_ranks(pairs, c, samples, seed).withColumnRenamed("ranks", f"r{c}") for c in ("a", "b")]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, samples))
        for batch in batches:
            for first in range(0, len(batch), SLICE):
                some = batch.iloc[first : first + SLICE]
                w = poisson_weights(some["h"].to_numpy(), some["c"].to_numpy(), samples, seed).astype(float)
                a, b = (np.array([np.frombuffer(v, np.int64) for v in some[c]], float) / 2 for c in ("ra", "rb"))
                total += np.array([w.sum(0), (w * a).sum(0), (w * b).sum(0), (w * a * b).sum(0), (w * a * a).sum(0), (w * b * b).sum(0)])
        yield pd.DataFrame(dict(zip(("n", "a", "b", "ab", "aa", "bb"), total)) | {"replicate": np.arange(samples)})

    names = ("n", "a", "b", "ab", "aa", "bb")
    joined = pairs.join(ranks[0], "a").join(ranks[1], "b").select("h", "c", "ra", "rb")
    parts = joined.mapInPandas(sums, ", ".join(f"{c} double" for c in names) + ", replicate int")
    total = parts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names])
    n, about = F.col("n"), lambda p, q, pq: F.col(pq) / F.col("n") - F.col(p) / F.col("n") * F.col(q) / F.col("n")
    spread = about("a", "a", "aa") * about("b", "b", "bb")
    return total.where((n > 1) & (spread > 1e-9)).select("replicate", (about("a", "b", "ab") / F.sqrt(spread)).alias("r"))


def percentile_interval(replicates: DataFrame, level: float = 0.95, least: int = 50) -> DataFrame:
    """(low, high) of the replicates' sorted values at places int(q * m), counted from 0; null for fewer than ``least``.

    The replicates, as many as asked for, are sorted as one array."""
    sorted_ = replicates.agg(F.sort_array(F.collect_list("r")).alias("r"))
    m = F.size("r")
    pick = lambda q: F.when(m >= least, half_up(F.get("r", F.floor(m * q).cast("int")), 6))
    return sorted_.select(pick((1 - level) / 2).alias("low"), pick((1 + level) / 2).alias("high"))
