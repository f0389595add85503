"""Shared plumbing: shared-storage scratch tables and rolling byte hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 64-bit words of the filter in only_rows(): 1 MB, whatever the input's size.
FILTER_WORDS = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where none is named and all runs in one JVM (tests), a local folder is made;
    on a cluster that would lose what executors write, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that nothing will read again; passes over other tables."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if isinstance(path, str):
            spark = df.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shuffle_width(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for ``rows`` rows of ``per_task`` each, at least the session's own width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // per_task))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def as_text(column: str) -> Column:
    """An id on its way through pandas, where a null would turn whole batches of numbers into floats."""
    return F.col(column).cast("string")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column of distinct longs, written once so that each reader sees the same numbers."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


def _bit_of(key: str) -> tuple[Column, Column]:
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))
    return F.floor(slot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit")


def _bits(keys: DataFrame, key: str) -> DataFrame:
    """A bit filter of the keys, at most FILTER_WORDS rows whatever the input's size."""
    return keys.select(*_bit_of(key)).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def only_rows(docs: DataFrame, row: str, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose number may be in ``keys``: a bit filter that spares most other texts
    the shuffle of the exact join after it.  It is broadcast as at most FILTER_WORDS rows, whatever the input's size."""
    marked = docs.select("*", *_bit_of(row)).join(F.broadcast(_bits(keys, row)), "word")
    return marked.where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select(*docs.columns)


def hot_keys(df: DataFrame, key: str, at_least: int) -> Callable[[DataFrame], DataFrame]:
    """What marks rows of a table with the column ``key``: ``hot``, true for each key that holds
    ``at_least`` rows of ``df``, and for few others.

    Keys are counted one by one, with partial sums, and the bound is a number of
    rows at every size.  The hot ones are written as a bit filter and broadcast as at
    most FILTER_WORDS rows; none reaches the driver.  Where very many keys are
    hot the filter marks others too, which costs them salts and changes no result.
    """
    hot = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    bits = stored(_bits(hot, key))

    def mark(rows: DataFrame) -> DataFrame:
        met = rows.select("*", *_bit_of(key)).join(F.broadcast(bits), "word", "left")
        return met.select(*rows.columns, F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False)).alias("hot"))

    return mark


def salted_join(many: DataFrame, once: DataFrame, on: list[str], by: list[str], at_least: int, salts: int, how: str = "inner") -> DataFrame:
    """``many`` joined with ``once``, which has one row for each value of ``on``.

    Values of the first column of ``on`` with ``at_least`` rows of ``many`` are split into
    ``salts`` parts by a hash of ``by``, and their row of ``once`` is copied to each part.
    """
    mark = hot_keys(many, on[0], at_least)
    part = F.when(F.col("hot"), F.pmod(F.xxhash64(*by, F.lit(43)), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    parts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    dealt = mark(many).withColumn("salt", part).drop("hot")
    copied = mark(once).withColumn("salt", parts).drop("hot")
    return dealt.join(copied, [*on, "salt"], how).drop("salt")


# --- rolling hashes -------------------------------------------------------


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1, 1 << 62)) * 2 + 1


class RollingHash:
    """Polynomial hash modulo 2**64 over bytes, any range in constant time.

    ``S[i]`` sums ``T[b] * B**-j`` over the first i bytes, so the hash of
    ``[a, b)`` is ``(S[b] - S[a]) * B**a``: the same for equal bytes anywhere.
    """

    def __init__(self, seed: int):
        self.table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = _odd(seed + 1)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            steps = np.full(n, self.base, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = self.inverse
            self.down = np.multiply.accumulate(steps)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.down[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.up[start]

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = len(prefix) - width
        return (prefix[width:] - prefix[:n]) * self.up[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
