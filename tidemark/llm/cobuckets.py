"""Two tables rewritten as one file per bucket, so that equal keys of both meet in files of equal number.

Spark deals rows by murmur3 of a key modulo the number of partitions; the buckets
here are given by another hash.  ``surrogate_keys`` finds, for each partition, an
integer that murmur3 sends there.  A row that carries the surrogate of its bucket
is dealt to the partition of that bucket by an ordinary ``repartition``, one to
one: no two buckets share a task and no task is idle.  Each partition is then
sorted and written by Spark's own sorter and Parquet writer.

Files that already hold exactly the rows of a bucket stay where they are.  What
the files hold is told from the files: counts, digests and the sizes of the
bucket-wise join are read back from what was written.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir, stored

#: Partition directories of files before and after; a table that has such a column gets longer names.
START, FINAL = "start_file", "bucket_file"
#: Ids that one update of a digest takes at once.
CHUNK = 4_096


def surrogate_keys(spark: SparkSession, partitions: int) -> list[int]:
    """For each partition the smallest integer from 0 on that ``repartition(partitions, integer)`` sends to it."""
    span = 16 * partitions
    while True:
        dealt = spark.range(span).select(F.col("id").cast("int").alias("key"))
        found = dealt.groupBy(F.pmod(F.hash("key"), F.lit(partitions)).alias("p")).agg(F.min("key").alias("key")).collect()
        if len(found) == partitions:
            return [r["key"] for r in sorted(found, key=lambda r: r["p"])]
        span *= 4


def surrogate(number: Column, keys: list[int]) -> Column:
    """The surrogate of a partition's number, as a look-up in a constant array."""
    return F.element_at(F.array(*[F.lit(k) for k in keys]), (number + 1).cast("int"))


def crc32_bucket(key: str, buckets: int, prefix: str = "") -> Column:
    """Unsigned crc32 of a key's decimal text behind ``prefix``, modulo ``buckets``."""
    return (F.crc32(F.concat(F.lit(prefix), F.col(key).cast("string"))) % buckets).cast("int")


def write_numbered(df: DataFrame, number: str, keys: list[int], first: str, path: str) -> None:
    """One Parquet file for each value of ``number`` (below ``len(keys)``) that has rows, without that column.

    Rows are sorted by ``first``, then by the other columns from left to right,
    nulls first, strings by their bytes; all columns must have an order.
    """
    columns = [c for c in df.columns if c != number]
    order = [F.col(f"`{c}`").asc_nulls_first() for c in (number, first, *[c for c in columns if c != first])]
    dealt = df.repartition(len(keys), surrogate(F.col(number), keys)).sortWithinPartitions(*order)
    writer = dealt.write.option("maxRecordsPerFile", 0).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    writer.partitionBy(number).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@dataclass
class Numbered:
    """A table with the number of the file that each row starts in, and later the number of its bucket."""

    name: str
    rows: DataFrame
    key: str
    start: Column
    #: Starting files are numbered below this.
    starts: int

    def free(self, name: str) -> str:
        """``name``, made longer until no column of the table has it."""
        used = {c.lower() for c in self.rows.columns}
        while name in used:
            name += "_"
        return name


def start_files(table: Numbered, folder: str) -> DataFrame:
    """Writes the table as numbered files; returns it as read from them, with the number of each row's file."""
    spark, number = table.rows.sparkSession, table.free(START)
    path = f"{folder}/{table.name}"
    write_numbered(table.rows.withColumn(number, table.start), number, surrogate_keys(spark, table.starts), table.key, path)
    return numbered_rows(spark, table.rows.schema, path, number)


def numbered_rows(spark: SparkSession, schema, path: str, number: str) -> DataFrame:
    """The rows of all files below ``path``, each with its file's number."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return rows.withColumn(number, F.regexp_extract(F.col("_metadata.file_path"), f"/{number}=(\\d+)/", 1).cast("int"))


def bucket_of(rows: DataFrame, table: Numbered, buckets: int, prefix: str, other: DataFrame | None = None) -> DataFrame:
    """``rows`` with the bucket of each key; ``buckets`` where ``other`` (one column of distinct keys) lacks it, one more where it is null.

    The join is a sort-merge one, whose large partitions Spark splits at run
    time; null keys, which it couldn't split, take no part in it.
    """
    key, final = table.key, table.free(FINAL)
    known, bucket = rows.where(F.col(key).isNotNull()), crc32_bucket(key, buckets, prefix)
    if other is None:
        known = known.withColumn(final, bucket)
    else:
        theirs = table.free("known_key")
        there = other.toDF(theirs).hint("merge")
        known = known.join(there, F.col(key) == F.col(theirs), "left").withColumn(final, F.when(F.col(theirs).isNotNull(), bucket).otherwise(buckets)).drop(theirs)
    return known.unionByName(rows.where(F.col(key).isNull()).withColumn(final, F.lit(buckets + 1)))


def rewrite(rows: DataFrame, table: Numbered, keys: list[int], folder: str) -> DataFrame:
    """Writes one file per bucket of ``rows``, but for those that a starting file is already.

    Starting files that aren't go, once the others are written.  Returns per
    bucket: ``table_name``, ``bucket``, ``start`` (the starting file that
    stayed, or null) and ``lineage_sha256``.  What it gathers are at most (files
    x buckets) counts.
    """
    spark, name, first, final = rows.sparkSession, table.name, table.free(START), table.free(FINAL)
    counts = rows.groupBy(F.col(first).alias("s"), F.col(final).alias("b")).agg(F.count("*").alias("n"))
    alone = F.count("*").over(Window.partitionBy("s")) == 1
    cells = stored(counts.withColumn("whole", alone & (F.count("*").over(Window.partitionBy("b")) == 1)))
    line = F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda x: F.concat_ws(":", x["s"], x["n"]))
    known = cells.groupBy(F.col("b").alias("bucket")).agg(F.sha2(F.array_join(line, ","), 256).alias("lineage_sha256"), F.max(F.when(F.col("whole"), F.col("s"))).alias("start"))
    staying = {r["s"]: r["b"] for r in cells.where("whole").collect()}
    moved = rows.where(~F.col(final).isin(list(staying.values()))) if staying else rows
    write_numbered(moved.drop(first), final, keys, table.key, f"{folder}/{name}/rewritten")
    for (number,) in cells.select("s").distinct().collect():
        if number not in staying:
            _delete(spark, f"{folder}/{name}/{first}={number}")
    return known.withColumn("table_name", F.lit(name))


def file_digests(files: DataFrame, keys: list[int]) -> DataFrame:
    """``path``, ``ids_sha256`` of each file: its ids in file order, decimal, null empty, joined by commas.

    ``files``: runs of equal ids, with the file's ``slot`` (below
    ``len(keys)``), its ``path``, the run's ``first`` row, its ``id`` and its
    length ``n``.  A file's runs stream through one task in batches.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, sha, between = None, hashlib.sha256(), b""
        for batch in batches:
            out = []
            for at, one, n in zip(batch["path"], batch["id"], batch["n"]):
                if at != path:
                    if path is not None:
                        out.append((path, sha.hexdigest()))
                    path, sha, between = at, hashlib.sha256(), b""
                text = one.encode()
                sha.update(between + text)
                between = b"," + text
                n -= 1
                while n > 0:
                    sha.update(between * min(n, CHUNK))
                    n -= CHUNK
                between = b","
            yield pd.DataFrame(out, columns=["path", "ids_sha256"])
        if path is not None:
            yield pd.DataFrame([(path, sha.hexdigest())], columns=["path", "ids_sha256"])

    dealt = files.repartition(len(keys), surrogate(F.col("slot"), keys)).sortWithinPartitions("slot", "path", "first")
    return dealt.select("path", F.coalesce("id", F.lit("")).alias("id"), "n").mapInPandas(digest, "path string, ids_sha256 string")


def co_bucket(left: Numbered, right: Numbered, buckets: int, prefix: str = "", folder: str | None = None) -> DataFrame:
    """Writes two tables as numbered files, then as one file per table and bucket, and describes those.

    A key's bucket is crc32 of ``prefix`` and its decimal text, modulo
    ``buckets``.  Keys of ``right`` that ``left`` lacks go to bucket
    ``buckets``, null keys of either to the one after it.  Columns of any type
    that has an order are kept, under any name; repeated
    rows are kept as often as they stand there, and equal rows need no order.
    Empty tables have no files and no rows in the result.  All is written to
    ``folder``, a new one in the shared folder unless named, and left there.

    Returns per final file ``table_name``, ``path``, ``columns``,
    ``ids_sha256``, ``lineage_sha256``, ``bucket``, ``n_rows``, ``n_joined``
    (rows of the bucket's inner join) and ``rewritten``.
    """
    spark = left.rows.sparkSession
    folder = folder or f"{shared_dir(spark)}/co-buckets-{uuid.uuid4().hex}"
    keys = surrogate_keys(spark, buckets + 2)
    started = {t.name: start_files(t, folder) for t in (left, right)}
    ids = stored(started[left.name].where(F.col(left.key).isNotNull()).select(left.key).distinct())
    known = rewrite(bucket_of(started[left.name], left, buckets, prefix), left, keys, folder)
    # the join is written once: counts and files both read it
    known = stored(known.unionByName(rewrite(stored(bucket_of(started[right.name], right, buckets, prefix, ids)), right, keys, folder)))

    # from here on, only what the files hold
    runs = None
    for side, t in enumerate((left, right)):
        held = spark.read.schema(t.rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{t.name}")
        held = held.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.col(t.key).cast("string").alias("id"))
        held = held.groupBy("path", "id").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
        number = lambda kind, t=t: F.regexp_extract("path", f"/{t.free(kind)}=(\\d+)/", 1).try_cast("int")
        held = held.select(F.lit(t.name).alias("table_name"), F.lit(side).alias("side"), "*", number(START).alias("start"), number(FINAL).alias("new"))
        runs = held if runs is None else runs.unionByName(held)
    placed, stayed = runs, known.where("start IS NOT NULL").select("table_name", "start", F.col("bucket").alias("old"))
    placed = stored(placed.join(F.broadcast(stayed), ["table_name", "start"], "left").withColumn("bucket", F.coalesce("new", "old")))
    misplaced = placed.where("last - first + 1 != n OR bucket IS NULL").limit(1).count()
    if misplaced:
        raise RuntimeError(f"a file below {folder} isn't sorted by its key or has no bucket")
    digests = file_digests(placed.withColumn("slot", F.col("bucket") * 2 + F.col("side")), surrogate_keys(spark, 2 * (buckets + 2)))
    files = placed.groupBy("table_name", "bucket", "path", "new").agg(F.sum("n").alias("n_rows"))
    each = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    pairs = placed.where((F.col("bucket") < buckets) & F.col("id").isNotNull()).groupBy("bucket", "id").agg((each(0) * each(1)).alias("pairs"))
    joined = pairs.groupBy("bucket").agg(F.sum("pairs").alias("n_joined"))
    named = F.create_map(*[F.lit(x) for t in (left, right) for x in (t.name, ",".join(t.rows.columns))])
    out = files.join(digests, "path").join(known.drop("start"), ["table_name", "bucket"]).join(joined, "bucket", "left")
    # paths begin as the shared folder is named, which may be without a scheme
    path = F.concat(F.lit(folder), F.regexp_extract("path", "/[^/]+(?:/rewritten)?/[^/]+/[^/]+$", 0))
    return stored(
        out.select(
            "table_name", path.alias("path"), named[F.col("table_name")].alias("columns"), "ids_sha256", "lineage_sha256", F.col("bucket").cast("long").alias("bucket"),
            F.col("n_rows").cast("long").alias("n_rows"), F.coalesce("n_joined", F.lit(0)).cast("long").alias("n_joined"), F.col("new").isNotNull().alias("rewritten"),
        )
    )
