"""Idempotent writes: documents by content hash, reports by key, everything else appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.unicode import nfkc
from tidemark.operators import transcripts
from tidemark.sources import commits

LEAST_CHARS = 20


def read(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def split_usable(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, malformed rows): no ticker, no date or no text."""
    ok = F.col("ticker").isNotNull() & F.col("doc_date").isNotNull() & F.col("text").isNotNull()
    return documents.where(ok), documents.where(~ok)


def new_documents(documents: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Documents of at least 20 normalised characters whose hash is neither stored nor repeated; with document_id."""
    body = tx.normalize(F.col("text"))
    digest = tx.content_hash(F.concat_ws("|", "ticker", "doc_type", body))
    rows = documents.where(F.length(body) >= LEAST_CHARS).withColumn("content_hash", digest)
    first = Window.partitionBy("content_hash").orderBy("doc_date", "title", "source")
    rows = rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    if stored is not None:
        rows = rows.join(stored.select("content_hash"), "content_hash", "left_anti")
    return rows.withColumns({"document_id": F.xxhash64("content_hash"), "ingested_at": F.current_timestamp().cast("timestamp_ntz")})


def chunk(documents: DataFrame) -> DataFrame:
    """Sentences by kind of document: segmented or line-tagged transcripts, filings (mdna), anything else (body)."""
    calls, segmented = F.col("doc_type") == "transcript", F.size(F.coalesce("segments", F.array().cast("array<struct<speaker:string,text:string>>"))) > 0
    filing = F.col("doc_type").isin("10-K", "10-Q", "10k", "10q")
    parts = documents.where(calls & segmented).select("document_id", F.posexplode("segments").alias("i", "s")).select("document_id", "i", "s.speaker", "s.text")
    out = transcripts.segment_chunks(parts).unionByName(transcripts.line_chunks(documents.where(calls & ~segmented)))
    out = out.unionByName(transcripts.plain_chunks(documents.where(~calls & filing), "mdna")).unionByName(transcripts.plain_chunks(documents.where(~calls & ~filing)))
    return out.withColumn("chunk_id", F.xxhash64("document_id", "idx"))


def ingest(documents: DataFrame, root: str, attempts: int = 5) -> dict[str, int]:
    """Adds new documents and their sentences under ``root`` as one transaction; running it again adds nothing.

    Both tables change at once or not at all: a crash leaves nothing that readers
    of the store see, and what another run published meanwhile is looked at
    before a second try, so no document is stored twice.  Texts are composed
    (NFKC) before anything else reads them."""
    spark = documents.sparkSession
    good, bad = split_usable(documents.withColumn("text", nfkc(F.col("text"))))
    fetched, failures = documents.count(), bad.count()

    def work(transaction: commits.Transaction) -> dict[str, int]:
        fresh = new_documents(good, transaction.read("documents"))
        fresh = transaction.stage("documents", fresh.sortWithinPartitions("ticker", "doc_date"))
        stats = {"fetched": fetched, "new": fresh.count(), "failures": failures}
        stats["duplicates"] = good.where(F.length(tx.normalize(F.col("text"))) >= LEAST_CHARS).count() - stats["new"]
        if not stats["new"]:
            transaction.tables.clear()
            transaction.abandon()
            return stats | {"chunks": 0}
        return stats | {"chunks": transaction.stage("chunks", chunk(fresh)).count()}

    return commits.transact(spark, root, work, attempts)


def upsert(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions (by ``keys``) that ``rows`` holds and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def traces(steps: DataFrame, payload: list[str]) -> DataFrame:
    """Log rows: brief_id, step, agent, payload as JSON."""
    return steps.select("brief_id", "step", "agent", F.to_json(F.struct(*payload)).alias("payload"))


def write_sheet(rows: DataFrame, key: DataFrame, path: str, batch: int = 50) -> None:
    """Annotation batches as CSV folders, the hidden key apart."""
    turn = F.floor((F.row_number().over(Window.orderBy("item_id")) - 1) / batch)  # a sheet for people: hundreds of rows
    rows.withColumn("batch", turn).write.mode("overwrite").partitionBy("batch").option("header", True).csv(f"{path}/sheet")
    key.write.mode("overwrite").parquet(f"{path}/key")


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A table of a report's rows (a handful) as Markdown."""
    cell = lambda x: f"{x:.3f}" if isinstance(x, float) else "" if x is None else str(x)
    body = [[cell(r[c]) for c in columns] for r in rows.select(*columns).collect()]
    return "\n".join("| " + " | ".join(x) + " |" for x in [columns, ["---"] * len(columns), *body])
