"""Sources to the document relation: ticker, doc_type, doc_date, title, source, source_url, text, segments.

Every reader is lazy and distributed; a ``since`` date is a plain filter.  HTTP
fetching stays outside: its landing folder is what these read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.unicode import unescape_html

TICKER = re.compile(r"[A-Z][A-Z0-9.\-]{0,9}")
SEGMENTS = "array<struct<speaker:string,text:string>>"
MDNA_CHARS, MDNA_LEAST, FEED_ITEMS = 200_000, 200, 15


def check_tickers(tickers: list[str]) -> list[str]:
    """Upper-cased tickers; one that doesn't look like a ticker raises."""
    out = [t.upper() for t in tickers]
    bad = [t for t in out if not TICKER.fullmatch(t)]
    if bad:
        raise ValueError(f"not tickers: {bad}")
    return out


def _shaped(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    kinds = {"ticker": "string", "doc_type": "string", "doc_date": "date", "title": "string", "source_url": "string", "text": "string", "segments": SEGMENTS}
    cols = [columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
    return df.select(*cols, F.lit(source).alias("source"))


def _since(df: DataFrame, since: str | None) -> DataFrame:
    return df if since is None else df.where(F.col("doc_date") >= F.lit(since).cast("date"))


def text_files(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """``<TICKER>_<type>_<date>.txt``; an optional first line ``TITLE: ...`` is taken off."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    parts = F.split(F.regexp_replace("name", r"\.txt$", ""), "_")
    date = F.try_to_date(F.element_at(parts, -1))
    title = F.regexp_extract("value", r"^TITLE:[ \t]*([^\n]*)", 1)
    body = F.regexp_replace("value", r"^TITLE:[^\n]*\n?", "")
    kind = F.array_join(F.slice(parts, 2, F.size(parts) - 2), "_")
    ok = raw.where(F.size(parts) >= 3).withColumn("d", date).where("d IS NOT NULL")
    return _since(_shaped(ok, "sample", ticker=F.upper(F.element_at(parts, 1)), doc_type=kind, doc_date=F.col("d"), title=title, text=body), since)


def transcript_table(spark: SparkSession, path: str, tickers: list[str] | None = None, since: str | None = None) -> DataFrame:
    """Parquet of speaker-segmented calls: symbol, company_name, year, quarter, date, structured_content."""
    raw = spark.read.parquet(path).select("symbol", "company_name", "year", "quarter", "date", "structured_content")
    if tickers is not None:
        raw = raw.where(F.col("symbol").isin(check_tickers(tickers)))
    said = F.filter("structured_content", lambda s: F.coalesce(F.btrim(s["text"]), F.lit("")) != "")
    said = F.transform(said, lambda s: F.struct(F.btrim(s["speaker"]).alias("speaker"), F.btrim(s["text"]).alias("text")))
    text = F.array_join(F.transform(said, lambda s: F.concat(F.coalesce(s["speaker"], F.lit("")), F.lit(": "), s["text"])), "\n")
    title = F.format_string("%s Q%s %s Earnings Call", F.col("company_name"), F.col("quarter").cast("string"), F.col("year").cast("string"))
    got = raw.where(F.size(said) > 0)
    return _since(_shaped(got, "transcripts", ticker=F.col("symbol"), doc_type=F.lit("transcript"), doc_date=F.try_to_date(F.substring("date", 1, 10)), title=title, text=text, segments=said), since)


def extract_subset(spark: SparkSession, path: str, tickers: list[str], out: str) -> int:
    """Writes the calls of some tickers, sorted, as zstd Parquet; returns their number."""
    rows = spark.read.parquet(path).where(F.col("symbol").isin(check_tickers(tickers)))
    rows.orderBy("symbol", "date").write.mode("overwrite").option("compression", "zstd").parquet(out)
    return spark.read.parquet(out).count()


def strip_tags(html: Column) -> Column:
    """Text of HTML without scripts, styles and tags; white space collapsed (entities: unicode.unescape_html)."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"[ \t\r\n]+", " ")
    return F.btrim(out, F.lit(" "))


def mdna_section(text: Column, start: str, end: str, most: int = MDNA_CHARS, least: int = MDNA_LEAST) -> Column:
    """From the last heading (an earlier one is the table of contents) to the next section, at least ``least`` on; else the text's head."""
    head = F.regexp_instr(text, F.lit(rf"(?is)(?:{start})(?!.*(?:{start}))"))
    rest = F.substr(text, head)
    stop = F.regexp_instr(F.substr(rest, F.lit(least + 1)), F.lit(rf"(?i)(?:{end})"))
    section = F.when(stop > 0, F.substr(rest, F.lit(1), stop + least - 1)).otherwise(rest)
    return F.substring(F.when(head > 0, section).otherwise(text), 1, most)


def filings(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """(source_url, text): MD&A sections of HTML files."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("source_url"), mdna_section(unescape_html(strip_tags(F.col("value"))), start, end).alias("text"))


def filing_index(spark: SparkSession, path: str, forms: list[str], since: str | None = None) -> DataFrame:
    """Submission JSON with parallel arrays: one row per filing of the forms, CIK padded to 10 digits."""
    raw = spark.read.json(path, multiLine=True)
    recent = "filings.recent"
    arrays = F.arrays_zip(*[F.col(f"{recent}.{c}").alias(c) for c in ("form", "filingDate", "accessionNumber", "primaryDocument")])
    rows = raw.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.inline(arrays))
    rows = rows.select("cik", "form", F.try_to_date("filingDate").alias("doc_date"), "accessionNumber", "primaryDocument").where(F.col("form").isin(forms))
    return _since(rows, since)


def news_feed(spark: SparkSession, path: str, ticker: str, since: str | None = None, items: int = FEED_ITEMS) -> DataFrame:
    """RSS items, the first ``items`` of each file in feed order; a missing date is today's."""
    item = "title string, link string, description string, pubDate string"
    raw = spark.read.format("xml").option("rowTag", "item").schema(item).load(path)
    order = raw.withColumns({"file": F.col("_metadata.file_path"), "i": F.monotonically_increasing_id()})
    turn = F.row_number().over(Window.partitionBy("file").orderBy("i"))
    kept = order.withColumn("turn", turn).where(F.col("turn") <= items)
    day = F.to_date(F.try_to_timestamp(F.regexp_extract("pubDate", r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), F.lit("d MMM yyyy")))
    return _since(_shaped(kept, "news", ticker=F.lit(ticker.upper()), doc_type=F.lit("news"), doc_date=F.coalesce(day, F.current_date()), title=F.col("title"), source_url=F.col("link"),
                          text=F.concat_ws("\n", "title", unescape_html(strip_tags(F.coalesce("description", F.lit("")))))), since)


def announcements(spark: SparkSession, path: str, ticker: str, since: str | None = None) -> DataFrame:
    """Exchange announcements, a JSON array; rows with a bad date are left out, an unreadable file gives none."""
    raw = spark.read.schema("an_dt string, desc string, attchmntText string, attchmntFile string").json(path, multiLine=True)
    day = F.try_to_date(F.substring("an_dt", 1, 11), "dd-MMM-yyyy")
    rows = raw.withColumn("d", day).where("d IS NOT NULL")
    return _since(_shaped(rows, "announcements", ticker=F.lit(ticker.upper()), doc_type=F.lit("announcement"), doc_date=F.col("d"), title=F.col("desc"), source_url=F.col("attchmntFile"), text=F.col("attchmntText")), since)


Reader = Callable[..., DataFrame]
READERS: dict[str, Reader] = {"sample": text_files, "transcripts": transcript_table, "news": news_feed, "announcements": announcements}


def read_all(spark: SparkSession, sources: dict[str, dict]) -> DataFrame:
    """Union of the named readers with their options; names that no reader has are passed over."""
    found = [READERS[name](spark, **options) for name, options in sources.items() if name in READERS]
    if not found:
        return spark.createDataFrame([], f"ticker string, doc_type string, doc_date date, title string, source_url string, text string, segments {SEGMENTS}, source string")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated aspect, label, trap, sentence."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    return raw.select("aspect", "label", (F.col("trap") == "1").alias("trap"), F.btrim("sentence").alias("text"))


def lexicon_rows(raw: DataFrame, categories: list[str]) -> DataFrame:
    """(category, word) where the category's column holds a positive year; a negative one marks a removed word."""
    long = raw.unpivot(["Word"], [F.col(c) for c in categories], "category", "year")
    return long.where(F.col("year").try_cast("int") > 0).select(F.lower("category").alias("category"), F.lower("Word").alias("word"))


def lexicon_csv(spark: SparkSession, path: str) -> DataFrame:
    return lexicon_rows(spark.read.csv(path, header=True), ["Negative", "Positive", "Uncertainty", "Litigious"])


def load_lexicon(spark: SparkSession, path: str | None = None):
    """The finance lists with the words of an official CSV if there is one, else as they are."""
    from dataclasses import replace

    from tidemark.functions.lexicons import FINANCE

    if path is None:
        return FINANCE
    words = {r["category"]: sorted(r["words"]) for r in lexicon_csv(spark, path).groupBy("category").agg(F.collect_set("word").alias("words")).collect()}
    return replace(FINANCE, **words)


def returns_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("ticker string, date date, ret double").csv(path, header=True)
    return raw.withColumn("ticker", F.upper("ticker"))


def covers(prices: DataFrame, start: str, end: str) -> DataFrame:
    """Per symbol: do the stored days reach over the whole span?"""
    return prices.groupBy("symbol").agg(((F.min("day") <= F.lit(start).cast("date")) & (F.max("day") >= F.lit(end).cast("date"))).alias("covered"))


def labels(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """Labelled sheets as CSV: blank labels are skipped, an unknown one raises when read."""
    raw = spark.read.csv(path, header=True).where(F.coalesce(F.btrim("label"), F.lit("")) != "")
    label = F.lower(F.btrim("label"))
    known = F.when(label.isin(allowed), label).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)))
    return raw.select("item_id", known.alias("label"))
