"""The engine's relations made from the driver's tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.lexicons import Lexicon

#: Word lists for the invented-syllable documents: frequent words stand in for finance terms.
SYLLABLES = Lexicon(
    terms={
        "guidance": ["that", "this is", "this"],
        "margins": ["with the", "with", "from"],
        "demand": ["was", "is"],
        "litigation": ["of the", "la", "der"],
        "management_tone": ["and the", "and", "de*"],
        "liquidity": ["for", "to the"],
    },
    positive=["the", "by", "les", "die", "el"],
    negative=["of", "as", "in", "un", "das"],
    uncertainty=["it", "par"],
    litigious=["of"],
    up=["are", "or", "est"],
    down=["at", "be", "des"],
    cues=["not", "on", "que", "an", "no"],
    breaks=[",", ";", ":", ".", "!", "?", "but", "und"],
    hedges=["to", "it", "on", "la", "den"],
    contrast=["thst", "whst", "but"],
    bad_when_up="of|de|das",
    good_when_up="to|la",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored sentences: a document is a ticker's day."""
    return scored(table(spark, sf_dir, "events"))


def live_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the table's files, with the time ``ts`` of each row."""
    shape = table(spark, sf_dir, "events").schema
    # as a pattern: a plain path that streams read must be a folder, and the table may be one file
    e = spark.readStream.schema(shape).parquet(f"{sf_dir}/[e]vents.parquet")
    return scored(e, F.col("ts").cast("timestamp").alias("ts"))


def scored(e: DataFrame, *more: Column) -> DataFrame:
    day, value = F.col("ts").cast("date"), F.col("value")
    ticker = F.concat(F.lit("T"), F.col("user_id") % 20)
    return e.select(
        F.col("event_id").alias("chunk_id"), ticker.alias("ticker"), F.concat_ws("/", ticker, day.cast("string")).alias("document_id"),
        F.when(F.dayofmonth(day) % 3 == 0, "filing").otherwise("transcript").alias("doc_type"), day.alias("doc_date"),
        F.when(F.col("event_id") % 3 == 0, "qa").otherwise("prepared").alias("section"), F.col("event_type").alias("aspect"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (value - 35) / 50)).alias("score"), F.least(F.lit(1.0), 0.34 + F.abs(value - 35) / 100).alias("confidence"),
        F.when(F.col("event_id") % 2 == 0, "lm_directional").otherwise("lm_lexicon").alias("model_name"), F.lit(0.0).alias("similarity"), *more,
    )


SCORES = """scores AS (
  SELECT event_id AS chunk_id, 'T' || (user_id % 20) AS ticker, 'T' || (user_id % 20) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS document_id,
    CASE WHEN day(CAST(ts AS DATE)) % 3 = 0 THEN 'filing' ELSE 'transcript' END AS doc_type, CAST(ts AS DATE) AS doc_date,
    CASE WHEN event_id % 3 = 0 THEN 'qa' ELSE 'prepared' END AS section, event_type AS aspect,
    greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 35) / 50)) AS score, least(1.0::DOUBLE, 0.34::DOUBLE + abs(value - 35) / 100) AS confidence,
    CASE WHEN event_id % 2 = 0 THEN 'lm_directional' ELSE 'lm_lexicon' END AS model_name FROM events)"""
EVENT_ASPECTS = "event_aspects AS (SELECT DISTINCT event_type AS aspect FROM events)"


def score_documents(scored: DataFrame) -> DataFrame:
    return scored.select("document_id", "ticker", "doc_type", "doc_date").distinct()


SCORE_DOCS = "docs AS (SELECT DISTINCT document_id, ticker, doc_type, doc_date FROM scores)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dated filings of 20 tickers."""
    d = table(spark, sf_dir, "documents")
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return d.select(F.col("doc_id").alias("document_id"), F.col("source").alias("ticker"), F.col("lang").alias("doc_type"), date.alias("doc_date"), "text")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cluster's cores where its scan yields fewer tasks (a small file is one
    row group, so one task); a large scan has more and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the corpus, unnormalised, numbered per document."""
    d = spread(corpus(spark, sf_dir))
    return d.select("document_id", "ticker", F.posexplode(tx.sentences(F.col("text"))).alias("idx", "text")).withColumn("idx", F.col("idx").cast("long"))


def _abbreviations() -> str:
    from tidemark.functions.lexicons import ABBREVIATIONS

    return "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)


#: Boundaries get a mark; the marks after abbreviations are taken back (twice, as matches can't overlap).
SENTENCES = rf"""flat AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\r\n\f\v]*\n[ \t\r\n\f\v]*', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
marked AS (SELECT doc_id, regexp_replace(t, '([.!?])["'')\]]*\s+(["''(\[]?[A-Z0-9])', '\1' || chr(30) || '\2', 'g') AS t0 FROM flat),
rejoined AS (SELECT doc_id, regexp_replace(regexp_replace(t0, '(?i)((?:^|[\s\x1e])["''(\[]*(?:{_abbreviations()})["''(\[]*\.)\x1e', '\1 ', 'g'),
  '(?i)((?:^|[\s\x1e])["''(\[]*(?:{_abbreviations()})["''(\[]*\.)\x1e', '\1 ', 'g') AS t FROM marked),
pieces AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(30)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 1) AS ss FROM rejoined),
sents AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS idx FROM pieces)"""
TOKEN_SQL = r"regexp_extract_all(s, '[A-Za-z][A-Za-z''\-]*|\d+(?:\.\d+)?%?|[.,;:!?]')"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as speaker segments: system is the operator, users ask, assistants present."""
    c = table(spark, sf_dir, "conversations")
    who = F.when(F.col("role") == "system", "Operator").when(F.col("role") == "user", F.concat(F.lit("User "), F.col("turn") % 4)).otherwise("Company")
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("i"), who.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))


SEGMENTS = """segments AS (SELECT conv_id AS document_id, turn AS i,
  CASE role WHEN 'system' THEN 'Operator' WHEN 'user' THEN 'User ' || (turn % 4) ELSE 'Company' END AS speaker, coalesce(text, '') AS text FROM conversations)"""
INTRO, HANDOFF = "the|de", "and|la|un"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as daily closes of 20 symbols."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("S"), F.col("l_partkey") % 20).alias("symbol"), F.col("l_shipdate").cast("date").alias("day")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close")
    )


PRICES = """prices AS (SELECT 'S' || (l_partkey % 20) AS symbol, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY 1, 2)"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


MARKET = "market AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY 1)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls: one symbol per customer group, a time from the key."""
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(o_orderkey % 24 as int))")
    return o.select(F.concat(F.lit("S"), F.col("o_custkey") % 20).alias("symbol"), at.alias("call_at")).distinct()


CALLS = "calls AS (SELECT DISTINCT 'S' || (o_custkey % 20) AS symbol, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS call_at FROM orders)"


#: Speakers of conversations written as lines, and the words that open a Q&A there.
LINE_SPEAKERS = {"system": "Operator", "user": "Ann Lee -- Analyst", "assistant": "Bo Chan - Chief Officer"}
LINE_MARKERS = "quelle|oder|with the"


def line_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one text each, a line per turn: ``Name -- Role: text``."""
    who = F.create_map(*[F.lit(x) for item in LINE_SPEAKERS.items() for x in item])
    c = table(spark, sf_dir, "conversations").withColumn("line", F.concat(F.coalesce(who[F.col("role")], F.lit("Someone")), F.lit(": "), F.coalesce("text", F.lit(""))))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return c.groupBy(F.col("conv_id").alias("document_id")).agg(F.array_join(lines, "\n").alias("text"))


LINE_TEXTS = "conv AS (SELECT conv_id AS doc_id, string_agg(CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LINE_SPEAKERS.items()) + " ELSE 'Someone' END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
