"""Documents to sentences: plain texts, line-tagged transcripts, speaker segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.lexicons import HANDOFF, OPERATOR_NAMES, QA_MARKERS, QUESTION_INTRO

SPEAKER_LINE = (
    r"^\s*([A-Z][A-Za-z.'\-]+(?:\s+[A-Z][A-Za-z.'\-]+){0,3})(?:\s*(?:--|-|,|\()\s*([A-Za-z&,./ \-]{2,60}?)\)?)?\s*:\s*(.*)$"
)
MARKER_LINE, PREPARED_SHARE, HANDOFF_TAIL = 200, 0.12, 400


def plain_chunks(documents: DataFrame, section: str = "body") -> DataFrame:
    """(document_id, idx, text, section, speaker) of texts without speakers."""
    parts = documents.select("document_id", F.posexplode(tx.sentences(tx.normalize(F.col("text")))).alias("idx", "text"))
    return parts.select("document_id", "idx", "text", F.lit(section).alias("section"), F.lit("").alias("speaker"))


def _numbered(parts: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy(*order)
    return parts.withColumn("idx", F.row_number().over(w) - 1).select("document_id", "idx", "text", "section", "speaker")


def line_chunks(documents: DataFrame, markers: str = QA_MARKERS) -> DataFrame:
    """Sentences of ``Name -- Role: text`` transcripts.

    A line-by-line machine as windows: a speaker or a Q&A marker starts a block,
    the speaker is the last one named, the section is Q&A once a marker has
    passed; blocks are joined and split into sentences."""
    lines = documents.select("document_id", F.posexplode(F.split(tx.normalize(F.col("text")), "\n")).alias("i", "raw"))
    lines = lines.withColumn("line", F.btrim(F.col("raw"))).where("line <> ''")
    marker = F.col("line").rlike(f"(?i)(?:{markers})") & (F.length("line") < MARKER_LINE)
    part = lambda k: F.btrim(F.regexp_extract("line", SPEAKER_LINE, k))
    named = (part(1) != "") & ~F.lower("line").rlike("^(http|note)")
    lines = lines.withColumns({"marker": marker, "named": named, "name": part(1), "role": part(2)})
    rest = F.when(F.col("named"), part(3)).otherwise(F.col("line"))
    who = F.when(F.col("named"), F.when(F.col("role") != "", F.concat("name", F.lit(" ("), "role", F.lit(")"))).otherwise(F.col("name")))
    lines = lines.withColumns({"rest": rest, "who": who})
    opens = F.col("named") & F.lower("who").startswith("operator") & F.col("rest").rlike(f"(?i)(?:{markers})")
    w = Window.partitionBy("document_id").orderBy("i")
    lines = lines.withColumns({
        "qa": F.max((F.col("marker") | opens).cast("int")).over(w),
        "block": F.sum((F.col("marker") | F.col("named")).cast("int")).over(w),
        "speaker": F.coalesce(F.last("who", ignorenulls=True).over(w), F.lit("")),
    }).where("rest <> ''")
    joined = lines.groupBy("document_id", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "rest"))), lambda x: x["rest"]), " ").alias("body"), F.max("qa").alias("qa"), F.max_by("speaker", "i").alias("speaker")
    )
    section = F.when(F.col("qa") == 1, "qa").otherwise("prepared").alias("section")
    parts = joined.select("document_id", "block", "speaker", section, F.posexplode(tx.sentences(F.col("body"))).alias("pos", "text"))
    return _numbered(parts, "block", "pos")


def qa_start(segments: DataFrame, intro: str = QUESTION_INTRO, handoff: str = HANDOFF, operators: list[str] = OPERATOR_NAMES) -> DataFrame:
    """(document_id, qa_start) of segments (document_id, i, speaker, text): the first Q&A segment, null if none.

    An operator's question introduction, or the segment after a company
    speaker's hand-off, once the company has spoken and a share of the text has
    passed."""
    before = Window.partitionBy("document_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("document_id")
    operator = F.lower(F.btrim("speaker")).isin(operators)
    rows = segments.withColumn("operator", operator).withColumns({
        "company_spoke": F.coalesce(F.max((~F.col("operator")).cast("int")).over(before), F.lit(0)) == 1,
        "share": F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) / F.greatest(F.sum(F.length("text")).over(whole), F.lit(1)),
        "last": F.max("i").over(whole),
    })
    ready = F.col("company_spoke") & (F.col("share") >= PREPARED_SHARE)
    asks = F.col("operator") & F.col("text").rlike(f"(?i)(?:{intro})")
    hands = ~F.col("operator") & F.expr(f"right(text, {HANDOFF_TAIL})").rlike(f"(?i)(?:{handoff})")
    start = F.when(asks, F.col("i")).otherwise(F.when(F.col("i") < F.col("last"), F.col("i") + 1))
    hit = F.when(ready & (asks | hands), F.struct(F.col("i").alias("i"), start.alias("start")))
    return rows.groupBy("document_id").agg(F.min(hit)["start"].alias("qa_start"))


def speaker_roles(segments: DataFrame, starts: DataFrame, operators: list[str] = OPERATOR_NAMES) -> DataFrame:
    """Segments with ``role``: Operator, Analyst or '' (company), and their section."""
    w = Window.partitionBy("document_id").orderBy("i")
    rows = segments.join(starts, "document_id").withColumn("operator", F.lower(F.btrim("speaker")).isin(operators))
    in_qa = F.coalesce(F.col("i") >= F.col("qa_start"), F.lit(False))
    # the set of presenters: all before the Q&A; without one (or with one from the start) all segments
    presents = ~F.col("operator") & (~in_qa | F.coalesce(F.col("qa_start") == 0, F.lit(False)))
    rows = rows.withColumns({"in_qa": in_qa, "after_operator": F.coalesce(F.lag("operator").over(w), F.lit(False))})
    by_name = Window.partitionBy("document_id", "speaker")
    led = F.max((F.col("in_qa") & F.col("operator")).cast("int")).over(Window.partitionBy("document_id")) == 1
    introduced = F.max((F.col("in_qa") & F.col("after_operator")).cast("int")).over(by_name) == 1
    asked = F.max(F.col("in_qa").cast("int")).over(by_name) == 1
    rows = rows.withColumns({"presented": F.max(presents.cast("int")).over(by_name) == 1, "led": led, "introduced": introduced, "asked": asked})
    analyst = ~F.col("presented") & F.when(F.col("led"), F.col("introduced")).otherwise(F.col("asked"))
    role = F.when(F.col("operator"), "Operator").when(analyst, "Analyst").otherwise("")
    return rows.select("document_id", "i", "speaker", "text", role.alias("role"), F.when(F.col("in_qa"), "qa").otherwise("prepared").alias("section"))


def segment_chunks(segments: DataFrame) -> DataFrame:
    """Sentences of speaker-segmented transcripts."""
    roles = speaker_roles(segments, qa_start(segments))
    who = F.when(F.col("role") == "Operator", "Operator").when(F.col("role") == "Analyst", F.concat("speaker", F.lit(" (Analyst)"))).otherwise(F.col("speaker"))
    parts = roles.select("document_id", "i", who.alias("speaker"), "section", F.posexplode(tx.sentences(tx.normalize(F.col("text")))).alias("pos", "text"))
    return _numbered(parts, "i", "pos")
