"""Transcripts, grounding, events, sinks and streaming on small fixtures."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, grounding, signals, transcripts
from tidemark.sources import readers, sinks
from tidemark.streaming.ingest import ingest_available

CALL = [
    ("Operator", "Welcome. There will be a question-and-answer session later."),
    ("Ann Lee", "Revenue grew this quarter across all of our regions and we are pleased with that."),
    ("Bob Ray", "Margins were stable and cash flow was good. We see more of this ahead."),
    ("Operator", "Our first question comes from the line of Cy Fox."),
    ("Cy Fox", "What about costs?"),
    ("Ann Lee", "Costs fell."),
]


def segments(spark, rows, document=1):
    return spark.createDataFrame([(document, i, s, t) for i, (s, t) in enumerate(rows)], "document_id long, i long, speaker string, text string")


def test_qa_start_and_roles(spark):
    s = segments(spark, CALL)
    start = transcripts.qa_start(s)
    assert start.first()["qa_start"] == 3
    roles = {r["i"]: r["role"] for r in transcripts.speaker_roles(s, start).collect()}
    assert roles == {0: "Operator", 1: "", 2: "", 3: "Operator", 4: "Analyst", 5: ""}
    chunks = transcripts.segment_chunks(s).orderBy("idx").collect()
    assert [c["idx"] for c in chunks] == list(range(len(chunks)))
    assert {c["section"] for c in chunks} == {"prepared", "qa"}


def test_company_hands_off(spark):
    rows = [("A", "We did well in this period and in the one before it."), ("B", "We will now take your questions."), ("C", "Why?")]
    assert transcripts.qa_start(segments(spark, rows)).first()["qa_start"] == 2
    assert transcripts.qa_start(segments(spark, rows[:1])).first()["qa_start"] is None


def test_line_transcript(spark):
    text = "Jane Doe -- CFO: Revenue rose. Costs fell.\nMore text here.\nQuestion-and-Answer Session\nOperator: Next question.\nSam Poe: Why?"
    got = transcripts.line_chunks(spark.createDataFrame([(1, text)], "document_id long, text string")).orderBy("idx").collect()
    assert got[0]["speaker"] == "Jane Doe (CFO)" and got[0]["section"] == "prepared"
    assert got[-1]["speaker"] == "Sam Poe" and got[-1]["section"] == "qa"


def test_claims_are_checked_in_order(spark):
    evidence = spark.createDataFrame([(1, "Gross margin expanded to 42% on strong demand", 0.8), (2, "Costs were flat", -0.6)], "chunk_id long, text string, score double")
    rows = [
        ("ok", "Gross margin expanded to 42% on strong demand", [1]), ("none", "anything", []), ("missing", "anything", [9]),
        ("number", "Gross margin expanded to 45% on strong demand", [1]), ("partial", "Gross margin expanded to 42% on strong demand", [1, 9]),
        ("against", "Costs strong improved", [2]), ("weak", "Something unrelated entirely", [1]),
    ]
    claims = spark.createDataFrame([("T", i, t, c) for i, t, c in rows], "ticker string, claim_id string, text string, cited array<long>")
    got = {r["claim_id"]: r["status"] for r in grounding.verify(claims, evidence).collect()}
    assert got == {"ok": "supported", "none": "rejected", "missing": "rejected", "number": "rejected", "partial": "unverified", "against": "rejected", "weak": "unverified"}


def test_greedy_claims_use_each_aspect_and_sentence_once(spark):
    rows = [(1, "T", "margins", 0.9, 0.9), (1, "T", "demand", 0.8, 0.9), (2, "T", "demand", 0.7, 0.5), (3, "T", "margins", 0.6, 0.9), (4, "T", "demand", -0.5, 0.5)]
    e = spark.createDataFrame(rows, "chunk_id long, ticker string, aspect string, score double, confidence double")
    e = e.withColumns({"similarity": F.lit(0.0), "doc_date": F.lit("2025-01-01").cast("date"), "section": F.lit("qa"), "text": F.lit("a sentence")})
    got = [(r["claim_id"], r["aspect"], r["cited"]) for r in grounding.greedy_claims(grounding.evidence_topk(e)).orderBy("claim_id").collect()]
    assert got == [("bl1", "margins", [1]), ("bl2", "demand", [2]), ("br1", "demand", [4])]


def test_event_returns(spark):
    days = [dt.date(2025, 1, 1) + dt.timedelta(days=i) for i in range(15)]
    stock = spark.createDataFrame([("S", d, 100.0 if i < 3 else 110.0) for i, d in enumerate(days)], "symbol string, day date, close double")
    market = spark.createDataFrame([(d, 100.0 if i < 3 else 102.0) for i, d in enumerate(days)], "day date, close double")
    calls = spark.createDataFrame([("S", dt.datetime(2025, 1, 3, 17)), ("S", dt.datetime(2025, 1, 14, 9))], "symbol string, call_at timestamp_ntz")
    got = evaluation.event_returns(calls, stock, market).collect()
    assert [(r["day0"], r["car_0_1"], r["car_0_4"], r["drift_2_11"]) for r in got] == [(days[3], pytest.approx(0.08), pytest.approx(0.08), pytest.approx(0.0))]


def test_drift_needs_enough_rows(spark):
    rows = [("A", "x" if i < 8 else "y", dt.date(2025, 1, 10 if i < 8 else 30), 0.5 + i / 100) for i in range(16)] + [("B", "x", dt.date(2025, 1, 30), 0.5)]
    s = spark.createDataFrame(rows, "ticker string, aspect string, doc_date date, confidence double")
    got = {r["ticker"]: r for r in signals.drift(s, ["x", "y"]).collect()}
    assert len(got) == 3 and got["A"]["psi"] > 0.25 and got["A"]["alert"] and got["B"]["status"] == "insufficient_data"


def test_statistics(spark):
    assert evaluation.t_pvalue(2.0, 10) == pytest.approx(0.07339, abs=1e-4)
    df = spark.createDataFrame([(g, float(x), 2.0 * x + (3 if g == "a" else 0)) for g in "ab" for x in range(6)], "g string, x double, y double")
    fit = evaluation.ols_fixed_effects(df, "y", ["x"], "g")
    assert fit["coef"]["x"] == pytest.approx(2.0) and fit["r2_within"] == pytest.approx(1.0)
    got = evaluation.bootstrap_ci(df, "x", "y", samples=60).first()
    assert got["low"] <= got["high"]


def test_ingest_twice_adds_nothing(spark, tmp_path):
    rows = [("ACME", "transcript", dt.date(2025, 1, 1), "t", None, "Ann Lee: Revenue rose. Costs fell in the quarter.", [("Ann", "Revenue rose. Costs fell.")], "s"),
            ("ACME", "10-Q", dt.date(2025, 2, 1), "t", None, "Liquidity was adequate. Debt declined.", None, "s"), ("ACME", "10-Q", dt.date(2025, 2, 2), "t", None, "short", None, "s"),
            (None, "10-Q", dt.date(2025, 2, 1), "t", None, "No ticker on this one at all.", None, "s")]
    docs = spark.createDataFrame(rows, f"ticker string, doc_type string, doc_date date, title string, source_url string, text string, segments {readers.SEGMENTS}, source string")
    first, second = sinks.ingest(docs, str(tmp_path)), sinks.ingest(docs, str(tmp_path))
    assert (first["new"], first["failures"], second["new"], second["duplicates"]) == (2, 1, 0, 2)
    assert {r["section"] for r in spark.read.parquet(f"{tmp_path}/chunks").collect()} == {"prepared", "mdna"}


def test_stream_ingests_what_arrives_once(spark, tmp_path):
    schema = f"ticker string, doc_type string, doc_date date, title string, source_url string, text string, segments {readers.SEGMENTS}, source string"
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"ticker": "T", "doc_type": "news", "doc_date": "2025-01-01", "text": f"A story about orders, number {i // 2}."}))
        ingest_available(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/documents").count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "ACME_transcript_2025-01-02.txt").write_text("TITLE: Call\nAnn: Hello there.")
    (tmp_path / "bad.txt").write_text("x")
    got = readers.text_files(spark, str(tmp_path)).collect()
    assert [(r["ticker"], r["doc_type"], str(r["doc_date"]), r["title"], r["text"]) for r in got] == [("ACME", "transcript", "2025-01-02", "Call", "Ann: Hello there.")]
    with pytest.raises(ValueError, match="not tickers"):
        readers.check_tickers(["A'; DROP"])
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>u</link><description>&lt;p&gt;Body&lt;/p&gt;</description><pubDate>Thu, 02 Jan 2025 10:00:00 GMT</pubDate></item></channel></rss>")
    news = readers.news_feed(spark, f"{tmp_path}/feed.xml", "acme").first()
    assert (news["ticker"], str(news["doc_date"])) == ("ACME", "2025-01-02") and "Body" in news["text"]
    text = spark.createDataFrame([("Contents Item 2. MDNA Item 3. Risk " + "x " * 10 + "Item 2. MDNA " + "word " * 60 + "Item 3. Risk end",)], "t string")
    section = text.select(readers.mdna_section(F.col("t"), r"item 2\. mdna", r"item 3\. risk").alias("s")).first()["s"]
    assert section.startswith("Item 2. MDNA word") and "Risk" not in section


def plain_directional(text, aspect, lexicon):
    import re

    from tidemark.functions.lexicons import NEGATIVE_EVENTS, POSITIVE_EVENTS
    from tidemark.functions.text import TOKEN

    found = lambda words, x: re.search(rf"(?i)\b(?:{words})\b", x) is not None
    bad = found(lexicon.bad_when_up, text) and not found(lexicon.good_when_up, text.split(" and ")[0])
    bad = bad or (aspect == "litigation" and re.search(r"(?i)\b(legal|litigation) (expense|cost)s?\b", text) is not None)
    toks, total, moved = [x.lower() for x in re.findall(TOKEN, text)], 0.0, False
    for i, tok in enumerate(toks):
        cue = lambda t: t in lexicon.cues or t.endswith("n't")
        before = [1 if cue(t) else 2 for t in toks[max(0, i - 4) : i] if cue(t) or t in lexicon.breaks]
        masked = not cue(tok) and tok not in lexicon.breaks and bool(before) and before[-1] == 1
        up = -1.0 if bad else 1.0
        value = 0.0
        if tok in lexicon.up:
            value, moved = up, True
        elif tok in lexicon.down:
            value, moved = -up, True
        elif tok in lexicon.positive:
            value = 0.8
        elif tok in lexicon.negative:
            value = -0.8
        elif aspect == "management_tone" and tok in lexicon.uncertainty:
            value = -0.6
        moved = moved or tok in lexicon.up or tok in lexicon.down
        total += -value if masked else value
    total += (-1.0 if found(NEGATIVE_EVENTS, text) else 0.0) + (1.0 if found(POSITIVE_EVENTS, text) else 0.0)
    if aspect == "litigation":
        total = 0.0 if not moved and abs(total) < 0.5 else total
        total += 1.5 if re.search(r"(?i)\b(do not|does not|don't|no) (?:expect|anticipate)\b.*\b(impact|charge|effect)", text) else 0.0
    return max(-1.0, min(1.0, total / 2))


def test_the_default_model_equals_a_plain_loop(spark):
    from tidemark.functions import polarity
    from tidemark.functions.lexicons import FINANCE
    from tidemark.plans import adapters as ad

    own = ["Margins improved and costs fell.", "We do not expect any material impact.", "Legal costs increased.", "Demand wasn't strong, but orders rose.", "Uncertain outlook, no growth.", "The suit was settled and dismissed."]
    driver = [r["text"] for r in ad.corpus_chunks(spark, "/root/testdata/sf0.001").where("document_id % 5 = 0").collect() if r["text"].isascii()]
    for lexicon, texts in ((FINANCE, own + driver[:200]), (ad.SYLLABLES, driver)):
        rows = [(i, t, a) for i, t in enumerate(texts) for a in ("margins", "litigation", "management_tone")]
        df = spark.createDataFrame(rows, "i int, t string, a string")
        got = df.select("t", "a", polarity.directional_score(F.col("t"), F.col("a"), lexicon).alias("s")).collect()
        for r in got:
            assert abs(r["s"] - plain_directional(r["t"], r["a"], lexicon)) < 1e-9, (r["t"], r["a"])


def test_a_crash_between_the_two_writes_leaves_no_repeats(spark, tmp_path, monkeypatch):
    from tidemark.sources import sinks

    text = "Revenue grew strongly this year. Costs ﬁnally fell a little. Nothing else changed."
    schema = "source string, ticker string, doc_type string, doc_date date, title string, source_url string, text string, segments array<struct<speaker:string,text:string>>"
    docs = spark.sql("SELECT 'x' source, 'T' ticker, 'news' doc_type, date'2024-01-01' doc_date, 't' title, 'u' source_url, '" + text + "' text, cast(null as array<struct<speaker:string,text:string>>) segments")
    assert [f.name for f in docs.schema] == [x.split()[0] for x in schema.split(", ")]
    whole = sinks.read
    from pyspark.sql import DataFrameWriter

    parquet = DataFrameWriter.parquet

    def dies(self, path, *args, **kw):
        if path.endswith("/documents"):
            raise RuntimeError("lost")
        return parquet(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(RuntimeError):
        sinks.ingest(docs, str(tmp_path))
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    assert sinks.ingest(docs, str(tmp_path))["new"] == 1
    chunks = whole(spark, f"{tmp_path}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == 3
    assert any("finally" in r["text"] for r in chunks.collect())
    assert sinks.ingest(docs, str(tmp_path))["new"] == 0 and whole(spark, f"{tmp_path}/chunks").count() == 3


def test_day0_of_one_symbol_is_linear(spark):
    import time

    from tidemark.operators import evaluation

    calls = spark.range(48_000).select(F.lit("S").alias("symbol"), (F.lit("2020-01-01 10:00:00").cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(id % 30000 as int))")).alias("call_at"))
    days = spark.range(1200).where("id % 7 < 5").select(F.lit("S").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    evaluation.day0(calls.limit(10), days).collect()
    start = time.time()
    rows = evaluation.day0(calls, days).collect()
    assert time.time() - start < 8 and len(rows) == 48_000
    open_ = sorted(r["day"] for r in days.collect())
    import bisect
    from datetime import timedelta

    for r in rows[::997]:
        want = r["call_at"].date() + timedelta(days=r["call_at"].hour >= 16)
        at = bisect.bisect_left(open_, want)
        assert r["day0"] == (open_[at] if at < len(open_) else None)
