"""Requests, briefs found again, reports as rows and text, the command line."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from tidemark import __main__ as cli
from tidemark.operators import service

DAY = dt.date(2024, 3, 1)


def test_config_and_since(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"lookback_days": 3}))
    config = service.load_config(str(tmp_path / "c.json"))
    assert service.since(config, DAY) == "2024-02-27" and service.since(service.load_config()) is None
    assert service.since(config | {"since": "2023-01-01"}, DAY) == "2023-01-01"
    (tmp_path / "c.json").write_text('{"lookbak": 3}')
    with pytest.raises(ValueError, match="lookbak"):
        service.load_config(str(tmp_path / "c.json"))


def test_requests(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, "x" * 20_001), (4, "x" * 20_000)], "id int, text string")
    assert {r["id"]: r["problem"] for r in service.check_texts(rows).collect()} == {1: "empty", 2: "empty", 3: "too long", 4: None}
    assert service.check_pairs(spark.range(500)).count() == 500
    with pytest.raises(ValueError, match="500"):
        service.check_pairs(spark.range(501))


def scored(spark, score=0.5, ticker="AAA"):
    kind = "chunk_id long, ticker string, document_id string, doc_type string, doc_date date, section string, aspect string, score double, confidence double, model_name string"
    rows = [(1, ticker, "d1", "transcript", DAY, "prepared", "demand", score, 0.6, "m"), (2, ticker, "d1", "transcript", DAY, "qa", "demand", -0.5, 0.6, "m"),
            (3, ticker, "d0", "news", DAY - dt.timedelta(days=400), "body", "demand", 0.1, 0.6, "m")]
    return spark.createDataFrame(rows, kind)


def key(scores, backend="rules"):
    return service.brief_keys(scores, service.windows(scores), backend).first()["fingerprint"]


def test_fingerprints_follow_their_inputs(spark):
    s = scored(spark)
    assert key(s) == key(s.orderBy("score")) == key(scored(spark, 0.5001))  # three digits count
    assert len({key(s), key(scored(spark, 0.6)), key(scored(spark, ticker="BBB")), key(s, "other"), key(s.union(s.limit(1)))}) == 5
    assert service.brief_keys(s, service.windows(s)).first()["n"] == 2  # the old row is outside
    none = service.brief_keys(s, service.windows(s, start="2030-01-01", end="2030-02-01")).first()
    assert none["n"] == 0 and len(none["fingerprint"]) == 64
    with pytest.raises(LookupError, match="ZZZ"):
        service.windows(s, ["aaa", "zzz"])


def test_equal_inputs_reuse_the_newest_brief(spark):
    keys = service.brief_keys(scored(spark), service.windows(scored(spark)))
    mine = keys.first()["fingerprint"]
    briefs = spark.createDataFrame([(1, "AAA", mine), (2, "AAA", mine), (3, "AAA", "other")], "brief_id long, ticker string, fingerprint string")
    found, wanted = service.reuse(keys, briefs)
    assert [r["brief_id"] for r in found.collect()] == [2] and wanted.count() == 0
    found, wanted = service.reuse(keys, briefs, force=True)
    assert found.count() == 0 and wanted.count() == 1
    assert service.reuse(keys, briefs.where("brief_id = 3"))[1].count() == 1


def test_brief_sources_and_traces(spark):
    claim = "array<struct<cited:array<bigint>>>"
    briefs = spark.createDataFrame([(7, {"demand": ([([1, 2],)], [([2],)]), "margins": (None, [([3],)])})], f"brief_id long, sections map<string,struct<bull:{claim},bear:{claim}>>")
    assert sorted(r["chunk_id"] for r in service.citations(briefs).collect()) == [1, 2, 3]
    chunks = spark.createDataFrame([(1, "d", "t1", "qa", None), (2, "d", "t2", "qa", "A"), (9, "d", "t9", "qa", "A")], "chunk_id long, document_id string, text string, section string, speaker string")
    docs = spark.createDataFrame([("d", "T", DAY)], "document_id string, title string, doc_date date")
    assert sorted(r["text"] for r in service.brief_sources(briefs, chunks, docs).collect()) == ["t1", "t2"]
    traces = spark.createDataFrame([(7, 2, "b", "{}"), (7, 1, "a", "{}")], "brief_id long, step int, agent string, payload string")
    assert [t["agent"] for t in service.with_traces(briefs, traces).first()["traces"]] == ["a", "b"]
    assert service.with_traces(briefs, traces.limit(0)).first()["traces"] == []


def test_events_and_their_validity(spark):
    e = service.events(scored(spark)).first()
    assert (e["delta"], e["doc_level"], e["prepared"]) == (-1.0, 0.0, 0.5)
    rows = spark.createDataFrame([(float(i), float(i % 4), float(i * i % 7), None) for i in range(12)], "delta double, doc_level double, ret double, prepared double")
    got = {r["predictor"]: r for r in service.signal_validity(rows, "ret").collect()}
    assert got["prepared"]["n"] == 0 and got["prepared"]["spearman"] is None and got["prepared"]["low"] is None
    assert 0 < got["delta"]["pearson_p"] <= 1 and got["delta"]["low"] <= got["delta"]["spearman"] <= got["delta"]["high"]


def test_labels_and_reports(spark):
    labelled = spark.createDataFrame([("S001", "positive"), ("S002", "not about aspect"), ("S003", "neutral"), ("S004", "negative")], "item_id string, label string")
    known = spark.createDataFrame([(f"S00{i}", i, "positive", "neutral") for i in range(1, 5)], "item_id string, chunk_id long, pred_a string, pred_b string")
    gold, counts = service.kept_labels(labelled, known)
    assert tuple(counts.first()) == (4, 3, 1, 0.75) and sorted(r["chunk_id"] for r in gold.collect()) == [1, 3, 4]
    got = {(r["model"], r["label"]): r["recall"] for r in service.stored_against_labels(gold).collect()}
    assert got["pred_a", "positive"] == 1.0 and got["pred_b", "neutral"] == 1.0 and got["pred_b", "positive"] == 0.0
    rates = spark.createDataFrame([("b", 0.25, None, 0.5), ("a", 1.0, 0.125, 0.0)], "model string, error_all double, error_trap double, error_other double")
    assert service.failure_table(rates).splitlines()[2:] == ["| a | 100.0% | 12.5% | 0.0% |", "| b | 25.0% |  | 50.0% |"]
    moves = spark.createDataFrame([("AAA", "management_tone", 0.5, 0.1, -0.4, DAY)], "ticker string, aspect string, from_mean double, to_mean double, change double, to_date date")
    assert "AAA, management tone: +0.50 to +0.10 (down -0.40 on 2024-03-01)" in service.digest(moves)
    assert "None" in service.digest(moves.limit(0))
    run = service.run_rows(spark, "m", {"x": "y" * 300}, {"f1": 1}, dt.datetime(2024, 1, 2, 3, 4, 5)).first()
    assert run["version"] == "20240102030405" and len(run["params"]["x"]) == 250 and run["metrics"]["f1"] == 1.0


def test_candidates_are_calls_of_fit_length(spark):
    pairs = spark.createDataFrame([(i, "demand", "a", "b") for i in range(1, 5)], "chunk_id long, aspect string, pred_a string, pred_b string")
    chunks = spark.createDataFrame([(1, "d", "x" * 40, "qa", "A", 0), (2, "d", "x" * 39, "qa", "A", 1), (3, "d", "x" * 401, "qa", "A", 2), (4, "n", "x" * 50, "qa", "A", 0)],
                                   "chunk_id long, document_id string, text string, section string, speaker string, idx int")
    docs = spark.createDataFrame([("d", "AAA", "transcript", DAY), ("n", "AAA", "news", DAY)], "document_id string, ticker string, doc_type string, doc_date date")
    assert [r["chunk_id"] for r in service.candidates(pairs, chunks, docs).collect()] == [1]


def test_views_answer_sql(spark):
    names = service.views(scored(spark), scored(spark).select("document_id", "ticker", "doc_type", "doc_date").distinct())
    assert names == ["aspect_points", "aspect_watchlist", "aspect_moves"]
    assert spark.sql("SELECT count(*) AS n FROM aspect_points").first()["n"] == 2


def test_command_line(spark, capsys, tmp_path):
    assert cli.main(["analyze", "Gross margin expanded to 45% this quarter."], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["aspect"] for x in lines] == ["margins"] and lines[0]["label"] == "positive"
    assert cli.main(["analyze", ""], spark) == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ACM_transcript_2024-03-01.txt").write_text("TITLE: Call\nJane Doe -- CFO: Gross margin expanded to 45% this quarter. Demand was strong across regions.\n")
    (tmp_path / "c.json").write_text(json.dumps({"sources": {"sample": {"path": str(tmp_path / "in")}}}))
    assert cli.main(["daily", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")], spark) == 0
    assert "Largest moves" in capsys.readouterr().out
    assert cli.main(["keys", str(tmp_path / "out"), "acm"], spark) == 0
    assert json.loads(capsys.readouterr().out)["n"] > 0
