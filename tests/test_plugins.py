"""Data sources by name: what they read, what they skip, and runs that one bad source doesn't stop."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import plugins, readers


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    plugins.register(spark)
    root = tmp_path_factory.mktemp("landing")
    for d in ("filings", "feed", "nse"):
        (root / d).mkdir()
    body = "<html><style>x{}</style><p>Item 7. Discussion</p><p>contents</p><p>Item 7. Discussion</p><p>" + "Sales &amp; margins rose. " * 30 + "</p><p>Item 8. Statements</p>tail</html>"
    for t in ("ACME", "BETA"):
        for day in ("2024-03-01", "2025-03-01"):
            (root / f"filings/{t}_10-K_{day}.html").write_text(body)
    (root / "filings/nodate_x.html").write_text(body)
    items = "".join(f"<item><title>T{i}</title><link>u{i}</link><description>&lt;b&gt;News&lt;/b&gt; {i}</description><pubDate>Thu, {i + 1} Jan 2025 10:00:00 GMT</pubDate></item>" for i in range(20))
    (root / "feed/ACME.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    (root / "nse/ACME.json").write_text(json.dumps([{"an_dt": "02-Jan-2025 10:00", "desc": "d", "attchmntText": "t", "attchmntFile": "f"}, {"an_dt": "bad"}]))
    return root


def load(spark, name, path, **options):
    return spark.read.format(name).option("path", f"file://{path}").options(**options).load()


def test_sources_read_their_folders(spark, landing):
    got = load(spark, "tidemark_filings", landing / "filings", start=r"item 7\. discussion", end=r"item 8\.").collect()
    assert {(r["ticker"], r["doc_type"], r["doc_date"].year) for r in got} == {(t, "10-K", y) for t in ("ACME", "BETA") for y in (2024, 2025)}
    assert all(r["text"].startswith("Item 7. Discussion Sales & margins") and "tail" not in r["text"] and r["source"] == "filings" for r in got)
    news = load(spark, "tidemark_feed", landing / "feed").collect()
    assert len(news) == readers.FEED_ITEMS and news[0]["text"] == "T0\nNews 0" and {r["ticker"] for r in news} == {"ACME"} and news[0]["doc_date"] == dt.date(2025, 1, 1)
    assert len(load(spark, "tidemark_feed", landing / "feed", items=3).collect()) == 3
    told = load(spark, "tidemark_announcements", landing / "nse", ticker="xyz").collect()
    assert [(r["ticker"], r["doc_date"], r["text"]) for r in told] == [("XYZ", dt.date(2025, 1, 2), "t")]


def test_filters_are_pushed_and_skip_files(spark, landing, monkeypatch):
    rows = load(spark, "tidemark_filings", landing / "filings")
    some = rows.where((F.col("ticker") == "BETA") & (F.col("doc_date") >= dt.date(2025, 1, 1)))
    assert [(r["ticker"], r["doc_date"].year) for r in some.collect()] == [("BETA", 2025)]
    # a file that can't match is never opened: make it unreadable
    (landing / "filings/GAMMA_10-K_2025-01-01.html").mkdir()
    reader = plugins.Filings({"path": f"file://{landing}/filings"}).reader(None)
    rest = list(reader.pushFilters([plugins.EqualTo(("ticker",), "BETA"), plugins.GreaterThan(("doc_date",), dt.date(2024, 3, 1)), plugins.EqualTo(("title",), "x")]))
    assert [f.attribute for f in rest] == [("title",)]
    assert [p.path.rsplit("/", 1)[-1] for p in reader.partitions() if "nodate" not in p.path] == ["BETA_10-K_2025-03-01.html"]
    (landing / "filings/GAMMA_10-K_2025-01-01.html").rmdir()
    assert rows.where("ticker IN ('ACME', 'X')").count() == 2 and rows.where("title IS NULL").count() == 4


def test_one_bad_source_stops_no_other(spark, landing):
    (landing / "feed/BROKEN.xml").write_text("<rss><item>")
    waits = []
    requests = [
        plugins.Request("tidemark_feed", {"path": f"file://{landing}/feed"}, "ACME"),
        plugins.Request("tidemark_filings", {"path": f"file://{landing}/filings", "since": "2025-01-01"}),
        plugins.Request("tidemark_announcements", {"path": f"file://{landing}/missing"}, "ACME"),
        plugins.Request("nobody", {"path": "x"}),
        plugins.Request("announcements", {"path": f"file://{landing}/nse"}, "ACME"),
    ]
    got, failures = plugins.fetch_all(spark, requests, retries=2, wait=waits.append)
    assert [(f.source, f.ticker) for f in failures] == [("tidemark_feed", "ACME"), ("tidemark_announcements", "ACME")]
    assert "FileNotFoundError" in failures[1].error and "ParseError" in failures[0].error
    assert waits == [0, 1, 0, 1]
    assert {(r["source"], r["count"]) for r in got.groupBy("source").count().collect()} == {("filings", 2), ("announcements", 1)}
    (landing / "feed/BROKEN.xml").unlink()
    got, failures = plugins.fetch_all(spark, requests[:1])
    assert got.count() == readers.FEED_ITEMS and not failures
    assert plugins.fetch_all(spark, []) == (None, [])


def test_pages_are_read_by_row_group(spark, tmp_path):
    plugins.register(spark)
    spark.range(1000).selectExpr("concat('https://site', id % 3, '.example.org/', id) AS url", "concat('<p>page ', id, '</p>') AS html").coalesce(1).write.option("parquet.block.size", 8192).parquet(f"{tmp_path}/pages")
    pages = spark.read.format("tidemark_pages").option("path", f"file://{tmp_path}/pages").option("fetched", "2025-02-03").load()
    assert pages.count() == 1000 and pages.rdd.getNumPartitions() >= 1
    assert pages.where("ticker = 'SITE1'").count() == 333 and pages.where("doc_date > date'2025-02-03'").count() == 0
    assert {r["text"] for r in pages.limit(3).collect()} <= {f"page {i}" for i in range(1000)}
