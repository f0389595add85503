"""Live trajectories and drift: equal to the batch results after restarts, late rows and rows that come too late."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals
from tidemark.streaming import ingest, stateful

SCHEMA = "ts timestamp, chunk_id long, ticker string, aspect string, document_id string, doc_type string, section string, score double, confidence double"


def rows_of(days, rng):
    out = []
    for d in days:
        for t in ("A", "B"):
            for i in range(rng.randrange(1, 9)):
                at = dt.datetime(2024, 1, 1) + dt.timedelta(days=d, seconds=rng.randrange(86400))
                out.append((at, d * 100 + i, t, rng.choice("xyz"), f"{t}{d}", "transcript", rng.choice(["prepared", "qa"]), rng.uniform(-1, 1), rng.choice([0.4, 0.6, 0.9])))
    return out


@pytest.fixture(scope="module")
def fed(spark, tmp_path_factory):
    """Three starts on one checkpoint: late rows of an open day count, a row of a closed day doesn't."""
    root = tmp_path_factory.mktemp("stream")
    rng = random.Random(7)
    first, second = rows_of(range(0, 30), rng), rows_of(range(30, 60), rng)
    late = [r for r in rows_of([28, 29], rng)]  # the watermark stands at day 28.x after the first part
    too_late = [(dt.datetime(2024, 1, 3), 1, "A", "x", "A2", "transcript", "qa", 1.0, 0.9)]
    last = [(dt.datetime(2024, 3, 20), 1, "C", "x", "C0", "transcript", "qa", 1.0, 0.9)]  # moves the watermark past all else
    (root / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{root}/in")
    parts = {"points": stateful.live_trajectory(stream, "2 days"), "drift": stateful.live_drift(stream, ["x", "y", "z"], "2 days")}
    for part in ([first], [late, second], [too_late], [last]):
        for rows in part:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{root}/in")
        for name, df in parts.items():
            stateful.run_available(df, f"file://{root}/{name}", f"file://{root}/checkpoint-{name}", 180)
    batch = spark.createDataFrame([r for r in first + late + second], SCHEMA).withColumn("doc_date", F.to_date("ts"))
    return {name: spark.read.parquet(f"file://{root}/{name}").collect() for name in parts}, batch


def test_live_points_equal_the_batch(fed):
    got, batch = fed
    want = {(r["ticker"], r["aspect"], r["document_id"]): r for r in signals.trajectory(batch).collect()}
    have = {(r["ticker"], r["aspect"], r["document_id"]): r for r in got["points"] if r["ticker"] != "C"}
    assert len(have) == len([r for r in got["points"] if r["ticker"] != "C"]) and set(have) == set(want)
    for k, r in have.items():
        assert (r["doc_type"], r["doc_date"], r["n"]) == (want[k]["doc_type"], want[k]["doc_date"], want[k]["n"])
        for c in ("mean", "prepared", "qa"):
            assert r[c] == pytest.approx(want[k][c], abs=1.01e-4) if want[k][c] is not None else r[c] is None or math.isnan(r[c])


def test_live_drift_equals_the_batch(fed):
    got, batch = fed
    want = {(r["ticker"], r["as_of"]): r for r in signals.drift_series(batch, ["x", "y", "z"], total=False).collect()}
    have = {(r["ticker"], r["as_of"]): r for r in got["drift"] if r["ticker"] != "C"}
    assert set(have) == set(want) and len(want) == 120
    for k, r in have.items():
        assert (r["cur_n"], r["base_n"], r["status"]) == (want[k]["cur_n"], want[k]["base_n"], want[k]["status"])
        assert (r["psi"], r["shift"]) == (pytest.approx(want[k]["psi"], abs=1.01e-4), pytest.approx(want[k]["shift"], abs=1.01e-4))
    assert {r["status"] for r in want.values()} == {"ok", "insufficient_data"}


def test_windowed_means_and_distinct_documents(spark, tmp_path):
    rng = random.Random(9)
    rows = rows_of(range(0, 25), rng)
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :], [(dt.datetime(2024, 3, 20), 1, "C", "x", "C0", "transcript", "qa", 1.0, 0.9)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stateful.run_available(ingest.windowed_means(stream, "7 days", "30 days"), f"{tmp_path}/means", f"{tmp_path}/c1", 180)
    got = {(r["start"], r["ticker"], r["aspect"]): (r["mean"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/means").collect()}
    batch = spark.createDataFrame(rows, SCHEMA).groupBy(F.window("ts", "7 days").start.alias("start"), "ticker", "aspect").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    want = {(r["start"], r["ticker"], r["aspect"]): (r["mean"], r["n"]) for r in batch.collect()}
    assert set(got) == set(want) and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)

    hashed = stream.withColumn("content_hash", F.col("document_id"))
    stateful.run_available(ingest.distinct_documents(hashed, "30 days"), f"{tmp_path}/docs", f"{tmp_path}/c2", 180)
    ids = [r["document_id"] for r in spark.read.parquet(f"{tmp_path}/docs").collect()]
    assert sorted(ids) == sorted({r[4] for r in rows} | {"C0"})


def test_live_queries_equal_the_batch_queries(spark):
    """All days that the watermark closes: a day before the last."""
    from tidemark.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    live = {(r["ticker"], r["as_of"]): (r["cur_n"], r["base_n"], r["status"]) for r in QUERIES["live_drift"](spark, sf).collect()}
    batch = {(r["ticker"], r["as_of"]): (r["cur_n"], r["base_n"], r["status"]) for r in QUERIES["drift_series"](spark, sf).where("ticker <> 'ALL'").collect()}
    last = max(d for _, d in batch)
    closed = {k: v for k, v in batch.items() if k[1] < last - dt.timedelta(days=1)}
    assert closed.items() <= live.items() <= batch.items()
    points = {(r["ticker"], r["aspect"], r["document_id"]): r["n"] for r in QUERIES["live_trajectory"](spark, sf).collect()}
    whole = {(r["ticker"], r["aspect"], r["document_id"]): (r["n"], r["doc_date"]) for r in QUERIES["aspect_trajectory"](spark, sf).collect()}
    assert {k for k, v in whole.items() if v[1] < last - dt.timedelta(days=1)} <= set(points) and all(whole[k][0] == n for k, n in points.items())
