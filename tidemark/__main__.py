"""Command line: ``python -m tidemark daily|analyze|keys|study|gold|audit ...``; results as JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.polarity import resolve_model
from tidemark.functions.lexicons import FINANCE
from tidemark.operators import aspects, evaluation, grounding, sampling, service
from tidemark.operators.daily import daily
from tidemark.sources import commits, plugins, readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    does = top.add_subparsers(dest="does", required=True)
    run = does.add_parser("daily", help="ingest, score, brief and report what is new")
    run.add_argument("root")
    run.add_argument("--config")
    text = does.add_parser("analyze", help="scores of one text")
    text.add_argument("text")
    text.add_argument("--model")
    keys = does.add_parser("keys", help="fingerprints of a ticker's brief inputs")
    keys.add_argument("root")
    keys.add_argument("ticker")
    keys.add_argument("--start")
    keys.add_argument("--end")
    study = does.add_parser("study", help="models x horizons against returns (CSV: ticker, date and a column per horizon)")
    study.add_argument("root")
    study.add_argument("returns")
    gold = does.add_parser("gold", help="sentences to label, disagreements of two models first")
    gold.add_argument("root")
    gold.add_argument("model_a")
    gold.add_argument("model_b")
    gold.add_argument("--per-aspect", type=int, default=50)
    audit = does.add_parser("audit", help="claims for people to judge, or the scores of a judged sheet (CSV: status, human_ok)")
    audit.add_argument("root")
    audit.add_argument("--n", type=int)
    audit.add_argument("--score")
    return top


def stored(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The documents and, with their dates and tickers, the scores under ``root``."""
    documents = commits.Store(spark, root).read("documents")
    if documents is None:
        raise SystemExit(f"nothing is stored under {root}")
    documents = documents.select("document_id", "ticker", "doc_type", "doc_date")
    return documents, spark.read.parquet(f"{root}/scores").join(documents, "document_id")


def verified_claims(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The strongest claims of each ticker, verified, and the sentences that they cite."""
    top = grounding.evidence_topk(scores.withColumn("similarity", F.lit(0.0)))
    one = Window.partitionBy("chunk_id").orderBy(F.desc("strength"), "aspect")
    sources = top.withColumn("rn", F.row_number().over(one)).where("rn = 1")
    return grounding.verify(grounding.greedy_claims(top), sources), sources


def show(rows: DataFrame) -> None:
    """One JSON line a row, row by row."""
    for r in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        print(r["j"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    if a.does == "daily":
        config = service.load_config(a.config)
        start = service.since(config)
        plugins.register(spark)
        dated = {"since": start} if start else {}
        known = set(readers.READERS) | {x.name() for x in plugins.SOURCES}
        # a source whose options name no company is asked for each on the watchlist
        per = {n: config["watchlist"] or [None] if n not in ("sample", "transcripts") and "ticker" not in o else [None] for n, o in config["sources"].items()}
        requests = [plugins.Request(n, dated | o, t) for n, o in config["sources"].items() if n in known for t in per[n]]
        documents, failures = plugins.fetch_all(spark, requests)
        for f in failures:
            print(f"{f.source} {f.ticker or ''}: {f.error}", file=sys.stderr)
        if documents is None:
            return 1 if failures else 0
        got = daily(documents, a.root, resolve_model(config["model"]))
        print(service.digest(got.moves, got.drift))
    elif a.does == "analyze":
        rows = service.check_texts(spark.createDataFrame([(1, a.text)], "id int, text string"))
        if problem := rows.first()["problem"]:
            print(f"text: {problem}", file=sys.stderr)
            return 2
        show(aspects.analyze(rows, resolve_model(a.model)).orderBy("idx", "aspect"))
    elif a.does == "study":
        _, scores = stored(spark, a.root)
        returns = spark.read.csv(a.returns, header=True, inferSchema=True)
        returns = returns.withColumns({"ticker": F.upper("ticker"), "date": F.to_date("date")})
        horizons = [c for c in returns.columns if c not in ("ticker", "date")]
        show(evaluation.study(service.study_events(scores), returns, horizons, ["delta", "doc_level"]).orderBy("model", "horizon", "predictor"))
    elif a.does == "gold":
        documents, scores = stored(spark, a.root)
        pairs = evaluation.disagreements(scores, a.model_a, a.model_b).join(scores.select("chunk_id", "ticker", "text").distinct(), "chunk_id")
        items = sampling.stratified_sample(pairs, list(FINANCE.terms), a.per_aspect)
        show(items.join(pairs.select("chunk_id", "text").distinct(), "chunk_id").drop("agree").orderBy("item_id"))
    elif a.does == "audit":
        if a.score:
            judged = spark.read.csv(a.score, header=True).select("status", (F.lower("human_ok").isin("1", "true", "yes", "y")).alias("human_ok"))
            show(evaluation.audit_scores(judged))
        else:
            show(grounding.audit_export(*verified_claims(stored(spark, a.root)[1]), a.n))
    else:
        documents, scores = stored(spark, a.root)
        asked = service.windows(documents, [a.ticker], a.start, a.end)
        show(service.brief_keys(scores, asked))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
