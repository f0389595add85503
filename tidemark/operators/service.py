"""What a service over the tables answers: checked requests, briefs found again, reports as rows and text.

``briefs``: brief_id, ticker, fingerprint, sections (aspect to bull and bear
claims with ``cited`` ids).
"""

from __future__ import annotations

import datetime as dt
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.lexicons import FINANCE, Lexicon
from tidemark.functions.text import half_up, mean_half_up
from tidemark.operators import evaluation, signals

MOST_CHARS, MOST_PAIRS, PARAM_CHARS = 20_000, 500, 250
NOTICE = "Measured sentiment of texts, not investment advice."
CONFIG = {"watchlist": [], "sources": {}, "since": None, "lookback_days": 0, "model": "lm_directional"}


# --- requests -------------------------------------------------------------


def load_config(path: str | None = None) -> dict:
    """The defaults with the keys of a JSON or YAML file: the one named, else the one that TIDEMARK_CONFIG names; an unknown key raises."""
    path = path or os.environ.get("TIDEMARK_CONFIG")
    given = {}
    if path:
        text = Path(path).read_text()
        if path.endswith((".yml", ".yaml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("YAML settings need the yaml package; JSON ones don't") from e
            given = yaml.safe_load(text) or {}
        else:
            given = json.loads(text)
    if unknown := sorted(set(given) - set(CONFIG)):
        raise ValueError(f"unknown settings: {unknown}")
    return CONFIG | given


def since(config: dict, today: dt.date | None = None) -> str | None:
    """The first date to read: a fixed one, else some days back, else none."""
    if config.get("since"):
        return str(config["since"])
    days = int(config.get("lookback_days") or 0)
    return str((today or dt.date.today()) - dt.timedelta(days=days)) if days else None


def check_texts(texts: DataFrame, text: str = "text", most: int = MOST_CHARS) -> DataFrame:
    """``texts`` with ``problem``: 'empty' (null too), 'too long' or null."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return texts.withColumn("problem", F.when(n == 0, "empty").when(n > most, "too long"))


def check_pairs(pairs: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """``pairs`` as they are; more than ``most`` rows raise."""
    if pairs.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} pairs in one request")
    return pairs


def health(spark: SparkSession, lexicon: Lexicon = FINANCE) -> DataFrame:
    return spark.createDataFrame([(list(lexicon.terms), NOTICE)], "aspects array<string>, notice string")


def views(scores: DataFrame, documents: DataFrame) -> list[str]:
    """Temporary views for SQL users: aspect_points, aspect_watchlist and aspect_moves; returns their names."""
    points = signals.trajectory(scores)
    made = {"aspect_points": points, "aspect_watchlist": signals.watchlist(scores, documents), "aspect_moves": signals.top_moves(points, documents, n=10)}
    for name, rows in made.items():
        rows.createOrReplaceTempView(name)
    return list(made)


def aspect_prompt(aspect: Column) -> Column:
    """How a sentence-pair model is told the aspect."""
    return F.concat(F.lit("aspect: "), F.replace(aspect, F.lit("_"), F.lit(" ")))


# --- briefs ----------------------------------------------------------------


def brief_keys(scores: DataFrame, windows: DataFrame, backend: str = "rules", model: str | None = None) -> DataFrame:
    """(ticker, window_start, window_end, fingerprint, n) of the scores inside each ticker's window.

    Equal windows, backend and multisets of (sentence, aspect, rounded score,
    model) give equal fingerprints.  The rows are summed as two 60-bit digests
    and a count, so no ticker is gathered in one place; a ticker without scores
    in its window has n = 0."""
    line = F.concat_ws("|", F.col("chunk_id").cast("string"), "aspect", F.floor(F.col("score") * 1000 + 0.5).cast("long").cast("string"), "model_name")
    part = lambda at: F.conv(F.substring(F.md5(line), at, 15), 16, 10).cast("decimal(20,0)")
    inside = windows.join(signals.of_model(scores, model), (windows["ticker"] == scores["ticker"]) & F.col("doc_date").between(F.col("window_start"), F.col("window_end")), "left")
    zero = F.lit(0).cast("decimal(30,0)")
    keys = [windows["ticker"], F.col("window_start"), F.col("window_end")]
    sums = inside.groupBy(*keys).agg(F.count("chunk_id").alias("n"), *[F.coalesce(F.sum(F.when(F.col("chunk_id").isNotNull(), part(at))), zero).alias(f"h{at}") for at in (1, 16)])
    parts = F.concat_ws("|", "ticker", F.col("window_start").cast("string"), F.col("window_end").cast("string"), F.lit(backend), F.col("n").cast("string"), F.col("h1").cast("string"), F.col("h16").cast("string"))
    return sums.select("ticker", "window_start", "window_end", F.sha2(parts, 256).alias("fingerprint"), "n")


def windows(documents: DataFrame, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The window asked for, where one side is not given the default one's; an asked ticker without documents raises."""
    found = signals.default_window(documents)
    if tickers is not None:
        asked = [t.upper() for t in tickers]
        found = found.where(F.col("ticker").isin(asked))
        known = {r["ticker"] for r in found.select("ticker").collect()}  # at most the tickers asked for
        if missing := sorted(set(asked) - known):
            raise LookupError(f"no documents for {missing}")
    pick = lambda given, other: F.lit(given).cast("date") if given else F.col(other)
    return found.select("ticker", pick(start, "window_start").alias("window_start"), pick(end, "window_end").alias("window_end"))


def reuse(keys: DataFrame, briefs: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(newest stored brief of each equal fingerprint, keys whose briefs are to be made); ``force`` makes all."""
    if force:
        return briefs.limit(0), keys
    same = briefs.join(keys.select("ticker", "fingerprint"), ["ticker", "fingerprint"], "left_semi")
    newest = same.groupBy("ticker", "fingerprint").agg(F.max("brief_id").alias("brief_id"))
    return briefs.join(newest.select("brief_id"), "brief_id", "left_semi"), keys.join(briefs, ["ticker", "fingerprint"], "left_anti")


def citations(briefs: DataFrame) -> DataFrame:
    """(brief_id, chunk_id) of everything that a brief's sections cite, each once."""
    sides = F.flatten(F.transform(F.map_values("sections"), lambda s: F.concat(F.coalesce(s["bull"], F.array()), F.coalesce(s["bear"], F.array()))))
    ids = F.array_distinct(F.flatten(F.transform(sides, lambda c: c["cited"])))
    return briefs.select("brief_id", F.explode(ids).alias("chunk_id"))


def brief_sources(briefs: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The cited sentences of briefs: brief_id, chunk_id, text, section, speaker, document_id, title, doc_date."""
    said = chunks.select("chunk_id", "document_id", "text", "section", "speaker")
    return citations(briefs).join(said, "chunk_id").join(documents.select("document_id", "title", "doc_date"), "document_id")


def with_traces(briefs: DataFrame, traces: DataFrame) -> DataFrame:
    """Briefs with their log entries in order of step; none is an empty array."""
    entry = F.struct("step", "agent", "payload")
    log = traces.groupBy("brief_id").agg(F.sort_array(F.collect_list(entry)).alias("traces"))
    joined = briefs.join(log, "brief_id", "left")
    return joined.withColumn("traces", F.coalesce("traces", F.array().cast(log.schema["traces"].dataType)))


def merged_claims(claims: DataFrame) -> DataFrame:
    """Per ticker: claims that repeat an earlier one's side and cited sentences."""
    groups = claims.groupBy("ticker", "side", F.array_sort("cited").alias("ids")).agg(F.count("*").alias("n"))
    return groups.groupBy("ticker").agg(F.sum(F.col("n") - 1).alias("merged"))


# --- reports -----------------------------------------------------------------


def events(scores: DataFrame, model: str | None = None) -> DataFrame:
    """Per transcript: delta, doc_level and mean prepared sentiment, each the mean of its aspects' rounded means."""
    calls = scores.where(F.col("doc_type") == "transcript")
    per = signals.aspect_summary(calls, model, keys=("ticker", "document_id", "doc_date"))
    means = {"delta": "delta", "doc_level": "mean", "prepared": "prepared"}
    return per.groupBy("ticker", "document_id", "doc_date").agg(*[mean_half_up(F.col(c)).alias(name) for name, c in means.items()])


def study_events(scores: DataFrame) -> DataFrame:
    """(model, ticker, date, delta, doc_level) of all models at once, for ``evaluation.study``."""
    keys = ("model_name", "ticker", "doc_date")
    summary = signals.aspect_summary(scores, keys=keys)
    both = signals.transcript_delta(summary, keys).join(signals.document_sentiment(summary, keys), list(keys))
    return both.select(F.col("model_name").alias("model"), "ticker", F.col("doc_date").alias("date"), "delta", F.col("sentiment").alias("doc_level"))


def signal_validity(rows: DataFrame, outcome: str, predictors: tuple[str, ...] = ("delta", "doc_level", "prepared")) -> DataFrame:
    """Per predictor: n, Spearman and Pearson with two-sided p, and the bootstrap interval; nulls below 3 events."""
    out = []
    for x in predictors:
        one = evaluation.correlations(rows, [(x, outcome)]).first()
        p = lambda c: None if one[c] is None or abs(one[c]) >= 1 else evaluation.t_pvalue(one[c] * ((one["n"] - 2) / (1 - one[c] ** 2)) ** 0.5, one["n"] - 2)  # noqa: E731, B023
        low = high = None
        if one["n"] >= 3:
            low, high = evaluation.bootstrap_ci(rows, x, outcome).first()
        out.append((x, one["n"], one["spearman"], p("spearman"), one["pearson"], p("pearson"), low, high))
    return rows.sparkSession.createDataFrame(out, "predictor string, n long, spearman double, spearman_p double, pearson double, pearson_p double, low double, high double")


def failing_rows(df: DataFrame, true: str, pred: str) -> DataFrame:
    """The rows that a model got wrong, as they are."""
    return df.where(F.col(true) != F.col(pred))


def failure_table(rates: DataFrame, key: str = "model") -> str:
    """Error rates (a row a model) as a Markdown table in percent."""
    percent = lambda x: "" if x is None else f"{x:.1%}"
    lines = [f"| {key} | all | trap | other |", "|---|---|---|---|"]
    for r in rates.orderBy(key).collect():
        lines.append(f"| {r[key]} | " + " | ".join(percent(r[c]) for c in ("error_all", "error_trap", "error_other")) + " |")
    return "\n".join(lines)


def overall_catch_rate(verified: DataFrame) -> DataFrame:
    """(corrupted, caught) over all kinds but the faithful ones: the kinds weigh by their rows."""
    bad = verified.where(F.col("kind") != "faithful")
    return bad.agg(F.count("*").alias("corrupted"), half_up(F.coalesce(F.avg((F.col("status") != "supported").cast("double")), F.lit(0.0))).alias("caught"))


def candidates(disagreeing: DataFrame, chunks: DataFrame, documents: DataFrame, least: int = 40, most: int = 400) -> DataFrame:
    """Sentences of transcripts that two models scored, of ``least`` to ``most`` characters."""
    calls = documents.where(F.col("doc_type") == "transcript").select("document_id", "ticker", "doc_date")
    fit = chunks.where(F.length("text").between(least, most)).select("chunk_id", "document_id", "text", "section", "speaker", "idx")
    return disagreeing.join(fit, "chunk_id").join(calls, "document_id")


def kept_labels(labelled: DataFrame, key: DataFrame, off: str = "not about aspect") -> tuple[DataFrame, DataFrame]:
    """(gold rows: labelled ones that are about their aspect, with the key's columns; one row of counts and aspect_precision)."""
    kept = F.col("label") != off
    share = half_up(F.avg(kept.cast("double")), 3)
    counts = labelled.agg(F.count("*").alias("labelled"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias(off.replace(" ", "_")), share.alias("aspect_precision"))
    return labelled.where(kept).join(key, "item_id"), counts


def stored_against_labels(gold: DataFrame, models: tuple[str, ...] = ("pred_a", "pred_b")) -> DataFrame:
    """A classification report per stored prediction column against ``label``."""
    long = gold.unpivot(["label"], list(models), "model", "predicted").withColumnRenamed("label", "t")
    return evaluation.classification_report(long, "t", "predicted", keys=("model",))


def trap_accuracy(df: DataFrame, true: str, pred: str, trap: str, seconds: float, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Per model: trap rows, the share of them that is right, and milliseconds per row of all ``seconds``."""
    right = F.avg(F.when(F.col(trap), (F.col(true) == F.col(pred)).cast("double")))
    return df.groupBy(*keys).agg(F.count_if(F.col(trap)).alias("trap_n"), half_up(right).alias("trap_accuracy"), (F.lit(1000.0 * seconds) / F.count("*")).alias("ms_per_item"))


def run_rows(spark: SparkSession, name: str, params: dict, metrics: dict, at: dt.datetime | None = None) -> DataFrame:
    """One model run as a row to append: its version is the UTC time; parameters are cut to 250 characters."""
    version = (at or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%d%H%M%S")
    row = (name, version, {k: str(v)[:PARAM_CHARS] for k, v in params.items()}, {k: float(v) for k, v in metrics.items()})
    return spark.createDataFrame([row], "name string, version string, params map<string,string>, metrics map<string,double>")


def digest(moves: DataFrame, drift: DataFrame | None = None) -> str:
    """The largest moves (a handful of rows) and drift alerts as plain text."""
    lines = ["Largest moves of aspect sentiment", ""]
    for i, m in enumerate(moves.orderBy(F.abs("change").desc(), "ticker", "aspect").collect(), 1):
        way = "up" if m["change"] > 0 else "down"
        lines.append(f"{i}. {m['ticker']}, {m['aspect'].replace('_', ' ')}: {m['from_mean']:+.2f} to {m['to_mean']:+.2f} ({way} {m['change']:+.2f} on {m['to_date']})")
    if len(lines) == 2:
        lines.append("None: a ticker needs two documents that mention an aspect.")
    for a in drift.where("alert").orderBy("ticker").collect() if drift is not None else []:
        lines.append(f"Drift of {a['ticker']}: PSI {a['psi']}, shift of confidence {a['shift']}")
    return "\n".join([*lines, "", NOTICE])
