"""Signals over the score relation: summaries, deltas, trajectories, drift, moves.

``scores``: chunk_id, ticker, document_id, doc_type, doc_date, section, aspect,
score, confidence, model_name.  A ``model`` of None mixes all models, as stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import half_up, mean_half_up

POSITIVE, NEGATIVE = 0.15, -0.15


def of_model(scores: DataFrame, model: str | None) -> DataFrame:
    return scores if model is None else scores.where(F.col("model_name") == model)


def _section_means() -> list[Column]:
    part = lambda s: F.when(F.col("section") == s, F.col("score"))
    return [F.avg("score").alias("mean"), F.count("*").alias("n"), F.avg(part("prepared")).alias("prepared"), F.avg(part("qa")).alias("qa"),
            F.count(part("prepared")).alias("prepared_n"), F.count(part("qa")).alias("qa_n")]


def aspect_summary(scores: DataFrame, model: str | None = None, keys: tuple[str, ...] = ("ticker", "doc_date")) -> DataFrame:
    """Per document and aspect: means over all, prepared and Q&A sentences; delta = Q&A - prepared, null if one is missing."""
    means = of_model(scores, model).groupBy(*keys, "aspect").agg(*_section_means())
    return means.select(*keys, "aspect", half_up(F.col("mean")).alias("mean"), "n", half_up(F.col("prepared")).alias("prepared"), half_up(F.col("qa")).alias("qa"),
                        "prepared_n", "qa_n", half_up(F.col("qa") - F.col("prepared")).alias("delta"))


def transcript_delta(summary: DataFrame, keys: tuple[str, ...] = ("ticker", "doc_date")) -> DataFrame:
    """Mean of the aspects' rounded deltas."""
    return summary.groupBy(*keys).agg(mean_half_up(F.col("delta")).alias("delta"))


def document_sentiment(summary: DataFrame, keys: tuple[str, ...] = ("ticker", "doc_date")) -> DataFrame:
    """Mean of the aspects' means: each aspect counts once."""
    return summary.groupBy(*keys).agg(mean_half_up(F.col("mean")).alias("sentiment"))


def trajectory(scores: DataFrame, model: str | None = None) -> DataFrame:
    """Per ticker and aspect, a point per document in date order."""
    points = of_model(scores, model).groupBy("ticker", "aspect", "document_id", "doc_type", "doc_date").agg(*_section_means())
    return points.select("ticker", "aspect", "document_id", "doc_type", "doc_date", half_up(F.col("mean")).alias("mean"), "n",
                         half_up(F.col("prepared")).alias("prepared"), half_up(F.col("qa")).alias("qa"))


def trajectory_lists(scores: DataFrame, model: str | None = None) -> DataFrame:
    """One row per ticker and aspect with its points as an ordered array."""
    point = F.struct("doc_date", "document_id", "mean", "n")
    return trajectory(scores, model).groupBy("ticker", "aspect").agg(F.sort_array(F.collect_list(point)).alias("points"))


def drill_down(scores: DataFrame, chunks: DataFrame, ticker: str, aspect: str, model: str | None = None, limit: int = 200) -> DataFrame:
    """Scored sentences of one ticker and aspect, by date and position."""
    wanted = of_model(scores, model).where((F.col("ticker") == ticker) & (F.col("aspect") == aspect))
    return wanted.join(chunks, "chunk_id").orderBy("doc_date", "idx", "chunk_id").limit(min(limit, 1000))


def context(chunks: DataFrame, k: int, of: Column) -> DataFrame:
    """The sentences up to k before and after each target, with a flag on the target itself.

    A frame over the positions of a document: one shuffle, and each sentence is
    made once.  Rows without document or position are nobody's context."""
    near = Window.partitionBy("document_id").orderBy("idx").rangeBetween(-k, k)
    rows = chunks.where("document_id IS NOT NULL AND idx IS NOT NULL").withColumn("of", of)
    others = [c for c in chunks.columns if c != "document_id"]
    framed = rows.select("document_id", F.col("idx").alias("target_idx"), "of", F.collect_list(F.struct(*others)).over(near).alias("near")).where("of")
    got = framed.select("document_id", "target_idx", F.inline("near"))
    return got.select("document_id", "idx", *[c for c in others if c != "idx"], "target_idx", (F.col("idx") == F.col("target_idx")).alias("is_target"))


def neighbours(chunks: DataFrame) -> DataFrame:
    """Each sentence with the one before and after it, null across gaps of the position."""
    w = Window.partitionBy("document_id").orderBy("idx")
    near = lambda f, d: F.when(f("idx").over(w) == F.col("idx") + d, f("text").over(w))
    return chunks.withColumns({"previous": near(F.lag, -1), "next": near(F.lead, 1)})


def latest_per_ticker(documents: DataFrame, prefer: str = "transcript") -> DataFrame:
    """The newest preferred document of each ticker, else its newest of any type."""
    order = Window.partitionBy("ticker").orderBy((F.col("doc_type") == prefer).desc(), F.desc("doc_date"), F.desc("document_id"))
    return documents.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def watchlist(scores: DataFrame, documents: DataFrame, briefs: DataFrame | None = None) -> DataFrame:
    """Latest document per ticker with its aspect summary and, if there is one, its newest brief."""
    latest = latest_per_ticker(documents)
    rows = latest.join(aspect_summary(scores, keys=("document_id",)), "document_id")
    if briefs is None:
        return rows
    newest = briefs.groupBy("ticker").agg(F.max("brief_id").alias("brief_id"))
    return rows.join(newest, "ticker", "left")


def latest_documents(documents: DataFrame) -> DataFrame:
    """The newest documents of each ticker and type; all of those that share the date."""
    w = Window.partitionBy("ticker", "doc_type").orderBy(F.desc("doc_date"))
    return documents.withColumn("r", F.rank().over(w)).where("r = 1").drop("r")


def top_moves(points: DataFrame, documents: DataFrame, n: int = 3, min_mentions: int = 3) -> DataFrame:
    """Largest changes between a point in a latest document and the last one of the same type before it."""
    key = Window.partitionBy("ticker", "aspect")
    latest = latest_documents(documents).select("document_id", F.lit(True).alias("is_latest"))
    marked = points.where(F.col("n") >= min_mentions).join(latest, "document_id", "left")
    last = marked.where("is_latest").withColumn("rn", F.row_number().over(key.orderBy(F.desc("doc_date"), F.desc("document_id")))).where("rn = 1")
    cur = last.select("ticker", "aspect", "doc_type", F.col("doc_date").alias("to_date"), F.col("mean").alias("to_mean"))
    before = marked.select("ticker", "aspect", "doc_type", "doc_date", "mean", "document_id").join(cur, ["ticker", "aspect", "doc_type"]).where("doc_date < to_date")
    prev = before.groupBy("ticker", "aspect", "to_date", "to_mean").agg(F.max_by(F.struct("mean", "doc_date"), F.struct("doc_date", "document_id")).alias("p"))
    moves = prev.select("ticker", "aspect", "to_date", F.col("p.doc_date").alias("from_date"), F.col("p.mean").alias("from_mean"), "to_mean",
                        half_up(F.col("to_mean") - F.col("p.mean"), 3).alias("change"))
    return moves.orderBy(F.abs("change").desc(), "ticker", "aspect").limit(n)


# --- drift ---------------------------------------------------------------


def aspect_mix(scores: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Share of each aspect among a key's rows."""
    counts = scores.groupBy(*keys, "aspect").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


#: Confidences are summed around this, and variances below the least count as none: sums of squares can't tell them from 0.
CENTRE, LEAST_VARIANCE = 0.5, 1e-14
#: Alerts and floors of the drift reports.
PSI_ALERT, SHIFT_ALERT, EPSILON = 0.25, 0.8, 1e-4


def daily_statistics(scores: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(``keys``, aspect, doc_date, n, s1, s2): counts and sums of the confidence and its square, which add up over days and tickers."""
    c = F.col("confidence") - CENTRE
    return scores.groupBy(*keys, "aspect", "doc_date").agg(F.count("*").alias("n"), F.sum(c).alias("s1"), F.sum(c * c).alias("s2"))


def with_total(daily: DataFrame) -> DataFrame:
    """``daily`` and the sums over all tickers as ``ALL``: added up from days, no row of a score counts twice."""
    total = daily.groupBy("aspect", "doc_date").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
    return daily.unionByName(total.select(F.lit("ALL").alias("ticker"), *[c for c in daily.columns if c != "ticker"]))


def drift_reports(daily: DataFrame, ends: DataFrame, aspects: list[str], window_days: int = 7, baseline_days: int = 28, min_obs: int = 5,
                  psi_alert: float = PSI_ALERT, shift_alert: float = SHIFT_ALERT, epsilon: float = EPSILON) -> DataFrame:
    """One report per row of ``ends`` (ticker, as_of) from additive statistics.

    Current: (as_of - window, as_of]; baseline: the ``baseline_days`` before.
    Each day's statistics meet the ends whose windows they are in by a join on
    ticker and day.  Too few rows on a side give status insufficient_data; an
    aspect out of the list counts for the shares' base alone."""
    age = F.explode(F.sequence(F.lit(0), F.lit(window_days + baseline_days - 1)))
    wanted = ends.select("ticker", "as_of", age.alias("age")).withColumn("doc_date", F.date_sub("as_of", F.col("age")))
    joined = wanted.join(daily, ["ticker", "doc_date"], "left").withColumn("side", F.when(F.col("age") < window_days, "cur").otherwise("base"))
    of = lambda s, x: F.coalesce(F.sum(F.when((F.col("side") == s) & x[0], F.col(x[1]))), F.lit(0))
    all_ = F.lit(True)
    aggs = [of(s, (all_, c)).alias(f"{s}_{c}") for s in ("cur", "base") for c in ("n", "s1", "s2")]
    aggs += [of(s, (F.col("aspect") == a, "n")).alias(f"{s}_{i}") for s in ("cur", "base") for i, a in enumerate(aspects)]
    got = joined.groupBy("ticker", "as_of").agg(*aggs)
    share = lambda s, i: F.greatest(F.try_divide(F.col(f"{s}_{i}"), F.col(f"{s}_n")), F.lit(epsilon))
    psi = sum(((share("cur", i) - share("base", i)) * F.ln(share("cur", i) / share("base", i)) for i in range(len(aspects))), F.lit(0.0))
    mean = lambda s: F.try_divide(F.col(f"{s}_s1"), F.col(f"{s}_n"))
    variance = lambda s: F.try_divide(F.col(f"{s}_s2"), F.col(f"{s}_n")) - mean(s) * mean(s)
    true = lambda v: F.when(v < LEAST_VARIANCE, 0.0).otherwise(v)
    pooled = F.sqrt((true(variance("cur")) + true(variance("base"))) / 2)
    shift = F.when((F.col("cur_n") < 2) | (F.col("base_n") < 2) | (pooled <= 1e-9), 0.0).otherwise((mean("cur") - mean("base")) / F.when(pooled > 1e-9, pooled))
    enough = (F.col("cur_n") >= min_obs) & (F.col("base_n") >= min_obs)
    out = got.select("ticker", "as_of", "cur_n", "base_n", F.when(enough, half_up(psi)).otherwise(0.0).alias("psi"), F.when(enough, half_up(shift)).otherwise(0.0).alias("shift"),
                     F.when(enough, "ok").otherwise("insufficient_data").alias("status"))
    return out.withColumn("alert", (F.col("psi") > psi_alert) | (F.abs("shift") > shift_alert))


def drift(scores: DataFrame, aspects: list[str], as_of: str | None = None, window_days: int = 7, baseline_days: int = 28, min_obs: int = 5, total: bool = True) -> DataFrame:
    """Population stability of the aspect mix and shift of the confidence, per ticker at its own latest date up to ``as_of``.

    With ``total`` also a row ``ALL``: at ``as_of``, or at the latest date of
    all.  Scores are summed once, per ticker, aspect and day; every window is
    read from those sums."""
    known = scores if as_of is None else scores.where(F.col("doc_date") <= F.lit(as_of).cast("date"))
    daily = daily_statistics(known)
    daily = with_total(daily) if total else daily
    end = F.max("doc_date")
    if as_of is not None:
        end = F.when(F.col("ticker") == "ALL", F.lit(as_of).cast("date")).otherwise(end)
    return drift_reports(daily, daily.groupBy("ticker").agg(end.alias("as_of")), aspects, window_days, baseline_days, min_obs)


def drift_series(scores: DataFrame, aspects: list[str], window_days: int = 7, baseline_days: int = 28, min_obs: int = 5, total: bool = True) -> DataFrame:
    """A report for each ticker (and ``ALL``) at each of its dates: the drift as it would have been seen that day."""
    daily = daily_statistics(scores)
    daily = with_total(daily) if total else daily
    ends = daily.select("ticker", F.col("doc_date").alias("as_of")).distinct()
    return drift_reports(daily, ends, aspects, window_days, baseline_days, min_obs)


def score_bucket(score: Column) -> Column:
    return F.when(score > POSITIVE, "positive").when(score < NEGATIVE, "negative").otherwise("neutral")


def default_window(documents: DataFrame, days: int = 180) -> DataFrame:
    """Per ticker: the ``days`` up to its latest document."""
    return documents.groupBy("ticker").agg(F.max("doc_date").alias("window_end")).select("ticker", F.date_sub("window_end", days).alias("window_start"), "window_end")


def serving_model(runs: DataFrame) -> DataFrame:
    """The newest run that serves."""
    return runs.where("serving").orderBy(F.desc("run_id")).limit(1)


def set_serving(runs: DataFrame, name: str) -> DataFrame:
    """All flags off, then the newest run of that name on."""
    newest = F.max("run_id").over(Window.partitionBy("name"))
    return runs.withColumn("serving", (F.col("name") == name) & (F.col("run_id") == newest))


def recent(rows: DataFrame, by: str, n: int = 50, ticker: str | None = None) -> DataFrame:
    """The newest ``n`` rows by a unique id: briefs, drift reports or model runs, of one ticker or of all."""
    some = rows if ticker is None else rows.where(F.col("ticker") == ticker)
    return some.orderBy(F.desc(by)).limit(n)
