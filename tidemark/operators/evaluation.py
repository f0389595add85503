"""Measuring models, claims and signals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lexicons import LABELS
from tidemark.functions.text import half_up
from tidemark.operators import ranks

HORIZONS = {"car_0_1": (0, 1), "car_0_4": (0, 4), "drift_2_11": (2, 11)}


def classification_report(df: DataFrame, true: str, pred: str, labels: tuple[str, ...] = LABELS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label (0 where undefined), with accuracy and macro-F1."""
    confusion = df.groupBy(*keys, F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sums = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    aggs = [sums(F.col("t") == F.col("p")).alias("hit"), F.sum("n").alias("total")]
    for i, x in enumerate(labels):
        aggs += [sums((F.col("t") == x) & (F.col("p") == x)).alias(f"tp{i}"), sums(F.col("t") == x).alias(f"t{i}"), sums(F.col("p") == x).alias(f"p{i}")]
    got = confusion.groupBy(*keys).agg(*aggs)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    per = [F.struct(F.lit(x).alias("label"), ratio(F.col(f"tp{i}"), F.col(f"p{i}")).alias("precision"), ratio(F.col(f"tp{i}"), F.col(f"t{i}")).alias("recall"),
                    ratio(2 * F.col(f"tp{i}"), F.col(f"t{i}") + F.col(f"p{i}")).alias("f1"), F.col(f"t{i}").alias("support")) for i, x in enumerate(labels)]
    rows = got.select(*keys, ratio(F.col("hit"), F.col("total")).alias("accuracy"), F.array(*per).alias("per"))
    macro = F.aggregate("per", F.lit(0.0), lambda a, x: a + x["f1"]) / len(labels)
    rows = rows.select(*keys, half_up(F.col("accuracy")).alias("accuracy"), half_up(macro).alias("macro_f1"), F.inline("per"))
    return rows.select(*keys, "label", *[half_up(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support", "accuracy", "macro_f1")


def flat_metrics(report: DataFrame) -> DataFrame:
    """(label, metric, value) rows of a report."""
    return report.unpivot(["label"], ["precision", "recall", "f1", "accuracy", "macro_f1"], "metric", "value")


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    return df.groupBy(F.col(true).alias("true_label")).agg(*[F.count_if(F.col(pred) == x).alias(f"pred_{x}") for x in labels])


def trap_errors(df: DataFrame, true: str, pred: str, trap: str, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Error rates over all, trap and other rows."""
    wrong = (F.col(true) != F.col(pred)).cast("double")
    part = lambda test: half_up(F.avg(F.when(test, wrong)))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), half_up(F.avg(wrong)).alias("error_all"), part(F.col(trap)).alias("error_trap"), part(~F.col(trap)).alias("error_other"))


def audit_scores(df: DataFrame) -> DataFrame:
    """Of (status, human_ok): precision of supported claims, catch rate of bad ones, share kept; null without a base."""
    sup, ok = F.col("status") == "supported", F.col("human_ok")
    rate = lambda hit, base: half_up(F.avg(F.when(base, hit.cast("double"))))
    return df.agg(F.count("*").alias("n"), rate(ok, sup).alias("precision"), rate(~sup, ~ok).alias("catch_rate"), rate(sup, F.lit(True)).alias("kept"))


# --- events and prices ----------------------------------------------------


def day0(calls: DataFrame, days: DataFrame, roll_hour: int = 16) -> DataFrame:
    """Forward as-of join: the first trading day on or after the call's (from ``roll_hour`` on, the day after's).

    ``calls``: symbol, call_at; ``days``: symbol, day.  A union and one ordered
    window per symbol, read backwards so that each row only looks at what it has
    passed: linear in both sides; no range join."""
    target = F.to_date("call_at") + F.when(F.hour("call_at") >= roll_hour, 1).otherwise(0)
    asked = calls.select("symbol", F.col("call_at"), target.alias("day"), F.lit(None).cast("date").alias("trading"), F.lit(1).alias("kind"))
    open_ = days.select("symbol", F.lit(None).cast(calls.schema["call_at"].dataType).alias("call_at"), "day", F.col("day").alias("trading"), F.lit(0).alias("kind")).distinct()
    w = Window.partitionBy("symbol").orderBy(F.desc("day"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    return asked.unionByName(open_).withColumn("day0", F.last("trading", ignorenulls=True).over(w)).where("kind = 1").select("symbol", "call_at", "day0")


def event_returns(
    calls: DataFrame, prices: DataFrame, market: DataFrame, horizons: dict[str, tuple[int, int]] = HORIZONS, roll_hour: int = 16
) -> DataFrame:
    """Market-adjusted returns from the close before each window to its last close.

    ``prices``: symbol, day, close; ``market``: day, close.  Trading days are
    those of both; an event without all of its windows is dropped."""
    both = prices.join(market.withColumnRenamed("close", "market"), "day")
    w = Window.partitionBy("symbol").orderBy("day")
    need = {k for a, b in horizons.values() for k in (a - 1, b)}
    at = lambda c, k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)
    wide = both.select("symbol", F.col("day").alias("day0"), *[at(c, k).alias(f"{c}{k}".replace("-", "m")) for c in ("close", "market") for k in sorted(need)])
    col = lambda c, k: F.col(f"{c}{k}".replace("-", "m"))
    gain = lambda c, a, b: col(c, b) / col(c, a - 1)
    events = day0(calls, both, roll_hour).join(wide, ["symbol", "day0"])
    out = events.select("symbol", "call_at", "day0", *[half_up(gain("close", a, b) - gain("market", a, b), 6).alias(n) for n, (a, b) in horizons.items()])
    return out.dropna(subset=list(horizons))


def horizon_returns(calls: DataFrame, prices: DataFrame, market: DataFrame, days: int = 5) -> DataFrame:
    """Market-adjusted return over ``days`` trading days from the first close on or after the call's date, whatever its hour."""
    return event_returns(calls, prices, market, {f"return_{days}d": (1, days)}, roll_hour=24)


def revisions(estimates: DataFrame) -> DataFrame:
    """(symbol, day, eps, revision): change against the previous estimate, where that is neither null nor 0."""
    prev = F.lag("eps").over(Window.partitionBy("symbol").orderBy("day"))
    rows = estimates.withColumn("prev", prev).where("prev IS NOT NULL AND prev <> 0 AND eps IS NOT NULL")
    return rows.select("symbol", "day", "eps", half_up((F.col("eps") - F.col("prev")) / F.abs("prev"), 6).alias("revision"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-30)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > 1e-30 else 1e-30)
            c = 1 + top / c
            c = c if abs(c) > 1e-30 else 1e-30
            out *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * out


def t_pvalue(t: float, degrees: float) -> float:
    """Two-sided p of a t statistic."""
    return _beta(degrees / 2, 0.5, degrees / (degrees + t * t)) if degrees > 0 else float("nan")


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(x, y, n, pearson, spearman) of rows where both are known; null for fewer than 3, or if one is constant.

    All pairs are cells of one pass; ranks come from slices of the order."""
    each = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b")) for x, y in pairs])
    found = ranks.rank_correlations(df.select(F.inline(each)), ["x", "y"])
    asked = df.sparkSession.createDataFrame(pairs, "x string, y string")
    enough = lambda c: F.when(F.col("n") >= 3, half_up(F.col(c))).alias(c)
    return asked.join(found, ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"), enough("pearson"), enough("spearman"))


def bootstrap_ci(df: DataFrame, x: str, y: str, samples: int = 2000, seed: int = 0) -> DataFrame:
    """(low, high): percentile interval of the Spearman correlation over Poisson resamples; see ``ranks``."""
    return ranks.percentile_interval(ranks.resampled_spearman(df, x, y, samples, seed))


def ols_fixed_effects(df: DataFrame, y: str, xs: list[str], group: str) -> dict:
    """Least squares with group effects (by demeaning in Spark) and HC1 errors: only sums of products reach the driver."""
    rows = df.select(F.col(group).alias("g"), F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    w = Window.partitionBy("g")
    names = [f"x{i}" for i in range(len(xs))]
    rows = rows.select("g", *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in ("y", *names)])
    k = len(xs)
    sums = rows.agg(F.count("*").alias("n"), F.count_distinct("g").alias("groups"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names for b in ("y", *names)]).first()
    xx = np.array([[sums[f"{a}_{b}"] or 0.0 for b in names] for a in names])
    beta = np.linalg.pinv(xx) @ np.array([sums[f"{a}_y"] or 0.0 for a in names])
    e = F.col("y") - sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, names)), F.lit(0.0))
    meat = rows.agg(*[F.sum(F.col(a) * F.col(b) * e * e).alias(f"{a}_{b}") for a in names for b in names], F.sum(e * e).alias("rss"), F.sum(F.col("y") * F.col("y")).alias("tss")).first()
    free = sums["n"] - k - sums["groups"]
    bread = np.linalg.pinv(xx)
    cover = bread @ np.array([[meat[f"{a}_{b}"] or 0.0 for b in names] for a in names]) @ bread * sums["n"] / max(free, 1)
    errors = np.sqrt(np.maximum(np.diag(cover), 0))
    p = [math.erfc(abs(b) / s / math.sqrt(2)) if s > 0 else float("nan") for b, s in zip(beta, errors)]  # robust errors: normal
    return {"n": sums["n"], "coef": dict(zip(xs, beta.tolist())), "error": dict(zip(xs, errors.tolist())), "p": dict(zip(xs, p)), "r2_within": 1 - meat["rss"] / meat["tss"] if meat["tss"] else 0.0}


def cell_regressions(df: DataFrame, keys: list[str], y: str, xs: list[str], group: str) -> DataFrame:
    """(``keys``, n, groups, x, coef, error, p): least squares with group effects per cell, HC1 errors and normal p-values.

    Two passes of sums of products over all cells at once; the small systems are
    solved per cell, in tasks.  Rows with a null take no part; a cell without
    degrees of freedom has null errors."""
    names = [f"x{i}" for i in range(len(xs))]
    rows = df.select(*keys, F.col(group).alias("g"), F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(c) for x, c in zip(xs, names)]).dropna()
    w = Window.partitionBy(*keys, "g")
    rows = rows.select(*keys, "g", *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in ("y", *names)])
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    products = [F.sum(F.col(a) * F.col(b)) for a in names for b in ("y", *names)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("g").alias("groups"), F.array(*products).alias("s"))

    def solve(batches):
        for batch in batches:
            tables = [np.array(s, float).reshape(len(xs), len(xs) + 1) for s in batch["s"]]
            yield batch.assign(beta=[(np.linalg.pinv(t[:, 1:]) @ t[:, 0]).tolist() for t in tables], bread=[np.linalg.pinv(t[:, 1:]).ravel().tolist() for t in tables])[[*keys, "n", "groups", "beta", "bread"]]

    fits = sums.mapInPandas(solve, f"{kinds}, n long, groups long, beta array<double>, bread array<double>")
    fitted = rows.join(fits, keys)  # a row per cell: Spark broadcasts it if it is small
    e = F.col("y") - sum((F.get("beta", F.lit(i)) * F.col(c) for i, c in enumerate(names)), F.lit(0.0))
    meat = F.array(*[F.sum(F.col(a) * F.col(b) * e * e) for a in names for b in names])
    meats = fitted.groupBy(*keys, "n", "groups", "beta", "bread").agg(meat.alias("meat"))

    def errors(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                k, r = len(xs), r._asdict()
                bread, free = np.array(r["bread"]).reshape(k, k), r["n"] - k - r["groups"]
                cover = bread @ np.array(r["meat"], float).reshape(k, k) @ bread * r["n"] / free if free > 0 else np.full((k, k), np.nan)
                for i, x in enumerate(xs):
                    coef, error = float(r["beta"][i]), float(np.sqrt(max(cover[i, i], 0.0))) if free > 0 else None
                    p = math.erfc(abs(coef) / error / math.sqrt(2)) if error else None
                    out.append((*[r[c] for c in keys], r["n"], r["groups"], x, coef, error, p))
            yield pd.DataFrame(out, columns=[*keys, "n", "groups", "x", "coef", "error", "p"])

    return meats.mapInPandas(errors, f"{kinds}, n long, groups long, x string, coef double, error double, p double")


def bonferroni(df: DataFrame, tests: Column | int, p: str = "p") -> DataFrame:
    """``df`` with ``p_bonferroni``: ``p`` times the number of tests, at most 1; null stays null."""
    return df.withColumn("p_bonferroni", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * tests)))


def study(events: DataFrame, returns: DataFrame, horizons: list[str], predictors: list[str]) -> DataFrame:
    """Per model, horizon and predictor: rank correlation, regression and corrected p-values, all cells in one pass.

    ``events``: model, ticker, date and the predictors; ``returns``: ticker,
    date and a column per horizon.  Events without returns drop out.  The
    regression is of the horizon on all predictors with ticker effects;
    ``n_tests`` is models x horizons."""
    joined = events.join(returns, ["ticker", "date"])
    long = joined.select("model", "ticker", *predictors, F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(h).cast("double").alias("ret")) for h in horizons])))
    each = F.array(*[F.struct(F.lit(x).alias("predictor"), F.col(x).cast("double").alias("a")) for x in predictors])
    keys = ["model", "horizon", "predictor"]
    correlated = ranks.rank_correlations(long.select("model", "horizon", F.col("ret").alias("b"), F.inline(each)), keys)
    fits = cell_regressions(long, ["model", "horizon"], "ret", predictors, "ticker").withColumnsRenamed({"x": "predictor", "n": "n_ols"}).drop("groups")
    tests = joined.agg(F.count_distinct("model")).first()[0] * len(horizons)
    rows = correlated.join(fits, keys, "left").withColumn("n_tests", F.lit(tests))

    def pvalues(batches):
        for batch in batches:
            r, n = batch["spearman"].to_numpy(float), batch["n"].to_numpy(float)
            t = [x * math.sqrt((m - 2) / max(1 - x * x, 1e-300)) if m > 2 and x == x else None for x, m in zip(r, n)]
            yield batch.assign(spearman_p=[t_pvalue(x, m - 2) if x is not None else None for x, m in zip(t, n)])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return bonferroni(rows.mapInPandas(pvalues, f"{kinds}, spearman_p double"), F.col("n_tests"))


# --- operations -----------------------------------------------------------


def latency_report(df: DataFrame, value: str = "latency", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, median, maximum and the p95 of rank min(n - 1, int(0.95 n)), counted from 0."""
    # distinct values with their counts: far fewer rows than requests, and no window over those
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"upto": F.sum("n").over(upto), "m": F.sum("n").over(Window.partitionBy(*keys))})
    p95 = F.min(F.when(F.col("upto") > F.least(F.col("m") - 1, F.floor(F.col("m") * 0.95)), F.col(value)))
    mean = F.sum(F.col(value) * F.col("n")) / F.sum("n")
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"), half_up(mean).alias("mean"), half_up(F.percentile(value, 0.5, F.col("n"))).alias("median"), half_up(p95).alias("p95"), half_up(F.max(value)).alias("max")
    )


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Dollars per model: tokens in and out against prices per million."""
    dollars = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return usage.join(prices, "llm").groupBy("llm").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), half_up(F.sum(dollars), 6).alias("usd"))


def disagreements(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Sentences and aspects that both models scored: both labels, and whether they agree."""
    side = lambda m, n: scores.where(F.col("model_name") == m).select("chunk_id", "aspect", F.col("label").alias(n))
    return side(a, "pred_a").join(side(b, "pred_b"), ["chunk_id", "aspect"]).withColumn("agree", F.col("pred_a") == F.col("pred_b"))
