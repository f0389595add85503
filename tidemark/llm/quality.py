"""Quality classification by a sparse ensemble of rules.

Shallow boosted trees over text statistics are grown on a bounded, hash-chosen
sample of labelled documents; every path from a root to a node is a conjunctive
rule.  A logistic regression with an l1 penalty weighs the rules and drops most.
What remains is compiled into one Spark column expression over the statistics,
so the fitted model is readable and runs inside generated code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
PENALTY = 2e-3
STATISTICS = (
    "log_bytes", "words", "word_length", "distinct_words", "repeated_next", "upper", "digits", "pipes", "exclamations",
    "symbols", "stops", "spaces", "high_bytes", "lines", "distinct_lines", "words_per_line",
)


def _class_table() -> np.ndarray:
    """Byte to class: 1 lower, 2 upper, 3 digit, 4 bar, 5 exclamation, 6 other symbol, 7 stop or comma, 8 white space, 9 high."""
    out = np.full(256, 6)
    for kind, chars in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b"|"), (5, b"!"), (7, b".,;:?'\"-()"), (8, range(0, 33)), (9, range(128, 256))):
        out[list(chars)] = kind
    return out


_CLASS = _class_table()


def statistics(text: str | None) -> tuple[float, ...]:
    """The numbers of STATISTICS; all 0 for a null or empty text."""
    if not text:
        return (0.0,) * len(STATISTICS)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    share = np.bincount(_CLASS, np.bincount(data, minlength=256), 10) / len(data)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, m = max(len(words), 1), max(len(lines), 1)
    return (
        float(np.log1p(len(data))), float(len(words)), len(text) / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[9],
        float(len(lines)), len(set(lines)) / m, len(words) / m,
    )


def with_statistics(df: DataFrame, text: str, name: str = "stats") -> DataFrame:
    """``df`` with a struct column of that name; every other column passes through."""
    schema = ", ".join(f"{x} double" for x in STATISTICS)

    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(x if isinstance(x, str) else None) for x in texts], columns=list(STATISTICS), dtype=float)

    return df.withColumn(name, F.pandas_udf(measure, f"struct<{schema.replace(' double', ':double')}>")(F.col(text)))


@dataclass(frozen=True)
class Rule:
    """(statistic, is above, value) conditions, all of which hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, above, value in self.conditions:
            out &= (x[:, i] > value) if above else (x[:, i] <= value)
        return out

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for i, above, value in self.conditions:
            c = F.col(f"{stats}.{STATISTICS[i]}")
            out = out & (c > F.lit(value) if above else c <= F.lit(value))
        return out


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> tuple[list[Rule], np.ndarray]:
    """All node paths of one regression tree on gradients, and its output per row."""
    rules, out = [], np.zeros(len(x))

    def split(rows: np.ndarray, path: tuple, left: int) -> None:
        if path:
            rules.append(Rule(path))
        out[rows] = -g[rows].sum() / (h[rows].sum() + 1.0)
        if not left or len(rows) < 20:
            return
        best = (1e-6, 0, 0)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for i, cuts in enumerate(edges):
            if not len(cuts):
                continue
            gs = np.cumsum(np.bincount(binned[rows, i], g[rows], len(cuts) + 1))
            hs = np.cumsum(np.bincount(binned[rows, i], h[rows], len(cuts) + 1))
            gain = gs[:-1] ** 2 / (hs[:-1] + 1.0) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1.0) - whole
            gain[(hs[:-1] < 1e-3) | (hs[-1] - hs[:-1] < 1e-3)] = -1
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], i, j)
        if best[0] > 1e-6:
            _, i, j = best
            low = binned[rows, i] <= j
            value = float(edges[i][j])
            split(rows[low], (*path, (i, False, value)), left - 1)
            split(rows[~low], (*path, (i, True, value)), left - 1)

    split(np.arange(len(x)), (), depth)
    return rules, out


@dataclass
class RuleEnsemble:
    """Rules with weights and an intercept; ``score`` is a Spark column in (0, 1)."""

    rules: list[Rule]
    weights: list[float]
    intercept: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, seed: int = 19) -> RuleEnsemble:
        if not len(y):
            return RuleEnsemble([], [], 0.0)
        base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        f = np.full(len(y), np.log(base / (1 - base)))
        edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
        edges = [e[e < x[:, i].max()] for i, e in enumerate(edges)]
        binned = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
        rng, found = np.random.default_rng(seed), {}
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            some = rng.random(len(y)) < 0.7
            rules, _ = _grow(x[some], binned[some], edges, (p - y)[some], (p * (1 - p))[some], DEPTH)
            found.update(dict.fromkeys(rules))
            _, out = _grow(x, binned, edges, p - y, p * (1 - p), DEPTH)
            f = f + RATE * out
        rules = [r for r in found if 0.002 <= r.holds(x).mean() <= 0.998]
        r = np.stack([rule.holds(x) for rule in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
        weights, intercept = _lasso(r, y, np.log(base / (1 - base)))
        kept = [i for i in range(len(rules)) if weights[i] != 0]
        return RuleEnsemble([rules[i] for i in kept], [float(weights[i]) for i in kept], float(intercept))

    def score(self, stats: str = "stats") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _lasso(r: np.ndarray, y: np.ndarray, intercept: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """l1-penalised logistic regression by accelerated proximal gradient steps."""
    n = len(y)
    mean = r.mean(axis=0)
    c = r - mean
    rate = 4.0 * n / max(float(np.linalg.eigvalsh(c.T @ c).max()) if r.shape[1] else 1.0, 1e-9)
    w = v = np.zeros(r.shape[1])
    b, t = intercept, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(c @ v + b)))
        step = v - rate * (c.T @ (p - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * PENALTY, 0)
        b -= 4.0 * float((p - y).mean())
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return w, b - float(mean @ w)


def fold_of(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def learn_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality",
    folds: int = 5, held_out_fold: int = 0, train_rows: int = TRAIN_ROWS,
) -> RuleEnsemble:
    """Fit on at most ``train_rows`` labelled ids, chosen by hash, outside the held-out fold."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold_of(id_col, folds) != held_out_fold))
    # one label per id; ids with both labels count as the lower one
    once = usable.groupBy(F.col(id_col).alias("i")).agg(F.min(label).alias("y"))
    # the lowest hashes, from a share of the ids that holds enough of them, so that the last sort meets few rows
    order, share = F.xxhash64("i", F.lit(41)), min(1.0, (2 * train_rows + 1_000) / max(once.count(), 1))
    chosen = once.where(order <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))).orderBy(order, "i").limit(train_rows)
    text_of = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i")  # at most train_rows rows
    # an id that stands for several texts counts once, by the least of their statistics
    measured = with_statistics(text_of, "t").groupBy("i", "y").agg(F.min("stats").alias("stats"))
    rows = measured.select("i", "y", "stats.*").toPandas().sort_values("i")
    return RuleEnsemble.fit(rows[list(STATISTICS)].to_numpy(float), rows["y"].to_numpy(float))


def score_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality",
    folds: int = 5, held_out_fold: int = 0, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """``id_col``, ``held_out``, ``score``, ``predicted`` per row of ``docs``.

    Learns from labels outside the held-out fold; scores whole texts, of any
    length, from their statistics alone.  Null and empty texts have all
    statistics 0 and get a score like any other.  Null ids are scored, never held
    out.  Labels that are null or neither 0 nor 1 are ignored; an id with both
    counts as 0; without usable labels every score is 0.5.  A score equal to the
    threshold is predicted 1.  Repeated rows are kept, an empty table gives none;
    other columns are not read.
    """
    model = learn_quality(docs, labels, text, id_col, label, folds, held_out_fold, train_rows)
    held = F.coalesce(fold_of(id_col, folds) == held_out_fold, F.lit(False))
    rows = with_statistics(docs.select(F.col(id_col), held.alias("held_out"), F.col(text).alias("t")), "t")
    scored = rows.select(id_col, "held_out", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
