"""Trajectories and drift kept live: state per key, timers in event time, late rows counted until their day closes.

A day closes when the watermark passes its end.  Until then rows may come in any
order; a row of a closed day is dropped by the watermark.  What a key keeps is
bounded: one sum per open document, or the days that a window still reaches.
"""

from __future__ import annotations

import datetime as dt
import math
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.signals import CENTRE, EPSILON, LEAST_VARIANCE, PSI_ALERT, SHIFT_ALERT

POINT = "ticker string, aspect string, document_id string, doc_type string, doc_date date, mean double, n long, prepared double, qa double"
REPORT = "ticker string, as_of date, cur_n long, base_n long, psi double, shift double, status string, alert boolean"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that such queries need, while one is being started; the session's own comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _half_up(x: float | None, digits: int = 4) -> float | None:
    return None if x is None else math.floor(x * 10**digits + 0.5) / 10**digits


def _end_of(day: int) -> int:
    """The first millisecond after a day, counted in days since 1970."""
    return (day + 1) * DAY_MS


def _date(day: int) -> dt.date:
    return dt.date(1970, 1, 1) + dt.timedelta(days=day)


class TrajectoryProcessor(StatefulProcessor):
    """Per ticker and aspect: sums of each open document; a document becomes a point when its day closes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "document_id string, doc_type string, day long", "n long, total double, np long, prepared double, nq long, qa double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            days = set()
            for name, part in batch.groupby(["document_id", "doc_type", "day"], sort=True):
                held = self.open.getValue(name) if self.open.containsKey(name) else (0, 0.0, 0, 0.0, 0, 0.0)
                sums = [len(part), float(part["score"].sum())]
                for section in ("prepared", "qa"):
                    some = part.loc[part["section"] == section, "score"]
                    sums += [len(some), float(some.sum())]
                self.open.updateValue(name, tuple(a + b for a, b in zip(held, sums)))
                days.add(int(name[2]))
            for day in days:
                self.handle.registerTimer(_end_of(day))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for name, sums in sorted((tuple(k), tuple(v)) for k, v in self.open.iterator()):
            if _end_of(name[2]) == closed:
                n, total, *parts = sums
                means = [_half_up(parts[i + 1] / parts[i]) if parts[i] else None for i in (0, 2)]
                out.append((*key, name[0], name[1], _date(name[2]), _half_up(total / n), n, *means))
                self.open.removeKey(name)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in POINT.split(", ")])

    def close(self) -> None:
        pass


class DriftProcessor(StatefulProcessor):
    """Per ticker: each day's counts and sums by aspect; when a day closes, its drift report, read from the days behind it."""

    def __init__(self, aspects: list[str], window_days: int = 7, baseline_days: int = 28, min_obs: int = 5):
        self.aspects, self.window, self.reach, self.min_obs = aspects, window_days, window_days + baseline_days, min_obs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long, aspect string", "n long, s1 double, s2 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            c = batch["confidence"] - CENTRE
            sums = batch.assign(c=c, c2=c * c).groupby(["day", "aspect"], sort=True).agg(n=("c", "size"), s1=("c", "sum"), s2=("c2", "sum"))
            for (day, aspect), (n, s1, s2) in zip(sums.index, sums.itertuples(index=False)):
                name = (int(day), aspect)
                held = self.days.getValue(name) if self.days.containsKey(name) else (0, 0.0, 0.0)
                self.days.updateValue(name, (held[0] + int(n), held[1] + float(s1), held[2] + float(s2)))
            for day in {int(d) for d in batch["day"]}:
                self.handle.registerTimer(_end_of(day))
        return iter([])

    def report(self, ticker: str, day: int, held: list[tuple]) -> tuple:
        n, s1, s2, counts = {}, {}, {}, {}
        for side, first, last in (("cur", day - self.window, day), ("base", day - self.reach, day - self.window)):
            mine = [x for x in held if first < x[0] <= last]
            n[side], s1[side], s2[side] = sum(x[2] for x in mine), math.fsum(x[3] for x in mine), math.fsum(x[4] for x in mine)
            counts[side] = defaultdict(int)
            for x in mine:
                counts[side][x[1]] += x[2]
        psi = shift = 0.0
        enough = min(n.values()) >= self.min_obs
        if enough:
            share = {s: [max(counts[s][a] / n[s], EPSILON) for a in self.aspects] for s in n}
            psi = _half_up(sum((c - b) * math.log(c / b) for c, b in zip(share["cur"], share["base"])))
            mean = {s: s1[s] / n[s] for s in n}
            spread = [s2[s] / n[s] - mean[s] ** 2 for s in n]
            pooled = math.sqrt(sum(v if v >= LEAST_VARIANCE else 0.0 for v in spread) / 2)
            if min(n.values()) >= 2 and pooled > 1e-9:
                shift = _half_up((mean["cur"] - mean["base"]) / pooled)
        return (ticker, _date(day), n["cur"], n["base"], psi, shift, "ok" if enough else "insufficient_data", psi > PSI_ALERT or abs(shift) > SHIFT_ALERT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # timers expire in the order of their time, so no earlier day will ask for what goes here
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        held = [(*k, *v) for k, v in self.days.iterator()]
        for x in held:
            if x[0] <= day - self.reach:
                self.days.removeKey((x[0], x[1]))
        yield pd.DataFrame([self.report(key[0], day, held)], columns=[c.split()[0] for c in REPORT.split(", ")])

    def close(self) -> None:
        pass


def _timed(scores: DataFrame, late: str) -> DataFrame:
    """``scores`` with the day since 1970 and a watermark on ``ts``."""
    return scores.withColumn("day", F.unix_date(F.col("ts").cast("date")).cast("long")).withWatermark("ts", late)


def live_trajectory(scores: DataFrame, late: str = "1 day") -> DataFrame:
    """Points of closed documents from a stream of scores (ts timestamp, ticker, aspect, document_id, doc_type, section, score).

    A document's rows share their day.  Equal to the batch trajectory over the rows that came in time."""
    rows = _timed(scores, late).select("ts", "ticker", "aspect", "document_id", "doc_type", "section", "score", "day")
    return rows.groupBy("ticker", "aspect").transformWithStateInPandas(TrajectoryProcessor(), POINT, "append", "eventTime")


def live_drift(scores: DataFrame, aspects: list[str], late: str = "1 day", window_days: int = 7, baseline_days: int = 28, min_obs: int = 5) -> DataFrame:
    """A report per ticker and closed day from a stream of scores (ts timestamp, ticker, aspect, confidence).

    Equal to the batch series over the rows that came in time, but for ALL, which adds up in batch."""
    rows = _timed(scores, late).select("ts", "ticker", "aspect", "confidence", "day")
    return rows.groupBy("ticker").transformWithStateInPandas(DriftProcessor(aspects, window_days, baseline_days, min_obs), REPORT, "append", "eventTime")


def run_available(stream: DataFrame, out: str, checkpoint: str, timeout: int | None = None) -> None:
    """Feeds what is there into ``out`` (Parquet, each batch once) and stops; the next call goes on from ``checkpoint``."""
    with state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(timeout) if timeout else query.awaitTermination()
