"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash picks anchors: in every string of the length asked for, the anchor
is the position with the smallest hash among those near its start, so equal
strings have the same anchor wherever they stand, and no two anchors are further
apart than the span looked at.  A string can occur again only if its anchor's
core, the bytes that all strings of the anchor share, does.  So the entries (the
bytes that the strings of one anchor cover) are first counted by core and by
whole entry, with 64 bits of hash each: inside each batch before anything is
shuffled, then over all.  An entry that occurs twice is all repeats; one whose
core occurs once is none.

The rest, entries that occur once while their core occurs again, is settled on
bytes by prefix-free parsing.  Rolling-hash triggers cut the bytes after an anchor
(and those before it, read backwards) into phrases.  The distinct phrases are the
dictionary, the sequences of their ranks the parse; sorting the dictionary and
then the parse puts the suffixes in corpus order, and common prefixes between
neighbours give the classes of equal suffixes for every length at once.  A string
is the pair of its two classes, before and after the anchor: repeated exactly if
that pair occurs again.  Dictionary and parse are dealt by core, so equal strings
meet.  A core with more than ``hot_core`` distinct entries is not gathered; its
strings are counted by 128-bit hash with partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import RollingHash, as_text, hot_keys, kind_of, mixed, numbered, only_rows, salted_join, shuffle_width, stored

LENGTH = 200
TRIGGER = 16
SPAN = 128
ITEMS_PER_TASK = 20_000
HOT_CORE = 4_096
#: Cores with more items than this are counted by partial sums and split over SALTS tasks.
HOT, SALTS = 1_024, 64
#: Mean length of a phrase.
PHRASE = 32
_HASH, _SECOND = RollingHash(211), RollingHash(223)
_PLACE = np.uint64((1 << 31) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Parse:
    """The triggers of one text: position, and first and last start of the strings that have it."""

    def __init__(self, data: np.ndarray, length: int, span: int):
        self.data, self.length = data, length
        empty = np.empty(0, np.int64)
        self.at, self.low, self.high = empty, empty, empty
        if len(data) < length:
            return
        self.prefix = _HASH.prefix(data)
        order = mixed(_HASH.windows(self.prefix, TRIGGER))
        # the position, counted down, settles ties: the last of equal hashes wins
        order = (order & ~_PLACE) | (_PLACE - np.arange(len(order), dtype=np.uint64))
        best = _sliding_min(order[: len(data) - length + span], span)
        trigger = (_PLACE - (best & _PLACE)).astype(np.int64)
        first = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
        self.at, self.low, self.high = trigger[first], first, np.append(first[1:], len(trigger)) - 1

    def keys(self, core: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each trigger's core and of its whole entry (with the trigger's place in it)."""
        k = mixed(_HASH.ranges(self.prefix, self.at, self.at + core))
        f = mixed(_HASH.ranges(self.prefix, self.low, self.high + self.length))
        f = mixed(f + (self.at - self.low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (self.high - self.low).astype(np.uint64))
        return k.astype(np.int64), f.astype(np.int64)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _parsed(docs: DataFrame, length: int, span: int) -> DataFrame:
    """Per row of (row, i, t): size, digest, the entries that this batch can't settle (js, ks, fs, ws) and the repeats it found (known)."""
    core = length - span + 1

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for first in range(0, len(whole), 2000):
                batch = whole.iloc[first : first + 2000]
                texts = [_bytes(x) for x in batch["t"]]
                ks, fs = [], []
                for data in texts:
                    p = Parse(np.frombuffer(data, np.uint8), length, span)
                    k, f = p.keys(core) if len(p.at) else (p.at, p.at)
                    ks.append(k)
                    fs.append(f)
                count = [len(k) for k in ks]
                k, f = np.concatenate(ks), np.concatenate(fs)
                order = np.lexsort((f, k))
                new = np.append(True, (k[order][1:] != k[order][:-1]) | (f[order][1:] != f[order][:-1])) if len(k) else np.empty(0, bool)
                group = np.cumsum(new) - 1
                size = np.bincount(group) if len(k) else group
                weight, many = np.zeros(len(k), np.int64), np.zeros(len(k), bool)
                weight[order[new]] = np.minimum(size, 2)
                many[order] = size[group] > 1
                out, at = [], 0
                for data, n, row, i in zip(texts, count, batch["row"], batch["i"]):
                    w = weight[at : at + n]
                    js = np.flatnonzero(w)
                    out.append((row, i, len(data), hashlib.sha256(data).hexdigest(), js, k[at : at + n][js], f[at : at + n][js], w[js], np.flatnonzero(many[at : at + n])))
                    at += n
                yield pd.DataFrame(out, columns=["row", "i", "n_bytes", "sha", "js", "ks", "fs", "ws", "known"])

    schema = "row long, i string, n_bytes long, sha string, js array<int>, ks array<long>, fs array<long>, ws array<int>, known array<int>"
    return docs.select("row", as_text("i").alias("i"), "t").mapInPandas(parse, schema)


def _counted(items: DataFrame) -> DataFrame:
    """(row, j, k, first, weight, entries) of the items whose core occurs again: how often their
    entry occurs (2: twice or more), whether they stand for it, and how many entries share the core."""
    items = hot_keys(items, "k", HOT)(items)
    core, entry = Window.partitionBy("k"), Window.partitionBy("k", "f")
    cold = (
        items.where(~F.col("hot"))
        .repartition("k")
        .withColumn("first", F.row_number().over(entry.orderBy("row", "j")) == 1)
        .withColumn("weight", F.sum("w").over(entry))
        .withColumn("entries", F.sum(F.col("first").cast("int")).over(core))
    )
    # cores with very many items are counted by partial sums, and joined in salts
    many = items.where("hot").drop("hot")
    entries = stored(many.groupBy("k", "f").agg(F.sum("w").alias("weight"), F.min(F.struct("row", "j")).alias("one")))
    cores = entries.groupBy("k").agg(F.count("*").alias("entries")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = entries.withColumn("salt", F.pmod(F.xxhash64("f"), F.lit(SALTS)).cast("int")).join(cores, ["k", "salt"]).drop("salt")
    warm = salted_join(many, known, ["f", "k"], ["row", "j"], HOT, SALTS)
    columns = ["row", "j", "k", "first", "weight", "entries"]
    counted = cold.select(*columns).unionByName(warm.withColumn("first", F.struct("row", "j") == F.col("one")).select(*columns))
    return counted.where("weight > 1 or entries > 1").withColumn("weight", F.least("weight", F.lit(2)))


def _reversed_left(data: np.ndarray, at: np.ndarray, low: np.ndarray, span: int) -> np.ndarray:
    """Rows of the bytes before each trigger, nearest first; 0 beyond the entry."""
    offset = np.arange(1, span)
    place = at[:, None] - offset[None, :]
    return np.where(place >= low[:, None], data[np.maximum(place, 0)], 0).astype(np.uint8)


def _right(data: np.ndarray, at: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Rows of the bytes from each trigger on; 0 beyond the entry."""
    place = at[:, None] + np.arange(length)[None, :]
    return np.where(place < end[:, None], data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)


def _phrases(rows: np.ndarray) -> np.ndarray:
    """Marks [row, i]: a phrase ends before byte i, where the hash of the TRIGGER bytes before it is 0
    modulo PHRASE.  Bytes alone decide it, so rows that agree are cut alike."""
    hashed = np.zeros((len(rows), rows.shape[1] - TRIGGER + 1), np.uint64)
    for i in range(TRIGGER):
        hashed = hashed * np.uint64(_HASH.base) + _HASH.table[rows[:, i : i + hashed.shape[1]]]
    ends = np.zeros((len(rows), rows.shape[1] + 1), bool)
    ends[:, TRIGGER:] = mixed(hashed) % np.uint64(PHRASE) == 0
    ends[:, -1] = True
    return ends


def _suffix_order(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of suffixes (rows of bytes) inside groups, and each one's common prefix with the one before (-1: new group).

    Each suffix is a sequence of phrases, the first of them a suffix of a phrase.
    The distinct ones are the dictionary; sorting it gives their ranks, and the
    sequences of ranks, the parse, sort like the bytes: no phrase is a proper
    prefix of another, since it would have been cut there too.
    """
    row, end = np.nonzero(_phrases(rows))
    start = np.where(np.append(True, row[1:] != row[:-1]), 0, np.append(0, end[:-1]))
    flat, width = rows.tobytes(), rows.shape[1]
    pieces = [flat[a:b] for a, b in zip((row * width + start).tolist(), (row * width + end).tolist())]
    rank = {x: i for i, x in enumerate(sorted(set(pieces)), 1)}
    place = np.arange(len(row)) - np.searchsorted(row, row)
    parse = np.zeros((len(rows), place.max(initial=0) + 1), np.int32)
    parse[row, place] = [rank[x] for x in pieces]
    order = np.lexsort((*parse.T[::-1], group))
    common = np.full(len(order), -1)
    if len(order) > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[1:] = np.where(group[order[1:]] == group[order[:-1]], lcp, -1)
    return order, common


def repeated_strings(group: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray, most: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Marks [item, t]: the string with t bytes before the trigger occurs in another item of the group too.

    ``least`` and ``most`` bound t per item.  The strings of an item with a
    weight over 1 occur again by themselves.
    """
    m, span = len(group), left.shape[1] + 1
    out = np.zeros((m, span), bool)
    lorder, lcommon = _suffix_order(group, left)
    rorder, rcommon = _suffix_order(group, right)
    lclass, rclass = np.empty(m, np.int64), np.empty(m, np.int64)
    for t in range(span):
        active = np.flatnonzero((least <= t) & (t <= most))
        if not len(active):
            continue
        lclass[lorder] = np.cumsum(lcommon < t)
        rclass[rorder] = np.cumsum(rcommon < length - t)
        _, inverse = np.unique(lclass[active] * np.int64(m + 1) + rclass[active], return_inverse=True)
        out[active, t] = np.bincount(inverse, weight[active])[inverse] > 1
    return out


def _settle_cores(items: DataFrame, length: int, span: int, n: int) -> DataFrame:
    """(row, j, mask) of entries that occur once, by suffix orders inside each core."""

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        rows = pd.concat(got) if got else pd.DataFrame()
        if not len(rows):
            return
        left = np.frombuffer(b"".join(rows["left"]), np.uint8).reshape(len(rows), span - 1)
        right = np.frombuffer(b"".join(rows["right"]), np.uint8).reshape(len(rows), length)
        marks = repeated_strings(rows["k"].to_numpy(), left, right, rows["least"].to_numpy(), rows["most"].to_numpy(), rows["weight"].to_numpy(), length)
        out = rows[["row", "j"]].assign(mask=[x.tobytes() for x in np.packbits(marks, axis=1)])
        yield out[marks.any(axis=1) & (rows["weight"] == 1).to_numpy()]

    return items.repartition(n, "k").mapInPandas(settle, "row long, j int, mask binary")


def _settle_hot(items: DataFrame, length: int, span: int) -> DataFrame:
    """The same for cores with very many entries: strings are counted by hash, with partial sums."""

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                data = np.frombuffer(row.left[::-1] + row.right, np.uint8)
                start = span - 1 - np.arange(row.least, row.most + 1)
                one, two = (h.ranges(h.prefix(data), start, start + length) for h in (_HASH, _SECOND))
                yield pd.DataFrame({"row": row.row, "j": row.j, "w": row.weight, "t": span - 1 - start, "h1": one.astype(np.int64), "h2": two.astype(np.int64)})

    rows = stored(items.mapInPandas(strings, "row long, j int, w long, t int, h1 long, h2 long"))
    twice = rows.groupBy("h1", "h2").agg(F.sum("w").alias("n")).where("n > 1").select("h1", "h2")
    marked = salted_join(rows.where("w = 1"), twice, ["h1", "h2"], ["row", "j", "t"], HOT, SALTS).groupBy("row", "j").agg(F.collect_set("t").alias("ts"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = np.zeros((len(batch), span), bool)
            for i, ts in enumerate(batch["ts"]):
                marks[i, np.asarray(ts, np.int64)] = True
            yield batch[["row", "j"]].assign(mask=[x.tobytes() for x in np.packbits(marks, axis=1)])

    return marked.mapInPandas(pack, "row long, j int, mask binary")


def repeat_spans(
    df: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, span: int = SPAN, hot_core: int = HOT_CORE, cut_text: bool = False, row: str | None = None
) -> DataFrame:
    """``id_col``, ``row``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` per row,
    and with ``cut_text`` the ``kept`` text, null where nothing is removed.  ``row``
    names a column of distinct longs; without one the rows are numbered here.

    Removes each byte of a UTF-8 text that lies in a string of ``length`` bytes
    which starts anywhere else too, in this row or another; strings are judged on
    the input and never cross rows.  Null and empty texts, and those shorter than
    ``length``, keep everything; longer ones are read whole, up to the 2**31
    bytes of a string.  Repeated rows repeat each other, so there is no first one
    that stays.  Bytes left of a split character are dropped from ``kept`` (not
    from the digest).  Null ids are kept, an empty table gives none; other
    columns are not read.
    """
    if not TRIGGER <= length - span + 1:
        raise ValueError("the span leaves no room for a trigger")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("i"), F.col(text).alias("t"), *([F.col(row).alias("row")] if row else []))
    docs = docs if row else numbered(docs, "row")
    rows = stored(_parsed(docs, length, span))
    items = rows.select("row", F.inline(F.arrays_zip("js", "ks", "fs", "ws"))).toDF("row", "j", "k", "f", "w")
    counted = stored(_counted(items))
    open_ = counted.where("entries > 1 and first")
    # only cores where some entry occurs once have anything left to settle
    unsettled = open_.where("weight = 1").select("k").distinct()
    asked = stored(salted_join(open_, unsettled, ["k"], ["row", "j"], HOT, SALTS, "left_semi").groupBy("row").agg(F.collect_list(F.struct("j", "k", "weight", "entries")).alias("asked")))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                data = np.frombuffer(_bytes(row.t), np.uint8)
                p = Parse(data, length, span)
                ask = [x if isinstance(x, dict) else x.asDict() for x in row.asked]
                j = np.array([x["j"] for x in ask])
                at, low, high = p.at[j], p.low[j], p.high[j]
                left, right = _reversed_left(data, at, low, span), _right(data, at, high + length, length)
                yield pd.DataFrame(
                    {
                        "row": row.row, "j": j, "k": [x["k"] for x in ask], "weight": [x["weight"] for x in ask], "entries": [x["entries"] for x in ask],
                        "least": at - high, "most": at - low, "left": [x.tobytes() for x in left], "right": [x.tobytes() for x in right],
                    }
                )

    schema = "row long, j int, k long, weight long, entries long, least int, most int, left binary, right binary"
    texts = only_rows(docs.select("row", "t"), "row", asked.select("row")).join(asked, "row")
    look = stored(texts.mapInPandas(entries, schema))
    tasks = shuffle_width(spark, look.count(), ITEMS_PER_TASK)
    marks = _settle_cores(look.where(F.col("entries") <= hot_core), length, span, tasks)
    hot = look.where(F.col("entries") > hot_core)
    if hot.head(1):
        marks = marks.unionByName(_settle_hot(hot, length, span))
    whole = counted.where("weight > 1").select("row", "j", F.lit(None).cast("binary").alias("mask"))
    settled = whole.unionByName(marks).select("row", F.struct("j", "mask").alias("one"), F.lit(None).cast("array<int>").alias("known"))
    local = rows.where(F.size("known") > 0).select("row", F.lit(None).cast("struct<j:int,mask:binary>").alias("one"), "known")
    found = stored(settled.unionByName(local).groupBy("row").agg(F.collect_list("one").alias("found"), F.flatten(F.collect_list("known")).alias("known")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                raw = _bytes(row.t)
                data = np.frombuffer(raw, np.uint8)
                p = Parse(data, length, span)
                starts = np.zeros(len(data) + 1, np.int32)
                for j in row.known:
                    starts[p.low[j] : p.high[j] + 1] = 1
                for x in row.found:
                    j, mask = (x["j"], x["mask"]) if isinstance(x, dict) else (x[0], x[1])
                    if mask is None:
                        starts[p.low[j] : p.high[j] + 1] = 1
                    else:
                        t = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8)))
                        starts[p.at[j] - t] = 1
                at = np.flatnonzero(starts)
                change = np.zeros(len(data) + 1, np.int32)
                change[at] += 1
                change[at + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                kept = data[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(np.append(0, gone.astype(np.int8))) == 1))
                out.append((row.row, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if cut_text else None))
            yield pd.DataFrame(out, columns=["row", "n_removed", "n_spans", "kept_sha256", "kept"])

    flagged = only_rows(docs.select("row", "t"), "row", found.select("row")).join(found, "row")
    result = flagged.mapInPandas(cut, "row long, n_removed long, n_spans long, kept_sha256 string, kept string")
    out = rows.select("i", "row", "n_bytes", "sha").join(result, "row", "left").select(
        F.col("i").cast(kind_of(df, id_col)).alias(id_col), "row", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept",
    )
    return out if cut_text else out.drop("kept")
