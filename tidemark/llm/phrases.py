"""Removal of passages that recur, by automata of repeated phrases.

Texts are sequences of words; a window is a fixed number of them.  Rolling hashes
pick an anchor in each window, the least-hashed place near its start, so equal
windows have the same anchor wherever they stand.  The windows of one anchor form
an entry, and all of them hold the anchor's core, the words that follow it.  Each
different text is read once, whatever its copies.

Which windows recur is told from counts of 64-bit hashes with partial sums, in
two steps: entries that stand in two places are phrases whole; where an entry
stands once but its core recurs, its windows are counted one by one, by the
hashes of core and window.  Each place that recurs points to the first place of
its words.  Places that follow each other here and there merge into passages.

The words of the passages are then fetched from where they stand first, dealt to
the shards of texts that point to them, and compiled into one Aho-Corasick
automaton a shard, over words and not over hashes.  All texts of the shard stream
through it, and what is removed is what it finds, word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import RollingHash, mixed, numbered, only_rows, shuffle_width, stored

WINDOW = 35
#: Anchors lie among so many places from a window's start on; a core is what is left of the window.
SPAN = 28
#: Words hashed to choose an anchor.
TRIGGER = 4
#: Texts read at once, and words in the texts of one shard (a longer text is a shard's by itself).
BATCH = 1_000
WORDS_PER_SHARD = 500_000
_LETTERS, _WORDS = RollingHash(307), RollingHash(311)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_PLACE = np.uint64((1 << 31) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class WordHashes:
    """Hashes of a text's words and of any run of them."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        space = np.concatenate(([True], _SPACE[raw], [True]))
        first, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        self.n = len(first)
        words = mixed(_LETTERS.ranges(_LETTERS.prefix(raw), first, end)) if self.n else np.empty(0, np.uint64)
        _WORDS.prefix(np.zeros(self.n, np.uint8))  # long enough powers
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * _WORDS.down[: self.n], out=self.prefix[1:])

    def runs(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(_WORDS.ranges(self.prefix, first, end))

    def windows(self, width: int) -> np.ndarray:
        return mixed(_WORDS.windows(self.prefix, width)) if self.n >= width else np.empty(0, np.uint64)

    def entries(self, window: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor: first window, number of windows, hash of the core, hash of the entry and the anchor's place in it."""
        if self.n < window:
            empty = np.empty(0, np.int64)
            return empty, empty, empty, empty
        order = self.windows(TRIGGER)
        # the position, counted down, settles ties: the last of equal hashes wins
        order = (order & ~_PLACE) | (_PLACE - np.arange(len(order), dtype=np.uint64))
        anchor = (_PLACE - (_least(order[: self.n - window + span], span) & _PLACE)).astype(np.int64)
        low = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        high, at = np.append(low[1:], len(anchor)) - 1, anchor[low]
        core = self.runs(at, at + window - span + 1)
        entry = mixed(self.runs(low, high + window) + (at - low).astype(np.uint64) * _ODD + (high - low).astype(np.uint64))
        return low, high - low + 1, core.astype(np.int64), entry.astype(np.int64)


def _texts(docs: DataFrame, window: int, span: int) -> DataFrame:
    """One numbered row per different text of (d, t): copies, words, the digest of all its words, and its entries."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for first in range(0, len(whole), BATCH):
                out: dict[bytes, list] = {}
                for d, text in zip(whole["d"].iloc[first : first + BATCH], whole["t"].iloc[first : first + BATCH]):
                    d = bytes(d)
                    if d in out:
                        out[d][1] += 1
                        continue
                    data = _bytes(text)
                    hashes = WordHashes(data)
                    out[d] = [d, 1, hashes.n, hashlib.sha256(b" ".join(data.split())).hexdigest(), *hashes.entries(window, span)]
                yield pd.DataFrame(list(out.values()), columns=["d", "n", "n_words", "sha", "lows", "sizes", "ks", "fs"])

    parsed = docs.mapInPandas(read, "d binary, n long, n_words long, sha string, lows array<int>, sizes array<int>, ks array<long>, fs array<long>")
    same = [F.first(c).alias(c) for c in ("n_words", "sha", "lows", "sizes", "ks", "fs")]
    return numbered(parsed.groupBy("d").agg(F.sum("n").alias("n"), *same), "row")


def _with_text(docs: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (one row per number ``row``) with the text ``t``, fetched from one of its copies."""
    keyed = texts.select("row", "d").join(wanted, "row")
    found = only_rows(docs, "d", keyed.select("d")).dropDuplicates(["d"])
    return found.join(keyed, "d").drop("d")


def _recurring_entries(items: DataFrame) -> DataFrame:
    """(k, f, weight, entries, least, size, one) of the entries whose core stands in two places:
    how often the entry does, how many entries the core has and the rarest one's count, and where the entry stands first."""
    entries = stored(items.groupBy("k", "f").agg(F.sum("w").alias("weight"), F.min(F.struct("row", "low")).alias("one"), F.max("size").alias("size")))
    cores = entries.groupBy("k").agg(F.count("*").alias("entries"), F.min("weight").alias("least"), F.sum("weight").alias("all")).where(F.col("all") > 1).drop("all")
    return stored(entries.join(cores, "k"))


def _recurring_windows(docs: DataFrame, texts: DataFrame, live: DataFrame, window: int) -> DataFrame:
    """(row, low, size, to, shift) of single windows that recur in entries that stand once."""
    # only cores with several entries, one of them standing once, have anything to settle
    asked = live.where("entries > 1 AND least = 1").groupBy("one.row").agg(F.collect_list(F.struct("one.low", "size", "weight", "k")).alias("asked"))
    asked = asked.select("row", *[F.col(f"asked.{c}").alias(c) for c in ("low", "size", "weight", "k")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, text, low, size, weight, k in zip(*[batch[c] for c in ("row", "t", "low", "size", "weight", "k")]):
                hashes = WordHashes(_bytes(text)).windows(window).astype(np.int64)
                size = np.asarray(size, np.int64)
                at = np.repeat(np.asarray(low, np.int64), size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                out.append((row, at, np.repeat(np.asarray(k, np.int64), size), hashes[at], np.repeat(np.asarray(weight, np.int64), size)))
            yield pd.DataFrame(out, columns=["row", "at", "k", "h", "w"])

    read = stored(_with_text(docs, texts, asked).mapInPandas(count, "row long, at array<int>, k array<long>, h array<long>, w array<long>"))
    each = read.select("row", F.inline(F.arrays_zip("at", "k", "h", "w")))
    again = each.groupBy("k", "h").agg(F.sum("w").alias("n"), F.min(F.struct("row", "at")).alias("one")).where("n > 1").drop("n")
    single = each.where("w = 1").join(again, ["k", "h"])
    return single.select("row", F.col("at").alias("low"), F.lit(1).alias("size"), F.col("one.row").alias("to"), (F.col("one.at") - F.col("at")).alias("shift"))


def _passages(claims: DataFrame, window: int) -> DataFrame:
    """(row, to, a, b) per text: the words [a, b) of the texts that it points to; neighbours that point alike are one."""
    by_text = claims.groupBy("row").agg(F.collect_list(F.struct("to", "shift", "low", "size")).alias("c"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, to, shift, low, size in zip(*[batch[c] for c in ("row", "to", "shift", "low", "size")]):
                to, shift, low, size = (np.asarray(x, np.int64) for x in (to, shift, low, size))
                order = np.lexsort((low, shift, to))
                to, shift, low, end = to[order], shift[order], low[order], (low + size)[order]
                # places of one text never overlap, so the ends rise with the starts
                new = np.append(True, (to[1:] != to[:-1]) | (shift[1:] != shift[:-1]) | (low[1:] > end[:-1]))
                last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
                out.append((row, to[new], (low + shift)[new], (end + shift)[last] + window - 1))
            yield pd.DataFrame(out, columns=["row", "to", "a", "b"])

    flat = by_text.select("row", *[F.col(f"c.{c}").alias(c) for c in ("to", "shift", "low", "size")])
    return stored(flat.mapInPandas(merge, "row long, to array<long>, a array<int>, b array<int>"))


def _fetched(docs: DataFrame, texts: DataFrame, named: DataFrame) -> DataFrame:
    """(to, a, b, phrase) of each different passage."""
    wanted = named.select("to", "a", "b").distinct().groupBy(F.col("to").alias("row")).agg(F.collect_list(F.struct("a", "b")).alias("c"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, text, firsts, ends in zip(batch["row"], batch["t"], batch["a"], batch["b"]):
                words = _bytes(text).split()
                out += [(row, a, b, b" ".join(words[a:b])) for a, b in zip(firsts, ends)]
            yield pd.DataFrame(out, columns=["to", "a", "b", "phrase"])

    return _with_text(docs, texts, wanted.select("row", F.col("c.a").alias("a"), F.col("c.b").alias("b"))).mapInPandas(cut, "to long, a int, b int, phrase binary")


class PhraseAutomaton:
    """An Aho-Corasick automaton over words: the places of all phrases in a text.

    Words are numbered as they come, so equal numbers are equal words; those of no phrase are 0.
    """

    def __init__(self, phrases: Iterator[bytes]):
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase in phrases:
            key = tuple([self.numbers.setdefault(x, len(self.numbers) + 1) for x in phrase.split()])
            if key:
                self.automaton.add_word(key, len(key))
        if self.numbers:
            self.automaton.make_automaton()

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Marks the words that lie in a phrase."""
        steps = np.zeros(len(words) + 1, np.int32)
        if self.numbers and words:
            known = self.numbers.get
            before = -1
            for end, length in self.automaton.iter(tuple([known(x, 0) for x in words])):
                if end != before:  # the first that ends here is the longest
                    steps[end + 1 - length] += 1
                    steps[end + 1] -= 1
                    before = end
        return np.cumsum(steps[:-1]) > 0


def _located(docs: DataFrame, texts: DataFrame, pointers: DataFrame, phrases: DataFrame, shards: int) -> DataFrame:
    """(row, n_removed, n_spans, kept_sha256, kept) of the texts that point to phrases."""
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long").alias("shard")
    named = pointers.select(shard, F.inline(F.arrays_zip("to", "a", "b"))).distinct()
    dealt = named.join(phrases, ["to", "a", "b"]).select("shard", "phrase")
    streamed = _with_text(docs, texts, pointers.select("row")).select(shard, "row", "t")
    n = shuffle_width(docs.sparkSession, shards, 1)

    def locate(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        automaton, out = PhraseAutomaton(iter(theirs["phrase"])), []
        for row, text in zip(mine["row"], mine["t"]):
            words = _bytes(text).split()
            gone = automaton.covered(words)
            kept = b" ".join([x for x, g in zip(words, gone.tolist()) if not g])
            spans = int(np.count_nonzero(np.diff(np.append(0, gone.astype(np.int8))) == 1))
            out.append((row, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["row", "n_removed", "n_spans", "kept_sha256", "kept"])

    part = lambda x: x.repartition(n, "shard").groupBy("shard")
    return part(streamed).cogroup(part(dealt)).applyInPandas(locate, "row long, n_removed long, n_spans long, kept_sha256 string, kept string")


def repeated_phrases(df: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, span: int = SPAN, words_per_shard: int = WORDS_PER_SHARD, keep_text: bool = False) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` per row, and with
    ``keep_text`` the ``kept`` words, null where nothing is removed.

    Words are the runs of characters that are neither blanks nor the controls 9
    to 13, unchanged.  A word goes if it lies in a window of ``window``
    consecutive words whose words stand in a row anywhere else too, in this text
    or another; windows are judged on the input and never cross texts.  What is
    kept is joined by one blank.  Null and empty texts have no words; texts
    shorter than a window keep all theirs, longer ones are read whole.  Repeated
    rows repeat each other, so there is no first one that stays.  Null ids are
    kept, an empty table gives none; other columns are not read.
    """
    if not TRIGGER <= window - span + 1:
        raise ValueError("the span leaves no room for a trigger")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = df.select(F.unhex(F.md5(whole)).alias("d"), whole.alias("t"))
    texts = _texts(docs, window, span)
    items = texts.select("row", F.least("n", F.lit(2)).alias("w"), F.inline(F.arrays_zip("lows", "sizes", "ks", "fs"))).toDF("row", "w", "low", "size", "k", "f")
    live = _recurring_entries(items)
    often = live.where("weight > 1").select("k", "f", F.col("one.row").alias("to"), F.col("one.low").alias("first"))
    claims = items.join(often, ["k", "f"]).select("row", "low", "size", "to", (F.col("first") - F.col("low")).alias("shift"))
    pointers = _passages(claims.unionByName(_recurring_windows(docs, texts, live, window)), window)
    phrases = _fetched(docs, texts, pointers.select(F.inline(F.arrays_zip("to", "a", "b"))))
    words = texts.agg(F.sum("n_words")).head()[0] or 0
    found = _located(docs, texts, pointers, phrases, max(1, words // words_per_shard))
    result = texts.select("d", "row", "n_words", "sha").join(found if keep_text else found.drop("kept"), "row", "left")
    out = df.select(F.col(id_col).alias("i"), F.unhex(F.md5(whole)).alias("d")).join(result, "d")
    columns = [F.col("i").alias(id_col), "n_words", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")], F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select(*columns, *(["kept"] if keep_text else []))
