"""Hierarchical packing of token streams into windows of several lengths.

A document longer than the longest window fills whole such windows; what is left
of it, or a shorter document whole, is routed to the least of the tiers 4096,
2048, 1024, 512 that holds it.  The longest tier is packed first: its pieces open
windows, and their gaps are filled with pieces of the shorter tiers.  Each
shorter tier then packs its pieces with others of its own and shorter ones, and
closes the windows that come out full to the last token; the few pieces that
find no such window go to long windows, best fit first.  The cuts depend on the
document alone, so one pass over the texts yields every piece with its checksum,
and packing moves a few integers per piece, never text.  Equal pieces are counted
first, then dealt to groups by hash, so no task sees more than a bounded share
and no source, hot document or repeated row can gather in one.

Windows of one tier are dealt to steps of about ``step_tokens`` tokens, heaviest
attention cost first in alternating order, so that steps cost about the same.  A
group of pieces makes steps of its own; groups are alike, as hashes deal them.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_text, kind_of, shuffle_width, stored

TOKENIZER = "word_bpe_49k.json"
TIERS = (4096, 2048, 1024, 512)
END_ID = 2
STEP_TOKENS = 1 << 18
GROUP_PIECES = 60_000
#: Equal pieces are dealt to groups in chunks of this many.
CHUNK = 1_024
#: First pieces tried for a gap of a shorter tier.
TRIES = 16
_PIECE_COLUMNS = ["i", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
WORD_END = "</w>"
#: A worker holds up to about 350 MB of known words and stems; a full table starts again.
WORD_ENTRIES, STEM_ENTRIES = 500_000, 800_000
#: Python's str.split() takes these as white space, the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters whose lower case and composition are the same everywhere, then marks that never join letters.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,:;!?|#$%&*]*)")


class WordEncoder:
    """Token ids as little-endian bytes; each distinct word is encoded once per worker.

    The tokenizer drops white space and never looks across it, so the ids of a
    text are the ids of its white-space-separated words in a row.  It folds case
    and splits letters from punctuation too, so plain words share their stem's ids.
    """

    def __init__(self, tokenizer_file: str, words: int = WORD_ENTRIES, stems: int = STEM_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {"": b""}
        self.most_words, self.most_stems = words, stems

    def _encode(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (x.ids for x in encoded)]

    def _encode_stems(self, stems: list[str]) -> list[bytes]:
        """Stems are one word each to the tokenizer, so one call encodes many; a
        word's last token carries the mark of a word's end."""
        out: list[bytes] = []
        for at in range(0, len(stems), 2000):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(stems[at : at + 2000])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(stems[at : at + 2000]):
                return self._encode(stems)
            data, edges = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [data[a:b] for a, b in zip(edges, edges[1:])]
        return out

    def _learn(self, new: set[str]) -> None:
        plain, other = {}, []
        for w in new:
            m = _PLAIN.fullmatch(w)
            if m:
                plain[w] = (m[1].lower(), m[2])
            else:
                other.append(w)
        stems = {x for pair in plain.values() for x in pair}
        if len(self.stems) + len(stems) > self.most_stems:
            self.stems = {"": b""}
        stems = list(stems.difference(self.stems))
        self.stems.update(zip(stems, self._encode_stems(stems)))
        known = self.stems
        self.words.update((w, known[a] + known[b]) for w, (a, b) in plain.items())
        self.words.update(zip(other, self._encode(other)))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 32):
            some = texts[at : at + 32]
            odd = [_ODD_SPACE.search(x) is not None for x in some]
            split = [[] if o else x.split() for x, o in zip(some, odd)]
            new = set().union(*split).difference(self.words)
            if new:
                if len(self.words) + len(new) > self.most_words:
                    self.words = {}
                    new = set().union(*split)
                self._learn(new)
            words = self.words
            for x, o, parts in zip(some, odd, split):
                yield self._encode([x])[0] if o else b"".join([words[w] for w in parts])


def cuts(n: int, top: int = TIERS[0]) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full windows of the longest tier, then the rest."""
    return [(at, min(top, n - at)) for at in range(0, n, top)]


class Shelf:
    """Pieces that wait, by length; a bit per length, and one mirrored, says which there are."""

    def __init__(self, lengths: list[int], top: int):
        self.top, self.bits, self.mirror = top, 0, 0
        self.at: dict[int, list[int]] = defaultdict(list)
        for i in range(len(lengths) - 1, -1, -1):
            self.at[lengths[i]].append(i)
        for n in self.at:
            self.bits |= 1 << n
            self.mirror |= 1 << (top - n)

    def take(self, n: int) -> int:
        waiting = self.at[n]
        piece = waiting.pop()
        if not waiting:
            self.bits ^= 1 << n
            self.mirror ^= 1 << (self.top - n)
        return piece

    def longest(self, most: int) -> int:
        """The greatest length up to ``most``; 0 if there is none."""
        return max((self.bits & ((2 << most) - 1)).bit_length() - 1, 0)

    def pair(self, gap: int) -> tuple[int, ...]:
        """One or two lengths that fill the gap to the last token, the first the longer; () if there are none."""
        if self.bits >> gap & 1:
            return (gap,)
        # bit n: both n and gap - n wait
        both = self.bits & (self.mirror >> (self.top - gap)) & ((1 << gap) - 2)
        while both:
            n = both.bit_length() - 1
            if 2 * n < gap:
                break
            if 2 * n > gap or len(self.at[n]) > 1:
                return (n, gap - n)
            both ^= 1 << n
        return ()

    def exact(self, gap: int) -> tuple[int, ...]:
        """Up to three lengths that fill the gap; the longest that lets the others do so is tried first."""
        found = self.pair(gap)
        n = gap
        for _ in range(TRIES):
            if found:
                return found
            n = self.longest(n - 1) if n > 1 else 0
            if not n:
                break
            rest = self.pair(gap - n)
            # a length may be used as often as it waits
            if rest and all(rest.count(x) + (x == n) <= len(self.at[x]) for x in rest):
                found = (n, *rest)
        return found


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset per length; longest first into the tightest gap."""
    open_at: dict[int, list[int]] = defaultdict(list)
    gaps, made = 0, 0
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fit = gaps >> n
        if fit:
            gap = n + (fit & -fit).bit_length() - 1
            k = open_at[gap].pop()
            if not open_at[gap]:
                gaps ^= 1 << gap
        else:
            gap, k, made = window, made, made + 1
        where[i], offset[i] = k, window - gap
        if gap > n:
            if not open_at[gap - n]:
                gaps |= 1 << (gap - n)
            open_at[gap - n].append(k)
    return where, offset


def pack_tiers(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window number, offset and tier of each piece; no piece is longer than the first tier."""
    top = tiers[0]
    window, offset, tier = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.full(len(lengths), top)
    shelf, made, left = Shelf(lengths, top), 0, []

    def close(pieces: list[int], size: int) -> int:
        at = 0
        for i in pieces:
            window[i], offset[i], tier[i] = made, at, size
            at += lengths[i]
        return made + 1

    for size, below in zip(tiers, (*tiers[1:], 0)):
        while (n := shelf.longest(size)) > below:
            pieces, gap = [shelf.take(n)], size - n
            if size == top:
                # the gap takes the longest pieces of the shorter tiers, the last ones exactly if they can
                while gap and (n := shelf.longest(gap)):
                    for n in shelf.pair(gap) or (n,):
                        pieces.append(shelf.take(n))
                        gap -= n
            elif gap:
                pieces += [shelf.take(n) for n in shelf.exact(gap)]
                if len(pieces) == 1:
                    left += pieces
                    continue
            made = close(pieces, size)
    where, at = best_fit([lengths[i] for i in left], top)
    window[left], offset[left] = np.array(where, np.int64) + made, at
    return window, offset, tier


def _packed(group: pd.DataFrame, tiers: tuple[int, ...], step_tokens: int) -> pd.DataFrame:
    group = group.sort_values(["length", "i", "start", "ids_crc32", "chunk"], ascending=[False, True, True, True, True], kind="stable", na_position="last")
    group = group.loc[group.index.repeat(group["n"])].reset_index(drop=True)
    window, offset, tier = pack_tiers(group["length"].tolist(), tiers)
    n = int(window.max()) + 1
    size = np.zeros(n, np.int64)
    size[window] = tier
    fill = np.bincount(window, group["length"], n).astype(np.int64)
    size = np.where((fill & (fill - 1)) == 0, fill, size)
    cost = np.bincount(window, group["length"].to_numpy(float) ** 2, n)
    step, first = np.zeros(n, np.int64), 0
    for t in np.unique(size)[::-1]:
        members = np.flatnonzero(size == t)
        members = members[np.argsort(-cost[members], kind="stable")]
        steps = max(1, -(-len(members) * int(t) // step_tokens))
        lane = np.arange(len(members)) % (2 * steps)
        step[members] = first + np.where(lane < steps, lane, 2 * steps - 1 - lane)
        first += steps
    base = group["pack_group"].to_numpy() << 32
    return group.assign(sequence_id=base + window, offset=offset, window=size[window], step_group=base + step[window])[_PIECE_COLUMNS]


@lru_cache(2)
def _encoder(tokenizer_file: str | None) -> WordEncoder:
    """One per Python worker, so that its known words serve all of the worker's tasks."""
    import public_tokenizers

    return WordEncoder(tokenizer_file or public_tokenizers.path(TOKENIZER))


def token_pieces(df: DataFrame, text: str, id_col: str, tokenizer_file: str | None, top: int) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_file)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            texts = [x if isinstance(x, str) else "" for x in batch["t"]]
            for key, ids in zip(batch["i"], encoder.ids(texts)):
                data = ids + end
                n = len(data) // 4
                rows += [(key, a, m, zlib.crc32(data[4 * a : 4 * (a + m)]), n) for a, m in cuts(n, top)]
            yield pd.DataFrame(rows, columns=["i", "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(as_text(id_col).alias("i"), F.col(text).alias("t")).mapInPandas(cut, "i string, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(
    df: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    tokenizer_file: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``, ``window``, ``step_group``.

    A null or empty text is one piece that holds only the end id; a text of any
    length is cut at multiples of the longest tier alone.  A null id is kept;
    repeated rows are documents of their own; pieces of one length are taken in
    the order of id (as text), start and checksum.  An empty table gives none.
    Other columns of ``df`` are not read.  Equal inputs give equal results,
    whatever their order.
    """
    keys = ["i", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = token_pieces(df, text, id_col, tokenizer_file, tiers[0])
    units = stored(pieces.groupBy(*keys).agg(F.count("*").alias("n")))
    total = units.agg(F.sum("n")).head()[0] or 0
    groups = max(1, -(-total // GROUP_PIECES))
    last = F.floor((F.col("n") - 1) / CHUNK).cast("int")
    chunks = units.select(*keys, "n", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    dealt = chunks.withColumns({
        "n": F.least(F.col("n") - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("long"),
        "pack_group": F.pmod(F.xxhash64("i", "start", "ids_crc32", "chunk"), F.lit(groups)),
    }).repartition(shuffle_width(df.sparkSession, groups, 1), "pack_group")
    schema = "i string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"
    packed = dealt.groupBy("pack_group").applyInPandas(lambda g: _packed(g, tiers, step_tokens), schema)
    return packed.select(F.col("i").cast(kind_of(df, id_col)).alias(id_col), *_PIECE_COLUMNS[1:])
