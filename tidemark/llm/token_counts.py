"""Exact token counts at every prefix of a text, by dynamic programming.

A byte-pair vocabulary that ranks merges by their result has one valid
encoding of each string, and validity is local: a token sequence is the
encoding exactly if each adjacent pair is the encoding of its own
concatenation.  So the encoding of a prefix ends in the one vocabulary piece
that fits the last token of the encoding of what stands before it, and a single
left-to-right pass gives the count at *every* prefix.  Truncation points and
budget questions are read from that table; nothing is encoded again.

No piece crosses from a non-space character to a space, so a text is a sum over
its space-led segments and each distinct segment is solved once per worker (the
memo is bounded; dropping it costs time only).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_text, kind_of

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MEMO_ENTRIES = 1_000_000
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


class Memo(dict):
    """A bounded table of solved strings; when full it starts again."""

    def __init__(self, solve: Callable[[str], int], entries: int):
        self.solve, self.entries = solve, entries

    def __missing__(self, key: str) -> int:
        out = self.solve(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[key] = out
        return out


class PrefixCounter:
    """Prefix token counts for a sentencepiece byte-pair model with byte fallback."""

    def __init__(self, model_file: str, memo_entries: int = MEMO_ENTRIES):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        self.trie: dict = {}
        for piece in self.scores:
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = piece
        crossing = [p for p in self.scores if SPACE in p[1:] and p.strip(SPACE)]
        if crossing:
            raise ValueError(f"pieces cross from text to a space: {crossing[:3]}")
        self.memo_entries = memo_entries
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.memo = Memo(lambda segment: self.segment_prefixes(segment)[-1], memo_entries)
        self.words = Memo(lambda word: self.segment_prefixes(SPACE + word)[-1], memo_entries)
        self.runs = [0]

    def merged(self, text: str) -> list[str]:
        """The plain merge loop: highest score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, known: dict[str, bool], left: str, right: str) -> bool:
        self.n_fits += 1
        if self.n_fits > self.memo_entries:
            for after in self.fits.values():
                after.clear()
            self.n_fits = 1
        known[right] = out = self.merged(left + right) == ([left, right] if left else [right])
        return out

    def _cost(self, token: str) -> int:
        return 1 if token in self.scores else len(token.encode("utf-8", "surrogatepass"))

    def prefixes(self, segment: str) -> tuple[list[int], list[bool]]:
        """Per prefix length: token count, and whether the first token is a bare space mark."""
        n, fits, trie = len(segment), self.fits, self.trie
        counts, last, bare = [0] + [-1] * n, [""] * (n + 1), [False] * (n + 1)
        for j in range(n):
            known, node, i = fits.get(last[j]), trie, j
            if known is None:
                known = fits[last[j]] = {}
            while i < n:
                node = node.get(segment[i])
                i += 1
                if node is None:
                    if i > j + 1:
                        break
                    piece, cost = segment[j], self._cost(segment[j])
                else:
                    piece, cost = node.get(""), 1
                if piece is not None and counts[i] < 0:
                    fit = known.get(piece)
                    if fit is None:
                        fit = self._fit(known, last[j], piece)
                    if fit:
                        counts[i], last[i] = counts[j] + cost, piece
                        bare[i] = bare[j] if j else piece == SPACE
                if node is None:
                    break
        return counts, bare

    def run(self, n: int) -> int:
        """Tokens of n space marks in a row."""
        while len(self.runs) <= min(n, 96):
            self.runs.append(len(self.merged(SPACE * len(self.runs))))
        if n < len(self.runs):
            return self.runs[n]
        period, more = 16, (n - 80 + 15) // 16
        return self.runs[n - more * period] + more

    def segment_prefixes(self, segment: str) -> list[int]:
        """Counts at every prefix of one segment: space marks, then text without any."""
        text = segment.lstrip(SPACE)
        k = len(segment) - len(text)
        if not k:
            return self.prefixes(segment)[0]
        out = [self.run(i) for i in range(k + 1)]
        counts, bare = self.prefixes(SPACE + text)
        out += [self.run(k) + counts[i] - 1 if bare[i] else self.run(k - 1) + counts[i] for i in range(2, len(counts))]
        return out

    def segment_count(self, segment: str) -> int:
        if len(segment) > 64:
            return self.segment_prefixes(segment)[-1]
        return self.memo[segment]

    def segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, text: str) -> int:
        words = text.split(" ")
        if "" in words or SPACE in text:
            return sum(map(self.segment_count, self.segments(text)))
        return sum(map(self.words.__getitem__, words))

    def prefix_counts(self, text: str) -> list[int]:
        """Token count of ``text[:i]`` for i = 0 .. len(text)."""
        out, base = [0], 0
        for k, segment in enumerate(self.segments(text)):
            inner = self.segment_prefixes(segment)
            # the first mark of the text is added by the model and is no character
            out += [base + x for x in inner[2 if k == 0 else 1 :]]
            base += inner[-1]
        return out

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that takes at most ``budget`` tokens."""
        base, at = 0, -1
        found = 0
        for segment in self.segments(text):
            if base > budget:
                break
            whole = self.segment_count(segment)
            if base + whole <= budget:
                found = at + len(segment)
            else:
                inner = self.segment_prefixes(segment)
                found = max([found, *(at + i for i in range(1, len(inner)) if base + inner[i] <= budget)])
            base, at = base + whole, at + len(segment)
        return found


@lru_cache(2)
def _counter(model_file: str | None) -> PrefixCounter:
    """One per Python worker, so that its solved segments serve all of the worker's tasks."""
    import public_tokenizers

    return PrefixCounter(model_file or public_tokenizers.path(MODEL))


def token_counts(
    df: DataFrame, text: str = "text", id_col: str = "doc_id", limit: int = 4096, model_file: str | None = None
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars`` per row.

    ``fit_chars`` is the length of the longest prefix within ``limit`` tokens
    (of equally good ones there is but the longest).  A null text counts as
    empty: 0 bytes, 0 tokens.  Texts of any length are taken whole, segment by
    segment.  Null ids and repeated rows are kept as rows of their own, an empty
    table gives none; other columns of ``df`` are not read.  One pass without a
    shuffle.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(model_file)
        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch["t"]]
            tokens = [counter.count(x) for x in texts]
            yield pd.DataFrame(
                {
                    "i": batch["i"],
                    "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in texts],
                    "n_tokens": tokens,
                    "over_limit": [n > limit for n in tokens],
                    "fit_chars": [counter.fit(x, limit) if n > limit else len(x) for x, n in zip(texts, tokens)],
                }
            )

    found = df.select(as_text(id_col).alias("i"), F.col(text).alias("t")).mapInPandas(count, "i string, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return found.select(F.col("i").cast(kind_of(df, id_col)).alias(id_col), "n_bytes", "n_tokens", "over_limit", "fit_chars")


def prefix_tables(df: DataFrame, text: str = "text", id_col: str = "doc_id", model_file: str | None = None) -> DataFrame:
    """``id_col``, ``prefix_tokens`` (array of int) per row: the tokens of each prefix of 0, 1, 2, ... characters.

    Stored once, the table answers every later question of truncation and budget
    (``within_budget``) without encoding.  Null texts count as empty: [0].  Texts
    are taken whole.  Null ids and repeated rows are kept as rows of their own,
    an empty table gives none; other columns are not read.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(model_file)
        for batch in batches:
            yield pd.DataFrame({"i": batch["i"], "prefix_tokens": [counter.prefix_counts(x if isinstance(x, str) else "") for x in batch["t"]]})

    found = df.select(as_text(id_col).alias("i"), F.col(text).alias("t")).mapInPandas(solve, "i string, prefix_tokens array<int>")
    return found.select(F.col("i").cast(kind_of(df, id_col)).alias(id_col), "prefix_tokens")


def within_budget(prefix_tokens: str | Column, budget: int) -> Column:
    """Characters of the longest prefix that takes at most ``budget`` tokens, read from a prefix table.

    Counts may fall by one or more where a merge completes, so the last that fits
    counts.  A null table gives null; a budget below 0, which nothing fits, raises."""
    if budget < 0:
        raise ValueError("a budget is at least 0 tokens")
    counts = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    return F.size(counts) - 1 - (F.array_position(F.transform(F.reverse(counts), lambda n: n <= budget), True).cast("int") - 1)
