"""Texts as strings of one letter a token, on which regular expressions count words and follow negations.

Lambdas over arrays are interpreted, a few nodes for each token and use; the
letters are found once for each token, and all else is compiled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens in no list; no letter at all, so that classes without letters are valid.
OTHER, NONE = "o", "~"
_ALPHABET = "abcdefghijklmnpqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Coding:
    """Letters of tokens by the word lists that hold them; ``cues`` also holds all that ends in n't, ``breaks`` no cue."""

    def __init__(self, **lists: list[str]) -> None:
        held = {n: set(ws) for n, ws in lists.items()}
        signs: dict[frozenset[str], list[str]] = {}
        for w in sorted(set().union(*held.values())):
            mine = {n for n, ws in held.items() if w in ws}
            if "cues" in held and (w in held["cues"] or w.endswith("n't")):
                mine = (mine | {"cues"}) - {"breaks"}
            signs.setdefault(frozenset(mine), []).append(w)
        if "cues" in held:
            signs.setdefault(frozenset({"cues"}), [])
        letters = [*_ALPHABET, *map(chr, range(0x4E00, 0x4E00 + max(0, len(signs) - len(_ALPHABET))))]
        self.words = dict(zip(letters, signs.values()))
        self.signs = dict(zip(letters, signs))
        self.cue = next((x for x, s in self.signs.items() if s == {"cues"}), OTHER)

    def letter(self, word: Column) -> Column:
        """The letter of a lower-cased token."""
        every = [w for ws in self.words.values() for w in ws]
        rest = F.when(word.endswith("n't"), self.cue).otherwise(OTHER) if self.cue != OTHER else F.lit(OTHER)
        if not every:
            return rest
        found = F.when(~word.isin(every), rest)
        for x, ws in self.words.items():
            found = found.when(word.isin(ws), x) if ws else found
        return found

    def code(self, toks: Column) -> Column:
        return F.array_join(F.transform(F.transform(toks, F.lower), self.letter), "")

    def of(self, name: str, *without: str) -> str:
        """The letters of a list's tokens, but for those that one of ``without`` holds too."""
        return NONE + "".join(x for x, s in self.signs.items() if name in s and not s & set(without))

    def _reach(self, window: int) -> str:
        cues, breaks = self.of("cues"), self.of("breaks", "cues")
        return f"([{cues}])([^{cues}{breaks}]{{1,{window}}})"

    def reached(self, code: Column, window: int) -> Column:
        """The letters that a negation reaches: up to ``window`` after a cue, none beyond the next cue or break."""
        return F.array_join(F.regexp_extract_all(code, F.lit(self._reach(window)), F.lit(2)), "")

    def free(self, code: Column, window: int) -> Column:
        """The other letters."""
        return F.regexp_replace(code, self._reach(window), "$1")


def count(code: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(code, f"[^{letters}]+", ""))
