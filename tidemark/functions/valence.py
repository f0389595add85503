"""Valence of short texts: a table of word values, folded with boosters, negation, capitals, contrast and punctuation.

The rules and their constants are those of the published rule-based model for
social media text (Hutto and Gilbert, 2014); the table of words is an argument.
All of it is one Column expression per text.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.lexicons import FINANCE, Lexicon

# Fixed values of the model.
CAPITALS, NEGATION, NEVER_SO = 0.733, -0.74, 1.25
DISTANCE = (1.0, 0.95, 0.9)
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS, MOST_QUESTIONS = 0.18, 0.96, 3
ALPHA = 15.0
BOOST = 0.293

PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: The same characters.
_MARKS = string.punctuation


@dataclass(frozen=True)
class Valences:
    """Words and their values, words that raise or lower the one after them, and words that turn it round."""

    words: dict[str, float]
    boosters: dict[str, float] = field(default_factory=lambda: {w: BOOST for w in ("very", "extremely", "highly", "really", "significantly", "sharply", "strongly", "substantially")} | {w: -BOOST for w in ("slightly", "somewhat", "marginally", "barely", "partly", "modestly")})
    negations: tuple[str, ...] = ("not", "no", "never", "none", "nor", "neither", "without", "cannot", "hardly", "nothing", "nowhere")
    contrast: tuple[str, ...] = ("but",)


def of_lexicon(lexicon: Lexicon, positive: float = 1.9, negative: float = -1.9) -> Valences:
    """A lexicon's positive and negative words at one value each; its cues turn words round."""
    words = {w: negative for w in lexicon.negative} | {w: positive for w in lexicon.positive}
    return Valences(words, negations=tuple(lexicon.cues), contrast=tuple(w for w in lexicon.contrast if w.isalpha()))


def _value(word: Column, values: dict[str, float]) -> Column:
    """A word's value, null where it has none: sets of words by value, asked only for words that any holds."""
    by: dict[float, list[str]] = {}
    for w, v in values.items():
        by.setdefault(v, []).append(w)
    none = F.lit(None).cast("double")
    if not by:
        return none
    found = F.when(~word.isin(list(values)), none)
    for v, ws in by.items():
        found = found.when(word.isin(ws), F.lit(float(v)))
    return found


def words(text: Column) -> Column:
    """The text's words between blanks without the punctuation around them; words of one or two letters keep theirs."""
    bare = lambda t: F.btrim(t, F.lit(_MARKS))
    whole = F.btrim(text, F.lit(tx.BLANKS))
    return F.transform(F.when(whole == "", tx.strings([])).otherwise(F.split(whole, r"[ \t\n\r\f\x0B]+")), lambda t: F.when(F.length(bare(t)) <= 2, t).otherwise(bare(t)))


#: Words that the rules know besides a table's own.
_RULED = ("never", "without", "so", "this", "doubt", "least", "at", "very")


def valence_score(text: Column, valences: Valences) -> Column:
    """The compound score in [-1, 1]; 0 for null, empty and unknown texts."""
    known = list(dict.fromkeys([*valences.words, *valences.boosters, *valences.negations, *valences.contrast, *_RULED]))
    is_in = lambda w, some: w.isin(list(some)) if some else F.lit(False)

    def item(t: Column) -> Column:
        def built(low: Column) -> Column:
            up = ((t != low) & (t == F.upper(t))).alias("up")
            of = lambda v, b, neg: F.struct(low.alias("w"), up, v.alias("v"), b.alias("b"), neg.alias("neg"))
            negation = is_in(low, valences.negations) | low.contains("n't")
            boost = F.coalesce(_value(low, valences.boosters), F.lit(0.0))
            # most words are in no list: one look in a set tells
            return F.when(low.isin(known) | low.contains("n't"), of(_value(low, valences.words), boost, negation)).otherwise(of(F.lit(None).cast("double"), F.lit(0.0), F.lit(False)))

        return tx.let(F.lower(t), built)

    def step(s: Column, items: Column, i: Column, mixed: Column, d: int) -> Column:
        """What the word ``d`` before does to a value."""
        p, one, two = F.get(items, i - d), F.get(items, i - 1)["w"], F.get(items, i - 2)["w"]
        sign = F.when(s < 0, -1.0).otherwise(1.0)
        louder = F.when(p["up"] & mixed, CAPITALS).otherwise(0.0)
        raised = F.when(p["b"] != 0, sign * (p["b"] + louder) * DISTANCE[d - 1]).otherwise(0.0)
        turned = lambda x: F.when(p["neg"], x * NEGATION).otherwise(x)
        near = {1: F.lit(False), 2: one.isin("so", "this"), 3: one.isin("so", "this") | two.isin("so", "this")}[d]
        sure = {1: F.lit(False), 2: one == "doubt", 3: (one == "doubt") | (two == "doubt")}[d]
        apply = lambda x: F.when((p["w"] == "never") & near, x * NEVER_SO).when((p["w"] == "without") & sure, x).otherwise(turned(x))
        return F.when((i >= d) & p["v"].isNull(), tx.let(s + raised, apply)).otherwise(s)

    def scored(items: Column, mixed: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            own = x["v"] + F.when(x["up"] & mixed, F.signum(x["v"]) * CAPITALS).otherwise(0.0)
            before, two = F.get(items, i - 1), F.get(items, i - 2)["w"]
            least = (i >= 1) & (before["w"] == "least") & before["v"].isNull() & ((i < 2) | ~two.isin("at", "very"))
            folded = tx.let(own, lambda a: tx.let(step(a, items, i, mixed, 1), lambda b: tx.let(step(b, items, i, mixed, 2), lambda c: step(c, items, i, mixed, 3))))
            return F.when((x["b"] != 0) | x["v"].isNull(), 0.0).otherwise(F.when(F.coalesce(least, F.lit(False)), folded * NEGATION).otherwise(folded))

        def weighed(scores: Column) -> Column:
            places = F.filter(F.transform(items, lambda x, i: F.when(is_in(x["w"], valences.contrast), i)), lambda i: i.isNotNull())
            weight = lambda i, at: F.when((at < 0) | (i == at), 1.0).when(i < at, BEFORE_CONTRAST).otherwise(AFTER_CONTRAST)
            add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, s: a + s)
            total = lambda at: F.when(at < 0, add(scores)).otherwise(add(F.transform(scores, lambda s, i: s * weight(i, at))))
            # found once: looked up at each word, it made a text's cost quadratic in its length
            return tx.let(F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(-1)), total)

        return tx.let(F.transform(items, one), weighed)

    text = F.coalesce(text, F.lit(""))
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    questions = F.when(count("?") > MOST_QUESTIONS, MANY_QUESTIONS).when(count("?") > 1, count("?") * QUESTION).otherwise(0.0)
    emphasis = F.least(count("!"), F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION + questions
    louder = lambda s: F.when(s > 0, s + emphasis).when(s < 0, s - emphasis).otherwise(0.0)
    squashed = lambda s: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s / F.sqrt(s * s + ALPHA)))

    def whole(items: Column) -> Column:
        capitals = F.size(F.filter(items, lambda x: x["up"]))
        mixed = (capitals > 0) & (capitals < F.size(items))
        known = F.exists(items, lambda x: x["v"].isNotNull())
        return F.when(known, tx.let(mixed, lambda m: tx.let(scored(items, m), lambda s: tx.let(louder(s), squashed)))).otherwise(0.0)

    return tx.let(F.transform(words(text), item), whole)


def scorer(text: Column, aspect: Column | None = None, lexicon: Lexicon = FINANCE) -> Column:
    """The model as the registry wants it: aspects are not looked at."""
    return valence_score(text, of_lexicon(lexicon))
