"""Lexicon polarity models as Column expressions, and the registry of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import valence
from tidemark.functions.codes import Coding, count
from tidemark.functions.lexicons import FINANCE, LABELS, NEGATION_WINDOW, NEGATIVE_EVENTS, POSITIVE_EVENTS, Lexicon


def label_of(score: Column, threshold: float) -> Column:
    return F.when(score > threshold, "positive").when(score < -threshold, "negative").otherwise("neutral")


def graded(score: Column, threshold: float = 0.05, scale: float = 1.0, more: Callable[[Column, Column], list[Column]] = lambda label, confidence: []) -> Column:
    """struct(label, score, confidence, ...) of a signed score."""
    def built(s: Column) -> Column:
        label = label_of(s, threshold)
        confidence = F.when(label != "neutral", F.least(F.lit(1.0), 0.34 + F.abs(s) * scale * 0.66)).otherwise(F.greatest(F.lit(0.34), 1 - F.abs(s) * 6))
        return F.struct(label.alias("label"), s.alias("score"), confidence.alias("confidence"), *more(label, confidence))

    return tx.let(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)), built)


def prediction(score: Column, threshold: float = 0.05, scale: float = 1.0) -> Column:
    """struct(label, score, confidence, probs) of a signed score."""
    def probs(label: Column, confidence: Column) -> list[Column]:
        shares = F.array(*[F.when(label == x, confidence).otherwise((1 - confidence) / 2) for x in LABELS])
        return [F.map_from_arrays(tx.strings(list(LABELS)), shares).alias("probs")]

    return graded(score, threshold, scale, probs)


def prediction_from_probs(probs: Column) -> Column:
    """struct(label, score, confidence, probs) of class probabilities; ties go to the first label."""
    p = {x: F.coalesce(F.try_element_at(probs, F.lit(x)), F.lit(0.0)) for x in LABELS}
    best = F.array_max(F.array(*[F.struct(p[x].alias("p"), F.lit(-i).alias("order"), F.lit(x).alias("label")) for i, x in enumerate(LABELS)]))
    return F.struct(best["label"].alias("label"), (p["positive"] - p["negative"]).alias("score"), best["p"].alias("confidence"), probs.alias("probs"))


def counted_score(text: Column, aspect: Column | None = None, lexicon: Lexicon = FINANCE) -> Column:
    """Positive against negative words; a negation moves a word to the other side."""
    c = Coding(cues=lexicon.cues, breaks=lexicon.breaks, positive=lexicon.positive, negative=lexicon.negative)
    pos, neg = c.of("positive"), c.of("negative", "positive")
    balance = lambda p, n: (p - n) / F.greatest(F.lit(1.0), p + n) * F.least(F.lit(1.0), (p + n) / 2 + 0.2)

    def sides(free: Column, off: Column) -> Column:
        p, n = count(free, pos) + count(off, neg), count(free, neg) + count(off, pos)
        return tx.let(p.cast("double"), lambda x: tx.let(n.cast("double"), lambda y: balance(x, y)))

    def scored(k: Column) -> Column:
        # most texts hold no such word or no cue: one look tells
        plain = tx.let(count(k, pos).cast("double"), lambda p: tx.let(count(k, neg).cast("double"), lambda n: balance(p, n)))
        turned = tx.let(c.free(k, NEGATION_WINDOW), lambda f: tx.let(c.reached(k, NEGATION_WINDOW), lambda o: sides(f, o)))
        return F.when(~k.rlike(f"[{pos}{neg}]"), 0.0).when(k.rlike(f"[{c.of('cues')}]"), turned).otherwise(plain)

    return tx.let(c.code(tx.tokens(text)), lambda k: F.when(k.isNotNull(), scored(k)))


def directional_parts(text: Column, lexicon: Lexicon = FINANCE) -> Column:
    """struct(turns, words, doubt, moved, bad, events): what a text's words say, in tenths, whatever the aspect."""
    c = Coding(cues=lexicon.cues, breaks=lexicon.breaks, up=lexicon.up, down=lexicon.down, positive=lexicon.positive, negative=lexicon.negative, uncertainty=lexicon.uncertainty)
    up, down = c.of("up"), c.of("down", "up")
    pos, neg = c.of("positive", "up", "down"), c.of("negative", "positive", "up", "down")
    doubt = c.of("uncertainty", "up", "down", "positive", "negative")
    bad = text.rlike(tx.any_of(lexicon.bad_when_up)) & ~F.substring_index(text, " and ", 1).rlike(tx.any_of(lexicon.good_when_up))
    events = F.when(text.rlike(tx.any_of(POSITIVE_EVENTS)), 10).otherwise(0) - F.when(text.rlike(tx.any_of(NEGATIVE_EVENTS)), 10).otherwise(0)

    def parts(code: Column, free: Column, off: Column) -> Column:
        net = lambda letters: count(free, letters) - count(off, letters)
        moved = code.rlike(f"[{up}{down}]")
        turns = F.when(moved, 10 * (net(up) - net(down))).otherwise(0)
        return F.struct(turns.alias("turns"), (8 * (net(pos) - net(neg))).alias("words"), (-6 * net(doubt)).alias("doubt"), moved.alias("moved"),
                        (moved & F.coalesce(bad, F.lit(False))).alias("bad"), events.alias("events"))

    return tx.let(c.code(tx.tokens(text)), lambda k: tx.let(c.free(k, NEGATION_WINDOW), lambda f: tx.let(c.reached(k, NEGATION_WINDOW), lambda o: parts(k, f, o))))


def directional_total(parts: Column, text: Column, aspect: Column) -> Column:
    """The score in [-1, 1] that a text's parts give for one aspect; sums are whole tenths, so equal ones are equal bits."""
    legal_cost = (aspect == "litigation") & parts["moved"] & F.coalesce(text.rlike(r"(?i)\b(legal|litigation) (expense|cost)s?\b"), F.lit(False))
    unexpected = lambda: F.when(text.rlike(r"(?i)\b(do not|does not|don't|no) (?:expect|anticipate)\b.*\b(impact|charge|effect)"), 15).otherwise(0)
    turned = F.when(parts["bad"] | legal_cost, -parts["turns"]).otherwise(parts["turns"])
    tenths = turned + parts["words"] + F.when(aspect == "management_tone", parts["doubt"]).otherwise(0) + parts["events"]
    bare = lambda t: F.when(~parts["moved"] & (F.abs(t) < 5), 0).otherwise(t) + unexpected()
    total = tx.let(tenths, lambda t: F.when(aspect == "litigation", bare(t)).otherwise(t))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / F.lit(10.0) / 2))


def directional_score(text: Column, aspect: Column, lexicon: Lexicon = FINANCE) -> Column:
    """Directions read against what they move, then lexicon words, events and litigation rules; in [-1, 1]."""
    return tx.let(directional_parts(text, lexicon), lambda parts: directional_total(parts, text, aspect))


#: Words of a dictionary up to which each task gets all of it.
BROADCAST_WORDS = 500_000

Scorer = Callable[..., Column]
#: name: (score of (text, aspect, lexicon), neutral threshold)
MODELS: dict[str, tuple[Scorer, float]] = {"lm_lexicon": (counted_score, 0.05), "lm_directional": (directional_score, 0.12), "valence": (valence.scorer, 0.05)}
DEFAULT_MODEL = "lm_directional"


def register_model(name: str, scorer: Scorer, threshold: float = 0.05) -> None:
    """Adds a model: a function from (text, aspect, lexicon) Columns to a score Column (a pandas UDF will do)."""
    MODELS[name] = (scorer, threshold)


def resolve_model(name: str | None = None, serving: str | None = None) -> str:
    """The model asked for, else the one that serves, else the default; an unknown name raises."""
    if name is not None and name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(MODELS)}")
    return name or (serving if serving in MODELS else DEFAULT_MODEL)


def predict(model: str, text: Column, aspect: Column, lexicon: Lexicon = FINANCE) -> Column:
    scorer, threshold = MODELS[resolve_model(model)]
    return prediction(scorer(text, aspect, lexicon), threshold)


def sense_score(chunks: DataFrame, senses: DataFrame, keys: tuple[str, ...], lexicon: Lexicon = FINANCE, weights: tuple[float, ...] = (1.0, 0.5, 0.33)) -> DataFrame:
    """(``keys``, score) from a dictionary of word senses (word, rank from 1, value).

    A word's value is the weighted mean of its first senses; negation turns its
    sign.  Only words of three or more letters count.  A text's score is four
    times the sum over its number of tokens, within -1 and 1; texts without
    tokens score 0.  Each task gets a dictionary of up to BROADCAST_WORDS words,
    and only sums per text travel; a larger one joins on the word."""
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("rank").cast("int"))
    first = senses.where(F.col("rank").between(1, len(weights))).withColumn("w", weight)
    values = first.groupBy(F.lower("word").alias("word")).agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))
    values = values.where(F.col("word").rlike("^[a-z]{3,}$"))
    toks = chunks.select(*keys, tx.tokens(F.coalesce("text", F.lit(""))).alias("toks"))
    pairs = F.arrays_zip(F.transform("toks", F.lower).alias("word"), tx.negated(F.col("toks"), lexicon.cues, lexicon.breaks).alias("off"))
    # a row's tokens need no row each but where a word of the right shape may have a value
    long = F.filter(pairs, lambda x: x["word"].rlike("^[a-z]{3,}$"))
    words = toks.select(*keys, F.size("toks").alias("n"), F.inline_outer(long))
    each = F.when(F.col("off"), -1).otherwise(1)
    if values.count() <= BROADCAST_WORDS:
        # every task has the dictionary: a row's words are summed up where they are
        met = words.join(F.broadcast(values), "word", "left").groupBy(*keys).agg(F.max("n").alias("n"), F.sum(each * F.col("value")).alias("s"))
    else:
        # one row per text, word and sign before the join: frequent words do not travel once per use
        counted = words.groupBy(*keys, "word").agg(F.max("n").alias("n"), F.sum(each).alias("uses"))
        met = counted.join(values, "word", "left").groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.col("uses") * F.col("value")).alias("s"))
    score = 4 * F.coalesce("s", F.lit(0.0)) / F.greatest("n", F.lit(1))
    return met.select(*keys, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)).alias("score"))
