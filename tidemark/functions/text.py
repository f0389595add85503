"""Text functions as Column expressions: no UDF, no shuffle.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicons as lx
from tidemark.functions.codes import Coding

TOKEN = r"[A-Za-z][A-Za-z'\-]*|\d+(?:\.\d+)?%?|[.,;:!?]"
#: Stands for a token that a negation reaches.
MARK = "!"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
#: What \\s matches.
BLANKS = " \t\n\x0b\f\r"
_CLOSERS, _OPENERS = r"[\"')\]]*", r"[\"'(\[]?"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values]) if values else F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: inside lambdas nothing else
    keeps an expression from being evaluated at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(pattern: str) -> str:
    return rf"(?i)\b(?:{pattern})\b"


def normalize(text: Column) -> Column:
    """Quotes, dashes, blanks and line ends unified; stage directions dropped (NFKC: see unicode.nfkc)."""
    out = F.translate(text, "‘’“”– ", "''\"\"- ")
    out = F.replace(out, F.lit("—"), F.lit("--"))
    out = F.regexp_replace(out, r"(?i)\[[^\]]{0,80}\]|\((?:laughter|inaudible|crosstalk)\)", " ")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the lower-cased text with its white space collapsed."""
    return F.sha2(F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "), F.lit(" ")), 256)


def sentences(text: Column, abbreviations: list[str] = lx.ABBREVIATIONS) -> Column:
    """Sentences of a text; a full stop after an abbreviation ends none."""
    words = "|".join(a.replace(".", r"\.") for a in abbreviations)
    boundary = rf"{_CLOSERS}\s+(?={_OPENERS}[A-Z0-9])"
    flat = F.btrim(F.regexp_replace(text, r"\s*\n\s*", " "), F.lit(BLANKS))
    # the cheap test stands first: a closer or blank ahead; pieces begin and end without blanks
    pieces = F.split(flat, rf"(?<=[.!?])(?=[\"')\]\s]){boundary}")
    if abbreviations:
        # only a piece's last letters tell whether an abbreviation ends it; no line end is left, so one parts the others
        tail = 8 + max(map(len, abbreviations))
        ended = rf"(?:^|\s)[\"'(\[]{{0,2}}(?i:{words})[\"'(\[]{{0,2}}\.{{1,3}}\z"
        part = lambda s: F.when(s.endswith(".") & F.substring(s, -tail, tail).rlike(ended), " ").otherwise("\n")
        joined = F.array_join(F.transform(pieces, lambda s: F.concat(s, part(s))), "")
        pieces = F.split(F.rtrim(joined), "\n")
    return F.filter(pieces, lambda s: F.length(s) > 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_word(token: Column) -> Column:
    """Has a lower-cased token no hyphen, number or mark?  Tokens that begin with a letter hold letters, hyphens and apostrophes."""
    return (token >= "a") & ~token.contains("-")


def negated(toks: Column, cues: list[str] = lx.NEGATION_CUES, breaks: list[str] = lx.CLAUSE_BREAKS, window: int = lx.NEGATION_WINDOW) -> Column:
    """Per token: does a negation reach it?  True if the last cue or break among
    the ``window`` tokens before it is a cue; cues and breaks are not reached."""
    c = Coding(cues=cues, breaks=breaks)
    cue, other = c.of("cues"), f"[^{c.of('cues')}{c.of('breaks', 'cues')}]"
    mask = F.regexp_replace(c.code(toks), f"(?<=[{cue}]{other}{{0,{window - 1}}}){other}", MARK)
    return F.when(F.size(toks) == 0, F.array().cast("array<boolean>")).otherwise(F.transform(F.split(mask, ""), lambda m: m == MARK))


def hedge_score(text: Column, hedges: list[str] = lx.HEDGE_WORDS) -> Column:
    return hedges_of(F.transform(tokens(text), F.lower), hedges)


def hedges_of(toks: Column, hedges: list[str] = lx.HEDGE_WORDS) -> Column:
    """The same of lower-cased tokens."""
    words = F.filter(toks, lambda t: is_word(t) | t.contains("'"))
    hits = lambda ws: F.size(F.filter(ws, lambda w: w.isin(hedges) if hedges else F.lit(False)))
    return let(words, lambda ws: F.least(F.lit(1.0), hits(ws) / F.greatest(F.lit(3.0), F.size(ws) * 0.25)))


def clauses(sentence: Column, contrast: list[str] = lx.CONTRAST) -> Column:
    """Parts between semicolons and contrast words; the sentence itself if none is left."""
    words = "|".join(contrast)
    parts = F.split(sentence, rf"(?i)\s*(?:;|,?\s+\b(?:{words})\b)\s*")
    kept = F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" ,"))), lambda p: p != "")
    several = let(kept, lambda ps: F.when(F.size(ps) == 0, F.array(sentence)).otherwise(ps))
    # most sentences have no separator, which a plainer pattern tells, and nothing at their ends to trim (a look at all letters)
    trimmed = F.btrim(sentence, F.lit(" ,"))
    loose = F.startswith(sentence, F.lit(" ")) | F.startswith(sentence, F.lit(",")) | F.endswith(sentence, F.lit(" ")) | F.endswith(sentence, F.lit(","))
    whole = F.array(F.when(loose & (trimmed != ""), trimmed).otherwise(sentence))
    return F.when(sentence.rlike(rf"(?i);|\s(?:{words})"), several).when(sentence.isNotNull(), whole)


def numbers(text: Column) -> Column:
    """Distinct numbers, without thousands separators."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.rtrim(F.replace(n, F.lit(","), F.lit("")), F.lit("."))))


def content_words(text: Column, stop: list[str] = lx.STOP_WORDS) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z'\-]+"), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), strings(stop))


def clean_quote(text: Column, limit: int = 220) -> Column:
    flat = F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" "))
    cut = F.substring(flat, 1, limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("...")))


def claim_body(text: Column) -> Column:
    """The quotation at the end of a claim, else the claim."""
    quote = F.regexp_extract(text, r'(?s)"(.+)"\s*$', 1)
    return F.when(quote == "", text).otherwise(quote)


def flip_polarity(text: Column, pairs: list[tuple[str, str]] = lx.FLIPS) -> Column:
    """The first pair whose left word occurs: its first occurrence becomes the right word; else null."""
    swapped = [F.when(text.rlike(rf"(?i)\b{a}\b"), F.regexp_replace(text, rf"(?is)^(.*?)\b{a}\b", f"$1{b}")) for a, b in pairs]
    return F.coalesce(*swapped)


def swap_number(text: Column) -> Column:
    """The first number replaced by another, chosen by a hash of the text; null without a number."""
    number = F.regexp_extract(text, r"\d+(?:\.\d+)?", 0)
    value = F.expr("1").cast("double") * number.try_cast("double")
    share = 0.2 + F.pmod(F.crc32(text), F.lit(71)) / 100
    sign = F.when(F.pmod(F.crc32(F.reverse(text)), F.lit(2)) == 0, -1.0).otherwise(1.0)
    moved = value + sign * F.greatest(F.lit(1.0), F.round(value * share, 1))
    new = F.when(number.contains("."), F.format_string("%.1f", moved)).otherwise((F.floor(F.abs(moved)) + 3).cast("string"))
    return F.when(number != "", F.concat(F.regexp_extract(text, r"(?s)^(\D*)", 1), new, F.regexp_extract(text, r"(?s)^\D*\d+(?:\.\d+)?(.*)$", 1)))


def marked_tokens(toks: Column, mask: Column, aspect: Column | None = None) -> Column:
    """Lower-cased tokens, NEG_ before negated words, led by the aspect's mark."""
    words = F.zip_with(toks, mask, lambda t, m: F.when(m & t.rlike("^[A-Za-z]+$"), F.concat(F.lit("NEG_"), F.lower(t))).otherwise(F.lower(t)))
    return words if aspect is None else F.concat(F.array(F.concat(F.lit("asp_"), aspect)), words)


def embed_features(text: Column, stop: list[str] = lx.EMBED_STOP) -> Column:
    """Words and word pairs that the hashed embedding counts."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9%]+"), F.lit(0)), lambda w: ~F.array_contains(strings(stop), w))
    rest = lambda ws: F.greatest(F.size(ws) - 1, F.lit(0))
    pairs = lambda ws: F.zip_with(F.slice(ws, 1, rest(ws)), F.slice(ws, 2, rest(ws)), lambda a, b: F.concat_ws("_", a, b))
    return let(words, lambda ws: F.when(F.size(ws) > 1, F.concat(ws, pairs(ws))).otherwise(ws))


def feature_slot(feature: Column, dimensions: int) -> tuple[Column, Column]:
    """(dimension, sign) of a feature, from its MD5."""
    number = F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("long")
    return F.pmod(number, F.lit(dimensions)), F.when(F.substring(F.md5(feature), 9, 1).rlike("[89a-f]"), 1.0).otherwise(-1.0)


def hashed_embedding(text: Column, dimensions: int = 384) -> Column:
    """Sparse hashed embedding, L2-normalised: map of dimension to weight; empty for a text without words."""
    slot = lambda f: F.struct(feature_slot(f, dimensions)[0].alias("d"), feature_slot(f, dimensions)[1].alias("s"))
    norm = lambda ws: F.sqrt(F.aggregate(ws, F.lit(0.0), lambda a, w: a + w * w))
    scaled = lambda ws: let(norm(ws), lambda n: F.transform(ws, lambda w: F.when(n > 0, w / n).otherwise(0.0)))
    # sorted by dimension, each one's signs stand together: a sum per run, and no look at the others
    first = lambda xs: F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (x["d"] != F.get(xs, i - 1)["d"]), i)), lambda i: i.isNotNull())
    ends = lambda xs, at: F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(xs)))
    total = lambda xs, i, j: F.aggregate(F.slice(xs, i + 1, j - i), F.lit(0.0), lambda a, x: a + x["s"])
    sums = lambda xs, at: F.zip_with(at, F.when(F.size(at) > 0, ends(xs, at)).otherwise(at), lambda i, j: total(xs, i, j))
    built = lambda xs, at: F.map_from_arrays(F.transform(at, lambda i: F.get(xs, i)["d"]), let(sums(xs, at), scaled))
    return let(F.array_sort(F.transform(embed_features(text), slot)), lambda xs: let(first(xs), lambda at: built(xs, at)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def map_dot(a: Column, b: Column) -> Column:
    product = lambda x, y: F.aggregate(F.map_keys(x), F.lit(0.0), lambda s, k: s + F.element_at(x, k) * F.coalesce(F.try_element_at(y, k), F.lit(0.0)))
    return let(a, lambda x: let(b, lambda y: product(x, y)))


def mean_half_up(x: Column, digits: int = 4) -> Column:
    """Mean of values that are already rounded, by whole numbers: the order of the sum can't matter."""
    unit = float(10**digits)
    return F.floor(F.sum(F.floor(x * F.lit(unit) + 0.5)) / F.count(x) + 0.5) / F.lit(unit)


def exact_mean(x: Column, digits: int = 4) -> Column:
    """Mean rounded half up, from a sum of decimals: neither the rows' order nor the last bits of doubles decide a tie.

    Values count with twelve decimals; where one doesn't fit, all are averaged as doubles."""
    exact = x.try_cast("decimal(24,12)")
    unit = F.lit(10**digits).cast(f"decimal({digits + 1},0)")
    tie = F.floor(F.try_avg(exact) * unit + F.lit("0.5").cast("decimal(2,1)")).cast("double") / F.lit(float(10**digits))
    return F.when(F.count(exact) == F.count(x), tie).otherwise(half_up(F.avg(x), digits))


def half_up(x: Column, digits: int = 4) -> Column:
    """Rounding that other engines repeat bit for bit: floor(x * 10^d + 0.5) / 10^d."""
    return F.floor(x * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def json_block(text: Column, schema: str) -> Column:
    """The object in a reply: a fenced block's, else from the first brace to the last; null fields if it does not parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).when(bare != "", bare).otherwise("{}"), schema)


def evidence_line(chunk_id: Column, aspect: Column, date: Column, section: Column, score: Column, text: Column) -> Column:
    """``[id] (aspect, date, section, +0.00) text``; the score is rounded half up first."""
    where = F.concat_ws(", ", aspect, date.cast("string"), section, F.format_string("%+.2f", half_up(score, 2)))
    return F.concat(F.lit("["), chunk_id.cast("string"), F.lit("] ("), where, F.lit(") "), F.coalesce(text, F.lit("")))
