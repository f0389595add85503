"""Language identification by error-correcting output codes.

Every language has a codeword; each bit is a binary classifier over hashed byte
trigrams that tells the languages with a 1 from those with a 0, by the log ratio
of their pooled trigram distributions.  Decoding weighs each bit's loss by how
reliably that bit's classifier knows that language, and takes the nearest
codeword; a second one close by flags the text as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_text, kind_of, shuffle_width

BUCKETS = 1 << 16
BLOCK = 1 << 12
TRAIN_DOCS = 4_000
CHUNK_BYTES = 1 << 20
AMBIGUOUS = 0.9
MOST_BITS = 120
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def letters_only(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_FOLD.tobytes()) + b" "


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two; bucket 0 for blanks."""
    a = data.astype(np.uint32)
    packed = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    bucket = ((packed * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    # a trigram is of use if its middle is a letter: word edges count, gaps don't
    bucket[data[1:-1] == 32] = 0
    return bucket


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n rows of bits.  All splits of the languages up to 6, else distinct random halves, at most
    MOST_BITS of them (of seven or eight languages there are only 35)."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        return np.array([(1, *bits) for bits in product((1, -1), repeat=n - 1) if -1 in bits], float).T
    rng, bits, seen = np.random.default_rng(seed), [], set()
    while len(bits) < min(12 * int(np.ceil(np.log2(n))), 32 if n <= 8 else MOST_BITS):
        column = rng.permutation(np.where(np.arange(n) < n // 2, 1, -1))
        column = column * column[0]
        if tuple(column) not in seen:
            seen.add(tuple(column))
            bits.append(column)
    return np.array(bits, float).T


@dataclass
class CodeModel:
    """languages, codewords (languages x bits), weights (bits x buckets), trust (languages x bits)."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    @staticmethod
    def fit(languages: list[str], counts: np.ndarray) -> CodeModel:
        if not languages:
            return CodeModel([], np.ones((0, 1)), np.zeros((1, counts.shape[1])), np.zeros((0, 1)))
        counts = counts.astype(float).copy()
        counts[:, 0] = 0
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        code = codewords(len(languages))
        weights, trust = [], []
        for bit in code.T:
            one, zero = share[bit > 0], share[bit < 0]
            w = np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0)) if len(one) and len(zero) else np.zeros(share.shape[1])
            w[0] = 0.0
            mean = share @ w
            deviation = np.sqrt(np.maximum(share @ w**2 - mean**2, 1e-12))
            # chance that 64 trigrams of the language fall on the right side
            trust.append([0.5 + 0.5 * erf(8 * m * b / d / 2**0.5) for m, d, b in zip(mean, deviation, bit)])
            weights.append(w / max(float(np.abs(mean).mean()), 1e-9))
        trust = np.array(trust).T
        return CodeModel(languages, code, np.array(weights), trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9))

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Mean margin per bit of each text."""
        out = np.zeros((len(texts), len(self.weights)))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_BYTES):
                size, end = size + len(texts[end]), end + 1
            bucket = trigrams(np.frombuffer(b"".join(texts[at:end]), np.uint8))
            starts = np.cumsum([0] + [len(x) for x in texts[at : end - 1]])
            used = np.maximum(np.add.reduceat((bucket > 0).astype(np.int64), starts), 1)
            for b, w in enumerate(self.weights):
                out[at:end, b] = np.add.reduceat(w[bucket], starts) / used
            at = end
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score per row."""
        loss = np.log1p(np.exp(-2 * np.clip(margins, -4, 4)[:, None, :] * self.code[None]))
        distance = (loss * self.trust[None]).sum(axis=2)
        e = np.exp(-4 * (distance - distance.min(axis=1, keepdims=True)))
        share = e / e.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, share[np.arange(len(best)), best]


def learn(df: DataFrame, text: str, lang: str, id_col: str, train_docs: int = TRAIN_DOCS) -> CodeModel:
    """Trigram counts per language over about ``train_docs`` hash-chosen rows of each."""
    known = df.where(F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return CodeModel.fit([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, train_docs / sizes[k]))])
    draw = F.pmod(F.xxhash64(id_col, F.lit(29)), F.lit(1 << 20)) / float(1 << 20)
    some = known.where(draw <= share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("t"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang_, value in zip(batch["lang"], batch["t"]):
                if isinstance(value, str) and value:
                    got = np.bincount(trigrams(np.frombuffer(letters_only(value), np.uint8)), minlength=BUCKETS)
                    sums[lang_] = sums[lang_] + got if lang_ in sums else got
        for lang_, total in sums.items():
            yield pd.DataFrame({"lang": lang_, "block": np.arange(BUCKETS // BLOCK), "n": list(total.reshape(-1, BLOCK))})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "block": group["block"].iloc[:1], "n": [np.sum(np.vstack(group["n"].to_list()), axis=0)]})

    schema = "lang string, block long, n array<long>"
    found = some.mapInPandas(count, schema).repartition(shuffle_width(df.sparkSession, 1, 1), "lang", "block").groupBy("lang", "block").applyInPandas(add, schema).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    for lang_, block, n in zip(found["lang"], found["block"], found["n"]):
        counts[languages.index(lang_), block * BLOCK : (block + 1) * BLOCK] = n
    return CodeModel.fit(languages, counts)


def identify_language(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    id_col: str = "doc_id",
    folds: int = 4,
    held_out_fold: int = 2,
    train_docs: int = TRAIN_DOCS,
    ambiguous: float = AMBIGUOUS,
) -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred``, ``score``, ``ambiguous`` per row.

    Learns from rows whose language is known and whose crc32(id) modulo
    ``folds`` isn't ``held_out_fold``; predicts every row from its whole text
    alone, however long.  A null text, one without a letter, or no language to
    learn gives ``und`` with score 0.  Among equally near codewords the first
    language by name is taken.  A null id is neither learned from nor held out.
    Repeated rows are kept, an empty table gives none; other columns are not read.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))
    model = learn(df.where(fold != held_out_fold), text, lang, id_col, train_docs)
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x bits x 65,536 weights at most

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            usable = np.array([isinstance(x, str) and bool(known.languages) and _LETTER.search(x) is not None for x in batch["t"]], bool)
            pred, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            if usable.any():
                best, sure = known.decode(known.margins([letters_only(x) for x in batch["t"][usable]]))
                pred[usable], score[usable] = np.array(known.languages, object)[best], sure
            yield pd.DataFrame({"i": batch["i"], "held_out": batch["held_out"], "lang_pred": pred, "score": score, "ambiguous": score < ambiguous})

    out = df.select(as_text(id_col).alias("i"), F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"), F.col(text).alias("t"))
    found = out.mapInPandas(predict, "i string, held_out boolean, lang_pred string, score double, ambiguous boolean")
    return found.select(F.col("i").cast(kind_of(df, id_col)).alias(id_col), "held_out", "lang_pred", "score", "ambiguous")
