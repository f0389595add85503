"""The few text functions that Spark has no expression for, as Arrow UDFs."""

from __future__ import annotations

import hashlib
import html
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from tidemark.functions.lexicons import EMBED_STOP


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def blake_embedding(dimensions: int = 384):
    """Dense hashed embedding with BLAKE2b slots, for exchange with stores that hold such vectors."""
    import re

    words, stop = re.compile("[a-z0-9%]+"), set(EMBED_STOP)

    def one(text: str | None) -> list[float] | None:
        if text is None:
            return None
        out = np.zeros(dimensions, np.float32)
        kept = [w for w in words.findall(text.lower()) if w not in stop]
        for feature in kept + [f"{a}_{b}" for a, b in zip(kept, kept[1:])]:
            number = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
            out[number % dimensions] += 1.0 if number >> 63 else -1.0
        norm = float(np.linalg.norm(out))
        return (out / norm if norm else out).tolist()

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        return text.map(one)

    return embed
