"""Hashes over UTF-16 code units (FNV-1a, murmur3), feature-hash vectors and vector arithmetic."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 128
_MASK = 0xFFFFFFFF
#: Constants of the published FNV-1a and murmur3 algorithms, and the two seeds of the 64-bit digest.
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193
MURMUR_C1, MURMUR_C2, MURMUR_ADD, MURMUR_F1, MURMUR_F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
DIGEST_SEEDS = (0x9747B28C, 0x5BD1E995)


def utf16_units(text: str) -> list[int]:
    """UTF-16 code units of a text."""
    raw = text.encode("utf-16-le", "surrogatepass")
    return list(memoryview(raw).cast("H")) if raw else []


def fnv1a(text: str, seed: int = 0) -> int:
    """32-bit FNV-1a over UTF-16 code units, the seed mixed into the offset."""
    h = (seed ^ FNV_OFFSET) & _MASK
    for unit in utf16_units(text):
        h = ((h ^ unit) * FNV_PRIME) & _MASK
    return h


def murmur3_units(text: str, seed: int = 0) -> int:
    """32-bit murmur3 over UTF-16 code units, two units to a block."""
    units = utf16_units(text)
    rotate = lambda x, r: ((x << r) | (x >> (32 - r))) & _MASK
    mix = lambda k: (rotate((k * MURMUR_C1) & _MASK, 15) * MURMUR_C2) & _MASK
    h = seed & _MASK
    for low, high in zip(units[::2], units[1::2]):
        h = (rotate(h ^ mix(low | high << 16), 13) * 5 + MURMUR_ADD) & _MASK
    if len(units) % 2:
        h ^= mix(units[-1])
    h ^= 2 * len(units)
    h = ((h ^ (h >> 16)) * MURMUR_F1) & _MASK
    h = ((h ^ (h >> 13)) * MURMUR_F2) & _MASK
    return h ^ (h >> 16)


def digest64(text: str) -> str:
    """Two murmur3 lanes as 16 hex characters."""
    return "".join(f"{murmur3_units(text, s):08x}" for s in DIGEST_SEEDS)


def feature_vector(text: str | None) -> np.ndarray:
    """Unit vector of hashed tokens (weight 2) and their padded trigrams (weight 1); zero without tokens."""
    v = np.zeros(DIMENSIONS, dtype=np.float32)
    spaced = re.sub("([a-z0-9])([A-Z])", r"\1 \2", text or "").lower()
    for token in re.split(r"[^a-z0-9_$-]+", spaced):
        if len(token) > 1:
            v[fnv1a(token) % DIMENSIONS] += 2
            padded = f"_{token}_"
            for i in range(len(padded) - 2):
                v[fnv1a(padded[i : i + 3], 42) % DIMENSIONS] += 1
    norm = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v / np.float32(norm) if norm else v


@F.pandas_udf(T.ArrayType(T.FloatType()))
def feature_vector_udf(text: pd.Series) -> pd.Series:
    return text.map(feature_vector)


@F.pandas_udf(T.LongType())
def fnv1a_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fnv1a(t)).astype("Int64")


@F.pandas_udf(T.StringType())
def digest64_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else digest64(t))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; null for different lengths or null."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine_unit(a: Column, b: Column) -> Column:
    """Cosine of unit vectors clamped to 0..1; 0 where the lengths differ."""
    d = dot(a, b)
    return F.when(d.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)))
