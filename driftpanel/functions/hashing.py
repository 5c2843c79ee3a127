"""Seeded, partition-independent randomness.

Two sources, both reproducible in plain SQL: md5 order keys for ids, and a 32-bit
integer mixer for numbered draws that runs the same in Spark and NumPy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# Fixed values of the integer mixer.
MIX_MULTIPLIER = 73244475
MASK32 = 4294967295


def order_key(seed: int, stage: str, subject: str = "subject_id") -> Column:
    """Uniform hexadecimal sort key ``md5(seed|stage|id)``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stage), F.col(subject)))


def key_bucket(key: Column) -> Column:
    """First three hexadecimal digits of a key as 0..4095, in key order."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def mix32(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.uint64) & np.uint64(MASK32)
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX_MULTIPLIER)) & np.uint64(MASK32)
    return x ^ (x >> np.uint64(16))


def draw32(seed: int, stage: int | np.ndarray, index: np.ndarray) -> np.ndarray:
    """Uniform 32-bit numbers for (seed, stage, index); broadcasts over the last two."""
    base = mix32(np.uint64(int(seed) & MASK32))
    inner = mix32(base + np.asarray(stage, dtype=np.uint64))
    return mix32(inner + np.asarray(index, dtype=np.uint64))
