"""murmur3 (32 bits, seed 0, signed) of a string's UTF-8 bytes.

Spark's ``hash`` uses another seed and another tail, so ring positions that must
equal those of the standard function are computed here, vectorized over a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

M = np.uint32
C1, C2 = M(0xCC9E2D51), M(0x1B873593)


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << M(r)) | (x >> M(32 - r))


def murmur3_array(values: list[bytes]) -> np.ndarray:
    """Signed hashes; values are worked on four bytes at a time, all rows together."""
    n = np.array([len(v) for v in values], np.int64)
    wide = int(n.max(initial=0)) // 4 * 4 + 4
    data = np.zeros((len(values), wide), np.uint8)
    for k, v in enumerate(values):
        data[k, : len(v)] = np.frombuffer(v, np.uint8)
    words = data.view("<u4")
    h = np.zeros(len(values), M)
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            x = _rotated(words[:, k] * C1, 15) * C2
            body, tail = n // 4 > k, (n // 4 == k) & (n % 4 > 0)
            h = np.where(body, _rotated(h ^ x, 13) * M(5) + M(0xE6546B64), np.where(tail, h ^ x, h))
        h ^= n.astype(M)
        h = (h ^ (h >> M(16))) * M(0x85EBCA6B)
        h = (h ^ (h >> M(13))) * M(0xC2B2AE35)
        return (h ^ (h >> M(16))).view(np.int32)


@pandas_udf(IntegerType())
def murmur3(text: pd.Series) -> pd.Series:
    """Hash of each string; null stays null."""
    there = text.notna()
    out = pd.Series([None] * len(text), dtype="Int32", index=text.index)
    out[there] = murmur3_array([t.encode() for t in text[there]])
    return out
