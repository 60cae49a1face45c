"""Hash functions of keys as Spark expressions, and Bloom filter arithmetic."""

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import workers_can_import

#: 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def crc(key: Column | str) -> Column:
    """CRC-32 (IEEE) as an unsigned number."""
    return F.crc32(F.encode(F.col(key) if isinstance(key, str) else key, "UTF-8"))


def sha(text: Column | str) -> Column:
    return F.sha2(F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8"), 256)


def bloom_shape(n: int, rate: float = 0.01) -> tuple[int, int]:
    """(bits, hash functions) of a Bloom filter for ``n`` keys."""
    bits = int(-n * log(rate) / log(2) ** 2)
    return max(1, bits), max(1, int(bits / n * log(2))) if n else 1


def fnv1a(key: bytes) -> int:
    h = FNV_OFFSET
    for b in key:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_all(keys: list[bytes]) -> np.ndarray:
    """FNV-1a of many keys at once, byte position by byte position; keys are taken longest first."""
    lengths = np.array([len(k) for k in keys], np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
    data = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64)
    h = np.full(len(keys), FNV_OFFSET, np.uint64)
    shorter = np.sort(lengths)
    for i in range(int(lengths.max(initial=0))):
        n = len(keys) - int(np.searchsorted(shorter, i, "right"))  # keys longer than i
        h[:n] = (h[:n] ^ data[starts[:n] + i]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def bloom_positions(spark, key: Column | str, n: int, rate: float = 0.01) -> Column:
    """Bit positions of a key under double hashing of its FNV-1a halves (32-bit wrap-around), by an Arrow UDF.

    Wrapping 64-bit products have no built-in expression under ANSI arithmetic, hence the UDF.
    """
    workers_can_import(spark)
    bits, count = bloom_shape(n, rate)

    @F.pandas_udf("array<long>")
    def positions(keys: pd.Series) -> pd.Series:
        h = fnv1a_all([(k or "").encode() for k in keys])
        low, high = h & np.uint64(0xFFFFFFFF), np.maximum(h >> np.uint64(32), np.uint64(1))
        at = (low[:, None] + np.arange(count, dtype=np.uint64) * high[:, None]) & np.uint64(0xFFFFFFFF)
        return pd.Series(list((at % np.uint64(bits)).astype(np.int64)), dtype=object)

    return positions(F.col(key) if isinstance(key, str) else key)
