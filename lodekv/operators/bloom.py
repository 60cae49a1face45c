"""Bloom filters of keys by double-hashed FNV-1a, with a size that follows from the number of keys and the error rate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bloom_positions, bloom_shape

#: Bits of the largest filter that is sent to the workers (16 MiB).
MAX_BITS = 1 << 27


def build(keys: DataFrame, n: int, rate: float = 0.01) -> DataFrame:
    """``position``: the bits that are set, merged before they are shuffled."""
    return keys.select(F.explode(bloom_positions(keys.sparkSession, "key", n, rate)).alias("position")).distinct()


def check(keys: DataFrame, bits: DataFrame, n: int, rate: float = 0.01) -> DataFrame:
    """``keys`` with ``maybe``: false means that the key was certainly not added.

    Beyond ``MAX_BITS`` the bits are joined instead of sent.
    """
    spark, size = keys.sparkSession, bloom_shape(n, rate)[0]
    placed = keys.withColumn("__at", bloom_positions(spark, "key", n, rate))
    if size > MAX_BITS:
        uid = placed.select("key", "__at").distinct()
        hit = uid.select("key", F.explode("__at").alias("position")).distinct().join(bits, "position", "left_anti").select("key").distinct()
        return placed.drop("__at").join(hit.withColumn("__no", F.lit(True)), "key", "left").withColumn("maybe", F.col("__no").isNull()).drop("__no")
    merged = bits.groupBy(F.shiftright("position", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(position & 31 AS int))) AS mask")).toArrow()
    field = np.zeros(size // 32 + 1, np.uint32)  # at most MAX_BITS / 32 words
    field[merged.column("word").to_numpy()] = merged.column("mask").to_numpy().astype(np.uint32)
    sent = spark.sparkContext.broadcast(field)

    @F.pandas_udf("boolean")
    def all_set(positions: pd.Series) -> pd.Series:
        if not len(positions):
            return pd.Series([], dtype=bool)
        at = np.stack(positions.to_list())
        return pd.Series((sent.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).all(axis=1).astype(bool))

    return placed.withColumn("maybe", all_set("__at")).drop("__at")
