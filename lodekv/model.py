"""Schemas, operation names and typed errors."""

from __future__ import annotations

from pyspark.sql import types as T

SET, PLANT, MORPH, BANISH = "SET", "PLANT", "MORPH", "BANISH"

KV = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType())])
LOG = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), *KV.fields])
RUN = T.StructType([T.StructField("run_id", T.IntegerType(), False), *KV.fields])
APPLIED = "op string, n_keys long, message string"


class StatementError(ValueError):
    """A statement that cannot be parsed or applied; the text is part of the contract."""


class ParseError(StatementError):
    def __init__(self, errors: list[str]):
        self.errors = errors
        super().__init__(f"parser errors: [{' '.join(errors)}]")


class ConcurrentWrite(RuntimeError):
    """Another writer has changed the store since this one opened it."""


class KeyExists(StatementError):
    def __init__(self, key: str):
        self.key = key
        super().__init__(f"key '{key}' already exists — use MORPH to update it")


class KeyMissing(StatementError):
    def __init__(self, key: str):
        self.key = key
        super().__init__(f"cannot morph key {key}: not found")
