"""Newest-wins state of a log, its listings, and compaction of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BANISH


def latest(log: DataFrame, order: str = "seq") -> DataFrame:
    """The newest ``op, value`` of each key, tombstones included. Partial aggregation carries one row per key and task."""
    newest = F.max_by(F.struct("op", "value"), order)
    return log.groupBy("key").agg(newest.alias("__new")).select("key", "__new.op", "__new.value")


def snapshot(log: DataFrame) -> DataFrame:
    """State of a log of unconditional operations: newest version per key, deleted keys gone."""
    return latest(log).where(F.col("op") != BANISH).select("key", "value")


def live_keys(log: DataFrame) -> DataFrame:
    """Keys of the state; values are not read."""
    newest = log.groupBy("key").agg(F.max_by("op", "seq").alias("op"))
    return newest.where(F.col("op") != BANISH).select("key")


def compact(runs: DataFrame) -> DataFrame:
    """Full merge of runs ``(run_id, key, value)``: the highest run wins, null values are tombstones."""
    newest = F.max_by(F.struct("value"), "run_id")
    return runs.groupBy("key").agg(newest.alias("__new")).select("key", F.col("__new.value").alias("value")).where("value IS NOT NULL")


def split_runs(log: DataFrame, run: Column) -> DataFrame:
    """Runs of a log: the newest version of each key within each run, deletions as null values."""
    newest = F.max_by(F.struct("op", "value"), "seq")
    rows = log.withColumn("run_id", run.cast("int")).groupBy("run_id", "key").agg(newest.alias("__new"))
    return rows.select("run_id", "key", F.when(F.col("__new.op") != BANISH, F.col("__new.value")).alias("value"))


def byte_size(log: DataFrame) -> DataFrame:
    """Bytes of keys and values that a write buffer holds after the log; a deletion's key stays, without a value."""
    value = F.when(F.col("op") != BANISH, F.col("value"))
    size = F.octet_length("key") + F.coalesce(F.octet_length(value), F.lit(0))
    return latest(log).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_bytes"))


def total(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("total"))


def last_wins(rows: DataFrame, order: str = "pos") -> DataFrame:
    """One row per key: that with the highest position."""
    return rows.groupBy("key").agg(F.max_by("value", order).alias("value"))
