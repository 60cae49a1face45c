"""Key-value fixtures made of the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ring import Ring, shards
from .operators.snapshot import split_runs
from .runtime import table

NODES = ["NodeA", "NodeB", "NodeC"]
MORE_NODES = [*NODES, "NodeD"]
RING_KEYS = 100_000
RUN_ROWS = 2500


def _kv(rows: DataFrame, family: str, key: str, value: str) -> DataFrame:
    return rows.select(F.concat(F.lit(f"{family}:"), F.col(key).cast("string")).alias("key"), F.col(value).alias("value"))


def kv_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(table(spark, sf_dir, "customer"), "customer", "c_custkey", "c_name")


def kv_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = [("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("part", "p_partkey", "p_name")]
    parts = [kv_customer(spark, sf_dir), *(_kv(table(spark, sf_dir, t), t, k, v) for t, k, v in families)]
    return reduce(DataFrame.unionByName, parts)


def _events(spark: SparkSession, sf_dir: str, op, value) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), value.alias("value"))


def log_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return _events(spark, sf_dir, F.when(error, "BANISH").otherwise("SET"), F.when(~error, F.col("props")))


def log_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "signup", "PLANT").when(kind == "error", "BANISH").when(kind == "purchase", "SET").otherwise("MORPH")
    return _events(spark, sf_dir, op, F.when(kind != "error", F.col("props")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_runs(log_upsert(spark, sf_dir), F.floor(F.col("seq") / RUN_ROWS))


def ring_keys(spark: SparkSession, n: int = RING_KEYS) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("Key-"), F.col("id").cast("string")).alias("key"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kv_mixed`` on its two replicas; the first replica has lost a tenth of the keys."""
    placed = shards(kv_mixed(spark, sf_dir), Ring(NODES))
    return placed.where(~((F.col("node") == "NodeA") & (F.crc32(F.encode("key", "UTF-8")) % 10 == 0)))


def member_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that join and leave, as events of users say; ``seq, node, op``."""
    kind = F.col("event_type")
    op = F.when(kind == "error", "LEAVE").otherwise("JOIN")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("Node"), (F.col("user_id") % 40).cast("string")).alias("node"), op.alias("op"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_upsert`` as numbered text lines."""
    rows = log_upsert(spark, sf_dir)
    line = F.when(F.col("op") == "BANISH", F.concat(F.lit("DELETE|"), "key")).otherwise(F.concat(F.lit("PUT|"), "key", F.lit("|"), "value"))
    return rows.select(F.col("seq").alias("line"), line.alias("value"))
