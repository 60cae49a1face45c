"""Text logs: one ``PUT|key|value`` or ``DELETE|key`` line per operation, in append order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BANISH, SET
from ..runtime import materialize

_ROW_BITS = 33  # of monotonically_increasing_id


def parse_lines(lines: DataFrame, order: str = "line", text: str = "value") -> DataFrame:
    """``seq, op, key, value`` of log lines; the value may hold bars, lines of any other form are skipped."""
    part = F.split(F.col(text), r"\|", 3)
    rows = lines.select(F.col(order).cast("long").alias("seq"), part.alias("p"))
    put, gone = F.get("p", 0) == "PUT", F.get("p", 0) == "DELETE"
    rows = rows.where((put & (F.size("p") == 3)) | (gone & (F.size("p") >= 2)))
    return rows.select("seq", F.when(put, SET).otherwise(BANISH).alias("op"), F.get("p", 1).alias("key"), F.when(put, F.get("p", 2)).alias("value"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A text log as ``seq, op, key, value``: ``seq`` is the line's number over all files, from 0.

    A file's lines keep their order; files are taken in the order of their names. A split's lines are numbered in its
    own task, and the driver adds up the splits' line counts (one row for each split of a file).
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    held = materialize(lines, "lines").withColumn("p", F.shiftright("m", _ROW_BITS))
    offsets, at = [], 0
    for r in held.groupBy("file", "block", "p").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("file", "block").collect():
        offsets.append((r["file"], r["block"], r["p"], at - r["first"]))
        at += r["n"]
    table = spark.createDataFrame(offsets, "file string, block long, p long, shift long")
    return parse_lines(held.join(table, ["file", "block", "p"]).select((F.col("m") + F.col("shift")).alias("line"), "value"))


def to_lines(log: DataFrame) -> DataFrame:
    """``value``: log lines in order of ``seq``. Keys with a bar, and keys or values with a line break, have no line form."""
    bad = F.col("key").rlike(r"[|\r\n]") | F.coalesce(F.col("value").rlike(r"[\r\n]"), F.lit(False))
    line = F.when(F.col("op") == BANISH, F.concat(F.lit("DELETE|"), "key")).otherwise(F.concat(F.lit("PUT|"), "key", F.lit("|"), "value"))
    return log.orderBy("seq").select(F.when(bad, F.raise_error(F.lit("a key or value has no line form"))).otherwise(line).alias("value"))


def write_log(log: DataFrame, path: str) -> None:
    to_lines(log).write.mode("append").text(path)
