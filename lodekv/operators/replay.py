"""Conditional writes: replay of a mixed log by one window, and multi-pair statements by their first conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import BANISH, MORPH, PLANT

#: Pairs of a statement that are sent to the workers; a larger one is joined by shuffle.
SENT_PAIRS = 1_000_000

#: Sequence numbers of one chunk of a key's history; a key with more of them is replayed by several tasks.
CHUNK = 1 << 20


def replay(log: DataFrame, initial: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """``seq, key, op, applied`` (and ``value``) of every row of a log of single-pair operations.

    A MORPH never changes presence, and a PLANT that is rejected leaves the key present; so presence before a row
    is that after the last operation before it that is not a MORPH. ``initial`` are the keys present at first.

    A hot key's history is cut into chunks: a pre-aggregation finds the last such operation of each chunk, a window
    over chunks carries it on, and the rows are then judged by windows within single chunks.
    """
    rows = log.select("seq", "key", "op", "value", F.floor(F.col("seq") / chunk).alias("__chunk"))
    lasting = F.col("op") != MORPH
    ends = rows.groupBy("key", "__chunk").agg(F.max_by(F.when(lasting, F.col("op")), F.when(lasting, F.col("seq"))).alias("op"))
    if initial is not None:  # before all chunks
        ends = ends.unionByName(initial.select("key", F.lit(None).cast("long").alias("__chunk"), F.lit("SET").alias("op")))
    earlier = Window.partitionBy("key").orderBy(F.asc_nulls_first("__chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "__chunk", F.last("op", ignorenulls=True).over(earlier).alias("op")).where("op IS NOT NULL AND __chunk IS NOT NULL")
    born = carried.select(F.lit(None).cast("long").alias("seq"), "key", "op", F.lit(None).cast("string").alias("value"), "__chunk")
    before = Window.partitionBy("key", "__chunk").orderBy(F.asc_nulls_first("seq")).rowsBetween(Window.unboundedPreceding, -1)
    kind = F.last(F.when(lasting, F.col("op")), ignorenulls=True).over(before)
    present = F.coalesce(kind != BANISH, F.lit(False))
    applied = F.when(F.col("op") == PLANT, ~F.col("__present")).when(F.col("op") == MORPH, F.col("__present")).otherwise(True)
    return rows.unionByName(born).withColumn("__present", present).where("seq IS NOT NULL").select("seq", "key", "op", applied.alias("applied"), "value")


def replay_state(log: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """State after the applied operations of the log."""
    done = replay(log, initial).where("applied").select("seq", "op", "key", "value")
    if initial is not None:
        done = done.unionByName(initial.select(F.lit(-1).cast("long").alias("seq"), F.lit("SET").alias("op"), "key", "value"))
    newest = F.max_by(F.struct("op", "value"), "seq")
    return done.groupBy("key").agg(newest.alias("__new")).where(F.col("__new.op") != BANISH).select("key", F.col("__new.value").alias("value"))


def judge_pairs(state: DataFrame, pairs: DataFrame, op: str) -> DataFrame:
    """``pos, key, value, accepted`` of a multi-pair PLANT or MORPH: pairs before the first conflict are accepted.

    PLANT conflicts with a key of the state or of an earlier pair, MORPH with a key that the state lacks.
    """
    listed = _sent(pairs.select("key").distinct(), pairs)
    known = state.join(listed, "key", "left_semi").select("key", F.lit(True).alias("__known"))  # no more rows than pairs
    judged = pairs.join(known, "key", "left")
    if op == PLANT:
        again = F.row_number().over(Window.partitionBy("key").orderBy("pos")) > 1
        judged = judged.withColumn("__bad", F.coalesce("__known", F.lit(False)) | again)
    else:
        judged = judged.withColumn("__bad", F.col("__known").isNull())
    first = judged.where("__bad").agg(F.min("pos").alias("first"))
    return judged.select("pos", "key", "value", F.coalesce(F.col("pos") < first.scalar(), F.lit(True)).alias("accepted"))


def after_pairs(state: DataFrame, pairs: DataFrame, op: str) -> DataFrame:
    """State after a multi-pair statement: later pairs of a key win.

    Accepted pairs of a PLANT have keys that the state lacks, so they are added to it; those of a MORPH replace
    values in place. The state itself is never shuffled, but for a statement of more than ``SENT_PAIRS`` pairs.
    """
    accepted = judge_pairs(state, pairs, op).where("accepted").groupBy("key").agg(F.max_by("value", "pos").alias("__new"))
    if op == PLANT:
        return state.select("key", "value").unionByName(accepted.select("key", F.col("__new").alias("value")))
    return state.join(_sent(accepted, pairs), "key", "left").select("key", F.coalesce("__new", "value").alias("value"))


def _sent(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows``, which are no more than ``pairs``, with a broadcast hint if a count allows it."""
    return F.broadcast(rows) if pairs.limit(SENT_PAIRS + 1).count() <= SENT_PAIRS else rows


def banish(state: DataFrame, keys: DataFrame) -> DataFrame:
    """State without the listed keys."""
    return state.join(_sent(keys.select("key").distinct(), keys), "key", "left_anti")


def applied_count(op: str, rows: DataFrame) -> DataFrame:
    """``op, n_keys, message`` of a statement's accepted rows."""
    word = {"PLANT": "Planted", "MORPH": "Morphed", "BANISH": "Banished"}[op]
    return rows.agg(F.count(F.lit(1)).alias("n_keys")).select(F.lit(op).alias("op"), "n_keys", F.concat(F.lit(f"{word} "), F.col("n_keys").cast("string"), F.lit(" keys")).alias("message"))
