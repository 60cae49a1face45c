"""Log streams: a maintained newest-wins state, and ingestion of conditional writes into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import BANISH
from ..plans.engine import Engine
from ..sources.store import COMPACT_BYTES


def newest(log: DataFrame) -> DataFrame:
    """Streaming newest version of each key (update mode): ``key, op, value, seq``. State is one row per key."""
    agg = log.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("__new"), F.max("seq").alias("seq"))
    return agg.select("key", "__new.op", "__new.value", "seq")


def ingest(log: DataFrame, engine: Engine, checkpoint: str, compact_bytes: int = COMPACT_BYTES, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Apply a stream of ``seq, op, key, value`` to the engine's store, batch by batch, conditional writes included.

    Each micro-batch is replayed against the presence of its keys in the store, appended as one log batch, and the
    store is compacted when its log has grown. Batches must arrive in order of ``seq``. The epoch enters the
    manifest in the same commit as its batch, so that a batch that is delivered again is not applied twice.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        store = engine.store
        if store.manifest.get("epoch", -1) >= epoch:
            return
        base = batch.agg(F.min("seq")).first()[0]
        if base is None:
            return
        done = engine.execute_batch(batch.select((F.col("seq") - base).alias("pos"), "op", "key", "value"), epoch=epoch)
        if on_batch:
            on_batch(done, epoch)
        store.maintain(compact_bytes)

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def live(rows: DataFrame) -> DataFrame:
    """The state of the rows of :func:`newest` (of a sink that keeps every update: the latest of each key)."""
    latest = rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("__new"))
    return latest.where(F.col("__new.op") != BANISH).select("key", F.col("__new.value").alias("value"))
