"""The engine: statements and API calls over a keyspace, compiled to DataFrames.

Reads return lazy plans. Writes are resolved once: the driver looks up which of the listed keys exist (never more than
the statement lists), keeps the pairs before the first conflict, and appends them as one log batch.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import APPLIED, BANISH, MORPH, PLANT, SET, KeyExists, KeyMissing
from ..operators import digest
from ..operators.replay import replay
from ..operators.snapshot import total
from ..runtime import materialize
from ..sources.store import Store
from . import reveal
from .statements import Banish, Reveal, Write, parse


class Engine:
    """``cache``: keep the state of the current version in memory and on disk; a write makes it stale."""

    def __init__(self, spark: SparkSession, store: Store | str, cache: bool = False):
        self.spark, self.cache = spark, cache
        self.store = Store(spark, store) if isinstance(store, str) else store
        self._cached: tuple[int, DataFrame] | None = None
        self._root: tuple[int, str | None] | None = None

    @property
    def state(self) -> DataFrame:
        if not self.cache:
            return self.store.state()
        version = self.store.manifest["version"]
        if self._cached is None or self._cached[0] != version:
            if self._cached is not None:
                self._cached[1].unpersist()
            self._cached = version, self.store.state().persist(StorageLevel.MEMORY_AND_DISK)
        return self._cached[1]

    def digest_root(self) -> str | None:
        """The root of the digest over the keys (null for none), computed once for each version."""
        version = self.store.manifest["version"]
        if self._root is None or self._root[0] != version:
            found = digest.root(self.state).first()
            self._root = version, found["root"] if found else None
        return self._root[1]

    # statements

    def execute(self, text: str, strict: bool = False) -> DataFrame:
        """Run the first statement of ``text``."""
        statement = parse(text, strict)
        if isinstance(statement, Reveal):
            if statement.prefix is not None:
                return reveal.reveal_prefix(self.state, statement.prefix)
            return reveal.reveal_keys(self.state, list(statement.keys))
        if isinstance(statement, Banish):
            return self._banish(list(statement.keys))
        return self._write(statement)

    def _applied(self, op: str, word: str, n: int) -> DataFrame:
        return self.spark.createDataFrame([(op, n, f"{word} {n} keys")], APPLIED)

    def _append(self, rows: list[tuple[str, str, str | None]]) -> None:
        if rows:
            numbered = [(i, *r) for i, r in enumerate(rows)]
            self.store.append(self.spark.createDataFrame(numbered, "pos long, op string, key string, value string").coalesce(1))

    def _banish(self, keys: list[str]) -> DataFrame:
        self._append([(BANISH, k, None) for k in keys])
        return self._applied(BANISH, "Banished", len(keys))

    def _write(self, statement: Write) -> DataFrame:
        listed = sorted({k for k, _ in statement.pairs})
        known = {r.key for r in reveal.hits_of(self.state, listed).select("key").collect()}  # no more than are listed
        accepted, error = [], None
        for key, value in statement.pairs:
            if statement.op == PLANT and key in known:
                error = KeyExists(key)
            elif statement.op == MORPH and key not in known:
                error = KeyMissing(key)
            if error is not None:
                break
            known.add(key)
            accepted.append((statement.op, key, value))
        self._append(accepted)
        if error is not None:
            raise error
        return self._applied(statement.op, "Planted" if statement.op == PLANT else "Morphed", len(accepted))

    def execute_batch(self, writes: DataFrame, **note) -> DataFrame:
        """Apply many single-pair operations ``pos, op, key, value`` in order, as one job: ``seq, key, op, applied``.

        Only the state of the written keys is read. ``note`` goes into the manifest with the batch.
        """
        log = writes.withColumnRenamed("pos", "seq")
        before = self.state.join(writes.select("key").distinct(), "key", "left_semi")
        judged = materialize(replay(log, before), "batch")
        self.store.append(judged.where("applied").select(F.col("seq").alias("pos"), "op", "key", "value"), **note)
        return judged.drop("value")

    # keyed API

    def get(self, key: str) -> DataFrame:
        """``pos, key, value, found``: one row."""
        return reveal.reveal_keys(self.state, [key])

    def set(self, pairs: DataFrame) -> None:
        """Unconditional upsert of ``key, value`` rows; of a repeated key one row wins, as ``pos`` says if there is one.

        Each key comes once, so all rows share one sequence number.
        """
        pos = F.col("pos") if "pos" in pairs.columns else F.lit(0)
        newest = pairs.groupBy("key").agg(F.max_by(F.struct("value"), pos).alias("__new"))
        self.store.append(newest.select(F.lit(0).alias("pos"), F.lit(SET).alias("op"), "key", "__new.value"))

    def delete(self, keys: DataFrame) -> None:
        """Unconditional; keys that do not exist are no error."""
        self.store.append(keys.select("key").distinct().select(F.lit(0).alias("pos"), F.lit(BANISH).alias("op"), "key", F.lit(None).cast("string").alias("value")))

    def keys(self, offset: int | None = None, limit: int | None = None) -> DataFrame:
        return reveal.keys_page(self.state, offset, limit)

    def page(self, offset: int | None = None, limit: int | None = None, search: str | None = None) -> DataFrame:
        """A page of keys with values, of which ``search`` keeps those that contain it."""
        out = reveal.page_with_values(self.state, offset, limit)
        return reveal.search(out, search) if search else out

    def total(self) -> DataFrame:
        return total(self.state)
