"""Versioned store: append-only log batches, sorted snapshots and a manifest, on any Hadoop file system.

Layout below the root: ``log/batch=N`` and ``snapshot/version=N`` (Parquet; ``N`` is a number and a suffix of the writer's
own, so that no writer replaces another's files) and ``manifest.json``. Files that the
manifest does not name are invisible. A change writes new files first and then replaces the manifest by a
rename; readers pin the manifest that they opened. One writer at a time: a commit onto a manifest that is no longer
the one opened is an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BANISH, LOG, SET, ConcurrentWrite
from ..operators.snapshot import latest

#: Bytes of log batches from which ``maintain`` compacts.
COMPACT_BYTES = 1 << 30


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.manifest = self._load() or {"version": 0, "snapshot": None, "batches": [], "next_seq": 0, "next_batch": 0}

    # files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _load(self) -> dict | None:
        path = self._path("manifest.json")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _check(self) -> None:
        found = self._load()
        if (found or {"version": 0})["version"] != self.manifest["version"]:
            raise ConcurrentWrite(f"the store is at version {found['version'] if found else 0}, this writer opened version {self.manifest['version']}")

    def _own(self, number: int) -> str:
        return f"{number}-{uuid.uuid4().hex[:12]}"

    def _commit(self, **changes) -> None:
        self._check()
        new = {**self.manifest, **changes, "version": self.manifest["version"] + 1}
        temporary = self._path("manifest.json.new")
        stream = self._fs.create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(new).encode()))
        finally:
            stream.close()
        target = self._path("manifest.json")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, target, options)
        self.manifest = new

    # reading

    def _read(self, names: list[str]) -> DataFrame:
        paths = [f"{self.root}/{n}" for n in names]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def log(self) -> DataFrame:
        """The batches since the last snapshot."""
        return self._read([f"log/batch={n}" for n in self.manifest["batches"]])

    def versions(self) -> DataFrame:
        """Snapshot and log together, as log rows: snapshot rows have the lowest ``seq``."""
        names = [] if self.manifest["snapshot"] is None else [f"snapshot/version={self.manifest['snapshot']}"]
        return self._read([*names, *(f"log/batch={n}" for n in self.manifest["batches"])])

    def state(self) -> DataFrame:
        """``key, value``. A key condition moves below the aggregation and into the Parquet scans."""
        if not self.manifest["batches"]:
            return self.versions().select("key", "value")  # a snapshot has one row per key already
        return latest(self.versions()).where(F.col("op") != BANISH).select("key", "value")

    # writing

    def append(self, rows: DataFrame, **note) -> None:
        """Add ``pos, op, key, value`` rows as one batch, in order of ``pos`` (a number from 0, unique for each key).

        ``note``: entries of the manifest that change with the batch, in the same commit.
        """
        self._check()
        number, base = self.manifest["next_batch"], self.manifest["next_seq"]
        batch = self._own(number)
        target = f"{self.root}/log/batch={batch}"
        numbered = rows.select((F.col("pos").cast("long") + base).alias("seq"), "op", "key", "value")
        numbered.write.mode("overwrite").parquet(target)
        last = self.spark.read.schema(LOG).parquet(target).agg(F.max("seq")).first()[0]
        if last is not None:
            note |= {"batches": [*self.manifest["batches"], batch], "next_batch": number + 1, "next_seq": last + 1}
        if note:
            self._commit(**note)

    def compact(self) -> None:
        """Write the state as a new snapshot, sorted by key with a Bloom filter per file, and forget the batches."""
        self._check()
        number = self.manifest["next_batch"]
        version = self._own(number)
        rows = self.state().select(F.lit(-1).cast("long").alias("seq"), F.lit(SET).alias("op"), "key", "value")
        writer = rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite")
        writer.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.root}/snapshot/version={version}")
        self._commit(snapshot=version, batches=[], next_batch=number + 1)

    def log_bytes(self) -> int:
        return sum(self._fs.getContentSummary(self._path(f"log/batch={n}")).getLength() for n in self.manifest["batches"])

    def maintain(self, limit: int = COMPACT_BYTES) -> bool:
        """Compact if the log has grown beyond ``limit`` bytes."""
        if self.log_bytes() <= limit:
            return False
        self.compact()
        return True

    def vacuum(self) -> int:
        """Delete batches and snapshots that the manifest does not name; no reader may still use an older one."""
        keep = {f"batch={n}" for n in self.manifest["batches"]} | {f"version={self.manifest['snapshot']}"}
        gone = 0
        for name in ("log", "snapshot"):
            if self._fs.exists(self._path(name)):
                for status in self._fs.listStatus(self._path(name)):
                    if status.getPath().getName() not in keep:
                        gone += bool(self._fs.delete(status.getPath(), True))
        return gone
