"""Binary run files: sorted length-prefixed records, a sparse index, and a footer with the index's offset.

Layout (little-endian): for each record ``u32`` key length, key, ``u32`` value length, value; then ``u32`` index entries
of ``u32`` key length, key, ``u64`` record offset, one for every ``INDEX_EVERY`` records; then ``u64`` offset of the
index. A file is a task's work; its records end at the index, whose bytes are never read as records.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import Struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import workers_can_import

INDEX_EVERY = 100
#: The value that stands for a deletion in these files; in this package a deletion is a null value.
TOMBSTONE = "__deleted__"
_u32, _u64 = Struct("<I"), Struct("<Q")


def encode(pairs: list[tuple[str, str | None]]) -> bytes:
    """One run file of pairs that are sorted by key."""
    body, index, at = [], [], 0
    for i, (key, value) in enumerate(pairs):
        k, v = key.encode(), (TOMBSTONE if value is None else value).encode()
        if i % INDEX_EVERY == 0:
            index.append(_u32.pack(len(k)) + k + _u64.pack(at))
        body += (_u32.pack(len(k)), k, _u32.pack(len(v)), v)
        at += 8 + len(k) + len(v)
    return b"".join([*body, _u32.pack(len(index)), *index, _u64.pack(at)])


def decode(data: bytes) -> Iterator[tuple[str, str | None]]:
    if len(data) < 12:
        raise ValueError("not a run file")
    (end,) = _u64.unpack_from(data, len(data) - 8)
    if end > len(data) - 12:
        raise ValueError("the index lies outside of the file")

    def text(at: int) -> tuple[str, int]:
        (n,) = _u32.unpack_from(data, at)
        if at + 4 + n > end:
            raise ValueError("a record runs into the index")
        return data[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n

    at = 0
    while at < end:
        key, at = text(at)
        value, at = text(at)
        yield key, None if value == TOMBSTONE else value


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, key, value`` of all run files below ``path``; a later file name is a newer run."""
    workers_can_import(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    order = {r.path: i for i, r in enumerate(files.select("path").orderBy(F.expr("cast(regexp_extract(path, '([0-9]+)[.]bin$', 1) as decimal(38, 0))"), "path").collect())}  # names only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pairs = list(decode(content.as_buffer().to_pybytes()))
                for k in range(0, len(pairs), 50_000):
                    some = pairs[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([order[name]] * len(some), pa.int32()), pa.array([p[0] for p in some]), pa.array([p[1] for p in some], pa.string())], names=["run_id", "key", "value"])

    return files.select("path", "content").mapInArrow(run, "run_id int, key string, value string")


def write_run(rows: DataFrame, path: str) -> None:
    """``key, value`` rows as run files, one for each partition of the sorted keys.

    The footer's last byte is zero for any file below 2**56 bytes; it is written as the text format's line separator.
    """
    workers_can_import(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([encode(pairs)[:-1]], pa.binary())], names=["value"])

    files = rows.select("key", "value").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)
