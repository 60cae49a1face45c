"""Arrow helpers of the Python-side operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that become Python objects at once.
ROWS = 1024


def texts(column: pa.Array) -> list[str | None]:
    """Python strings of a string column; bytes that are not UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast(pa.large_binary()).to_pylist()
        return [None if x is None else x.decode("utf-8", "replace") for x in raw]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): one uint8 array of the whole column and where each text begins; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts [first, last) of about ``limit`` bytes; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(first + 1, min(last, n))
        yield first, last
        first = last


def with_columns(df: DataFrame, text_col: str, added: T.StructType, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], keep: list[str] | None = None) -> DataFrame:
    """``df`` (its ``keep`` columns, or all) with columns computed from ``text_col`` batch by batch.

    ``make()`` runs once per task and returns the function from a text array to the added arrays. A column
    of ``df`` that has the name of an added one is replaced.
    """
    names = {f.name.lower() for f in added.fields}
    keep = [c for c in (keep or df.columns) if c.lower() not in names]
    source = df.select(*[_quoted(c) for c in keep], df[_quoted(text_col)].cast("string").alias("__text"))
    schema = T.StructType([*(f for f in source.schema.fields if f.name != "__text"), *added.fields])
    arrow = to_arrow_schema(added)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            new = [a.cast(f.type) if a.type != f.type else a for a, f in zip(compute(batch.column(width)), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=[*keep, *(f.name for f in arrow)])

    return source.mapInArrow(run, schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
