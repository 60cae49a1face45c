"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list; a heap holds the rank of every adjacent pair that can merge. The
lowest rank is popped again and again, stale entries are skipped, and each merge only joins two list nodes.
The count of a word is its initial symbols minus its merges: no identifier is ever looked up.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows stay; an empty table gives no
rows; a text of one huge word
takes O(n log n) time and O(n) memory; columns of the input that have the name of a result are replaced.
"""

from __future__ import annotations

from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import workers_can_import
from .columns import texts, with_columns
from .word_bpe import Memo, default_path, vocabulary

#: Words remembered per worker process, twice over.
MEMO_WORDS = 400_000


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of tokens of one pre-token."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        rank, i = heappop(heap)
        left = symbols[i]
        if left is None or (j := after[i]) >= n or ranks.get((left, symbols[j])) != rank:
            continue
        joined = symbols[i] = left + symbols[j]
        symbols[j] = None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((joined, symbols[k]))) is not None:
                heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], joined))) is not None:
            heappush(heap, (r, h))
    return n - merges


@cache
def counter(path: str):
    """The function text -> token count of one vocabulary file; kept per worker process."""
    vocab = vocabulary(path)
    memo = Memo(lambda word: merged_length(vocab.symbols(word), vocab.ranks), MEMO_WORDS)
    look = memo.__getitem__

    def count(text: str | None) -> int:
        if not text:
            return 0
        return sum(sum(map(look, words)) + (added is not None) for words, added in vocab.pieces(text))

    return count


ADDED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def token_counts(df: DataFrame, text_col: str = "text", tokenizer_path: str | None = None, limit: int = 2048, keep: list[str] | None = None) -> DataFrame:
    """``df`` (its ``keep`` columns, or all) with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    workers_can_import(df.sparkSession)
    path = tokenizer_path or default_path()

    def make():
        count = counter(path)

        def compute(column: pa.Array) -> list[pa.Array]:
            values = texts(column)
            return [
                pa.array([0 if x is None else len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")) for x in values], pa.int64()),
                pa.array([count(x) for x in values], pa.int64()),
            ]

        return compute

    out = with_columns(df, text_col, ADDED, make, [c for c in (keep or df.columns) if c.lower() != "over_limit"])
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
