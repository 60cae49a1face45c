"""BPE encoding and decoding by forced-boundary splitting.

A merge can only join two symbols that stand side by side inside some token. So where two adjacent bytes of a
word occur side by side in no token of the vocabulary, no merge can ever cross: the place is a certain cut. A
word is cut at all such places, the fragments are encoded independently (and remembered, since fragments
repeat far more than words), and the ids are concatenated.

Defined results: a null text is empty (no ids, empty decoded text); repeated rows stay; an empty table gives no
rows; texts of any length are encoded whole; columns of the input
that have the name of a result are replaced. Added tokens that stand in a text become their ids, as the
library does by default.
"""

from __future__ import annotations

from functools import cache
from hashlib import sha256
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..runtime import workers_can_import
from .columns import texts, with_columns
from .word_bpe import END, Memo, default_path, vocabulary

#: Words and fragments remembered per worker process, twice over.
MEMO_WORDS, MEMO_FRAGMENTS = 250_000, 50_000


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.tokens = {i: t for t, i in self.vocab.ids.items()} | {i: t for t, i in self.vocab.added.items()}
        self.joinable = self._joinable()
        self.fragments = Memo(self._encode_fragment, MEMO_FRAGMENTS)
        self.words = Memo(self._encode_word, MEMO_WORDS)

    def _joinable(self) -> set[tuple[str, str]]:
        """Pairs of start symbols that stand side by side inside some token (word-end mark included)."""
        pairs = set()
        for token in self.vocab.ids:
            ended = token.endswith(END) and token != END
            symbols = list(token.removesuffix(END) if ended else token)
            if ended:
                symbols[-1] += END
            pairs.update(zip(symbols, symbols[1:], strict=False))
        return pairs

    def cut(self, word: str) -> list[tuple[str, ...]]:
        """The fragments of a word between its forced boundaries."""
        symbols, joinable = self.vocab.symbols(word), self.joinable
        out, first = [], 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in joinable:
                out.append(tuple(symbols[first:i]))
                first = i
        if symbols:
            out.append(tuple(symbols[first:]))
        return out

    def _encode_fragment(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        parts = list(fragment)
        parts = merged_long(parts, self.vocab.ranks) if len(parts) > 256 else merged_short(parts, self.vocab.ranks)
        ids = self.vocab.ids
        return tuple(ids[p] for p in parts if p in ids)

    def _encode_word(self, word: str) -> tuple[bytes, bytes]:
        ids = [i for fragment in self.cut(word) for i in self.fragments[fragment]]
        return pack(f"<{len(ids)}I", *ids), " ".join(map(self.tokens.__getitem__, ids)).encode()

    def encode(self, text: str | None) -> tuple[bytes, list[bytes]]:
        """(ids as little-endian unsigned 32-bit integers, the decoded pieces of each word)."""
        ids, decoded = [], []
        look = self.words.__getitem__
        for words, added in self.vocab.pieces(text) if text else ():
            found = list(map(look, words))
            ids += [a for a, _ in found]
            decoded += [b for _, b in found]
            if added is not None:
                ids.append(pack("<I", added))
                decoded.append(self.tokens[added].encode())
        return b"".join(ids), decoded

    def decode(self, ids: bytes) -> str:
        """The library's decode for a file without a decoder: token strings joined by spaces."""
        return " ".join(self.tokens[i] for i in memoryview(ids).cast("I"))


_NEVER = 1 << 60


def merged_short(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge the pair of lowest rank, the first of equals, until none is left; two ranks change with each merge."""
    get = ranks.get
    order = [get(pair, _NEVER) for pair in zip(parts, parts[1:], strict=False)]
    while order and (best := min(order)) != _NEVER:
        i = order.index(best)
        parts[i] += parts.pop(i + 1)
        del order[i]
        if i < len(order):
            order[i] = get((parts[i], parts[i + 1]), _NEVER)
        if i:
            order[i - 1] = get((parts[i - 1], parts[i]), _NEVER)
    return parts


def merged_long(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same by a heap: for fragments of hundreds of symbols."""
    from heapq import heapify, heappop, heappush

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        if parts[i] is None or (j := after[i]) >= n or ranks.get((parts[i], parts[j])) != rank:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (i, before[i]):
            if left >= 0 and after[left] < n and (r := ranks.get((parts[left], parts[after[left]]))) is not None:
                heappush(heap, (r, left))
    return [p for p in parts if p is not None]


@cache
def codec(path: str) -> Codec:
    """One codec, with its memos, per worker process and file."""
    return Codec(path)


IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
DECODED = T.StructField("decoded", T.StringType())
DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode_decode(df: DataFrame, text_col: str = "text", tokenizer_path: str | None = None, keep: list[str] | None = None, values: bool = True) -> DataFrame:
    """``df`` (its ``keep`` columns, or all) with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    ``values`` adds ``ids`` (array of int) and ``decoded`` (text); without it only their digests leave the workers.
    """
    workers_can_import(df.sparkSession)
    path = tokenizer_path or default_path()

    def make():
        code = codec(path)

        def compute(column: pa.Array) -> list[pa.Array]:
            counts, id_digests, text_digests, all_ids, all_text = [], [], [], [], []
            for text in texts(column):
                ids, decoded = code.encode(text)
                plain = b" ".join(decoded)
                counts.append(len(ids) // 4)
                id_digests.append(sha256(ids).hexdigest())
                text_digests.append(sha256(plain).hexdigest())
                if values:
                    all_ids.append(list(memoryview(ids).cast("I")))
                    all_text.append(plain.decode())
            out = [pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            return out + [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())] if values else out

        return compute

    added = T.StructType(DIGESTS + ([IDS, DECODED] if values else []))
    return with_columns(df, text_col, added, make, keep)
