"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by token windows.

Words are the runs ``[0-9a-z]`` and all non-ASCII bytes after A-Z has been lower-cased. Each benchmark item
gives its windows of 13 consecutive words (an item of fewer words is one window). The set is the items' normalised text,
once, and the sorted 64-bit hashes of its windows with their places in that text. Workers roll the same hash over
the words of each text with numpy, look it up, and verify every candidate by comparing the window's words
themselves; so hash collisions cannot change a result.

The set is broadcast only in shards whose built size (text and arrays) is at most ``SHARD_BYTES``; an item that alone is
larger goes in pieces that overlap by a window. A larger benchmark is scanned shard after shard, the hits of each
pass being kept per document until the last.

Defined results: null or wordless texts have no words, no hits, and are not contaminated; items that are
null, wordless or without an id are ignored; repeated items count once; repeated documents stay; an empty
benchmark or an empty table of documents gives no hits; texts and items of any length are scanned whole, in pieces; a
window that many items share hits for all of them; columns of the documents that have the name of a result are
replaced, others may have any names; an item id that is no integer is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, workers_can_import
from .columns import groups, utf8, with_columns

WINDOW = 13
#: Bytes of one broadcast set as it lies in each worker's memory.
SHARD_BYTES = 48 << 20
#: Bytes of text that are scanned at once.
SLAB = 1 << 20
#: Bytes of a set for each window of it: its hash, its place and width, and its item.
WINDOW_BYTES = 24

_word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER = np.frombuffer(_lower, np.uint8)
IS_WORD = np.array([bool(_word.match(_lower[b : b + 1])) for b in range(256)])

P = np.uint64(0x9E3779B97F4A7C15)
Q = np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)


def words_of(text: bytes) -> list[bytes]:
    return _word.findall(text.translate(_lower))


def windows_of(words: list[bytes], width: int) -> set[bytes]:
    if len(words) <= width:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse modulo 2**64."""
    inverse = pow(int(P), -1, 1 << 64)
    up, down = np.full(n, P, np.uint64), np.full(n, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class WindowSet:
    """Exact set of the windows of some items, and a vectorised scan for them."""

    def __init__(self, items: list[tuple[int, bytes]], width: int = WINDOW):
        """``items``: ids and normalised texts (words with one space between them, at least one)."""
        self.up, self.down = _powers(4096)
        self.text = np.frombuffer(b"\n".join(t for _, t in items), np.uint8)
        parts: list[tuple[np.ndarray, ...]] = []
        at, group, size = 0, [], 0
        for k, (_, text) in enumerate(items):
            group.append(k)
            size += len(text) + 1
            if size > SLAB or k + 1 == len(items):
                parts += self._windows(at, size - 1, group, width)
                at, group, size = at + size, [], 0
        none = np.zeros(0, np.int64)
        hashes, places, widths, owners = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none.astype(np.uint64), none, none, none)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places, self.sizes = hashes[order], places[order].astype(np.int32), widths[order].astype(np.int32)
        self.owners = np.array([i for i, _ in items], np.int64)[owners[order]] if len(items) else none
        self.widths = sorted(set(self.sizes.tolist()))
        bits = max(16, int(4 * len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, np.bool_)
        self.maybe[(self.hashes >> self.shift).astype(np.int64)] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("maybe", "up", "down")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.up, self.down = _powers(4096)
        self.maybe = np.zeros(1 << (64 - int(self.shift)), np.bool_)
        self.maybe[(self.hashes >> self.shift).astype(np.int64)] = True

    def _windows(self, at: int, size: int, group: list[int], width: int) -> list[tuple[np.ndarray, ...]]:
        """(hashes, places, widths, item numbers) of the items that lie in the text from ``at``."""
        low = self.text[at : at + size]
        item_starts = np.append(0, np.flatnonzero(low == 10) + 1)
        starts, ends = word_bounds(low, IS_WORD[low], item_starts)
        owner = np.searchsorted(item_starts, starts, "right") - 1
        counts = np.bincount(owner, minlength=len(group))
        hashes = self._word_hashes(low, starts, ends)
        out = []
        for w in np.unique(np.minimum(counts, width)).tolist():
            n = len(starts) - w + 1
            whole = (owner[:n] == owner[w - 1 :]) & (np.minimum(counts[owner[:n]], width) == w)
            some = np.flatnonzero(whole)
            out.append((self._roll(hashes, w)[some], starts[some] + at, np.full(len(some), w), np.array(group)[owner[some]]))
        return out

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = _powers(1 << int(n).bit_length())

    def _word_hashes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(low) + 1)
        sums = np.empty(len(low) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.up[: len(low)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> _S
        h *= Q
        return h

    def _roll(self, hashes: np.ndarray, width: int) -> np.ndarray:
        n = len(hashes) - width + 1
        out = hashes[:n].copy()
        for k in range(1, width):
            out *= Q
            out += hashes[k : k + n]
        out ^= out >> _S
        out *= P
        return out

    def _items_of(self, window: bytes, key: np.uint64, width: int) -> np.ndarray:
        """The items that have this window of so many words."""
        first, last = np.searchsorted(self.hashes, key, "left"), np.searchsorted(self.hashes, key, "right")
        at = self.places[first:last][self.sizes[first:last] == width].astype(np.int64)
        items = self.owners[first:last][self.sizes[first:last] == width]
        wanted = np.frombuffer(window + b" ", np.uint8)
        at, items = at[at + len(window) <= len(self.text)], items[at + len(window) <= len(self.text)]
        for lo in range(0, len(at), 1 << 12):
            spot = at[lo : lo + (1 << 12), None] + np.arange(len(window))
            same = (self.text[spot] == wanted[:-1]).all(axis=1)
            after = at[lo : lo + (1 << 12)] + len(window)
            ended = np.where(after < len(self.text), self.text[np.minimum(after, len(self.text) - 1)], 10) <= 32
            at[lo : lo + (1 << 12)] = np.where(same & ended, at[lo : lo + (1 << 12)], -1)
        return np.unique(items[at >= 0])

    def scan(self, raw: np.ndarray, offsets: np.ndarray):
        """(word starts, word ends, text of each word, hit flag of each word, [(text, items)]) of a slab."""
        low = LOWER[raw]
        starts, ends = word_bounds(low, IS_WORD[low], offsets)
        owner = np.searchsorted(offsets, starts, "right") - 1
        hit = np.zeros(len(starts), np.bool_)
        found: list[tuple[int, list[int]]] = []
        if len(starts) and self.widths and len(starts) >= self.widths[0]:
            hashes = self._word_hashes(low, starts, ends)
            known: dict[bytes, list[int]] = {}
            for width in self.widths:
                if width > len(starts):
                    break
                n = len(starts) - width + 1
                rolled = self._roll(hashes, width)
                some = np.flatnonzero(self.maybe[(rolled >> self.shift).astype(np.int64)] & (owner[:n] == owner[width - 1 :]))
                at = np.minimum(np.searchsorted(self.hashes, rolled[some]), len(self.hashes) - 1)
                some = some[self.hashes[at] == rolled[some]]
                for i in some.tolist():
                    window = b" ".join(low[starts[j] : ends[j]].tobytes() for j in range(i, i + width))
                    items = known.get(window)
                    if items is None:
                        items = known[window] = self._items_of(window, rolled[i], width).tolist()
                    if items:
                        hit[i : i + width] = True
                        found.append((int(owner[i]), items))
        return starts, ends, owner, hit, found


def word_bounds(low: np.ndarray, is_word: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; no word goes across the start of a text."""
    n = len(low)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    cuts = text_starts[(text_starts > 0) & (text_starts < n)]
    first[cuts] |= is_word[cuts]
    last[cuts - 1] |= is_word[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def scan_texts(windows: WindowSet, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, set[int], np.ndarray]]:
    """For each text: words, items that occur, and the bytes [start, end) of each hit word."""
    overlap = (windows.widths[-1] if windows.widths else 1) - 1
    for first, last in groups(offsets, SLAB):
        if last == first + 1 and offsets[last] - offsets[first] > SLAB:
            yield _scan_long(windows, data[offsets[first] : offsets[last]], overlap)
            continue
        base = offsets[first]
        starts, ends, owner, hit, found = windows.scan(data[base : offsets[last]], offsets[first:last] - base)
        counts = np.bincount(owner, minlength=last - first)
        items: dict[int, set[int]] = {}
        for text, ids in found:
            items.setdefault(text, set()).update(ids)
        if not items:
            none = np.zeros((0, 2), np.int64)
            yield from ((int(c), set(), none) for c in counts)
            continue
        where = np.flatnonzero(hit)
        spans, of = np.stack([starts[where], ends[where]], 1) + base, owner[where]
        for k in range(last - first):
            yield int(counts[k]), items.get(k, set()), (spans[of == k] - offsets[first + k] if k in items else np.zeros((0, 2), np.int64))


def _scan_long(windows: WindowSet, data: np.ndarray, overlap: int) -> tuple[int, set[int], np.ndarray]:
    """One long text in pieces that end between words; each repeats the last words of the piece before."""
    at = seen = total = 0
    items, spans = set(), {}
    while seen < len(data):
        end = _next_gap(data, min(len(data), seen + SLAB))
        starts, ends, _, hit, found = windows.scan(data[at:end], np.zeros(1, np.int64))
        starts, ends = starts + at, ends + at
        total += int((starts >= seen).sum())
        for _, ids in found:
            items.update(ids)
        spans.update(zip(starts[hit].tolist(), ends[hit].tolist(), strict=True))
        seen = end
        at = int(starts[-min(overlap, len(starts))]) if overlap and len(starts) else end
    return total, items, np.array(sorted(spans.items()), np.int64).reshape(-1, 2)


def _next_gap(data: np.ndarray, at: int) -> int:
    """The first byte from ``at`` that belongs to no word, or the end."""
    while at < len(data):
        gap = np.flatnonzero(~IS_WORD[LOWER[data[at : at + SLAB]]])
        if len(gap):
            return at + int(gap[0])
        at += SLAB
    return len(data)


def item_pieces(words: list[bytes], window: int, most: int) -> Iterator[bytes]:
    """An item's normalised text, in pieces of about ``most`` bytes as built, which overlap by ``window - 1`` words."""
    first = 0
    while True:
        size, last = 0, first
        while last < len(words) and (size < most or last < first + window):
            size += len(words[last]) + 1 + WINDOW_BYTES
            last += 1
        yield b" ".join(words[first:last])
        if last == len(words):
            return
        first = last - window + 1


def benchmark_shards(benchmark: DataFrame, id_col: str, text_col: str, window: int, shard_bytes: int) -> Iterator[WindowSet]:
    """Sets of the benchmark's windows, each of at most about ``shard_bytes``; one empty set if there are none."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    held: list[tuple[int, bytes]] = []
    size, shards = 0, 0
    for row in items.toLocalIterator():
        words = words_of(row.text.encode("utf-8", "surrogatepass"))
        for piece in item_pieces(words, window, shard_bytes // 2) if words else ():
            mine = len(piece) + 1 + WINDOW_BYTES * (piece.count(b" ") + 1)
            if held and size + mine > shard_bytes:
                yield WindowSet(held, window)
                held, size, shards = [], 0, shards + 1
            held.append((row.item_id, piece))
            size += mine
    if held or not shards:
        yield WindowSet(held, window)


_SPAN = T.ArrayType(T.LongType(), False)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, min_share: int = 20) -> DataFrame:
    """``docs`` (its ``keep`` columns, or all) with what of the benchmark they contain.

    Added: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` (hit words are at least one
    in ``min_share``), ``hit_items`` (ids, ascending) and ``hit_spans`` (start and end byte of each hit
    word, flat, ascending).
    """
    spark = docs.sparkSession
    workers_can_import(spark)
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_items", "hit_spans", "__items", "__spans"]
    keep = [c for c in (keep or docs.columns) if c.lower() not in names]
    out = docs.select(*[docs["`" + c.replace("`", "``") + "`"] for c in keep], docs["`" + text_col.replace("`", "``") + "`"].cast("string").alias("__scan"))
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("__items", _SPAN), T.StructField("__spans", _SPAN)])
    earlier = None
    for windows in benchmark_shards(benchmark, item_id, item_text, window, shard_bytes):
        if earlier is not None:  # more than one shard: keep the hits so far beside the text
            out = materialize(out.withColumnsRenamed({"__items": "__items_0", "__spans": "__spans_0"}), "decontaminate")
        shipped = spark.sparkContext.broadcast(windows)

        def make(shipped=shipped):
            found = shipped.value

            def compute(column: pa.Array) -> list[pa.Array]:
                rows = list(scan_texts(found, *utf8(column)))
                return [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([sorted(r[1]) for r in rows], pa.list_(pa.int64())),
                    pa.array([r[2].ravel().tolist() for r in rows], pa.list_(pa.int64())),
                ]

            return compute

        out = with_columns(out, "__scan", added, make)
        if earlier is not None:
            pair = lambda c: F.transform(F.sequence(F.lit(0), (F.size(c) / 2).cast("int") - 1), lambda i: F.struct(F.get(c, i * 2).alias("a"), F.get(c, i * 2 + 1).alias("b")))
            pairs = lambda c: F.when(F.size(c) > 0, pair(F.col(c))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
            out = out.withColumns({
                "__items": F.array_sort(F.array_union("__items_0", "__items")),
                "__spans": F.flatten(F.transform(F.array_sort(F.array_union(pairs("__spans_0"), pairs("__spans"))), lambda s: F.array(s["a"], s["b"]))),
            }).drop("__items_0", "__spans_0")
        earlier = shipped
    n_hit = (F.size("__spans") / 2).cast("long")
    return out.select(
        *["`" + c.replace("`", "``") + "`" for c in keep],
        "n_words",
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("__items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (F.lit(min_share) * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("__items").alias("hit_items"),
        F.col("__spans").alias("hit_spans"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents of ``docs`` that are not contaminated, with their own columns."""
    judged = contamination(docs.withColumn("__row", F.struct(*["`" + c.replace("`", "``") + "`" for c in docs.columns])), benchmark, text_col, keep=["__row"], **options)
    return judged.where(~F.col("contaminated")).select("__row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the hit words of contaminated texts cut out (each run of hit words becomes one space)."""
    workers_can_import(docs.sparkSession)
    row = F.struct(*["`" + c.replace("`", "``") + "`" for c in docs.columns])
    judged = contamination(docs.withColumn("__row", row), benchmark, text_col, keep=["__row"], **options)
    schema = docs.schema

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, cut_spans)

    new = F.when(F.col("contaminated"), cut(F.col("__row")[text_col].cast("string"), "hit_spans")).otherwise(F.col("__row")[text_col].cast("string"))
    return judged.select(*[new.alias(f.name) if f.name == text_col else F.col("__row")[f.name].alias(f.name) for f in schema.fields])


def cut_spans(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    raw, out, at = text.encode("utf-8"), [], 0
    runs: list[list[int]] = []
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        if runs and not _word.search(raw[runs[-1][1] : start].translate(_lower)):
            runs[-1][1] = end
        else:
            runs.append([start, end])
    for start, end in runs:
        out += [raw[at:start].rstrip(), b" "]
        at = end
    return b"".join([*out, raw[at:].lstrip()]).decode("utf-8", "replace").strip()


def brute_force(text: str | None, items: dict[int, str], window: int = WINDOW) -> tuple[int, int, list[int]]:
    """(n_words, n_hit, items) of one text by comparing all windows: for tests."""
    words = words_of((text or "").encode())
    hit, found = set(), []
    for item, other in items.items():
        for w in windows_of(words_of((other or "").encode()), window):
            parts = w.split(b" ")
            at = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
            if at:
                hit.update(j for i in at for j in range(i, i + len(parts)))
                if item not in found:
                    found.append(item)
    return len(words), len(hit), sorted(found)


def items_digest(items: list[int]) -> str:
    return sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
