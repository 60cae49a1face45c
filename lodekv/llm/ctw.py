"""Language-model scores by context-tree weighting over byte contexts.

A text is coded as its words (A-Z lower-cased, cut at white space) with one space between them and a line feed as
its end; so the model gives a probability to every sequence of words. Each byte is decomposed into eight binary
decisions. The decision after some leading bits has a context tree of its own over the ``DEPTH`` bytes before;
every node holds a Krichevsky-Trofimov estimate, and a node's weighted probability is half its own estimate
plus half the product of its children's. The prediction mixes the estimates at all depths along the path by the
posterior weights that follow from the training counts. Nodes that no training text has reached stand aside.

Training counts cover the whole corpus: workers count (DEPTH + 1)-byte grams and words of their texts, Spark sums
them by key. Nodes are exact, each under its own (depth, context, leading bits). The grams are dealt into parts by the
last ``DEEP`` context bytes, so that a part has the whole subtrees of its contexts; their number grows with the
corpus. Above them are nodes of fewer context bytes, which number less than 2 ** (8 * DEEP) at any scale; they are
broadcast. Blocks of texts ask every part for the values of their distinct grams and sum the answers, so that no
worker holds more than one part and one block. The base score is a unigram model over words: the most frequent
words (at most ``FREQUENT``, by count) are broadcast with their counts, all others are joined by shuffle.

Defined results: a null text is empty and has the end token alone; rows that repeat stay, and each counts in training;
without any training text all counts are 0 and each byte costs eight bits; an empty table gives no rows; texts of any length are
read whole, in pieces; rows whose ``train`` condition is null are held out; only the id, the text and the columns of
``train`` are read, so other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import materialize, workers_can_import
from .columns import utf8

DEPTH = 5
#: Contexts of so many bytes or more are dealt into parts.
DEEP = 3
#: Distinct training grams of a part; bytes of all texts for each part.
PART_GRAMS, PART_BYTES = 400_000, 32 << 20
FREQUENT = 300_000
#: Bytes that are coded at once; distinct grams and words that a worker counts before it passes them on.
SLAB, GRAMS, WORDS = 1 << 20, 2_500_000, 200_000
#: Bytes of the texts that ask for values together, and slots for finding grams that repeat within a slab.
BLOCK, REPEATS = 16 << 20, 1 << 20
#: Rows whose texts become Python objects at once.
ROWS = 1024
REMEMBERED = 1 << 21
END = b"\n"

_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_lower).split()  # cuts at 0x20 and 0x09 to 0x0D


def grams_of(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram that ends at each byte, number of its stream); a stream's context is line feeds."""
    pad = END * DEPTH
    data = np.frombuffer(b"".join(x for s in streams for x in (pad, s)), np.uint8)
    lengths = np.array([len(s) for s in streams], np.int64)
    real = np.ones(len(data), np.bool_)
    real[((np.cumsum(lengths + DEPTH) - lengths - DEPTH)[:, None] + np.arange(DEPTH)).ravel()] = False
    gram = np.zeros(len(data), np.uint64)
    for back in range(DEPTH, -1, -1):
        gram <<= np.uint64(8)
        gram[DEPTH:] |= data[DEPTH - back : len(data) - back]
    return gram[real], np.repeat(np.arange(len(streams)), lengths)


def slabs(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], int]]:
    """(text numbers, streams, bytes of context at the head of the first stream), about ``SLAB`` bytes each."""
    owners, streams, size = [], [], 0
    for k, stream in enumerate(texts):
        if len(stream) > SLAB:
            for at in range(0, len(stream), SLAB):
                head = min(at, DEPTH)
                yield [k], [stream[at - head : at + SLAB]], head
            continue
        owners.append(k)
        streams.append(stream)
        size += len(stream)
        if size > SLAB:
            yield owners, streams, 0
            owners, streams, size = [], [], 0
    if owners:
        yield owners, streams, 0


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts


def count_corpus(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` or ``gram`` and its count ``n`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def pass_on(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "gram", "n"])

        def pass_words() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["word", "gram", "n"])
            words.clear()
            return out

        for batch in sliced(batches):
            data, offsets = utf8(batch.column(0))
            raw, marks = data.tobytes(), offsets.tolist()
            streams = []
            for a, b in zip(marks, marks[1:], strict=False):
                mine = words_of(raw[a:b])
                words.update(mine)
                streams.append(b" ".join(mine) + END)
                if len(words) > WORDS:
                    yield pass_words()
            words[END] += len(streams)
            for _, some, head in slabs(streams):
                gram, _ = grams_of(some)
                keys, counts = count_grams(gram[head:])
                parts.append((keys, counts.astype(np.int32)))
                held += len(keys)
                if held > GRAMS:
                    parts = [merge_counts(parts)]
                    held = len(parts[0][0])
                    if held > GRAMS // 2:
                        for k in range(0, held, 500_000):
                            yield pass_on(parts[0][0][k : k + 500_000], parts[0][1][k : k + 500_000])
                        parts, held = [], 0
        if parts:
            keys, counts = merge_counts(parts)
            for k in range(0, len(keys), 500_000):
                yield pass_on(keys[k : k + 500_000], counts[k : k + 500_000])
        if words:
            yield pass_words()

    source = texts.select(F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def node_keys(gram: np.ndarray, depth: int, prefix: np.ndarray) -> np.ndarray:
    """The key of the node with the last ``depth`` context bytes and the leading bits ``prefix`` (with a 1 before)."""
    return (gram & np.uint64((1 << 8 * depth + 8) - 256)) | prefix


def bits_of(gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(leading bits, next bit) of each gram's last byte, for its eight decisions."""
    symbol = gram & np.uint64(255)
    for i in range(8):
        yield (np.uint64(1 << i) | (symbol >> np.uint64(8 - i))), ((symbol >> np.uint64(7 - i)) & np.uint64(1)).astype(np.int64)


class NodeCounts:
    """Distinct grams, which are the deepest nodes with the next byte, and their counts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, gram: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((gram, n))

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(grams in order, counts)."""
        if self.parts:
            yield merge_counts(self.parts)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x > 0: Stirling's series after a shift."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift += np.where(small, np.log(np.where(small, y, 1.0)), 0.0)
        y = np.where(small, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


class NodeTable(NodeCounts):
    """The grams of all texts, or of one part."""

    def put(self, gram: np.ndarray, n: np.ndarray) -> None:
        self.add(gram, n)

    def leaves(self, bits: list[int]) -> "Nodes":
        """The nodes of ``DEPTH`` context bytes for the decisions after so many leading bits."""
        for gram, n in self.rows():
            decisions = list(bits_of(gram))
            keys = np.concatenate([node_keys(gram, DEPTH, decisions[k][0]) for k in bits])
            ones = np.concatenate([n * decisions[k][1] for k in bits])
            return summed(keys, np.tile(n, len(bits)) - ones, ones, np.zeros(len(keys)))
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0)


#: Keys in order, zeros, ones, and the sum of the children's weighted log-probabilities.
Nodes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: By depth: keys in order, the KT probability of a one, and the weight of the node's own estimate.
Levels = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def summed(keys: np.ndarray, *values: np.ndarray) -> Nodes:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order].astype(np.float64), first) if len(first) else np.zeros(0) for v in values)


def climb(nodes: Nodes, depth: int, least: int) -> tuple[Levels, Nodes]:
    """The levels from ``depth`` up to ``least``, and the nodes of the level above."""
    levels = {}
    for d in range(depth, least - 1, -1):
        keys, a, b, below = nodes
        own = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)
        if d == DEPTH:
            weight, weighted = np.ones(len(keys)), own
        else:
            weight = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
            weighted = np.logaddexp(own, below) - np.log(2)
        levels[d] = keys, (b + 0.5) / (a + b + 1), weight
        if d:
            nodes = summed(node_keys(keys, d - 1, keys & np.uint64(255)), a, b, weighted)
    return levels, nodes


def mix(levels: Levels, gram: np.ndarray, prefix: np.ndarray, p: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of a one, whether a node was found) after the levels, deepest first, from that of the levels below."""
    for depth in sorted(levels, reverse=True):
        keys, ones, weight = levels[depth]
        if not len(keys):
            continue
        wanted = node_keys(gram, depth, prefix)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        seen = keys[at] == wanted
        p = np.where(seen, np.where(has, weight[at] * ones[at] + (1 - weight[at]) * p, ones[at]), p)
        has = has | seen
    return p, has


class ContextTrees:
    """The trees of a table of grams as a whole."""

    def __init__(self, nodes: NodeTable):
        self.levels, _ = climb(nodes.leaves(list(range(8))), DEPTH, 0)

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """Log10 of the probability of each gram's last byte after the bytes before it."""
        total = np.zeros(len(gram))
        for prefix, bit in bits_of(gram):
            p, _ = mix(self.levels, gram, prefix, np.full(len(gram), 0.5), np.zeros(len(gram), np.bool_))
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return total


def part_of(gram: np.ndarray, parts: int) -> np.ndarray:
    """The part of each gram, by its last ``DEEP`` context bytes; the same as :func:`part_column`."""
    context = (gram >> np.uint64(8)) & np.uint64((1 << 8 * DEEP) - 1)
    return ((context * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(parts)).astype(np.int32)


def split_by_part(gram: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part numbers that occur, order of the grams by part, where each part begins in it, and the end)."""
    part = part_of(gram, parts)
    order = np.argsort(part, kind="stable")
    sorted_ = part[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(gram) else np.zeros(0, np.int64)
    return sorted_[first], order, np.append(first, len(gram))


def part_column(parts: int) -> Column:
    return F.expr(f"cast((shiftrightunsigned((shiftrightunsigned(gram, 8) & {(1 << 8 * DEEP) - 1}) * 2654435761L, 16)) % {parts} as int)")


def _table(rows: pa.Table) -> NodeTable:
    table = NodeTable()
    table.put(rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy())
    return table


def fit_top(grams: DataFrame) -> Levels:
    """The levels of less than ``DEEP`` context bytes, of a table of gram counts (columns ``part``, ``gram``, ``n``)."""

    def subtrees(rows: pa.Table) -> pa.Table:
        table = _table(rows)
        tops = [climb(table.leaves([k]), DEPTH, DEEP)[1] for k in range(8)]
        columns = [np.concatenate(x) for x in zip(*tops, strict=True)]
        return pa.table([columns[0].view(np.int64), *columns[1:]], names=["node", "n0", "n1", "below"])

    parts = grams.groupBy("part").applyInArrow(subtrees, "node long, n0 double, n1 double, below double")
    nodes = parts.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below"))).toArrow()  # less than 2 ** (8 * DEEP) rows
    keys = nodes.column("node").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return climb((keys[order], *(nodes.column(c).to_numpy()[order] for c in ("n0", "n1", "below"))), DEEP - 1, 0)[0]


def repeats(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position that stands for each gram, whether it has the same gram); without sorting, where no slot is shared."""
    slot = ((gram * _A) >> np.uint64(64 - REPEATS.bit_length() + 1)).astype(np.int64)
    table = np.zeros(REPEATS, np.int32)
    table[slot] = np.arange(len(gram), dtype=np.int32)
    stands = table[slot]
    return stands, gram[stands] == gram


def count_grams(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``np.unique(gram, return_counts=True)``."""
    stands, same = repeats(gram)
    n = np.bincount(stands[same], minlength=len(gram))
    first = np.flatnonzero(n)
    rest, more = np.unique(gram[~same], return_counts=True)
    keys = np.concatenate([gram[first], rest])
    order = np.argsort(keys)
    return keys[order], np.concatenate([n[first], more])[order]


def distinct_grams(streams: list[bytes]) -> np.ndarray:
    held = NodeCounts()
    for _, some, head in slabs(streams):
        held.add(*count_grams(grams_of(some)[0][head:]))
        if len(held.parts) > 16:
            held.parts = list(held.rows())
    return next(held.rows())[0]


def pack_grams(gram: np.ndarray) -> bytes:
    """Byte planes, which a shuffle's compression shrinks; the two leading bytes are 0."""
    return gram.view(np.uint8).reshape(-1, 8)[:, : DEPTH + 1].T.tobytes()


def unpack_grams(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(DEPTH + 1, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : DEPTH + 1] = planes.T
    return out.view(np.uint64).ravel()


def looked_up(gram: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of grams that are all among ``keys``."""
    stands, same = repeats(gram)
    held = np.zeros(len(gram), values.dtype)
    first = np.flatnonzero(np.bincount(stands[same], minlength=len(gram)))
    held[first] = values[np.searchsorted(keys, gram[first])]
    out = held[stands]
    out[~same] = values[np.searchsorted(keys, gram[~same])]
    return out


def score_streams(streams: list[bytes], log10) -> np.ndarray:
    out = np.zeros(len(streams))
    for owners, some, head in slabs(streams):
        gram, owner = grams_of(some)
        out[owners] += np.bincount(owner[head:], log10(gram[head:]), len(some))
    return out


def answers(grams: DataFrame, asked: DataFrame, top: Levels) -> DataFrame:
    """``block``, ``part``, ``packed``: the log10 values of the grams that a block asks a part for, in their order."""
    sent = grams.sparkSession.sparkContext.broadcast(top)

    def answer(rows: pa.Table, asks: pa.Table) -> pa.Table:
        table, lists = _table(rows), [unpack_grams(x.as_py()) for x in asks.column("packed")]
        wanted = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
        total = np.zeros(len(wanted))
        for k, (prefix, bit) in enumerate(bits_of(wanted)):
            p, has = mix(climb(table.leaves([k]), DEPTH, DEEP)[0], wanted, prefix, np.full(len(wanted), 0.5), np.zeros(len(wanted), np.bool_))
            p, _ = mix(sent.value, wanted, prefix, p, has)
            total += np.log10(np.where(bit == 1, p, 1 - p))
        values = total.astype(np.float32)
        packed = [values[np.searchsorted(wanted, x)].tobytes() for x in lists]
        return pa.table([asks.column("block"), asks.column("part"), pa.array(packed, pa.binary())], names=["block", "part", "packed"])

    return grams.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(answer, "block long, part int, packed binary")


class Scorer:
    """Log10 probabilities of texts by trees that are held as a whole, with a fixed-size memory of grams."""

    def __init__(self, trees: ContextTrees, frequent: dict[bytes, float]):
        self.trees, self.frequent = trees, frequent
        self.keys = np.full(REMEMBERED, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(REMEMBERED, np.float32)
        self.shift = np.uint64(64 - REMEMBERED.bit_length() + 1)

    def log10(self, gram: np.ndarray) -> np.ndarray:
        slot = ((gram * _A) >> self.shift).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != gram)
        if len(missing):
            unique, first = np.unique(gram[missing], return_index=True)
            computed = self.trees.log10(unique)
            self.keys[slot[missing[first]]] = unique
            self.values[slot[missing[first]]] = computed
            out = self.values[slot]
            wrong = np.flatnonzero(self.keys[slot] != gram)  # shared slots
            if len(wrong):
                again, where = np.unique(gram[wrong], return_inverse=True)
                out[wrong] = self.trees.log10(again)[where]
            return out
        return self.values[slot]

    def score(self, streams: list[bytes]) -> np.ndarray:
        return score_streams(streams, self.log10)


def _frequent(words: DataFrame, most: int) -> int:
    """The least count above which there are at most ``most`` words."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    floor_, held = 0, 0
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 8 * 63 rows
        held += r["count"]
        if held > most:
            return floor_ or (1 << 62)
        floor_ = int(np.ceil(2 ** (r["step"] / 8)))
    return 0


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    ``train``: condition of the rows to learn from.
    """
    spark = docs.sparkSession
    workers_can_import(spark)
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].cast("string").alias("__t"), F.coalesce(train, F.lit(False)).alias("__train"))
    counts = materialize(count_corpus(rows.where("__train"), "__t"), "counts")
    words = counts.where("word IS NOT NULL").select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = _frequent(words, frequent)
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    common: dict[bytes, float] = {}
    if total:
        known = words.where(F.col("n") >= least).toArrow()  # at most ``frequent`` rows
        common = dict(zip(known.column("word").to_pylist(), (np.log10(known.column("n").to_numpy() + 0.5) - norm).tolist(), strict=True))
    end_known = bool(total)
    distinct_trained = counts.where("gram IS NOT NULL").count()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("__t")), F.lit(0))).first()[0]
    parts = 1 + max(distinct_trained // PART_GRAMS, size // PART_BYTES)
    grams = counts.where("gram IS NOT NULL").select(part_column(parts).alias("part"), "gram", "n")
    shipped = spark.sparkContext.broadcast(common)
    end_score = common.get(END)
    if end_score is None:
        end_n = words.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        end_score = float(np.log10(end_n + 0.5)) - norm
    id_type = rows.schema["__id"].dataType
    kept = [
        T.StructField("__id", id_type), T.StructField("__train", T.BooleanType()), T.StructField("uid", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_common", T.LongType()), T.StructField("base", T.DoubleType()),
    ]
    schema = T.StructType([*kept, T.StructField("stream", T.BinaryType()), T.StructField("rare", T.MapType(T.BinaryType(), T.LongType())), T.StructField("block", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("packed", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shipped.value.get
        uid = block = TaskContext.get().partitionId() << 40
        waiting: list[bytes] = []
        held = 0

        def ask() -> pa.RecordBatch:
            gram = distinct_grams(waiting)
            found, order, first = split_by_part(gram, parts)
            gram = gram[order]
            lists = pa.array([pack_grams(gram[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            columns = {"block": pa.array([block] * len(found), pa.int64()), "part": pa.array(found, pa.int32()), "packed": lists}
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(len(found), f.type) for f in arrow], schema=arrow)

        for batch in sliced(batches):
            data, offsets = utf8(batch.column(1))
            raw, marks = data.tobytes(), offsets.tolist()
            at = 0
            while at < batch.num_rows:
                first, streams, n, n_common, base, rare = at, [], [], [], [], []
                while at < batch.num_rows and held < BLOCK:
                    mine = words_of(raw[marks[at] : marks[at + 1]])
                    found = list(map(get, mine))
                    known = [x for x in found if x is not None]
                    streams.append(b" ".join(mine) + END)
                    held += len(streams[-1])
                    n.append(len(mine) + 1)
                    n_common.append(len(known) + end_known)
                    base.append(sum(known) + end_score)
                    rare.append(list(Counter([w for w, x in zip(mine, found, strict=True) if x is None]).items()) if len(known) < len(mine) else [])
                    at += 1
                size = at - first
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:at], batch.column(2)[first:at], pa.array(range(uid, uid + size), pa.int64()), pa.array(n, pa.int64()), pa.array(n_common, pa.int64()), pa.array(base, pa.float64()),
                     pa.array(streams, pa.binary()), pa.array(rare, pa.map_(pa.binary(), pa.int64())), pa.array([block] * size, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())],
                    names=schema.names,
                )
                uid += size
                waiting += streams
                if held >= BLOCK:
                    yield ask()
                    block += 1
                    waiting, held = [], 0
        if waiting:
            yield ask()

    coded = materialize(rows.select("__id", "__t", "__train").mapInArrow(run, schema), "coded")
    texts = coded.where("uid IS NOT NULL")
    asked = coded.where("uid IS NULL").select("block", "part", "packed")

    def finish(mine: pa.Table, values: pa.Table) -> pa.Table:
        mine = mine.combine_chunks()
        streams = mine.column("stream").to_pylist()
        gram = distinct_grams(streams)
        found, order, first = split_by_part(gram, parts)
        value, at = np.zeros(len(gram), np.float32), {int(x): k for k, x in enumerate(found)}
        for x, packed in zip(values.column("part").to_pylist(), values.column("packed").to_pylist(), strict=True):
            value[order[first[at[x]] : first[at[x] + 1]]] = np.frombuffer(packed, np.float32)
        score = score_streams(streams, lambda g: looked_up(g, gram, value))
        return mine.select([f.name for f in kept]).append_column("score", pa.array(score, pa.float64()))

    told = answers(grams, asked, fit_top(grams))
    columns = [f.name for f in kept]
    scored = texts.select(*columns, "stream", "block").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, T.StructType([*kept, T.StructField("score", T.DoubleType())]))
    seldom = texts.select("uid", F.explode("rare").alias("word", "k"))
    joined = seldom.join(words.where(F.col("n") < least), "word", "left") if least else seldom.withColumn("n", F.lit(None).cast("long"))
    count = F.coalesce("n", F.lit(0))
    rest = joined.groupBy("uid").agg(F.sum(F.col("k") * (F.log10(count + 0.5) - norm)).alias("more"), F.sum(F.when(count > 0, F.col("k")).otherwise(0)).alias("known"))
    out = scored.join(rest, "uid", "left")
    return out.select(
        F.col("__id").alias(id_col), (~F.col("__train")).alias("held_out"), "n_tokens", (F.col("n_common") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
