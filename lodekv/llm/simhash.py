"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index for the links, and their components.

1. Each text gets a 64-bit fingerprint (XXH64 of 4-word shingles). Equal fingerprints are merged first, by a
   pre-aggregated group-by, so that a group of exact copies is one row from here on.
2. Fingerprints that differ in at most k bits agree on some choice of bit blocks; they are dealt into a
   bucket for each choice. The rows of a bucket beyond ``FULL * BUCKET`` are dealt again by k + 1 runs of their other
   bits, on one of which linked ones agree, ``ROUNDS`` times at most. A bucket that is still beyond ``BUCKET`` rows is
   split by hash, and every pair of parts is a bucket of its own: nothing is dropped and no task holds more than two parts.
3. Within buckets a Gray-order hierarchical index finds the links; only a spanning tree of each bucket's
   components (with at most three edges at a node) is emitted, never all pairs.
4. Components of these trees are found by min-label rounds with hooking and shortcuts; every round is written
   to the shared folder, so that a lost executor costs one round at most.

Defined results: a null text, or one without words, has fingerprint 0 and is linked like any other; rows with a
null id are linked too, but never give their component its id (null where all ids of it are null); rows that repeat
an id are each linked by their own text; an empty table gives an empty result; texts of any length are read whole;
columns of the input may have any names, only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import discard, join_unique, materialize, workers_can_import
from .columns import utf8, with_columns
from .gray_index import GrayIndex, components, trees

SHINGLE, SEED, BITS = 4, 42, 4
#: Rows of one part of a bucket; parts beyond which a bucket is dealt again by more bits, and how often.
BUCKET, FULL, ROUNDS = 512, 10, 2
#: Comparisons that one search may hold at once.
CHUNK = 2_000_000
#: Shingles that are hashed at once.
SLAB = 200_000

_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text, unsigned."""
    plain = b" ".join(text.translate(_lower).split())  # bytes.split() cuts at 0x20 and 0x09 to 0x0D
    if not plain:
        return 0
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(plain))
    n = max(1, len(starts) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(ends) >= SHINGLE else ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, SLAB):
        spans = zip(starts[k : min(n, k + SLAB)].tolist(), last[k : k + SLAB].tolist(), strict=False)
        hashes = np.array([digest(plain[s:e], SEED) for s, e in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """``df`` (its ``keep`` columns, or all) with the fingerprint as a signed 64-bit number."""
    workers_can_import(df.sparkSession)

    def make():
        def compute(column: pa.Array) -> list[pa.Array]:
            data, offsets = utf8(column)
            raw = data.tobytes()
            marks = offsets.tolist()
            return [pa.array(np.array([fingerprint(raw[a:b]) for a, b in zip(marks, marks[1:], strict=False)], np.uint64).view(np.int64))]

        return compute

    return with_columns(df, text_col, T.StructType([T.StructField(name, T.LongType())]), make, keep)


def block_masks(most: int, blocks: int) -> list[int]:
    """Masks of ``blocks - most`` of that many blocks: two fingerprints within ``most`` bits agree on one mask."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - most)]


def masks_for(n: int, most: int) -> list[int]:
    """Few wide buckets for few fingerprints, more and narrower ones for many: about 13, 21, 27 or 32 bits."""
    extra = next((i for i, limit in enumerate((1 << 21, 1 << 28, 1 << 34)) if n <= limit), 3)
    return block_masks(most, most + 1 + extra)


def bucket_edges(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges of the components within each bucket; ``keys``: ascending bucket numbers."""
    out_a, out_b = [], []
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    work = np.cumsum(sizes.astype(np.int64) ** 2)
    first = 0
    while first < len(starts):
        base = work[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(work, base + CHUNK, "right")))
        a0, a1 = starts[first], starts[last] if last < len(starts) else len(keys)
        part, local = fps[a0:a1], keys[a0:a1]
        i, j, _ = GrayIndex(part, local).pairs(most)
        if len(i):
            child, parent = trees(components(len(part), i, j))
            out_a.append(part[child])
            out_b.append(part[parent])
        first = last
    none = np.zeros(0, np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _edges_of_sorted(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [rows.column(c).to_numpy() for c in ("m", "v", "i", "j")]
            change = np.zeros(rows.num_rows, np.bool_)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            a, b = bucket_edges(np.cumsum(change), rows.column("fp").to_numpy().view(np.uint64), most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "w"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in range(4)]
            last = np.flatnonzero(np.any([c != c[-1] for c in key], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if rest and (cut or any(rest[-1].column(c)[-1].as_py() != key[c][0] for c in range(4))):
                yield from flush(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest = []
            elif cut:
                yield from flush(pa.Table.from_batches([batch.slice(0, cut)]))
            rest.append(batch.slice(cut))
        if rest:
            yield from flush(pa.Table.from_batches(rest))

    return run


def finer(mask: int, most: int) -> list[int]:
    """``mask`` with each of ``most + 1`` runs of its other bits: of those, two fingerprints within ``most`` bits agree on one."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // (most + 1) for i in range(most + 2)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def dealt(distinct: DataFrame, n: int, most: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Rows ``m, v, i, j, fp``: the buckets (mask number, bits under it, two parts) in which each fingerprint is compared."""
    masks = masks_for(n, most)
    rows = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("m", "v"))
    done, full = [], F.coalesce("n", F.lit(1)) > bucket * FULL
    for rounds in range(ROUNDS, -1, -1):
        crowded = materialize(rows.groupBy("m", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket), "crowded")
        rows = rows.join(crowded, ["m", "v"], "left")
        again = [r["m"] for r in crowded.where(full).select("m").distinct().collect()] if rounds else []  # at most one for each mask
        if not again:
            break
        done.append(rows.where(~full))
        more = [(m, x) for m in again for x in finer(masks[m], most)]
        into = distinct.sparkSession.createDataFrame([(m, len(masks) + k, _signed(x)) for k, (m, x) in enumerate(more)], "m int, to int, mask long")
        masks += [x for _, x in more]
        rows = rows.where(full).join(F.broadcast(into), "m").select("fp", F.col("to").alias("m"), F.col("fp").bitwiseAND(F.col("mask")).alias("v"))
    rows = reduce(DataFrame.unionByName, [*done, rows])
    parts = F.ceil(F.coalesce("n", F.lit(1)) / bucket).cast("int")
    rows = rows.select("m", "v", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"))
    rows = rows.select("m", "v", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return rows.select("m", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")


def links(distinct: DataFrame, n: int, most: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, w) that connect exactly the components of ``distinct`` fingerprints (column ``fp``)."""
    shuffles = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt(distinct, n, most, bucket).repartition(shuffles, "m", "v", "i", "j").sortWithinPartitions("m", "v", "i", "j")
    return rows.mapInArrow(_edges_of_sorted(most), "u long, w long")


def connected(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Component label of every node that has an edge: ``v``, ``label`` (struct of ``rep`` and ``v``, the least of its component).

    ``nodes``: ``v`` and its ``rep`` (of any type with an order, never null). A round takes the least label of the
    neighbours, hooks it to the node that the old label points at, and then jumps from each label to that node's label.
    """
    # the trees depend on the order in which rows arrive: both directions must come from one evaluation of the edges
    edges = materialize(edges.select("u", "w"), "links")
    both = materialize(edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct(), "edges")
    discard(edges)
    touched = both.select(F.col("u").alias("v")).distinct()
    state = materialize(nodes.join(touched, "v", "left_semi").select("v", F.struct("rep", "v").alias("label")), "labels")
    for _ in range(max_rounds):
        sent = both.join(state, both.u == state.v).select(F.col("w").alias("v"), "label", F.lit(None).cast(state.schema["label"].dataType).alias("old"))
        heard = state.select("v", "label", F.col("label").alias("old")).unionByName(sent).groupBy("v").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        heard = materialize(heard, "heard")
        hook = heard.select(F.col("old.v").alias("v"), "label", F.lit(None).cast(state.schema["label"].dataType).alias("old"))
        hooked = materialize(heard.unionByName(hook).groupBy("v").agg(F.min("label").alias("label"), F.max("old").alias("old")), "hooked")
        target = hooked.select(F.col("v").alias("__t"), F.col("label").alias("__far"))
        jumped = hooked.join(target, hooked["label.v"] == target["__t"], "left")
        new = materialize(jumped.select("v", F.least("label", "__far").alias("label"), "old"), "labels")
        changed = not new.where(F.col("label") != F.col("old")).isEmpty()
        new = _without_old(new)
        for old in (heard, hooked, state):
            discard(old)
        state = new
        if not changed:
            discard(both)
            return state
    raise RuntimeError("components did not settle")


def _without_old(labels: DataFrame) -> DataFrame:
    out = labels.drop("old")
    out._lodekv_path = labels._lodekv_path
    return out


def _classes(rows: DataFrame, first: Column, most: int) -> DataFrame:
    """``fp``, ``n`` (rows that have it) and ``first`` (the least of the component's rows), one row per fingerprint of ``rows``."""
    distinct = materialize(rows.groupBy("fp").agg(F.min(first).alias("rep"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = connected(distinct.select(F.col("fp").alias("v"), "rep"), links(distinct, distinct.count(), most))
    found = distinct.join(labels.select(F.col("v").alias("fp"), F.col("label.rep").alias("__least")), "fp", "left")
    out = materialize(found.select("fp", "n", F.coalesce("__least", "rep").alias("first")), "components")
    for old in (distinct, labels):
        discard(old)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BITS) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (the smallest id reachable over links of at most ``most`` bits)."""
    rows = materialize(fingerprints(df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__t")), "__t", ["__id"]), "fingerprints")
    least = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"))
    out = join_unique(rows, _classes(rows, least, most), "fp", "n", rows.count())
    return out.select(F.col("__id").alias(id_col), "fp", F.col("first.id").alias("component_id"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BITS) -> DataFrame:
    """One row of each component: that with the smallest id, any one of them where several rows have it.

    Rows are told apart by a number of their own, so an id that occurs with different texts loses none of them, and
    of rows without an id one stays where no row of their component has one.
    """
    row = F.struct(*["`" + c.replace("`", "``") + "`" for c in df.columns])
    coded = fingerprints(df.select(row.alias("__row"), df[id_col].cast("long").alias("__id"), df[text_col].cast("string").alias("__t")), "__t", ["__row", "__id"])
    coded = materialize(coded.withColumn("__n", F.monotonically_increasing_id()), "coded")
    least = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__n").alias("n"))
    kept = _classes(coded.select("fp", "__id", "__n"), least, most).select(F.col("first.n").alias("__n")).distinct()
    return coded.join(kept, "__n", "left_semi").select("__row.*")
