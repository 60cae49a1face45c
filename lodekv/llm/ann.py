"""Approximate nearest neighbours by learned partitions, largest inner product first.

Fit, on a bounded sample of vectors (``SAMPLE``): the neighbour graph of the sample is cut into balanced parts (balanced
assignment refined by moving vertices to the part of most of their neighbours, under a size limit), and a small
softmax classifier learns each vector's distribution of its neighbours' parts. The model is a few matrices of
bounded size and is broadcast.

Index: every vector goes to its most probable part. Search: a query goes to the most probable parts until their
probabilities sum to a mass (at least ``MIN_PROBES`` of them), and its candidates there are reranked by exact
double-precision inner products. The mass is the least that reaches ``TARGET_RECALL`` on vectors of the sample
that were held back from the fit. Parts larger than the average are split into blocks by hash (at most ``BLOCK_BYTES`` of candidates), and
the queries that were counted for a part too (at most about ``QUERY_BYTES`` in a block); so a part that holds a third of
all rows is many tasks. Vectors travel in the precision they are stored in. Each block passes on its best k candidates
for each query, ties broken by the smaller id, and a query's candidates are merged by a window over at most k rows of each block.
Where vectors have no cluster structure, a high recall needs most parts, and the work is that share of all pairs.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part; rows that repeat an id and vector count once; of one id with several vectors each is a
candidate, and the first in the vectors' order is the query; a query is never its own neighbour; with fewer than k candidates in the
probed parts the query goes to all parts; inner products that overflow keep their IEEE value, and those that are not a
number come last; columns of the input may have any names, only the two named are read. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..runtime import materialize, workers_can_import

#: Vectors of the sample that the partitions are learned from, and neighbours in their graph.
SAMPLE, GRAPH_NEIGHBOURS = 8000, 10
#: Parts: ``PARTS``, more (a 32nd of the root of the rows) from a million rows on, fewer for tiny tables.
PARTS, MAX_PARTS = 32, 256
MIN_PROBES = 3
#: Recall that the probability mass is chosen for, on this many vectors of the sample that the model has not seen.
TARGET_RECALL, HELD_BACK = 0.94, 500
#: Candidates of a block: a quarter more than those of an average part, within these bounds (rows, bytes). Queries of a block, about, or their bytes.
MIN_BLOCK, BLOCK_BYTES, MIN_QUERIES, QUERY_BYTES = 512, 32 << 20, 256, 8 << 20
#: Inner products that are held at once.
PRODUCTS = 2 << 20
HIDDEN, EPOCHS = 96, 30


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest inner products of each row among the others, in blocks of rows."""
    n = len(x)
    k = min(k, n - 1)
    out = np.zeros((n, k), np.int64)
    for at in range(0, n, 1024):
        scores = x[at : at + 1024] @ x.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        out[at : at + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k else out[at : at + 1024]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A balanced partition of the neighbour graph: seeded by balanced k-means, refined by neighbours' votes."""
    n, limit = len(x), int(np.ceil(len(x) / parts * slack))
    centers = x[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, np.int64)
    for _ in range(8):
        label = _fill(x @ unit(centers).T, limit)
        for p in range(parts):
            if (mine := label == p).any():
                centers[p] = x[mine].mean(0)
    source = np.repeat(np.arange(n), graph.shape[1])
    target = graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (source, label[target]), 1)
        np.add.at(votes, (target, label[source]), 1)
        votes[np.arange(n), label] += 0.5
        new = _fill(votes + 0.01 * (x @ unit(centers).T), limit)
        if (new == label).mean() > 0.999:
            break
        label = new
    return label


def _fill(preference: np.ndarray, limit: int) -> np.ndarray:
    """Each row to its preferred part; rows beyond a part's limit, the least decided first, go to their next one."""
    n, parts = preference.shape
    order = np.argsort(-preference, axis=1, kind="stable")
    label = np.full(n, -1)
    room = np.full(parts, limit)
    choice = np.zeros(n, np.int64)
    todo = np.arange(n)
    while len(todo):
        want = order[todo, choice[todo]]
        strength = preference[todo, want]
        by = np.lexsort((-strength, want))
        first = np.searchsorted(want[by], np.arange(parts))
        rank = np.arange(len(by)) - first[want[by]]
        accepted = by[rank < room[want[by]]]
        label[todo[accepted]] = want[accepted]
        room -= np.bincount(want[accepted], minlength=parts)
        todo = todo[label[todo] < 0]
        choice[todo] += 1
    return label


class Router:
    """A softmax classifier with one hidden layer over the parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator):
        d, parts = x.shape[1], target.shape[1]
        self.scale = float(np.abs(x).std()) or 1.0
        self.a = rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN))
        self.b = rng.normal(0, 1 / np.sqrt(HIDDEN + d), (HIDDEN + d, parts))
        self.bias = np.zeros(parts)
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (self.a, self.b, self.bias)]
        step = 0
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                xs = x[at] / self.scale
                h = np.maximum(xs @ self.a, 0)
                both = np.concatenate([h, xs], 1)
                delta = (_softmax(both @ self.b + self.bias) - target[at]) / len(at)
                grads = [xs.T @ ((delta @ self.b[:HIDDEN].T) * (h > 0)), both.T @ delta, delta.sum(0)]
                step += 1
                for w, g, m in zip((self.a, self.b, self.bias), grads, moments, strict=True):
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    w -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        xs = x / self.scale
        return _softmax(np.concatenate([np.maximum(xs @ self.a, 0), xs], 1) @ self.b + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Partitions:
    """The learned partition: fit on a sample, then a map from vectors to parts."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        distinct = np.unique(sample, axis=0)  # copies would fill parts with one point
        self.parts = int(min(MAX_PARTS, max(PARTS, np.sqrt(rows) / 32), max(1, len(distinct) // 64)))
        self.router, self.mass = None, 1.0
        if self.parts < 2:
            self.parts = 1
            return
        distinct = distinct[rng.permutation(len(distinct))]
        back = min(HELD_BACK, len(distinct) // 10)
        held, seen = distinct[:back], distinct[back:]
        graph = neighbour_graph(seen, GRAPH_NEIGHBOURS)
        label = balanced_parts(unit(seen), graph, self.parts, rng)
        target = np.zeros((len(seen), self.parts))
        for k in range(graph.shape[1]):
            np.add.at(target, (np.arange(len(seen)), label[graph[:, k]]), 1.0)
        target[np.arange(len(seen)), label] += 1.0
        self.router = Router(seen, target / target.sum(1, keepdims=True), rng)
        self._choose_mass(held, seen)

    def _choose_mass(self, held: np.ndarray, seen: np.ndarray) -> None:
        """The least mass that finds enough of the held-back vectors' neighbours."""
        if not len(held):
            return
        label, scores = self.assign(seen), held @ seen.T
        k = min(2 * GRAPH_NEIGHBOURS, len(seen))
        truth = label[np.argpartition(-scores, k - 1, axis=1)[:, :k]]
        sizes = np.bincount(label, minlength=self.parts)
        for mass in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99, 0.995):
            row, part = self.probes(held, mass, MIN_PROBES, sizes, k)
            probed = np.zeros((len(held), self.parts), np.bool_)
            probed[row, part] = True
            if probed[np.arange(len(held))[:, None], truth].mean() >= TARGET_RECALL:
                self.mass = mass
                return

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.ones((len(x), 1)) if self.router is None else self.router.probabilities(x)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(1)

    def probes(self, x: np.ndarray, mass: float, least: int, sizes: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, part): the most probable parts of each query, with at least ``enough`` candidates or all parts."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1)
        sorted_p = np.take_along_axis(p, order, 1)
        before = np.cumsum(sorted_p, 1) - sorted_p
        held = np.cumsum(sizes[order], 1) - sizes[order]
        take = (before < mass) | (np.arange(self.parts) < least) | (held < enough)
        rows, columns = np.nonzero(take)
        return rows, order[rows, columns]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v`` (floats as they are, else doubles) of the rows that take part, each once."""
    v = F.col("`" + vector_col + "`")
    kind = df.select(v.alias("v")).schema["v"].dataType
    v = v if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else v.cast("array<double>")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col("`" + id_col + "`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(fine)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def top(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (position, ids, scores) of its best k candidates; exact scores, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    with np.errstate(over="ignore", invalid="ignore"):
        largest = np.linalg.norm(x, axis=1).max(initial=0)
        step = max(1, PRODUCTS // max(1, len(x)))
        for at in range(0, len(queries), step):
            part = queries[at : at + step]
            own = ids[None, :] == query_ids[at : at + step, None]
            rough = part @ x.T
            rough[own | np.isnan(rough)] = -np.inf
            floor = np.full(len(part), -np.inf)
            if len(ids) > k:
                margin = 1e-12 * np.linalg.norm(part, axis=1) * largest
                floor = np.where(np.isfinite(margin), -np.partition(-rough, k - 1, axis=1)[:, k - 1] - margin, -np.inf)
            for i in range(len(part)):
                near = np.flatnonzero((rough[i] >= floor[i]) & ~own[i])
                scores = (x[near] * part[i]).sum(axis=1)  # the same order of additions for every candidate
                best = np.lexsort((ids[near], np.where(np.isnan(scores), np.inf, -scores)))[:k]
                yield at + i, ids[near[best]], scores[best]


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, mass: float | None = None, min_probes: int = MIN_PROBES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest found of every row that ``is_query`` selects.

    ``is_query`` is a condition on ``vec_id``. ``mass`` (default: as fitted) and ``min_probes`` trade time for recall.
    """
    spark = df.sparkSession
    workers_can_import(spark)
    rows = materialize(usable(df, id_col, vector_col).dropDuplicates(), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, SAMPLE / n)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(2 * SAMPLE).toArrow()
    model = Partitions(_matrix(drawn.column(0)), n)
    mass = model.mass if mass is None else mass
    shipped = spark.sparkContext.broadcast(model)

    kind = rows.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = shipped.value.assign(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["vec_id", "v", "part"])

    placed = materialize(rows.select("vec_id", "v").mapInArrow(place, f"vec_id long, v {kind}, part int"), "placed")
    sizes = _by_part(placed.groupBy("part").count(), model.parts)
    copies = rows.groupBy("vec_id").count().agg(F.max("count")).first()[0]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, part = shipped.value.probes(_matrix(batch.column(1)), mass, min_probes, sizes, k + copies)
                some = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(part.astype(np.int32))], names=["vec_id", "v", "part"])

    def count_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(model_parts, np.int64)
        for some in route(batches):
            total += np.bincount(some.column(2).to_numpy(), minlength=model_parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(model_parts, dtype=np.int32)), pa.array(total)], names=["part", "n"])

    model_parts = model.parts
    queries = materialize(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    asked = _by_part(queries.mapInArrow(count_routes, "part int, n long").groupBy("part").agg(F.sum("n").alias("count")), model.parts)
    width = rows.select(F.size("v")).first()[0]
    block = int(np.clip(1.25 * n / model.parts, MIN_BLOCK, max(MIN_BLOCK, BLOCK_BYTES // (8 * width))))
    return _search_blocks(placed, queries.mapInArrow(route, f"vec_id long, v {kind}, part int"), sizes, asked, block, max(MIN_QUERIES, QUERY_BYTES // (8 * width)), k)


def _by_part(counts: DataFrame, parts: int) -> np.ndarray:
    out = np.zeros(parts, np.int64)
    for r in counts.collect():  # at most MAX_PARTS rows
        out[r["part"]] = r["count"]
    return out


def _search_blocks(placed: DataFrame, routed: DataFrame, sizes: np.ndarray, asked: np.ndarray, block: int, query_block: int, k: int) -> DataFrame:
    """Every routed query against every block of its part; the best k of all. ``sizes``, ``asked``: rows and queries of each part."""
    of_part = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("part") + 1)
    blocks = of_part(np.maximum(1, -(-sizes // block)))
    query_blocks = of_part(np.maximum(1, -(-asked // query_block)))
    wide = placed.select("part", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), query_blocks - 1)).alias("query_block"), "vec_id", "v")
    questions = routed.select("part", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(3)), query_blocks).cast("int").alias("query_block"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    schema = "query_id long, vec_id long, score double"

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            x, ids = _matrix(left.column("v")), left.column("vec_id").to_numpy()
            q, query_ids = _matrix(right.column("q")), right.column("query_id").to_numpy()
            for i, found, scores in top(q, query_ids, x, ids, k):
                out[0].append(np.full(len(found), query_ids[i]))
                out[1].append(found)
                out[2].append(scores)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table([pa.array(c, t) for c, t in zip((columns[0].astype(np.int64), columns[1].astype(np.int64), columns[2]), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    keys = ["part", "block", "query_block"]
    found = wide.groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInArrow(nearest, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
