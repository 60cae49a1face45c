"""Consistent-hash placement: arcs of virtual nodes, owners, replicas, rebalance plans.

The ring is metadata of a few dozen numbers per node, so its arcs are made on the driver. Keys are placed by a
broadcast hash join: an arc is listed under every value of the hash's leading byte that it touches, so
a key meets one or two arcs and not all of them.
"""

from __future__ import annotations

from bisect import bisect_left
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import crc

VNODES, REPLICAS = 50, 2
#: Arcs that are broadcast by a hint; a larger ring is left to the optimizer's own size check.
MAX_BROADCAST_ARCS = 200_000
#: Nodes of a ring at most.
MAX_NODES = 10_000
_TOP = (1 << 32) - 1


def members(log: DataFrame) -> DataFrame:
    """``node`` of the live members by a log ``seq, node, op``: those whose newest operation is ``JOIN``."""
    newest = log.groupBy("node").agg(F.max_by("op", "seq").alias("op"))
    return newest.where("op = 'JOIN'").select("node")


class Ring:
    def __init__(self, nodes: list[str], vnodes: int = VNODES):
        self.nodes = list(dict.fromkeys(nodes))
        self.owner = {crc32(f"{n}#{i}".encode()): n for n in self.nodes for i in range(vnodes)}  # a later node takes a shared hash
        self.hashes = sorted(self.owner)

    @classmethod
    def of(cls, members: DataFrame, vnodes: int = VNODES) -> "Ring":
        """The ring of the ``node`` names of a table of members; a ring is metadata, so their number is checked."""
        names = [r["node"] for r in members.select("node").where("node IS NOT NULL").distinct().orderBy("node").limit(MAX_NODES + 1).collect()]
        if len(names) > MAX_NODES:
            raise ValueError(f"more than {MAX_NODES} nodes")
        return cls(names, vnodes)

    def at(self, i: int) -> str:
        return self.owner[self.hashes[i % len(self.hashes)]]

    def walk(self, i: int, count: int) -> list[str]:
        """The first ``count`` different nodes clockwise from the i-th virtual node."""
        found: dict[str, None] = {}
        for k in range(len(self.hashes)):
            found.setdefault(self.at(i + k))
            if len(found) == count:
                break
        return list(found)

    def node_of(self, key: str) -> str | None:
        return self.at(bisect_left(self.hashes, crc32(key.encode()))) if self.hashes else None

    def arcs(self, count: int = REPLICAS) -> list[tuple[int, int, str, list[str]]]:
        """(lo, hi, node, replicas): every hash lies in exactly one arc; the last one wraps to the first node."""
        out, lo = [], 0
        for i, hi in enumerate(self.hashes):
            if lo <= hi:
                out.append((lo, hi, self.at(i), self.walk(i, count)))
            lo = hi + 1
        if self.hashes and lo <= _TOP:
            out.append((lo, _TOP, self.at(0), self.walk(0, count)))
        return out

    def vnodes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(h, self.owner[h]) for h in self.hashes], "vnode_hash long, node string")


def place(keys: DataFrame, ring: Ring, count: int = REPLICAS) -> DataFrame:
    """``keys`` with the ``node`` that owns each key and its ``replicas``."""
    arcs = ring.arcs(count)
    listed = [(b, lo, hi, node, replicas) for lo, hi, node, replicas in arcs for b in range(lo >> 24, (hi >> 24) + 1)]
    table = keys.sparkSession.createDataFrame(listed, "__b int, __lo long, __hi long, node string, replicas array<string>")
    table = F.broadcast(table) if len(listed) <= MAX_BROADCAST_ARCS else table
    h = crc("key")
    hashed = keys.withColumns({"__h": h, "__b": F.shiftright(h, 24).cast("int")})
    return hashed.join(table, "__b").where("__h BETWEEN __lo AND __hi").drop("__b", "__h", "__lo", "__hi")


def owners(keys: DataFrame, ring: Ring) -> DataFrame:
    return place(keys, ring, 1).drop("replicas")


def load(keys: DataFrame, ring: Ring) -> DataFrame:
    return owners(keys, ring).groupBy("node").agg(F.count(F.lit(1)).alias("n_keys"))


def moves(keys: DataFrame, old: Ring, new: Ring) -> DataFrame:
    """``key, from_node, to_node`` of every key: both placements in one pass, without a join of keys."""
    first = owners(keys.select("key"), old).withColumnRenamed("node", "from_node")
    return owners(first, new).withColumnRenamed("node", "to_node")


def rebalance_plan(keys: DataFrame, old: Ring, new: Ring) -> DataFrame:
    return moves(keys, old, new).where("from_node <> to_node")


def moved_count(keys: DataFrame, old: Ring, new: Ring) -> DataFrame:
    return moves(keys, old, new).agg(F.count(F.when(F.col("from_node") != F.col("to_node"), 1)).alias("moved"), F.count(F.lit(1)).alias("total"))


def moved_percent(keys: DataFrame, old: Ring, new: Ring) -> DataFrame:
    return moved_count(keys, old, new).select((F.col("moved") * 100.0 / F.col("total")).alias("pct"))


def shards(kv: DataFrame, ring: Ring, count: int = REPLICAS) -> DataFrame:
    """``node, replica_rank, key, value``: each pair on each of its replicas."""
    return place(kv, ring, count).select(F.posexplode("replicas").alias("replica_rank", "node"), "key", "value")


def replica_read(stored: DataFrame) -> DataFrame:
    """The value of each key from the first replica, in ring order, that has it."""
    return stored.groupBy("key").agg(F.min_by("value", "replica_rank").alias("value"), F.min("replica_rank").alias("replica_rank"))


def quorum(stored: DataFrame, count: int = REPLICAS) -> DataFrame:
    """``key, n_replicas, quorum``: have more than half of the replicas accepted the key?"""
    return stored.groupBy("key").agg(F.count(F.lit(1)).alias("n_replicas")).withColumn("quorum", F.col("n_replicas") >= count // 2 + 1)


def scatter(stored: DataFrame, nodes: list[str]) -> DataFrame:
    """UNION ALL of the nodes' pairs: replicas give repetitions."""
    return stored.where(F.col("node").isin(nodes)).select("key", "value")


def cluster_keys(stored: DataFrame) -> DataFrame:
    return stored.select("key").distinct()
