"""The key-value queries by name, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workload as w
from .functions.hashing import bloom_positions, crc
from .operators import bloom, digest, repair, replay, ring, snapshot
from .plans import reveal
from .runtime import materialize, shared_path, table
from .sources.textlog import read_log

Query = Callable[[SparkSession, str], DataFrame]
LISTED = ["customer:7", "customer:3", "customer:7", "customer:nope"]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order: the key of its customer shifted by 50, so that some are missing."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("pos"), F.concat(F.lit("customer:"), (F.col("o_custkey") + 50).cast("string")).alias("key"))


def _pairs(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """One pair per supplier, for the customer key of its number plus ``shift``."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("pos"), F.concat(F.lit("customer:"), (F.col("s_suppkey") + shift).cast("string")).alias("key"), F.col("s_name").alias("value"))


def _old_new() -> tuple[ring.Ring, ring.Ring]:
    return ring.Ring(w.NODES), ring.Ring(w.MORE_NODES)


def _last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"))
    return snapshot.last_wins(rows)


def _wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a log that was written to text files and is read from them."""
    path = shared_path(spark, "wal")
    w.log_lines(spark, sf_dir).orderBy("line").select("value").write.text(path)
    return snapshot.snapshot(read_log(spark, path))


def _page(rows: DataFrame) -> DataFrame:
    """Rows of a page with their position, so that the order is part of the result."""
    from pyspark.sql import Window

    return rows.withColumn("pos", (F.row_number().over(Window.orderBy("key")) - 1).cast("int"))  # at most one page


def _merkle_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.leaves(w.kv_customer(spark, sf_dir))


def _merkle_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NodeA against the keys it should hold: before and after its repair, and a node without keys."""
    peer, mine = _peer(spark, sf_dir)
    should = ring.place(peer, ring.Ring(w.NODES)).where(F.array_contains("replicas", "NodeA")).select("key", "value")
    healed = materialize(repair.repair(peer, mine, ring.Ring(w.NODES), "NodeA"), "healed")
    cases = [("before", mine), ("after", healed), ("no keys", mine.limit(0))]
    return reduce(DataFrame.unionByName, [digest.compare(keys, should).select(F.lit(name).alias("case"), "mine", "theirs", "equal", "skip") for name, keys in cases])


def _peer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held = w.stored(spark, sf_dir)
    return held.where("node <> 'NodeA'").select("key", "value").distinct(), held.where("node = 'NodeA'").select("key", "value")


def _bloom_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customer keys against a filter of the keys of all suppliers' pairs, sized by their number."""
    held = _pairs(spark, sf_dir, 0).select("key")
    n = held.count()
    return bloom.check(w.kv_customer(spark, sf_dir).select("key"), bloom.build(held, n), n)


def _bloom_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions of all keys of the mixed keyspace in a filter sized by their number."""
    keys = w.kv_mixed(spark, sf_dir).select("key")
    return keys.select("key", F.array_join(bloom_positions(spark, "key", keys.count()), ",").alias("positions"))


def _bloom_check_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of the mixed keyspace against a filter of all customer keys, sized by their number."""
    held = w.kv_customer(spark, sf_dir).select("key")
    n = held.count()
    return bloom.check(w.kv_mixed(spark, sf_dir).select("key"), bloom.build(held, n), n)


def _bloom_fnv_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions of all customer keys in a filter sized by their number."""
    held = w.kv_customer(spark, sf_dir).select("key")
    return held.select("key", F.array_join(bloom_positions(spark, "key", held.count()), ",").alias("positions"))


QUERIES: dict[str, Query] = {
    # scans and state
    "run_scan": lambda s, d: w.runs(s, d).select("run_id", "key", "value"),
    "run_keys": lambda s, d: w.runs(s, d).select("run_id", "key"),
    "point_get": lambda s, d: snapshot.snapshot(w.log_upsert(s, d)).where("key = 'user:42'"),
    "wal_replay": _wal_replay,
    "snapshot_latest": lambda s, d: snapshot.snapshot(w.log_upsert(s, d)),
    "upsert_snapshot": lambda s, d: snapshot.snapshot(w.log_upsert(s, d).where("op = 'SET'")),
    "tombstone_snapshot": lambda s, d: snapshot.latest(w.log_upsert(s, d)).where("op = 'BANISH'").select("key"),
    "live_keys": lambda s, d: snapshot.live_keys(w.log_upsert(s, d)),
    "compact_runs": lambda s, d: snapshot.compact(w.runs(s, d)),
    "memtable_bytes": lambda s, d: snapshot.byte_size(w.log_upsert(s, d)),
    "key_total": lambda s, d: snapshot.total(w.kv_mixed(s, d)),
    "merge_last_wins": _last_wins,
    "sorted_keys": lambda s, d: w.kv_mixed(s, d).select("key").orderBy("key"),
    # statements
    "reveal_single": lambda s, d: reveal.reveal_keys(w.kv_customer(s, d), ["customer:7"]),
    "reveal_list": lambda s, d: reveal.reveal_requests(w.kv_customer(s, d), _requests(s, d)),
    "reveal_list_missing": lambda s, d: reveal.reveal_keys(w.kv_customer(s, d), ["customer:nope", "nation:1"]),
    "reveal_list_duplicates": lambda s, d: reveal.reveal_keys(w.kv_customer(s, d), LISTED),
    "reveal_prefix": lambda s, d: reveal.reveal_prefix(w.kv_mixed(s, d), "supplier:"),
    "reveal_prefix_none": lambda s, d: reveal.reveal_prefix(w.kv_mixed(s, d), "nope"),
    "reveal_all": lambda s, d: reveal.reveal_prefix(w.kv_mixed(s, d), ""),
    "banish_list": lambda s, d: replay.banish(w.kv_customer(s, d), _pairs(s, d, 0)),
    "banish_count": lambda s, d: replay.applied_count("BANISH", _pairs(s, d, 0)),
    "plant_absent": lambda s, d: replay.after_pairs(w.kv_customer(s, d), _pairs(s, d, 1_000_000), "PLANT"),
    "plant_conflicts": lambda s, d: replay.judge_pairs(w.kv_customer(s, d).where("key <> 'customer:1' AND key <> 'customer:2'"), _pairs(s, d, 0), "PLANT"),
    "morph_present": lambda s, d: replay.after_pairs(w.kv_customer(s, d), _pairs(s, d, 0), "MORPH"),
    "morph_missing": lambda s, d: replay.judge_pairs(w.kv_customer(s, d).where("key <> 'customer:5'"), _pairs(s, d, 0), "MORPH"),
    "cas_replay_applied": lambda s, d: replay.replay(w.log_cas(s, d)).select("seq", "key", "op", "applied"),
    "cas_replay_state": lambda s, d: replay.replay_state(w.log_cas(s, d)),
    # pages
    "keys_page": lambda s, d: _page(reveal.keys_page(w.kv_mixed(s, d), 100, 50)),
    "keys_page_past_end": lambda s, d: _page(reveal.keys_page(w.kv_mixed(s, d), 10_000_000, 50)),
    "page_with_values": lambda s, d: reveal.page_with_values(w.kv_mixed(s, d), 40, 20),
    "search_page": lambda s, d: reveal.search(reveal.page_with_values(w.kv_mixed(s, d), 0, 500), "CUSTOMER:1"),
    # ring
    "key_crc32": lambda s, d: w.kv_mixed(s, d).select("key", crc("key").alias("crc")),
    "ring_vnodes": lambda s, d: ring.Ring(w.MORE_NODES).vnodes(s),
    "ring_owner": lambda s, d: ring.owners(w.ring_keys(s), ring.Ring(w.NODES)),
    "ring_replicas": lambda s, d: ring.place(w.kv_mixed(s, d).select("key"), ring.Ring(w.NODES)).select("key", "node", F.array_join("replicas", ",").alias("replicas")),
    "ring_load": lambda s, d: ring.load(w.ring_keys(s), ring.Ring(w.NODES)),
    "ring_moved_count": lambda s, d: ring.moved_count(w.ring_keys(s), *_old_new()),
    "ring_moved_pct": lambda s, d: ring.moved_percent(w.ring_keys(s), *_old_new()),
    "rebalance_plan": lambda s, d: ring.rebalance_plan(w.ring_keys(s), *_old_new()),
    "members_live": lambda s, d: ring.members(w.member_log(s, d)),
    "members_ring": lambda s, d: ring.Ring.of(ring.members(w.member_log(s, d))).vnodes(s),
    "members": lambda s, d: s.createDataFrame([(n,) for n in w.MORE_NODES], "node string"),
    # cluster reads
    "scatter_union_all": lambda s, d: ring.scatter(w.stored(s, d), w.NODES),
    "cluster_keys": lambda s, d: ring.cluster_keys(w.stored(s, d)),
    "cluster_keys_page": lambda s, d: _page(reveal.keys_page(ring.cluster_keys(w.stored(s, d)), 20, 20)),
    "replica_read": lambda s, d: ring.replica_read(w.stored(s, d)),
    "quorum_check": lambda s, d: ring.quorum(w.stored(s, d)),
    # digests and repair
    "merkle_leaves": _merkle_leaves,
    "merkle_root": lambda s, d: digest.root(w.kv_customer(s, d)),
    "merkle_equal": _merkle_equal,
    "repair_missing": lambda s, d: repair.missing(*_peer(s, d)),
    "repair_owned": lambda s, d: repair.owned(*_peer(s, d), ring.Ring(w.NODES), "NodeA"),
    "repair_gated": lambda s, d: repair.gated(*_peer(s, d), ring.Ring(w.NODES), "NodeA"),
    # Bloom filters
    "bloom_fnv": _bloom_fnv,
    "bloom_fnv_all": _bloom_fnv_all,
    "bloom_check": _bloom_check,
    "bloom_check_all": _bloom_check_all,
}

_CUSTOMER = "SELECT 'customer:' || c_custkey AS key, c_name AS value FROM customer"
_MIXED = f"{_CUSTOMER} UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'part:' || p_partkey, p_name FROM part"
_UPSERT = "SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'BANISH' ELSE 'SET' END AS op, 'user:' || user_id AS key, CASE WHEN event_type <> 'error' THEN props END AS value FROM events"
_SETS = _UPSERT + " WHERE event_type <> 'error'"
_CAS = "SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'PLANT' WHEN 'error' THEN 'BANISH' WHEN 'purchase' THEN 'SET' ELSE 'MORPH' END AS op, 'user:' || user_id AS key, CASE WHEN event_type <> 'error' THEN props END AS value FROM events"
_NEWEST = "SELECT * FROM ({}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"
_RUNS = f"SELECT (seq // 2500)::INT AS run_id, key, value FROM ({_UPSERT}) QUALIFY row_number() OVER (PARTITION BY seq // 2500, key ORDER BY seq DESC) = 1"
_PAIRS = "SELECT s_suppkey::INT AS pos, 'customer:' || (s_suppkey + {}) AS key, s_name AS value FROM supplier"
_REPLAY = f"""SELECT *, CASE op WHEN 'PLANT' THEN NOT present WHEN 'MORPH' THEN present ELSE true END AS applied FROM (
  SELECT *, coalesce(last_value(CASE WHEN op <> 'MORPH' THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <> 'BANISH', false) AS present FROM ({_CAS}))"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({k})), lambda i: ord({k}[i + 1])::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""


def _vnodes(nodes: list[str]) -> str:
    listed = ", ".join(f"('{n}')" for n in nodes)
    name = "(node || '#' || i)"
    return f"SELECT {_CRC.format(k='k')} AS vnode_hash, node FROM (SELECT {name} AS k, node FROM (VALUES {listed}) n(node), range(50) r(i))"


def _placed(keys: str, nodes: list[str]) -> str:
    """SQL of ``key, h, node`` (owner): the first virtual node at or after the key's hash, else the first of all."""
    return f"""SELECT k.*, coalesce(v.node, (SELECT arg_min(node, vnode_hash) FROM ({_vnodes(nodes)}))) AS node
FROM (SELECT *, {_CRC.format(k='key')} AS h FROM ({keys})) k ASOF LEFT JOIN ({_vnodes(nodes)}) v ON k.h <= v.vnode_hash"""


_MEMBERS = "SELECT node FROM (SELECT 'Node' || (user_id % 40) AS node, arg_max(CASE WHEN event_type = 'error' THEN 'LEAVE' ELSE 'JOIN' END, event_id) AS op FROM events GROUP BY 1) WHERE op = 'JOIN'"
_RING_KEYS = "SELECT 'Key-' || i AS key FROM range(100000) r(i)"
_MOVES = f"SELECT a.key, a.node AS from_node, b.node AS to_node FROM ({_placed(_RING_KEYS, w.NODES)}) a JOIN ({_placed(_RING_KEYS, w.MORE_NODES)}) b ON a.key = b.key"
# the second replica: the first virtual node after the key whose node is not the owner
_SECOND = f"""SELECT p.key, p.value, p.h, p.node, arg_min(v.node, CASE WHEN v.vnode_hash >= p.h THEN v.vnode_hash ELSE v.vnode_hash + 4294967296 END) AS second
FROM ({_placed(_MIXED, w.NODES)}) p JOIN ({_vnodes(w.NODES)}) v ON v.node <> p.node GROUP BY ALL"""
_STORED = f"""SELECT * FROM (SELECT node, 0 AS replica_rank, key, value, h FROM ({_SECOND}) UNION ALL SELECT second, 1, key, value, h FROM ({_SECOND})) WHERE NOT (node = 'NodeA' AND h % 10 = 0)"""
_PEER = f"SELECT DISTINCT key, value FROM ({_STORED}) WHERE node <> 'NodeA'"
_MISSING = f"SELECT * FROM ({_PEER}) WHERE key NOT IN (SELECT key FROM ({_STORED}) WHERE node = 'NodeA')"



def _root(keys: str) -> str:
    return f"""WITH RECURSIVE t(l) AS (
  SELECT list(sha256(key) ORDER BY key) FROM ({keys})
  UNION ALL SELECT list_transform(range((len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], l[2 * i + 1]))) FROM t WHERE len(l) > 1)
SELECT l[1] AS root FROM t WHERE len(l) = 1"""


_OWNED = f"SELECT m.key, m.value FROM ({_MISSING}) m JOIN ({_SECOND}) p ON m.key = p.key WHERE p.node = 'NodeA' OR p.second = 'NodeA'"
_HELD = f"SELECT key FROM ({_STORED}) WHERE node = 'NodeA'"
_SHOULD = f"SELECT s.key FROM ({_PEER}) s JOIN ({_SECOND}) p ON s.key = p.key WHERE p.node = 'NodeA' OR p.second = 'NodeA'"


def _compared(case: str, mine: str, theirs: str) -> str:
    return f"""SELECT '{case}' AS "case", mine, theirs, mine IS NOT DISTINCT FROM theirs AS equal, mine IS NOT DISTINCT FROM theirs OR mine IS NULL OR theirs IS NULL AS skip
FROM (SELECT ({_root(mine)}) AS mine, ({_root(theirs)}) AS theirs)"""


def _revealed(keys: list[str]) -> str:
    listed = ", ".join(f"({i}, '{k}')" for i, k in enumerate(keys))
    return f"SELECT r.pos::INT AS pos, r.key, k.value, k.key IS NOT NULL AS found FROM (VALUES {listed}) r(pos, key) LEFT JOIN ({_CUSTOMER}) k ON r.key = k.key"


def _judged(state: str, op: str) -> str:
    bad = "k.key IS NOT NULL OR row_number() OVER (PARTITION BY p.key ORDER BY p.pos) > 1" if op == "PLANT" else "k.key IS NULL"
    return f"""WITH j AS (SELECT p.*, {bad} AS bad FROM ({_PAIRS.format(0)}) p LEFT JOIN ({state}) k ON p.key = k.key)
SELECT pos, key, value, coalesce(pos < (SELECT min(pos) FROM j WHERE bad), true) AS accepted FROM j"""


def _paged(keys: str, offset: int, limit: int) -> str:
    return f"SELECT key, (row_number() OVER (ORDER BY key) - 1)::INT AS pos FROM (SELECT key FROM ({keys}) ORDER BY key LIMIT {limit} OFFSET {offset})"


_SUPPLIED = f"SELECT key FROM ({_PAIRS.format(0)})"


def _bits(keys: str, held: str) -> str:
    """SQL of ``key, places``: the positions of ``keys`` in a filter sized for the number of ``held`` at an error rate of 1 %."""
    return f"""SELECT key, list_transform(range(hashes), lambda i: (((h & 4294967295::HUGEINT) + i * greatest(h >> 32, 1::HUGEINT)) & 4294967295::HUGEINT) % size) AS places
FROM (SELECT key, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(length(key)), lambda i: ord(key[i + 1])::HUGEINT)),
  lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) & 18446744073709551615::HUGEINT) AS h FROM ({keys})),
(SELECT size, greatest(1, trunc(size / n * ln(2))::BIGINT) AS hashes FROM (SELECT n, greatest(1, trunc(-n * ln(0.01) / (ln(2) * ln(2)))::BIGINT) AS size FROM (SELECT count(*) AS n FROM ({held}))))"""


def _maybe(keys: str, held: str) -> str:
    """SQL of ``key, maybe``: whether all positions of a key are set by those of ``held``."""
    return f"""SELECT key, bool_and(s.x IS NOT NULL) AS maybe FROM (SELECT key, unnest(places) AS x FROM ({_bits(keys, held)})) p
LEFT JOIN (SELECT DISTINCT unnest(places) AS x FROM ({_bits(held, held)})) s ON p.x = s.x GROUP BY key"""


ORACLE_SQL: dict[str, str] = {
    "run_scan": _RUNS,
    "run_keys": f"SELECT run_id, key FROM ({_RUNS})",
    "point_get": f"SELECT key, value FROM ({_NEWEST.format(_UPSERT)}) WHERE op <> 'BANISH' AND key = 'user:42'",
    "wal_replay": f"SELECT key, value FROM ({_NEWEST.format(_UPSERT)}) WHERE op <> 'BANISH'",
    "snapshot_latest": f"SELECT key, value FROM ({_NEWEST.format(_UPSERT)}) WHERE op <> 'BANISH'",
    "upsert_snapshot": f"SELECT key, value FROM ({_NEWEST.format(_SETS)})",
    "tombstone_snapshot": f"SELECT key FROM ({_NEWEST.format(_UPSERT)}) WHERE op = 'BANISH'",
    "live_keys": f"SELECT key FROM ({_NEWEST.format(_UPSERT)}) WHERE op <> 'BANISH'",
    "compact_runs": f"SELECT key, value FROM ({_RUNS} ) QUALIFY row_number() OVER (PARTITION BY key ORDER BY run_id DESC) = 1 AND value IS NOT NULL",
    "memtable_bytes": f"SELECT sum(strlen(key) + coalesce(strlen(value), 0))::BIGINT AS n_bytes FROM ({_NEWEST.format(_UPSERT)})",
    "key_total": f"SELECT count(*) AS total FROM ({_MIXED})",
    "merge_last_wins": "SELECT 'user:' || user_id AS key, arg_max(props, event_id) AS value FROM events GROUP BY user_id",
    "sorted_keys": f"SELECT key FROM ({_MIXED}) ORDER BY key",
    "reveal_single": _revealed(["customer:7"]),
    "reveal_list": f"SELECT r.pos, r.key, k.value, k.key IS NOT NULL AS found FROM (SELECT o_orderkey::INT AS pos, 'customer:' || (o_custkey + 50) AS key FROM orders) r LEFT JOIN ({_CUSTOMER}) k ON r.key = k.key",
    "reveal_list_missing": _revealed(["customer:nope", "nation:1"]),
    "reveal_list_duplicates": _revealed(LISTED),
    "reveal_prefix": f"SELECT * FROM ({_MIXED}) WHERE starts_with(key, 'supplier:')",
    "reveal_prefix_none": f"SELECT * FROM ({_MIXED}) WHERE starts_with(key, 'nope')",
    "reveal_all": _MIXED,
    "banish_list": f"SELECT * FROM ({_CUSTOMER}) WHERE key NOT IN (SELECT key FROM ({_PAIRS.format(0)}))",
    "banish_count": "SELECT 'BANISH' AS op, count(*) AS n_keys, 'Banished ' || count(*) || ' keys' AS message FROM supplier",
    "plant_absent": f"{_CUSTOMER} UNION ALL SELECT key, value FROM ({_PAIRS.format(1_000_000)})",
    "plant_conflicts": _judged(f"SELECT * FROM ({_CUSTOMER}) WHERE key NOT IN ('customer:1', 'customer:2')", "PLANT"),
    "morph_present": f"SELECT k.key, coalesce(p.value, k.value) AS value FROM ({_CUSTOMER}) k LEFT JOIN (SELECT * FROM ({_PAIRS.format(0)}) WHERE pos < coalesce((SELECT min(pos) FROM ({_PAIRS.format(0)}) WHERE key NOT IN (SELECT key FROM ({_CUSTOMER}))), 1000000000)) p ON k.key = p.key",
    "morph_missing": _judged(f"SELECT * FROM ({_CUSTOMER}) WHERE key <> 'customer:5'", "MORPH"),
    "cas_replay_applied": f"SELECT seq, key, op, applied FROM ({_REPLAY})",
    "cas_replay_state": f"SELECT key, value FROM (SELECT * FROM ({_REPLAY}) WHERE applied QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op <> 'BANISH'",
    "keys_page": _paged(_MIXED, 100, 50),
    "keys_page_past_end": _paged(_MIXED, 10_000_000, 50),
    "page_with_values": f"SELECT * FROM ({_MIXED}) ORDER BY key LIMIT 20 OFFSET 40",
    "search_page": f"SELECT * FROM (SELECT * FROM ({_MIXED}) ORDER BY key LIMIT 500) WHERE contains(lower(key), 'customer:1') OR contains(lower(value), 'customer:1')",
    "key_crc32": f"SELECT key, {_CRC.format(k='key')} AS crc FROM ({_MIXED})",
    "ring_vnodes": _vnodes(w.MORE_NODES),
    "ring_owner": f"SELECT key, node FROM ({_placed(_RING_KEYS, w.NODES)})",
    "ring_replicas": f"SELECT key, node, node || ',' || second AS replicas FROM ({_SECOND})",
    "ring_load": f"SELECT node, count(*) AS n_keys FROM ({_placed(_RING_KEYS, w.NODES)}) GROUP BY node",
    "ring_moved_count": f"SELECT count(*) FILTER (from_node <> to_node) AS moved, count(*) AS total FROM ({_MOVES})",
    "ring_moved_pct": f"SELECT count(*) FILTER (from_node <> to_node) * 100.0::DOUBLE / count(*) AS pct FROM ({_MOVES})",
    "rebalance_plan": f"SELECT * FROM ({_MOVES}) WHERE from_node <> to_node",
    "members_live": _MEMBERS,
    "members_ring": f"SELECT {_CRC.format(k='k')} AS vnode_hash, node FROM (SELECT (node || '#' || i) AS k, node FROM ({_MEMBERS}) n, range(50) r(i)) QUALIFY row_number() OVER (PARTITION BY vnode_hash ORDER BY node DESC) = 1",
    "members": "SELECT * FROM (VALUES ('NodeA'), ('NodeB'), ('NodeC'), ('NodeD')) n(node)",
    "scatter_union_all": f"SELECT key, value FROM ({_STORED})",
    "cluster_keys": f"SELECT DISTINCT key FROM ({_STORED})",
    "cluster_keys_page": _paged(f"SELECT DISTINCT key FROM ({_STORED})", 20, 20),
    "replica_read": f"SELECT key, arg_min(value, replica_rank) AS value, min(replica_rank)::INT AS replica_rank FROM ({_STORED}) GROUP BY key",
    "quorum_check": f"SELECT key, count(*) AS n_replicas, count(*) >= 2 AS quorum FROM ({_STORED}) GROUP BY key",
    "merkle_leaves": f"SELECT row_number() OVER (ORDER BY key) - 1 AS i, sha256(key) AS h FROM ({_CUSTOMER})",
    "merkle_root": _root(_CUSTOMER),
    "merkle_equal": " UNION ALL ".join(f"({_compared(case, mine, _SHOULD)})" for case, mine in (("before", _HELD), ("after", f"{_HELD} UNION ALL SELECT key FROM ({_OWNED})"), ("no keys", f"{_HELD} AND false"))),
    "repair_missing": _MISSING,
    "repair_owned": _OWNED,
    "repair_gated": _OWNED,
    "bloom_fnv": f"SELECT key, array_to_string(places, ',') AS positions FROM ({_bits(_MIXED, _MIXED)})",
    "bloom_fnv_all": f"SELECT key, array_to_string(places, ',') AS positions FROM ({_bits(_CUSTOMER, _CUSTOMER)})",
    "bloom_check": _maybe(_CUSTOMER, _SUPPLIED),
    "bloom_check_all": _maybe(_MIXED, _CUSTOMER),
}
