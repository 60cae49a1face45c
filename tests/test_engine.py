"""The engine over a store: golden statements, random operations against a dictionary, reopening, compaction, streams."""

import random

import pytest

from lodekv.model import ConcurrentWrite, KeyExists, KeyMissing
from lodekv.operators import digest
from lodekv.plans.engine import Engine
from lodekv.sources.store import Store


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.execute("PLANT (a WITH 1, user:x WITH 2, user:y WITH 3)")
    return e


def state(e):
    return {r.key: r.value for r in e.state.collect()}


START = {"a": "1", "user:x": "2", "user:y": "3"}


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_reads(engine):
    assert rows(engine.execute("reveal 'a'")) == [(0, "a", "1", True)]
    assert rows(engine.execute("REVEAL zz")) == [(0, "zz", None, False)]
    assert rows(engine.execute("REVEAL (a, zz, a)")) == [(0, "a", "1", True), (1, "zz", None, False), (2, "a", "1", True)]
    assert rows(engine.execute("REVEAL ()")) == []
    assert rows(engine.execute("REVEAL PREFIX user:")) == [("user:x", "2"), ("user:y", "3")]
    assert rows(engine.execute("REVEAL PREFIX 'nope'")) == []
    assert rows(engine.execute("REVEAL *")) == sorted(START.items())
    assert rows(engine.get("a")) == [(0, "a", "1", True)]
    assert rows(engine.keys(1, 1)) == [("user:x",)] and rows(engine.keys(99)) == [] and rows(engine.keys(-5, 0)) == [("a",)]
    assert rows(engine.page(0, 20, "USER:X")) == [("user:x", "2")]
    assert rows(engine.total()) == [(3,)]


WRITES = [
    ("PLANT n WITH v", ("PLANT", 1, "Planted 1 keys"), {**START, "n": "v"}),
    ("PLANT a WITH x", KeyExists("a"), START),
    ("PLANT (n WITH v, a WITH w, m WITH x)", KeyExists("a"), {**START, "n": "v"}),
    ("PLANT (n WITH v n WITH w)", KeyExists("n"), {**START, "n": "v"}),
    ("PLANT ()", ("PLANT", 0, "Planted 0 keys"), START),
    ("PLANT n WITH '__deleted__'", ("PLANT", 1, "Planted 1 keys"), {**START, "n": "__deleted__"}),
    ("PLANT n WITH ''", ("PLANT", 1, "Planted 1 keys"), {**START, "n": ""}),
    ("BANISH (a, a, zz)", ("BANISH", 3, "Banished 3 keys"), {"user:x": "2", "user:y": "3"}),
    ("BANISH ()", ("BANISH", 0, "Banished 0 keys"), START),
    ("MORPH (a TO x, a TO y)", ("MORPH", 2, "Morphed 2 keys"), {**START, "a": "y"}),
    ("MORPH (a TO x, zz TO y)", KeyMissing("zz"), {**START, "a": "x"}),
]


@pytest.mark.parametrize("text, want, after", WRITES, ids=[w[0] for w in WRITES])
def test_writes(engine, text, want, after):
    if isinstance(want, Exception):
        with pytest.raises(type(want)) as error:
            engine.execute(text)
        assert str(error.value) == str(want)
    else:
        assert rows(engine.execute(text)) == [want]
    assert state(engine) == after


def test_messages():
    assert str(KeyExists("a")) == "key 'a' already exists — use MORPH to update it"
    assert str(KeyMissing("zz")) == "cannot morph key zz: not found"


def test_plant_after_banish(engine):
    engine.execute("BANISH a")
    engine.execute("PLANT a WITH again")
    assert state(engine)["a"] == "again"


def test_random_operations_reopen_and_compact(spark, tmp_path):
    rng, want, path = random.Random(4), {}, str(tmp_path / "store")
    e = Engine(spark, path)
    odd = ["", "k|1", "line\nbreak", "é", "'q'", "__deleted__", "x" * 1000]
    for step in range(5):
        ops = []
        for pos in range(60):
            op, key = rng.choice(["SET", "PLANT", "MORPH", "BANISH"]), rng.choice([*odd, "a", "b"])
            value = None if op == "BANISH" else rng.choice([*odd, str(pos)])
            ops.append((pos, op, key, value))
        applied = []
        for pos, op, key, value in ops:
            fine = {"PLANT": key not in want, "MORPH": key in want}.get(op, True)
            applied.append((pos, fine))
            if fine:
                want.pop(key, None) if op == "BANISH" else want.__setitem__(key, value)
        got = e.execute_batch(spark.createDataFrame(ops, "pos long, op string, key string, value string"))
        assert sorted((r.seq, r.applied) for r in got.collect()) == applied
        assert state(e) == want
        if step % 2:
            before = digest.root(e.state).collect()
            e.store.compact()
            assert digest.root(e.state).collect() == before
        e = Engine(spark, path)
        assert state(e) == want
    assert e.store.vacuum() > 0 and state(Engine(spark, path)) == want
    e.delete(spark.createDataFrame([(k,) for k in want], "key string"))
    assert state(e) == {} and rows(e.total()) == [(0,)]


def test_set_and_maintain(spark, engine):
    engine.set(spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "b", None)], "pos long, key string, value string"))
    assert state(engine) == {**START, "a": "y", "b": None}
    assert not engine.store.maintain() and engine.store.maintain(0) and engine.store.log_bytes() == 0
    assert state(engine) == {**START, "a": "y", "b": None}


def test_key_conditions_reach_the_scan(spark, engine):
    engine.store.compact()
    engine.execute("PLANT z WITH 9")
    plan = engine.get("a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan and "SortMergeJoin" not in plan
    assert "StringStartsWith(key,user:)" in engine.execute("REVEAL PREFIX user:")._jdf.queryExecution().executedPlan().toString()


def test_stale_manifest_is_pinned(spark, tmp_path):
    writer = Engine(spark, str(tmp_path / "s"))
    writer.execute("PLANT a WITH 1")
    reader = Store(spark, str(tmp_path / "s"))
    writer.execute("MORPH a TO 2")
    assert reader.state().collect()[0].value == "1" and Store(spark, str(tmp_path / "s")).state().collect()[0].value == "2"


def test_stream(spark, tmp_path):
    from lodekv import workload
    from lodekv.operators.replay import replay_state
    from lodekv.operators.snapshot import snapshot
    from lodekv.streaming import ingest as streaming

    log = workload.log_cas(spark, "/root/testdata/sf0.001")
    source = str(tmp_path / "log")
    for k in range(4):  # files in order of seq
        log.where(f"seq div 250 = {k}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    e = Engine(spark, str(tmp_path / "store"))
    q = streaming.ingest(stream, e, str(tmp_path / "ck"), compact_bytes=20_000)
    q.processAllAvailable()
    q.stop()
    assert state(Engine(spark, str(tmp_path / "store"))) == {r.key: r.value for r in replay_state(log).collect()}
    upserts = workload.log_upsert(spark, "/root/testdata/sf0.001")
    upserts.write.parquet(str(tmp_path / "up"))
    source = spark.readStream.schema(upserts.schema).parquet(str(tmp_path / "up"))
    q = streaming.newest(source).writeStream.outputMode("update").format("memory").queryName("newest").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(streaming.live(spark.table("newest")).collect()) == sorted(snapshot(upserts).collect())


def test_cache_follows_the_version(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), cache=True)
    assert e.digest_root() is None
    e.execute("PLANT (a WITH 1, b WITH 2)")
    held = e.state
    assert held.storageLevel.useMemory and e.state is held and state(e) == {"a": "1", "b": "2"}
    root = e.digest_root()
    e.execute("BANISH a")
    assert e.state is not held and not held.storageLevel.useMemory and state(e) == {"b": "2"} and e.digest_root() != root


def test_second_writer_is_refused(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    other = Engine(spark, str(tmp_path / "store"))
    e.execute("PLANT a WITH 1")
    with pytest.raises(ConcurrentWrite):
        other.execute("PLANT a WITH 2")
    assert state(Engine(spark, str(tmp_path / "store"))) == {"a": "1"}


def test_bulk_writes_take_one_number(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    many = spark.range(1000).selectExpr("concat('k', id % 300) AS key", "cast(id AS string) AS value", "id AS pos").repartition(7)
    e.set(many)
    assert e.store.manifest["next_seq"] == 1 and state(e) == {f"k{i}": str(i + 900 if i < 100 else i + 600) for i in range(300)}
    e.delete(many.where("pos < 250"))
    e.set(spark.createDataFrame([("k1", None)], "key string, value string"))
    assert e.store.manifest["next_seq"] == 3 and set(state(e)) == {"k1", *(f"k{i}" for i in range(250, 300))} and state(e)["k1"] is None


def test_long_statements(spark, tmp_path, monkeypatch):
    from lodekv.plans import reveal

    monkeypatch.setattr(reveal, "LITERAL_KEYS", 2)
    e = Engine(spark, str(tmp_path / "store"))
    e.execute("PLANT (a WITH 1, b WITH 2, c WITH 3)")
    with pytest.raises(KeyExists):
        e.execute("PLANT (d WITH 4, e WITH 5, c WITH 6, f WITH 7)")
    assert state(e) == {"a": "1", "b": "2", "c": "3", "d": "4", "e": "5"}
    assert [r.value for r in e.execute("REVEAL (e, a, zz, b)").collect()] == ["5", "1", None, "2"]
