"""Run files and Bloom filters."""

import pytest

from lodekv import workload
from lodekv.functions.hashing import bloom_shape, fnv1a
from lodekv.operators import bloom, snapshot
from lodekv.queries import QUERIES
from lodekv.sources import runfile


def test_run_file_layout():
    data = runfile.encode([("a", "xy"), ("é", None)])
    assert data[:11] == b"\x01\0\0\0a\x02\0\0\0xy" and data[-8] == 11 + 4 + 2 + 4 + 11
    assert list(runfile.decode(data)) == [("a", "xy"), ("é", None)]
    assert list(runfile.decode(runfile.encode([]))) == []
    for bad in (b"", data[:-9], data[:-8] + b"\xff" * 8):
        with pytest.raises(ValueError):
            list(runfile.decode(bad))


def test_runs_are_read_and_compacted(spark, tmp_path):
    old, new = {f"k{i:03}": str(i) for i in range(250)}, {"k001": None, "k002": "new", "z": "9"}
    (tmp_path / "run-99.bin").write_bytes(runfile.encode(sorted(old.items())))
    (tmp_path / "run-100.bin").write_bytes(runfile.encode(sorted(new.items())))
    runs = runfile.read_runs(spark, str(tmp_path))
    assert runs.where("run_id = 1").count() == 3 and runs.where("run_id = 0").count() == 250
    want = {k: v for k, v in {**old, **new}.items() if v is not None}
    assert {r.key: r.value for r in snapshot.compact(runs).collect()} == want


def test_write_and_read_again(spark, tmp_path):
    kv = workload.kv_customer(spark, "/root/testdata/sf0.001")
    runfile.write_run(kv, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    got = [p for f in files for p in (runfile.decode(f.read_bytes()) if f.stat().st_size else [])]
    assert got == sorted((r.key, r.value) for r in kv.collect())


@pytest.mark.parametrize("most", [bloom.MAX_BITS, 1])
def test_bloom_has_no_false_negative(spark, monkeypatch, most):
    monkeypatch.setattr(bloom, "MAX_BITS", most)
    keys = workload.ring_keys(spark, 4000)
    inside = keys.where("crc32(key) % 4 = 0")
    n = inside.count()
    judged = bloom.check(keys, bloom.build(inside, n), n)
    assert judged.join(inside, "key", "left_semi").where("NOT maybe").count() == 0
    assert judged.join(inside, "key", "left_anti").where("maybe").count() < 0.03 * 3000


@pytest.mark.parametrize("most", [bloom.MAX_BITS, 1])
def test_bloom_queries_cover_all_keys(spark, monkeypatch, most):
    monkeypatch.setattr(bloom, "MAX_BITS", most)
    sf = "/root/testdata/sf0.001"
    held = [r.key for r in workload.kv_customer(spark, sf).collect()]
    bits, hashes = bloom_shape(len(held))

    def places(key):
        h = fnv1a(key.encode())
        return [((h & 0xFFFFFFFF) + i * ((h >> 32) or 1) & 0xFFFFFFFF) % bits for i in range(hashes)]

    field = {p for k in held for p in places(k)}
    want = sorted((r.key, field.issuperset(places(r.key))) for r in workload.kv_mixed(spark, sf).collect())
    assert len(held) > 100 and sum(maybe for _, maybe in want) >= len(held) and not all(maybe for _, maybe in want)
    assert sorted(map(tuple, QUERIES["bloom_check_all"](spark, sf).collect())) == want
    assert sorted(map(tuple, QUERIES["bloom_fnv_all"](spark, sf).collect())) == sorted((k, ",".join(map(str, places(k)))) for k in held)
