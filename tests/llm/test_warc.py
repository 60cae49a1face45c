"""Round trips, damage, and the defined edge cases."""

import gzip
import hashlib
import random

import pytest

from lodekv.llm import warc


def archive(n=30, plain=False):
    rng = random.Random(n)
    payloads = [bytes(rng.choice(b"abc <>\r\n") for _ in range(rng.randrange(2000))) for _ in range(n)]
    parts = [warc.record(i, f"http://h/{i}", p) for i, p in enumerate(payloads)]
    return payloads, parts if plain else [warc.member(p) for p in parts]


def test_members_are_plain_gzip():
    payloads, parts = archive()
    assert all(p[-1] == 0 for p in parts)
    assert gzip.decompress(b"".join(parts)).count(b"WARC/1.1\r\n") == len(payloads)


def test_intact():
    for plain in (False, True):
        payloads, parts = archive(plain=plain)
        got = list(warc.salvage(b"".join(parts)))
        assert [x.payload() for x in got] == [(len(p), p) for p in payloads]


def test_damage_costs_only_what_it_hits():
    rng = random.Random(5)
    for plain in (False, True):
        payloads, parts = archive(plain=plain)
        starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
        whole = b"".join(parts)
        for _ in range(60):
            data = bytearray(whole)
            a = rng.randrange(len(data))
            b = min(len(data), a + rng.choice([1, 7, 300, 3000]))
            data[a:b] = bytes(rng.randrange(256) for _ in range(b - a))
            got = list(warc.salvage(bytes(data)))
            untouched = {i for i in range(len(parts)) if starts[i + 1] <= a or starts[i] >= b}
            ids = {x.number("WARC-Record-ID") for x in got if isinstance(x, warc.Record)}
            assert untouched <= ids
            covered = sum(x.length for x in got if isinstance(x, warc.Gap))
            assert all(x.offset >= 0 and x.length > 0 for x in got if isinstance(x, warc.Gap))
            if len(ids) < len(parts):
                assert 0 < covered


def test_cut_off_and_leading_junk():
    payloads, parts = archive()
    whole = b"".join(parts)
    got = list(warc.salvage(b"junk\x1f\x8b\x08junk" + whole[:-9]))
    assert isinstance(got[0], warc.Gap) and got[0].offset == 0 and got[0].length == 11
    assert isinstance(got[-1], warc.Gap)
    assert sum(isinstance(x, warc.Record) for x in got) >= len(payloads) - 1
    assert list(warc.salvage(b"")) == []


def several():
    return [warc.record(i, f"http://h/{i}", f"payload {i} ".encode() * 200) for i in range(6)]


def ids_of(got):
    return [x.number("WARC-Record-ID") for x in got if isinstance(x, warc.Record)]


def test_one_bad_record_of_a_member_costs_no_other():
    parts = several()
    parts[2] = parts[2].replace(b"payload 2", b"payl0ad 2", 1)
    got = list(warc.salvage(gzip.compress(b"".join(parts))))
    assert ids_of(got) == [0, 1, 3, 4, 5]
    (gap,) = [x for x in got if isinstance(x, warc.Gap)]
    assert (gap.offset, gap.inside, gap.length) == (0, len(parts[0] + parts[1]), len(parts[2]))


@pytest.mark.parametrize("level", [0, 6])
def test_records_before_a_break_in_their_member_stay(level):
    rng = random.Random(3)
    parts = [warc.record(i, "u", bytes(rng.randrange(256) for _ in range(3000))) for i in range(6)]
    whole = gzip.compress(b"".join(parts), level)
    after = warc.member(warc.record(9, "u", b"later"))
    assert ids_of(warc.salvage(whole[:-100] + after))[-1] == 9 and ids_of(warc.salvage(whole[:-100] + after))[:-1] == [0, 1, 2, 3, 4]
    broken = bytearray(whole)
    broken[len(whole) // 2 : len(whole) // 2 + 400] = bytes(400)
    got = ids_of(warc.salvage(bytes(broken) + after))
    assert got[:2] == [0, 1] and got[-1] == 9 and len(set(got)) == len(got)
    assert any(isinstance(x, warc.Gap) for x in warc.salvage(bytes(broken) + after))


def test_files_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "RUN_BYTES", 20_000)
    monkeypatch.setattr(warc, "RUNS_PER_FILE", 2)
    monkeypatch.setattr(warc, "FILTER_BITS", 1 << 5)  # nearly every digest is a false hit
    rng = random.Random(1)
    pages = [(i, None, "".join(rng.choice("abcdefgh") for _ in range(30_000))) for i in range(30)]
    pages += [(100 + i, "urn:none", "x" * 3_000_000) for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(df, str(tmp_path / "w"))
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) >= 8 and max(sizes) < 70_000
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == 33 and all(bytes(got[i].payload).decode() == h and got[i].url == u for i, u, h in pages[:30])
    assert [got[100 + i].record_type for i in range(3)] == ["revisit", "revisit", "response"] and got[100].refers_to == 102


def test_damage_to_a_fresh_archive_is_an_error(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "u", "x" * 2000)], "page_id long, url string, html string")
    whole = warc.record
    monkeypatch.setattr(warc, "read_archives", lambda s, path, payloads: s.createDataFrame([("f", 0, None, None, None, None, None, None, None, 7, "cut", None)], warc._READ))
    with pytest.raises(Exception, match="damaged"):
        warc.round_trip(df).collect()
    assert warc.record is whole


def test_round_trip(spark):
    big, other = "x" * 1500, "é" * 700
    rows = [(1, "u", big), (2, "u\r\nv", big), (9, "u", big), (3, None, other), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", big), (None, "u", "z" * 1200), (None, "u", "z" * 1200), (9, "u", big), (8, "u", "y" * 999), (10, "u", "y" * 999)]
    rows += [(100 + i, "u", "w" * 1000) for i in range(50)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, keeper int").repartition(3)
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=repr)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        keeper = max(same) if len(p) >= 1000 and same else None
        revisit = keeper is not None and i != keeper
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_payloads_and_gaps_are_read(spark, tmp_path):
    payloads, parts = archive(5)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"??" + parts[1] + parts[2][:-12] + parts[3] + parts[4])
    got = warc.read_archives(spark, str(tmp_path)).orderBy("byte_offset").collect()
    assert [bytes(r.payload) for r in got if r.gap_bytes is None] == [payloads[i] for i in (0, 1, 3, 4)]
    assert [r.gap_bytes for r in got if r.gap_bytes is not None] == [2, len(parts[2]) - 12]
