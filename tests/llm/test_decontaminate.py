"""Hits against brute force, pieces, shards, removal, and the defined edge cases."""

import random

import numpy as np
import pytest

from lodekv.llm import decontaminate as d
from lodekv.llm.columns import utf8


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "x1", "日本"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = {i: say(rng.choice([2, 5, 13, 14, 20])) for i in range(12)}
    docs = []
    for i in range(60):
        parts = [say(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(list(items.values())).upper().replace(" ", ", "), say(rng.randrange(30))]
        docs.append((i, rng.choice([" ", "\n-", "! "]).join(parts)))
    return items, docs


def check(got, items, docs):
    for i, text in docs:
        n_words, n_hit, found = d.brute_force(text, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, list(r.hit_items)) == (n_words, n_hit, len(found), found), i
        assert r.items_sha256 == d.items_digest(found)
        assert r.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)


@pytest.mark.parametrize("shard_bytes", [d.SHARD_BYTES, 2500])
def test_against_brute_force(spark, shard_bytes):
    items, docs = corpus()
    docs += [(100, None), (101, ""), (102, "?!"), (103, items[3]), (104, "w1")]
    bench = spark.createDataFrame([*items.items(), (50, None), (51, "..."), (None, items[1]), (3, items[3])], "item_id long, text string")
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, n_words string, item_id int").repartition(3)
    got = {r.doc_id: r for r in d.contamination(df, bench, shard_bytes=shard_bytes).collect()}
    assert len(got) == len(docs)
    check(got, items, docs)
    for r in got.values():
        text = dict(docs)[r.doc_id]
        spans = list(zip(r.hit_spans[::2], r.hit_spans[1::2], strict=True))
        assert spans == sorted(spans) and all(len(d.words_of((text or "").encode()[a:b])) == 1 for a, b in spans)


def test_long_text_in_pieces(monkeypatch):
    items, docs = corpus(2)
    text = " ".join(t for _, t in docs * 3)
    windows = d.WindowSet([(i, b" ".join(d.words_of(t.encode()))) for i, t in items.items()])
    monkeypatch.setattr(d, "SLAB", 200)
    for t in (text, "x" * 1000 + " " + text + " " + "y" * 900, "", "z" * 700):
        import pyarrow as pa

        ((n, found, spans),) = d.scan_texts(windows, *utf8(pa.array([t])))
        want = d.brute_force(t, items)
        assert (n, len(spans), sorted(found)) == want


def test_no_word_crosses_texts():
    import pyarrow as pa

    rows = list(d.scan_texts(d.WindowSet([(1, b"ab")]), *utf8(pa.array(["a", "b", "ab", "xab"]))))
    assert [(n, sorted(f)) for n, f, _ in rows] == [(1, []), (1, []), (1, [1]), (1, [])]
    assert isinstance(rows[0][2], np.ndarray)


def test_removal_and_empty_tables(spark):
    items, docs = corpus(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    df = spark.createDataFrame([*docs, (None, None)], "doc_id long, text string")
    bad = {i for i, t in docs if d.brute_force(t, items)[1] * 20 >= max(1, d.brute_force(t, items)[0])}
    kept = d.remove_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs if i not in bad} | {None}
    cleaned = {r.doc_id: r.text for r in d.remove_spans(df, bench).collect()}
    assert all(cleaned[i] == t for i, t in docs if i not in bad)
    assert all(len(cleaned[i]) < len(t) for i, t in docs if i in bad)
    assert d.remove_contaminated(df.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in d.contamination(df, bench.limit(0)).collect())


def test_items_in_pieces_and_shared_windows():
    import pyarrow as pa

    rng = random.Random(7)
    words = [f"w{rng.randrange(40)}".encode() for _ in range(900)]
    for most in (1, 60, 10_000):
        pieces = list(d.item_pieces(words, d.WINDOW, most))
        got = {w for p in pieces for w in d.windows_of(p.split(b" "), d.WINDOW)}
        assert got == d.windows_of(words, d.WINDOW)
    passage = " ".join(f"p{i}" for i in range(15))
    items = {i: f"{passage} only{i}" for i in range(50)} | {90: "p3", 91: "p3 p4"}
    sets = d.WindowSet([(i, t.encode()) for i, t in items.items()])
    texts = [f"a {passage} b", "P3. p4", "p33 p3x", passage[: passage.rindex(" ")]]
    for t, (n, found, spans) in zip(texts, d.scan_texts(sets, *utf8(pa.array(texts))), strict=True):
        assert (n, len(spans), sorted(found)) == d.brute_force(t, items)


def test_built_size_is_bounded(spark):
    """A shard's memory is what the parameter says, and its pickle is smaller."""
    import pickle

    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.randrange(10**5)}" for _ in range(400))) for i in range(300)] + [(999, " ".join(f"{rng.randrange(10**5)}" for _ in range(60_000)))]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    shards = list(d.benchmark_shards(bench, "item_id", "text", d.WINDOW, 1 << 20))
    assert len(shards) > 3
    for x in shards:
        assert x.text.nbytes + x.hashes.nbytes + x.places.nbytes + x.sizes.nbytes + x.owners.nbytes <= 1.05 * (1 << 20)
        assert len(pickle.dumps(x)) <= 1.05 * (1 << 20)
    windows = {w for _, t in rows for w in d.windows_of(t.encode().split(b" "), d.WINDOW)}
    assert len(windows) <= sum(len(x.hashes) for x in shards) <= len(windows) + 13 * len(shards)
