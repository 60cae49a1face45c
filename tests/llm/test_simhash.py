"""Fingerprints, index, links and components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodekv.llm import simhash
from lodekv.llm.gray_index import GrayIndex, components, gray_rank


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, most=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def near(rng, n, centers):
    middle = [rng.getrandbits(64) for _ in range(centers)]
    out = set()
    while len(out) < n:
        x = rng.choice(middle)
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return list(out)


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "one two THREE", "a b c d", "é Ü à\x0bß x\x1cy z", " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(500))]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t), t


def test_gray_rank():
    x = np.arange(64, dtype=np.uint64)
    assert np.array_equal(gray_rank(x ^ (x >> np.uint64(1))), x)


@pytest.mark.parametrize("n, centers", [(1, 1), (2, 1), (60, 2), (700, 5), (700, 700)])
def test_index_finds_all_pairs(n, centers):
    fps = near(random.Random(n), n, centers)
    a, b, work = GrayIndex(np.array(fps, np.uint64), np.zeros(n, np.int64)).pairs(4)
    got = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert len(got) == len(a)
    assert got == {frozenset((i, j)) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}
    assert work <= n * n + 8 * n


def test_masks_cover():
    rng = random.Random(5)
    for n in (10, 1 << 22, 1 << 30, 1 << 40):
        masks = simhash.masks_for(n, 4)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m for m in masks)


def test_finer_masks_cover():
    rng = random.Random(6)
    for mask in (*simhash.masks_for(10, 4), *simhash.masks_for(1 << 40, 4)):
        free = [b for b in range(64) if not mask >> b & 1]
        more = simhash.finer(mask, 4)
        assert len(more) == 5 and all(m & mask == mask and m != mask for m in more)
        for _ in range(50):
            diff = sum(1 << b for b in rng.sample(free, 4))
            assert any(not diff & m for m in more)


@pytest.mark.parametrize("tight", [False, True])
def test_full_buckets_are_dealt_again(spark, tight):
    """Many fingerprints that agree on a block: few copies, and the components of brute force."""
    rng = random.Random(8)
    fps = {x >> 16 for x in near(rng, 1500, 500)} if not tight else {rng.getrandbits(14) << 3 for _ in range(1200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    rows = simhash.dealt(df, len(fps), 4, 8)
    held = rows.groupBy("m", "v", "i", "j").count().agg({"count": "max"}).first()[0]
    assert held <= 64  # two parts of about eight
    if not tight:
        assert rows.count() < len(fps) * 5 * len(fps) / 8 / 20  # all pairs of parts would be more than twenty times as many
    nodes = df.selectExpr("fp AS v", "fp AS rep")
    got = {r.v: r.label.rep for r in simhash.connected(nodes, simhash.links(df, len(fps), 4, 8)).collect()}
    comp = plain_components(fps)
    assert [got.get(x, x) for x in fps] == [fps[c] for c in comp]


def test_local_components():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    label = components(300, a, b)
    assert (label[a] == label[b]).all()
    edges = [[] for _ in range(300)]
    for x, y in zip(a, b, strict=True):
        edges[x].append(y)
        edges[y].append(x)
    for s in range(300):
        seen, todo = {s}, [s]
        while todo:
            for y in edges[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        assert label[s] == min(seen)


@pytest.mark.parametrize("bucket", [8, 512])
def test_near_duplicates(spark, monkeypatch, bucket):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(120)) for _ in range(12)]
    rows = []
    for k in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "zz"
        rows.append((1000 - k, " ".join(words), k, k))
    rows += [(5, None, 1, 1), (4, "", 1, 1), (3, "...", 1, 1), (3, rows[0][1], 1, 1), (None, "x", 1, 1), (None, rows[1][1], 1, 1), (2000, "y " * 50_000, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long, component_id long").repartition(3)
    monkeypatch.setattr(simhash.links, "__defaults__", (4, bucket))
    got = [(r.doc_id if r.doc_id is not None else -1, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()]
    fps = [plain_fingerprint(r[1]) for r in rows]
    comp = plain_components(fps)
    least = {}
    for r, c in zip(rows, comp, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = [(-1 if r[0] is None else r[0], signed(f), least.get(c)) for r, f, c in zip(rows, fps, comp, strict=True)]
    order = lambda r: (r[0], r[1], r[2] or 0)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert len(set(comp)) < len(rows) // 2
    check_kept(simhash.keep_one_of_each(df), df, rows)


def check_kept(kept, df, rows):
    """One row of each component: one of those with its smallest id."""
    assert kept.columns == df.columns
    comp = plain_components([plain_fingerprint(r[1]) for r in rows])
    of = {}
    for r, c in zip(rows, comp, strict=True):
        of.setdefault(c, []).append(r[:2])
    rank = lambda r: (r[0] is None, r[0] or 0)
    got = [tuple(r)[:2] for r in kept.collect()]
    assert len(got) == len(of)
    for mine in of.values():
        assert sum(r in mine for r in got) == 1
        (row,) = [r for r in got if r in mine]
        assert rank(row) == min(map(rank, mine))


@pytest.mark.parametrize("parts", [1, 3])
def test_no_text_is_lost_with_its_id(spark, parts):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    for rows in ([(1, a), (5, a), (5, b)], [(5, b), (5, a), (1, a)], [(None, a), (None, a), (None, b), (7, b)], [(3, a), (3, a), (3, b), (3, None), (None, "")]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        check_kept(simhash.keep_one_of_each(df), df, rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_one_of_each(df).collect() == []


def test_edges_that_differ_at_each_evaluation(spark):
    """Links are the same components whichever trees and directions an evaluation gives."""

    def either(batches):
        for batch in batches:
            flip = np.random.default_rng().random(batch.num_rows) < 0.5
            u, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.where(flip, u, w)), pa.array(np.where(flip, w, u))], names=["u", "w"])

    nodes = spark.range(60).selectExpr("id AS v", "id AS rep")
    edges = spark.range(59).selectExpr("id AS u", "id + 1 AS w").mapInArrow(either, "u long, w long")
    assert {r.label.rep for r in simhash.connected(nodes, edges).collect()} == {0}


def test_long_chain(spark):
    """Components do not need a link between their ends."""
    chain = [0]
    for b in range(0, 64, 4):
        chain.append(chain[-1] | 0xF << b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x), 100 - i) for i, x in enumerate(chain)], "v long, rep long")
    edges = simhash.links(nodes.selectExpr("v AS fp"), len(chain))
    labels = simhash.connected(nodes, edges).collect()
    assert len(labels) == len(chain) and {r.label.rep for r in labels} == {100 - len(chain) + 1}
