"""Context-tree weighting against a plain recursion; base score against plain counts; edge cases."""

import functools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodekv.llm import ctw
from lodekv.llm.langid import in_fold


def nodes_of(streams):
    held = ctw.NodeCounts()
    gram, _ = ctw.grams_of(streams)
    keys, counts = np.unique(gram, return_counts=True)
    held.add(keys, counts)
    table = ctw.NodeTable()
    for columns in held.rows():
        table.put(*columns)
    return table


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Plain:
    """The trees as dictionaries: (context, leading bits) -> [zeros, ones]."""

    def __init__(self, streams):
        self.n, self.children = {}, {}
        for s in streams:
            data = ctw.END * ctw.DEPTH + s
            for i in range(ctw.DEPTH, len(data)):
                for k in range(8):
                    prefix, bit = (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1
                    for d in range(ctw.DEPTH + 1):
                        context = data[i - d : i]
                        self.n.setdefault((context, prefix), [0, 0])[bit] += 1
                        if d:
                            self.children.setdefault((data[i - d + 1 : i], prefix), set()).add((context, prefix))

    def weighted(self, node):
        own = kt(*self.n[node])
        if len(node[0]) == ctw.DEPTH:
            return own
        return np.logaddexp(own, sum(map(self.weighted, self.children[node]))) - math.log(2)

    def ones(self, context, prefix, d=0):
        node = (context[len(context) - d :], prefix)
        if node not in self.n:
            return None
        a, b = self.n[node]
        own = (b + 0.5) / (a + b + 1)
        deeper = self.ones(context, prefix, d + 1) if d < ctw.DEPTH else None
        if deeper is None:
            return own
        w = 1 / (1 + math.exp(sum(map(self.weighted, self.children[node])) - kt(a, b)))
        return w * own + (1 - w) * deeper

    def log10(self, stream):
        data, total = ctw.END * ctw.DEPTH + stream, 0.0
        for i in range(ctw.DEPTH, len(data)):
            for k in range(8):
                p = self.ones(data[i - ctw.DEPTH : i], (1 << k) | (data[i] >> (8 - k)))
                p = 0.5 if p is None else p
                total += math.log10(p if data[i] >> (7 - k) & 1 else 1 - p)
        return total


def test_same_as_plain_recursion():
    rng = random.Random(1)
    streams = [" ".join(rng.choice("the of error nation été".split()) for _ in range(12)).encode() + b"\n" for _ in range(4)]
    trees, plain = ctw.ContextTrees(nodes_of(streams)), Plain(streams)
    scorer = ctw.Scorer(trees, {})
    for s in [*streams[:2], b"\n", b"the nation\n", b"zz q\n", "éé\n".encode()]:
        assert scorer.score([s])[0] == pytest.approx(plain.log10(s), rel=1e-4)


def test_each_byte_sums_to_one():
    trees = ctw.ContextTrees(nodes_of([b"abracadabra\n", b"abra cada\n"]))
    for context in (b"\n\n\n\n\n", b"abrac", b"xxxab"):
        gram = np.array([int.from_bytes(context + bytes([c]), "big") for c in range(256)], np.uint64)
        assert (10 ** trees.log10(gram)).sum() == pytest.approx(1, abs=1e-4)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 7.9, 8, 100.5, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_pieces_do_not_change_scores(monkeypatch):
    rng = random.Random(3)
    stream = bytes(rng.choice(b"abc ") for _ in range(5000)) + b"\n"
    trees = ctw.ContextTrees(nodes_of([stream]))
    whole = ctw.Scorer(trees, {}).score([stream, b"ab\n"])
    monkeypatch.setattr(ctw, "SLAB", 700)
    monkeypatch.setattr(ctw, "REMEMBERED", 64)
    assert np.allclose(ctw.Scorer(trees, {}).score([stream, b"ab\n"]), whole)


@pytest.mark.parametrize("frequent", [3, 1000])
def test_score_texts(spark, monkeypatch, frequent):
    monkeypatch.setattr(ctw, "WORDS", 5)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "B", "cc", "é", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \t\n"), (62, " \t\n"), (None, "a b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = ctw.score_texts(df, in_fold("doc_id", 5) != 1, frequent=frequent).collect()
    fold = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5
    tokens = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()] + ["\n"]
    counts = Counter(w for i, t in rows if fold(i) != 1 for w in tokens(t))
    total, norm = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    want = sorted((-1 if i is None else i, fold(i) == 1, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(sum(math.log10(counts[w] + 0.5) - norm for w in tokens(t)), 9)) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got) == want
    assert all(r.score < 0 for r in got)
    streams = [(" ".join(tokens(t)[:-1]) + "\n").encode() for i, t in rows if fold(i) != 1]
    scorer = ctw.Scorer(ctw.ContextTrees(nodes_of(streams)), {})
    by_id = {r.doc_id: r.score for r in got}
    for i, t in rows[:20]:
        assert by_id[i] == pytest.approx(scorer.score([(" ".join(tokens(t)[:-1]) + "\n").encode()])[0], rel=1e-5)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    (row,) = ctw.score_texts(df, F.lit(False)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (2, 0, 0)
    assert row.score == pytest.approx(3 * 8 * math.log10(0.5)) and row.base_score == pytest.approx(0.0)
    assert ctw.score_texts(df.limit(0), F.lit(True)).collect() == []


def test_nodes_that_shared_a_slot_stay_apart(spark, monkeypatch):
    """Random bytes reach more deep contexts than any table of fixed size holds apart; parts must not matter either."""
    monkeypatch.setattr(ctw, "PART_GRAMS", 500)
    monkeypatch.setattr(ctw, "SLAB", 700)
    monkeypatch.setattr(ctw, "BLOCK", 900)
    monkeypatch.setattr(ctw, "REPEATS", 64)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(400)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in ctw.score_texts(df, F.col("doc_id") < 9).collect()}
    streams = [(" ".join(t.split()) + "\n").encode() for t in texts]
    plain = Plain(streams[:9])
    plain.weighted = functools.cache(plain.weighted)
    for i in (0, 4, 9, 11):
        assert got[i] == pytest.approx(plain.log10(streams[i]), rel=1e-6)


def test_large_corpus_keeps_every_node():
    """More distinct nodes than the 4,194,304 slots that all depth-5 nodes once shared."""
    gram = np.unique(np.random.default_rng(7).integers(0, 1 << 48, 700_000, dtype=np.uint64))
    table = ctw.NodeTable()
    table.put(gram, np.ones(len(gram), np.int64))
    keys = table.leaves(list(range(8)))[0]
    want = np.unique(np.concatenate([(gram >> np.uint64(8) << np.uint64(8)) | prefix for prefix, _ in ctw.bits_of(gram)]))
    assert len(want) > 1 << 22 and np.array_equal(keys, want)
