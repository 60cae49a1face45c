"""Held-out accuracy, probabilities that sum to one, rejection, and the defined edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodekv.llm import langid

WORDS = {"aa": "the and of thing error nation with from this that".split(), "bb": "der und die ung schen für über nicht ver ein".split(), "cc": "le la que été ment çon pour avec dans une".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", rng.choice(WORDS[lang])]) for _ in range(n))


@pytest.fixture(scope="module")
def models():
    rng = random.Random(1)
    return langid.LanguageModels({k: [text(rng, k, 60) for _ in range(60)] for k in WORDS})


def test_accuracy(models):
    rng, of = random.Random(2), langid.Identifier(models)
    for k in WORDS:
        for _ in range(50):
            lang, score, _, accepted = of(text(rng, k, 40))
            assert lang == k and 0.5 < score <= 1 and accepted


def test_texts_shorter_than_the_order(models):
    of = langid.Identifier(models)
    for t in ("a", "É", "in", "of x", " q ", "1a2"):
        lang, score, entropy, _ = of(t)
        assert lang in WORDS and 0 < score <= 1 and entropy > 0
        assert all(len(h) == len(langid.symbols(t)) for h in langid.gram_hashes(langid.symbols(t), langid.ORDER))


def test_rejects_what_is_no_language(models):
    rng, of = random.Random(3), langid.Identifier(models)
    for _ in range(20):
        noise = "".join(rng.choice("qxzjkwv") for _ in range(300))
        assert not of(noise)[3]


def test_distribution_sums_to_one(models):
    model = models.models[0]
    context = langid.symbols("then")[:-1]
    alphabet = sorted({int(c) for w in WORDS["aa"] for c in langid.symbols(w)})
    points = np.array([[*context, c] for c in alphabet], np.uint32)
    p = 0.0
    for row in points:
        hashes = langid.gram_hashes(row, langid.ORDER)
        at = np.array([len(row) - 1])
        p += float(np.exp(model.log_probability([h[at] for h in hashes], [np.zeros(1, np.uint64), *(h[at - 1] for h in hashes[: langid.ORDER - 1])]))[0])
    assert 0.97 < p <= 1.0001


def plain_kneser_ney(samples, order):
    """log P(character | the characters before) by dictionaries, straight from the formulas."""
    counts = [{} for _ in range(order + 1)]
    for s in samples:
        for n in range(1, order + 1):
            for i in range(n, len(s) + 1):
                counts[n][s[i - n : i]] = counts[n].get(s[i - n : i], 0) + 1
    for n in range(1, order):
        kinds = {}
        for g in counts[n + 1]:
            kinds[g[1:]] = kinds.get(g[1:], 0) + 1
        counts[n] = {g: max(1, kinds.get(g, 0)) for g in counts[n]}  # a gram at the head of a text alone follows one of them
    totals, after, discount = [{} for _ in range(order + 1)], [{} for _ in range(order + 1)], [0.0] * (order + 1)
    for n in range(1, order + 1):
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        discount[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        for g, c in counts[n].items():
            totals[n][g[:-1]] = totals[n].get(g[:-1], 0) + c
            after[n][g[:-1]] = after[n].get(g[:-1], 0) + 1
    uniform = 1 / (max(2, len(counts[1])) + 1 + 1000)

    def p(context, c, n):
        if not n:
            return uniform
        h = context[len(context) - n + 1 :] if n > 1 else ""
        below = p(context, c, n - 1)
        if h not in totals[n]:
            return below
        return max(0.0, counts[n].get(h + c, 0) - (discount[n] if h + c in counts[n] else 0)) / totals[n][h] + discount[n] * after[n][h] / totals[n][h] * below

    return lambda context, c: np.log(p(context, c, min(order, len(context) + 1)))


def test_against_plain_kneser_ney():
    rng = random.Random(8)
    for lang in WORDS:
        samples = ["".join(map(chr, langid.symbols(text(rng, lang, 25)))) for _ in range(6)]
        model = langid.KneserNey([np.array(list(map(ord, s)), np.uint32) for s in samples])
        plain = plain_kneser_ney(samples, langid.ORDER)
        for other in [text(rng, lang, 20), text(rng, "aa", 10), "zzz über zebra"]:
            points = langid.symbols(other)
            hashes = langid.gram_hashes(points, langid.ORDER)
            at = np.arange(langid.ORDER - 1, len(points))
            got = model.log_probability([h[at] for h in hashes], [np.zeros(len(at), np.uint64), *(h[at - 1] for h in hashes[: langid.ORDER - 1])])
            s = "".join(map(chr, points))
            assert np.allclose(got, [plain(s[i - langid.ORDER + 1 : i], s[i]) for i in at], atol=1e-5)


@pytest.mark.parametrize("slab", [1, 7, 500, 100_000])
def test_size_of_pieces_changes_nothing(models, monkeypatch, slab):
    rng = random.Random(9)
    for t in (text(rng, "bb", 400).replace(" ", ""), " 12 ".join(["ΟΔΟΣ", "x", "İi", "e\u0301 Σ"] * 90), "12" * 300 + "Q" + "  " * 300, "z"):
        points = np.concatenate([*langid.pieces(t, slab)])
        assert np.array_equal(points, langid.symbols(t))
        whole, n = langid.Coder(models).totals(t)
        monkeypatch.setattr(langid, "SLAB", slab)
        parts, m = langid.Coder(models).totals(t)
        monkeypatch.undo()
        assert n == m == len(points) - 1 and np.allclose(whole, parts, rtol=1e-4)


@pytest.mark.parametrize("parts", [1, 4])
def test_copies_do_not_displace_other_texts(spark, parts):
    rng = random.Random(10)
    texts = [text(rng, "aa", 30) + str(i) for i in range(400)]
    df = spark.createDataFrame([("aa", t) for t in texts], "lang string, text string")
    first = langid.sample(df, "lang", "text", docs=20, chars=2000)["aa"]
    for copied in (first[0], texts[0]):
        more = df.unionByName(spark.range(3000).selectExpr("'aa' AS lang").withColumn("text", F.lit(copied)))
        assert langid.sample(more.repartition(parts), "lang", "text", docs=20, chars=2000)["aa"] == first and len(first) == 20


def test_pieces_and_memory_do_not_change_totals(models, monkeypatch):
    rng = random.Random(4)
    long = text(rng, "bb", 3000)
    whole, n = langid.Coder(models).totals(long)
    monkeypatch.setattr(langid, "SLAB", 500)
    parts, m = langid.Coder(models, remembered=1 << 12).totals(long)
    assert n == m and np.allclose(whole, parts, rtol=1e-4)


def test_edges(spark, models):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, text(random.Random(5), "cc", 30), "x"), (4, "́", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {(r.doc_id, r.lang_pred, r.accepted) for r in langid.identify(df, models).collect()}
    assert got == {(1, "und", False), (2, "und", False), (3, "und", False), (4, "cc", True), (4, "und", False)}
    assert langid.identify(df, models).columns == ["doc_id", "text", "lang_pred", "score", "cross_entropy", "accepted"]


def test_sample_is_bounded_and_empty_tables_work(spark):
    rng = random.Random(6)
    rows = [(k, text(rng, k, 50)) for k in WORDS for _ in range(40)] + [(None, "x"), ("dd", None), ("dd", "")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = langid.sample(df, "lang", "text", docs=10, chars=100)
    assert set(got) == set(WORDS) and all(0 < len(v) <= 10 and all(len(t) <= 100 for t in v) for v in got.values())
    none = langid.fit(df.limit(0))
    assert [r.lang_pred for r in langid.identify(df.limit(2), none).collect()] == ["und", "und"]
