"""Token columns on awkward tables, and the pipeline against its parts done plainly."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodekv.llm import bpe, decontaminate, langid, simhash, token_count
from lodekv.runtime import table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_token_columns(spark):
    library = Tokenizer.from_file(PATH)
    texts = [None, "", "Hello  World<|endoftext|>", "é" * 5000, "a b " * 20000, "x"]
    df = spark.createDataFrame([(i // 2, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(2)
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i // 2, len((t or "").encode()), len(ids), len(ids) > 2048, hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    counted = sorted(map(tuple, token_count.token_counts(df, keep=["doc_id"]).collect()))
    assert counted == sorted(w[:4] for w in want)
    coded = bpe.encode_decode(df)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded.collect()) == sorted((w[0], w[2], w[4], w[5]) for w in want)
    assert all(library.decode(r.ids, skip_special_tokens=False) == r.decoded for r in coded.collect())
    assert token_count.token_counts(df.limit(0)).collect() == [] and bpe.encode_decode(df.limit(0)).collect() == []


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    of = langid.Identifier(langid.fit(docs))
    left = {i for i, r in rows.items() if of(r.text)[3]}
    fps = {i: simhash.fingerprint(rows[i].text.encode()) for i in left}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in left:
        for b in left:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {i for i in left if find(i) == i}
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    windows = {}
    for i, t in items.items():
        for w in decontaminate.windows_of(decontaminate.words_of(t.encode()), 13):
            windows.setdefault(w, i)
    widths = {w.count(b" ") + 1 for w in windows}

    def clean(text):
        words = decontaminate.words_of(text.encode())
        hit = {j for n in widths for i in range(len(words) - n + 1) if b" ".join(words[i : i + n]) in windows for j in range(i, i + n)}
        return not hit or 20 * len(hit) < len(words)

    left = {i for i in left if clean(rows[i].text)}
    assert set(got) == left
    library = Tokenizer.from_file(PATH)
    for i in sorted(left)[:40]:
        assert got[i].n_tokens == len(library.encode(rows[i].text, add_special_tokens=False).ids)


def test_stages_on_awkward_documents(spark):
    rows = [(1, None, None), (2, "", "en"), (None, "the of and " * 30, "en"), (3, "the of and " * 30, "en"), (3, "the of and " * 30, "en"), (4, "123 456", None)]
    docs = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, accepted int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, SF)
            assert out.columns == docs.columns, name
            out.collect()
    assert docs.where("doc_id = 3").count() == 2 and simhash.keep_one_of_each(docs).where(F.col("doc_id") == 3).count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 6
