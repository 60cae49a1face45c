"""The queries on the smallest real tables: held-out accuracy, exact texts, recall, and score quality."""

import re
from html import unescape

import numpy as np
import pytest

from lodekv.llm.queries import QUERIES
from lodekv.runtime import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark):
    def rows(name):
        return QUERIES[name](spark, SF).collect()

    return rows


def test_languages(spark, result):
    want = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    got = result("op1_langid")
    held = [r for r in got if r.held_out]
    assert len(got) == len(want) and 20 < len(held) < len(got)
    assert sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and sum(r.accepted for r in got) >= len(got) - 1


def test_page_texts(spark, result):
    got = {r.page_id: r for r in result("op8_html")}
    for page in table(spark, SF, "pages").collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", page.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


def test_neighbours(spark, result):
    rows = table(spark, SF, "embeddings").collect()
    fine = [r for r in rows if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)]
    ids, x = np.array([r.vec_id for r in fine]), np.array([r.embedding for r in fine], float)
    got = {}
    for r in result("op5_ann"):
        got.setdefault(r.query_id, []).append(r)
    queries = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(got) == sorted(queries)
    hits = 0
    for q in queries:
        scores = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -scores))].tolist() if i != q][:20]
        hits += len({r.vec_id for r in got[q]} & set(best))
        for r in got[q]:
            assert r.score == pytest.approx(scores[ids == r.vec_id][0], rel=1e-12)
    assert hits / (20 * len(queries)) >= 0.9


def test_scores(result):
    rows = result("op7_ctw")
    held = [r for r in rows if r.held_out]
    assert 0 < len(held) < len(rows) and len({r.train_tokens for r in rows}) == 1
    assert all(r.n_known == r.n_tokens for r in rows if not r.held_out)
    bits = -sum(r.score for r in held) * np.log2(10)
    assert bits / sum(r.n_tokens for r in held) < 20  # a word of six letters in 2.3 to 3 bits a byte
