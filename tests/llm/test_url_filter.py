"""Verdicts against plain Python, exact cascades, and the defined edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodekv.llm import url_filter as u

BLOCK, ALLOW = ["net/", "example.com/de/", "a.b.c/x", "tie.net/"], ["example.net/en/", "org/fr/", "b.c/"]


def plain(url, block=BLOCK, allow=ALLOW):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for rule in [*block, *allow]:
        rhost, rpath = u.split_rule(rule)
        if (host == rhost or host.endswith("." + rhost)) and path.startswith(rpath) and (best is None or (len(rule), len(rhost)) > (len(best), len(u.split_rule(best)[0]))):
            best = rule
    return host, path, best, "allow" if best is None or best not in block else "block"


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "https://m.Example.NET/en/25#top", "http://example.net/de/", "http://example.com/de", "http://example.com/de/1?x=/fr/",
    "http://x.org/fr/", "http://org/fr/a", "http://xorg/fr/", "a://b://c/d", "http://a.b.c/xyz", "http://z.a.b.c/y", "http://b.c", "http://tie.net/en/", "http://.net/", "http://net./", "http://u@net:80/", "http://é.net/É", "x://a.net?q/", "http://a.net\n/b",
]


def test_verdicts(spark):
    rng = random.Random(1)
    urls = URLS + [f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['example', 'other', 'b'])}.{rng.choice(['net', 'com', 'org', 'c'])}/{rng.choice(['en', 'de', 'fr'])}{rng.choice(['', '/', '/1'])}" for _ in range(200)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.filter_urls(df, BLOCK, ALLOW).collect()}
    assert got == {i: plain(x) for i, x in enumerate(urls)}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = u.filter_urls(df, BLOCK, ALLOW)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)


@pytest.mark.parametrize("max_bits", [u.MAX_BITS, 2048])
def test_cascade_is_exact(spark, max_bits):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    filters = u.SlicedCascade.build(keys, "listed", max_bits)
    assert keys.where(filters.contains(F.col("key")) != F.col("listed")).count() == 0
    assert len(filters.parts) == 1 or max_bits < u.MAX_BITS
    assert len(filters.parts[0].levels) > 1


def test_edges(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in u.filter_urls(df, [], []).collect()] == [(None, "allow")] * 2
    assert [(r.rule, r.verdict) for r in u.filter_urls(df, ["net/"], ["net/"]).collect()] == [("net/", "block")] * 2
    assert u.filter_urls(df.limit(0), BLOCK, ALLOW).collect() == []


def test_long_urls_and_clashing_names(spark):
    tail = "a/" * 200_000
    rows = [(1, "http://x.org/fr/" + tail, "old"), (2, "http://" + "s." * 50_000 + "net/" + tail, "old")]
    got = u.filter_urls(spark.createDataFrame(rows, "page_id long, url string, Verdict string"), ["net/"], ["org/fr/"])
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    found = {r.page_id: (len(r.host), len(r.path), r.rule, r.verdict) for r in got.collect()}
    assert found == {1: (5, 4 + len(tail), "org/fr/", "allow"), 2: (100_003, 1 + len(tail), "net/", "block")}
