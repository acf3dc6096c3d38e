import random

import pytest
from pyspark.sql import functions as F

from matweft.llm import entries, url_rules

RULES = "host string, path string, verdict string"
LOWER = str.maketrans(url_rules.UPPER, url_rules.LOWER)


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end].translate(LOWER), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, default)


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(k, u, "<p>", "k", "r", 1) for k, u in enumerate(urls)], "page_id bigint, url string, html string, key string, rule string, range int")
    return {r.page_id: tuple(r)[1:] for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, RULES), **more).collect()}


def test_nested_rules_match_brute_force(spark):
    rng = random.Random(5)
    labels, parts = ["a", "b", "ab", "a-b", "é", "z"], ["", "/", "/a", "/a/", "/a/b", "/ab", "/é", "//"]
    some = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5)))
    rules = list({(some(), rng.choice(parts)) for _ in range(120)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"{rng.choice(['http', 'ftp'])}://{some()}{rng.choice(parts)}{rng.choice(['', 'x', '/a', '?a=/a', '#://b'])}" for _ in range(3000)]
    got = judged(spark, urls, rules, default="block")
    assert got == {k: brute(u, rules, "block") for k, u in enumerate(urls)}
    assert len({v[2] for v in got.values()}) > 40


def test_odd_urls_and_rules(spark):
    rules = [("ORG", "/", "allow"), ("org", "/", "block"), ("a.org", None, "allow"), (None, "/", "block"), ("x.org", "/", None), ("b.org", "/é", "block")]
    plain = [("org", "/", "block"), ("a.org", "", "allow"), ("b.org", "/é", "block")]
    urls = [None, "", "://", "http:/x.org/", "x.org/", "HTTP://A.Org", "http://a.org?/b", "http://x.ORG:80/", "http://borg/", "http://.org/", "http://org./", "http://É.org/É", "http://b.org/é", "http://x.org/a\nb"]
    urls += ["http://" + "a." * 3000 + "org/" + "p/" * 5000, "http://x.org/a://b.org/", "http://x.org/"] + ["http://same.org/"] * 50
    assert judged(spark, urls, rules) == {k: brute(u, plain) for k, u in enumerate(urls)}


def test_repeated_rows_and_no_rows(spark):
    pages = spark.createDataFrame([(None, "http://a.b/c"), (1, "http://a.b/c"), (1, "http://a.b/c"), (1, None)], "page_id bigint, url string")
    rules = spark.createDataFrame([("b", "/", "block")], RULES)
    got = sorted(map(tuple, url_rules.judge_urls(pages, rules).collect()), key=str)
    assert got == [(1, "", "", None, "allow"), (1, "a.b", "/c", "b/", "block"), (1, "a.b", "/c", "b/", "block"), (None, "a.b", "/c", "b/", "block")]
    assert url_rules.judge_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_ranges_do_not_matter(spark):
    keys = [bytes(f"{a}/{b}", "utf8") for a in "abcdefgh" for b in ("", "a", "ab", "abc", "b", "bb")]
    starts = [b"", b"a", b"a/", b"a/a", b"a/ab", b"c/", b"c/b", b"h/abc"]
    want = {k: max((s for s in starts if k.startswith(s)), key=len) for k in keys}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rules = spark.createDataFrame([(bytearray(s), bytearray(s)) for s in starts], "start binary, rule binary")
            found = url_rules.sweep(spark.createDataFrame([(bytearray(k),) for k in keys], "key binary"), rules)
            assert {bytes(r.key): bytes(r.rule) for r in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("native", ["Python", "Arrow", "Pandas"])
def test_query_runs_no_python(spark, tiny, native):
    found = entries.op12_url_rules(spark, tiny)
    assert native not in found._jdf.queryExecution().executedPlan().toString()
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "url").collect()}
    assert {r.page_id: tuple(r)[1:] for r in found.select("page_id", "host", "path", "rule", "verdict").collect()} == {k: brute(u, rules) for k, u in urls.items()}
    assert found.where(F.col("rule").isNotNull()).count()
