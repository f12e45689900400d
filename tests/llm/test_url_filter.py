from hypothesis import given
from hypothesis import strategies as st
from oracle import compare

from casemill.llm import url_filter as U
from casemill.llm.registry import ORACLE, QUERIES

URLS = [
    "http://EXAMPLE.net/en/1", "https://a.b.example.net/de/x", "http://example.com/de/", "http://example.com/de", "http://notexample.com/de/1",
    "https://x.org/fr/2?q=/en/", "https://org/fr/", "ftp://net", "ftp://net/", "no scheme", "", None, "http://", "http:///path", "http://a.net?x/y",
    "http://a.net#x", "http://listed.com/a/b/", "https://www.listed.com:443/a/b", "http://listed.com/a/B", "://x.net/y://z", "http://a.net/p\nq",
]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    best = None
    for verdict, rule in U.RULES:
        name, slash, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_against_sql(spark, sf):
    assert compare(QUERIES["op1_url_filter"](spark, sf), ORACLE["op1_url_filter"], sf) == ""


def test_rules_and_list(spark):
    urls = spark.createDataFrame([(i, u, "mine") for i, u in enumerate([*URLS, *URLS])], "page_id bigint, url string, rule string")
    listed = spark.createDataFrame([("http://listed.com/a/b",), ("http://listed.com/a/b",), (None,), ("junk",)], "url string")
    rows = U.filter_urls(urls, listed).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path, rule = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1]), r.url
        on_list = r.url in ("http://listed.com/a/b/", "https://www.listed.com:443/a/b")
        assert r.listed == on_list
        assert r.verdict == (rule[0] if rule else "block" if on_list else "allow")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    some = spark.createDataFrame([(1, "http://a.com/x")], "page_id bigint, url string")
    assert U.filter_urls(none, some.select("url")).collect() == []
    assert [r.verdict for r in U.filter_urls(some, none.select("url")).collect()] == ["allow"]


def test_filter_has_no_false_negatives_and_few_false_hits(spark):
    from functools import reduce

    from pyspark.sql import functions as F

    n = 4000
    listed = spark.range(n).select(F.concat(F.lit("host/"), "id").alias("u"))
    table, blocks = U.bloom(listed, "u", n)
    probe = spark.range(2 * n).select("id", F.concat(F.lit("host/"), "id").alias("u"))
    joined = probe.join(table, U._block(F.col("u"), blocks) == F.col("block"), "left")
    hit = reduce(lambda a, b: a & b, ((F.col(f"w{i}").bitwiseAND(m) != 0) for i, m in enumerate(U._masks(F.col("u")))))
    rows = joined.select("id", F.coalesce(hit, F.lit(False)).alias("hit")).collect()
    assert all(r.hit for r in rows if r.id < n)
    assert sum(r.hit for r in rows if r.id >= n) < 0.05 * n


@given(st.lists(st.sampled_from(["a", "Z", ".", "/", "?", "#", "://", "net", "example.net", "en"]), max_size=8).map("".join))
def test_brute_force_is_sane(url):
    host, path, _ = brute(url)
    assert "/" not in host and "?" not in path
