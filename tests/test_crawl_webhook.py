import hashlib
import hmac

from pyspark.sql import functions as F

from marlspike.operators.crawl import cached_flag, crawl
from marlspike.sources.webhook import dispatch, verified

SITE = {
    "https://h/a": '<a href="b">x</a><a href="/c#f">y</a><a href="https://other/z">z</a>',
    "https://h/b": '<a href="/a">back</a><a href="/d?q=1">d</a>',
    "https://h/c": None,
    "https://h/d": '<a href="/old">o</a><a href="/secret/x">s</a>',
    "https://h/old": "never",
    "https://h/secret/x": "never",
}


def test_crawl(spark):
    pages = spark.createDataFrame(list(SITE.items()), "url string, html string")
    known = spark.createDataFrame([("https://h/old", 95), ("https://h/b", 5)], "url string, last_crawl bigint")
    seeds = spark.createDataFrame([("https://h/a",), ("https://h/a#top",), (None,)], "url string")
    got = crawl(seeds, lambda d: d.join(pages, "url", "left"), [("https://h/", True), ("https://h/secret/", False)], known, now=100, recrawl=50)
    assert sorted((r.url, r.round, r.from_url) for r in got.collect()) == [("https://h/a", 0, None), ("https://h/b", 1, "https://h/a"), ("https://h/c", 1, "https://h/a"), ("https://h/d", 2, "https://h/b")]
    assert crawl(seeds.limit(0), lambda d: d.join(pages, "url", "left"), []).count() == 0


def test_flags(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    flags = spark.createDataFrame([(1, False, 90), (2, False, 10)], "k int, ok boolean, computed bigint")
    got = cached_flag(rows, flags, ["k"], "ok", now=100, ttl=50).orderBy("k").collect()
    assert [(r.ok, r.stale) for r in got] == [(False, False), (False, True), (True, True)]


def test_webhook(spark):
    body = '{"action": "opened", "issue": {"number": 7}, "repository": {"full_name": "o/p"}}'
    sign = lambda b, s="k": "sha256=" + hmac.new(s.encode(), b.encode(), hashlib.sha256).hexdigest()
    rows = [("issues", sign(body), body), ("issues", sign(body, "x"), body), ("issue_comment", None, body), ("push", sign(body), body), ("issues", sign("{"), "{"), ("issues", "s", None)]
    good = verified(spark.createDataFrame(rows, "kind string, signature string, body string"), "k")
    assert good.count() == 3
    assert [(r.api, r.action, r.project, r.issue) for r in dispatch(good).collect()] == [("/issues", "opened", "o/p", 7)]
    assert dispatch(good.filter(F.lit(False))).collect() == []
