import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlspike.operators import crawl, feed, joins, reviews, vectors


def test_time_window():
    at, now, day = dt.datetime(2024, 3, 5), dt.datetime(2024, 4, 1), dt.timedelta(days=1)
    assert joins.time_window(None, None, now) == (dt.datetime.min, now)
    assert joins.time_window(day, at, now) == (at - day, at) and joins.time_window(day, None, now) == (now - day, now)
    assert joins.time_window(at, day, now) == (at, at + day) and joins.time_window(at, at, now) == (at, at)
    for bad in ((day, day), (None, day), (at, at - day)):
        with pytest.raises(ValueError):
            joins.time_window(*bad, now)


def test_children_candidates_accounts(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    c = spark.createDataFrame([(1, "x"), (1, "x"), (3, "z"), (None, "n")], "k int, w string")
    assert sorted(map(tuple, joins.with_children(p, c, ["k"]).collect()), key=str) == sorted([(1, "a", "x"), (1, "a", "x"), (2, "b", None), (None, "n", None)], key=str)
    assert joins.with_children(p.limit(0), c, ["k"]).collect() == []
    refs, known = spark.createDataFrame([(1,), (1,), (2,), (3,)], "n int"), spark.createDataFrame([(1, "q"), (1, "p"), (2, "z"), (3, "q")], "n int, proj string")
    assert {tuple(r) for r in joins.first_candidate(refs, known, "n", "proj", ["p", "q"]).collect()} == {(1, "p"), (2, None), (3, "q")}
    acc = spark.createDataFrame([("A@x", "l2", None), ("a@X", "l1", "bot"), (None, "l3", "bot")], "email string, login string, kind string")
    rows = spark.createDataFrame([("a@x",), (None,), ("b@x",)], "e string")
    assert {tuple(r) for r in joins.with_account(rows, acc, "e", ["login", "kind"]).collect()} == {("a@x", "l1", "bot"), (None, "unknown", "unknown"), ("b@x", "unknown", "unknown")}


def test_deletions_and_cursors(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3), ("c", 5, None)], "k string, t long, v int").withColumn("deleted", F.lit(False))
    gone = joins.delete_entries(rows.filter("t > 1").drop("deleted"), ["k", "t", "v"], ["k"], F.col("k") == "a", "t", 9, "deleted")
    view = joins.timed_view(rows.unionByName(gone), ["k"], ["t"], "deleted")
    assert {tuple(r) for r in view.collect()} == {("b", 1, 3), ("c", 5, None)}
    again = spark.createDataFrame([("a", 10, 7, False)], "k string, t long, v int, deleted boolean")
    assert ("a", 10, 7) in {tuple(r) for r in joins.timed_view(rows.unionByName(gone).unionByName(again), ["k"], ["t"], "deleted").collect()}
    cur, marks = spark.createDataFrame([("a", 5), ("b", 7)], "k string, at long"), spark.createDataFrame([("a", 6), ("b", 1), ("c", 2)], "k string, at long")
    assert {tuple(r) for r in joins.mark_old(cur, marks, ["k"], "at").collect()} == {("a", 6), ("b", 7), ("c", 2)}
    assert {r.k for r in joins.mark_old(cur, marks, ["k"], "at", restart=F.col("k") == "b").collect()} == {"a", "c"}
    docs, vecs = spark.createDataFrame([("p/1",), ("q/1",), (None,)], "id string"), spark.createDataFrame([("p/1",), ("p/2",), ("q/1",)], "id string")
    left, kept = joins.cascade_delete(docs, vecs, "id", "id", "p/")
    assert {r.id for r in left.collect()} == {"q/1", None} and {r.id for r in kept.collect()} == {"p/2", "q/1"}


def test_newest_needs_report(spark):
    c = spark.createDataFrame([(1, 5), (1, 9), (2, 4), (3, 1)], "issue int, id int")
    done = spark.createDataFrame([(1, 9), (2, 3)], "issue int, id int")
    assert {tuple(r) for r in joins.newest_comment(c, ["issue"], "id", done).collect()} == {(2, 4), (3, 1)}
    b = spark.createDataFrame([(True, None), (False, True), (True, True)], "x boolean, y boolean").select(joins.needs([(1, F.col("x")), (4, F.col("y"))]).alias("n"))
    assert [r.n for r in b.collect()] == [1, 4, 5] and joins.run_report(c, ["issue"], F.col("id") > 4, F.lit(None).cast("boolean")).count() == 3


def test_ranges_beyond_a_broadcast(spark):
    rows = spark.range(400).select(F.col("id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k long"))
    ranges = [(i * 10, i * 10 + i % 7) for i in range(30)] + [(100, 180), (250, 240), (350, 350)]
    want = {k for k in range(400) if not any(lo <= k <= hi for lo, hi in ranges)} | {None}
    r = spark.createDataFrame(ranges, "lo long, hi long")
    for few in (1000, 3):
        assert {x.k for x in feed.outside(rows, "k", r, few).collect()} == want
    assert feed.outside(rows, "k", r.limit(0), 0).count() == 401


def test_next_entry(spark):
    log = [(t, t * 10 + k) for t in (3, 7, 7, 7, 20, 90) for k in (0, 1)] + [(None, 1)]
    asked = [0, 3, 6, 7, 8, 19, 20, 89, 90, 91, None, 7]
    got = feed.feed_time_after(spark.createDataFrame(log, "w long, m long"), spark.createDataFrame([(a,) for a in asked], "t long"), "w", "m", "t").collect()
    want = [(a, min(((w, m) for w, m in log if w is not None and a is not None and w > a), default=(0, None))[1]) for a in asked]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_queries_beyond_one_set(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "id long, vec array<float>")
    one = {(r.query, r.id, r.score) for r in vectors.batch_top_k(rows, rows, 3, 3).collect()}
    assert one == {(r.query, r.id, r.score) for r in vectors.batch_top_k(rows, rows, 3, 3, held=30).collect()} and len(one) == 180


def test_urls_and_questions(spark):
    urls = {"https://a/b": True, "mailto:x": False, "/a": False, "a b://c": False, "file:/x": True, "": False, None: False, "http://": False}
    d = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.x for r in d.select("u", vectors.is_url(F.col("u")).alias("x")).collect()} == urls
    store = spark.createDataFrame([("k1", [1.0, 2.0]), ("x" * 800, [3.0, 3.0])], "id string, vec array<float>")
    asked = spark.createDataFrame([(1, " k1 "), (2, "text"), (3, "  "), (4, None), (5, "x" * 800)], "query int, q string")
    got = {r.query: r.vec for r in vectors.resolve_queries(asked, store, lambda c: F.array(F.length(c).cast("float"))).collect()}
    assert got == {1: [1.0, 2.0], 2: [4.0], 5: [800.0]}


def test_account_stats_by_rights(spark):
    kind = "status string, owner_email string, submitter_email string, messages array<struct<author:string,real_author:string>>, revisions array<struct<number:int,commit_author:string>>, labels map<string,array<struct<email:string,value:int>>>"
    rows = [
        ("MERGED", "bot@x", "s@x", [("r@x", None), ("c@x", None), (None, None)], [(2, "d@x"), (1, "c@x")], {"Code-Review": [("v@x", 2), ("w@x", 1)]}),
        ("NEW", "o@x", None, [("o@x", "r@x"), ("o@x", None)], None, None),
        ("MERGED", None, None, None, [], {}),
    ]
    s = reviews.account_stats(spark.createDataFrame(rows, kind), spark.createDataFrame([("BOT@x",), (None,)], "email string"))
    got = {r.email: (r.commits, r.reviews, r.level) for r in s.withColumn("level", reviews.authority()).collect()}
    assert got == {"c@x": (1, 0, "contributor"), "s@x": (0, 0, "maintainer"), "r@x": (0, 2, "reviewer"), "v@x": (0, 0, "maintainer")}
    assert reviews.account_stats(spark.createDataFrame([], kind)).collect() == []


def test_crawl_goes_as_deep_as_links_do(spark):
    def fetch(todo):
        n = F.regexp_extract("url", r"(\d+)$", 1).cast("int")
        return todo.withColumn("html", F.when(n < 12, F.concat(F.lit('<a href="https://h/p'), (n + 1).cast("string"), F.lit('">x</a>'))).otherwise("end"))

    seeds = spark.createDataFrame([("https://h/p0",)], "url string")
    assert crawl.crawl(seeds, fetch, [("https://h/", True)]).count() == 13
    with pytest.raises(ValueError):
        crawl.crawl(seeds, fetch, [("https://h/", True)], max_rounds=3)
