import difflib
import random

import pytest
from pyspark.sql import functions as F

from marlspike.functions import text as tx
from marlspike.operators import docs as dp
from marlspike.operators import feed, reviews, vectors
from marlspike.operators.ordered import running_sum


def test_range_scan_and_ops(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    assert [r.k for r in feed.range_scan(df, "k", 3, 6).collect()] == [3, 4, 5, 6]
    assert [r.k for r in feed.range_scan(df, "k", 17).collect()] == [17, 18, 19]
    with pytest.raises(ValueError):
        feed.range_scan(df, "k", None, 3)
    ops = spark.createDataFrame([("a", 1, "set", "x"), ("a", 2, "delete", None), ("b", 1, "delete", None), ("b", 2, "set", "y"), ("c", 1, "set", None)], "k string, seq int, op string, v string")
    assert sorted(map(tuple, feed.apply_ops(ops, "k", ["seq"], F.col("op") == "delete", "v").collect())) == [("b", "y"), ("c", None)]
    assert feed.delete_range(df, "k", 5, 19).count() == 5


def test_overlay_equals_plain_table(spark):
    rnd = random.Random(1)
    base = {k: k for k in range(50)}
    over = {k: -k for k in rnd.sample(range(60), 12)}
    points, ranges = rnd.sample(range(50), 5), [(10, 14), (40, 60)]
    want = {k: v for k, v in base.items() if k not in points and not any(a <= k <= b for a, b in ranges)} | over
    mk = lambda d: spark.createDataFrame(list(d.items()), "k int, v int")
    got = feed.overlay_read(mk(base), mk(over), "k", spark.createDataFrame([(p,) for p in points], "k int"), spark.createDataFrame(ranges, "lo int, hi int"))
    assert dict(map(tuple, got.collect())) == want


def test_snapshot_diff_and_changed_docs(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (5, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, None), (5, None)], "k int, v string")
    assert sorted(map(tuple, feed.snapshot_diff(a, b, "k", ["v"]).collect())) == [(2, "set"), (3, "delete"), (4, "set")]
    assert sorted(r.k for r in feed.changed_docs(a, b, "k", ["v"]).collect()) == [2, 4]


def test_feed_time_after(spark):
    day = 86_400_000_000
    log = spark.createDataFrame([(day + 5, 1), (day + 9, 2), (4 * day, 3), (None, 9)], "wall bigint, m bigint")
    asked = [0, day + 4, day + 5, day + 9, 2 * day, 4 * day, 9 * day]
    got = feed.feed_time_after(log, spark.createDataFrame([(x,) for x in asked], "q bigint"), "wall", "m", "q").collect()
    assert {r.q: r.feed_time for r in got} == {0: 1, day + 4: 1, day + 5: 2, day + 9: 3, 2 * day: 3, 4 * day: None, 9 * day: None}


def test_running_sums_of_a_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"), F.xxhash64("id").alias("k"), (F.col("id") % 7 - 3).alias("v"))
    got = running_sum(rows, ["g"], ["k"], F.col("v"), "s").toPandas().fillna({"g": "?"}).sort_values(["g", "k"])
    assert (got.groupby("g")["v"].cumsum() == got["s"]).all() and len(got) == 3000
    assert running_sum(rows.limit(0), ["g"], ["k"], F.col("v"), "s").collect() == []


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0]), (4, [1.0]), (5, None), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, vec array<float>")
    assert [(r.id, r.score) for r in vectors.top_k(df, [1.0, 0.0], 3).collect()] == [(3, 1.0), (1, 1.0), (2, pytest.approx(0.6))]
    hits = vectors.top_k(df, [1.0, 0.0], 3)
    assert [r.id for r in vectors.drop_first_self(hits, 3, 5).collect()] == [1, 2]
    assert [r.id for r in vectors.drop_first_self(hits, 1, 2).collect()] == [3, 1]
    got = vectors.batch_top_k(df, df.filter("id < 3"), 2, 2).collect()
    assert sorted((r.query, r.id) for r in got) == [(1, 1), (1, 3), (2, 2), (2, 3)]
    n = df.filter("id = 2").select(vectors.normalize(F.array(F.lit(3.0).cast("float"), F.lit(4.0).cast("float"))).alias("v")).first().v
    assert n == pytest.approx([0.6, 0.8])
    assert vectors.unquote(spark.range(1).select(vectors.quote_embed(F.lit("héllo")).alias("v")).first().v) == "héllo"
    with pytest.raises(ValueError):
        vectors.search(df, [1.0], threshold=2)


def test_docs(spark):
    schema = "instance string, project string, number bigint, subject string, description string, messages array<struct<author:string,real_author:string,date:timestamp_ntz,message:string>>"
    import datetime as dt

    t = [dt.datetime(2024, 1, d) for d in (2, 1, 2)]
    c = spark.createDataFrame([("i", "p", 1, None, " d ", [("a", None, t[0], "second "), ("b", None, t[1], "first"), ("c", None, t[2], "third")]), ("i", "p", 2, "s", None, None), (None, "p", 3, "s", "x", None)], schema)
    got = {r.id: (r.title, r.text) for r in dp.change_docs(c).collect()}
    assert got == {"https://i/c/p/+/1#related-content": ("", "d\n\nfirst\n\nsecond\n\nthird"), "https://i/c/p/+/2#related-content": ("s", "")}
    a = spark.createDataFrame([("u", "one", "x")], "id string, title string, text string")
    b = spark.createDataFrame([("u", "two", "y"), ("v", "two", "z")], "id string, title string, text string")
    assert sorted(map(tuple, dp.corpus(a, b).collect())) == [("u", "one", "x"), ("v", "two", "z")]


def test_scores_and_categories(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 1, True), (3, None, False)], "id int, n int, draft boolean")
    s = reviews.score(df, [("big", 2, F.col("n") > 3), ("any", 1, F.col("n") > 0)], [("draft", F.col("draft"))])
    assert sorted((r.id, r.total, r.applied) for r in s.collect()) == [(1, 3.0, ["big", "any"]), (3, 0.0, [])]
    assert [r.c for r in df.orderBy("id").select(reviews.categorize([("big", F.col("n") > 3), ("some", F.col("n") > 0)]).alias("c")).collect()] == ["big", "some", "Remainder"]


def test_urls(spark):
    urls = ["https://h/a", "https://h/ab", "https://h/a?x", "https://h/a/b", "http://x"]
    got = tx.url_allowed(spark.createDataFrame([(u,) for u in urls], "url string"), [("https://h/a", True), ("https://h/a/", False), ("https://h/a/", True)])
    assert [r.allowed for r in got.collect()] == [True, False, True, True, False]
    r = spark.range(1).select(tx.issue_ref(F.lit("https://h/issues/o/p/issues/12#c")).alias("r")).first().r
    assert (r.project, r.number) == ("o/p", 12)


def test_html():
    page = "<h1 id=a>One</h1><p>first &amp; text<h2 id='b'>Two</h2>more<script>no</script><h2>No id</h2>lost<h1 id=c>New</h1>end"
    assert [(s["title"], s["id"], s["text"]) for s in tx.split_sections(page)] == [("One", "a", "first & text"), ("One > Two", "b", "more"), ("New", "c", "end")]
    assert tx.split_sections(None) == []
    assert tx._links('<a href="/x">1</a><a href="#f">2</a><a href="">3</a><a href="y?z">4</a>', "https://h/d/e") == ["https://h/x", "https://h/d/y?z"]


def test_fixes():
    rules = [("link", r"\bo/p#(\d+)", r"https://h/\1"), ("text", "colour", "color"), ("url", "http://", "https://")]
    assert tx.fix_text("see o/p#7 `o/p#8` colour http://x [c](http://y) ", rules) == "see [o/p#7](https://h/7) `o/p#8` color https://x [c](https://y) "
    assert tx.fix_text("nothing", rules) is None and tx.fix_text(None, rules) is None


def apply_diff(old: str, diff: str) -> str:
    a, out, i = old.splitlines(keepends=True), [], 0
    lines = diff.splitlines(keepends=True)[2:]
    for n, line in enumerate(lines):
        if line.startswith("@@"):
            start, _, count = line.split()[1][1:].partition(",")
            at = int(start) - (count != "0")
            out += a[i:at]
            i = at
        elif line.startswith("\\"):
            out[-1:] = [out[-1].removesuffix("\n")] if lines[n - 1][0] != "-" else out[-1:]
        elif line[0] == "+":
            out.append(line[1:])
        else:
            assert a[i].rstrip("\n") == line[1:].rstrip("\n")
            if line[0] == " ":
                out.append(line[1:])
            i += 1
    return "".join(out + a[i:])


def test_diff_applies():
    rnd = random.Random(5)
    assert tx.anchored_diff("a\n", "a\n") == ""
    for _ in range(300):
        a = [rnd.choice("abcdefgh") + "\n" for _ in range(rnd.randrange(25))]
        b = [x for x in a if rnd.random() > 0.2]
        for _ in range(rnd.randrange(4)):
            b.insert(rnd.randrange(len(b) + 1), rnd.choice("abxyz") + "\n")
        if a != b:
            assert apply_diff("".join(a), tx.anchored_diff("".join(a), "".join(b))) == "".join(b)
    d = tx.anchored_diff("".join(f"{i}\n" for i in range(30)), "".join(f"{i}\n" for i in range(30) if i not in (3, 25)))
    assert d.count("@@ -") == 2 and len(d.splitlines()) == len(list(difflib.unified_diff([f"{i}\n" for i in range(30)], [f"{i}\n" for i in range(30) if i not in (3, 25)])))


def test_wrapping(spark):
    d = spark.range(1).select(tx.wrap(F.lit("body\ntext"), "m", F.lit('{"a":1}')).alias("w")).select(tx.unwrap(F.col("w")).alias("u"), tx.unwrap_all(F.concat(F.lit("x"), "w")).alias("r")).first()
    assert tuple(d.u) == ("m", '{"a":1}', "body\ntext") and d.r == "x"
    assert spark.range(1).select(tx.strip_comments(F.lit("a<!-- x\n -->b<!--c-->")).alias("s")).first().s == "ab"
