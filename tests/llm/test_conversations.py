import random

from pyspark.sql import functions as F

from marlspike.llm import conversations as conv

SCHEMA = "ch string, id bigint, parent bigint, at bigint, role string"


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = []
    for ch, rs in by.items():
        ids = {r[1]: r for r in rs}
        if any(r[3] is None or (r[2] is not None and (r[2] not in ids or ids[r[2]][3] is None or ids[r[2]][3] > r[3])) for r in rs):
            continue
        if not any(r[4] in ("maintainer", "participant") for r in rs):
            continue
        kids = {}
        for r in rs:
            kids.setdefault(r[2], []).append(r)
        order, todo = [], [None]
        while todo:
            p = todo.pop()
            if p is not None:
                order.append(p)
            todo += sorted(kids.get(p[1] if p else None, []), key=lambda r: (r[3], r[1]), reverse=True)
        if len(order) == len(rs):
            out += [(ch, i + 1, r[1], r[4]) for i, r in enumerate(order)]
    return sorted(out)


def run(spark, rows):
    got = conv.conversations(spark.createDataFrame(rows, SCHEMA).withColumn("login", F.lit("x")), ["ch"])
    return sorted((r.ch, r.turn_no, r.id, r.role) for r in got.collect())


def test_random_trees(spark):
    rnd = random.Random(3)
    rows, n = [], 0
    for c in range(60):
        ids, t = [], 0
        for _ in range(rnd.randrange(1, 25)):
            t += rnd.choice([0, 0, 1])
            parent = rnd.choice([None, *ids[-3:]]) if rnd.random() > 0.02 else 10**6
            rows.append((f"c{c}", n, parent, t if rnd.random() > 0.01 else None, rnd.choice(["asker", "participant", "bot", "maintainer"])))
            ids.append(n)
            n += 1
    assert run(spark, rows) == brute(rows)


def test_deep_chain_ring_and_unanswered(spark):
    chain = [("deep", i, i - 1 if i else None, 5, "participant") for i in range(150)]
    ring = [("ring", 1000 + i, 1000 + (i + 1) % 3, 5, "participant") for i in range(3)] + [("ring", 1003, 1000, 5, "asker"), ("ring", 1004, None, 1, "asker")]
    lone = [("lone", 2000, None, 1, "asker"), ("lone", 2001, 2000, 2, "bot")]
    self_ = [("self", 3000, 3000, 1, "participant")]
    rows = chain + ring + lone + self_
    assert run(spark, rows) == brute(rows) == [("deep", i + 1, i, "participant") for i in range(150)]


def test_empty(spark):
    assert run(spark, []) == []


def test_links(spark):
    urls = ["https://forge.example/O/p/discussions/7", "http://forge.example/o/p//discussions/7/", "https://api.forge.example/repos/o/p/discussions/7", "https://FORGE.EXAMPLE/o/p/discussions/7?sort=x#y", "https://forge.example/o/p/issues/7", "", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(conv.discussion_project(F.col("u")).alias("p"), conv.discussion_number(F.col("u")).alias("n")).collect()
    assert [(r.p, r.n) for r in got] == [("o/p", 7)] * 4 + [(None, None)] * 3
    replies = [("#discussioncomment-9", 9), ("https://h/o/p/discussions/7?x#discussioncomment-9", 9), ("https://h/o/p/discussions/7", None), ("", None), (" \t", None), (None, None), ("junk", -1)]
    got = spark.createDataFrame([(u,) for u, _ in replies], "u string").select(conv.reply_target(F.col("u")).alias("t")).collect()
    assert [r.t for r in got] == [t for _, t in replies]


def test_blank(spark):
    texts = [None, "", " \t\r\n", chr(160) + chr(0x2003), "x", " x "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(conv.blank(F.col("t")).alias("b")).collect()
    assert [r.b for r in got] == [True, True, True, True, False, False]


def test_sessions(spark):
    rnd = random.Random(9)
    gap, rows, want = 100, [], {}
    for c in range(8):
        t, s = rnd.randrange(1000), 1
        for i in range(80):
            rows.append((f"c{c}", c * 1000 + i, t))
            want[c * 1000 + i] = s
            d = rnd.choice([0, 1, 50, 99, 100, 101, 250])
            t += d
            s += d > gap
    rnd.shuffle(rows)
    got = conv.sessionize(spark.createDataFrame([*rows, ("c0", -1, None)], "ch string, id bigint, at bigint"), ["ch"], gap).collect()
    assert {r.id: r.session_no for r in got} == want | {-1: None}


def test_gap(spark):
    m = spark.createDataFrame([("a", 1, None, 0), ("a", 2, 1, 9 * 3_600_000_000)], "ch string, id bigint, parent bigint, at bigint")
    assert conv.calibrate_gap(m, ["ch"]) == 9 * 3_600_000_000
    assert conv.calibrate_gap(m.limit(0), ["ch"]) == 3_600_000_000


def test_ranks_of_a_hot_channel(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string"))).alias("ch"), F.xxhash64("id").alias("k"))
    got = conv.rank_in(rows, ["ch"], ["k"], "n").toPandas()
    want = got.sort_values(["ch", "k"]).groupby("ch").cumcount() + 1
    assert (want.reindex(got.index) == got["n"]).all() and len(got) == 5000


def test_reciprocal_sessions_with_missing_authors(spark):
    rows = [
        ("known", 1, None, "a"), ("known", 2, 1, "b"),
        ("null replies", 3, None, "a"), ("null replies", 4, 3, None),
        ("null is answered", 5, None, None), ("null is answered", 6, 5, "a"),
        ("both null", 7, None, None), ("both null", 8, 7, None),
        ("own reply", 9, None, "a"), ("own reply", 10, 9, "a"),
        ("no reply", 11, None, "a"), ("no reply", 12, None, None),
        ("parent elsewhere", 13, 1, "a"),
    ]
    s = spark.createDataFrame([(ch, i, p, i, login) for ch, i, p, login in rows], "ch string, id bigint, parent bigint, at bigint, login string").withColumn("role", F.lit("asker"))
    got = conv.conversations(s, ["ch"], gap_us=1000, sound=conv.RECIPROCAL).collect()
    assert {(r.ch, r.session_no) for r in got} == {("known", 1), ("null replies", 1), ("null is answered", 1)} and len(got) == 6


def test_sessions_of_a_channel(spark):
    rows = [("c", 1, None, 0, "a"), ("c", 2, 1, 50, "b"), ("c", 3, 1, 500, "c"), ("c", 4, 3, 560, "a"), ("c", 5, None, 2000, "a"), ("c", 6, None, None, "b")]
    m = spark.createDataFrame(rows, "ch string, id bigint, parent bigint, at bigint, login string").withColumn("role", F.lit("participant"))
    of = lambda **k: sorted((r.session_no, r.turn_no, r.id) for r in conv.conversations(m, ["ch"], gap_us=100, sound=conv.RECIPROCAL, **k).collect())
    assert of() == [(1, 1, 1), (1, 2, 2)]  # a reply to another session breaks the second
    assert of(cut_replies=True) == [(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 4)]
    assert conv.conversations(m, ["ch"]).collect() == []  # a message without a time
