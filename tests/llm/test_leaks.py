import random

import numpy as np

from marlspike.llm.leaks import BUCKETS, _code, leaks, passage, passages, reparameterised, template, words

ITEMS = {i: t for i, t in enumerate([
    "Suppose @ann lands 50ac80da1 between v3.6 and v3.3: does the vendoring still install before Qui.Pon frees the toolchain switch? Rank these by cost: tidy the toolchain switch in bar/yan_test.go now.",
    "Suppose @bob lands 11bb22cc3 between v1.2 and v1.9: does the gateway still proxy before Mox.Ren frees the packet loss? Name the socket that velSil left idle on the other machine yesterday please.",
    "The bisect of linux ended at c67d29391, yet the timer heap was concurrent and nobody could explain in one line how the allocation class was reclaimed before the last run of the day.",
])}
FILL = "Completely unrelated words about gardens and rivers flow around here without any meaning at all today."


def run(spark, docs, items=ITEMS):
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    i = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in leaks(d, i, in_items=2).collect()}


def edited(ws, n, rnd):
    ws = list(ws)
    for k in sorted(rnd.sample(range(1, len(ws) - 1), n)):
        ws[k] = "changed"
    return ws


def test_cases(spark):
    rnd = random.Random(7)
    w = [words(t) for t in ITEMS.values()]
    docs = {
        1: f"{FILL} {ITEMS[0]} {FILL}",
        2: f"{FILL} {ITEMS[0].upper().replace(' ', '  ')} {FILL}",
        3: FILL + " " + " ".join(f"<b>{x}</b>," for x in w[2][3:23]) + " " + FILL,
        4: FILL + " " + " ".join(edited(w[2][:24], 3, rnd)) + " " + FILL,
        5: FILL + " " + " ".join(edited(w[2][:24], 8, rnd)) + " " + FILL,
        6: FILL + " " + " ".join(w[2][:15]) + " " + FILL,
        7: FILL + " " + " ".join(rnd.sample(w[2], len(w[2]))),
        8: FILL + " " + " ".join(w[2][:10] + ["inserted"] + w[2][10:14] + w[2][15:22]),
        9: ITEMS[2].translate(str.maketrans("aeo", chr(0x430) + chr(0x435) + chr(0x43E))),
        10: "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in ITEMS[2]).replace("bisect", "bi" + chr(0x200B) + "sect"),
        11: None, 12: "", 13: " \n ", 14: FILL,
        15: (FILL + " ") * 3000 + ITEMS[1],
    }
    assert run(spark, docs) == {(1, 0), (2, 0), (3, 2), (4, 2), (8, 2), (9, 2), (10, 2), (15, 1)}


def test_same_template_other_slots(spark):
    other = "Suppose @eve lands 99ee88dd7 between v2.4 and v2.8: does the tutorial still reword before Kis.Tol frees the footnote?"
    assert run(spark, {1: other}) == set()


def test_reparameterised_question(spark):
    ask = "Suppose {0} lands {1} between {2} and {3}: does the {4} still install before {5} frees the {4} switch? Rank these by cost: tidy the {4} switch of {5} now."
    items = {i: ask.format(*x) for i, x in enumerate([("ann", "50ac80da1", 36, 33, "toolchain", "qui"), ("bob", "11bb22cc3", 12, 19, "gateway", "mox")])}
    docs = {
        1: FILL + " " + ask.format("eve", "99ee88dd7", 24, 28, "tutorial", "kis") + " " + FILL,
        2: ask.format("eve", "99ee88dd7", 24, 28, "tutorial", "kis").replace("the tutorial switch of", "the footnote switch of").replace("frees the tutorial", "frees the glossary"),
        3: ask.format("ann", "50ac80da1", 36, 33, "toolchain", "qui"),
        4: FILL, 5: None, 6: ask.format("eve", "99ee88dd7", 24, 28, "tutorial", "kis")[:60],
    }
    d, i = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in reparameterised(d, i, in_items=2).collect()}
    assert got == {(1, 0), (1, 1), (3, 1)}
    assert reparameterised(d.limit(0), i).count() == 0 and reparameterised(d, i.limit(0)).count() == 0


def test_empty_repeated_and_short(spark):
    assert run(spark, {}) == set()
    assert run(spark, {1: FILL}, {}) == set()
    assert run(spark, {1: ITEMS[0]}, {5: "only five words are here", 6: None}) == set()
    d = spark.createDataFrame([(1, ITEMS[0], 3), (1, ITEMS[0], 4)], "doc_id bigint, text string, words int")
    i = spark.createDataFrame([(0, ITEMS[0], "x"), (0, ITEMS[0], "y")], "item_id bigint, text string, doc_id string")
    assert leaks(d, i, in_items=1).count() == 1


def test_sound_stretch_beside_an_altered_one(spark):
    item = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(160)]
    changed = [w if i % 4 else "other" + w for i, w in enumerate(item[:101])]
    docs = {
        1: " ".join(item[130:150]),
        2: " ".join(item[130:150] + FILL.split() * 2 + changed),
        3: " ".join(changed + item[130:150]),
        4: " ".join(changed),
        5: " ".join(FILL.split() * 400 + item[:12] + FILL.split() * 3000 + item[40:60] + FILL.split()),
    }
    assert run(spark, docs, {0: " ".join(item), 1: " ".join(reversed(item))}) == {(1, 0), (2, 0), (3, 0), (5, 0)}


def test_words_cut_at_line_ends(spark):
    w = words(ITEMS[2])[:20]
    cut = " ".join(x[:2] + "-\n> " + x[2:] if len(x) > 4 and k % 3 == 0 else x for k, x in enumerate(w))
    kept = " ".join(w).replace("concurrent and", "concurrent-\nand")
    assert cut.count("-\n") > 2 and run(spark, {1: cut, 2: kept}) == {(1, 2), (2, 2)}


def brute(a, b, least, share):
    """The longest passage by trying every pair of ends and counting edits in full."""
    best = 0
    for j in range(len(b)):
        for e in range(j + least, len(b) + 1):
            part = b[j:e]
            row = np.arange(len(part) + 1) * 1.0
            row = np.where(np.arange(len(part) + 1) > 0, np.arange(len(part) + 1), 0).astype(float)
            for x in a:
                new = np.empty_like(row)
                new[0] = 0.0  # a passage may begin anywhere in the document
                for k in range(1, len(row)):
                    new[k] = min(row[k - 1] + (part[k - 1] != x), row[k] + 1, new[k - 1] + 1)
                row = new
                if row[-1] <= share * len(part):
                    best = max(best, len(part))
                    break
    return best


def test_passages_against_brute_force():
    rnd = random.Random(3)
    for trial in range(25):
        b = [rnd.randrange(12) for _ in range(20)]
        a = b[rnd.randrange(5) : 20 - rnd.randrange(3)]
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(a))
            a[k : k + 1] = [[99], [], [a[k], 98]][rnd.randrange(3)]
        a = [50] * rnd.randrange(4) + a + [51] * rnd.randrange(4)
        got = passages(np.array(a), np.array(b), 0, 24, 8, 1 / 8)
        want = brute(a, b, 8, 1 / 8)
        assert got <= want and (got > 0) == (want > 0), (a, b, got, want)


def test_kernels():
    assert words("A&amp;B <p class=x>Caf" + chr(0xE9) + "</p> x_y") == ["a", "b", "cafe", "x", "y"]
    common = np.zeros(BUCKETS, dtype=bool)
    common[[_code(w) % BUCKETS for w in ("took", "for")]] = True
    assert template(["took", "12", "ms", "for", "bob"], common) == ["took", "<n>", "<u>", "for", "<w>"]
    s = np.array([(1, 1), (1, 1), (0, 0), (1, 1), (1, 1)])
    assert passage(s, 4, 0.3) == 4 and passage(s, 4, 0.1) == 0 and passage(s, 2, 0.0) == 2
    assert passage(s[:0], 1, 0.5) == 0 and passage(s[2:3], 1, 0.5) == 0
    assert passages(np.array([1]), np.array([2]), 0, 4, 1, 0.5) == 0
