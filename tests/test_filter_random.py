"""Filters made at random, each beside a Python reading of it, over rows made at random."""

import random
import re

from pyspark.sql import functions as F

from marlspike.filterlang import compile_filter

WORDS = ["Bug", "bug", "docs", "big bug", "bug-fix", "debug", "Docs page", "b", "", "x1", "api docs bug"]
SCHEMA = "n bigint, x double, word string, flag boolean, tags array<string>, who struct<login:string,age:bigint>, pairs array<struct<k:string,v:bigint>>, m map<string,bigint>"


def row(r):
    text = lambda: r.choice([*WORDS, None])
    return (
        r.randrange(-5, 20), r.randrange(-8, 30) / 4, text(), r.random() < 0.5,
        None if r.random() < 0.2 else [r.choice(WORDS) for _ in range(r.randrange(4))],
        None if r.random() < 0.2 else (text(), r.randrange(60)),
        None if r.random() < 0.2 else [(r.choice(WORDS), r.randrange(6)) for _ in range(r.randrange(3))],
        None if r.random() < 0.2 else {w: r.randrange(5) for w in r.sample(["alpha", "beta", "gamma"], r.randrange(4))},
    )


def holds(op, s, w):
    """A comparison of one text."""
    if s is None:
        return op == "!="
    if op in ("<", "<=", ">", ">="):
        return {"<": s < w, "<=": s <= w, ">": s > w, ">=": s >= w}[op]
    same = s.lower() == w.lower()
    if w.startswith("*"):
        same = s.lower().endswith(w[1:].lower())
    elif w.endswith("*"):
        same = s.lower().startswith(w[:-1].lower())
    if op == ":":
        return re.search(rf"(?<![a-z0-9]){re.escape(w.lower())}(?![a-z0-9])", s.lower()) is not None
    return same if op == "=" else not same


COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def leaf(r, inside=False):
    """(text, Python reading) of one comparison; ``inside`` parentheses a star is no wildcard."""
    kind, order = r.randrange(11), r.choice(list(COMPARE))
    w = r.choice(["bug", "Docs", "x1", "debug", "b"])
    if kind == 0:
        k = r.randrange(-3, 15)
        return f"n {order} {k}", lambda t: COMPARE[order](t["n"], k)
    if kind == 1:
        k = r.randrange(0, 24) / 4
        return f"x {order} {k}", lambda t: COMPARE[order](t["x"], k)
    if kind == 2:
        w = r.choice([w, w + "*", "*" + w]) if not inside else w
        op = r.choice(["=", "!="])
        return f"word {op} {w}", lambda t: holds(op, t["word"], w)
    if kind == 3:
        op = r.choice([":", "<", "<=", ">", ">="])
        return f"word {op} {w}", lambda t: t["word"] is not None and holds(op, t["word"], w)
    if kind == 4:
        return r.choice(["flag = true", "flag = TRUE"]), lambda t: t["flag"]
    if kind == 5:
        op = r.choice(["=", "!=", ":"])
        return f"tags {op} {w}", lambda t: any(holds(op, s, w) for s in t["tags"] or [])
    if kind == 6:
        return f"who.login = {w}", lambda t: t["who"] is not None and t["who"]["login"] is not None and holds("=", t["who"]["login"], w)
    if kind == 7:
        k = r.randrange(5)
        op = r.choice(["<", "<=", ">", ">=", "="])
        return f"pairs.v {op} {k}", lambda t: any(COMPARE[op](p["v"], k) for p in t["pairs"] or [])
    if kind == 8:
        key = r.choice(["alpha", "beta", "delta"])
        return f"m:{key}", lambda t: key in (t["m"] or {})
    if kind == 9:
        return "word:*", lambda t: (t["word"] or "") != ""
    a, b = r.sample(["bug", "docs", "b", "x1"], 2)
    return f"word = ({a} OR {b})", lambda t: t["word"] is not None and t["word"].lower() in (a, b)


def tree(r, depth, inside=False):
    """(text, reading): OR binds tighter than AND, so alternatives stand without parentheses in a conjunction."""
    if depth == 0 or r.random() < 0.3:
        text, f = leaf(r, inside)
        if r.random() < 0.25:
            return r.choice(["NOT ", "-"]) + text, lambda t: not f(t)
        return text, f
    parts = [[tree(r, 0, inside) if r.random() < 0.6 else (lambda p: (f"({p[0]})", p[1]))(tree(r, depth - 1, True)) for _ in range(r.randrange(1, 3))] for _ in range(r.randrange(1, 4))]
    text = r.choice([" AND ", " "]).join(" OR ".join(p[0] for p in ps) for ps in parts)
    return text, lambda t: all(any(f(t) for _, f in ps) for ps in parts)


def test_600_random_filters(spark):
    r = random.Random(17)
    df = spark.createDataFrame([row(r) for _ in range(60)], SCHEMA)
    cases = [tree(r, 2) for _ in range(600)]
    wrong = []
    for at in range(0, len(cases), 60):
        some = cases[at : at + 60]
        cols = [F.coalesce(compile_filter(text, df.schema)[0], F.lit(False)).alias(f"c{i}") for i, (text, _) in enumerate(some)]
        for t in df.select("*", *cols).collect():
            d = t.asDict(recursive=True)
            wrong += [(text, d["word"], d["tags"]) for i, (text, f) in enumerate(some) if t[f"c{i}"] != bool(f(d))]
    assert not wrong, (len(wrong), wrong[:4])
