import json
import random

from pyspark.sql import functions as F

from marlspike.operators.cdc import apply_cells, apply_changes, issue_state
from marlspike.operators.shred import _deep, parent, places, read_json, shred, table
from marlspike.session import latest

LISTS = ["labels", "reactions.groups", "reactions.groups.users"]


def nodes(spark, *texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, json string, path string")
    return shred(df, "json", ["id"], **kw)


def test_shapes_of_lists(spark):
    texts = [
        '{"labels": [{"name": "a"}, null, "b", {"name": null}]}',
        '{"Labels": {"nodes": [{"name": "a"}]}}',
        '{"labels": {"edges": [{"node": {"name": "e"}}]}}',
        '{"labels": "solo"}',
        '{"labels": {"name": "one"}}',
        '{"labels": []}',
        '{"labels": null}',
        "{}",
    ]
    got = [(r["id"], r["pos"], r["kind"], r["fields"].get("name", r["fields"].get(""))) for r in nodes(spark, *texts, lists=LISTS, keep=["labels"]).withColumn("pos", places("labels", LISTS)).orderBy("id", "dewey").collect()]
    assert got == [
        (0, "0", "object", "a"), (0, "1", "null", None), (0, "2", "scalar", "b"), (0, "3", "object", None),
        (1, "0", "object", "a"), (2, "0", "object", "e"), (3, "0", "scalar", "solo"), (4, "0", "object", "one"),
    ]


def test_nested_places_and_parents(spark):
    t = json.dumps({"reactions": {"groups": [{"content": "+1", "users": []}, {"content": "eyes", "users": [{"login": "u"}, "v"]}]}})
    n = nodes(spark, t, lists=LISTS)
    users = table(n, "reactions.groups.users", {"login": "login", "bare": ""}, ["id"], LISTS).orderBy("pos").collect()
    assert [(r["pos"], r["login"], r["bare"]) for r in users] == [("1.0", "u", None), ("1.1", None, "v")]
    groups = {r["dewey"]: r["fields"]["content"] for r in n.filter("path = 'reactions.groups'").collect()}
    assert [(r["parent_table"], groups[r["parent_id"]]) for r in users] == [("reactions.groups", "eyes")] * 2
    top = table(n, "reactions.groups", {}, ["id"], LISTS).collect()
    assert {(r["parent_table"], r["parent_id"]) for r in top} == {("", "0")} and parent("a", ["a"])[0] == ""


def test_maps(spark):
    t = '{"7": {"account": {"email": "e", "tags": ["t", null]}}, "8": null}'
    two = ["s", "s.account.tags"]
    got = nodes(spark, t, maps=["s"], lists=["s.account.tags"], root="s", keep=two)
    rows = [r for p in two for r in table(got, p, {}, ["id"], two, ["s"]).withColumn("path", F.lit(p)).collect()]
    assert sorted((r["path"], r["pos"], r["kind"]) for r in rows) == [("s", "7", "object"), ("s", "8", "null"), ("s.account.tags", "7.0", "scalar"), ("s.account.tags", "7.1", "null")]
    ids = {r["node_id"]: r["pos"] for r in rows if r["path"] == "s"}
    assert {ids[r["parent_id"]] for r in rows if r["path"] != "s"} == {"7"}


def test_lists_in_lists(spark):
    n = nodes(spark, '{"m": [[1, 2], [3]]}', lists=["m"])
    got = n.filter("path = 'm[]'").withColumn("pos", places("m[]", ["m", "m[]"])).select("pos", "fields").collect()
    assert [(r["pos"], r["fields"][""]) for r in got] == [("0.0", "1"), ("0.1", "2"), ("1.0", "3")]


def test_readability():
    assert read_json(chr(0xFEFF) + "{}") == {} and read_json(")]}'\n{}") == {} and read_json('"{}"') == {}
    wrapped = "{}"
    for _ in range(6):
        wrapped = json.dumps(wrapped)
    assert read_json(wrapped) == {} and read_json('"plain"') is None
    assert read_json('{"a": ') is None and read_json(None) is None and read_json("") is None and read_json("[" * 100000) is None
    v = read_json("[" * 100_000 + "1" + "]" * 100_000)
    for _ in range(100_000):
        v = v[0]
    assert v == 1


def test_deep_parser_against_json():
    rnd = random.Random(5)

    def value(d):
        kind = rnd.randrange(7 if d else 5)
        if kind > 4:
            return [value(d - 1) for _ in range(rnd.randrange(4))] if kind == 5 else {f"k{i} \\ é": value(d - 1) for i in range(rnd.randrange(4))}
        return [None, True, -1.5e3, "a\"b\\ \n{}[]:,", 12][kind]

    for _ in range(200):
        v = value(4)
        text = json.dumps(v, indent=rnd.choice([None, 2]), ensure_ascii=rnd.random() < 0.5)
        assert _deep(text) == v
        broken = text[: rnd.randrange(len(text))] + rnd.choice(["", "]", "}", ",", "x"]) + text[rnd.randrange(len(text)) :]
        try:
            want = json.loads(broken)
        except ValueError:
            want = "bad"
        try:
            got = _deep(broken)
        except ValueError:
            got = "bad"
        assert got == want, broken


def test_unreadable_empty_repeated_and_deep(spark):
    deep = '{"a":' * 300 + "1" + "}" * 300
    assert nodes(spark, None, "", "{", deep, lists=LISTS, keep=["labels"]).collect() == []
    assert nodes(spark, deep, lists=LISTS).count() == 1
    two = nodes(spark, '{"labels": ["a"]}', '{"labels": ["a"]}', lists=LISTS, keep=["labels"])
    assert two.count() == 2
    empty = spark.createDataFrame([], "id int, json string")
    assert shred(empty, "json", ["id"], lists=LISTS).collect() == []


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 5, {"k": 1}), (1, "b", 7, None), (1, "b", 7, None), (None, "n", None, None), (2, "x", None, None), (2, "y", 0, None)], "k int, v string, t int, m map<string,int>")
    assert sorted(map(tuple, latest(df, ["k"], ["t"], ["v"]).collect()), key=str) == sorted([(1, "b"), (2, "y"), (None, "n")], key=str)
    assert sorted((r["k"] or 0, r["v"]) for r in latest(df, ["k"], ["t"]).collect()) == [(0, "n"), (1, "b"), (2, "y")]
    assert latest(df.limit(0), ["k"], ["t"]).collect() == []


def test_cells(spark):
    rows = [("e", "f", 2, "x"), ("e", "f", 1, "y"), ("e", "g", 1, "z"), ("e", "g", 2, None), ("e", "h", None, "q"), ("e", "f", 2, "x"), ("e", "f", 2, None)]
    df = spark.createDataFrame(rows, "e string, f string, s int, value string")
    assert sorted(map(tuple, apply_cells(df, ["e"], ["f"], ["s"]).collect())) == [("e", "f", "x")]
    assert apply_cells(df.limit(0), ["e"], ["f"], ["s"]).collect() == []


def test_changes_against_replay(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", "c", None]), i, rnd.choice(["set", "set", "set", "delete", "replace"]), rnd.choice([None, "u", "v"]), rnd.choice([None, 1, 2])) for i in range(400)]
    state = {}
    for k, _, op, x, y in rows:
        if op == "delete":
            state.pop(k, None)
            continue
        s = {"x": None, "y": None} if op == "replace" else state.get(k, {"x": None, "y": None})
        state[k] = {"x": x if x is not None or op == "replace" else s["x"], "y": y if y is not None or op == "replace" else s["y"]}
    shuffled = rows + rows[:100]
    rnd.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k string, seq int, op string, x string, y int")
    got = apply_changes(df, ["k"], ["seq"], ["x", "y"], F.col("op") == "delete", F.col("op") == "replace")
    assert {r["k"]: {"x": r["x"], "y": r["y"]} for r in got.collect()} == state
    assert apply_changes(df.limit(0), ["k"], ["seq"], ["x"], F.col("op") == "delete").collect() == []


def test_issue_state_nulls(spark):
    schema = "project string, issue bigint, id bigint, instant_us bigint, event string, label struct<name:string,description:string,color:string>, labels array<struct<name:string,description:string,color:string>>, assignees array<struct<login:string>>, milestone struct<title:string>, `rename` struct<`from`:string,`to`:string>"

    def e(i, at, kind, **kw):
        return ("p", kw.get("issue", 1), i, at, kind, kw.get("label"), kw.get("labels"), kw.get("assignees"), kw.get("milestone"), kw.get("rename"))

    rows = [
        e(1, 10, "labeled", label=(" Bug ", None, None), labels=[None, ("DOCS", None, None), ("", None, None)]),
        e(2, 20, "unlabeled", label=("bug", None, None)),
        e(3, 5, "assigned", assignees=[None, ("Ann",), (None,)]),
        e(4, 30, "closed"), e(5, 30, "reopened"),
        e(6, None, "labeled", label=("late", None, None)),
        e(7, 1, "milestoned", milestone=("m",)), e(8, 2, "demilestoned"),
        e(9, 3, "renamed", rename=(None, "T")), e(10, 4, "renamed", rename=("T", None)),
        e(11, 1, "closed", issue=2), e(12, None, "deleted", issue=2),
        e(13, 9, None),
    ]
    got = sorted((r["issue"], r["item_kind"], r["item"]) for r in issue_state(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "assignee", "ann"), (1, "label", "docs"), (1, "state", "open"), (1, "title", "T")]
    assert issue_state(spark.createDataFrame([], schema)).collect() == []
