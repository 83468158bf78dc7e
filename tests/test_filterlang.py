import datetime as dt

import pytest

from marlspike.filterlang import FilterError, compile_filter, filter_rows, parse, show

SCHEMA = """id int, flag boolean, name string, n bigint, f double, at timestamp_ntz, maybe string, tags array<string>, nums array<int>,
people array<struct<first: string, id: int>>, attrs map<string,string>, sizes map<string,int>, sub struct<name_x: string, deep: struct<v: int>>"""
ROWS = [
    (1, True, "Alpha beta-gamma", 8, 1.5, dt.datetime(2024, 1, 1), None, ["x", "Yes"], [1, 5], [("Ann", 1), ("Bob", 2)], {"k": "v w"}, {"a": 3}, ("hello", (7,))),
    (2, False, "alphabet", 16, float("nan"), dt.datetime(2024, 6, 1, 12), "set", [], None, [("Bob", 3)], {}, None, None),
    (3, None, "", 0, -2.0, None, "", None, [], [], None, {"a": 9}, ("x", None)),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


KEPT = [
    ("", [1, 2, 3]), ("flag = true", [1]), ("flag:false", [2]), ("-flag:true", [2, 3]), ("NOT flag = true", [2, 3]),
    ("name = alphabet", [2]), ("name = ALPHA*", [1, 2]), ('name = "*BET"', [2]), ("name != alphabet", [1, 3]), ("name : alpha", [1]),
    ("name:beta", [1]), ('name = ""', [3]), ('maybe = ""', [1, 3]), ("maybe != set", [1, 3]), ("maybe:*", [2]), ("n = 0x10", [2]),
    ("n = 010", [1]), ("n > 7 n < 10", [1]), ("n = 8 OR n = 16 AND flag = false", [2]), ("n = 0 n = 8 OR n = 16", []), ("f = NaN", [2]),
    ("f < 2", [1, 3]), ("f != 1.5", [3]), ('at >= "2024-06"', [2]), ('at < "2024-01-01T00:00:00.000000001Z"', [1]), ('at = "Jan 2024"', [1]),
    ("tags = yes", [1]), ("tags != x", [1]), ("tags:(x AND yes)", [1]), ("tags:(x AND no)", []), ("nums > 4", [1]), ("people.first = bob", [1, 2]),
    ("people.id > 2", [2]), ("attrs:k", [1]), ("attrs:K", []), ("attrs.k:w", [1]), ("attrs = v*", [1]), ("sizes > 5", [3]), ("sizes.a = 3", [1]),
    ("sub.nameX = hello", [1]), ("sub.deep.v = 7", [1]), ("sub:hello", [1]), ('name =~ "^al"', [2]), ('name !~ "^al"', [1, 3]), ('maybe !~ "q"', [2, 3]),
    ("gamma", [1]), ("bob", [1, 2]), ("16", [2]), ("n = (8 OR 16)", [1, 2]), ("NOT n = (8 OR 16)", [3]), ("name = (ALPHA*)", []), ("n = 8 -- comment", [1]),
    ("flag", []), ('name = alphabet OR name = ""', [2, 3]),
]


@pytest.mark.parametrize("text,want", KEPT)
def test_rows(table, text, want):
    assert sorted(r["id"] for r in filter_rows(table, text).select("id").collect()) == want


@pytest.mark.parametrize("text", ["nosuch = 1", "n = abc", 'n =~ "x"', "f(1)", "name.x = 1", "sub.no = 2", "flag.x"])
def test_messages(table, text):
    c, messages = compile_filter(text, table.schema)
    assert messages and table.filter(c).count() == 0


@pytest.mark.parametrize("text", ["=", "a = ", "(a", "a)", "a AND", "AND a", "a =~ b", 'a =~ "("', '"open', "a = (b", "f(a"])
def test_errors(text):
    with pytest.raises(FilterError):
        parse(text)


TREES = [
    ("a b OR c", "(a AND (b OR c))"), ("a AND b c", "(a AND (b AND c))"), ("NOT a OR b", "((NOT a) OR b)"), ("-a.b:c", "(NOT (a.b : c))"),
    ("a = b.c", "(a = b.c)"), ('x:"q r"', '(x : "q r")'), ("a = -5", "(a = -5)"), ("f(a, b)", "f(a, b)"), ("a.NOT = 1", "(a.NOT = 1)"), ("a ANDb", "(a AND ANDb)"),
]


@pytest.mark.parametrize("text,want", TREES)
def test_trees(text, want):
    assert show(parse(text)) == want


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s").write.parquet(str(tmp_path / "t"))
    d = filter_rows(spark.read.parquet(str(tmp_path / "t")), "id > 50")
    assert "GreaterThan(id,50)" in d._jdf.queryExecution().executedPlan().toString()
