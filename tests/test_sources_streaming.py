import json
import random

import pytest
from pyspark.sql import functions as F

from marlspike.operators.vectors import quote_embed
from marlspike.sources import backfill as bf
from marlspike.sources import specs
from marlspike.streaming import feeds


def test_specs(spark):
    assert specs.parse_spec("parquet:/a/b~n") == specs.Spec("parquet", "/a/b", "n") and str(specs.parse_spec("parquet:/a~n")) == "parquet:/a~n"
    assert specs.open_spec(spark, "mem", "a int").count() == 0
    for bad in ("", "parquet", "mem:/x", "other:/x"):
        with pytest.raises(ValueError):
            specs.parse_spec(bad)
    key = ["a, b", 7, None]
    assert specs.parse_key(specs.show_key(key)) == key
    assert spark.range(9).filter(specs.key_prefix(["id"], [7])).count() == 1


@pytest.mark.parametrize("same_time", [False, True])
def test_backfill_survives_stops(same_time):
    rnd = random.Random(2)
    records = [{"id": i, "updated": 100 if same_time else i // 2} for i in range(30)]
    clock = [50]
    now = lambda: clock[0] if not same_time else 200
    marks, seen = bf.Marks(), []
    for _ in range(40):
        got = list(bf.backfill(bf.newest_first(records, 3), marks, now, stop_after=rnd.randrange(1, 5)))
        seen += [r["id"] for r in got]
        if not got:
            break
        clock[0] += 1
    assert set(seen) == set(range(30)) and len(seen) == 30
    assert marks.high is None and marks.low is not None


def test_take_until():
    rows = [{"id": 3}, {"id": 2}, {"id": 1}]
    assert bf.take_until(iter(rows), 1) == (rows[:2], True) and bf.take_until(iter(rows), 9) == (rows, False)


def test_recorded_source(spark, tmp_path):
    (tmp_path / "1.json").write_text(")]}'\n" + json.dumps([{"id": 1, "updated": 5, "x": "y"}, {"id": 2}]))
    (tmp_path / "2.json").write_text("")
    spark.dataSource.register(bf.RecordedSource)
    got = spark.read.format("recorded").option("path", str(tmp_path)).load().orderBy("id").collect()
    assert [(r.id, r.updated) for r in got] == [(1, 5), (2, None)]


def test_stream_equals_batch(spark, tmp_path):
    src, out, cp = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "id string, title string, text string, mod_time bigint"

    def add(rows, n):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    add([("a", "t", "one", 1), ("b", "t", "two", 2), ("a", "t", "uno", 3)], 1)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    feeds.sync_docs(stream(), lambda d: d, out, cp)
    add([("a", "t", "uno", 9), ("b", "t", "zwei", 10), ("c", None, None, 11)], 2)
    feeds.sync_docs(stream(), lambda d: d, out, cp)
    got = {r.id: (r.text, r.mod_time) for r in feeds.read_log(spark, out, ["id"], ["mod_time"]).collect()}
    assert got == {"a": ("uno", 3), "b": ("zwei", 10), "c": (None, 11)}
    feeds.embed_new(stream(), quote_embed, str(tmp_path / "vec"), str(tmp_path / "cpv"))
    assert spark.read.parquet(str(tmp_path / "vec")).filter(F.size("vec") == 123).count() == 3


def test_failing_batch_is_delivered_again(spark, tmp_path):
    src, cp = str(tmp_path / "s"), str(tmp_path / "c")
    spark.createDataFrame([(1,)], "a int").write.parquet(src)
    stream = lambda: spark.readStream.schema("a int").parquet(src)
    seen = []

    def fail(batch, n):
        raise RuntimeError("down")

    with pytest.raises(Exception):
        feeds.run_to_end(stream(), cp, fail)
    feeds.run_to_end(stream(), cp, lambda b, n: seen.append(b.count()))
    feeds.run_to_end(stream(), cp, lambda b, n: seen.append(b.count()))
    assert seen == [1]
