"""Structured Streaming forms of the feeds (TM-5 to TM-10): durable cursors, upserts, batched embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlspike.operators.feed import changed_docs
from marlspike.session import latest


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """TM-5: deliver everything new since the cursor in ``checkpoint``, then stop. A failing batch doesn't move the cursor."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def upsert_log(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """TM-7: a batch writer that appends the batch's newest row per key under the batch's number.

    A batch that is delivered again overwrites its own folder, so delivery at least once gives each row once.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_log(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The current view of a log written by ``upsert_log``: the newest row per key over all batches."""
    rows = spark.read.parquet(path).drop("batch")
    return latest(rows, keys, order)


def sync_docs(stream: DataFrame, to_docs: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """TM-7, TM-8: turn entries into documents and store those that differ from what is stored.

    ``to_docs`` gives (id, title, text, mod_time). Unchanged documents keep their time.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        docs = latest(to_docs(batch), ["id"], ["mod_time"])
        old = [f for f in _folders(spark, path) if f < number]
        if old:
            have = latest(spark.read.option("basePath", path).parquet(*(f"{path}/batch={f}" for f in old)).drop("batch"), ["id"], ["mod_time"])
            docs = changed_docs(have, docs, "id", ["title", "text"])
        docs.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run_to_end(stream, checkpoint, write)


def embed_new(stream: DataFrame, embed: Callable, path: str, checkpoint: str) -> StreamingQuery:
    """TM-10, TM-11: embed new documents in Arrow batches; ``embed`` maps a column to vectors. One checkpoint per model."""

    def write(batch: DataFrame, number: int) -> None:
        newest = latest(batch, ["id"], ["mod_time"])
        newest.select("id", embed(F.concat_ws("\n\n", "title", "text")).alias("vec"), "mod_time").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run_to_end(stream, checkpoint, write)


def _folders(spark: SparkSession, path: str) -> list[int]:
    """The batches that ``path`` holds, asked from its file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
