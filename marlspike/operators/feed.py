"""Keyed tables, overlays, snapshot differences and modification-ordered feeds (ST, TM, SO, OR-5, JN-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.operators.ordered import running_sum
from marlspike.session import cut


def point_get(df: DataFrame, key: str, value) -> DataFrame:
    """ST-1: the row of one key; the equality reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


def range_scan(df: DataFrame, key: str, start=None, end=None, limit: int | None = None) -> DataFrame:
    """ST-2, ST-12: rows with ``start <= key <= end`` in key order; an open end is None, a start may not be missing where an end is given."""
    if end is not None and start is None:
        raise ValueError("end without start")
    if start is not None:
        df = df.filter(F.col(key) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(key) <= F.lit(end))
    df = df.orderBy(key)
    return df if limit is None else df.limit(limit)


def apply_ops(ops: DataFrame, key: str, seq: list[str], is_delete: Column, value: str) -> DataFrame:
    """ST-3 to ST-5: the table after an ordered batch; per key the last operation wins, deletes leave nothing."""
    last = F.max_by(F.struct(F.col(value).alias("v"), is_delete.alias("d")), F.struct(*seq))
    return ops.groupBy(key).agg(last.alias("_l")).filter(~F.col("_l.d")).select(key, F.col("_l.v").alias(value))


def delete_range(df: DataFrame, key: str, start, end) -> DataFrame:
    """ST-4: rows outside the inclusive range."""
    return df.filter(~F.coalesce(F.col(key).between(start, end), F.lit(False)))


def overlay_read(base: DataFrame, overlay: DataFrame, key: str, points: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """ST-7, ST-8, SO-1: overlay rows, and base rows hidden neither by them nor by point or range tombstones.

    ``points`` has the key column, ``ranges`` has ``lo`` and ``hi``, both ends included.
    """
    rows = base.join(overlay.select(key), key, "left_anti")
    if points is not None:
        rows = rows.join(points.select(key), key, "left_anti")
    if ranges is not None:
        rows = outside(rows, key, ranges)
    return rows.unionByName(overlay)


def outside(rows: DataFrame, key: str, ranges: DataFrame, few: int = 10_000) -> DataFrame:
    """ST-4, ST-8: ``rows`` whose key no range (``lo``, ``hi``) covers; null keys stay.

    A few ranges are broadcast, after a count. More are sorted together with the keys: the furthest end of the ranges
    begun so far is carried along within each sorted piece and from the pieces before it.
    """
    ranges = ranges.select("lo", "hi").filter("lo <= hi")
    if ranges.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(ranges), F.col(key).between(F.col("lo"), F.col("hi")), "left_anti")
    keys = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct().withColumn("_hi", F.lit(None).cast(dict(ranges.dtypes)["hi"]))
    both = ranges.select(F.col("lo").alias("_k"), F.col("hi").alias("_hi")).unionByName(keys).withColumn("_q", F.col("_hi").isNull())
    ranged = cut(both.repartitionByRange("_k", "_q").withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    ends = ranged.groupBy("_p").agg(F.max("_hi").alias("_m")).select("_p", F.max("_m").over(before).alias("_before"))
    inside = Window.partitionBy("_p").orderBy("_k", "_q").rowsBetween(Window.unboundedPreceding, 0)
    held = ranged.withColumn("_end", F.max("_hi").over(inside)).filter("_q").join(F.broadcast(ends), "_p")
    covered = held.filter(F.greatest("_end", "_before") >= F.col("_k")).select(F.col("_k").alias(key))
    return rows.join(covered, key, "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """ST-9, ST-10, JN-10: what turns ``old`` into ``new`` as (key, change): set for added or differing, delete for gone."""
    a = old.select(key, F.struct(*values).alias("_a"))
    b = new.select(key, F.struct(*values).alias("_b"))
    change = F.when(F.col("_b").isNull(), "delete").when(F.col("_a").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")), "set")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


def changes_since(current: DataFrame, t: int, mod_time: str = "mod_time") -> DataFrame:
    """TM-4: rows of a current view modified after ``t``, oldest first; each key once, at its latest time."""
    return current.filter(F.col(mod_time) > t).orderBy(mod_time)


def changed_docs(current: DataFrame, incoming: DataFrame, key: str, values: list[str]) -> DataFrame:
    """TM-8: the incoming rows that differ from the stored ones, so that unchanged ones keep their time."""
    have = current.select(key, F.struct(*values).alias("_have"), F.lit(True).alias("_there"))
    same = F.coalesce(F.col("_there"), F.lit(False)) & F.struct(*values).eqNullSafe(F.col("_have"))
    return incoming.join(have, key, "left").filter(~same).drop("_have", "_there")


def prefix_scan(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """TM-9: keys that begin with ``prefix``."""
    return df.filter(F.startswith(F.col(key), F.lit(prefix)))


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """AL-1, JN-8: the first incoming row of each key that isn't stored yet."""
    first = incoming.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in incoming.columns if c not in (*keys, *order)))).alias("_f")).select(*keys, "_f.*")
    return first.join(stored.select(*keys), keys, "left_anti")


def feed_time_after(log: DataFrame, times: DataFrame, wall: str, mod_time: str, at: str) -> DataFrame:
    """JN-7: for each ``at`` the feed time of the first entry with a later wall time, null if there is none.

    Entries and questions are range-sorted together by time; within a range the next entry is carried back by a
    window, and beyond its end the first entry of a later range is taken, of which there is one per partition. So
    neither a busy day nor a busy instant meets more than its own rows.
    """
    entries = log.select(F.col(wall).alias("_t"), F.struct(F.col(wall).alias("w"), F.col(mod_time).alias("m")).alias("_e")).filter("_t IS NOT NULL").groupBy("_t").agg(F.min("_e").alias("_e"))
    asked = times.select(F.col(at).alias("_t")).filter("_t IS NOT NULL").distinct().withColumn("_e", F.lit(None).cast(dict(entries.dtypes)["_e"]))
    # Of equal times the entry comes first, so that it isn't later than the question.
    both = entries.unionByName(asked).withColumn("_q", F.col("_e").isNull())
    ranged = cut(both.repartitionByRange("_t", "_q").withColumn("_p", F.spark_partition_id()))
    firsts = ranged.filter("NOT _q").groupBy("_p").agg(F.min("_e").alias("_first"))
    parts = ranged.select("_p").distinct().join(firsts, "_p", "left")
    beyond = Window.orderBy("_p").rowsBetween(1, Window.unboundedFollowing)  # a row per partition
    parts = parts.select("_p", F.first("_first", ignorenulls=True).over(beyond).alias("_next"))
    # The frame runs backwards over the reversed order, so each row costs one step.
    back = Window.partitionBy("_p").orderBy(F.desc("_t"), F.desc("_q")).rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("_n", F.last("_e", ignorenulls=True).over(back)).filter("_q").join(F.broadcast(parts), "_p")
    found = near.select(F.col("_t").alias("_at"), F.coalesce("_n.m", "_next.m").alias("feed_time"))
    return times.join(found, F.col(at) == F.col("_at"), "left").drop("_at")


def running_sum_keep(df: DataFrame, group: list[str], order: list[str], size: Column, limit: int) -> DataFrame:
    """DP-6: the leading rows of each group whose sizes add up to less than ``limit``."""
    return running_sum(df, group, order, size, "_s").filter(F.col("_s") < limit).drop("_s")


def label_merge(have: DataFrame, want: DataFrame) -> DataFrame:
    """SO-3: (name, action) for label lists matched without case: create, describe (fill an empty text), warn or keep."""
    h = have.select(F.lower("name").alias("_k"), F.col("description").alias("_h"), F.lit(1).alias("_in"))
    w = want.select(F.lower("name").alias("_k"), "name", "description")
    act = F.when(F.col("_in").isNull(), "create").when((F.coalesce("_h", F.lit("")) == "") & (F.coalesce("description", F.lit("")) != ""), "describe").when(~F.coalesce("_h", F.lit("")).eqNullSafe(F.coalesce("description", F.lit(""))), "warn").otherwise("keep")
    return w.join(h, "_k", "left").select("name", act.alias("action"))
