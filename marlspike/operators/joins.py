"""Joins of entities with what belongs to them (JN), feeds with deletions (TM-3, TM-6), windows of a log (AL-7, AL-8)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_children(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """JN-3, JN-6: every parent beside each of its children, once with nulls if it has none. Null keys match nothing.

    Rows are joined, not gathered, so a parent may have any number of children; AQE splits hot keys.
    """
    return parents.join(children, keys, "left")


def first_candidate(refs: DataFrame, known: DataFrame, number: str, project: str, candidates: list[str]) -> DataFrame:
    """JN-4: each number of ``refs`` with the first of ``candidates`` that has it, null if none does."""
    order = F.array_position(F.array(*(F.lit(c) for c in candidates)), F.col(project))
    have = known.filter(F.col(project).isin(candidates)).groupBy(number).agg(F.min_by(project, order).alias(project))
    return refs.select(number).distinct().join(have, number, "left")


def with_account(rows: DataFrame, accounts: DataFrame, email: str, columns: list[str], default: str = "unknown") -> DataFrame:
    """JN-5: ``rows`` with ``columns`` of the account of ``email``, which compares without case; ``default`` where there is none.

    Several accounts of one address count as the one with the smallest columns.
    """
    one = accounts.filter("email IS NOT NULL").groupBy(F.lower("email").alias("_e")).agg(F.min(F.struct(*columns)).alias("_a"))
    joined = rows.join(one, F.lower(email) == F.col("_e"), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_a.{c}").cast("string"), F.lit(default)) for c in columns}).drop("_e", "_a")


def cascade_delete(docs: DataFrame, vectors: DataFrame, doc_id: str, vector_id: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """ST-14: the documents left without those whose id begins with ``prefix``, and the vectors left without those of deleted documents."""
    gone = docs.filter(F.startswith(F.col(doc_id), F.lit(prefix))).select(F.col(doc_id).alias(vector_id)).distinct()
    left = docs.filter(~F.coalesce(F.startswith(F.col(doc_id), F.lit(prefix)), F.lit(False)))
    return left, vectors.join(gone, vector_id, "left_anti")


def timed_view(entries: DataFrame, keys: list[str], order: list[str], deleted: str) -> DataFrame:
    """TM-3: the newest entry of each key unless it is a deletion; ``deleted`` is a flag, null means no."""
    rest = [c for c in entries.columns if c not in keys]
    last = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(*keys, "_l.*")
    return last.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def delete_entries(current: DataFrame, columns: list[str], keys: list[str], where: Column, mod_time: str, now: int, deleted: str) -> DataFrame:
    """TM-3: the deletions to append to a feed for the rows of a current view that ``where`` holds for, stamped ``now``."""
    keep = [F.col(c) if c in keys else F.lit(now).cast(dict(current.dtypes)[c]).alias(c) if c == mod_time else F.lit(None).cast(dict(current.dtypes)[c]).alias(c) for c in columns]
    return current.filter(F.coalesce(where, F.lit(False))).select(*keep, F.lit(True).alias(deleted))


def mark_old(cursors: DataFrame, marks: DataFrame, keys: list[str], at: str, restart: Column | None = None) -> DataFrame:
    """TM-6: cursors moved to the later of their place and the mark of their key, never back; those to ``restart`` are gone."""
    both = cursors.select(*keys, at).unionByName(marks.select(*keys, at)).groupBy(*keys).agg(F.max(at).alias(at))
    return both if restart is None else both.filter(~F.coalesce(restart, F.lit(False)))


def newest_comment(comments: DataFrame, issue: list[str], comment: str, done: DataFrame) -> DataFrame:
    """OR-6: each issue once, at its newest comment, unless ``done`` (issue, comment) has that comment or a later one."""
    newest = comments.groupBy(*issue).agg(F.max(comment).alias(comment))
    seen = done.groupBy(*issue).agg(F.max(comment).alias("_done"))
    return newest.join(seen, issue, "left").filter(F.col("_done").isNull() | (F.col(comment) > F.col("_done"))).drop("_done")


def needs(flags: list[tuple[int, Column]]) -> Column:
    """AG-5: the bits of the conditions that hold; null conditions don't."""
    out = F.lit(0)
    for bit, c in flags:
        out = out.bitwiseOR(F.when(c, F.lit(bit)).otherwise(0))
    return out


def run_report(rows: DataFrame, by: list[str], done: Column, skipped: Column) -> DataFrame:
    """AG-10: (by, completed, skipped, errors); what is neither done nor skipped is an error."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.groupBy(*by).agg(
        F.count_if(yes(done)).alias("completed"), F.count_if(~yes(done) & yes(skipped)).alias("skipped"), F.count_if(~yes(done) & ~yes(skipped)).alias("errors")
    )


def time_window(start: dt.datetime | dt.timedelta | None, end: dt.datetime | dt.timedelta | None, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """AL-7: both ends of a window; an end may be a time, a duration from the other end, or open (the beginning, now).

    A single duration counts back from the end or on from the start. Two durations, and an end before its start, are errors.
    """
    if isinstance(start, dt.timedelta) and isinstance(end, dt.timedelta):
        raise ValueError("both ends are durations")
    if isinstance(end, dt.timedelta):
        if start is None:
            raise ValueError("a duration needs the other end")
        end = start + end
    end = now if end is None else end
    start = end - start if isinstance(start, dt.timedelta) else start
    start = dt.datetime.min if start is None else start
    if end < start:
        raise ValueError("the end lies before the start")
    return start, end


def between(log: DataFrame, at: str, window: tuple[dt.datetime, dt.datetime], also: Column | None = None) -> DataFrame:
    """AL-8: entries created within the window, ends included, that ``also`` holds for. Plain comparisons, so they reach the scan."""
    rows = log.filter((F.col(at) >= F.lit(window[0])) & (F.col(at) <= F.lit(window[1])))
    return rows if also is None else rows.filter(also)
