"""Applying a feed of inserts, updates and deletes: column-wise last writer wins, in plain SQL operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.session import cut


def apply_cells(cells: DataFrame, entity: list[str], field: list[str], seq: list[str], value: str = "value") -> DataFrame:
    """The last value of each field of each entity.

    ``cells`` holds one row per change of one field: the ``entity`` keys, the ``field`` keys, the sequence columns
    ``seq`` and ``value`` (null: the change clears the field). Returned are the fields whose last change set a
    value. One ``max_by`` per field merges the changes of a hot entity before the shuffle, and spreads what is
    left of it over its fields. Changes with a null in ``seq`` are ignored; changes of equal sequence are decided
    by the larger value, a clearing one loses; repeated changes do nothing. Empty input gives an empty table.
    """
    ready = cells.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in seq))
    order = F.struct(*(F.col(c) for c in seq), F.col(value).isNotNull(), F.col(value))
    last = ready.groupBy(*entity, *field).agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_last"))
    return last.select(*entity, *field, F.col("_last.v").alias(value)).filter(F.col(value).isNotNull())


def apply_changes(
    changes: DataFrame,
    keys: list[str],
    seq: list[str],
    columns: list[str],
    is_delete: Column,
    is_replace: Column | None = None,
    sets: dict[str, Column] | None = None,
    delete_is_final: bool = False,
) -> DataFrame:
    """Rebuild the table that ``changes`` describe: one row per living key.

    For each of ``columns`` the value of the last change that set it, looking only at changes after the key's
    latest delete and from its latest replacement on. ``sets[c]`` says whether a change sets column ``c`` (default:
    where it is not null, so set a flag if null is a value). With ``delete_is_final`` a key with any delete has no
    row. Repeated and out-of-order changes don't matter; a null in ``seq`` makes a change void. Two aggregations on
    the same keys share one shuffle: the first finds the bound, the second is evaluated per change after a join on
    those keys. Empty input gives an empty table.
    """
    sets = sets or {}
    order = F.struct(*(F.col(c) for c in seq))
    flag = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    ready = changes.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in seq))
    ready = ready.withColumns({"_del": flag(is_delete), "_rep": flag(is_replace), "_seq": order})
    bound = ready.groupBy(*keys).agg(F.max(F.when(F.col("_del"), F.col("_seq"))).alias("_d"), F.max(F.when(F.col("_rep"), F.col("_seq"))).alias("_r"))
    on = ready.alias("c").join(bound.alias("b"), [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    alive = ~F.col("c._del") & (F.col("b._d").isNull() | ((F.col("c._seq") > F.col("b._d")) & ~F.lit(delete_is_final))) & (F.col("b._r").isNull() | (F.col("c._seq") >= F.col("b._r")))
    live = on.filter(alive).select("c.*")
    last = [F.max_by(F.struct(F.col(c).alias("v")), F.when(F.coalesce(sets.get(c, F.col(c).isNotNull()) | F.col("_rep"), F.lit(False)), F.col("_seq"))).alias(f"_l_{c}") for c in columns]
    return live.groupBy(*keys).agg(*last).select(*keys, *(F.col(f"_l_{c}.v").alias(c) for c in columns))


def issue_state(events: DataFrame) -> DataFrame:
    """The present state of every issue as (project, issue, item_kind, item) from its events with ``instant_us``.

    ``events`` holds one row per (project, id). Events without an instant change nothing, except that a
    ``deleted`` event removes the issue whenever it comes. Null payloads, empty and blank names set nothing.
    """
    kind = F.lower(F.trim("event"))
    e = events.select("project", "issue", "id", "instant_us", kind.alias("kind"), "label", "labels", "assignees", "milestone", "rename")
    names = F.array_append(F.transform(F.coalesce("labels", F.array().cast("array<struct<name:string,description:string,color:string>>")), lambda x: x["name"]), F.col("label.name"))
    logins = F.transform("assignees", lambda x: F.lower(x["login"]))
    none = F.lit(None).cast("string")

    def cell(item_kind: str, item: Column, value: Column) -> Column:
        return F.struct(F.lit(item_kind).alias("item_kind"), item.alias("field"), value.alias("value"))

    def each(item_kind: str, items: Column, on: str) -> Column:
        return F.transform(F.filter(F.array_distinct(items), lambda x: x != ""), lambda x: cell(item_kind, x, F.when(F.col("kind") == on, x)))

    def one(item_kind: str, value: Column) -> Column:
        return F.array(cell(item_kind, F.lit(""), value))

    cells = (
        F.when(F.col("kind") == "deleted", one("deleted", F.lit("deleted")))
        .when(F.col("instant_us").isNull(), None)
        .when(F.col("kind").isin("labeled", "unlabeled"), each("label", F.transform(names, lambda x: F.lower(F.trim(x))), "labeled"))
        .when(F.col("kind").isin("assigned", "unassigned"), each("assignee", logins, "assigned"))
        .when(F.col("kind") == "closed", one("state", F.lit("closed")))
        .when(F.col("kind") == "reopened", one("state", F.lit("open")))
        .when((F.col("kind") == "milestoned") & F.col("milestone.title").isNotNull(), one("milestone", F.col("milestone.title")))
        .when(F.col("kind") == "demilestoned", one("milestone", none))
        .when((F.col("kind") == "renamed") & F.col("rename.to").isNotNull(), one("title", F.col("rename.to")))
    )
    # A deletion holds whenever it comes, so it has one place in time and is a cell of its own.
    once = lambda c: F.when(F.col("kind") == "deleted", 0).otherwise(F.col(c)).alias(c)
    rows = e.select("project", "issue", once("id"), once("instant_us"), F.inline(cells))
    # Read twice below; only the state is written, which is far smaller than the feed.
    last = cut(apply_cells(rows, ["project", "issue"], ["item_kind", "field"], ["instant_us", "id"]))
    gone = last.filter("item_kind = 'deleted'").select("project", "issue")
    return last.filter("item_kind <> 'deleted'").join(gone, ["project", "issue"], "left_anti").select("project", "issue", "item_kind", F.col("value").alias("item"))
