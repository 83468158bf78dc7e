"""Aggregates over code reviews (AG, RV-1, OR-1, OR-4): contributions, predicates as data, first-match categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def account_stats(changes: DataFrame, bots: DataFrame | None = None, vote: str = "Code-Review", most: int = 2) -> DataFrame:
    """AG-1: (email, commits, reviews, can_submit, can_vote): what each address did in ``changes``.

    A merged change is a commit of its owner; where ``bots`` (``email``) own it, of the author of its first revision. A
    message by anybody else is a review. Who submitted a change may submit, who gave ``most`` for ``vote`` may vote. Contributions
    are merged per task before they are shuffled. Null addresses don't count.
    """
    c = changes.select("status", "owner_email", "submitter_email", "messages", "revisions", F.col("labels")[vote].alias("votes"))
    if bots is not None:
        known = bots.filter("email IS NOT NULL").select(F.lower("email").alias("_b"), F.lit(True).alias("_bot")).distinct()
        first = F.get(F.filter("revisions", lambda r: r["number"] == 1), F.lit(0))["commit_author"]
        c = c.join(known, F.lower("owner_email") == F.col("_b"), "left").withColumn("owner_email", F.when(F.col("_bot"), first).otherwise(F.col("owner_email")))
    none, one = F.lit(0), F.lit(1)

    def did(email: Column, commits: Column, reviews: Column, submit: bool = False, voted: bool = False) -> Column:
        return F.struct(email.alias("email"), commits.alias("c"), reviews.alias("r"), F.lit(submit).alias("s"), F.lit(voted).alias("v"))

    kind = "array<struct<email:string,c:int,r:int,s:boolean,v:boolean>>"
    empty = F.array().cast(kind)
    said = F.transform("messages", lambda m: F.coalesce(m["real_author"], m["author"]))
    parts = [
        F.array(did(F.when(F.col("status") == "MERGED", F.col("owner_email")), one, none), did(F.col("submitter_email"), none, none, submit=True)),
        F.transform(F.filter(said, lambda x: ~x.eqNullSafe(F.col("owner_email"))), lambda x: did(x, none, one)),
        F.transform(F.filter("votes", lambda x: x["value"] >= most), lambda x: did(x["email"], none, none, voted=True)),
    ]
    each = c.select(F.inline(F.concat(*(F.coalesce(p.cast(kind), empty) for p in parts)))).filter("email IS NOT NULL")
    sums = [F.sum("c").alias("commits"), F.sum("r").alias("reviews"), F.bool_or("s").alias("can_submit"), F.bool_or("v").alias("can_vote")]
    return each.groupBy("email").agg(*sums)


def authority() -> Column:
    """AG-2: what ``account_stats`` says of an address: maintainer, reviewer, contributor or unknown."""
    rights = F.col("can_submit") | F.col("can_vote")
    return F.when(rights, "maintainer").when(F.col("reviews") > 0, "reviewer").when(F.col("commits") > 0, "contributor").otherwise("unknown")


def reviewers(changes: DataFrame) -> Column:
    """AG-4: the distinct authors of messages other than the owner, sorted."""
    who = F.transform("messages", lambda m: F.coalesce(m["real_author"], m["author"]))
    return F.sort_array(F.array_distinct(F.filter(who, lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("owner_email")))))


def score(rows: DataFrame, predicates: list[tuple[str, float, Column]], rejects: list[tuple[str, Column]] = ()) -> DataFrame:
    """RV-1, AG-3, UX-3: ``rows`` with ``applied`` and ``total`` for the predicates that hold; rejected rows vanish."""
    for _, c in rejects:
        rows = rows.filter(~F.coalesce(c, F.lit(False)))
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("score"))) for n, s, c in predicates)))
    return rows.withColumn("_h", hits).withColumns({"applied": F.transform("_h", lambda x: x["name"]), "total": F.aggregate("_h", F.lit(0.0), lambda a, x: a + x["score"])}).drop("_h")


def ranked(rows: DataFrame, total: str, updated: str, ident: str) -> DataFrame:
    """OR-1: by total and time downwards, then ids, numbers as numbers before texts."""
    return rows.orderBy(F.desc(total), F.desc(updated), F.col(ident).try_cast("bigint").asc_nulls_last(), F.col(ident))


def categorize(categories: list[tuple[str, Column]], rest: str = "Remainder") -> Column:
    """OR-4: the name of the first category whose filter holds."""
    out = None
    for name, c in categories:
        out = F.when(c, name) if out is None else out.when(c, name)
    return F.lit("") if out is None else out.otherwise(rest)


def last_message_time(prefix: str) -> Column:
    """AG-12: the time of the last message that begins with ``prefix``."""
    hit = F.filter("messages", lambda m: F.startswith(m["message"], F.lit(prefix)))
    return F.try_element_at(hit, F.lit(-1))["date"]


def owner_update_time() -> Column:
    """AG-13: when the owner uploaded the latest of their own revisions."""
    own = F.filter("revisions", lambda r: r["uploader"] == F.col("owner_email"))
    return F.try_element_at(own, F.lit(-1))["created"]
