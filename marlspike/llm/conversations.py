"""Conversations from message rows: sessions by channel, reply trees in reading order, roles, soundness.

Messages are sorted by time and split where a channel is silent for longer than a gap; where the channel itself is the
conversation, as with discussions, the gap has no end. Sessions that are broken or lack the replies asked for are
dropped. Reading order puts each message at the end of the path of its ancestors and sorts by path; paths come from
pointer doubling and ranks from a range sort, so no channel is ever gathered in a task. A path is as long as its
message is deep.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.operators.ordered import rank_in
from marlspike.session import cut

_DISCUSSION = r"(?i)^(?:https?:)?//[^/]+/+(?:repos/+)?([^/?#]+)/+([^/?#]+)/+discussions/+(\d+)(?:[/?#].*)?$"
_COMMENT = r"(?i)#discussioncomment-(\d+)\s*$"


def discussion_project(url: Column) -> Column:
    """``owner/name`` in lower case of a discussion's address, however it is written; null for anything else."""
    u = F.trim(url)
    return F.when(u.rlike(_DISCUSSION), F.lower(F.concat_ws("/", F.regexp_extract(u, _DISCUSSION, 1), F.regexp_extract(u, _DISCUSSION, 2))))


def discussion_number(url: Column) -> Column:
    """The number in a discussion's address, or null."""
    return F.regexp_extract(F.trim(url), _DISCUSSION, 3).try_cast("bigint")


def reply_target(url: Column) -> Column:
    """The comment that a reply link names: null for no reply, -1 for a link that names nothing known."""
    named = F.regexp_extract(url, _COMMENT, 1).try_cast("bigint")
    return F.when(F.coalesce(url.rlike(r"(?U)^\s*$"), F.lit(True)), None).when(named.isNotNull(), named).when(F.trim(url).rlike(_DISCUSSION), None).otherwise(F.lit(-1))


def blank(text: Column) -> Column:
    """Null, empty or nothing but white space, Unicode spaces included."""
    return F.coalesce(text.rlike(r"(?U)^\s*$"), F.lit(True))


def calibrate_gap(messages: DataFrame, channel: list[str], accuracy: int = 10_000, quantile: float = 0.99) -> int:
    """An inactivity gap in microseconds: the ``quantile`` of the time between a message and the one it replies to.

    ``messages``: channel keys, ``id``, ``parent``, ``at``. At least an hour, also where there are no replies.
    """
    p = messages.select(*channel, F.col("id").alias("parent"), F.col("at").alias("_p"))
    took = messages.join(p, [*channel, "parent"]).select((F.col("at") - F.col("_p")).alias("d")).filter("d >= 0")
    q = took.agg(F.percentile_approx("d", quantile, accuracy)).first()[0]
    return max(3_600_000_000, int(q or 0))


def sessionize(messages: DataFrame, channel: list[str], gap_us: int | None) -> DataFrame:
    """``messages`` (channel keys, ``at`` in microseconds) with ``session_no``, counted from 1 in each channel.

    A session ends where more than ``gap_us`` pass without a message. Time is cut into buckets as wide as the gap:
    none of them holds a break, so only the first and last time of each bucket are compared, of which a channel
    has at most (time span / gap). Without a gap every channel is session 1. Null times get the session null where
    there is a gap; equal times share a session; repeated rows stay; an empty table stays empty.
    """
    if gap_us is None:
        return messages.withColumn("session_no", F.lit(1).cast("bigint"))
    bucket = F.floor(F.col("at") / F.lit(gap_us))
    ends = messages.filter("at IS NOT NULL").groupBy(*channel, bucket.alias("_b")).agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"))
    w = Window.partitionBy(*channel).orderBy("_b")
    breaks = F.when(F.col("_lo") - F.lag("_hi").over(w) > gap_us, 1).otherwise(0)
    numbered = ends.withColumn("_x", breaks).select(*channel, "_b", (F.sum("_x").over(w) + 1).alias("session_no"))
    return messages.withColumn("_b", bucket).join(numbered, [*channel, "_b"], "left").drop("_b")


#: What makes a session a conversation, as aggregates over (role, login, replied, to_login): somebody other than the asker
#: and bots speaks; or one speaker replies to another. A missing login is a speaker other than every known one; missing
#: ones can't be told apart, so a reply among them is none to another.
ANSWERED = "coalesce(max(role IN ('maintainer', 'participant')), false)"
RECIPROCAL = "coalesce(max(replied AND NOT (login <=> to_login)), false)"


def reply_paths(messages: DataFrame, channel: list[str]) -> DataFrame:
    """``messages`` (channel keys, ``id``, ``parent``, ``at``) with ``path``, the (at, id) of all ancestors and itself.

    ``path`` is null for messages in or below a circle of replies. Parents must exist in the same channel. Pointer
    doubling takes log2(depth) joins; each round is written to the shared folder.
    """
    n = messages.groupBy(*channel).count().agg(F.max("count")).first()[0] or 0
    rows = cut(messages.select(*channel, "id", F.col("parent").alias("_to"), F.array(F.struct("at", "id")).alias("path"), F.lit(False).alias("_ring")))
    for _ in range(math.ceil(math.log2(n + 2)) + 1):
        if not rows.filter("_to IS NOT NULL").limit(1).count():
            break
        up = rows.select(*channel, F.col("id").alias("_to"), F.col("_to").alias("_next"), F.col("path").alias("_up"), F.col("_ring").alias("_upring"))
        todo = rows.filter("_to IS NOT NULL").join(up, [*channel, "_to"], "left")
        above = F.coalesce("_up", F.array().cast("array<struct<at:bigint,id:bigint>>"))
        ring = F.coalesce("_upring", F.lit(False)) | F.exists(above, lambda e: e["id"] == F.col("id"))
        path = F.when(ring, F.col("path")).otherwise(F.concat(above, "path")).alias("path")
        done = todo.select(*channel, "id", F.when(~ring, F.col("_next")).alias("_to"), path, ring.alias("_ring"))
        rows = cut(rows.filter("_to IS NULL").unionByName(done))
    good = rows.select(*channel, "id", F.when(F.col("_to").isNull() & ~F.col("_ring"), F.col("path")).alias("path"))
    return messages.join(good, [*channel, "id"])


def conversations(messages: DataFrame, channel: list[str], gap_us: int | None = None, cut_replies: bool = False, sound: str = ANSWERED) -> DataFrame:
    """Sound conversations: the rows of ``messages`` in them, with ``session_no`` and ``turn_no``.

    ``messages``: channel keys, ``id`` (unique), ``parent``, ``at`` in microseconds, ``role``, ``login``; nothing else passes
    through. Channels are split at silences longer than ``gap_us``. A session is sound if each of its messages has a
    time, each parent is a message of the same session that isn't later, replies form no circle, and the aggregate
    ``sound`` holds. With ``cut_replies`` a reply to another session of the channel counts as none. Broken sessions vanish
    whole, and messages without a time do where there is a gap; an empty table gives an empty one.
    """
    numbered = sessionize(messages.select(*channel, "id", "parent", "at", "role", "login"), channel, gap_us).filter("session_no IS NOT NULL")
    m, key = cut(numbered), [*channel, "session_no"]
    p = m.select(*channel, F.col("session_no").alias("_psession"), F.col("id").alias("parent"), F.lit(True).alias("_there"), F.col("at").alias("_pat"), F.col("login").alias("to_login"))
    seen = m.join(p, [*channel, "parent"], "left")
    same = F.coalesce(F.col("_psession") == F.col("session_no"), F.lit(False))
    away = F.coalesce("_there", F.lit(False)) & ~same & F.lit(cut_replies)
    seen = seen.withColumns({"replied": same, "parent": F.when(~away, F.col("parent"))})
    fine = F.col("at").isNotNull() & (F.col("parent").isNull() | (same & F.coalesce(F.col("_pat") <= F.col("at"), F.lit(False))))
    good = seen.groupBy(*key).agg(F.min(fine).alias("_fine"), F.expr(sound).alias("_sound")).filter("_fine AND _sound").select(*key)
    kept = seen.select(*key, "id", "parent", "at", "role", "login") if cut_replies else m
    paths = reply_paths(cut(kept.join(good, key, "left_semi")), key)
    ringed = paths.filter("path IS NULL").select(*key).distinct()
    return rank_in(paths.join(ringed, key, "left_anti"), key, ["path"], "turn_no").drop("path")
