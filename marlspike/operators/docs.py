"""Documents out of source entities (DP)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def issue_docs(events: DataFrame) -> DataFrame:
    """DP-1: (id, title, text) of issue rows whose JSON is readable and names a page."""
    j = F.try_parse_json("json")
    get = lambda p: F.try_variant_get(j, p, "string")
    d = events.filter(F.col("api") == "/issues").select(get("$.html_url").alias("id"), get("$.title").alias("title"), get("$.body").alias("text"))
    return d.filter("id IS NOT NULL").select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def discussion_docs(discussions: DataFrame) -> DataFrame:
    """DP-2: (id, title, text) of discussions, without their comments."""
    return discussions.filter("url IS NOT NULL").select(F.col("url").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("text"))


def change_docs(changes: DataFrame) -> DataFrame:
    """DP-3, OR-3: description, then all messages in order of time, equal times in their order, joined by blank lines."""
    at = F.transform(F.coalesce("messages", F.array().cast("array<struct<author:string,real_author:string,date:timestamp_ntz,message:string>>")), lambda m, i: F.struct(m["date"].alias("d"), i.alias("i"), F.trim(m["message"]).alias("m")))
    texts = F.transform(F.array_sort(at), lambda m: m["m"])
    parts = F.concat(F.array(F.trim(F.coalesce("description", F.lit("")))), F.array_compact(texts))
    text = F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")
    ident = F.concat(F.lit("https://"), "instance", F.lit("/c/"), "project", F.lit("/+/"), F.col("number").cast("string"), F.lit("#related-content"))
    return changes.filter("instance IS NOT NULL AND project IS NOT NULL AND number IS NOT NULL").select(ident.alias("id"), F.coalesce("subject", F.lit("")).alias("title"), text.alias("text"))


def first_message_docs(messages: DataFrame, thread: str, order: list[str], text: str) -> DataFrame:
    """DP-4: (id, text) with the first message of each thread."""
    first = messages.filter(F.col(thread).isNotNull()).groupBy(thread).agg(F.min_by(F.struct(F.col(text).alias("t")), F.struct(*order)).alias("_f"))
    return first.select(F.col(thread).alias("id"), F.coalesce(F.col("_f.t"), F.lit("")).alias("text"))


def corpus(*sources: DataFrame) -> DataFrame:
    """SO-4: one corpus; the first source that holds an id wins."""
    rows = None
    for i, s in enumerate(sources):
        s = s.select("id", "title", "text", F.lit(i).alias("_s"))
        rows = s if rows is None else rows.unionByName(s)
    return rows.groupBy("id").agg(F.min(F.struct("_s", "title", "text")).alias("_d")).select("id", "_d.title", "_d.text")
