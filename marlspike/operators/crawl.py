"""A crawl as repeated anti-joins (TM-18), and flags that live for a while (TM-21)."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.functions.text import clean_url, links, url_allowed
from marlspike.session import cut


def crawl(
    seeds: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    rules: list[tuple[str, bool]],
    known: DataFrame | None = None,
    now: int = 0,
    recrawl: int = 86_400_000_000,
    max_rounds: int | None = None,
) -> DataFrame:
    """All pages reached from ``seeds`` (``url``) over allowed links: (url, from_url, round, html).

    ``fetch`` maps (url, from_url) to the same with ``html``, null where a page can't be had. Each address is visited
    once per run, without fragment and query; those in ``known`` (``url``, ``last_crawl``) younger than ``recrawl`` are
    passed over. A round is one anti-join against all pages seen, written to the shared folder; nothing is
    gathered. Stops when a round finds nothing new; if pages are left after ``max_rounds`` it raises.
    """
    fresh = None if known is None else known.filter(F.col("last_crawl") > now - recrawl).select("url")

    def due(found: DataFrame, seen: DataFrame | None) -> DataFrame:
        new = url_allowed(found.filter("url IS NOT NULL").withColumn("url", clean_url(F.col("url"))), rules).filter("allowed")
        new = new.groupBy("url").agg(F.min("from_url").alias("from_url"))
        for old in (fresh, seen):
            new = new if old is None else new.join(old.select("url"), "url", "left_anti")
        return new

    rounds: list[DataFrame] = []
    seen: DataFrame | None = None
    todo = due(seeds.select("url", F.lit(None).cast("string").alias("from_url")), None)
    for n in itertools.count():
        pages = cut(fetch(todo).select("url", "from_url", F.lit(n).alias("round"), "html"))
        if not pages.limit(1).count():
            break
        if max_rounds is not None and n >= max_rounds:
            raise ValueError(f"pages are left after {max_rounds} rounds")
        rounds.append(pages)
        seen = pages if seen is None else seen.unionByName(pages)
        found = pages.select(F.explode(links(F.col("html"), F.col("url"))).alias("_l"), F.col("url").alias("from_url"))
        todo = due(found.select(F.col("_l").alias("url"), "from_url"), seen)
    return seen if seen is not None else seeds.sparkSession.createDataFrame([], "url string, from_url string, round int, html string")


def cached_flag(rows: DataFrame, flags: DataFrame, keys: list[str], flag: str, now: int, ttl: int, default: bool = True) -> DataFrame:
    """TM-21: ``rows`` with ``flag`` (``default`` where unknown) and whether it is ``stale``: unknown or older than ``ttl``."""
    f = flags.select(*keys, F.col(flag).alias("_f"), F.col("computed").alias("_c"))
    stale = F.col("_c").isNull() | (F.col("_c") < now - ttl)
    return rows.join(f, keys, "left").withColumns({flag: F.coalesce("_f", F.lit(default)), "stale": stale}).drop("_f", "_c")
