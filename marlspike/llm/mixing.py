"""Mixing sources to target weights by temperature, with capped repeats, as budgeted block permutations."""

from __future__ import annotations

import functools
import math
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.operators.ordered import running_sum
from marlspike.session import small

#: Where the public tokenizers lie; a parameter of every operator that counts tokens.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


@functools.cache
def tokenizer(path: str):
    """The encoder in a ``.tiktoken`` rank file, one per worker."""
    import base64

    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``docs`` with the size of ``text`` in tokens of a public vocabulary; null and empty texts have none. Whole texts count."""
    path = os.path.join(folder, vocabulary)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return pd.Series([0 if x is None else len(t.encode_ordinary(x)) for x in texts], dtype="int64")

    return docs.withColumn(out, count(F.col(text)))


def source_key(c: Column) -> Column:
    """A source's name without outer spaces and case."""
    return F.lower(F.trim(c))


def sized(docs: DataFrame, **tokens) -> DataFrame:
    """(doc_id, source, tokens) of all documents, ``source`` without outer spaces and case; texts are counted here and nowhere else."""
    ids = "doc_id" if "doc_id" in docs.columns else F.lit(None).cast("bigint").alias("doc_id")
    return token_counts(docs.select(ids, source_key(F.col("source")).alias("source"), "text"), **tokens).drop("text")


def source_sizes(counted: DataFrame, targets: DataFrame) -> list[dict]:
    """Per target source: name, key, weight, share asked for, most repeats, its tokens and documents, and the tokens of all documents.

    ``counted`` comes from ``sized``; ``targets``: ``source``, ``weight``, ``max_repeats``, a row per source. Null or
    negative weights and repeats count as 0, rows without a name are left out; names that are equal without case and
    outer spaces are one source with their weights added up, the largest of their repeats and the smallest of their
    names. Documents of no target source count for the total only. Sums run before any shuffle, so a source with a
    third of all rows is no burden.
    """
    t = targets.filter("source IS NOT NULL").groupBy(source_key(F.col("source")).alias("k")).agg(
        F.min("source").alias("source"),
        F.sum(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight"),
        F.max(F.greatest(F.coalesce(F.col("max_repeats").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("max_repeats"),
    )
    named = t.join(counted.groupBy(F.col("source").alias("k")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "k", "full")
    # A row per target, and one for all that no target names.
    other = F.when(F.col("source").isNotNull(), F.col("k")).alias("k")
    rows = named.groupBy(other, "source").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("weight", "max_repeats", "tokens", "docs"))).orderBy("source").collect()
    total = sum(r["tokens"] for r in rows)
    out = [r.asDict() | {"total": total} for r in rows if r["source"] is not None]
    weights = sum(r["weight"] for r in out)
    return [r | {"target_share": r["weight"] / weights if weights else 0.0} for r in out]


def temper(sizes: dict[str, float], exponent: float, target: dict[str, float] | None = None) -> dict[str, float]:
    """The mixture at an exponent, scaled to one; sources without size or without a target stay out.

    Without ``target`` the shares of the sizes raised to ``exponent``: 1 keeps them, 0 makes them equal. With it the
    ratio of target and size is raised: 1 gives the target shares, 0 those of the sizes, what lies between is between.
    """
    raised = {k: math.exp(exponent * math.log(v)) for k, v in sizes.items() if v > 0}
    if target is not None:
        raised = {k: math.exp(exponent * math.log(target[k] / v) + math.log(v)) for k, v in sizes.items() if v > 0 and target.get(k, 0) > 0}
    s = sum(raised.values())
    return {k: v / s for k, v in raised.items()} if s else {}


def entropy(shares: dict[str, float]) -> float:
    """Entropy in nats."""
    return -sum(v * math.log(v) for v in shares.values() if v > 0)


def fit_exponent(
    tokens: dict[str, float],
    budget: float,
    target_entropy: float | None = None,
    max_repeats: dict[str, float] | None = None,
    target: dict[str, float] | None = None,
    steps: int = 60,
) -> float:
    """The exponent in [0, 1] found by bisection, from one number per source.

    With ``target_entropy``: where the tempered shares reach it. Otherwise the one nearest to what is asked for at which
    ``budget`` tokens repeat no source more than ``max_repeats`` allows: asked for is ``target``, or equal shares.
    """
    fits = lambda x: all(w * budget <= (max_repeats or {}).get(k, 1) * tokens[k] * (1 + 1e-12) for k, w in temper(tokens, x, target).items())
    if target_entropy is not None:
        fits = lambda x: entropy(temper(tokens, x, target)) <= target_entropy
    best, lo, hi = (1.0, 1.0, 0.0) if target is not None and target_entropy is None else (0.0, 0.0, 1.0)
    if fits(best):
        return best
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


def plan(rows: list[dict], budget: float | None = None) -> list[dict]:
    """``rows`` of ``source_sizes`` with the tempered ``share`` and ``budget`` of each source, and whether it falls ``short``.

    The exponent is the largest at which a mixture of ``budget`` tokens (default: as many as all documents have) stays
    within the repeats of every source, so scarce sources pull all shares towards those of the sizes. A source is short if
    the limit cuts what it would give at exponent 1, the share asked for; sources without documents are. Where even the
    shares of the sizes exceed a limit (fewer than one repeat), that source gives what it may.
    """
    total = float(rows[0]["total"]) if rows else 0.0
    budget = total if budget is None else budget
    tokens = {r["k"]: float(r["tokens"]) for r in rows}
    most, target = {r["k"]: r["max_repeats"] for r in rows}, {r["k"]: r["target_share"] for r in rows}
    asked = {k: v for k, v in target.items() if most[k] >= 1}
    size = min(budget, sum(most[k] * tokens[k] for k in asked))
    x = fit_exponent(tokens, size, max_repeats=most, target=asked)
    share = temper(tokens, x, asked)
    out = []
    for r in rows:
        limit = r["max_repeats"] * r["tokens"]
        out.append(r | {"exponent": x, "share": share.get(r["k"], 0.0), "budget": min(share.get(r["k"], 0.0) * size, limit), "short": r["target_share"] * budget > limit})
    return out


def mix(counted: DataFrame, planned: list[dict], seed: int = 3, blocks: int = 64) -> DataFrame:
    """Realise a plan: (doc_id, source, copy, tokens, block, place) for every time a document is taken.

    ``counted`` comes from ``sized``; ``planned`` rows need ``k``, ``tokens`` and ``budget``. Each copy of a source is a
    permutation by keyed hash; copies follow one another, and a source is taken up to its budget in that order, stopping
    before the first document that would exceed it. A source's tokens are laid out evenly over ``blocks`` blocks of
    equal budget, so every block is a small mixture of the same shares; ``place`` orders a block, sources interleaved.
    Sums run over range-sorted pieces, nothing is gathered by source, so hot sources are fine. Documents of sources
    without a budget and those without an id aren't taken; repeated ids are each a document; an empty table gives none.
    """
    rows = [(r["k"], int(r["tokens"]), float(r["budget"])) for r in planned if r["budget"] > 0 and r["tokens"] > 0]
    spread = counted.sparkSession.createDataFrame(rows or [("", 0, 0.0)], "source string, _size bigint, _budget double")
    d = counted.filter("doc_id IS NOT NULL").join(small(spread), "source")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_budget") / F.col("_size")).cast("int"))))
    d = d.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "copy"))
    d = running_sum(d, ["source", "copy"], ["_key", "doc_id"], F.col("tokens"), "_run")
    end = (F.col("copy") - 1) * F.col("_size") + F.col("_run")
    d = d.withColumn("_end", end).filter(F.col("_end") <= F.col("_budget"))
    at = (F.col("_end") - F.col("tokens")) / F.col("_budget") * blocks
    block = F.least(F.floor(at), F.lit(blocks - 1)).cast("int")
    return d.select("doc_id", "source", "copy", "tokens", block.alias("block"), (at - block).alias("place"))
