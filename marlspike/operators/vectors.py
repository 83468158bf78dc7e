"""Dot products, exact search and its options (VS, JN-1, JN-11)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.session import small


def dot(a: Column, b: Column) -> Column:
    """VS-1: sum of products in double precision over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """VS-2: unit length, unless the length is at most 1e-10."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm <= 1e-10, v).otherwise(F.transform(v, lambda x: x * (F.lit(1.0) / norm).cast("float")))


def encode(v: Column) -> Column:
    """VS-3: big-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, dtype=">f4").tobytes())

    return run(v)


def decode(b: Column) -> Column:
    """VS-3: the inverse of ``encode``."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.frombuffer(x, dtype=">f4").astype("float32"))

    return run(b)


def top_k(df: DataFrame, query: list[float], k: int, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """VS-4: the ``k`` best (id, score) by score, then larger id; vectors of another length are passed over.

    The query is a literal, so the scan scores rows as it reads them and each task keeps ``k``.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = df.filter(F.size(vec) == len(query)).select(id_col, dot(F.col(vec), q).alias("score"))
    return rows.orderBy(F.desc("score"), F.desc(id_col)).limit(k)


def search(df: DataFrame, query: list[float], limit: int = 20, threshold: float | None = None, kind: str | None = None, allow: list[str] | None = None, deny: list[str] | None = None, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """VS-7, VS-10: top hits, then the threshold, then kinds; both apply after the limit, so fewer may remain."""
    if limit < 0 or not (threshold is None or 0 <= threshold <= 1):
        raise ValueError("limit must be at least 0, threshold between 0 and 1")
    extra = df.select(id_col, kind) if kind else None
    hits = top_k(df, query, limit or 20, id_col, vec)
    if threshold is not None:
        hits = hits.filter(F.col("score") >= threshold)
    if extra is not None:
        hits = hits.join(extra, id_col, "left")
        if allow:
            hits = hits.filter(F.col(kind).isin(allow))
        if deny:
            hits = hits.filter(~F.coalesce(F.col(kind).isin(deny), F.lit(False)))
    return hits


def is_url(text: Column) -> Column:
    """VS-15: an absolute address with a scheme, no white space, and something after the colon."""
    return F.coalesce(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:/(/[^\s?#]|[^\s/])\S*$"), F.lit(False))


def resolve_queries(asked: DataFrame, store: DataFrame, embed: Callable[[Column], Column], id_col: str = "id", vec: str = "vec", longest_id: int = 700) -> DataFrame:
    """VS-8, VS-9: (query, q, vec) of questions (``query``, ``q``): the stored vector where the trimmed text is an id, else its embedding.

    Blank and null questions vanish; texts of ``longest_id`` characters or more are never ids. Then ``batch_top_k`` searches.
    """
    trimmed = asked.select("query", F.trim("q").alias("q")).filter("q <> ''")
    ids = store.select(F.col(id_col).cast("string").alias("_id"), F.col(vec).alias("_v"))
    found = trimmed.join(ids, (F.col("q") == F.col("_id")) & (F.length("q") < longest_id), "left")
    return found.select("query", "q", F.coalesce("_v", embed(F.col("q"))).alias("vec"))


def drop_first_self(hits: DataFrame, self_id, keep: int, id_col: str = "id") -> DataFrame:
    """VS-12: hits without the document itself if it ranks first, cut to ``keep``. ``hits`` are a bounded list."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc(id_col)))
    ranked = hits.withColumn("_r", rank)
    first = ranked.filter((F.col("_r") > 1) | (F.col(id_col) != self_id))
    return first.orderBy("_r").limit(keep).drop("_r")


def batch_top_k(df: DataFrame, queries: DataFrame, k: int, dim: int, id_col: str = "id", vec: str = "vec", block: int = 512, held: int = 8_000_000) -> DataFrame:
    """VS-4 for a set of queries against all rows, exactly: (query, id, score), larger ids first on ties.

    Queries are cut into sets of about ``held`` numbers, which bounds what a task and the driver hold; each set meets the
    rows as matrix products in one pass, rows never meet in pairs, and every task keeps ``k`` per query before
    anything is shuffled. Self hits stay in; vectors of another length are passed over; no query is left out.
    """
    asked = queries.filter(F.size(vec) == dim).select(F.col(id_col).alias("query"), F.col(vec).alias("qv"))
    sets = max(1, -(-asked.count() * dim // held))
    rows = df.filter(F.size(vec) == dim).select(id_col, vec)
    out = None
    for n in range(sets):
        part = _one_set(rows, asked.filter(F.pmod(F.xxhash64("query"), F.lit(sets)) == n), k, id_col, vec, block)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("id"))
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _one_set(rows: DataFrame, asked: DataFrame, k: int, id_col: str, vec: str, block: int) -> DataFrame:
    """The best ``k`` rows of each task for each query of one bounded set."""
    kind = dict(rows.dtypes)[id_col]
    sent = asked.toPandas().sort_values("query", ignore_index=True)
    data = [(list(sent["query"][i : i + block]), np.array(list(sent["qv"][i : i + block]), dtype=np.float64)) for i in range(0, len(sent), block)]
    shared = rows.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple | None] = [None] * len(shared.value)
        for b in batches:
            if not len(b):
                continue
            m, ids = np.array(list(b[vec]), dtype=np.float64), b[id_col].to_numpy()
            for i, (_, q) in enumerate(shared.value):
                s, d = q @ m.T, np.broadcast_to(ids, (len(q), len(ids)))
                if best[i] is not None:
                    s, d = np.hstack([best[i][0], s]), np.hstack([best[i][1], d])
                # Sort by id, then stably by score, both downwards.
                o = np.argsort(d, axis=1, kind="stable")[:, ::-1]
                s, d = np.take_along_axis(s, o, 1), np.take_along_axis(d, o, 1)
                o = np.argsort(-s, axis=1, kind="stable")[:, :k]
                best[i] = (np.take_along_axis(s, o, 1), np.take_along_axis(d, o, 1))
        for i, (names, _) in enumerate(shared.value):
            if best[i] is not None:
                s, d = best[i]
                yield pd.DataFrame({"query": np.repeat(np.array(names), s.shape[1]), "id": d.ravel(), "score": s.ravel()})

    return rows.mapInPandas(run, f"query {kind}, id {kind}, score double")


def quote_embed(text: Column) -> Column:
    """TX-15: a test embedding of 123 numbers: 122 leading bytes over 256, then -1, scaled to unit length."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            v = np.zeros(123, dtype=np.float32)
            raw = (t or "").encode()[:122]
            v[: len(raw)] = np.frombuffer(raw, dtype=np.uint8) / np.float32(256)
            v[len(raw)] = -1
            return v / np.float32(np.sqrt((v.astype(np.float64) ** 2).sum()))

        return s.map(one)

    return run(text)


def unquote(v: list[float]) -> str:
    """TX-15: the text a quote embedding came from."""
    a = np.asarray(v, dtype=np.float64)
    end = int(np.flatnonzero(a < 0)[0])
    return bytes(int(round(x / -a[end] * 256)) for x in a[:end]).decode(errors="ignore")


def titled(hits: DataFrame, docs: DataFrame, id_col: str = "id") -> DataFrame:
    """JN-1: hits with their titles, empty where the document is unknown; hits are few, so they are broadcast where proven so."""
    return small(hits, 10_000).join(docs.select(id_col, "title"), id_col, "left").withColumn("title", F.coalesce("title", F.lit("")))
