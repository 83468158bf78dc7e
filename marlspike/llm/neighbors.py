"""The k most similar vectors of every vector by shifted Hilbert curves.

Unit vectors are turned and projected at random onto a few dimensions, once per curve; every curve orders them by
their place on a shifted Hilbert curve. The curves are range-partitioned and sorted; a window slides over neighbouring
keys and scores them against each other as matrix products, on vectors of one byte per number that travel once per
curve. The lists of all curves merge and the best are scored again on the full vectors. Vectors whose neighbours came up
on few curves lie in crowds too large for such windows and are searched once more in far larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.operators.ordered import rank_in
from marlspike.session import cut


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``cells`` (n x d integers below 2**bits), as int64."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of each level, the coarsest first
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _unit(vecs) -> np.ndarray:
    v = np.stack([np.asarray(x, dtype=np.float64) for x in vecs])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _dot(a: str, b: str) -> Column:
    """The dot product of two columns of equal length, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def usable(df: DataFrame, dim: int) -> DataFrame:
    """Rows whose ``vec`` has ``dim`` finite numbers, not all zero."""
    x = F.col("vec")
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return df.filter((F.size(x) == dim) & finite & F.exists(x, lambda e: e != 0))


def directed(vectors: DataFrame) -> DataFrame:
    """``vectors`` (``id``, ``vec``) with ``norm`` and ``dir``, a 128-bit hash of the direction to six digits.

    Copies that scaling rounded apart get different hashes and are found like other vectors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.stack([np.asarray(x, dtype=np.float64) for x in b["vec"]])
                norm = np.linalg.norm(v, axis=1)
                digits = np.rint(v / norm[:, None] * 1e6).astype(np.int32)
                yield b.assign(norm=norm, dir=[xxhash.xxh3_128_digest(x.tobytes()) for x in digits])

    return vectors.mapInPandas(run, "id string, vec array<float>, norm double, dir binary")


def curve_keys(vectors: DataFrame, dim: int, curves: int, dims: int, bits: int, seed: int, spread: float) -> DataFrame:
    """(curve, key, id) for every vector and curve. Each curve has its own random turn and shift."""
    rng = np.random.default_rng(seed)
    turns = [(np.linalg.qr(rng.standard_normal((dim, dims)))[0], rng.random(dims)) for _ in range(curves)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            u = _unit(b["vec"])
            for c, (turn, shift) in enumerate(turns):
                at = (np.clip(u @ turn / spread, -0.5, 0.5) + 0.5 + shift) / 2
                key = hilbert_key(np.minimum((at * 2**bits).astype(np.int64), 2**bits - 1), bits)
                yield pd.DataFrame({"curve": np.int32(c), "key": key, "id": b["id"]})

    return vectors.select("id", "vec").mapInPandas(run, "curve int, key bigint, id string")


def _largest(s: np.ndarray, m: int, group: int = 64) -> np.ndarray:
    """The columns of the ``m`` largest entries of each row, in any order."""
    n = s.shape[1]
    if m >= n:
        return np.broadcast_to(np.arange(n), s.shape)
    if n < 4 * group * m:
        return np.argpartition(-s, m - 1, axis=1)[:, :m]
    # The m largest lie in the m groups of columns whose maxima are largest; what is left over is a group of its own.
    whole = n // group * group
    tops = s[:, :whole].reshape(len(s), -1, group).max(axis=2)
    g = np.argpartition(-tops, m - 1, axis=1)[:, :m]
    at = (g[:, :, None] * group + np.arange(group)).reshape(len(s), -1)
    at = np.hstack([at, np.broadcast_to(np.arange(whole, n), (len(s), n - whole))])
    best = np.argpartition(-np.take_along_axis(s, at, axis=1), m - 1, axis=1)[:, :m]
    return np.take_along_axis(at, best, axis=1)


#: How far a score on bytes may lie from the exact one; candidates within it of a threshold are scored again.
ROUGH = 0.02


def slide(vectors: DataFrame, dim: int, k: int, min_score: float, curves: int, dims: int, bits: int, block: int, overlap: int, seed: int, spread: float) -> DataFrame:
    """(id, other, rough, curve): for every vector its best ``k`` within ``overlap`` places or more on each curve, by scores on bytes.

    One row per vector and curve is shuffled, its numbers cut to bytes. A task reads its range of a curve in order and
    holds a window of ``block + 2 * overlap`` rows, whatever the size of the range.
    """
    rng = np.random.default_rng(seed)
    turns = [(np.linalg.qr(rng.standard_normal((dim, dims)))[0], rng.random(dims)) for _ in range(curves)]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            u = _unit(b["vec"])
            scale = np.abs(u).max(axis=1) / 127
            byte = [x.tobytes() for x in np.rint(u / scale[:, None]).astype(np.int8)]
            for c, (turn, shift) in enumerate(turns):
                at = (np.clip(u @ turn / spread, -0.5, 0.5) + 0.5 + shift) / 2
                key = hilbert_key(np.minimum((at * 2**bits).astype(np.int64), 2**bits - 1), bits)
                yield pd.DataFrame({"curve": np.int32(c), "key": key, "id": b["id"], "q": byte, "scale": scale.astype(np.float32)})

    def score(ids: np.ndarray, v: np.ndarray, lo: int, hi: int, curve: int) -> pd.DataFrame:
        """The best of rows ``lo`` to ``hi`` among all rows of the window."""
        m = min(k, len(v) - 1)
        s = v[lo:hi] @ v.T
        s[np.arange(hi - lo), np.arange(lo, hi)] = -2
        top = _largest(s, m)
        rough = np.take_along_axis(s, top, axis=1).ravel()
        a, b, keep = np.repeat(np.arange(lo, hi), m), top.ravel(), rough >= min_score - ROUGH
        return pd.DataFrame({"id": ids[a[keep]], "other": ids[b[keep]], "rough": rough[keep].astype(np.float64), "curve": np.int32(curve)})

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, v, curve, done = np.zeros(0, object), np.zeros((0, dim), np.float32), -1, 0

        def flush(end: int) -> Iterator[pd.DataFrame]:
            """Score rows from ``done`` to ``end`` in blocks."""
            nonlocal ids, v, done
            while done < end:
                to = min(done + block, end)
                lo, hi = max(0, done - overlap), min(len(v), to + overlap)
                if hi - lo > 1:
                    yield score(ids[lo:hi], v[lo:hi], done - lo, to - lo, curve)
                done = to
            cut_at = max(0, done - overlap)
            ids, v, done = ids[cut_at:], v[cut_at:], done - cut_at

        for b in batches:
            for c, of in b.groupby("curve", sort=True):
                if c != curve:
                    yield from flush(len(v))
                    ids, v, curve, done = np.zeros(0, object), np.zeros((0, dim), np.float32), int(c), 0
                new = np.frombuffer(b"".join(of["q"]), dtype=np.int8).reshape(-1, dim) * of["scale"].to_numpy()[:, None]
                ids, v = np.concatenate([ids, of["id"].to_numpy()]), np.concatenate([v, new.astype(np.float32)])
                # Whole blocks only, with all rows that follow within the overlap at hand.
                yield from flush(done + max(0, len(v) - overlap - done) // block * block)
        yield from flush(len(v))

    rows = vectors.select("id", "vec").mapInPandas(keys, "curve int, key bigint, id string, q binary, scale float")
    spread_out = rows.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    return spread_out.mapInPandas(windows, "id string, other string, rough double, curve int")


def candidates(vectors: DataFrame, dim: int, k: int, min_score: float, curves: int, dims: int, bits: int, block: int, overlap: int, seed: int, spread: float, parts: int = 1) -> DataFrame:
    """(id, other, score, curve): for every vector its best ``k`` in each run of each curve, not below ``min_score``.

    ``vectors``: ``id``, ``vec`` and, if only some are asked for, ``ask``. A run is scored by ``parts`` tasks.
    """
    ask = F.col("ask") if "ask" in vectors.columns else F.lit(True)
    ranked = rank_in(curve_keys(vectors, dim, curves, dims, bits, seed, spread), ["curve"], ["key", "id"], "n")
    runs = F.array_distinct(F.array(F.floor(F.col("n") / block), F.floor((F.col("n") + overlap) / block)))
    rows = ranked.select("id", "curve", F.explode(runs).alias("run")).join(vectors.select("id", "vec", ask.alias("mine")), "id")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.withColumn("mine", F.col("mine") & (F.pmod(F.xxhash64("id"), F.lit(parts)) == F.col("part")))

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # One order whatever order the rows arrive in, so that a task run again gives the same rows.
        pdf = pdf.sort_values("id", ignore_index=True)
        ids, asked = pdf["id"].to_numpy(), np.flatnonzero(pdf["mine"])
        v = np.stack(pdf["vec"].to_numpy())
        norm = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
        flat = (v / norm[:, None]).astype(np.float32)
        m = min(k, len(v) - 1)
        out = [pd.DataFrame({"id": ids[:0], "other": ids[:0], "score": np.zeros(0)})]
        step = max(64, (1 << 22) // len(v))
        for i in range(0, len(asked) if m else 0, step):
            q = asked[i : i + step]
            s = flat[q] @ flat.T
            s[np.arange(len(q)), q] = -2
            top = _largest(s, m)
            a, b = np.repeat(q, m), top.ravel()
            near = np.take_along_axis(s, top, axis=1).ravel() >= min_score - 1e-4
            a, b = a[near], b[near]
            exact = np.einsum("ij,ij->i", v[a], v[b], dtype=np.float64) / norm[a] / norm[b]
            keep = (exact >= min_score) & (a != b)
            out.append(pd.DataFrame({"id": ids[a[keep]], "other": ids[b[keep]], "score": exact[keep]}))
        return pd.concat(out, ignore_index=True).assign(curve=np.int32(key[0]))

    return rows.groupBy("curve", "run", "part").applyInPandas(best, "id string, other string, score double, curve int")


def crowded(reps: DataFrame, found: DataFrame, sure: float) -> DataFrame:
    """(id, vec, ask): the vectors whose neighbours came up on fewer than ``sure`` curves on average, and those neighbours.

    A neighbour that lies beside its vector on many of the curves can hardly be missed by all of them. In a crowd the
    best ones come up on one curve or two, so as many others came up on none.
    """
    weak = cut(found.groupBy("id").agg(F.avg("hits").alias("_h")).filter(F.col("_h") < sure).select("id"))
    near = found.join(weak, "id", "left_semi").select(F.col("other").alias("id"), F.lit(False).alias("ask"))
    who = weak.withColumn("ask", F.lit(True)).unionByName(near).groupBy("id").agg(F.max("ask").alias("ask"))
    return reps.join(who, "id").select("id", "vec", "ask")


def nearest(
    df: DataFrame,
    dim: int,
    k: int = 5,
    min_score: float = -1.0,
    curves: int = 16,
    dims: int = 8,
    bits: int = 7,
    block: int = 512,
    overlap: int = 192,
    seed: int = 7,
    spread: float = 1.0,
    sure: float = 6.0,
    wide: int = 131_072,
    wide_curves: int = 8,
) -> DataFrame:
    """For every row of ``df`` (``id`` unique, ``vec``) its ``k`` most similar others: (id, other, rank, score).

    The score is the dot product after scaling to unit length, ties go to the smaller id. Rows whose vector is
    null, of another length, zero or not finite are left out; other columns are ignored; an empty table gives an
    empty one. Vectors whose directions agree to six digits are searched once: such copies score 1 and lead each
    other's lists, however many there are and whatever their lengths. Approximate: a neighbour is found if it lies within
    ``overlap`` places on any of the ``curves``; the tests measure recall. Vectors whose
    neighbours came up on fewer than ``sure`` curves lie in a crowd and are searched again: up to ``wide`` of them
    all against all, more in runs of ``wide`` on ``wide_curves`` finer curves, each run split over tasks.
    """
    vectors = cut(directed(usable(df.select("id", F.col("vec").cast("array<float>").alias("vec")), dim)))
    first = F.min_by(F.struct("vec", "norm"), "id")
    klass = vectors.groupBy("dir").agg(F.min("id").alias("klass"), first.alias("v"), F.count(F.lit(1)).alias("copies"))
    klass = cut(klass)
    reps = klass.select(F.col("klass").alias("id"), "v.vec", "v.norm")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")

    def merge(rows: DataFrame) -> DataFrame:
        each = rows.groupBy("id", "other").agg(F.max("score").alias("score"))
        return each.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")

    # A few more than asked for, so that scores on bytes don't decide who is among the best.
    near = slide(reps, dim, k + 3, min_score, curves, dims, bits, block, overlap, seed, spread)
    rough = near.groupBy("id", "other").agg(F.max("rough").alias("score"), F.count(F.lit(1)).alias("hits"))
    rough = rough.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 3).drop("_r", "score")
    exact = rough.join(reps.select("id", F.col("vec").alias("_a"), F.col("norm").alias("_na")), "id")
    exact = exact.join(reps.select(F.col("id").alias("other"), F.col("vec").alias("_b"), F.col("norm").alias("_nb")), "other")
    exact = exact.select("id", "other", "hits", (_dot("_a", "_b") / F.col("_na") / F.col("_nb")).alias("score")).filter(F.col("score") >= min_score)
    found = cut(exact.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r"))
    again = cut(crowded(reps, found, min(sure, curves)))
    n = again.count()
    if n > 1:
        one = n <= wide
        size, lap = (n + 1, 0) if one else (wide, wide * 3 // 8)
        second = candidates(again, dim, k, min_score, 1 if one else wide_curves, 4, 15, size, lap, seed + 1, spread, min(12, -(-size // 4096)))
        found = merge(found.select("id", "other", "score").unionByName(second.select("id", "other", "score")))

    member = vectors.select("id", "dir").join(klass.drop("v"), "dir").select("klass", "id", "copies")
    first = Window.partitionBy("klass").orderBy("id")
    heads = member.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1).select("klass", F.col("id").alias("other"))
    near = found.select(F.col("id").alias("for"), F.col("other").alias("klass"), "score").join(heads, "klass").select(F.col("for").alias("klass"), "other", "score")
    own = heads.join(klass.filter("copies > 1").select("klass"), "klass").select("klass", "other", F.lit(1.0).alias("score")).filter(F.lit(1.0) >= min_score)
    shared = Window.partitionBy("klass").orderBy(F.desc("score"), "other")
    lists = own.unionByName(near).groupBy("klass", "other").agg(F.max("score").alias("score")).withColumn("_r", F.row_number().over(shared)).filter(F.col("_r") <= k + 1).drop("_r")
    mine = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return member.select("klass", "id").join(lists, "klass").filter("id <> other").withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k).select("id", "other", "rank", "score")
