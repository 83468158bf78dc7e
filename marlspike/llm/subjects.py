"""Subject areas of documents: bisecting k-means over document vectors, leaves named by their terms, mixtures of leaves.

Terms are hashed into buckets. A document's vector is the TF-IDF of its terms within its language, projected by signed
hashing and scaled to unit length. Bisecting k-means splits the documents of each language into leaves; labels play no
part in that. The terms that tell a leaf from the rest of its language name its subject, by the labelled documents
that hold them. Every passage (a sentence or list entry) is spread over the leaves that its terms speak for, and the
mixture of leaves over all passages of a document gives its subjects.
"""

from __future__ import annotations

import functools
import html
import pickle
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.session import cut

_TAG = re.compile(r"<!--.*?-->|<(script|style|pre|code)\b.*?</\1>|</?[A-Za-z][^<>]*>", re.S | re.I)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_END = re.compile(r"(?<=[.!?:;])[\"')\]*_]*\s+|\n\s*\n|\n(?=[*#>-])")
_PLAIN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_INNER_CAPITAL = re.compile(r".[^\W\d_]*[a-zà-ÿ][A-ZÀ-Þ]")
_EDGE = ".,;:!?()[]{}\"'*_`“”¿¡>#…"

#: ISO 639 codes that name no language (several, none, undetermined, uncoded), by their first letters.
_NO_LANGUAGE = ("mu", "zx", "un", "mi")

#: Buckets that terms are hashed into; it bounds every table of terms below, whatever the vocabulary.
BUCKETS = 1 << 16
#: Numbers in a document vector.
DIM = 256
#: Vectors are clustered as whole numbers of about ``LENGTH``, at most ``BLOCK`` at a time, and split by directions of about ``REACH``:
#: products and sums stay below 2 ** 24, so float32 has them exact, in whatever order they are added.
LENGTH, REACH, BLOCK = 127, 100_000, 4096

ROWS = "doc_id bigint, lang string, words array<int>, sizes array<int>, terms array<int>"


@functools.lru_cache(maxsize=300_000)
def _term(token: str) -> str | None:
    """The term that a token stands for, None for names, numbers and signs."""
    w = token.strip(_EDGE)
    if not w or not _PLAIN.fullmatch(w) or _INNER_CAPITAL.match(w) or (w.isupper() and len(w) > 4):
        return None
    return w.lower()


def passages(text: str | None) -> Iterator[tuple[int, list[str]]]:
    """(words, terms) of each sentence or list entry; code, markup, names and numbers are no terms."""
    text = html.unescape(_TAG.sub(" ", _FENCE.sub("\n\n", text or "")))
    for s in _END.split(text):
        tokens = (s or "").split()
        if tokens:
            yield len(tokens), [w for w in map(_term, tokens) if w is not None]


@functools.lru_cache(maxsize=500_000)
def _bucket(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) % BUCKETS


def passage_rows(docs: DataFrame) -> DataFrame:
    """One row per stored document with the words of each passage and the buckets of its distinct terms, one after the other.

    ``docs``: ``doc_id``, ``text`` and, if there is one, ``lang``, of which the first two letters count.
    """
    lang = F.lower(F.regexp_extract(F.trim("lang"), r"^([A-Za-z]{2})", 1)) if "lang" in docs.columns else F.lit("")
    lang = F.when(lang.isin("", *_NO_LANGUAGE), None).otherwise(lang)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                ps = [(n, sorted({_bucket(w) for w in ws})) for n, ws in passages(text)]
                out.append(([n for n, _ in ps], [len(ws) for _, ws in ps], [w for _, ws in ps for w in ws]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "words": [o[0] for o in out], "sizes": [o[1] for o in out], "terms": [o[2] for o in out]})

    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", lang.alias("lang")).mapInPandas(run, ROWS)


# ---- languages


class Languages:
    """What is known of each language: documents, and in how many of them each bucket occurs."""

    def __init__(self, names: list[str], docs: np.ndarray, held: np.ndarray, common: float, weight: float):
        self.names = names
        whole = (held.sum(0) + 1e-3) / max(docs.sum(), 1)
        shares = (held + weight * whole) / (docs[:, None] + weight)
        self.telling = np.flatnonzero((shares >= common).any(axis=0))
        self.log = np.log(shares[:, self.telling]).astype(np.float32)
        self.prior = np.log((docs + 1) / (docs.sum() + len(docs))).astype(np.float32)
        self.held = held.sum(0)
        self.idf = np.log((docs[:, None] + 1) / (held + 1)).clip(min=0).astype(np.float32)
        slot = np.full(BUCKETS, -1, np.int64)
        slot[self.telling] = np.arange(len(self.telling))
        self.slot = slot

    def of(self, seen: np.ndarray) -> int:
        """The likeliest language of a document from the distinct buckets it holds."""
        at = self.slot[seen]
        return int((self.log[:, at[at >= 0]].sum(axis=1) + self.prior).argmax())


def languages(rows: DataFrame, least: float = 0.01, common: float = 0.02, weight: float = 20.0) -> Languages:
    """The languages that at least ``least`` of the documents name, so at most 1 / ``least``, learned from all documents.

    A document that names none, or a rare one, is read in the likeliest of them. Buckets held by ``common`` of a
    language's documents tell it; counts are drawn towards the whole corpus by ``weight`` documents. Where no document
    names a language there is one.
    """
    named = rows.groupBy("lang").count().collect()  # at most 27 ** 2 codes
    total = sum(r["count"] for r in named)
    names = sorted(r["lang"] for r in named if r["lang"] and r["count"] >= least * total)
    docs = np.array([next(r["count"] for r in named if r["lang"] == n) for n in names], dtype=np.float64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, of in b.groupby("lang"):
                k, n = np.unique(np.concatenate([np.unique(t) for t in of["terms"]] or [[]]).astype(np.int64), return_counts=True)
                yield pd.DataFrame({"lang": lang, "k": k, "n": n})

    told = rows.filter(F.col("lang").isin(names)) if names else rows.withColumn("lang", F.lit(""))
    got = told.select("lang", "terms").mapInPandas(count, "lang string, k int, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    if not names:
        names, docs = [""], np.array([float(total)])
    held = np.zeros((len(names), BUCKETS))
    for i, name in enumerate(names):
        of = got[got["lang"] == name]
        held[i, of["k"].to_numpy(dtype=np.int64)] = of["n"]
    return Languages(names, docs, held, common, weight)


# ---- document vectors and their leaves


def _signs(seed: int = 5, parts: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket goes in a document vector, and with which signs."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (BUCKETS, parts)), rng.choice(np.array([-1, 1], np.float32), (BUCKETS, parts))


def vector(terms: np.ndarray, idf: np.ndarray, signs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The unit vector of a document: logarithmic counts times ``idf``, projected; zero where nothing tells."""
    k, n = np.unique(terms, return_counts=True)
    w = (np.log1p(n) * idf[k])[:, None] * signs[1][k]
    v = np.bincount(signs[0][k].ravel(), weights=w.ravel(), minlength=DIM)
    norm = np.sqrt(v @ v)
    return (v / norm if norm > 1e-9 else v).astype(np.float32)


def _unit(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=-1, keepdims=True), 1e-9)


def _whole(v: np.ndarray) -> np.ndarray:
    """Vectors as whole numbers of a byte; zero stays zero."""
    return np.rint(_unit(v) * LENGTH).astype(np.int8)


def _toward(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The direction that parts what is nearer to ``right`` from what is nearer to ``left``."""
    return np.rint(_unit(_unit(right) - _unit(left)) * REACH).astype(np.float32)


class _Node:
    """A node of a language's tree: how many vectors it holds, their lengths (in 1,024ths) and sum, and its split, if it has one."""

    def __init__(self, error: float, n: int, norm: int = 0, s: np.ndarray | None = None, split: np.ndarray | None = None):
        self.n, self.split, self.s = n, split, s
        self.error = error  # negative: nothing to split
        self.tries: list[dict] | None = None  # None until vectors to start from are drawn
        if s is not None:
            self.fill(n, norm, s)

    def fill(self, n: int, norm: int, s: np.ndarray) -> None:
        self.n, self.norm, self.s = int(n), int(norm), s
        self.error = min(self.error, self.norm / 1024 - float(np.linalg.norm(s)))  # a part has no larger error than the whole

    def live(self) -> list[dict]:
        return [t for t in self.tries if not t["done"]]


def _tally(v: np.ndarray, top: str, splits: dict[str, np.ndarray], work: dict[str, np.ndarray | None], draws: int, seed: int) -> dict[str, tuple]:
    """What at most ``BLOCK`` vectors below the node ``top`` add to each node in ``work``: number, lengths, sum, vectors drawn.

    With directions, they are those of the vectors on the right of each. Without, they are those of all, and of the distinct
    vectors the ``draws`` with the lowest hashes are drawn. ``splits``: directions of the nodes above, parents first.
    """
    x = v.astype(np.float32)
    held = _below(x, top, splits)
    out = {}
    for path, w in work.items():
        at = held[path]
        if not len(at):
            continue
        own = x[at]
        norm = np.rint(np.sqrt(np.einsum("ij,ij->i", own, own).astype(np.float64)) * 1024).astype(np.int64)
        if w is None:
            salt = xxhash.xxh3_64_intdigest(path, seed)
            low = sorted({(xxhash.xxh3_64_intdigest(raw, salt), raw) for raw in map(bytes, v[at])})[:draws]
            out[path] = (np.int64(len(at)), norm.sum(), v[at].sum(axis=0, dtype=np.int64), low)
        else:
            right = own @ w.T > 0
            out[path] = (right.sum(axis=0), norm @ right, (right.T.astype(np.float32) @ own).astype(np.int64), [])
    return out


def _below(x: np.ndarray, top: str, splits: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Where the vectors of each node are among those of ``top``; a node's path is its parent's with 0 or 1."""
    held = {top: np.arange(len(x))}
    if splits:
        sides = x @ np.stack(list(splits.values())).T > 0
        for j, path in enumerate(splits):
            at = held[path]
            held[path + "0"], held[path + "1"] = at[~sides[at, j]], at[sides[at, j]]
    return held


def _add(total: dict, more: dict, draws: int) -> dict:
    """Add the tallies of ``more`` to ``total``."""
    for at, new in more.items():
        old = total.get(at)
        total[at] = new if old is None else (old[0] + new[0], old[1] + new[1], old[2] + new[2], sorted({*old[3], *new[3]})[:draws])
    return total


def _tallied(blocks: Iterable[tuple[int, np.ndarray]], draws: int, seed: int, splits: dict, work: dict, top: str = "") -> dict:
    """The sums of ``_tally`` by (language, path) over blocks of (language, vectors)."""
    total: dict = {}
    for lang, v in blocks:
        if lang in work:
            _add(total, {(lang, path): x for path, x in _tally(v, top, splits[lang], work[lang], draws, seed).items()}, draws)
    return total


def _ranked(nodes: dict, lang: int, leaves: int) -> list[str]:
    """The paths of the nodes of a language to split: the ``leaves`` - 1 with the largest errors, as no part has a larger error than the whole."""
    ranked = sorted((-n.error, len(path), path) for (of, path), n in nodes.items() if of == lang and n.error > 0)
    return [path for _, _, path in ranked[: max(leaves - 1, 0)]]


def _above(nodes: dict, lang: int, paths: Iterable[str], top: str = "") -> dict[str, np.ndarray]:
    """The directions of all nodes from ``top`` to the parents of ``paths``, parents first."""
    every = {path[:i] for path in paths for i in range(len(top), len(path))}
    return {path: nodes[lang, path].split for path in sorted(every, key=lambda path: (len(path), path))}


def grow(
    nodes: dict[tuple[int, str], _Node],
    tally: Callable[[dict, dict], dict],
    leaves: int,
    least: int = 8,
    steps: int = 12,
    top: str = "",
    floor: float = 0.0,
    held: int = -1,
    finish: Callable[[dict], dict] | None = None,
    at_once: int = 1 << 30,
) -> dict[tuple[int, str], _Node]:
    """Split the node ``top`` of each language into at most ``leaves``, by repeated two-means on the part with the largest error.

    ``tally(splits, work)`` goes over all vectors and gives the sums of ``_tally`` by (language, path). Nodes are worked on side by
    side, up to ``at_once`` in a pass, each in several tries of up to ``steps`` passes. Parts below ``least`` members or with
    an error below ``floor`` aren't split. Parts of at most ``held`` vectors are left to ``finish``, which gives the nodes below them.
    """

    def start(node: _Node, n: int, norm: int, s: np.ndarray, low: list) -> None:
        node.fill(n, norm, s)
        v = [np.frombuffer(raw, np.int8).astype(np.float64) for _, raw in low]
        node.tries = [{"w": _toward(*v[i : i + 2]), "steps": 0, "done": False, "got": None} for i in range(0, len(v) - 1, 2)]
        if node.n < least or not node.tries:
            node.error = -1.0

    def step(lang: int, path: str, n: np.ndarray, norm: np.ndarray, s: np.ndarray) -> None:
        node = nodes[lang, path]
        for i, t in enumerate(node.live()):
            same = t["got"] is not None and t["got"][0] == n[i] and (t["got"][2] == s[i]).all()
            t["steps"] += 1
            t["got"] = (n[i], norm[i], s[i]) if 0 < n[i] < node.n else None
            t["done"] = same or t["got"] is None or t["steps"] == steps
            if not t["done"]:
                t["w"] = _toward(node.s - s[i], s[i])
        if node.live():
            return
        fits = [-1.0 if t["got"] is None else float(np.linalg.norm(t["got"][2]) + np.linalg.norm(node.s - t["got"][2])) for t in node.tries]
        best = node.tries[int(np.argmax(fits))]
        if best["got"] is None:
            node.error = -1.0
            return
        n, norm, s = best["got"]
        node.split = best["w"]
        nodes[lang, path + "0"] = _Node(node.error, node.n - n, node.norm - norm, node.s - s)
        nodes[lang, path + "1"] = _Node(node.error, n, norm, s)

    langs = sorted({lang for lang, _ in nodes})
    while True:
        todo = [(lang, top) for lang in langs if nodes[lang, top].s is None]
        todo = todo or [(lang, path) for lang in langs for path in _ranked(nodes, lang, leaves) if nodes[lang, path].split is None and nodes[lang, path].error >= floor]
        large = sorted((x for x in todo if nodes[x].n > held), key=lambda x: (-nodes[x].error, x))[:at_once]
        if not todo:
            return nodes
        if not large:
            done = finish({x: nodes[x].error for x in todo})
            for x in todo:
                nodes[x] = _Node(-1.0, 0, s=np.zeros(DIM, np.int64))
            nodes |= done
            continue
        work: dict = {}
        for lang, path in large:
            node = nodes[lang, path]
            work.setdefault(lang, {})[path] = None if node.tries is None else np.stack([t["w"] for t in node.live()])
        got = tally({lang: _above(nodes, lang, of, top) for lang, of in work.items()}, work)
        for lang, path in large:
            node = nodes[lang, path]
            if node.tries is None:
                start(node, *got.get((lang, path), (0, 0, np.zeros(DIM, np.int64), [])))
            else:
                step(lang, path, *got[lang, path][:3])


def _grown(blocks: list[np.ndarray], leaves: int, lang: int = 0, top: str = "", error: float = np.inf, floor: float = 0.0, least: int = 8, tries: int = 3, steps: int = 12, seed: int = 11) -> dict:
    """The nodes of a tree over vectors that are held here."""
    tally = functools.partial(_tallied, [(lang, v) for v in blocks], 2 * tries, seed, top=top)
    return grow({(lang, top): _Node(error, sum(map(len, blocks)))}, tally, leaves, least, steps, top, floor)


def _centres(nodes: dict, lang: int, leaves: int) -> np.ndarray:
    split = set(_ranked(nodes, lang, leaves))
    ends = sorted({path + side for path in split for side in "01"} - split) or [""]
    sums = [nodes[lang, path].s for path in ends if nodes[lang, path].n]
    return _unit(np.array(sums, np.float64).reshape(-1, DIM)).astype(np.float32)


def _blocks(v: np.ndarray) -> list[np.ndarray]:
    return [v[i : i + BLOCK] for i in range(0, len(v), BLOCK)]


def bisect(vectors: np.ndarray, leaves: int, least: int = 8, tries: int = 3, steps: int = 12, seed: int = 11) -> np.ndarray:
    """Centres of at most ``leaves`` clusters of the vectors that aren't zero. The result depends on nothing but the arguments, and not on the vectors' order."""
    nodes = _grown(_blocks(_whole(vectors[np.abs(vectors).sum(axis=1) > 0])), leaves, least=least, tries=tries, steps=steps, seed=seed)
    return _centres(nodes, 0, leaves)


class Leaves:
    """The leaves of all languages: centres, the language of each, and each language's first leaf and number of leaves."""

    def __init__(self, centres: list[np.ndarray]):
        sizes = [len(c) for c in centres]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        self.centres = np.concatenate(centres)
        self.lang = np.repeat(np.arange(len(centres)), sizes)


def fit_leaves(rows: DataFrame, langs: Languages, leaves: int, seed: int, held: int = 1 << 18, tries: int = 3) -> Leaves:
    """Leaves fitted on all documents, each language alone.

    Parts of a tree with up to ``held`` documents are grown in one task each. What is larger is split by passes over all vectors,
    which lie in the shared folder, and only sums come to the driver. The sums are exact, so ``held`` doesn't change the leaves.
    """
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(langs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, signs = shared.value, _signs()
        kept: dict[int, list[bytes]] = {}

        def blocks() -> pd.DataFrame:
            out = [(lang, b"".join(vs[i : i + BLOCK])) for lang, vs in kept.items() for i in range(0, len(vs), BLOCK)]
            kept.clear()
            return pd.DataFrame(out, columns=["lang", "v"])

        for b in batches:
            for terms in b["terms"]:
                lang = known.of(np.unique(terms))
                v = _whole(vector(terms, known.idf[lang], signs))
                if v.any():
                    kept.setdefault(lang, []).append(v.tobytes())
            if sum(map(len, kept.values())) >= 4 * BLOCK:
                yield blocks()
        yield blocks()

    def parsed(b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        return ((int(lang), np.frombuffer(v, np.int8).reshape(-1, DIM)) for lang, v in zip(b["lang"], b["v"]))

    stored = rows.select("terms").mapInPandas(run, "lang int, v binary")
    docs = rows.count()
    if docs > held:
        stored = cut(stored)

    def tally(splits: dict, work: dict) -> dict:
        sent = sc.broadcast((splits, work))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({"part": [pickle.dumps(_tallied((x for b in batches for x in parsed(b)), 2 * tries, seed, *sent.value))]})

        total: dict = {}
        for r in stored.mapInPandas(part, "part binary").collect():  # a row per partition, bounded by at_once
            _add(total, pickle.loads(r["part"]), 2 * tries)
        sent.destroy()
        return total

    def finish(errors: dict[tuple[int, str], float]) -> dict:
        asked: dict = {}
        for lang, path in errors:
            asked.setdefault(lang, []).append(path)
        last = {lang: nodes[lang, r[-1]].error if len(r := _ranked(nodes, lang, leaves)) == leaves - 1 > 0 else 0.0 for lang in asked}
        floors = {lang: error if np.isfinite(error) else 0.0 for lang, error in last.items()}
        sent = sc.broadcast((asked, {lang: _above(nodes, lang, paths) for lang, paths in asked.items()}, errors, floors))

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked, above, _, _ = sent.value
            for b in batches:
                for lang, v in parsed(b):
                    if lang in asked:
                        at = _below(v.astype(np.float32), "", above[lang])
                        out = [(lang, path, v[at[path]].tobytes()) for path in asked[lang] if len(at[path])]
                        yield pd.DataFrame(out, columns=["lang", "path", "v"])

        def one(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            lang, top = int(key[0]), key[1]
            v = np.frombuffer(b"".join(b["v"]), np.int8).reshape(-1, DIM)
            grown = _grown(_blocks(v), leaves, lang, top, sent.value[2][lang, top], sent.value[3][lang], tries=tries, seed=seed)
            out = {x: _Node(n.error, n.n, n.norm, n.s, n.split) for x, n in grown.items()}
            return pd.DataFrame({"part": [pickle.dumps(out)]})

        parts = stored.mapInPandas(split, "lang int, path string, v binary").groupBy("lang", "path").applyInPandas(one, "part binary")
        out: dict = {}
        for r in parts.collect():  # at most 2 * leaves nodes for each part asked for
            out |= pickle.loads(r["part"])
        sent.destroy()
        return out

    # The sums of all partitions together take some 64 MB at most.
    at_once = max(1, (64 << 20) // (stored.rdd.getNumPartitions() * tries * DIM * 10))
    nodes = {(lang, ""): _Node(np.inf, docs) for lang in range(len(langs.names))}
    grow(nodes, tally, leaves, held=held, finish=finish, at_once=at_once)
    return Leaves([_centres(nodes, lang, leaves) for lang in range(len(langs.names))])


def leaf_terms(rows: DataFrame, langs: Languages, leaves: Leaves) -> DataFrame:
    """(leaf, k, n): documents nearest to each leaf that hold bucket ``k``; ``k`` -1 counts all of them."""
    shared = rows.sparkSession.sparkContext.broadcast((langs, leaves))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (known, ls), signs = shared.value, _signs()
        for b in batches:
            parts, sizes = [], np.zeros(len(ls.centres), np.int64)
            for terms in b["terms"]:
                own = np.unique(terms).astype(np.int64)
                lang = known.of(own)
                lo, hi = ls.first[lang], ls.first[lang + 1]
                v = vector(terms, known.idf[lang], signs)
                if lo == hi or not v.any():
                    continue
                leaf = lo + int((ls.centres[lo:hi] @ v).argmax())
                parts.append(leaf * BUCKETS + own)
                sizes[leaf] += 1
            key, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
            some = np.flatnonzero(sizes)
            yield pd.DataFrame({"leaf": np.r_[key // BUCKETS, some], "k": np.r_[key % BUCKETS, np.full(len(some), -1)], "n": np.r_[n, sizes[some]]})

    counted = rows.select("terms").mapInPandas(run, "leaf int, k int, n bigint")
    return counted.groupBy("leaf", "k").agg(F.sum("n").alias("n"))


# ---- what tells a leaf, and what it is about


def discriminative(counts: DataFrame, leaves: Leaves, g_least: float = 15.0, lift: float = 2.0, weight: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, bucket, log odds, G) of every term that tells a leaf from all documents of its language.

    ``counts`` come from ``leaf_terms``. A term tells if it is at least ``lift`` times as frequent there and the likelihood
    ratio reaches ``g_least`` (a chance of one in ten thousand); counts are drawn towards the language by ``weight``
    documents. Only such terms come to the driver.
    """
    spark = counts.sparkSession
    counts = cut(counts)
    sizes = {r["leaf"]: r["n"] for r in counts.filter("k < 0").collect()}  # a row per leaf
    whole = np.bincount(leaves.lang, weights=[sizes.get(i, 0) for i in range(len(leaves.lang))])
    rows = [(i, int(lang), float(sizes.get(i, 0)), float(whole[lang])) for i, lang in enumerate(leaves.lang)]
    about = F.broadcast(spark.createDataFrame(rows, "leaf int, lang int, size double, docs double"))
    each = counts.filter("k >= 0").join(about, "leaf")
    base = each.groupBy("lang", "k").agg(F.sum("n").alias("_whole"))
    each = each.join(base, ["lang", "k"]).withColumn("_base", (F.col("_whole") + 0.5) / (F.col("docs") + 1))
    each = each.withColumn("odds", F.log((F.col("n") + weight * F.col("_base")) / (F.col("size") + weight) / F.col("_base"))).withColumn("g", 2 * F.col("n") * F.col("odds"))
    got = each.filter((F.col("g") >= g_least) & (F.col("odds") > float(np.log(lift)))).select("leaf", "k", "odds", "g").toPandas().sort_values(["leaf", "k"])
    return tuple(got[c].to_numpy(dtype=t) for c, t in (("leaf", np.int64), ("k", np.int64), ("odds", np.float64), ("g", np.float64)))


def subject_terms(rows: DataFrame, labels: DataFrame, areas: list[str]) -> np.ndarray:
    """Labelled documents with each bucket, by area (buckets x areas); a document with several counts in parts."""
    index = F.create_map(*(x for i, a in enumerate(areas) for x in (F.lit(a.strip().lower()), F.lit(i))))
    told = labels.select("doc_id", index[F.lower(F.trim("subject"))].alias("a")).filter("doc_id IS NOT NULL AND a IS NOT NULL").distinct()
    part = told.groupBy("doc_id").agg(F.collect_list("a").alias("areas"))  # at most one entry per area
    one = rows.join(part, "doc_id").select(F.explode(F.array_distinct("terms")).alias("k"), F.explode(F.sort_array("areas")).alias("a"), F.size("areas").alias("m"))
    got = one.groupBy("k", "a").agg(F.sum(1 / F.col("m")).alias("n")).toPandas()
    table = np.zeros((BUCKETS, len(areas)))
    table[got["k"].to_numpy(dtype=np.int64), got["a"].to_numpy(dtype=np.int64)] = got["n"]
    return table


def name_leaves(telling: tuple, labelled: np.ndarray, held: np.ndarray, support: float = 0.5, least: float = 0.25) -> np.ndarray:
    """The areas of each leaf, as parts of one: those that its telling terms speak for, weighed by how much they tell.

    ``labelled``: labelled documents per bucket and area; ``held``: documents per bucket. A term speaks for the area
    that its labelled documents lift most. Areas with less than ``least`` of a leaf don't count. A leaf whose terms
    occur in labelled documents less than ``support`` times as often as terms do on the whole has none.
    """
    leaf, k, _, g = telling
    n, areas = int(leaf.max(initial=-1)) + 1, labelled.shape[1]
    prior = (labelled.sum(0) + 1e-3) / (labelled.sum() + 1e-3 * areas)
    per = np.log((labelled + prior) / (labelled.sum(1, keepdims=True) + 1) / prior)[k]
    votes, seen, whole = np.zeros((n, areas)), np.zeros(n), np.zeros(n)
    np.add.at(votes, (leaf, per.argmax(axis=1)), g * per.max(axis=1, initial=0))
    np.add.at(seen, leaf, g * labelled.sum(1)[k] / np.maximum(held[k], 1))
    np.add.at(whole, leaf, g)
    rate = seen / np.maximum(whole, 1e-9) / (labelled.sum() / max(held.sum(), 1))
    parts = votes / np.maximum(votes.sum(axis=1, keepdims=True), 1e-9)
    parts = np.where((parts >= least) & (rate >= support)[:, None], parts, 0)
    return parts / np.maximum(parts.sum(axis=1, keepdims=True), 1e-9)


def supported(telling: tuple, labelled: np.ndarray, held: np.ndarray, support: float = 0.5, slack: float = 3.0) -> tuple:
    """The telling terms, those that labelled documents hold too seldom for terms of any area moved to leaf -1.

    Such terms, as in notes of robots, speak for no area: at least ``slack`` labelled documents are missing from
    ``support`` times the number expected. Rare terms can't be told and stay.
    """
    k = telling[1]
    expected = held[k] * (labelled.sum() / max(held.sum(), 1))
    good = labelled[k].sum(axis=1) + slack >= support * expected
    return np.where(good, telling[0], -1), *telling[1:]


# ---- mixtures


def _spread(score: np.ndarray, words: np.ndarray, doc: np.ndarray, n: int, background: float, rounds: int) -> np.ndarray:
    """Words of each document per leaf, the last column for none: passages and the document's mixture settle in turns."""
    score[:, -1] += background
    e = np.exp(np.minimum(score, 30.0))
    theta = np.full((n, e.shape[1]), 1.0 / e.shape[1])
    total = np.maximum(np.bincount(doc, weights=words, minlength=n), 1e-9)[:, None]
    for _ in range(rounds):
        r = e * theta[doc]
        r *= (words / r.sum(axis=1))[:, None]
        sums = np.zeros_like(theta)
        np.add.at(sums, doc, r)
        theta = 0.9 * sums / total + 0.1 * theta
    return sums


def mixtures(rows: DataFrame, langs: Languages, leaves: Leaves, telling: tuple, background: float = 1.5, rounds: int = 4) -> DataFrame:
    """(doc_id, leaf, part): the words of a document that each leaf accounts for, leaf -1 for what none does.

    A passage speaks for a leaf with the log odds of its telling terms; what none of the leaves explains ``background``
    better than the whole language belongs to none. Parts of less than a thousandth of a document aren't listed.
    """
    leaf, k, odds, _ = telling
    tables = []
    for lang in range(len(langs.names)):
        lo, hi = leaves.first[lang], leaves.first[lang + 1]
        own = ((leaf >= lo) & (leaf < hi)) | (leaf < 0)
        used, at = np.unique(k[own], return_inverse=True)
        m = np.zeros((len(used) + 1, hi - lo + 1), np.float32)  # the last column speaks for no area
        m[at, np.where(leaf[own] < 0, hi - lo, leaf[own] - lo)] = odds[own]
        slot = np.full(BUCKETS, len(used), np.int32)
        slot[used] = np.arange(len(used))
        tables.append((slot, m, lo))
    shared = rows.sparkSession.sparkContext.broadcast((langs, tables))

    def scores(terms: np.ndarray, sizes: np.ndarray, slot: np.ndarray, m: np.ndarray) -> np.ndarray:
        out, ends = np.zeros((len(sizes), m.shape[1]), np.float32), np.cumsum(sizes)
        at = 0
        while at < len(sizes):  # as many passages at a time as hold some 100,000 terms
            start = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, start + 100_000)))
            some = np.flatnonzero(sizes[at:to]) + at
            if len(some):
                out[some] = np.add.reduceat(m[slot[terms[start : ends[to - 1]]]], ends[some] - sizes[some] - start, axis=0)
            at = to
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, ts = shared.value
        for b in batches:
            kept = [x for x in zip(b["doc_id"], b["terms"], b["sizes"], b["words"]) if len(x[2])]
            spoken = np.array([known.of(np.unique(x[1])) for x in kept], dtype=int)
            for lang in np.unique(spoken):
                own = [x for x, s in zip(kept, spoken) if s == lang]
                slot, m, lo = ts[lang]
                sizes = np.concatenate([x[2] for x in own]).astype(np.int64)
                words = np.concatenate([x[3] for x in own]).astype(np.float64)
                doc = np.repeat(np.arange(len(own)), [len(x[2]) for x in own])
                terms = np.concatenate([x[1] for x in own]).astype(np.int64)
                mix = _spread(scores(terms, sizes, slot, m), words, doc, len(own), background, rounds)
                whole = mix.sum(axis=1)
                i, j = np.nonzero(mix >= np.maximum(whole * 1e-3, 1e-9)[:, None])
                ids = np.array([x[0] for x in own], dtype=np.int64)
                yield pd.DataFrame({"doc_id": ids[i], "leaf": np.where(j == m.shape[1] - 1, -1, j + lo).astype(np.int32), "part": mix[i, j]})

    return rows.mapInPandas(run, "doc_id bigint, leaf int, part double")


def mixed_subjects(mix: DataFrame, named: DataFrame, share: float) -> DataFrame:
    """(doc_id, subject, share) from (doc_id, leaf, part) and (leaf, subject, of): the areas with at least ``share`` of the words.

    Rows of a document that is stored several times add up. ``named`` holds what part ``of`` a leaf is about an area.
    """
    both = mix.join(F.broadcast(named), "leaf", "left").withColumn("part", F.col("part") * F.coalesce("of", F.lit(1.0)))
    per = both.groupBy("doc_id", "subject").agg(F.sum("part").alias("part"))
    whole = per.groupBy("doc_id").agg(F.sum("part").alias("_n"), F.collect_list(F.struct("subject", "part")).alias("_s"))  # at most one entry per area
    each = whole.select("doc_id", "_n", F.inline("_s")).select("doc_id", "subject", (F.col("part") / F.col("_n")).alias("share"))
    return each.filter(F.col("subject").isNotNull() & (F.col("share") >= share))


def subjects(
    docs: DataFrame,
    labels: DataFrame,
    areas: list[str],
    share: float = 0.22,
    leaves: int = 32,
    seed: int = 11,
    rename: dict[int, int] | None = None,
) -> DataFrame:
    """The areas of each document: (doc_id, subject, share), share being its part of the words of the prose.

    ``docs``: ``doc_id``, ``text``, and ``lang`` if known; ``labels``: ``doc_id``, ``subject``, some wrong or missing;
    ``areas``: the names. ``leaves`` is the most per language. Leaves are fitted on all documents and
    named with the help of all labels; all counts and all results cover every document.
    ``rename`` replaces the areas of leaves by others, to see what the leaves decide.
    Documents with null or blank text, and all documents if nothing is labelled, get no subjects; copies count like
    other documents; repeated ids are one document; other columns are ignored; whole texts are read.
    """
    spark = docs.sparkSession
    none = spark.createDataFrame([], "doc_id bigint, subject string, share double")
    rows = cut(passage_rows(docs)) if areas else None
    if rows is None or not rows.limit(1).count():
        return none
    labelled = subject_terms(rows, labels, areas)
    if not labelled.any():
        return none
    langs = languages(rows)
    ls = fit_leaves(rows, langs, leaves, seed)
    if not len(ls.centres):
        return none
    counts = leaf_terms(rows, langs, ls)
    telling = discriminative(counts, ls)
    named = name_leaves(telling, labelled, langs.held)
    telling = supported(telling, labelled, langs.held)
    name = lambda a: areas[(rename or {}).get(a, a)]
    table = spark.createDataFrame([(int(i), name(int(a)), float(named[i, a])) for i, a in zip(*np.nonzero(named))], "leaf int, subject string, of double")
    return mixed_subjects(mixtures(rows, langs, ls, telling), table, share)
