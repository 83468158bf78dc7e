"""Held-out passages in training documents: template windows, a hash join, and a check of what fills the slots.

Words are runs of letters and digits, after markup, entities, case and forms of characters are levelled. A word
that carries a digit, a unit of measure, and a word that is rare among the held-out texts (a name) become typed
placeholders; windows of five such tokens are hashed and joined. The windows that agree along one diagonal nominate a
pair. Then the slots are compared: where they hold the fillers of the held-out text, the words are aligned and
counted (``leaks``); where every filler is replaced by the same other one throughout, the text is the same question
with new parameters (``reparameterised``).
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.session import cut, small

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_HIDDEN = {0xAD: None, **{c: None for c in (*range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF)}}

#: Cyrillic and Greek letters that look like Latin ones.
_LOOKS = str.maketrans("\u0430\u0435\u043e\u0440\u0441\u0445\u0443\u0456\u0458\u0455\u043a\u043c\u0442\u0432\u043d\u03bf\u03b1", "aeopcxyijskmtbhoa")

#: Units of measure.
UNITS = frozenset("ms s sec secs second seconds min mins minute minutes h hour hours day days kb mb gb tb kib mib gib b bytes percent times".split())

#: Buckets of words whose share of the held-out texts is kept; words that meet in one count together.
BUCKETS = 1 << 20

HITS = "doc_id bigint, joined boolean, h bigint, raw bigint, pos int"


#: A word cut at the end of a line, with the marks of quotes and comments that begin the next line.
_CUT = re.compile("(?<=[^\\W\\d_])[-\u00ad\u2010][ \\t]*\\r?\\n[ \\t>#/*|]*(?=[^\\W\\d_])")


def words(text: str | None, join: bool = False) -> list[str]:
    """The words of a text as they are compared: no markup or hidden characters, one form of characters, no case.

    ``join`` puts words together that a hyphen cuts at the end of a line.
    """
    if not text:
        return []
    if join:
        text = _CUT.sub("", text)
    text = html.unescape(_TAG.sub(" ", text))
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.translate(_HIDDEN)) if not unicodedata.combining(c))
        text = unicodedata.normalize("NFKC", text).casefold().translate(_LOOKS)
    return _WORD.findall(text.casefold())


@functools.lru_cache(maxsize=200_000)
def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def template(ws: list[str], common: np.ndarray) -> list[str]:
    """Typed placeholders for numbers, units and names, each by its word alone; words of ``common`` buckets stay."""
    out = []
    for w in ws:
        if any(c.isdigit() for c in w):
            out.append("<n>")
        elif w in UNITS:
            out.append("<u>")
        else:
            out.append(w if common[_code(w) % BUCKETS] else "<w>")
    return out


#: Odd multipliers, one per place of a window.
_PLACES = np.array([xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(64)], dtype=np.uint64)


def windows(ws: list[str], common: np.ndarray, size: int, literal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, word hash, fillers) of the window at every place.

    A window with fewer than ``literal`` words of its own is kept in words. Fillers are the codes of the words in its
    slots, 0 at the places of other words.
    """
    n = len(ws) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, size), np.int64)
    ts = template(ws, common)
    w = np.array([_code(x) for x in ws], dtype=np.uint64)
    t = np.array([_code(x) for x in ts], dtype=np.uint64)
    own = np.array([x[0] != "<" for x in ts], dtype=np.int64)
    raw, levelled, words_left = np.zeros(n, np.uint64), np.full(n, _PLACES[-1]), np.zeros(n, np.int64)
    for k in range(size):  # sums wrap around, as hashes may
        raw += w[k : k + n] * _PLACES[k]
        levelled += t[k : k + n] * _PLACES[k]
        words_left += own[k : k + n]
    fillers = np.lib.stride_tricks.sliding_window_view(np.where(own == 0, w, 0).view(np.int64), size)
    return np.where(words_left >= literal, levelled, raw).view(np.int64), raw.view(np.int64), fillers


def passage(steps: np.ndarray, least: int, share: float) -> int:
    """Words of the longest stretch of an alignment with at most ``share`` of its words changed; 0 if below ``least``.

    ``steps``: (match 1/0, held-out word used 1/0) in order. Stretches begin and end with equal words; the words counted
    are those of the held-out text.
    """
    match = steps[:, 0] == 1
    at = np.flatnonzero(match)
    if not len(at):
        return 0
    edits = np.concatenate([[0], np.cumsum(~match)])
    used = np.concatenate([[0], np.cumsum(steps[:, 1])])
    # A stretch from i to j is good if what it owes at its end is no more than what it owed at its start.
    owed = edits - share * used
    highest = np.maximum.accumulate(owed[at])
    start = np.searchsorted(highest, owed[at + 1] - 1e-9)
    fine = start <= np.arange(len(at))
    best = int((used[at + 1] - used[at[np.minimum(start, len(at) - 1)]])[fine].max(initial=0))
    return best if best >= least else 0


def passages(a: np.ndarray, b: np.ndarray, diagonal: int, width: int, least: int, share: float) -> int:
    """Words of the longest passage of ``b`` in ``a`` near one diagonal; 0 if none has ``least``.

    Word numbers are aligned within ``width`` of ``diagonal`` (place in ``a`` less place in ``b``), +1 for equal words and
    -1 for a change. A path taken is struck out and the next one sought, until none can hold a passage, so a stretch
    with too many changes doesn't hide a sound one beside it. Takes memory for ``len(a)`` times twice ``width``.
    """
    first = max(0, diagonal - width)
    a, diagonal = a[first : diagonal + len(b) + width], diagonal - first
    n, m, w = len(a), len(b), 2 * width + 1
    place = np.arange(n)[:, None] - diagonal + np.arange(-width, width + 1)[None, :]  # place in b of each cell
    inside = (place >= 0) & (place < m)
    same = inside & (b[np.clip(place, 0, m - 1)] == a[:, None])
    j, best_found = np.arange(w), 0
    enough = least - 2 * int(least * share)
    while np.count_nonzero(same.any(axis=1)) >= max(enough, (1 - share) * best_found):
        rows = np.zeros((n + 1, w), np.int32)
        gain = np.where(same, 1, -1)
        for i in range(n):
            up = rows[i]
            c = up + gain[i]
            c[:-1] = np.maximum(c[:-1], up[1:] - 1)
            c = np.where(inside[i], np.maximum(c, 0), 0)
            rows[i + 1] = np.where(inside[i], np.maximum.accumulate(c + j) - j, 0)
        if rows.max(initial=0) < enough:
            break
        i, k = np.unravel_index(int(rows.argmax()), rows.shape)
        steps, cells = [], []
        while i > 0 and rows[i, k] > 0:
            eq = bool(same[i - 1, k])
            if rows[i, k] == rows[i - 1, k] + (1 if eq else -1):
                steps.append((int(eq), 1))
                cells.append((i - 1, k))
                i -= 1
            elif k + 1 < w and rows[i, k] == rows[i - 1, k + 1] - 1:
                steps.append((0, 0))
                i, k = i - 1, k + 1
            else:
                steps.append((0, 1))
                k -= 1
        best_found = max(best_found, passage(np.array(steps[::-1], dtype=np.int64).reshape(-1, 2), least, share))
        at = np.array(cells)
        same[at[:, 0], at[:, 1]] = False
    return best_found


def common_words(items: DataFrame, in_items: int) -> np.ndarray:
    """Which buckets of words make up templates: those in at least ``in_items`` of the held-out texts.

    What comes to the driver is bounded by the number of buckets, whatever the texts.
    """

    def run(batches):
        for b in batches:
            rows = [k for t in b["text"] for k in {_code(w) % BUCKETS for w in words(t)}]
            yield pd.DataFrame({"k": np.array(rows, dtype=np.int32)})

    counts = items.select("text").mapInPandas(run, "k int").groupBy("k").count().filter(F.col("count") >= in_items).select("k").toPandas()
    out = np.zeros(BUCKETS, dtype=bool)
    out[counts["k"].to_numpy(dtype=np.int64)] = True
    return out


def _frame(parts: list[tuple], key: str) -> pd.DataFrame:
    out = pd.DataFrame({name: np.concatenate([p[k] for p in parts]) for k, name in enumerate((key, "joined", "h", "raw", "pos"))})
    return out if parts[0][5] is None else out.assign(slots=list(np.concatenate([p[5] for p in parts])))


def template_hits(docs: DataFrame, items: DataFrame, size: int, literal: int, in_items: int, fillers: bool = False) -> DataFrame:
    """(doc_id, joined, item_id, pos, ipos, same) of windows with the same template; ``same``: their slots hold the same words.

    Documents with words cut at line ends are read twice, as they stand and ``joined``.

    With ``fillers`` also ``slots`` and ``islots``, what fills the slots on either side. The item windows are broadcast
    only if they are proven few; nothing is grouped by window.
    """
    schema = HITS + ", slots array<bigint>" * fillers
    shared = docs.sparkSession.sparkContext.broadcast(common_words(items, in_items))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts, held = [], 0
            for i, t in zip(b.iloc[:, 0], b["text"]):
                for join in (False, True) if t and _CUT.search(t) else (False,):
                    h, raw, slots = windows(words(t, join), shared.value, size, literal)
                    parts.append((np.full(len(h), i, dtype=np.int64), np.full(len(h), join), h, raw, np.arange(len(h), dtype=np.int32), slots if fillers else None))
                    held += len(h)
                if held > 200_000:
                    yield _frame(parts, b.columns[0])
                    parts, held = [], 0
            if parts:
                yield _frame(parts, b.columns[0])

    of_docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(cut_up, schema)
    of_items = items.mapInPandas(cut_up, schema.replace("doc_id", "item_id")).filter("NOT joined").distinct()
    of_items = cut(of_items.select("item_id", "h", F.col("raw").alias("iraw"), F.col("pos").alias("ipos"), *[F.col("slots").alias("islots")] * fillers))
    same = (F.col("raw") == F.col("iraw")).alias("same")
    return of_docs.join(small(of_items, 500_000), "h").select("doc_id", "joined", "item_id", "pos", "ipos", same, *["slots", "islots"] * fillers)


def _banded(hits: DataFrame, band: int) -> DataFrame:
    """``hits`` once for each of the two bands of diagonals they lie in; bands overlap by half."""
    diagonal = F.col("pos") - F.col("ipos")
    bands = F.array(F.floor(diagonal / band), F.floor((diagonal + band // 2) / band) + F.lit(1 << 30))
    return hits.withColumns({"_d": diagonal, "band": F.explode(bands)})


def nominated(hits: DataFrame, band: int, need: int) -> DataFrame:
    """(doc_id, joined, item_id, n, same, lo, hi, dlo, dhi) of each band of diagonals with ``need`` windows of the same template.

    Of two bands that overlap by half, a passage whose additions shift it lies whole in one. ``lo`` to ``hi`` are the
    first and last window in the document, at most an item's length apart, ``dlo`` to ``dhi`` their diagonals.
    """
    near = _banded(hits, band).groupBy("doc_id", "joined", "item_id", "band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("_d").alias("dlo"), F.max("_d").alias("dhi")
    )
    return near.filter(F.col("n") >= need)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    least: int = 18,
    share: float = 1 / 8,
    size: int = 5,
    literal: int = 3,
    in_items: int = 4,
    band: int = 24,
) -> DataFrame:
    """Which document holds which held-out item: (doc_id, item_id, words), words being the longest passage.

    ``docs``: ``doc_id``, ``text``; ``items``: ``item_id``, ``text``. A passage has at least ``least`` words of the
    item in its order, of which at most ``share`` are changed, added or left out. Any such passage keeps
    ``least - size + 1 - size * int(least * share)`` whole windows. As many windows of the same template within a ``band``
    of diagonals nominate a pair; as many whose slots hold the item's own fillers send it to the alignment, of which
    every stretch counts. Whole texts count. Null and blank texts, and items shorter than ``least`` words, match
    nothing; other columns are ignored; repeated rows give one row; empty tables give an empty one. Hits shrink to
    counts before the shuffle; the alignment needs memory in proportion to the item's length.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text").filter("item_id IS NOT NULL")
    need = max(1, least - size + 1 - size * int(least * share))
    near = nominated(template_hits(docs, items, size, literal, in_items), band, need).filter(F.col("same") >= need)
    spot = F.struct("joined", "lo", "hi", "dlo", "dhi")
    pairs = cut(near.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_set(spot)).alias("spots")))  # a spot per occurrence

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, last, read = [], None, {}
            for d, i, spots, dt, it in zip(b["doc_id"], b["item_id"], b["spots"], b["text"], b["itext"]):
                if dt is not last:
                    last, read = dt, {}
                iw, n, done = words(it), 0, []
                for s in spots:
                    join, lo, hi, dlo, dhi = (s[x] for x in ("joined", "lo", "hi", "dlo", "dhi"))
                    if any(x[0] == join and x[1] <= lo and hi <= x[2] and x[3] <= dlo and dhi <= x[4] for x in done):
                        continue  # the other half-shifted band shows the same place
                    done.append((join, lo, hi, dlo, dhi))
                    dw = read.get(join) or read.setdefault(join, words(dt, join))
                    start = max(0, lo - len(iw))
                    part = dw[start : hi + size + len(iw)]
                    number = {w: k for k, w in enumerate(dict.fromkeys(part + iw))}
                    mid = (dlo + dhi) // 2 - start
                    n = max(n, passages(np.array([number[w] for w in part]), np.array([number[w] for w in iw]), mid, band, least, share))
                if n:
                    rows.append((d, i, n))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words"])

    texts = docs.join(small(pairs), "doc_id").join(small(items.select("item_id", F.col("text").alias("itext"))), "item_id")
    return texts.mapInPandas(check, "doc_id bigint, item_id bigint, words int").groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def reparameterised(
    docs: DataFrame,
    items: DataFrame,
    least: int = 18,
    size: int = 5,
    literal: int = 3,
    in_items: int = 4,
    band: int = 24,
    consistent: float = 0.95,
    changed: float = 0.5,
) -> DataFrame:
    """Which document asks which held-out question with other parameters: (doc_id, item_id, windows, slots, replaced).

    The windows of ``least`` words of the item's template must agree near one diagonal. Every filler of the item must
    stand for one filler of the document throughout: a part ``consistent`` of all slots in these windows holds the most
    frequent one of its filler, and at least a part ``changed`` of the fillers is replaced by others, so that
    passages kept as they are don't count. ``slots`` are the item's distinct fillers. Cases as in ``leaks``: nulls, blanks,
    short items, repeated rows and empty tables.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text").filter("item_id IS NOT NULL")
    hits = template_hits(docs, items, size, literal, in_items, fillers=True)
    place = ["doc_id", "joined", "item_id", "band"]
    bound = F.filter(F.arrays_zip("islots", "slots"), lambda x: x["islots"] != 0)
    # Equal bindings of a place merge before the shuffle, so a hot template costs no more than its places.
    each = _banded(hits, band).select(*place, "pos", "same", F.explode_outer(bound).alias("b")).groupBy(*place, "b").agg(F.count(F.lit(1)).alias("n"))
    fillers = each.filter("b IS NOT NULL").groupBy(*place, "b.islots").agg(F.max("n").alias("top"), F.sum("n").alias("n"), F.max_by("b.slots", F.struct("n", "b.slots")).alias("by"))
    slots = fillers.groupBy(*place).agg(
        F.sum("top").alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("slots"), F.count_if(F.col("by") != F.col("islots")).alias("replaced")
    )
    good = slots.filter((F.col("top") >= consistent * F.col("n")) & (F.col("replaced") >= changed * F.col("slots")))
    near = nominated(hits, band, least - size + 1).select(*place, F.col("n").alias("windows"))
    both = near.join(good.select(*place, "slots", "replaced"), place)
    return both.groupBy("doc_id", "item_id").agg(F.max(F.struct("windows", "slots", "replaced")).alias("r")).select("doc_id", "item_id", "r.*")
