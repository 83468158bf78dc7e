"""Addresses and text kernels (TX, VS-11, DP-7): columns where built-in functions suffice, batched Python elsewhere."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ISSUE = r"^.*/([^/]+/[^/]+)/issues/(\d+)(?:[#?].*)?$"


def issue_ref(url: Column) -> Column:
    """TX-12, JN-2: struct(project, number) of an issue's address, null for others; the last ``/issues/`` counts."""
    return F.when(url.rlike(_ISSUE), F.struct(F.regexp_extract(url, _ISSUE, 1).alias("project"), F.regexp_extract(url, _ISSUE, 2).try_cast("bigint").alias("number")))


def clean_url(url: Column) -> Column:
    """TX-4: without fragment and query."""
    return F.regexp_replace(url, r"[?#].*$", "")


def doc_kind(url: Column) -> Column:
    """VS-11: what a document is, by its address: a chain of anchored rules, the first that holds decides."""
    host = r"^https?://[^/]+"
    return (
        F.when(url.isNull() | ~url.rlike(r"^https?://[^/\s]+"), "unknown")
        .when(url.rlike(host + r"/[^/]+/[^/]+/issues/\d+$"), "issue")
        .when(url.rlike(host + r"/[^/]+/[^/]+/issues/\d+#"), "comment")
        .when(url.rlike(host + r"/[^/]+/[^/]+/discussions/\d+"), "discussion")
        .when(url.rlike(r"/\+/\d+(#|$)"), "change")
        .when(url.rlike(r"/(g|group|groups)/"), "conversation")
        .when(url.rlike(r"/wiki/"), "wiki")
        .when(url.rlike(r"/(blog)/"), "blog")
        .when(url.rlike(r"/(releases|tag)/"), "release")
        .otherwise("page")
    )


def url_allowed(urls: DataFrame, rules: list[tuple[str, bool]], url: str = "url") -> DataFrame:
    """TX-3: ``urls`` with ``allowed``: the longest rule whose prefix ends at a border decides, a later one wins ties, none denies."""
    best = None
    for k, (prefix, allow) in enumerate(rules):
        rest = F.substr(F.col(url), F.lit(len(prefix) + 1))
        hit = F.startswith(F.col(url), F.lit(prefix)) & (F.lit(prefix.endswith("/")) | (rest == "") | rest.rlike("^[/?#]"))
        one = F.when(hit, F.struct(F.lit(len(prefix)).alias("len"), F.lit(k).alias("k"), F.lit(allow).alias("ok")))
        best = one if best is None else F.greatest(best, one)
    allowed = F.coalesce(best["ok"], F.lit(False)) if best is not None else F.lit(False)
    return urls.withColumn("allowed", allowed)


def links(html: Column, base: Column) -> Column:
    """TX-2: targets of ``<a href>``, without empty ones and fragments of the page itself, made absolute."""

    @F.pandas_udf("array<string>")
    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_links(x, y) for x, y in zip(h, b)])

    return run(html, base)


def _links(text: str | None, base: str | None) -> list[str]:
    found: list[str] = []

    class P(HTMLParser):
        def handle_starttag(self, tag, attrs):
            href = dict(attrs).get("href") if tag == "a" else None
            if href and not href.startswith("#"):
                found.append(href)

    P().feed(text or "")
    out = []
    for x in found:
        try:
            out.append(urljoin(base or "", x))
        except ValueError:
            continue
    return out


class _Sections(HTMLParser):
    """Text after each heading with an id, under the titles of the headings above it."""

    def __init__(self):
        super().__init__()
        self.titles: list[str] = [""] * 6
        self.level, self.heading, self.text = 0, False, []
        self.ident, self.title = None, ""
        self.out: list[tuple[str, str, str]] = []
        self.skip = 0

    def flush(self):
        body = " ".join("".join(self.text).split())
        if self.ident and body:
            self.out.append((self.title, self.ident, body))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level, self.heading = int(tag[1]), True
            self.ident = dict(attrs).get("id")
            self.titles[self.level - 1 :] = [""] * (7 - self.level)
        elif not self.heading:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
        if self.heading and re.fullmatch("h[1-6]", tag):
            self.heading = False
            self.title = " > ".join(t.strip() for t in self.titles if t.strip())

    def handle_data(self, data):
        if self.skip:
            return
        if self.heading:
            self.titles[self.level - 1] += data
        else:
            self.text.append(data)


def sections(html: Column) -> Column:
    """TX-1, DP-5: array of (title, id, text) of the sections of a page; sections without id or text are left out."""

    @F.pandas_udf("array<struct<title:string,id:string,text:string>>")
    def run(h: pd.Series) -> pd.Series:
        return h.map(split_sections)

    return run(html)


def split_sections(text: str | None) -> list[dict]:
    """The sections of one page."""
    p = _Sections()
    p.feed(text or "")
    p.close()
    p.flush()
    return [{"title": t, "id": i, "text": x} for t, i, x in p.out]


def strip_comments(text: Column) -> Column:
    """TX-10: without HTML comments."""
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def wrap(body: Column, maker: str, meta: Column) -> Column:
    """TX-11: a generated text between markers that carry its maker and data."""
    return F.concat(F.lit(f"<!-- made by {maker} "), meta, F.lit(" -->\n"), body, F.lit("\n<!-- made end -->"))


_WRAPPED = r"(?s)<!-- made by (\S+) (.*?) -->\n(.*?)\n<!-- made end -->"


def unwrap(text: Column) -> Column:
    """TX-11: struct(maker, meta, body) of the first wrapped part, null if there is none."""
    return F.when(text.rlike(_WRAPPED), F.struct(*(F.regexp_extract(text, _WRAPPED, i + 1).alias(n) for i, n in enumerate(("maker", "meta", "body")))))


def unwrap_all(text: Column) -> Column:
    """TX-11: the text without wrapped parts."""
    return F.regexp_replace(text, _WRAPPED, "")


_CODE_OR_LINK = re.compile(r"(```.*?(?:```|\Z)|`[^`\n]*`|!?\[[^\]\n]*\]\([^)\n]*\)|<[^>\n]*>|https?://\S+)", re.S)


def fix_text(text: str | None, rules: list[tuple[str, str, str]]) -> str | None:
    """TX-5 to TX-7: apply (kind, pattern, replacement) rules in order; None if nothing changes.

    ``link`` turns matches in plain text into links to the replacement, ``text`` replaces in plain text, ``url``
    replaces at the start of addresses. Code and existing links are no plain text.
    """
    if not text:
        return None
    new = text
    for kind, pattern, to in rules:
        parts = _CODE_OR_LINK.split(new)
        for i, part in enumerate(parts):
            plain = i % 2 == 0
            if plain and kind == "text":
                parts[i] = re.sub(pattern, to, part)
            elif plain and kind == "link":
                parts[i] = re.sub(pattern, lambda m, to=to: f"[{m[0]}]({m.expand(to)})", part)
            elif not plain and kind == "url" and not part.startswith(("`", "<")):
                at = part.find("](") + 2 if part.startswith(("[", "![")) else 0
                parts[i] = part[:at] + re.sub(r"\A(?:" + pattern + ")", to, part[at:])
        new = "".join(parts)
    return None if new == text else new


def fixed(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """TX-7 as a column: the changed text, null where nothing changes."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fix_text(x, rules))

    return run(text)


def anchored_diff(old: str, new: str, context: int = 3) -> str:
    """TX-8: a unified diff whose anchors are lines that occur once on each side, in the longest common order."""
    a, b = old.splitlines(keepends=True), new.splitlines(keepends=True)
    if a == b:
        return ""
    ca, cb = Counter(a), Counter(b)
    where = {x: j for j, x in enumerate(b)}
    pairs = [(i, where[x]) for i, x in enumerate(a) if ca[x] == 1 and cb.get(x) == 1]
    tails, back = [], []  # patience: the longest increasing run of places in ``new``
    last: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
        last[k : k + 1] = [n]
        back.append(last[k - 1] if k else -1)
    chain, n = [], last[-1] if last else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    edits: list[tuple[str, int, int]] = []
    i = j = 0
    for x, y in [*reversed(chain), (len(a), len(b))]:
        if x < i or y < j:
            continue
        s = 0  # grow the anchor backwards over equal lines
        while x - s > i and y - s > j and a[x - s - 1] == b[y - s - 1]:
            s += 1
        lo = 0
        while i + lo < x - s and j + lo < y - s and a[i + lo] == b[j + lo]:
            lo += 1
        edits += [(" ", i + k, j + k) for k in range(lo)]
        edits += [("-", k, -1) for k in range(i + lo, x - s)] + [("+", -1, k) for k in range(j + lo, y - s)]
        edits += [(" ", x - s + k, y - s + k) for k in range(s)]
        if x < len(a):
            edits.append((" ", x, y))
        i, j = x + 1, y + 1
    changed = [k for k, e in enumerate(edits) if e[0] != " "]
    hunks: list[list[int]] = []
    for k in changed:
        if hunks and k - context <= hunks[-1][1] + 1 + context - 1 + 1:
            hunks[-1][1] = k
        else:
            hunks.append([k, k])
    out = ["--- old\n+++ new\n"]
    for lo, hi in hunks:
        part = edits[max(0, lo - context) : hi + 1 + context]
        before = edits[: max(0, lo - context)]
        ai, bi = sum(e[0] != "+" for e in before), sum(e[0] != "-" for e in before)
        na, nb = sum(e[0] != "+" for e in part), sum(e[0] != "-" for e in part)
        out.append(f"@@ -{ai + (na > 0)},{na} +{bi + (nb > 0)},{nb} @@\n")
        for op, x, y in part:
            line = a[x] if op != "+" else b[y]
            out.append(op + line + ("" if line.endswith("\n") else "\n\\ No newline at end of file\n"))
    return "".join(out)


def body_diff(old: Column, new: Column) -> Column:
    """TX-9: the diff of two bodies with line ends levelled and trailing ones cut."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        tidy = lambda s: (s or "").replace("\r\n", "\n").rstrip("\n") + "\n"
        return pd.Series([anchored_diff(tidy(x), tidy(y)) for x, y in zip(a, b)])

    return run(old, new)


def split_words(text: Column) -> Column:
    """TX-14: runs of characters that may start a word of the filter language, and every other character by itself."""
    return F.regexp_extract_all(text, F.lit(r"[#-'*/;?@A-Z\[\]\^-}\\\x{a1}-\x{effff}]+|\S"), 0)


def cache_key(kind: str, model: str, *parts: Column) -> Column:
    """CL-7, TX-17: hex digest of a kind, a model and the parts of a prompt, parted so that no two lists agree by chance."""
    return F.sha2(F.concat_ws("\x1f", F.lit(kind), F.lit(model), *parts), 256)
