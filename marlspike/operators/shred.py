"""Deeply nested records to related flat tables by Dewey labelling.

Each node of a record gets the ordinals on the way to it as its label (``0.3.1``); its parent's label is that
label cut at its end. Lists and maps become tables, named by the path of member names that leads to them; every
element is a row with its label and the scalar members that belong to it alone. Which ordinals of a label are places
in lists follows from the path, so places and parents come out of the labels alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Members in which services wrap a list, and the member that wraps one element of ``edges``.
WRAPPERS = ("nodes", "edges", "items", "data", "values", "elements")
EDGE = "node"

NODE = "path string, dewey string, names array<string>, kind string, fields map<string,string>"


_TOKEN = re.compile(r'[\s]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|([^\s\[\]{},:"]+))')


def _deep(text: str):
    """The value of a JSON text of any depth, by an own stack; ValueError if it isn't one."""
    done, stack, at, text = [], [], 0, text.rstrip(" \t\r\n")

    def put(v):
        if not stack:
            done.append(v)
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(v)
        else:
            stack[-1][0][stack[-1].pop()] = v

    want = "value"
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or (done and not stack):
            raise ValueError(at)
        at, (mark, string, other) = m.end(), m.groups()
        if want in ("value", "first") and mark in ("[", "{"):
            new = [] if mark == "[" else {}
            put(new)
            stack.append([new])
            want = "first" if mark == "[" else "key or end"
        elif (want == "first" and mark == "]") or (want == "key or end" and mark == "}"):
            stack.pop()
            want = "next"
        elif want in ("key", "key or end") and string:
            stack[-1].append(json.loads(string))
            want = ":"
        elif want == ":" and mark == ":":
            want = "value"
        elif want in ("value", "first") and (string or other):
            put(json.loads(string or other))
            want = "next"
        elif want == "next" and stack and mark == ",":
            want = "value" if isinstance(stack[-1][0], list) else "key"
        elif want == "next" and stack and mark == ("]" if isinstance(stack[-1][0], list) else "}"):
            stack.pop()
        else:
            raise ValueError(at)
    if stack or not done:
        raise ValueError("cut off")
    return done[0]


def read_json(text: str | None):
    """The value of a JSON text of any depth, or None if it can't be read.

    A byte order mark, the guard ``)]}'`` before the text, and texts that were themselves stored as JSON strings, however
    often, are seen through; cut-off texts can't be read.
    """
    while isinstance(text, str):
        text = text.lstrip("﻿ \t\r\n").removeprefix(")]}'").removeprefix(",")
        try:
            text = json.loads(text)
        except RecursionError:
            try:
                text = _deep(text)
            except ValueError:
                return None
        except ValueError:
            return None
    return text


def _scalar(x) -> str | None:
    if x is None or isinstance(x, str):
        return x
    return json.dumps(x)


def _get(d: dict, names: tuple[str, ...]):
    return next((k for k in d if k.lower() in names), None)


def label(value, lists: frozenset[str], maps: frozenset[str], keep: frozenset[str] | None = None) -> Iterator[tuple]:
    """(path, dewey, names, kind, fields) of every table row of one record, the record itself first.

    Walks with its own stack. ``lists``: paths that are lists even where they hold a lone element or a wrapped
    list; ``maps``: paths whose members are entries, whose ``names`` are kept. ``keep``: the only paths to return.
    """
    stack = [("", "0", (), value)]
    while stack:
        path, dewey, names, v = stack.pop()
        fields: dict[str, str | None] = {}
        inner = [("", "", v)] if isinstance(v, dict) else []
        if not isinstance(v, (dict, list)):
            fields[""] = _scalar(v)
        todo = []
        if isinstance(v, list):  # a list directly in a list, or a record that is a list
            todo.append((path + "[]", dewey, v, None))
        while inner:
            at, ordinals, obj = inner.pop()
            for k, (name, x) in enumerate(obj.items()):
                rel = f"{at}.{name.lower()}" if at else name.lower()
                full, d = f"{path}.{rel}" if path else rel, f"{ordinals}.{k}" if ordinals else str(k)
                if full in maps and isinstance(x, dict):
                    todo.append((full, f"{dewey}.{d}", list(x.values()), list(x)))
                    continue
                if full in lists and x is not None:
                    while isinstance(x, dict) and (w := _get(x, WRAPPERS)) is not None:
                        x = x[w]
                    x = [] if x is None else x if isinstance(x, list) else [x]
                    x = [e[EDGE] if isinstance(e, dict) and set(e) == {EDGE} else e for e in x]
                if isinstance(x, list):
                    todo.append((full, f"{dewey}.{d}", x, None))
                elif isinstance(x, dict):
                    inner.append((rel, d, x))
                else:
                    fields[rel] = _scalar(x)
        if keep is None or path in keep:
            kind = "null" if v is None else "object" if isinstance(v, dict) else "list" if isinstance(v, list) else "scalar"
            yield path, dewey, list(names), kind, fields
        for full, d, items, called in reversed(todo):
            if keep is None or any(p == full or p.startswith((full + ".", full + "[]")) for p in keep):
                stack += [(full, f"{d}.{i}", names if called is None else (*names, called[i]), items[i]) for i in range(len(items) - 1, -1, -1)]


def shred(df: DataFrame, column: str, keys: list[str], lists: list[str] = (), maps: list[str] = (), keep: list[str] | None = None, root: str = "") -> DataFrame:
    """All table rows of the JSON texts in ``column``: ``keys`` and (path, dewey, names, kind, fields).

    ``names`` are the keys of the map entries on the way. ``root`` names the path of the whole text. Records that are null or can't be read give nothing, empty lists and maps
    give no rows, null elements take a place and give a row of kind ``null``. Repeated records give repeated
    rows. Only ``keys`` pass through, so other columns can't clash. Each record is parsed once, in Arrow batches;
    nothing is grouped, so skewed keys don't matter.
    """
    ls, ms, kp = frozenset(lists), frozenset(maps), None if keep is None else frozenset(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            src, nodes = [], []
            for i, text in enumerate(b["_json"]):
                v = read_json(text)
                if v is None:
                    continue
                if root:
                    v = {root: v}
                for node in label(v, ls, ms, kp):
                    src.append(i)
                    nodes.append(node)
            out = b.drop(columns="_json").iloc[src].reset_index(drop=True)
            for k, name in enumerate(("path", "dewey", "names", "kind", "fields")):
                out[name] = pd.Series([n[k] for n in nodes], dtype=object)
            yield out

    slim = df.select(*keys, F.col(column).alias("_json"))
    out = T.StructType([*slim.drop("_json").schema.fields, *T._parse_datatype_string(NODE).fields])
    return slim.mapInPandas(run, out)


def levels(path: str, tables: list[str], maps: list[str] = ()) -> list[tuple[str, int, bool]]:
    """(table, ordinal, is a map) of each table on the way to ``path``, itself last: where in a label its place stands.

    The label of a row is ``0``, then for each table one ordinal per member of the path that leads to it and one for the
    element. Paths are member names joined by dots; ``[]`` is a list directly in a list.
    """
    out, at, begun = [], 0, ""
    for part in re.findall(r"[^.\[\]]+|\[\]", path):
        begun = begun + part if part == "[]" else f"{begun}.{part}" if begun else part
        at += part != "[]"
        if begun in tables or begun == path:
            at += 1
            out.append((begun, at, begun in maps))
    return out


def _upto(dewey: Column, n: int) -> Column:
    """A label cut after its first ``n`` ordinals."""
    return F.substring_index(dewey, ".", n)


def places(path: str, tables: list[str], maps: list[str] = ()) -> Column:
    """The places in the tables on the way to rows of ``path``, joined by dots, from ``dewey`` and, for maps, ``names``."""
    ordinals, named, parts = F.split("dewey", r"\."), 0, []
    for _, at, is_map in levels(path, tables, maps):
        parts.append(F.get("names", F.lit(named)) if is_map else F.get(ordinals, F.lit(at)))
        named += is_map
    return F.concat_ws(".", *parts)


def parent(path: str, tables: list[str], maps: list[str] = ()) -> tuple[str, Column]:
    """The table above ``path`` ('' is the record) and the label of a row's parent in it, by truncation of ``dewey``."""
    above = levels(path, tables, maps)[:-1]
    return (above[-1][0], _upto(F.col("dewey"), above[-1][1] + 1)) if above else ("", _upto(F.col("dewey"), 1))


def table(nodes: DataFrame, path: str, columns: dict[str, str], keys: list[str], tables: list[str], maps: list[str] = ()) -> DataFrame:
    """One flat table: (keys, node_id, parent_table, parent_id, pos, kind) of the rows of ``path``, and (column -> member) from ``fields``.

    ``node_id`` and ``parent_id`` are labels, unique within a record, so keys and ``parent_id`` join to the table above;
    member '' is the bare element. ``tables`` are the paths kept by ``shred``.
    """
    above, up = parent(path, tables, maps)
    link = [F.col("dewey").alias("node_id"), F.lit(above).alias("parent_table"), up.alias("parent_id"), places(path, tables, maps).alias("pos")]
    return nodes.filter(F.col("path") == path).select(*keys, *link, "kind", *(F.col("fields")[m].alias(c) for c, m in columns.items()))
