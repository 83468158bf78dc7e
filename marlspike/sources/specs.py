"""Where tables live, as one text (ST-18), and keys as text (ST-11)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """``format:path[~namespace]``, such as ``parquet:/data/docs~m1``; ``mem`` names an empty table."""

    kind: str
    path: str = ""
    namespace: str = ""

    def __str__(self) -> str:
        return self.kind + (f":{self.path}" if self.path else "") + (f"~{self.namespace}" if self.namespace else "")


KINDS = ("mem", "parquet", "orc", "json", "csv")


def parse_spec(text: str) -> Spec:
    """The parts of a spec; raises ValueError."""
    m = re.fullmatch(r"([a-z]+)(?::([^~]+))?(?:~(.+))?", text)
    if not m or m[1] not in KINDS:
        raise ValueError(f"unknown kind of table: {text!r}")
    if (m[1] == "mem") == bool(m[2]):
        raise ValueError("mem takes no path, every other kind needs one")
    return Spec(m[1], m[2] or "", m[3] or "")


def open_spec(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """The table of a spec; rows of other namespaces are left out where the schema has that column."""
    s = parse_spec(text)
    df = spark.createDataFrame([], schema) if s.kind == "mem" else spark.read.schema(schema).format(s.kind).load(s.path)
    return df.filter(F.col("namespace") == s.namespace) if s.namespace and "namespace" in df.columns else df


def parse_key(text: str) -> list:
    """A comma list of whole numbers, quoted texts, bare words, ``inf`` and ``-inf`` (None stands for an open end)."""
    out: list = []
    for part in re.findall(r'\s*("(?:[^"\\]|\\.)*"|[^,]+)\s*(?:,|$)', text):
        part = part.strip()
        if part in ("inf", "-inf"):
            out.append(None)
        elif re.fullmatch(r"-?\d+", part):
            out.append(int(part))
        else:
            out.append(part[1:-1].replace('\\"', '"') if part.startswith('"') else part)
    return out


def show_key(key: list) -> str:
    """A key as text that ``parse_key`` reads back."""
    return ", ".join("inf" if k is None else str(k) if isinstance(k, int) else '"' + k.replace('"', '\\"') + '"' for k in key)


def key_prefix(columns: list[str], key: list) -> Column:
    """Rows whose leading key columns equal ``key``; an open end stops there."""
    c = F.lit(True)
    for name, k in zip(columns, key):
        if k is None:
            break
        c = c & (F.col(name) == F.lit(k))
    return c
