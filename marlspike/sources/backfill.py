"""A source that walks a record's history backwards in time, interval by interval, with marks that survive a stop (TM-12 to TM-17).

The marks are ``low`` (all before is done), ``high`` (where the present interval began), ``curr`` (how far back it
has come) and ``skip`` (records at ``curr`` already taken). Pages come newest first from a ``fetch`` function, here
one over JSON files; the same reader is a Python data source for batch reads.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[int | None, int | None, int], list[dict]]


@dataclass
class Marks:
    """How far a backfill has come; None is open."""

    low: int | None = None
    high: int | None = None
    curr: int | None = None
    skip: int = 0


def backfill(fetch: Fetch, marks: Marks, now: Callable[[], int], stop_after: int | None = None) -> Iterator[dict]:
    """Records not yet taken, newest first within an interval; ``marks`` is kept up to date before each is handed out.

    ``fetch(low, curr, skip)`` gives one page of records with ``updated`` in [low, curr], newest first, without the
    first ``skip`` of those at ``curr``. After an interval its ``high`` becomes ``low``; one that gave anything is
    followed by another up to the present, so records changed meanwhile are caught. ``stop_after`` ends early, as
    a failure would.
    """
    taken = 0
    while True:
        if marks.high is None:
            marks.high = now()
            marks.curr, marks.skip = marks.high, 0
        any_ = False
        while page := fetch(marks.low, marks.curr, marks.skip):
            for r in page:
                marks.skip = marks.skip + 1 if r["updated"] == marks.curr else 1
                marks.curr = r["updated"]
                any_ = True
                yield r
                taken += 1
                if taken == stop_after:
                    return
        marks.low, marks.high, marks.curr, marks.skip = marks.high, None, None, 0
        if not any_ or now() <= marks.low:
            return


def newest_first(records: list[dict], page: int = 2) -> Fetch:
    """A fetch function over records at hand, in pages."""
    rows = sorted(records, key=lambda r: (-r["updated"], r["id"]))

    def fetch(low: int | None, curr: int | None, skip: int) -> list[dict]:
        inside = [r for r in rows if (low is None or r["updated"] >= low) and (curr is None or r["updated"] <= curr)]
        at = [r for r in inside if r["updated"] == curr]
        return (at[skip:] + [r for r in inside if r["updated"] != curr])[:page]

    return fetch


def take_until(records: Iterator[dict], last_id) -> tuple[list[dict], bool]:
    """TM-16: records of a newest-first feed before ``last_id`` and whether it was reached; if not, sync was lost."""
    out = []
    for r in records:
        if r["id"] == last_id:
            return out, True
        out.append(r)
    return out, last_id is None


class RecordedSource(DataSource):
    """``spark.read.format("recorded")``: recorded pages of JSON records in a folder, one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "id bigint, updated bigint, json string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".json")] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        with open(partition.value) as f:
            text = f.read().removeprefix(")]}'").strip()
        for r in json.loads(text) if text else []:
            yield r.get("id"), r.get("updated"), json.dumps(r)
