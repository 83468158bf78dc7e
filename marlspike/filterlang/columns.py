"""Filter trees to columns over any nested schema (FL-4 to FL-24).

Every leaf becomes a boolean that is never null, so that NOT stays two-valued. Types that don't fit give a message
and a part that is always false.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.filterlang.syntax import Both, Call, Compare, Not, Path, Word, parse

#: Layouts of time literals besides RFC 3339, tried in this order.
TIME_LAYOUTS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H", "%Y-%m-%d", "%Y-%m", "%Y", "%B %d %Y", "%B %Y", "%b %d %Y", "%b %Y")

_RFC3339 = re.compile(r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})$")
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
#: A word of a text: a run of characters that may start a bare word, or any other character but white space.
_WORDS = r"[#-'*/;?@A-Z\[\]\^-}\\\x{a1}-\x{effff}]+|\S"
_BOUNDARY = r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]$"


class _NoFit(Exception):
    pass


def _camel(name: str) -> str:
    s = re.sub(r"_(.)", lambda m: m[1].upper(), name)
    return s[:1].lower() + s[1:]


def _int(s: str) -> int:
    m = re.fullmatch(r"([+-]?)0([0-7_]+)", s)
    if m:
        return int(m[1] + m[2].replace("_", ""), 8)
    return int(s, 0)


def _time(s: str) -> tuple[dt.datetime, bool]:
    """A UTC time in microseconds and whether finer digits were cut off."""
    if m := _RFC3339.match(s):
        t = dt.datetime.fromisoformat(m[1] + ("+00:00" if m[3] == "Z" else m[3])).astimezone(dt.UTC).replace(tzinfo=None)
        frac = (m[2] or "").ljust(9, "0")
        return t + dt.timedelta(microseconds=int(frac[:6] or 0)), bool(frac[6:].strip("0"))
    for layout in TIME_LAYOUTS:
        try:
            return dt.datetime.strptime(s, layout), False
        except ValueError:
            pass
    raise ValueError(s)


def _literal(kind: T.DataType, s: str):
    """The value of a literal for a column type; raises ValueError if it has none."""
    if isinstance(kind, T.StringType):
        return s
    if isinstance(kind, T.BooleanType):
        if s.lower() in ("true", "false"):
            return s.lower() == "true"
        raise ValueError(s)
    if isinstance(kind, _INTS):
        if s.endswith("s") and isinstance(kind, T.LongType):
            return round(float(s[:-1]) * 1_000_000_000)
        return _int(s)
    if isinstance(kind, _FLOATS):
        return float(s)
    if isinstance(kind, _TIMES):
        return _time(s)
    raise ValueError(s)


#: Whether parts may be null for false, as in a filter outside of any negation; only such comparisons reach the scan.
_loose: ContextVar[bool] = ContextVar("loose", default=False)


@contextmanager
def _nulls(allowed: bool):
    was = _loose.set(allowed)
    try:
        yield
    finally:
        _loose.reset(was)


def _two(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _yes(c: Column) -> Column:
    return c if _loose.get() else _two(c)


def _text_test(op: str, w: Word) -> Callable[[Column], Column]:
    if op in ("=~", "!~"):
        pattern = re.sub(r"^\(\?i\)", "(?iu)", w.text)
        return (lambda c: _yes(c.rlike(pattern))) if op == "=~" else (lambda c: _yes(~c.rlike(pattern)))
    if op in ("<", "<=", ">", ">="):
        return lambda c: _yes({"<": c < w.text, "<=": c <= w.text, ">": c > w.text, ">=": c >= w.text}[op])
    if w.text == "" and w.quoted and op != "!=":
        return lambda c: F.coalesce(c == "", F.lit(True))
    low, wild = w.text.lower(), not w.grouped
    if wild and low.startswith("*"):
        test = lambda c: F.endswith(F.lower(c), F.lit(low[1:]))
    elif wild and low.endswith("*"):
        test = lambda c: F.startswith(F.lower(c), F.lit(low[:-1]))
    elif op == ":":

        def test(c: Column) -> Column:
            at = F.instr(F.lower(c), low)
            before, after = F.substr(c, at - 1, F.lit(1)), F.substr(c, at + len(low), F.lit(1))
            return (at > 0) & ((at == 1) | before.rlike(_BOUNDARY)) & ((at + len(low) > F.length(c)) | after.rlike(_BOUNDARY))
    else:
        test = lambda c: F.lower(c) == low
    if op == ":":

        def has(c: Column) -> Column:
            words = F.regexp_extract_all(c, F.lit(_WORDS), 0)
            return _yes(test(c) | ((F.size(words) > 1) & F.exists(words, test)))

        return has
    return (lambda c: ~_two(test(c))) if op == "!=" else (lambda c: _yes(test(c)))


def _present(kind: T.DataType, c: Column) -> Column:
    if isinstance(kind, T.StringType):
        return _yes(c != "")
    if isinstance(kind, T.BooleanType):
        return _yes(c)
    if isinstance(kind, (*_INTS, *_FLOATS)):
        return _yes(c != 0)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNotNull()
    return c.isNotNull()


def _test(op: str, kind: T.DataType, w: Word) -> Callable[[Column], Column]:
    """What a comparison with one literal asks of a value of ``kind``."""
    if op == ":" and w.text == "*" and not w.quoted:
        return lambda c: _present(kind, c)
    try:
        v = _literal(kind, w.text)
    except ValueError:
        raise _NoFit(f"{w.at}: can't read {w.text!r} as {kind.simpleString()}") from None
    if isinstance(kind, T.StringType):
        return _text_test(op, w)
    if op in ("=~", "!~"):
        raise _NoFit(f"{w.at}: regular expression match on {kind.simpleString()}")
    if isinstance(kind, _TIMES):
        (t, finer), lit = v, F.lit(v[0]).cast("timestamp_ntz").cast(kind)
        if finer:  # stored values have no such digits: they equal none, and the literal lies just after t
            op = {"<": "<=", ">=": ">", "=": "never", ":": "never", "!=": "always"}.get(op, op)
        v = lit
    make = {
        "<": lambda c: c < v, "<=": lambda c: c <= v, ">": lambda c: c > v, ">=": lambda c: c >= v,
        "=": lambda c: c == v, ":": lambda c: c == v, "!=": lambda c: c != v,
        "never": lambda c: F.lit(False), "always": lambda c: c.isNotNull(),
    }[op]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        nan = v != v
        return lambda c: _yes(F.when(F.isnan(c), F.lit(nan)).otherwise(F.lit(False) if nan and op != "!=" else make(c)))
    return lambda c: _yes(make(c))


class _Compiler:
    def __init__(self, schema: T.StructType, derived: dict[str, tuple[T.DataType, Column]] | None = None):
        self.schema, self.derived, self.messages = schema, derived or {}, []

    def field(self, struct: T.StructType, name: str) -> T.StructField | None:
        exact = [f for f in struct.fields if f.name == name]
        alike = [f for f in struct.fields if _camel(f.name) == _camel(name)]
        return (exact or alike or [None])[0]

    def top(self, name: str, at: int) -> tuple[T.DataType, Column]:
        f = self.field(self.schema, name)
        if f is not None:
            return f.dataType, F.col(f"`{f.name}`")
        if name in self.derived:
            return self.derived[name]
        raise _NoFit(f"{at}: unknown field {name}")

    def reach(self, kind: T.DataType, c: Column, parts: list[str], leaf: Callable[[T.DataType, Column], Column], at: int) -> Column:
        """``leaf`` at the end of ``parts``; true of any of the elements that lie on the way."""
        if isinstance(kind, T.ArrayType):
            return _yes(F.exists(c, lambda x: self.reach(kind.elementType, x, parts, leaf, at)))
        if not parts:
            if isinstance(kind, T.MapType):
                return _yes(F.exists(F.map_values(c), lambda x: self.reach(kind.valueType, x, parts, leaf, at)))
            return leaf(kind, c)
        if isinstance(kind, T.MapType):
            try:
                key = _literal(kind.keyType, parts[0])
            except ValueError:
                raise _NoFit(f"{at}: {parts[0]} is no key") from None
            return self.reach(kind.valueType, F.try_element_at(c, F.lit(key).cast(kind.keyType)), parts[1:], leaf, at)
        if isinstance(kind, T.StructType) and (f := self.field(kind, parts[0])) is not None:
            return self.reach(f.dataType, c.getField(f.name), parts[1:], leaf, at)
        raise _NoFit(f"{at}: unknown field {parts[0]}")

    def right(self, e, one: Callable[[Word], Column]) -> Column:
        """The right side of a comparison: the operator is distributed over its words."""
        if isinstance(e, Both):
            a, b = self.right(e.left, one), self.right(e.right, one)
            return a & b if e.op == "AND" else a | b
        if isinstance(e, Not):
            with _nulls(False):
                return ~self.right(e.sub, one)
        if isinstance(e, Path):
            return one(Word(".".join(e.parts), at=e.at))
        if isinstance(e, Word):
            return one(e)
        raise _NoFit(f"{getattr(e, 'at', 0)}: " + ("functions are not implemented" if isinstance(e, Call) else "invalid comparison on right of comparison"))

    def leaf(self, op: str, w: Word) -> Callable[[T.DataType, Column], Column]:
        def test(kind: T.DataType, c: Column) -> Column:
            if not isinstance(kind, T.StructType):
                return _test(op, kind, w)(c)
            if op not in ("=", ":", "!="):
                raise _NoFit(f"{w.at}: {op} on a structure")
            parts = []
            for f in kind.fields:
                try:
                    if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
                        parts.append(_two(_test(":", f.dataType, w)(c.getField(f.name))))
                except _NoFit:
                    pass
            if not parts:
                raise _NoFit(f"{w.at}: no field can hold {w.text}")
            any_ = c.isNotNull() & _any(parts)
            return ~any_ if op == "!=" else any_

        return test

    def compare(self, e: Compare) -> Column:
        if not isinstance(e.left, (Word, Path)):
            raise _NoFit(f"{e.at}: invalid expression on left of {e.op}")
        parts = e.left.parts if isinstance(e.left, Path) else [e.left.text]
        kind, c = self.top(parts[0], e.left.at)
        bare = isinstance(e.right, Word) and not e.right.quoted and "*" not in e.right.text
        if e.op == ":" and len(parts) == 1 and bare and isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            return _yes(F.map_contains_key(c, e.right.text))
        return self.right(e.right, lambda w: self.reach(kind, c, parts[1:], self.leaf(e.op, w), e.at))

    def anywhere(self, kind: T.DataType, c: Column, w: Word) -> Column | None:
        """Whether a bare word occurs in a value or anything inside it; None if it can't."""
        if isinstance(kind, T.StructType):
            parts = [p for f in kind.fields if (p := self.anywhere(f.dataType, c.getField(f.name), w)) is not None]
            return _any(parts) if parts else None
        if isinstance(kind, (T.ArrayType, T.MapType)):
            inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
            items = c if isinstance(kind, T.ArrayType) else F.map_values(c)
            if self.anywhere(inner, F.lit(None).cast(inner), w) is None:
                return None
            return _yes(F.exists(items, lambda x: self.anywhere(inner, x, w)))
        if isinstance(kind, T.StringType):
            return _yes(F.contains(F.lower(c), F.lit(w.text.lower())))
        try:
            return _test("=", kind, w)(c)
        except _NoFit:
            return None

    def build(self, e) -> Column:
        if isinstance(e, Both):
            a, b = self.build(e.left), self.build(e.right)
            return a & b if e.op == "AND" else a | b
        if isinstance(e, Not):
            with _nulls(False):
                return ~self.build(e.sub)
        try:
            if isinstance(e, Compare):
                return self.compare(e)
            if isinstance(e, Word):
                parts = [p for f in self.schema.fields if (p := self.anywhere(f.dataType, F.col(f"`{f.name}`"), e)) is not None]
                parts += [p for kind, c in self.derived.values() if (p := self.anywhere(kind, c, e)) is not None]
                if not parts:
                    raise _NoFit(f"{e.at}: nothing can match {e.text}")
                return _any(parts)
            if isinstance(e, Path):
                kind, c = self.top(e.parts[0], e.at)

                def boolean(k: T.DataType, x: Column) -> Column:
                    if not isinstance(k, T.BooleanType):
                        raise _NoFit(f"{e.at}: {'.'.join(e.parts)} is not a boolean")
                    return _yes(x)

                return self.reach(kind, c, e.parts[1:], boolean, e.at)
            raise _NoFit(f"{e.at}: functions are not implemented")
        except _NoFit as bad:
            self.messages.append(str(bad))
            return F.lit(False)


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def compile_filter(text: str, schema: T.StructType, derived: dict[str, tuple[T.DataType, Column]] | None = None) -> tuple[Column, list[str]]:
    """A filter text as (boolean column, messages). ``derived`` adds named columns that behave like fields."""
    e = parse(text)
    if e is None:
        return F.lit(True), []
    c = _Compiler(schema, derived)
    return c.build(e), c.messages


def filter_rows(df: DataFrame, text: str, derived: dict[str, tuple[T.DataType, Column]] | None = None) -> DataFrame:
    """The rows of ``df`` that a filter text keeps; comparisons outside of negations stay plain, so they reach the scan."""
    with _nulls(True):
        kept = compile_filter(text, df.schema, derived)[0]
    return df.filter(kept)
