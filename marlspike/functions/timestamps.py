"""Mixed timestamp texts to UTC instants: an ordered cascade of anchored patterns, all inside the JVM.

Every pattern rewrites a text it matches to one canonical line ``Y|M|D|h|m|s|fraction|half|zone|check``; one
set of expressions then turns that line into microseconds since 1970-01-01 UTC. The first pattern that matches
decides. A text denotes an instant only if exactly one reading of it is a valid one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Zone abbreviations and their offsets from UTC in minutes (North American and Central European use).
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "CET": 60, "CEST": 120,
}

_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_DAYS = "mon|tue|wed|thu|fri|sat|sun"
_LONG_DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
_TIME = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"

#: (name, pattern, canonical line). Order matters: the first match decides.
CASCADE = [
    ("iso_offset", rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}})[t ]{_TIME} ?([+-]\d{{2}}(?::?\d{{2}})?)(?: ([a-z]{{1,5}}))?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9|"),
    ("iso_offset_region", rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}})[t ]{_TIME} ?([+-]\d{{2}}(?::?\d{{2}})?)\[([a-z0-9_+/-]+)\]$", "$1|$2|$3|$4|$5|$6|$7||$8|$9|"),
    ("iso_zone", rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}})[t ]{_TIME} ?([a-z]{{1,5}}|[a-z_]+(?:/[a-z0-9_+-]+){{1,2}}|\[[a-z0-9_+/-]+\])$", "$1|$2|$3|$4|$5|$6|$7||$8||"),
    ("iso_local", rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}})[t ]{_TIME}$", "$1|$2|$3|$4|$5|$6|$7||||"),
    ("compact", r"(?i)^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?(z|[+-]\d{2}(?::?\d{2})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8||"),
    ("slash_ymd", rf"^(\d{{4}})/(\d{{2}})/(\d{{2}}) {_TIME}$", "$1|$2|$3|$4|$5|$6|$7||||"),
    ("slash_two", rf"^(\d{{2}})/(\d{{2}})/(\d{{4}}) {_TIME}$", "$3|$2|$1|$4|$5|$6|$7||||two"),
    ("rfc1123", rf"(?i)^({_DAYS}), (\d{{1,2}}) ({_MONTHS}) (\d{{4}}) {_TIME} ([a-z]{{1,5}}|[+-]\d{{2}}:?\d{{2}})$", "$4|$3|$2|$5|$6|$7|$8||$9||$1"),
    ("rfc850", rf"(?i)^({_LONG_DAYS}), (\d{{2}})-({_MONTHS})-(\d{{2}}) {_TIME} ([a-z]{{1,5}}|[+-]\d{{2}}:?\d{{2}})$", "$4|$3|$2|$5|$6|$7|$8||$9||$1"),
    ("ansic", rf"(?i)^({_DAYS}) ({_MONTHS}) {{1,2}}(\d{{1,2}}) {_TIME}(?: ([a-z]{{1,5}}|[+-]\d{{4}}))? (\d{{4}})$", "$9|$2|$3|$4|$5|$6|$7||$8||$1"),
    ("medium", rf"(?i)^({_MONTHS})[a-z]* (\d{{1,2}}), (\d{{4}}),? (\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:\.(\d{{1,9}}))?)? ([ap]m)(?: ([a-z]{{1,5}}|[+-]\d{{2}}:?\d{{2}}))?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9||"),
]
#: Digits of a bare number: seconds (with or without a fraction), milli-, micro- or nanoseconds since 1970.
EPOCH = r"^(\d{9,10}(?:\.\d{1,9})?|\d{13}|\d{16}|\d{19})$"


def known_zones() -> str:
    """The region names the JVM can resolve, between bars; Spark raises on others, so they have no reading."""
    s = SparkSession.getActiveSession()
    if s is not None and hasattr(s, "_jvm"):
        return "|" + s._jvm.java.lang.String.join("|", s._jvm.java.time.ZoneId.getAvailableZoneIds()) + "|"
    import zoneinfo

    return "|" + "|".join(zoneinfo.available_timezones()) + "|"


def _offset_at(instant: Column, zone: Column) -> Column:
    """Microseconds by which local time in ``zone`` is ahead of UTC at ``instant`` (microseconds)."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant), zone)) - instant


def local_instants(local: Column, zone: Column) -> Column:
    """All instants (microseconds) at which clocks in ``zone`` show ``local``: none in a gap, two in a fold."""
    day = F.lit(86_400_000_000)
    tried = F.array(local - _offset_at(local - day, zone), local - _offset_at(local + day, zone))
    return F.array_distinct(F.filter(tried, lambda u: u + _offset_at(u, zone) == local))


def _int(c: Column) -> Column:
    return c.try_cast("bigint")


def with_instant(
    df: DataFrame,
    text: str,
    out: str,
    zone: str | None = None,
    ambiguous: str = "null",
    nonexistent: str = "null",
    date_order: str = "unique",
) -> DataFrame:
    """Add ``out``: the one UTC instant, in microseconds, that the column ``text`` denotes, or null.

    ``zone`` is the column with the region for texts without a zone (none: UTC); where it is null or unknown such
    texts give null. ``ambiguous``: a local time that occurs twice gives ``null``, or the ``earlier`` / ``later``
    instant. ``nonexistent``: a local time skipped by the clocks gives ``null``, or is shifted ``forward`` by the
    gap. ``date_order`` of ``NN/NN/YYYY``: ``unique`` accepts a date only if one order is a date or both are the
    same, also where clocks skip the hour on one of them; ``day_first`` and ``month_first`` fix the order.

    Digits finer than microseconds are cut off, missing seconds are zero. Null: null, blank and unreadable texts,
    impossible dates, dates without a time, the zero time (year 1), and a weekday, bracketed region or
    abbreviation that contradicts the rest. An empty table stays empty; other columns and repeated rows pass
    through. A column that is already called ``out`` is replaced.

    The work is laid out as a chain of projections, so that each text is matched and split once.
    """
    if ambiguous not in ("null", "earlier", "later") or nonexistent not in ("null", "forward") or date_order not in ("unique", "day_first", "month_first"):
        raise ValueError("unknown policy")
    kept = [c for c in df.columns if c != out]
    zones, none = known_zones(), F.lit(None).cast("bigint")
    table = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    known = lambda c: F.contains(F.lit(zones), F.concat(F.lit("|"), c, F.lit("|")))
    empty = F.array().cast("array<bigint>")
    col = lambda name: F.col(f"__ms_{name}")

    def step(rows: DataFrame, /, **new: Column) -> DataFrame:
        return rows.withColumns({f"__ms_{k}": v for k, v in new.items()})

    d = step(df, t=F.regexp_replace(F.regexp_replace(F.col(f"`{text}`"), rf"^{_SPACE}+|{_SPACE}+$", ""), r"[\u00a0\u2007\u2009\u202f]", " "), z=F.col(f"`{zone}`") if zone else F.lit("UTC"))

    line = F.lit(None).cast("string")
    for _, pattern, to in reversed(CASCADE):
        line = F.when(col("t").rlike(pattern), F.regexp_replace(col("t"), pattern, to)).otherwise(line)
    d = step(d, l=F.split(line, r"\|"))

    part = lambda k: F.nullif(F.get(col("l"), F.lit(k)), F.lit(""))
    d = step(d, y=_int(part(0)), ys=F.length(part(0)) == 2, mt=F.lower(part(1)), d=_int(part(2)), h=_int(part(3)), mi=_int(part(4)), s=F.coalesce(_int(part(5)), F.lit(0)), f=F.coalesce(_int(F.substring(F.rpad(part(6), 9, "0"), 1, 6)), F.lit(0)), half=F.lower(part(7)), zn=F.regexp_replace(part(8), r"[\[\]]", ""), ck=part(9), tag=F.lower(F.substring(part(10), 1, 3)))

    signed = F.regexp_extract_all(col("zn"), F.lit(r"(\d{2})"), 1)
    minutes = _int(F.get(signed, F.lit(0))) * 60 + F.coalesce(_int(F.get(signed, F.lit(1))), F.lit(0))
    d = step(
        d,
        y=F.when(col("ys"), col("y") + F.when(col("y") >= 69, 1900).otherwise(2000)).otherwise(col("y")),
        mo=F.when(col("mt").rlike(r"^\d+$"), _int(col("mt"))).otherwise(F.floor((F.instr(F.lit(_MONTHS.replace("|", "")), col("mt")) + 2) / 3)),
        h=F.when(col("half").isNull(), col("h")).when(col("h").between(1, 12), F.pmod(col("h"), F.lit(12)) + F.when(col("half") == "pm", 12).otherwise(0)),
        off=F.when(col("zn").rlike(r"^[+-]\d"), F.when((minutes <= 18 * 60) & (F.coalesce(_int(F.get(signed, F.lit(1))), F.lit(0)) < 60), F.when(F.startswith(col("zn"), F.lit("-")), -minutes).otherwise(minutes))).otherwise(F.try_element_at(table, F.upper(col("zn")))),
        numeric=col("zn").rlike(r"^[+-]\d"),
    )

    region = F.when(col("zn").isNull(), col("z")).when(col("off").isNull() & ~col("numeric"), col("zn"))
    clock_ok = col("h").between(0, 23) & col("mi").between(0, 59) & col("s").between(0, 59) & (col("y") > 1)
    d = step(
        d,
        clock=F.when(clock_ok, ((col("h") * 60 + col("mi")) * 60 + col("s")) * 1_000_000 + col("f")),
        rg=F.when(known(region), region),
        two=F.coalesce(col("tag") == "two", F.lit(False)),
        a=F.format_string("%04d-%02d-%02d", col("y"), col("mo"), col("d")).try_cast("date"),
        b=F.format_string("%04d-%02d-%02d", col("y"), col("d"), col("mo")).try_cast("date"),
    )

    def local(date: Column) -> Column:
        says = F.when(col("tag").isin(_DAYS.split("|")), col("tag") == F.lower(F.date_format(date, "EEE"))).otherwise(True)
        return F.when(says, F.unix_date(date).cast("bigint") * 86_400_000_000 + col("clock"))

    first = local(col("a")) if date_order != "month_first" else F.when(~col("two"), local(col("a")))
    second = none if date_order == "day_first" else F.when(col("two"), local(col("b")))
    d = step(d, x=F.array_distinct(F.array_compact(F.array(first, second))))

    def of_local(x: Column) -> Column:
        at = local_instants(x, col("rg"))
        if ambiguous != "null":
            at = F.slice(F.sort_array(at, asc=ambiguous == "earlier"), 1, 1)
        if nonexistent == "forward":
            at = F.when(F.size(at) == 0, F.array(x - _offset_at(x - 86_400_000_000, col("rg")))).otherwise(at)
        return F.when(col("rg").isNotNull(), at).otherwise(empty)

    def of_offset(x: Column) -> Column:
        u, said = x - col("off") * 60_000_000, F.try_element_at(table, F.upper(col("ck")))
        named = F.when(known(col("ck")), col("ck"))
        fits = F.when(col("ck").isNull(), True).when(said.isNotNull(), said == col("off")).when(named.isNotNull(), _offset_at(u, named) == col("off") * 60_000_000).otherwise(~F.contains(col("ck"), F.lit("/")))
        return F.when(fits, F.array(u)).otherwise(empty)

    readings = F.transform(col("x"), lambda x: F.when(col("off").isNotNull(), of_offset(x)).otherwise(of_local(x)))
    d = step(d, u=F.array_distinct(F.flatten(readings)))

    t = col("t")
    fraction = F.when(F.contains(t, F.lit(".")), F.substring_index(t, ".", -1)).otherwise("")
    seconds = _int(F.substring_index(t, ".", 1)) * 1_000_000 + _int(F.substring(F.rpad(fraction, 9, "0"), 1, 6))
    number = F.when(F.length(t) == 13, _int(t) * 1000).when(F.length(t) == 16, _int(t)).when(F.length(t) == 19, _int(F.substring(t, 1, 16)))
    number = F.when(F.length(F.substring_index(t, ".", 1)) <= 10, seconds).otherwise(number)
    found = F.when(t.rlike(EPOCH), F.array(number.cast("bigint"))).when((F.size(col("x")) == 1) & (F.size(col("u")) == 1), col("u"))
    # A generator ends the chain: the optimiser would otherwise push a filter on the result down through all
    # projections and repeat their expressions without end.
    return step(d, r=found).select(*(F.col(f"`{c}`") for c in kept), F.explode_outer(col("r")).alias(out))
