"""The search box as a filter: the same text a user types, turned into Spark column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalfold.scale import scoped, time_literal, utc


class SearchError(ValueError):
    """Names the term that is wrong and why, so that a typo never yields an empty page."""

    def __init__(self, term: str, reason: str):
        super().__init__(f"{term}: {reason}")
        self.term, self.reason = term, reason


@dataclass(frozen=True)
class Signal:
    """Searchable fields of one signal: name -> (column, kind)."""

    fields: dict[str, tuple[str, str]]
    text_columns: tuple[str, ...]
    catch_all: str


# The fields each signal can be searched by.
ERRORS = Signal(
    fields={
        "level": ("level", "string"),
        "environment": ("environment", "string"),
        "release": ("release", "string"),
        "platform": ("platform", "string"),
        "type": ("exception_type", "string"),
        "value": ("exception_value", "string"),
        "culprit": ("culprit", "string"),
        "browser": ("browser", "string"),
        "os": ("os", "string"),
        "country": ("geo_country", "string"),
        "sdk": ("sdk_name", "string"),
        "user.id": ("user_id", "string"),
        "user.email": ("user_email", "string"),
        "trace": ("trace_id", "string"),
        "timestamp": ("timestamp", "time"),
        "tags": ("tags", "map"),
    },
    text_columns=("exception_value", "culprit"),
    catch_all="tags",
)
LOGS = Signal(
    fields={
        "severity": ("severity_number", "severity"),
        "level": ("severity_number", "severity"),
        "service": ("service", "string"),
        "environment": ("environment", "string"),
        "release": ("release", "string"),
        "body": ("body", "string"),
        "template": ("template", "string"),
        "trace": ("trace_id", "string"),
        "timestamp": ("timestamp", "time"),
        "attributes": ("attributes", "map"),
    },
    text_columns=("body",),
    catch_all="attributes",
)
SPANS = Signal(
    fields={
        "op": ("op", "string"),
        "name": ("name", "string"),
        "service": ("service", "string"),
        "status": ("status", "string"),
        "duration": ("duration_ns", "duration"),
        "environment": ("environment", "string"),
        "release": ("release", "string"),
        "trace": ("trace_id", "string"),
        "http.method": ("http_method", "string"),
        "http.status": ("http_status", "number"),
        "http.route": ("http_route", "string"),
        "db": ("db_system", "string"),
        "user.id": ("user_id", "string"),
        "timestamp": ("timestamp", "time"),
        "tags": ("tags", "map"),
    },
    text_columns=("name", "http_route"),
    catch_all="tags",
)
SIGNALS = {"errors": ERRORS, "logs": LOGS, "spans": SPANS}

# Severity names and their OpenTelemetry numbers.
SEVERITY_NUMBERS = {
    "trace": 1,
    "debug": 5,
    "info": 9,
    "warn": 13,
    "warning": 13,
    "error": 17,
    "err": 17,
    "fatal": 21,
    "critical": 21,
}
UNIT_NANOS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}

_CHUNK = re.compile(r'(?:"[^"]*(?:"|$)|[^\s"])+')
_QUOTED = re.compile(r'"([^"]*)(?:"|$)')
_OPERATOR = re.compile(r"(>=|<=|>|<)?(.*)", re.S)
_DURATION_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def split_terms(text: str) -> list[tuple[str | None, str, bool, bool]]:
    """(field or None, value, negated, quoted) for every term of the search text."""
    terms = []
    for chunk in _CHUNK.findall(text):
        quoted = '"' in chunk
        body = chunk.lstrip("!-")
        negated = body != chunk
        # A colon inside quotes is text; hide it while looking for the separator.
        plain = _QUOTED.sub(lambda m: m.group(1).replace(":", "\0"), body)
        colon = plain.find(":", 1)
        field = plain[:colon].replace("\0", ":") if colon > 0 else None
        value = plain[colon + 1 :].replace("\0", ":") if colon > 0 else plain.replace("\0", ":")
        if value or quoted:
            terms.append((field, value, negated, quoted))
    return terms


def parse_duration(text: str) -> int:
    """'500ms', '1.5s', '1h30m' as nanoseconds."""
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if body == "0":
        return 0
    parts = _DURATION_PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"{text!r} is no duration; write e.g. 250ms, 1.5s or 1h30m")
    return sign * int(sum(Decimal(n) * UNIT_NANOS[u] for n, u in parts))


def parse_time(text: str, now: datetime | None) -> datetime:
    """An absolute time, or an age such as -24h counted back from `now`."""
    if text.startswith("-"):
        if now is None:
            raise ValueError("a relative time needs `now`")
        try:
            nanos = parse_duration(text)
        except ValueError:
            raise ValueError(f"{text!r} is no age; write e.g. -6h") from None
        return utc(now) + timedelta(microseconds=nanos / 1000)
    for pattern in ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return utc(datetime.strptime(text, pattern))
        except ValueError:
            continue
    raise ValueError(f"{text!r} is no point in time; write e.g. 2024-01-31 or -6h")


def _typed(kind: str, text: str, now: datetime | None):
    text = text.strip()
    if kind == "number":
        try:
            if "_" in text:
                raise ValueError
            number = float(text)
            # A whole number compares with an integer column without a cast.
            return int(number) if number.is_integer() else number
        except ValueError:
            raise ValueError(f"{text!r} is no number") from None
    if kind == "duration":
        return parse_duration(text)
    if kind == "time":
        return parse_time(text, now)
    if kind == "severity":
        if text.lower() not in SEVERITY_NUMBERS:
            raise ValueError(
                f"{text!r} is none of {', '.join(SEVERITY_NUMBERS)}"
            )
        return SEVERITY_NUMBERS[text.lower()]
    return text


def lookup(signal: Signal, name: str) -> tuple[str, str, str]:
    """(column, kind, map key); unknown names are keys of the catch-all map."""
    name = name.strip()
    if name in signal.fields:
        return (*signal.fields[name], "")
    base, dot, key = name.partition(".")
    if dot and signal.fields.get(base, ("", ""))[1] == "map":
        return (*signal.fields[base], key)
    return (*signal.fields[signal.catch_all], name)


def map_value(column: str, key: str) -> Column:
    """A missing key reads as the empty string, so `!key:v` keeps rows without the key."""
    return F.coalesce(F.col(column)[key], F.lit(""))


def search_condition(
    df: DataFrame, signal: Signal, text: str, now: datetime | None = None, strict: bool = False
) -> Column:
    """All terms of the search as one condition; a blank search matches everything."""
    condition = F.lit(True)
    for field, value, negated, quoted in split_terms(text):
        if field is None:
            if negated and strict:
                raise SearchError(value, "a bare word cannot be negated")
            if value:
                hits = [F.lower(c).contains(value.lower()) for c in signal.text_columns]
                either = hits[0]
                for hit in hits[1:]:
                    either = either | hit
                condition = condition & either
            continue
        term = f"{field}:{value}"
        column, kind, key = lookup(signal, field)
        operator, raw = (None, value) if quoted else _OPERATOR.fullmatch(value).groups()
        try:
            typed = _typed(kind, raw, now)
        except ValueError as error:
            raise SearchError(term, str(error)) from None
        if kind == "map" and not key:
            raise SearchError(term, f"name a key, as in {column}.plan:free")
        if operator and kind in ("string", "map"):
            raise SearchError(
                term,
                f"{operator} cannot order text; it works on numbers, durations, times and severities",
            )
        left = map_value(column, key) if kind == "map" else F.col(column)
        right = time_literal(df, column, typed) if kind == "time" else F.lit(typed)
        test = {
            None: left == right,
            ">": left > right,
            ">=": left >= right,
            "<": left < right,
            "<=": left <= right,
        }[operator]
        condition = condition & (~test if negated else test)
    return condition


def search(
    df: DataFrame,
    signal: str,
    text: str = "",
    project_id: int | None = None,
    start=None,
    end=None,
    environment: str = "",
    now: datetime | None = None,
) -> DataFrame:
    """Rows of one signal matching the search inside a project and half-open time range."""
    rows = scoped(df, project_id, environment, start, end)
    return rows.filter(search_condition(df, SIGNALS[signal], text, now))


DEFAULT_RANGE = timedelta(days=14)


def time_range(now: datetime, start=None, end=None) -> tuple[datetime, datetime]:
    """The last 14 days unless both bounds are usable and in order."""

    def usable(value):
        try:
            return utc(value) if value is not None else None
        except (TypeError, ValueError):
            return None

    low, high = usable(start), usable(end)
    high = high if high is not None else utc(now)
    low = low if low is not None else utc(now) - DEFAULT_RANGE
    if low >= high:
        return utc(now) - DEFAULT_RANGE, utc(now)
    return low, high
