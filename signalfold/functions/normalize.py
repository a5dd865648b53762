"""Column rules that turn what clients send into trustworthy values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalfold.functions.text import blank_to_null, clip_bytes, let, trim

NIL_UUID = "00000000-0000-0000-0000-000000000000"
UUID_TEXT = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
AUTO_IP = "{{auto}}"
DAY_US = 24 * 3600 * 1_000_000
MINUTE_US = 60 * 1_000_000
ZERO_TIME_US = -62_135_596_800_000_000

# Levels, span states and metric types the tables accept.
LEVELS = ("debug", "info", "warning", "error", "fatal")
SPAN_STATUSES = ("ok", "error", "cancelled")
METRIC_TYPES = ("counter", "gauge", "distribution", "set")
# Severity spellings and OpenTelemetry numbers.
SEVERITY_SPELLINGS = {
    "trace": ["trace"],
    "debug": ["debug", "verbose"],
    "warn": ["warn", "warning"],
    "error": ["error", "err"],
    "fatal": ["fatal", "critical", "crit", "panic", "emerg"],
}
SEVERITY_NUMBERS = {"trace": 1, "debug": 5, "info": 9, "warn": 13, "error": 17, "fatal": 21}


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def one_of(value: Column, allowed, default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def _lookup(values: dict, key: Column, default: Column) -> Column:
    """One probe of a constant map."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def severity(value: Column) -> Column:
    names = {spelling: name for name, all_ in SEVERITY_SPELLINGS.items() for spelling in all_}
    return _lookup(names, F.lower(trim(text(value))), F.lit("info"))


def severity_number(name: Column) -> Column:
    return _lookup(SEVERITY_NUMBERS, name, F.lit(SEVERITY_NUMBERS["info"])).cast("tinyint")


def parse_time(value: Column) -> Column:
    return value.try_cast("timestamp")


def corrected_micros(ts: Column, received: Column, sent: Column) -> Column:
    """Event time in microseconds, kept inside [received - 24 h, received + 1 min].

    A known send time measures the client's clock against ours and shifts the event; a clock
    more than a day off is not believed at all.
    """
    at, got, left = (F.unix_micros(c) for c in (ts, received, sent))
    zero = F.lit(ZERO_TIME_US)
    skew = F.when(left.isNull() | (left == zero), F.lit(0)).otherwise(got - left)
    moved = at + skew
    usable = (
        ts.isNotNull()
        & (at != zero)
        & (F.abs(skew) <= DAY_US)
        & (moved <= got + MINUTE_US)
        & (moved >= got - DAY_US)
    )
    return F.when(usable, moved).otherwise(got)


def corrected_time(ts: Column, received: Column, sent: Column) -> Column:
    return F.timestamp_micros(corrected_micros(ts, received, sent))


def parse_uuid(value: Column) -> Column:
    """Lower-case UUID text; URN, braced and undashed forms are accepted, the rest is nil."""
    lower = F.lower(value)
    size = F.length(value)

    def dashed(text: Column) -> Column:
        cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        return F.concat_ws("-", *[F.substring(text, at, n) for at, n in cuts])

    plain = (
        F.when(size == 36, lower)
        .when(size == 32, dashed(lower))
        .when(size == 38, F.substring(lower, 2, 36))
        .when((size == 45) & lower.startswith("urn:uuid:"), F.substring(lower, 10, 36))
    )
    return let(
        plain, lambda p: F.when(p.rlike(UUID_TEXT), p).otherwise(F.lit(NIL_UUID))
    )


def derived_uuid(*parts: Column) -> Column:
    """A UUID made from the row itself, so that a retried task gives the same id."""
    digest = F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")


def parse_span_id(value: Column) -> Column:
    """Hex text folded into 64 bits (the last 16 digits); anything else is 0."""
    hexadecimal = value.rlike(r"^[0-9a-fA-F]+\z")
    return F.when(hexadecimal, F.conv(F.right(value, F.lit(16)), 16, -10).cast("long")).otherwise(
        F.lit(0).cast("long")
    )


def client_ip(user_ip: Column, job_ip: Column) -> Column:
    asked = F.coalesce(user_ip, F.lit("")).isin("", AUTO_IP)
    return text(F.when(asked, job_ip).otherwise(user_ip))


def environment(value: Column) -> Column:
    return F.coalesce(blank_to_null(value), F.lit("production"))


def duration_ns(ms: Column) -> Column:
    """Milliseconds to nanoseconds, truncated; a negative duration counts as zero."""
    return F.greatest(F.coalesce((ms * 1e6).cast("long"), F.lit(0).cast("long")), F.lit(0))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def last_exception(exceptions: Column) -> Column:
    return F.try_element_at(exceptions, F.lit(-1))


def title(exceptions: Column, message: Column) -> Column:
    """'Type: value' of the last exception, else the message; at most 200 bytes."""
    last = last_exception(exceptions)
    kind, value = blank_to_null(last["type"]), blank_to_null(last["value"])
    headline = F.when(kind.isNotNull(), F.concat_ws(": ", kind, value)).otherwise(
        blank_to_null(message)
    )
    return F.coalesce(clip_bytes(headline, 200), F.lit("Unknown error"))


def frame_label(frame: Column) -> Column:
    where = F.coalesce(blank_to_null(frame["module"]), blank_to_null(frame["filename"]))
    function = blank_to_null(frame["function"])
    return F.coalesce(
        F.concat(function, F.lit("("), where, F.lit(")")), function, where, F.lit("")
    )


def culprit(exceptions: Column) -> Column:
    """Label of the last in-app frame of the last exception, else of its last frame."""
    frames = last_exception(exceptions)["frames"]
    own = F.filter(frames, lambda f: F.coalesce(f["in_app"], F.lit(False)))
    chosen = F.coalesce(
        F.try_element_at(own, F.lit(-1)), F.try_element_at(frames, F.lit(-1))
    )
    return F.when(chosen.isNull(), F.lit("")).otherwise(frame_label(chosen))
