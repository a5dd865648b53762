"""Fingerprints: which occurrences are the same problem."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalfold.functions.text import (
    EDGE,
    WORD_END,
    WORD_START,
    blank_to_null,
    replace_with_probe,
    squeeze,
    trim,
)

DEFAULT_MARK = "{{default}}"
SEPARATOR = "\x1f"

# The variable parts of a message, in the order they are replaced, with a plain
# substring every match contains where there is one.  Possessive repeats match the same text
# and keep the matcher off the call stack.
MESSAGE_PARTS = [
    (r"(?i)" + WORD_START + r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}" + WORD_END, "<uuid>", "-"),
    (r"(?i)" + EDGE + r"[\w.+-]+@[\w-]+\.[\w.-]+" + EDGE, "<email>", "@"),
    (r"(?i)" + WORD_START + r"https?://[^\t\n\f\r '\"]+", "<url>", "://"),
    (r"(?i)" + WORD_START + r"(?:0x)?[0-9a-f]{8,}" + WORD_END, "<hex>", None),
    (r"(?:/[\w.@:-]++){2,}+/?", "<path>", "/"),
    (r"'[^']*'|\"[^\"]*\"", "<str>", None),
    (r"\d(?<!\w\d)[\d.,]*" + EDGE, "<num>", None),
]
BUNDLE_HASH = r"(?i)[.\-_](?:[0-9a-f]{4,}|[0-9a-z]{8,})(\.\w+)\z"


def parameterize(message: Column) -> Column:
    """Replace ids, addresses, paths, quoted text and numbers by placeholders."""
    out = trim(message)
    for pattern, placeholder, probe in MESSAGE_PARTS:
        if probe:
            out = replace_with_probe(out, probe, pattern, placeholder)
        else:
            out = F.regexp_replace(out, pattern, placeholder)
    return squeeze(out)


def normal_filename(filename: Column) -> Column:
    """Base name without query, fragment and build hash."""
    path = F.regexp_replace(filename, r"(?s)[?#].*", "")
    return F.regexp_replace(F.substring_index(path, "/", -1), BUNDLE_HASH, "$1")


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def custom_components(fingerprint: Column, extend_default: bool = False) -> Column:
    """Trimmed entries of an explicit fingerprint; NULL when there is none or it asks for ours.

    With `extend_default` the caller appends the extras to the computed components instead.
    """
    entries = F.transform(fingerprint, lambda f: trim(f))
    named = F.filter(entries, lambda f: (f != "") & (f != DEFAULT_MARK))
    if extend_default:
        return named
    usable = ~F.array_contains(entries, DEFAULT_MARK) & (F.size(named) > 0)
    return F.when(usable, named)


def innermost(exceptions: Column) -> Column:
    """The last exception that carries anything at all."""
    filled = F.filter(
        exceptions,
        lambda e: (F.coalesce(F.size(e["frames"]), F.lit(0)) > 0)
        | (_text(e["type"]) != "")
        | (_text(e["value"]) != ""),
    )
    return F.try_element_at(filled, F.lit(-1))


def frame_component(frame: Column) -> Column:
    """Where the code is, never the line it is on today."""
    module = F.coalesce(
        blank_to_null(frame["module"]), normal_filename(_text(frame["filename"]))
    )
    function = _text(frame["function"])
    return F.when(
        (module != "") | (function != ""), F.concat(F.lit("frame:"), module, F.lit(":"), function)
    )


def stack_components(exceptions: Column) -> Column:
    inner = innermost(exceptions)
    frames = inner["frames"]
    in_app = F.filter(frames, lambda f: F.coalesce(f["in_app"], F.lit(False)))
    used = F.when(F.size(in_app) > 0, in_app).otherwise(frames)
    located = F.filter(F.transform(used, frame_component), lambda c: c.isNotNull())
    kind = F.filter(F.array(_text(inner["type"])), lambda t: t != "")
    return F.when(
        F.size(located) > 0,
        F.concat(F.transform(kind, lambda t: F.concat(F.lit("type:"), t)), located),
    )


def message_components(message: Column, exceptions: Column) -> Column:
    text = trim(F.coalesce(blank_to_null(message), _text(innermost(exceptions)["value"])))
    return F.when(text != "", F.array(F.concat(F.lit("message:"), parameterize(text))))


def fallback_components(exceptions: Column) -> Column:
    inner = innermost(exceptions)
    return F.when(inner.isNull(), F.array(F.lit("empty"))).otherwise(
        F.array(
            F.concat(F.lit("type:"), _text(inner["type"])),
            F.concat(F.lit("value:"), parameterize(_text(inner["value"]))),
        )
    )


def fingerprint(
    exceptions: Column, message: Column, explicit: Column, extend_default: bool = False
) -> Column:
    """Struct of method and components; the first rule that yields components wins."""
    stack = stack_components(exceptions)
    by_message = message_components(message, exceptions)
    computed = F.coalesce(stack, by_message, fallback_components(exceptions))
    custom = custom_components(explicit)
    if extend_default:
        extras = F.when(
            F.array_contains(F.transform(explicit, lambda f: trim(f)), DEFAULT_MARK),
            custom_components(explicit, extend_default=True),
        )
        computed = F.concat(computed, F.coalesce(extras, F.array().cast("array<string>")))
    method = (
        F.when(custom.isNotNull(), "custom")
        .when(stack.isNotNull(), "stack_trace")
        .when(by_message.isNotNull(), "message")
        .otherwise("fallback")
    )
    return F.struct(method.alias("method"), F.coalesce(custom, computed).alias("components"))


@F.pandas_udf(T.LongType())
def _xxh64_seed0(text: pd.Series) -> pd.Series:
    import xxhash

    digests = [int.from_bytes(xxhash.xxh64_digest(t.encode()), "big", signed=True) for t in text]
    return pd.Series(digests, dtype="int64")


def group_hash(components: Column, exact: bool = False) -> Column:
    """64-bit group identity.

    The JVM hash forms the same groups under other numbers; `exact` gives the numbers of
    XXH64 with seed 0, for tables that must line up with existing group ids.
    """
    joined = F.array_join(components, SEPARATOR)
    return _xxh64_seed0(joined) if exact else F.xxhash64(joined)


def hash_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hash_from_hex(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")
