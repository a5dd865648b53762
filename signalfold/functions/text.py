"""Text helpers with one meaning of whitespace and word edge on every JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as characters and as a regex class.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
SPACE_CLASS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# The same without the blank.
ODD_SPACE_CLASS = SPACE_CLASS.replace("\\r ", "\\r")

# Java's \b follows Unicode letters on some JDKs; \w is ASCII on all of them.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
WORD_START = r"(?<!\w)"
WORD_END = r"(?!\w)"


def trim(text: Column) -> Column:
    """Strip Unicode white space at both ends (Spark's own `trim` strips blanks only)."""
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one blank."""
    # Single blanks are by far the most frequent and need no replacement.
    blanks = F.regexp_replace(text, ODD_SPACE_CLASS, " ")
    return trim(F.regexp_replace(blanks, " {2,}", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times."""
    return F.transform(F.array(value), body)[0]


def replace_with_probe(text: Column, probe: str, pattern: str, replacement: str) -> Column:
    """Regex replacement that first looks for a plain substring every match must contain."""
    return let(
        text,
        lambda t: F.when(t.contains(probe), F.regexp_replace(t, pattern, replacement)).otherwise(t),
    )


def first_token(text: Column, tokens: Sequence[tuple[str, str]]) -> Column:
    """Name of the first listed token that occurs in the text, else ''."""
    found = F.lit("")
    for token, name in reversed(tokens):
        found = F.when(text.contains(token), name).otherwise(found)
    return found


def clip_bytes(text: Column, limit: int) -> Column:
    """Trimmed text of at most `limit` bytes; longer text keeps whole characters and gets an ellipsis."""

    def clip(t: Column) -> Column:
        cut = F.substring(t.cast("binary"), 1, limit - 1).cast("string")
        whole = F.regexp_replace(F.make_valid_utf8(cut), "\ufffd+\\z", "")
        return F.when(F.octet_length(t) <= limit, t).otherwise(F.concat(whole, F.lit("\u2026")))

    return let(trim(text), clip)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
