"""Raw stack text of V8, SpiderMonkey and JavaScriptCore as frame structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalfold.functions.enrich import is_in_app
from signalfold.functions.text import let

MAX_FRAMES = 50
# The two line formats and the path parts of third-party code in raw stacks.
V8_LINE = r"^\s*at (?:(.+?)\s+\()?(?:(.+?):(\d+):(\d+)|([^)]+))\)?\s*$"
GECKO_LINE = r"^\s*(?:(.*?)@)?(.+?):(\d+):(\d+)\s*$"
STACK_VENDOR_MARKERS = (
    "node_modules/",
    "webpack-internal:",
    "webpack/bootstrap",
    "/deps/",
    ".pnpm/",
    "node:internal/",
)


def _frame(line: Column) -> Column:
    v8 = line.rlike(V8_LINE)

    def part(v8_group: int, gecko_group: int) -> Column:
        return F.when(v8, F.regexp_extract(line, V8_LINE, v8_group)).otherwise(
            F.regexp_extract(line, GECKO_LINE, gecko_group)
        )

    def build(file: Column) -> Column:
        function = part(1, 1)
        return F.struct(
            F.when(function == "", "<anonymous>").otherwise(function).alias("function"),
            file.alias("filename"),
            part(3, 3).try_cast("int").alias("lineno"),
            part(4, 4).try_cast("int").alias("colno"),
            ((file != "") & is_in_app(file, STACK_VENDOR_MARKERS)).alias("in_app"),
        )

    # A V8 line without a position carries its location in the last group.
    bare = F.when(v8, F.regexp_extract(line, V8_LINE, 5)).otherwise("")
    located = part(2, 2)
    return let(F.when(located != "", located).otherwise(bare), build)


def parse_stack(stack: Column, sdk_pattern: str | None = None) -> Column:
    """Frames outermost first, 50 innermost at most; `sdk_pattern` drops the SDK's own files."""
    lines = F.filter(
        F.split(F.coalesce(stack, F.lit("")), "\n", -1),
        lambda line: line.rlike(V8_LINE) | line.rlike(GECKO_LINE),
    )
    frames = F.transform(lines, _frame)
    if sdk_pattern:
        frames = F.filter(frames, lambda f: ~f["filename"].rlike(sdk_pattern))
    return F.reverse(F.slice(frames, 1, MAX_FRAMES))
