"""Benchmark decontamination with DataFrame functions only: broadcast n-grams, scanned windows, verified hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalfold.llm.words import ALNUM_PATTERN, free_name
from signalfold.scale import input_bytes

# A benchmark whose own files are no larger is broadcast (its windows take some tens of times that).
BROADCAST_BYTES = 2 << 20
# Capital letters beyond ASCII and other code points that `lower` changes but the contract does not.
_OTHER_CAPITALS = r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"
# The word pattern for text that is not yet in lower case, with the separators before each word.
_WORD_AND_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; the slow exact form runs only where `lower` would change more."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.rlike(_OTHER_CAPITALS), slow).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """The words of a text in lower case; none for null."""
    separators = ALNUM_PATTERN.replace("[^", "[")
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), separators), "")


def benchmark_windows(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """Distinct (h, window, len, item_id): n consecutive words of an item, or all of a shorter one."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0 and item_id is not null")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1))))
    parts = items.select("item_id", "w", starts.alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(n)).alias("part"))
    return parts.select(
        F.xxhash64("part").alias("h"), F.concat_ws(" ", "part").alias("window"), F.size("part").alias("len"), "item_id"
    ).distinct()


def find_hits(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    n: int = 10, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (array) and spans (array of first word and length).

    All windows of a document are hashed and looked up among the benchmark's; equal hashes are
    verified word for word.  A small benchmark is broadcast; a larger one is joined by shuffle.
    A document without hits sends one short row to the final grouping.  Null and empty texts
    have no words; items without words or id have no windows.  Every row is a document of its
    own, even with a null or repeated id; other columns are ignored.
    """
    windows = benchmark_windows(benchmark, item_col=item_col, n=n)
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most n numbers
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("_w")
    )

    def starts(length: int) -> Column:
        def one(i: Column) -> Column:
            return F.struct(i.alias("pos"), F.lit(length).alias("len"), F.xxhash64(F.slice("_w", i, F.lit(length))).alias("h"))

        places = F.transform(F.sequence(F.lit(1), F.size("_w") - (length - 1)), one)
        return F.when(F.size("_w") >= length, places)

    # The row at place 0 stands for the document itself, so that one without hits is not lost.
    itself = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("h")))
    none = F.array().cast("array<struct<pos:int,len:int,h:bigint>>")
    scanned = rows.select(
        "_row", "doc_id", "_w", F.size("_w").alias("n_words"),
        F.concat(itself, *[F.coalesce(starts(length), none) for length in lengths]).alias("_at"),
    ).select("_row", "doc_id", "n_words", "_w", F.inline_outer("_at"))
    there = windows.select(F.col("h").alias("_h"), "window", "item_id")
    text = F.concat_ws(" ", F.slice("_w", F.col("pos"), F.col("len")))
    if input_bytes(benchmark) <= broadcast_bytes:
        # Both ways round this is equality, but no join key: the text is built for equal hashes only.
        equal = (F.col("h") == F.col("_h")) & F.startswith(F.col("window"), text) & F.startswith(text, F.col("window"))
        found = scanned.join(F.broadcast(there), equal, "left_outer")
    else:
        alone = scanned.select("_row", "doc_id", "n_words", "pos", "len", "h", F.when(F.col("pos") > 0, text).alias("_text"))
        found = alone.join(there, (F.col("h") == F.col("_h")) & (F.col("_text") == F.col("window")), "left_outer")
    found = found.where((F.col("pos") == 0) | F.col("item_id").isNotNull())
    per_doc = found.groupBy("_row", "doc_id", "n_words").agg(
        F.sort_array(F.collect_set(F.when(F.col("pos") > 0, F.struct("pos", "len")))).alias("spans"),
        F.collect_set("item_id").alias("item_ids"),
    )
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))

    def cover(acc: Column, span: Column) -> Column:
        end = span["pos"] + span["len"]
        fresh = F.greatest(F.lit(0), end - F.greatest(acc["end"], span["pos"]))
        return F.struct((acc["hit"] + fresh).alias("hit"), F.greatest(acc["end"], end).alias("end"))

    return per_doc.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("spans", start, cover)["hit"].cast("long").alias("n_hit"), "item_ids", "spans",
    )


def remove_documents(docs: DataFrame, hits: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Documents without hits, all columns; rows whose id is null cannot be named and stay (see `clean_documents`)."""
    name = free_name(docs, "bad")
    bad = hits.where("n_hit > 0 and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(f"`{id_col}`") == F.col(name), "left_anti")


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", n: int = 10, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Documents whose text has no hit, with all their columns, whatever their names.

    The text alone decides, by its SHA-256: equal texts go together, rows with a null id go too,
    and of rows that repeat an id only those with a hit.  Null and empty texts stay; an empty
    table or benchmark removes nothing.
    """
    key = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)
    rows = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    hits = find_hits(rows, benchmark, item_col=item_col, n=n, broadcast_bytes=broadcast_bytes)
    bad = free_name(docs, "bad")
    return docs.join(hits.where("n_hit > 0").select(F.col("doc_id").alias(bad)).distinct(), key == F.col(bad), "left_anti")


def remove_spans(docs: DataFrame, hits: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with all hit words cut out of their text, with the separators before each.

    Ids are taken to be unique; rows with a null id stay as they are.
    """
    name, spans = free_name(docs, "bad"), free_name(docs, "spans")
    bad = hits.where("n_hit > 0 and doc_id is not null").select(F.col("doc_id").alias(name), F.col("spans").alias(spans))
    parts = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"({_WORD_AND_GAP})"), F.lit(1))

    def outside(_: Column, i: Column) -> Column:
        return ~F.exists(spans, lambda s: (i + 1 >= s["pos"]) & (i + 1 < s["pos"] + s["len"]))

    cut = F.concat_ws("", F.filter(parts, outside))
    joined = docs.join(bad, F.col(f"`{id_col}`") == F.col(name), "left_outer")
    text = F.when(F.col(name).isNull(), F.col(f"`{text_col}`")).otherwise(cut)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns of `find_hits`."""
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
