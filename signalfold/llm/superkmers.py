"""Removal of repeated word windows by super-k-mer partitioning.

A window is k consecutive words.  Its minimiser is the least hash among its m-word runs.
Consecutive windows of a document with one minimiser travel together as one packed string to
the minimiser's bucket, where equal windows meet whatever document they come from and sorting
counts them.  Documents are handled in blocks of bounded size; a block sends each distinct
packed string once, however many of its documents hold it, and gets back one bit per window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalfold.llm.words import Slices, blank_joined, chunks, hash_slices, least_in_runs, mix, sum_runs

BLOCK_BYTES = 6 << 20  # text of a block
BUCKET_BYTES = 4 << 20  # text whose windows share a bucket, about a third of the bucket's size
HOT = 5_000  # packed strings of one minimiser from which its windows are dealt by a second one too
M = 4


@dataclass
class Packed:
    """The super-k-mers of some texts."""

    words: Slices
    sizes: np.ndarray  # words of each text
    first: np.ndarray  # first word of each super-k-mer
    count: np.ndarray  # its windows
    key: np.ndarray  # hash that names its bucket
    least: np.ndarray  # its minimiser


def superkmers(texts: list[bytes | None], k: int, hot: np.ndarray) -> Packed:
    words, sizes = blank_joined(texts)
    at = inside(sizes, k)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Packed(words, sizes, none, none, none.astype(np.uint64), none.astype(np.uint64))
    grams = mix(sum_runs(hash_slices(words), M))
    least = least_in_runs(grams, k - M + 1)[at]
    key = least
    if len(hot):
        in_hot = np.isin(least, hot)
        if in_hot.any():
            second = least_in_runs(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), k - M + 1)[at]
            key = np.where(in_hot, mix(least + second), least)
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    return Packed(words, sizes, at[begin], np.diff(np.append(begin, len(at))), key[begin], least[begin])


def inside(sizes: np.ndarray, k: int) -> np.ndarray:
    """First words of the windows of k words that stay in one text."""
    windows = np.maximum(sizes - k + 1, 0)
    return ranges(np.cumsum(sizes) - sizes, windows)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every range in turn, `count` of each."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


@dataclass
class Strings:
    """The distinct packed strings of some super-k-mers, by bucket and then in order of appearance."""

    text: list[bytes]
    bucket: np.ndarray  # in which each string is counted
    windows: np.ndarray  # of each string
    times: np.ndarray  # super-k-mers that have this string
    number: np.ndarray  # the string of each super-k-mer

    def buckets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets with strings, and where the strings of each begin and end."""
        to, begin = np.unique(self.bucket, return_index=True)
        return to, begin, np.append(begin, len(self.bucket))[1:]


def distinct_strings(p: Packed, k: int, buckets: int) -> Strings:
    """Equal strings have equal minimisers, so each has one bucket."""
    text, held = p.words.data.tobytes(), {}
    begins, ends = p.words.start[p.first].tolist(), p.words.end[p.first + p.count + k - 2].tolist()
    seen = np.array([held.setdefault(text[a:b], len(held)) for a, b in zip(begins, ends, strict=True)], np.int64)
    _, at, times = np.unique(seen, return_index=True, return_counts=True)
    bucket = (mix(p.key[at] + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    strings = list(held)
    return Strings([strings[i] for i in order.tolist()], bucket[order], p.count[at][order], times[order], place[seen])


def _hot_minimisers(docs: DataFrame, k: int, hot: int, share: float = 1.0) -> np.ndarray:
    """Minimisers of more than `hot` super-k-mers, counted over all rows.

    What comes back is at most one number per `hot` super-k-mers.  With a `share` below 1 only about that
    share of the rows is counted; then a minimiser that it misses has a larger bucket.
    """
    if share < 1:
        docs = docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in chunks(batch.column(0).cast(pa.binary()).to_pylist()):
                values, times = np.unique(superkmers(texts, k, np.zeros(0, np.uint64)).least, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times)], names=["least", "n"])

    counted = docs.mapInArrow(count, "least long, n long").groupBy("least").agg(F.sum("n").alias("n"))
    found = [r["least"] for r in counted.where(F.col("n") > hot * min(share, 1.0)).select("least").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _block_rows(table: pa.Table) -> tuple[list, list]:
    """Rows of a block in an order that does not depend on how they arrived; texts as UTF-8."""
    columns = table.column("id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
    rows = sorted(zip(*columns, strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1] or b""))
    return [r[0] for r in rows], [r[1] for r in rows]


def repeated_windows(strings: bytes, k: int, known: np.ndarray) -> np.ndarray:
    """For the windows of all strings in turn: True if another one has the same words.

    Every string is a line of at least k words with one blank between them.  `known` marks windows
    that are repeated already.  Every window is compared with the one before it of the same hash;
    neighbours whose earlier windows are neighbours too are compared as one stretch of bytes.
    """
    data = np.frombuffer(strings + bytes(8), np.uint8)
    end = np.flatnonzero((data == 32) | (data == 10))
    words = Slices(data, np.concatenate([[0], end + 1])[:-1], end)
    at = inside(np.diff(np.flatnonzero(data[end] == 10), prepend=-1), k)
    runs = sum_runs(hash_slices(words), k)[at]
    order = np.argsort(runs)
    equal = runs[order][1:] == runs[order][:-1]
    group = np.cumsum(np.concatenate([[True], ~equal]))
    shared = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    group, member = np.divmod(np.sort(group[shared] * len(runs) + order[shared]), len(runs))
    out = known.copy()
    out[member] = True
    pair = np.flatnonzero(group[1:] == group[:-1])
    pair = pair[np.argsort(member[pair + 1])]
    before, after = at[member[pair]], at[member[pair + 1]]
    new = np.ones(len(pair), bool)
    new[1:] = (before[1:] != before[:-1] + 1) | (after[1:] != after[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(pair))) + k - 2
    bounds = [x.tolist() for place in (before[begin], after[begin]) for x in (words.start[place], words.end[place + length])]
    differs = [strings[a:b] != strings[c:d] for a, b, c, d in zip(*bounds, strict=True)]
    if any(differs):  # different windows with one hash: compare all of that hash
        unlike = pair[np.repeat(differs, length - k + 2)]
        clash = member[np.isin(group, group[unlike])]
        same: dict[bytes, list[int]] = {}
        for i, a, b in zip(clash.tolist(), words.start[at[clash]].tolist(), words.end[at[clash] + k - 1].tolist(), strict=True):
            same.setdefault(strings[a:b], []).append(i)
        out[clash] = known[clash]
        for members in same.values():
            if len(members) > 1:
                out[members] = True
    return out


def _joined(words: Slices, sizes: np.ndarray, stays: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of each text the number of words that stay, and these joined by one blank."""
    before = np.concatenate([[0], np.cumsum(stays)])
    ends = np.cumsum(sizes)
    n = before[ends] - before[ends - sizes]
    last = np.flatnonzero(stays)[before[ends[n > 0]] - 1]
    length = np.where(stays, words.end - words.start + 1, 0)
    byte = np.repeat(stays, words.end - words.start + 1)
    byte[words.end[last]] = False
    length[last] -= 1
    offsets = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], ends])]
    data = words.data[: len(byte)][byte]
    return n, pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def remove_repeated_windows(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 35, block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, sample_bytes: int | None = None,
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept_text (kept words joined by one blank).

    Words in a window of k words that starts at two or more places of the table are removed,
    all copies alike; windows are judged on the input.  Null and empty texts have no words, and
    texts of fewer than k words lose none.  Busy minimisers are counted in all texts, or in about `sample_bytes`
    of them if that is given; no result depends on it.  Rows with a null or repeated id are documents of their own,
    other columns are ignored, an empty table gives no rows.
    """
    size = docs.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    blocks, buckets = size // block_bytes + 1, size // bucket_bytes + 1
    rare = _hot_minimisers(docs.select(F.col(text_col).alias("text")), k, hot, sample_bytes / max(size, 1) if sample_bytes else 1.0)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Rows are dealt by their number, so that equal ones cannot fill a block; a lost task numbers them alike.
    rows = base.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"), "id", "text")
    dealt = rows.repartition("block")

    def send(table: pa.Table) -> pa.Table:
        _, texts = _block_rows(table)
        block = table.column("block")[0].as_py()
        held = distinct_strings(superkmers(texts, k, rare), k, buckets)
        squeeze = zstandard.ZstdCompressor(level=3)
        out = []
        for to, a, b in zip(*[x.tolist() for x in held.buckets()], strict=True):
            marks = np.packbits(held.times[a:b] > 1).tobytes()
            out.append((to, block, b - a, squeeze.compress(b"\n".join(held.text[a:b])), marks))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "block", "n", "strings", "marks"])

    def count(table: pa.Table) -> pa.Table:
        unpack, strings, marks, sizes = zstandard.ZstdDecompressor(), [], [], []
        for n, packed, bits in zip(*[table.column(c).to_pylist() for c in ("n", "strings", "marks")], strict=True):
            some = unpack.decompress(packed)
            windows = np.array([s.count(b" ") + 2 - k for s in some.split(b"\n")], np.int64)
            strings.append(some)
            marks.append(np.repeat(np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool), windows))
            sizes.append(int(windows.sum()))
        flags = np.split(repeated_windows(b"\n".join([*strings, b""]), k, np.concatenate(marks)), np.cumsum(sizes)[:-1])
        bits = [zlib.compress(np.packbits(f).tobytes(), 1) if f.any() else None for f in flags]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = _block_rows(left)
        p = superkmers(texts, k, rare)
        held = distinct_strings(p, k, buckets)
        replies = dict(zip(right.column("bucket").to_pylist(), right.column("bits").to_pylist(), strict=True))
        ends = np.cumsum(held.windows)
        begins = ends - held.windows
        hit = np.zeros(held.windows.sum(), bool)
        for to, a, b in zip(*[x.tolist() for x in held.buckets()], strict=True):
            if replies.get(to) is not None:
                bits = np.frombuffer(zlib.decompress(replies[to]), np.uint8)
                hit[begins[a] : ends[b - 1]] = np.unpackbits(bits, count=int(ends[b - 1] - begins[a]))
        lost = ranges(p.first, p.count)[hit[ranges(begins[held.number], p.count)]]
        edge = np.zeros(len(p.words.end) + 1, np.int8)
        edge[lost] += 1
        edge[lost + k] -= 1
        stays = np.cumsum(edge[:-1], dtype=np.int64) == 0
        n_kept, kept = _joined(p.words, p.sizes, stays)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(p.sizes), "n_removed": pa.array(p.sizes - n_kept), "kept_text": kept})

    sent = dealt.groupBy("block").applyInArrow(send, "bucket long, block long, n long, strings binary, marks binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "block long, bucket long, bits binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        keep, "doc_id long, n_words long, n_removed long, kept_text string"
    )
