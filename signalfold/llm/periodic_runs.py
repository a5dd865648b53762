"""Periodic runs of words: recursive frequency splitting, then a lag scan of the segments that are left.

A run of period q and length of at least 4q holds each of its words four times or more.  A word that
occurs less often within its segment is therefore in no run of that segment and splits it; the parts
are counted again until nothing changes.  Few words of ordinary prose are left.

The lag scan takes lags in classes (w/2, w] for w = 1, 2, 4, ...  Windows of w words get a number by
doubling.  Inside a run of smallest period q of the class, a window of w words recurs next exactly q
words on (a word sequence that is no power of a shorter one occurs in its own repetition only at
multiples of its length).  So every place is compared at one lag of a class, the distance to the next
equal window, and a run is a stretch of places with the same such distance.  A text of n words takes
n log n steps per class and log n classes, whatever its lags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalfold.llm.words import chunks, spaced_words

LEAST_EXPONENT = 4
LEAST_LENGTH = 6
RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def _renumber(at: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Segment numbers from 0 for ascending places; a gap or another old segment begins a new one."""
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(segment) != 0)
    return np.cumsum(new) - 1


def frequent_segments(codes: np.ndarray, sizes: np.ndarray, exponent: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of every segment in which each word occurs `exponent` times or more.

    `codes` are the words of all texts in turn, `sizes` the words of each text.  Segments never
    cross texts; those shorter than `shortest` are left out.  A round counts only the segments
    that the round before it has split.
    """
    at, segment = np.arange(len(codes)), np.repeat(np.arange(len(sizes)), sizes)
    width = int(codes.max(initial=0)) + 1
    firsts, ends = [], []
    while len(at):
        segment = _renumber(at, segment)
        size = np.bincount(segment)
        long = size[segment] >= shortest
        at, segment = at[long], segment[long]
        if not len(at):
            break
        segment = _renumber(at, segment)
        number = pd.factorize(segment * width + codes[at])[0]
        stays = np.bincount(number)[number] >= exponent
        split = np.bincount(segment, ~stays) > 0
        edge = np.flatnonzero(np.diff(segment, prepend=-1))
        whole = np.flatnonzero(~split)
        firsts.append(at[edge[whole]])
        ends.append(at[edge[whole]] + np.bincount(segment)[whole])
        again = stays & split[segment]
        at, segment = at[again], segment[again]
    first, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, ends))
    order = np.argsort(first)
    return first[order], end[order]


def _laid_out(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all segments in turn, one free slot (-1) after each; the segment of every slot."""
    size = end - first + 1
    segment = np.repeat(np.arange(len(first)), size)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.where(inside < size[segment] - 1, first[segment] + inside, -1), segment


def lag_scan(codes: np.ndarray, first: np.ndarray, end: np.ndarray, exponent: int, shortest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs inside the segments, by start, then period.

    A run is maximal, `period` is its smallest one, and its length is at least `shortest` and
    `exponent` periods.
    """
    place, segment = _laid_out(first, end)
    # Free slots have numbers of their own, so a window over the end of a segment never recurs.
    name = np.where(place >= 0, codes[place], codes.max(initial=0) + 1 + segment)
    found, w = [np.zeros((0, 3), np.int64)], 1
    while len(place):
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        lag = np.zeros(len(name), np.int64)
        lag[order[:-1][same]] = np.diff(order)[same]
        lag[(lag > w) | (2 * lag <= w)] = 0
        begin = np.flatnonzero(np.diff(lag, prepend=0) != 0)
        stretch = np.diff(np.append(begin, len(lag)))
        period = lag[begin]
        length = stretch - 1 + w + period
        good = (period > 0) & (length >= shortest) & (length >= exponent * period)
        found.append(np.column_stack([place[begin[good]], length[good], period[good]]))
        # The next class has lags above w: shorter segments hold no run of it.
        longer = (end - first >= exponent * (w + 1))[segment]
        ahead = np.full(len(name), -1, np.int64)
        ahead[:-w] = name[w:]
        alone = ahead < 0
        top = int(name.max()) + 2
        name = pd.factorize((name * top + ahead + 1)[longer])[0].astype(np.int64)
        alone = alone[longer]
        name[alone] = len(name) + np.arange(int(alone.sum()))
        kept = np.flatnonzero((end - first) >= exponent * (w + 1))
        place, segment = place[longer], np.searchsorted(kept, segment[longer])
        first, end, w = first[kept], end[kept], 2 * w
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(lists: list[list[str]], exponent: int = LEAST_EXPONENT, shortest: int = LEAST_LENGTH) -> list[np.ndarray]:
    """Runs (start, length, period) of every list of words, numbered from the first word of the list."""
    sizes = np.array([len(ws) for ws in lists], np.int64)
    words = [w for ws in lists for w in ws]
    if not words:
        return [np.zeros((0, 3), np.int64)] * len(lists)
    codes = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    first, end = frequent_segments(codes, sizes, exponent, shortest)
    runs = lag_scan(codes, first, end, exponent, shortest)
    begins = np.cumsum(sizes) - sizes
    of = np.searchsorted(begins + sizes, runs[:, 0], side="right")
    runs[:, 0] -= begins[of]
    return np.split(runs, np.cumsum(np.bincount(of, minlength=len(lists)))[:-1])


def collapse(words: list[str], runs: np.ndarray) -> list[str]:
    """The words without those that any run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", exponent: int = LEAST_EXPONENT,
    shortest: int = LEAST_LENGTH, read_words: Callable[[object, str | None], list[str]] | None = None,
) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period, by start, then period) and collapsed_text.

    A run is a stretch of consecutive words with smallest period q, `shortest` words and `exponent`
    periods or more, which no neighbouring word extends; runs may overlap.  `collapsed_text` is
    the words that no run holds after its first q words, joined by one blank.  `read_words(id, text)`
    may give the words of a row; else they are the parts between ASCII white space.

    Null, empty and blank texts have no words, no runs and an empty collapsed text.  Every row is
    a document of its own, with a null or repeated id too; other columns are ignored, whatever
    their names; an empty table gives no rows.  No shuffle: a worker holds an Arrow batch and the
    words of some texts (of one, if it is long) at a time.
    """
    read = read_words or (lambda _, text: spaced_words(text))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", RUN), T.StructField("collapsed_text", T.StringType()),
    ])
    item = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, texts in chunks(batch.column(1).to_pylist(), 2_000_000):
                lists = [read(i, t) for i, t in zip(ids[first:end], texts, strict=True)]
                found = find_runs(lists, exponent, shortest)
                runs = np.concatenate(found)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])])
                items = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], fields=list(item))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first),
                    pa.array([len(ws) for ws in lists], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items),
                    pa.array([" ".join(collapse(ws, r)) for ws, r in zip(lists, found, strict=True)], pa.string()),
                ], names=["doc_id", "n_words", "runs", "collapsed_text"])

    return rows.mapInArrow(run, schema)


def run_digest(found: DataFrame) -> DataFrame:
    """Per row of `periodic_runs`: number of runs, the greatest one, and hashes of all runs and of the collapsed text.

    Of runs of the greatest length the one with the least start, then period, counts; a row
    without runs has nulls there.
    """
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    best = found.withColumn("top", top)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"), "n_words",
    )


def planted_words(doc_id: int | None, text: str | None) -> list[str]:
    """Words of a text; one document of ten, by the checksum of its id, has its end made periodic."""
    import zlib

    words = spaced_words(text)
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]
