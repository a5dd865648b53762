"""Words of a text as small integers, and hashes of word sequences, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The two word definitions of the query contracts, and A-Z to a-z.
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight
_LONG = 64  # bytes of a word that are hashed eight at a time


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def spaced_words(text: str | None) -> list[str]:
    return SPACED.findall(text) if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _MUL
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(words: Sequence[str]) -> np.ndarray:
    """A 64-bit hash of every word, the same in every process; each distinct word is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return mix(pd.util.hash_array(distinct, categorize=False))[codes]


def hash_runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive entries, by doubling: log k passes over the array."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    done, length, power, width = None, 0, h, 1
    while True:
        if k & width:
            if done is None:
                done = power
            else:
                n = len(power) - length
                done = mix(done[:n] * _MIX + power[length : length + n])
            length += width
        if length == k:
            return mix(done[: len(h) - k + 1] + np.uint64(k))
        power = mix(power[:-width] * _MIX + power[width:])
        width *= 2


def least_in_runs(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every run of k consecutive entries."""
    width, least = 1, h
    while width * 2 <= k:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(h) - k + 1
    return np.minimum(least[:n], least[k - width : k - width + n])


@dataclass
class Slices:
    """Words in one run of bytes, each with one more byte behind it; eight bytes follow the last."""

    data: np.ndarray
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # the byte behind it


def blank_joined(texts: Iterable[bytes | None]) -> tuple[Slices, np.ndarray]:
    """The words `SPACED` of UTF-8 texts, each followed by one blank, and the number of words of each text."""
    held = [t or b"" for t in texts]
    raw = np.frombuffer(b"\n".join([*held, b""]), np.uint8)
    blank = (raw == 32) | (raw - np.uint8(9) <= 4)
    last = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    stays = ~blank
    stays[last] = True
    data = np.concatenate([raw[stays], np.zeros(8, np.uint8)])
    end = np.flatnonzero(blank[stays])
    data[end] = 32
    bounds = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
    sizes = np.diff(np.searchsorted(last, bounds, side="right"), prepend=0)
    return Slices(data, np.concatenate([[0], end + 1])[:-1], end), sizes


def hash_slices(words: Slices) -> np.ndarray:
    """A 64-bit hash of every word, the same in every process, from eight bytes of all words at a time."""
    eights = np.ndarray(len(words.data) - 7, "<u8", words.data, strides=(1,))
    size = words.end - words.start
    h = mix((eights[words.start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _MIX)
    at, more = 8, np.flatnonzero(size > 8)
    while len(more) and at < _LONG:
        part = eights[words.start[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]
        h[more] = mix(h[more] * _MIX + part)
        at, more = at + 8, more[size[more] > at + 8]
    for i in more.tolist():
        h[i] = int.from_bytes(blake2b(words.data[words.start[i] : words.end[i]], digest_size=8).digest(), "little")
    return h


def sum_runs(h: np.ndarray, k: int) -> np.ndarray:
    """Like `hash_runs` for entries that are hashes: a polynomial, whose bits are not spread again."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    done, length, power, width, factor = None, 0, h, 1, int(_MIX)
    while True:
        if k & width:
            if done is None:
                done = power
            else:
                n = len(power) - length
                done = done[:n] * np.uint64(factor)
                done += power[length:]
            length += width
        if length == k:
            return done[: len(h) - k + 1]
        longer = power[:-width] * np.uint64(factor)
        longer += power[width:]
        power, width, factor = longer, width * 2, factor * factor % (1 << 64)


def spans(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each text in the joined word array, and which starts of k words stay in one text."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    total = int(starts[-1])
    inside = np.ones(max(total - k + 1, 0), bool)
    for e in starts[1:]:
        inside[max(int(e) - k + 1, 0) : int(e)] = False
    return starts, inside


def chunks[T: (str, bytes)](texts: Iterable[T | None], chars: int = 4_000_000) -> Iterator[tuple[int, int, list[T]]]:
    """Consecutive texts of about `chars` characters or bytes together, as (first, end, texts); none is cut."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= chars:
            yield first, i + 1, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, first + len(held), held
