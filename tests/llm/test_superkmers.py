"""Windows on runs of bytes: words, hashes and comparison against plain Python, and their cost."""

from __future__ import annotations

import inspect
import random
import time
from collections import Counter

import numpy as np
import pytest

from signalfold.llm import superkmers
from signalfold.llm.words import blank_joined, hash_slices, hash_words, spaced_words, sum_runs

K = 35


def lines(strings: list[str]) -> bytes:
    return "".join(f"{s}\n" for s in strings).encode()


def test_words_of_bytes():
    rng = random.Random(3)
    kinds = ["a", "a\0", "\0", "é", "漢字", "\x1c", *["x" * n for n in (7, 8, 9, 16, 17, 63, 64, 65, 200)], "x" * 199 + "y"]
    some = rng.choices(kinds, k=500)
    texts = [None, "", " \n\t", "\x0b " + "\r\n".join(some), " ".join(some), "a　b\x85c  d "]
    words, sizes = blank_joined(t and t.encode() for t in texts)
    flat = [w for t in texts for w in spaced_words(t)]
    assert sizes.tolist() == [len(spaced_words(t)) for t in texts]
    assert [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end, strict=True)] == flat
    hashes = hash_slices(words)
    for width in (1, 4, K):
        runs = [tuple(flat[i : i + width]) for i in range(len(flat) - width + 1)]
        assert len(set(runs)) == len(set(zip(runs, sum_runs(hashes, width).tolist(), strict=True))) == len(set(sum_runs(hashes, width).tolist()))


@pytest.mark.parametrize("hashes", [None, 50, 3])
def test_repeated_windows(monkeypatch, hashes):
    """Also where different windows share a hash."""
    if hashes:
        monkeypatch.setattr(superkmers, "sum_runs", lambda h, k: sum_runs(h, k) % np.uint64(hashes))
    rng = random.Random(4)
    for k in (4, K):
        for _ in range(20):
            strings = [" ".join(rng.choices(["a", "bb", "c\0", "dé"][: rng.randint(1, 4)], k=k + rng.randint(0, 60))) for _ in range(5)]
            strings += rng.choices(strings, k=rng.randint(0, 2))
            windows = [tuple(s.split(" ")[i : i + k]) for s in strings for i in range(s.count(" ") + 2 - k)]
            seen, known = Counter(windows), np.array([rng.random() < 0.1 for _ in windows])
            got = superkmers.repeated_windows(lines(strings), k, known)
            assert got.tolist() == [seen[w] > 1 or b for w, b in zip(windows, known.tolist(), strict=True)]


def test_windows_cost_less_than_python_words():
    """Finding words and dealing or comparing their windows costs less CPU than splitting into Python words and hashing these."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(vocabulary, k=400)) for _ in range(1_000)]
    encoded, joined, known = [t.encode() for t in texts], lines(texts), np.zeros(1_000 * (400 - K + 1), bool)

    def least(work) -> float:
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    plain = least(lambda: hash_words([w for t in texts for w in spaced_words(t)]))
    assert least(lambda: superkmers.superkmers(encoded, K, np.zeros(0, np.uint64))) < plain
    assert least(lambda: superkmers.repeated_windows(joined, K, known)) < plain


def test_busy_minimisers_are_counted_in_all_rows(spark):
    """Also those that no part of the table holds twice; a default run counts the whole table."""
    rng = random.Random(6)
    common, texts = " ".join(rng.choices("abcdefgh", k=60)), []
    for i in range(8):
        texts.append(" ".join([*(f"w{i}x{rng.random()}" for _ in range(50)), common]))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartitionByRange(8, "text")
    counts = Counter(x for t in texts for x in superkmers.superkmers([t.encode()], K, np.zeros(0, np.uint64)).least.tolist())
    want = sorted(x for x, n in counts.items() if n > 5)
    assert want and superkmers._hot_minimisers(docs, K, 5).tolist() == want
    assert inspect.signature(superkmers.remove_repeated_windows).parameters["sample_bytes"].default is None
