"""Periodic runs against brute force, and odd tables."""

import hashlib
import random
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from signalfold.llm import periodic_runs as pr


def brute(x, exponent=4, shortest=6):
    out = []
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i + q < len(x):
            begin = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            size = i + q - begin
            part = x[begin : begin + size]
            if size >= max(shortest, exponent * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((begin, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


parts = st.one_of(
    st.lists(st.sampled_from("abcdef"), max_size=6),
    st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 70)).map(lambda x: (x[0] * 80)[: x[1]]),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(parts, max_size=6).map(lambda x: sum(x, [])), max_size=5))
def test_runs_equal_brute_force(lists):
    assert [list(map(tuple, r.tolist())) for r in pr.find_runs(lists)] == [brute(x) for x in lists]


def test_long_texts():
    rng = random.Random(1)
    words = rng.choices([f"w{i}" for i in range(50)], k=400_000)
    once = rng.choices([f"w{i}" for i in range(9000)], k=60_000)
    found = pr.find_runs([words, once * 5, ["x"] * 300_000, ["a"] + once[:7] * 6])
    assert [list(map(tuple, r.tolist())) for r in found[1:]] == [[(0, 300_000, 60_000)], [(0, 300_000, 1)], [(1, 42, 7)]]
    assert all(length >= max(6, 4 * q) for _, length, q in found[0].tolist())


def test_query_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("ab cd efg h".split(), k=rng.randint(0, 60))) for _ in range(60)]
    texts += ["", None, " \n\t", "x", "x " * 6, "x " * 5, "a　b " * 9, "p q " * 500 + "end", "é\nÉ\n" * 4]
    rows = [(i, t, "r", 1, 2) for i, t in enumerate(texts)] + [(None, "y " * 9, "r", 1, 2), (3, texts[3], "r", 1, 2)]
    schema = "doc_id long, text string, runs string, n_words long, start long"
    want = Counter()
    for doc_id, text, *_ in rows:
        words = (text or "").replace("\n", " ").replace("\t", " ").split(" ")
        words = [w for w in words if w]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        want[
            doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(), n,
        ] += 1
    docs = spark.createDataFrame(rows, schema).repartition(3)
    found = pr.run_digest(pr.periodic_runs(docs, read_words=pr.planted_words))
    assert Counter(map(tuple, found.collect())) == want
    assert sum(n for k, n in want.items() if k[1]) >= 8
    assert pr.periodic_runs(spark.createDataFrame([], schema)).count() == 0
