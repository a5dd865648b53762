"""Operators of the subpackage against brute force on small tables with nulls, ties and odd texts."""

import bisect
import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalfold.llm import cotrain, decontaminate, langid, licenses, line_templates, packing, quality_trees
from signalfold.llm import superkmers, token_files, tsearch
from signalfold.llm.bpe import Encoder
from signalfold.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, block long, component string, n long"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    rng = random.Random(5)
    make = lambda n: " ".join("".join(rng.choices("abcdeéÄ", k=rng.randint(1, 5))) for _ in range(n))
    passage, base = make(60), make(120)
    texts = [make(rng.randint(1, 90)) for _ in range(20)]
    texts += [f"{make(10)} {passage}\n{make(12)}" for _ in range(4)] + [base] * 3
    for _ in range(6):
        words = base.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += ["", None, " \n\t", "x", "One TWO three", make(20000), "\x1c a　b  c \n\n d", make(40) + " 漢字 <|endoftext|>"]
    ids = [*range(len(texts) - 2), None, 7]  # a null and a repeated id
    return [(i, t, "en", "s", len(t or ""), "p", 1, "c", 2) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_windows(docs, empty):
    got = Counter(tuple(r) for r in superkmers.remove_repeated_windows(docs, block_bytes=4000, bucket_bytes=2000, hot=3).collect())
    lists = [(r[0], SPACED.findall(r[1] or "")) for r in rows()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in lists for i in range(len(w) - 34))
    want = Counter()
    for doc_id, w in lists:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    assert got == want
    assert any(k[2] for k in want)
    sampled = superkmers.remove_repeated_windows(docs, block_bytes=4000, bucket_bytes=2000, hot=3, sample_bytes=20_000)
    assert Counter(tuple(r) for r in sampled.collect()) == want
    assert superkmers.remove_repeated_windows(empty).count() == 0


def test_near_duplicates(docs, empty):
    got = Counter(tuple(r) for r in tsearch.near_duplicates(docs, block_bytes=3000).collect())
    sets, want = {}, Counter()
    for doc_id, text, *_ in rows():
        w = SPACED.findall((text or "").translate(LOWER))
        s = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))}
        sets.setdefault(doc_id, []).append(s)
    flat = [(i, s) for i, ss in sets.items() if i is not None for s in ss]
    comp = {i: i for i, _ in flat}
    for _ in range(len(comp)):
        for (a, x), (b, y) in itertools.combinations(flat, 2):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                comp[a] = comp[b] = min(comp[a], comp[b])
    for i, ss in sets.items():
        for s in ss:
            want[i, len(s), comp.get(i)] += 1
    # The repeated id 7 has two texts; only its place in a component is compared.
    assert {k: v for k, v in got.items() if k[0] != 7} == {k: v for k, v in want.items() if k[0] != 7}
    assert tsearch.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_of_large_groups(spark, seed):
    """Groups whose members are on both sides of the threshold, some sharing their changes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for size, n in ((150, 160), (90, 60), (40, 300)):
        base = [word() for _ in range(n)]
        fixes = [(rng.randrange(n), word()) for _ in range(12)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, n // 25)):
                words[rng.randrange(n)] = word()
            for at, new in rng.sample(fixes, rng.randint(0, 3)):
                words[at] = new
            texts.append(" ".join(words[: n - rng.randint(0, n // 10)]))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in zip(ids, texts, strict=True) for w in [t.split(" ")]}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in tsearch.near_duplicates(docs, block_bytes=20_000).collect()}
    assert got == {i: root(i) for i in sets}
    assert 20 < len(set(got.values())) < len(got) - 20  # the fixture has both cases


def test_shingles_take_little_memory():
    """No word becomes an object: 8 MB of short words take a few times their bytes."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 100_000, 500).tolist())) for _ in range(2800)]

    class Rows:
        def mapInArrow(self, run, schema):
            return run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])]))

    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in tsearch._signatures(Rows(), 5))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == len(texts)
    assert peak < 100_000_000


def test_common_lists_of_a_pair_are_summed(spark):
    """Pairs on 6 lists of several lengths, each of over 600 members; the members besides are of one component."""
    rows, other = [], 1000
    for token, size in enumerate((650, 700, 1250, 1300, 1900, 2000)):
        rows += [(i, 100, 100, i, None, token) for i in range(20)]
        rows += [(other + i, 100, 100, 999, None, token) for i in range(size)]
        other += size
    columns = "doc_id long, n long, s long, component long, ref long, token long"
    postings = spark.createDataFrame(rows, columns)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would meet in one task
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = sorted(map(tuple, tsearch._candidates(postings, full=True).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == list(itertools.combinations(range(20), 2))


def test_common_lists_of_a_pair_with_two_refs_are_summed(spark):
    """Each of the two is the query on 3 of the lists, since most of a list have the ref of the other one."""
    rows, other = [], 1000
    for token in range(6):
        rows += [(i, 100, 100, i, i + 50, token) for i in range(2)]
        rows += [(other + i, 100, 100, 999, 50 + token % 2, token) for i in range(10)]
        other += 10
    columns = "doc_id long, n long, s long, component long, ref long, token long"
    got = tsearch._candidates(spark.createDataFrame(rows, columns), full=True)
    assert list(map(tuple, got.collect())) == [(0, 1)]


def test_merge_and_probe():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lists = [sorted(rng.choice(30, rng.integers(0, 9), replace=False).tolist()) for _ in range(6)]
        times = Counter(x for one in lists for x in one)
        assert dict(tsearch.merge_short(lists, 2)) == {k: v for k, v in times.items() if v >= 2}
        a, b = (np.unique(rng.integers(0, 400, 300)) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert tsearch.probe_long(a, b, both) and not tsearch.probe_long(a, b, both + 1)


def test_decontamination(spark, docs, empty):
    texts = [r[1] for r in rows()]
    items = [(1, texts[21]), (2, "one two THREE"), (3, None), (4, "--"), (None, texts[3]), (5, " ".join((texts[36] or "").split(" ")[50:75]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(len(w) - 9, 1 if w else 0)):
            if item is not None:
                grams.setdefault(tuple(w[i : i + 10]), set()).add(item)
    want = Counter()
    for doc_id, text, *_ in rows():
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for g, ids in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want[doc_id, len(w), len(hit), len(found), sha, bool(hit)] += 1
    for limit in (1 << 20, 0):
        hits = decontaminate.find_hits(docs, bench, broadcast_bytes=limit)
        assert Counter(tuple(r) for r in decontaminate.digest(hits).collect()) == want
    unique = docs.where("doc_id is not null and doc_id <> 7")
    cut = decontaminate.remove_spans(unique, decontaminate.find_hits(unique, bench))
    assert cut.columns == docs.columns and cut.count() == unique.count()
    assert decontaminate.find_hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_hits(empty, bench).count() == 0
    named = docs.withColumnsRenamed({"lang": "bad", "source": "spans", "part": "_bad"})
    bad = {r[1] or "" for r in rows() for g in grams for w in [ALNUM.findall((r[1] or "").translate(LOWER))] for i in range(len(w) - len(g) + 1) if tuple(w[i : i + len(g)]) == g}
    left = decontaminate.clean_documents(named, bench)
    assert left.columns == named.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter((r[0], r[1]) for r in rows() if (r[1] or "") not in bad)
    assert decontaminate.remove_documents(named, decontaminate.find_hits(named, bench)).count() < len(rows())
    assert decontaminate.clean_documents(empty, bench).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sÉ1!　\x1c\x85\0漢", max_size=12), max_size=6))
def test_pieces_have_the_ids_of_whole_texts(texts):
    bpe = _encoder()
    assert bpe.encode(texts) == [np.array(bpe._ids([t])[0], "<u4").tobytes() for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n'sdLl.,_#~`[éÉßªµÿɏɐ×÷aZ1", max_size=16), max_size=6))
def test_words_have_the_ids_of_whole_texts(texts):
    from tokenizers import Tokenizer

    whole = _whole.get(0) or _whole.setdefault(0, Tokenizer.from_file(tokenizer_path()))
    assert _encoder().encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_new_words_skip_the_splitter():
    """Words of letters go to the model; only their punctuation, once each, and other pieces pass the whole tokenizer."""
    bpe, passed = Encoder(tokenizer_path()), []
    plain = bpe._ids
    bpe._ids = lambda texts: passed.extend(texts) or plain(texts)
    words = [a + b + c for a in "abcdefgh" for b in "éouxyz" for c in "mnpqrst"]
    text = "\n".join(" ".join(f"{w}{m}" for w in words[i : i + 8]) for i, m in zip(range(0, len(words), 8), [".", ",", "", "!!"] * 11, strict=False))
    assert bpe.encode([text, text]) == [np.array(plain([text])[0], "<u4").tobytes()] * 2
    assert len(passed) <= 5


def test_distinct_pieces_of_a_block_are_looked_up_once():
    bpe, asked = Encoder(tokenizer_path()), []
    find = bpe._find
    bpe._find = lambda pieces: asked.append(pieces.to_pylist()) or find(pieces)
    texts = ["one two, two.\none", None, "", "one  two,\ttwo.", "two. one"] * 50
    want = [np.array(bpe._ids([t or ""])[0], "<u4").tobytes() for t in texts]
    assert bpe.encode(texts) == want == bpe.encode(texts)
    assert len(asked) == 2 and all(len(a) == len(set(a)) <= 12 for a in asked)
    assert len(bpe._known) == len(set(asked[0]))


def test_pieces_of_equal_hash_have_their_own_ids(monkeypatch):
    from signalfold.llm import bpe

    monkeypatch.setattr(bpe, "_hashes", lambda pieces: np.array([len(p) % 2 for p in pieces.to_pylist()], np.uint64))
    one = Encoder(tokenizer_path(), limit=12)
    for texts in (["the dog, the house."], ["house. dog, at home", "the\ndog"], ["a dog,  a house.", "dogs dogs"] * 2):
        assert one.encode(texts) == [np.array(one._ids([t])[0], "<u4").tobytes() for t in texts]
        assert len(one._known) == len(one._known_ids) <= 12 and len(one._hash) == len(one._place) <= 2


def test_long_pieces_are_not_remembered():
    bpe = Encoder(tokenizer_path())
    texts = ["one two\u200b " * 100, "x" * 300 + " one, two", "one,"]
    assert bpe.encode(texts) == [np.array(bpe._ids([t])[0], "<u4").tobytes() for t in texts] == bpe.encode(texts)
    assert sorted(bpe._known.to_pylist()) == ["\0one,", "one,", "two"]


def test_text_blocks():
    from signalfold.llm.bpe import text_blocks

    texts = ["ab", None, "", "é" * 3, "x" * 50, "y", None, "zz"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    got = [b.column("text").to_pylist() for b in text_blocks(batch, most=8)]
    assert got == [["ab", None, "", "ééé"], ["x" * 50], ["y", None, "zz"]]
    assert [x for b in text_blocks(batch, most=1) for x in b.column("doc_id").to_pylist()] == [*range(8)]
    assert list(text_blocks(batch.slice(0, 0))) == []


_whole = {}


def _encoder(made=[]):  # noqa: B006
    if not made:
        made.append(Encoder(tokenizer_path(), limit=40))
    return made[0]


def _ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows()]


def test_token_files(spark, docs, empty, tmp_path):
    token_files.write_token_files(docs, str(tmp_path / "t"), tokenizer_path())
    got = sorted((tuple(r) for r in token_files.read_token_digest(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in _ids()), key=lambda i: (i is not None, i))
    assert got[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in itertools.pairwise(got))
    digests = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in _ids())
    assert Counter((r[0], r[2], r[3]) for r in got) == digests
    token_files.write_token_files(empty, str(tmp_path / "e"), tokenizer_path())
    assert token_files.read_token_digest(spark, str(tmp_path / "e")).count() == 0


def test_packing(docs, empty):
    got = packing.pack_documents(docs, tokenizer_path(), capacity=64).collect()
    want = Counter()
    for i, ids in _ids():
        start, length = 0, len(ids) % 64 or 64
        for piece in range(-(-len(ids) // 64)):
            want[i, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
            start, length = start + length, 64
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        assert all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(sorted(places))) and sum(p[1] for p in places) <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_pack(sizes):
    place, offset = packing.pack(sizes, 20)
    for b in set(place):
        mine = sorted((offset[i], sizes[i]) for i in range(len(sizes)) if place[i] == b)
        assert mine[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in itertools.pairwise(mine)) and sum(s for _, s in mine) <= 20


def test_languages(spark, docs, empty):
    training = spark.createDataFrame(
        [(i, t, x) for i in range(30) for t, x in (("the house of the dog and with them", "en"), ("das haus und der hund mit ihnen", "de"), ("дом и собака", "ru"))],
        "doc_id long, text string, lang string",
    )
    model = langid.learn(training)
    assert [s[0] for s in langid.language_spans(model, "the dog of the house and the house with them und das haus mit der und das der hund")] == ["en", "de"]
    found = {r["text"]: r for r in langid.identify(docs, model).collect()}
    assert found[None]["lang_pred"] == found[" \n\t"]["lang_pred"] == "und" and found[None]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in found.values()) and len(found["x"]) == len(docs.columns) + 3
    assert langid.identify(spark.createDataFrame([(1, "собака дом")], "doc_id long, text string"), model).first()["lang_pred"] == "ru"
    odd = [(1, "½ ² Ⅷ 12", "a", "b"), (2, "हिन्दी", "a", "b"), (3, "dog" * 4000 + " the house of the dog", "a", "b")]
    odd = spark.createDataFrame(odd, "_text long, text string, lang_spans string, words string")
    judged = {r["_text"]: r for r in langid.identify(odd, model, id_col="_text").collect()}
    assert [judged[i]["lang_pred"] for i in (1, 3)] == ["und", "en"] and judged[3]["words"] == "b" and judged[2]["lang_pred"] != "und"
    assert langid.words_of("हिन्दी naïve 漢字 x½y ก้า") == ["हिन्दी", "naïve", "漢", "字", "x", "y", "ก", "า"]
    assert len(langid.words_of("x" * 10_000)[0]) == 10_000
    named = odd.select(F.col("text").alias("score"), "words")
    assert langid.identify(named, model, text_col="score").columns == ["words", "lang_pred", "score", "lang_spans"]
    again = langid.learn(training.where("doc_id = 0").limit(1).unionByName(training.where("doc_id = 0").limit(1)), max_docs=1)
    assert again is None or len(again.languages) == 1
    assert langid.learn(empty) is None and langid.identify(docs, None).where("lang_pred = 'und'").count() == docs.count()
    assert langid.identify(empty, model).count() == 0


def test_viterbi_is_best():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(0, 6, 4)
        scores, penalty = rng.normal(0, 2, (sizes.sum(), 3)).astype("f4"), float(rng.choice([0.5, 2, 5]))
        got, at = langid.best_path(scores, sizes, penalty), 0
        for n in sizes.tolist():
            value = lambda p, at=at, n=n: sum(scores[at + i, p[i]] for i in range(n)) - penalty * sum(p[i] != p[i - 1] for i in range(1, n))
            assert abs(value(got[at : at + n]) - max(map(value, itertools.product(range(3), repeat=n)))) < 1e-3
            at += n


def test_quality_statistics(spark, docs, empty):
    got = Counter(tuple(r)[:8] for r in quality_trees.judge_quality(docs, None).collect())
    want = Counter()
    for doc_id, text, *_ in rows():
        text = text or ""
        w = SPACED.findall(text)
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        twice = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
        want[doc_id, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice), failed, not failed] += 1
    assert got == want
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_trees.fit_quality(docs, labels) is None and quality_trees.judge_quality(empty, None).count() == 0


def test_trees_are_monotonic():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 2))
    y = ((x[:, 0] + 0.4 * np.sin(9 * x[:, 0]) + 0.3 * rng.random(2000)) > 0.7).astype(float)
    model = quality_trees.fit_trees(x, y, [1, 0], trees=20)
    line = np.column_stack([np.linspace(0, 1, 300), np.full(300, 0.5)])
    assert (np.diff(model.score(line)) >= -1e-12).all() and np.mean((model.score(x) > 0.5) == y) > 0.85


def test_licenses(spark, empty):
    texts = [
        "Released under the MIT License.", "under the Apache License, Version 2.0 or GNU General Public License v3 and cc by-nc 4.0!",
        "MIT license mit LICENSE", None, "", "summit license", "All Rights Reserved", "no such thing",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, text in enumerate(texts):
        w = ALNUM.findall((text or "").translate(LOWER))
        at = [(j, label) for p, label in licenses.BASE.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == (min(at)[0] if at else None, max(at)[0] if at else None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in at})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert got[1]["labels"] == "apache,apache-2,cc-by,cc-by-nc-4,gpl,gpl-3" and got[5]["labels"] == ""
    assert len(licenses.rules()) > 200 and licenses.scan_licenses(empty).count() == 0
    for rule in licenses.rules():
        assert all(any(g in k for g in licenses.GATE) for k in rule.keywords) or any(g in rule.pattern.pattern for g in licenses.GATE)


@pytest.mark.parametrize(
    "text, base, labels",
    [
        ("GNU Lesser General Public License", "", "lgpl"),
        ("GNU Lesser General Public License version 3", "", "lgpl-3"),
        ("LGPL v2.1", "", "lgpl-2.1"),
        ("MPL 1.1", "", "mpl-1.1"),
        ("CC BY-NC-SA", "cc-by", "cc-by,cc-by-nc-sa"),
        ("MPL 1.1 or MPL 1", "", "mpl-1,mpl-1.1"),
    ],
)
def test_shorter_license_names_inside_longer_ones(text, base, labels):
    assert licenses.scan(text)[4:6] == (base, labels)
    assert len(licenses.detections(licenses.normalise(text))) == 1 + text.count(" or ")


def test_line_templates(spark, docs, empty, tmp_path):
    boiler = "Copyright {} by the authors of this page"
    own = [(i, f"first line of {chr(97 + i)}{chr(98 + i)} is here and long enough to be most\n{boiler.format(i)}\n") for i in range(8)]
    copies = [(20 + i, "the same text\nin all of them") for i in range(8)]
    spark.createDataFrame([*own, *copies, (40, None)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(spark.read.parquet(str(tmp_path / "t")), min_docs=5).collect()}
    assert got[3]["text"] == own[3][1].split("\n")[0] + "\n" and got[3]["n_dropped"] == 1
    assert got[21]["text"] == copies[1][1] and got[21]["n_dropped"] == 0  # copies stay whole
    assert got[40]["text"] is None and got[40]["n_lines"] == 0
    whole = line_templates.drop_recurring_lines(docs, min_docs=99)
    assert sorted(map(str, whole.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert line_templates.drop_recurring_lines(empty).count() == 0
    assert line_templates.template("GET /a/b/c took 15ms") == (4, "GET <*> took", "<*>")


def test_similar_lines_merge_into_templates(spark, tmp_path):
    """Lines of a branch that differ in plain words are one template; others of the branch are not."""
    word = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    own = lambda i: f"{word(i)} opens the text of this document, most words are here {word(i)} {word(i + 1)}"
    other = lambda i: " ".join(["Share this page with", *[word(37 * i + 5 * j) for j in range(4)]])
    lines = [f"Share this page with {word(i)} friends and others" for i in range(24)]
    texts = [f"{own(i)}\n{line}" for i, line in enumerate(lines)] + [f"{own(30 + i)}\n{other(i)}" for i in range(10)]
    texts.append("\n".join([lines[0], own(50)]))
    few = [f"{own(60 + i)}\nRead more about this {word(i)} in our archive" for i in range(19)]
    docs = list(enumerate(texts + few))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(table, same_form=False).collect()}
    want = {i: "\n".join(x for x in t.split("\n") if x not in lines) for i, t in docs}
    assert got == want and sum(got[i] != t for i, t in docs) == 25
    alone = line_templates.drop_recurring_lines(table)
    assert {r["doc_id"]: r["text"] for r in alone.collect()} == dict(docs)  # no masked form is in 20 documents
    parted = line_templates.drop_recurring_lines(table, depth=6, same_form=False)
    assert {r["doc_id"]: r["text"] for r in parted.collect()} == dict(docs)  # the differing word is a level of the tree


def test_co_training(spark, docs, empty):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["good", "fine"] if i % 2 else ["bad$$", "junk##"], k=30)), "en", f"s{i % 2}", 10) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = cotrain.fit(df, labels)
    got = cotrain.score(df, model)
    assert got.where((F.col("kept")) != (F.col("doc_id") % 2 == 1)).count() == 0
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert cotrain.score(docs, model).count() == docs.count()  # nulls, empty texts
    assert cotrain.fit(docs, labels.limit(0)) is None and cotrain.score(empty, model).count() == 0
    assert cotrain.score(docs, None).where("kept").count() == docs.count()


def test_license_short_names_identifiers_and_negations():
    said = {
        "SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: Apache-2.0": "apache-2", "SPDX-License-Identifier: BSD-3-Clause": "bsd",
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2", "see BSD-3-Clause below": "bsd", "is under Apache 2.0 here": "apache-2",
        "not licensed under the GPL": "", "It is no longer distributed under the Mozilla Public License 2.0": "", "a new BSD text": "bsd",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2,mit", "GPLv3 or later": "gpl-3", "the GNU Lesser General Public License version 3": "lgpl-3",
        "a file without any": "", "commit licen": "",
    }
    for text, want in said.items():
        labels = set(licenses.scan(text)[5].split(",")) - {""}
        assert labels >= set(want.split(",")) - {""}, (text, labels)
        assert want or not labels, (text, labels)
    # The base phrases count, negated or not.
    assert licenses.scan("not licensed under the MIT License")[4:6] == ("mit", "mit")


def test_many_mentions_in_one_text():
    text = "under the MIT License x Apache License, Version 2.0 y " * 50_000
    began = time.perf_counter()
    n_words, n_base, first, last, base, labels, score = licenses.scan(text)
    assert time.perf_counter() - began < 10
    assert (n_words, n_base, first, last, base) == (550_000, 100_000, 2, 549_994, "apache,mit") and set(labels.split(",")) >= {"apache-2", "mit"}
    rng = random.Random(4)
    spans = [(a, a + rng.randrange(1, 40)) for a in (rng.randrange(200) for _ in range(300))]
    kept, starts, ends = [], [], []
    for a, b in spans:  # the sweep of `detections` against a comparison with all
        at = bisect.bisect_right(starts, a)
        inside = bool(at and ends[at - 1] >= b)
        assert inside == any(x <= a and b <= y for x, y in kept)
        if not inside:
            kept.append((a, b))
            low = at - 1 if at and starts[at - 1] == a else at
            high = bisect.bisect_right(ends, b, low)
            starts[low:high], ends[low:high] = [a], [b]
