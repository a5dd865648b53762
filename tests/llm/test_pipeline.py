"""The pipeline on odd small tables and on the given ones."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from signalfold.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string"


def test_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, "one text of some words that stays here", "en", "s", 3, "x"), (2, None, None, None, None, None), (None, "a text without an id", "en", "s", 1, "y"),
         (3, "one text of some words that stays here", "en", "s", 3, "x"), (4, "", "en", "s", 0, "x")], COLUMNS,
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            kept = stage(spark, some, "/root/testdata/sf0.001")
            assert kept.columns == docs.columns, name
            assert kept.count() <= some.count()
    left = corpus_pipeline.jaccard_join(spark, docs, "")
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 4]


def test_clashing_names_and_null_ids(spark, tmp_path):
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("text is not null").first()["text"]
    plain = "there was some little water under that other house and many people before them"
    rows = [(5, plain, 1), (None, plain, 2), (None, f"{plain} {item}", 3), (6, None, 4), (None, None, 5)]
    names = ["row_id", "gone", "bad", "score", "lang_pred", "lang_spans", "_text", "_gone", "_bad", "_row", "_lines"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").select("*", *[F.lit("x").alias(c) for c in names], F.lit("en").alias("lang"))
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    keys = lambda df: sorted(r["k"] for r in df.collect())
    for stage in (corpus_pipeline.language_id, corpus_pipeline.jaccard_join, corpus_pipeline.decontaminate):
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    assert keys(corpus_pipeline.jaccard_join(spark, docs, "")) in ([1, 3, 4, 5], [1, 4, 5])
    assert keys(corpus_pipeline.decontaminate(spark, docs, "/root/testdata/sf0.001")) == [1, 2, 4, 5]


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.where("length > 2048").count() == 0


WORDS = {
    "en": "the house of dog and with them was that from which would there before people little water under another should".split(),
    "de": "das haus der hund und mit ihnen war dass aus welche wird dort vorher leute kleine wasser unter andere sollte".split(),
}
NOTICE, SELDOM = "the people of that house read page {} before", "there was little water under that other house"
ITEM = "which would people from another little house give water before them today"


def planted():
    """Documents (id, text, lang) with cases for every stage on both sides of its rule."""
    rng = random.Random(11)
    make = lambda lang, n: " ".join(rng.choices(WORDS[lang], k=n))
    texts = {i: (f"{make(lang, 30)}\n{make(lang, 35)}", lang) for i in range(80) for lang in ["en" if i % 2 else "de"]}
    for i in range(1, 51, 2):  # 25 documents: cut out
        texts[i] = f"{texts[i][0]}\n{NOTICE.format(i)}", "en"
    for i in range(1, 39, 2):  # 19 documents: stays
        texts[i] = f"{SELDOM}\n{texts[i][0]}", "en"
    texts[100] = f"{NOTICE.format(7)}\nthe dog was there", "en"  # mostly recurring lines: stays whole
    texts[101] = texts[60][0].rsplit(" ", 1)[0] + " wasser2", "de"  # near copy
    texts[102] = texts[62][0].replace("\n", " haus2 ").replace(" hund ", " katze ").replace(" und ", " oder "), "de"  # too far to go
    texts[103] = texts[101][0].replace("das ", "das3 ", 1), "de"  # near copy of a near copy
    texts[110] = f"{make('en', 30)} {ITEM} {make('en', 20)}", "en"
    texts[111] = f"{make('en', 30)} {' '.join(ITEM.split()[:9])} {make('en', 20)}", "en"  # one word too few
    texts[120], texts[121], texts[122] = ("12 34 -- 56", "en"), ("", "en"), (None, "en")
    return [(i, t, lang) for i, (t, lang) in sorted(texts.items())]


def cut_lines(docs):
    mask = lambda line: " ".join("<*>" if re.search("[0-9]", w) else w for w in line.split())
    seen = Counter(k for t in docs.values() for k in {mask(x) for x in t.split("\n")})
    out = {}
    for i, t in docs.items():
        lines = t.split("\n")
        kept = [x for x in lines if seen[mask(x)] < 20]
        gone = len(t.split()) - len(" ".join(kept).split())
        out[i] = t if 2 * gone > len(t.split()) else "\n".join(kept)
    return out


def first_of_near(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, t in docs.items() for w in [t.split()]}
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: t for i, t in docs.items() if comp[i] == i}


def uncontaminated(docs):
    item = ITEM.split()
    grams = [" ".join(item[k : k + 10]) for k in range(len(item) - 9)]
    return {i: t for i, t in docs.items() if not any(f" {g} " in f" {' '.join(t.split())} " for g in grams)}


def test_stages_against_brute_force(spark, tmp_path):
    sf_dir = str(tmp_path)
    docs = [(i, t, lang, "s", len(t or ""), "x") for i, t, lang in planted()]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    want = {i: t for i, t, *_ in docs if i < 120}  # the last three have no letters
    got = corpus_pipeline.table(spark, sf_dir, "documents")
    sizes = []
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], (dict, cut_lines, first_of_near, uncontaminated), strict=True):
        before, want = want, brute(want)
        got = corpus_pipeline.stored(stage(spark, got, sf_dir), f"test-{name}")
        assert {r["doc_id"]: r["text"] for r in got.collect()} == want and got.count() == len(want), name
        sizes.append((len(before) - len(want), sum(before[i] != t for i, t in want.items())))
    assert sizes == [(0, 0), (0, 25), (2, 0), (1, 0)]  # the cases are there
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = {}
    for r in corpus_pipeline.best_fit_packing(spark, got, sf_dir).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert pieces.keys() == want.keys()
    for i, t in want.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert pieces[i] == [(0, len(ids), zlib.crc32(ids.tobytes()))]


def test_arrow_batches_are_small(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "some words", "en", "s", 3, "x")], COLUMNS)
    before = spark.conf.get(key)
    try:
        for set_, held in (("10000", "2000"), ("0", "2000"), ("500", "500")):
            spark.conf.set(key, set_)
            corpus_pipeline.jaccard_join(spark, docs, "").collect()
            assert spark.conf.get(key) == held
    finally:
        spark.conf.set(key, before)
