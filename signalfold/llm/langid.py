"""Language of documents: script candidates, word scores, and Viterbi spans with a switching penalty."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalfold.llm.words import chunks, mix
from signalfold.llm.worker import giving_back

UNKNOWN = "und"
# First code point of ranges of Unicode scripts; a range lasts to the next entry.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_NO = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


def _set(points: np.ndarray) -> str:
    """Ascending code points as a set of a regular expression."""
    gaps = np.flatnonzero(np.diff(points) > 1)
    ranges = zip(points[np.concatenate([[0], gaps + 1])].tolist(), points[np.concatenate([gaps, [-1]])].tolist(), strict=True)
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


# Scripts written without blanks: every letter is a word.
_ALONE = [(0x0E00, 0x0E7F), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF)]


_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _patterns() -> tuple[np.ndarray, re.Pattern]:
    """Table of what the plain pattern misjudges (combining marks, numbers that are no digits, letters that are words), and words."""
    names = [unicodedata.category(chr(c)) for c in range(0x110000)]
    letter, mark = (np.array([n[0] == x for n in names]) for x in "LM")
    alone = np.zeros(len(names), bool)
    for a, b in _ALONE:
        alone[a : b + 1] = True
    odd = mark | alone | np.array([n in ("Nl", "No") for n in names])
    single, first, more = (_set(np.flatnonzero(x)) for x in (letter & alone, letter & ~alone, (letter | mark) & ~alone))
    return odd, re.compile(f"{single}|{first}{more}*")


BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
ROWS = 500  # rows of an Arrow batch that are scored together


def words_of(text: str) -> list[str]:
    """Runs of letters with their combining marks, in lower case; scripts written without blanks give a word per letter."""
    text = text.lower()
    if text.isascii():
        return _LETTERS.findall(text)
    odd, words = _patterns()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return (words if odd[points].any() else _LETTERS).findall(text)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the character n-grams of all words, and the word of each."""
    padded = [f" {w} " for w in words]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    buckets, owner, power = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        power = power[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            inside = word[: len(power)] == word[n - 1 :] if n > 1 else points != 32
            buckets.append((mix(power + np.uint64(n << 40))[inside] % np.uint64(BUCKETS)).astype(np.int64))
            owner.append(word[: len(power)][inside])
    return np.concatenate(buckets), np.concatenate(owner)


@dataclass
class Model:
    """Log probabilities of n-gram buckets for each language, and the scripts each one is written in."""

    languages: list[str]
    logp: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # scripts x languages, True where the language was seen in that script
    known: dict[str, int] = field(default_factory=dict)  # word to row of `rows`, bounded
    rows: np.ndarray | None = None

    def word_scores(self, words: list[str], limit: int = 400_000) -> np.ndarray:
        """Score of every word under every language; each distinct word is scored once, then remembered."""
        if self.rows is None or len(self.known) > limit:
            self.known, self.rows = {}, np.zeros((0, len(self.languages)), np.float32)
        codes, distinct = pd.factorize(np.array(words, dtype=object))
        at = np.fromiter((self.known.get(w, -1) for w in distinct), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [distinct[i] for i in new]
            at[new] = len(self.rows) + np.arange(len(new))
            self.known.update(zip(fresh, at[new].tolist(), strict=True))
            self.rows = np.vstack([self.rows, self._score(fresh)])
        return self.rows[at][codes]

    def forget(self) -> None:
        """The remembered words go."""
        self.known, self.rows = {}, None

    def _score(self, words: list[str]) -> np.ndarray:
        buckets, owner = _grams(words)
        n = len(self.languages)
        total = np.column_stack([np.bincount(owner, self.logp[buckets, j], len(words)) for j in range(n)])
        total /= np.maximum(np.bincount(owner, minlength=len(words)), 1)[:, None]
        # Letters of a word, up to a few, carry evidence; very long words do not outweigh the rest.
        total *= np.minimum(np.fromiter(map(len, words), float, len(words)), 12)[:, None]
        total -= total.max(axis=1, keepdims=True)
        script = _SCRIPT_NO[np.searchsorted(_STARTS, [ord(w[0]) for w in words], side="right") - 1]
        fits = self.scripts[script]
        # Languages of another script are out, unless no learned language uses this one.
        return np.where(fits | ~fits.any(axis=1, keepdims=True), total, -30.0).astype(np.float32)


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word of many texts at once: step t treats word t of every text that has one."""
    labels = np.zeros(len(scores), np.int8)
    if not len(scores):
        return labels
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.argsort(-sizes, kind="stable")
    first, length = starts[order], sizes[order]
    back = np.zeros((len(scores), scores.shape[1]), np.int8)
    active = int(np.count_nonzero(length))
    best = scores[first[:active]].copy()
    stay = np.arange(scores.shape[1], dtype=np.int8)
    final = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t in range(1, int(length[0]) + 1):
        going = int(np.searchsorted(-length, -t, side="left"))  # texts with more than t words
        final[going:active] = best[going:active]
        active = going
        if not active:
            break
        best = best[:active]
        top = best.argmax(axis=1)
        switched = best[np.arange(active), top] - penalty
        moves = switched[:, None] > best
        back[first[:active] + t] = np.where(moves, top[:, None], stay)
        best = np.maximum(best, switched[:, None]) + scores[first[:active] + t]
        best -= best.max(axis=1, keepdims=True)
    count = int(np.count_nonzero(length))
    state = final[:count].argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        n = int(np.searchsorted(-length, -t, side="left"))
        at = first[:n] + t
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return labels


def best_path(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The labels of `viterbi`, which is run only for texts where a switch may pay.

    Let d be how far the best other language beats the text's best single language c at each word.
    An excursion from c gains at most the sum of d over its words and costs a penalty at each end
    inside the text, so if no stretch sums to more than two penalties, and none at an end of the
    text to more than one, c throughout is a best path.
    """
    if not len(scores) or scores.shape[1] == 1:
        return np.zeros(len(scores), np.int8)
    text = np.repeat(np.arange(len(sizes)), sizes)
    totals = np.column_stack([np.bincount(text, scores[:, j], len(sizes)) for j in range(scores.shape[1])])
    labels = totals.argmax(axis=1)[text].astype(np.int8)
    rows = np.arange(len(scores))
    own = scores[rows, labels]
    others = scores.copy()
    others[rows, labels] = -np.inf
    d = (others.max(axis=1) - own).astype(float)
    sums = np.concatenate([[0.0], np.cumsum(d)])
    ends = np.cumsum(sizes)
    before, after = sums[(ends - sizes)[text]], sums[ends[text]]
    here = sums[1:]
    # The lowest sum so far within the same text: each text is shifted below all earlier ones.
    shift = text * (2 * np.abs(sums).max() + 1)
    lowest = np.minimum.accumulate(sums[:-1] - shift) + shift
    slack = 1e-6
    may = (here - lowest > 2 * penalty - slack) | (here - before > penalty - slack) | (after - sums[:-1] > penalty - slack)
    redo = np.bincount(text, may, len(sizes)) > 0
    mine = redo[text]
    labels[mine] = viterbi(scores[mine], sizes[redo], penalty)
    return labels


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 8_000) -> Model | None:
    """A model from about `max_docs` labelled documents, picked by the hash of their id and text.

    Rows with null text or language do not count; without any there is no model.  Where equal rows
    leave the sample empty, some `max_docs` rows are taken.  Languages are numbered by name.  What reaches
    the driver is one row per language and hash bucket.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text is not null and lang is not null"
    )
    share = min(1.0, max_docs / max(rows.select("lang").count(), 1))
    some = rows.where(F.pmod(F.xxhash64("id", "text", F.lit(7)), F.lit(1_000_000)) < max(1, round(share * 1_000_000)))
    if some.isEmpty():
        some = rows.limit(max_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, _, texts in chunks(batch.column(0).to_pylist()):
                for lang in set(langs[first : first + len(texts)]):
                    words = [w for i, t in enumerate(texts) if langs[first + i] == lang for w in words_of(t)]
                    if not words:
                        continue
                    table = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES)))
                    table[:BUCKETS] += np.bincount(_grams(words)[0], minlength=BUCKETS)
                    points = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
                    script = _SCRIPT_NO[np.searchsorted(_STARTS, points, side="right") - 1]
                    table[BUCKETS:] += np.bincount(script, minlength=len(SCRIPT_NAMES))
        for lang, table in totals.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at), pa.array(table[at].astype(np.int64))], names=["lang", "bucket", "n"]
            )

    counted = some.select("text", "lang").mapInArrow(giving_back(count), "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if table.empty:
        return None
    languages = sorted(table["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    counts[table["bucket"], table["lang"].map(languages.index)] = table["n"]
    grams, seen = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    scripts = seen > 0.01 * np.maximum(seen.sum(axis=0), 1)
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), scripts)


def label_words(model: Model, texts: list[str], penalty: float) -> tuple[list[list[str]], list[np.ndarray], list[np.ndarray]]:
    """Words, their language numbers and their scores for every text."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    scores = model.word_scores(flat) if flat else np.zeros((0, len(model.languages)), np.float32)
    labels = best_path(scores, sizes, penalty)
    cuts = np.cumsum(sizes)[:-1]
    return words, np.split(labels, cuts), np.split(scores, cuts)


def language_spans(model: Model, text: str, penalty: float = 4.0) -> list[tuple[str, int, int]]:
    """Spans (language, first word, end word) of one text."""
    (labels,) = label_words(model, [text], penalty)[1]
    edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    return [(model.languages[labels[a]], a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = 4.0) -> DataFrame:
    """Each row of `docs` with `lang_pred`, `score` and `lang_spans`.

    The predicted language is the one whose spans hold most letters; `score` is its share of
    the letters, times how much better its words fit it than the next language (0 to 1).
    `lang_spans` is the number of spans.  Of languages with equal letters the first by name counts.
    A text that is null or has no letter, or any text without a model, gives `und`, 0 and 0.  No
    shuffle; null ids, repeated rows and other columns stay as they are, whatever their names
    (columns named like a new one are replaced).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                yield judged(whole.slice(at, ROWS))
        if model is not None:
            model.forget()

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for _, _, texts in chunks(batch.column(where).to_pylist(), 1_000_000):
            if model is None:
                found += [(UNKNOWN, 0.0, 0)] * len(texts)
                continue
            for words, labels, scores in zip(*label_words(model, texts, penalty), strict=True):
                if not words:
                    found.append((UNKNOWN, 0.0, 0))
                    continue
                letters = np.fromiter(map(len, words), float, len(words))
                held = np.bincount(labels, letters, len(model.languages))
                best = int(held.argmax())
                own = scores[labels == best]
                others = np.delete(own.mean(axis=0), best)
                margin = float(own[:, best].mean() - others.max()) if len(others) else 3.0
                sure = 1 / (1 + np.exp(-np.clip(2 * margin, -20, 20)))
                found.append((model.languages[best], float(held[best] / letters.sum() * sure), 1 + int(np.count_nonzero(np.diff(labels)))))
        made = zip(*found, strict=True) if found else ([], [], [])
        arrays = [pa.array(list(c), t) for c, t in zip(made, (pa.string(), pa.float64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *arrays], names=[*passed, *new])

    new = ["lang_pred", "score", "lang_spans"]
    passed = [c for c in docs.columns if c not in new]
    # The text goes to Python once, in its own column unless that is replaced.
    sent = passed if text_col in passed else [*passed, text_col]
    where = sent.index(text_col)
    rows = docs.select(*[F.col(f"`{c}`") for c in sent])
    schema = docs.select(*[F.col(f"`{c}`") for c in passed]).schema
    for name, kind in zip(new, ("string", "double", "long"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(giving_back(run), schema)
