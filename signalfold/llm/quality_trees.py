"""Quality rules: text statistics, fixed floors, and boosted trees with monotonic constraints."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalfold.llm.words import SPACED, chunks, hash_runs, hash_words, spans

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Statistics the trees see, and how the quality may move as one grows (+1 up, -1 down, 0 free).
FEATURES = {
    "log_words": 1, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "upper_share": -1, "digit_share": -1, "punct_share": 0, "deflated_share": 0, "words_per_line": 0, "odd_letter_share": 0,
}
_NOT_SYMBOL = {c: None for c in map(ord, SYMBOLS)}


def base_statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The five contract statistics of each text (n x 5), and each text's number of distinct words."""
    words = [SPACED.findall(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    h = hash_words(flat)
    chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))])
    starts, inside = spans(n, WINDOW)
    out = np.zeros((len(texts), 5), np.int64)
    out[:, 0], out[:, 1] = n, chars[starts[1:]] - chars[starts[:-1]]
    doc = np.repeat(np.arange(len(texts)), n)
    # Windows of one text that are found twice: equal neighbours after sorting by text and hash.
    at = np.flatnonzero(inside)
    runs, of = hash_runs(h, WINDOW)[at], doc[at]
    order = np.lexsort((runs, of))
    same = (runs[order][1:] == runs[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, at[order[twice]], 1)
    np.add.at(edge, at[order[twice]] + WINDOW, -1)
    out[:, 4] = np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=len(texts))
    order = np.lexsort((h, doc))
    first = np.ones(len(order), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order[first]], minlength=len(texts))
    for i, t in enumerate(texts):
        out[i, 2] = sum(map(t.count, SYMBOLS))
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        out[i, 3] = len(lines) - len(set(lines))
    return out, distinct


def tree_features(texts: list[str], base: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Shares and means per text, in the order of FEATURES; whole texts are read."""
    n_words, chars, symbols, dup, repeat = base.T.astype(float)
    some, letters = np.maximum(n_words, 1), np.maximum(chars, 1)
    rest = np.zeros((len(texts), 6))
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "replace")
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        size = max(len(raw), 1)
        rest[i] = (
            counts[65:91].sum() / size, counts[48:58].sum() / size,
            (counts[33:48].sum() + counts[58:65].sum()) / size, len(zlib.compress(raw, 1)) / size,
            n_words[i] / (counts[10] + 1), counts[128:].sum() / size,
        )
    upper, digit, punct, deflated, per_line, odd = rest.T
    return np.column_stack([
        np.log1p(n_words), chars / some, symbols / letters, dup / (dup + 1), repeat / some, distinct / some,
        upper, digit, punct, deflated, per_line, odd,
    ])


@dataclass
class Trees:
    """Boosted regression trees as flat node arrays; a leaf points to itself."""

    feature: np.ndarray  # int32, 0 for leaves
    cut: np.ndarray  # float64, a value above goes right
    left: np.ndarray  # int32
    right: np.ndarray  # int32
    value: np.ndarray  # float64, the leaf's share of the log odds
    roots: np.ndarray  # int32
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability for every row; all rows walk down one level at a time."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] > self.cut[node], self.right[node], self.left[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, directions: list[int], *, trees: int = 60, depth: int = 4, rate: float = 0.2,
    bins: int = 64, least_rows: int = 20, shrink: float = 1.0,
) -> Trees:
    """Histogram boosting on the logistic loss.

    A split on a constrained feature is taken only if its two leaf values stand in the wanted
    order, and the midpoint between them bounds all values below, so the whole sum is monotonic.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    score = np.full(len(y), start)
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + shrink), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, -1, -1, 0.0)
        if level < depth and len(rows) >= 2 * least_rows:
            gt, ht = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                vl = np.clip(-gl / (hl + shrink), low, high)
                vr = np.clip(-(gt - gl) / (ht - hl + shrink), low, high)
                gain = gl**2 / (hl + shrink) + (gt - gl) ** 2 / (ht - hl + shrink) - gt**2 / (ht + shrink)
                allowed = (nl >= least_rows) & (len(rows) - nl >= least_rows) & (directions[j] * (vr - vl) >= 0)
                gain = np.where(allowed, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(vl[k] + vr[k]) / 2)
        if best[1] >= 0:
            _, j, k, middle = best
            goes = binned[rows, j] > k
            down, up = (low, high), (low, high)
            if directions[j] > 0:
                down, up = (low, middle), (middle, high)
            elif directions[j] < 0:
                down, up = (middle, high), (low, middle)
            left = grow(rows[~goes], g, h, level + 1, *down)
            right = grow(rows[goes], g, h, level + 1, *up)
            nodes[me] = [j, cuts[j][k], left, right, 0.0]
        else:
            score[rows] += rate * value
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
    f, c, left, right, v = (np.array(col) for col in zip(*nodes, strict=True))
    return Trees(f.astype(np.int32), c, left.astype(np.int32), right.astype(np.int32), v, np.array(roots, np.int32), depth, start)


SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE)


def _statistics(docs: DataFrame, extra: str, add) -> DataFrame:
    """Rows (doc_id, base statistics, what `add` makes of the tree features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, end, texts in chunks(batch.column(1).to_pylist()):
                base, distinct = base_statistics(texts)
                ids = pd.Series(batch.column(0).slice(first, end - first).to_pylist(), dtype="Int64")
                frame = pd.concat([ids.rename("doc_id"), pd.DataFrame(base, columns=BASE)], axis=1)
                for name, column in add(tree_features(texts, base, distinct)).items():
                    frame[name] = column
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return docs.mapInArrow(run, f"{SCHEMA}, {extra}")


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", max_rows: int = 10_000) -> Trees | None:
    """Trees fitted on a sample of at most about `max_rows` labelled documents, picked by the hash of their id.

    Null labels and ids are left out; without both kinds of label there is no model.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").alias("y")).where(
        "doc_id is not null and y is not null"
    ).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, max_rows / max(known.count(), 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    texts = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000))
    rows = _statistics(texts.select("doc_id", "text"), "x array<double>", lambda x: {"x": list(x)})
    # At most `max_rows` short rows in expectation, whatever the size of the tables.
    found = rows.select("doc_id", "x").join(sample, "doc_id").toPandas().sort_values("doc_id")
    y = found["y"].to_numpy(float)
    if len(found) < 50 or y.min() == y.max():
        return None
    return fit_trees(np.stack(found["x"].to_list()), y, list(FEATURES.values()))


def judge_quality(
    docs: DataFrame, model: Trees | None, *, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5,
    least_words: int = 20, repeat_percent: int = 30,
) -> DataFrame:
    """The statistics of every whole text, `base_failed`, `score` (probability of quality) and `kept`.

    A text fails the floor with fewer than `least_words` words, or with more than `repeat_percent`
    percent of its words in repeated windows; null and empty texts so fail.  Others are kept if
    the trees give `keep_from` or more, or if there is no model (score null).  No shuffle, one
    output row per row; null ids and repeated rows stay, other columns are ignored.
    """

    def add(x: np.ndarray) -> dict:
        return {"score": model.score(x) if model else pd.array([None] * len(x), "Float64")}

    rows = _statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "score double", add)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    good = F.coalesce(F.col("score") >= keep_from, F.lit(True))
    return rows.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & good).alias("kept"), "score")
