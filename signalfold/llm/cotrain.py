"""Quality classifier by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalfold.llm.words import SPACED, chunks, mix

TEXT_BUCKETS = 1024
META_BUCKETS = 128
_SHAPE = [(re.compile(p), s) for p, s in ((r"[A-ZÀ-Þ]", "A"), (r"[a-zß-ÿ]", "a"), (r"[0-9]", "0"), (r"[^\w\s]", "."))]


def _shape(word: str) -> str:
    """The runs of letters, digits and signs of a word, such as `Aa.` for `Words,`."""
    for pattern, sign in _SHAPE:
        word = pattern.sub(sign, word)
    return re.sub(r"(.)\1+", r"\1", word)[:8]


def text_view(texts: list[str]) -> np.ndarray:
    """Content features: hashed words, word shapes and whether a word was there before."""
    out = np.zeros((len(texts), TEXT_BUCKETS), np.float32)
    lists = [SPACED.findall(t) for t in texts]
    flat = np.array([w for ws in lists for w in ws], dtype=object)
    if not len(flat):
        return out
    codes, distinct = pd.factorize(flat)
    hashed = (mix(pd.util.hash_array(distinct, categorize=False)) % np.uint64(TEXT_BUCKETS - 256)).astype(np.int64)
    shapes = np.array([_shape(w) for w in distinct], dtype=object)
    shaped = (TEXT_BUCKETS - 256 + mix(pd.util.hash_array(shapes)) % np.uint64(255)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in lists])
    np.add.at(out, (doc, hashed[codes]), 1)
    np.add.at(out, (doc, shaped[codes]), 1)
    pair = doc.astype(np.int64) * len(distinct) + codes
    distinct_words = np.bincount(np.unique(pair) // len(distinct), minlength=len(texts))
    n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
    out[:, -1] = 0
    out = np.sqrt(out / n[:, None])
    out[:, -1] = distinct_words / n
    return out


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Page features: hashed source and language, and the length in steps of a factor of two."""
    keys = [
        (f"s{s}", f"l{l}", f"n{int(np.log2(max(n or 0, 1)))}" if n is not None else "n") for s, l, n in zip(source, lang, n_chars, strict=True)
    ]
    out = np.zeros((len(keys), META_BUCKETS), np.float32)
    if keys:
        for column in zip(*keys, strict=True):
            h = pd.util.hash_array(np.array(column, dtype=object)) % np.uint64(META_BUCKETS)
            out[np.arange(len(keys)), h.astype(np.int64)] = 1
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the last entry is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = ahead = np.zeros(x.shape[1])
    rate = 4 / max(float((x**2).sum(axis=1).max()), 1e-9)
    for i in range(steps):
        p = 1 / (1 + np.exp(-(x @ ahead)))
        new = ahead - rate * (x.T @ (weight * (p - y)) / weight.sum() + penalty * ahead)
        ahead = new + i / (i + 3) * (new - w)
        w = new
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and offset that fit the held-back labels."""
    scale = max(float(np.abs(z).std()), 1e-6)
    a, b = _fit((z / scale)[:, None].astype(np.float32), y, np.ones(len(y)))
    return float(max(a / scale, 0.0)), float(b)


@dataclass
class CoModel:
    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float  # log odds of good quality

    def views(self, texts: list[str], source: list, lang: list, n_chars: list) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of both views."""
        zt, zm = _logit(text_view(texts), self.text), _logit(meta_view(source, lang, n_chars), self.meta)
        return self.text_scale[0] * zt + self.text_scale[1], self.meta_scale[0] * zm + self.meta_scale[1]


def co_train(
    xt: np.ndarray, xm: np.ndarray, y: np.ndarray, *, rounds: int = 4, share: float = 0.1, sure: float = 0.9
) -> CoModel | None:
    """Two views on rows of which some have a label (0, 1; nan elsewhere).

    A quarter of the labelled rows only calibrates.  In each round each view is fitted to its own
    rows, and hands the unlabelled rows it is surest of, up to a share of them for each class and
    only beyond `sure`, to the other view as pseudo-labels.
    """
    labelled = np.flatnonzero(~np.isnan(y))
    if len(labelled) < 40 or len(set(y[labelled])) < 2:
        return None
    held, train = labelled[::4], np.setdiff1d(labelled, labelled[::4])
    free = np.flatnonzero(np.isnan(y))
    views = {"t": xt, "m": xm}
    pseudo: dict[str, dict[int, float]] = {"t": {}, "m": {}}
    weights: dict[str, np.ndarray] = {}
    for step in range(rounds + 1):
        for v, x in views.items():
            extra = np.array(sorted(pseudo[v]), int)
            rows = np.concatenate([train, extra])
            targets = np.concatenate([y[train], [pseudo[v][i] for i in extra]])
            weights[v] = _fit(x[rows], targets, np.concatenate([np.ones(len(train)), np.full(len(extra), 0.5)]))
        if step == rounds or not len(free):
            break
        for v, other in (("t", "m"), ("m", "t")):
            a, b = _calibrate(_logit(views[v][held], weights[v]), y[held])
            p = 1 / (1 + np.exp(-(a * _logit(views[v][free], weights[v]) + b)))
            most = max(1, int(share * len(free)))
            for label, chance in ((1.0, p), (0.0, 1 - p)):
                best = np.argsort(-chance, kind="stable")[:most]
                pseudo[other].update({int(free[i]): label for i in best if chance[i] >= sure})
    scales = {v: _calibrate(_logit(x[held], weights[v]), y[held]) for v, x in views.items()}
    rate = min(max(float(y[train].mean()), 1e-3), 1 - 1e-3)
    return CoModel(weights["t"], weights["m"], scales["t"], scales["m"], float(np.log(rate / (1 - rate))))


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 4000, max_free: int = 4000) -> CoModel | None:
    """Co-training on about `max_labelled` labelled and `max_free` other documents, picked by the hash of their id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars").where("doc_id is not null")
    n_known, n_docs = known.count(), docs.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    want_known = min(1.0, max_labelled / max(n_known, 1))
    want_free = min(1.0, max_free / max(n_docs - n_known, 1))
    near = rows.where(place < round(1e6 * max(want_known, want_free)))  # before the join, so that few texts move
    some = near.join(known, "doc_id", "left").where(
        F.when(F.col("y").isNotNull(), place < round(1e6 * want_known)).otherwise(place < round(1e6 * want_free))
    )
    table = some.toPandas().sort_values("doc_id").drop_duplicates("doc_id")
    if table.empty:
        return None
    xt = np.vstack([text_view(t) for _, _, t in chunks(table["text"].where(table["text"].notna(), None))])
    n_chars = [None if pd.isna(n) else int(n) for n in table["n_chars"]]
    return co_train(xt, meta_view(table["source"].tolist(), table["lang"].tolist(), n_chars), table["y"].to_numpy(float))


def score(docs: DataFrame, model: CoModel | None, *, keep_from: float = 0.5) -> DataFrame:
    """Per row: doc_id, text_score, meta_score, score (0 to 1) and kept.

    `score` combines the calibrated log odds of both views, the prior counted once.  Without a
    model the scores are null and all rows are kept.  A null or empty text is scored as a text
    without words, null metadata are values of their own.  No shuffle, one output row per row;
    null ids and repeated rows stay, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for first, end, texts in chunks(columns[1]):
                t, m = model.views(texts, *[c[first:end] for c in columns[2:]])
                parts = [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (t, m, t + m - model.prior)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first)] + [pa.array(p.astype(float)) for p in parts],
                    names=["doc_id", "text_score", "meta_score", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    if model is None:
        none = [F.lit(None).cast("double").alias(c) for c in ("text_score", "meta_score", "score")]
        return rows.select("doc_id", *none, F.lit(True).alias("kept"))
    found = rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    return found.withColumn("kept", F.col("score") >= keep_from)
