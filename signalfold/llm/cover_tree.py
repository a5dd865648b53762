"""Hard negatives by inner product: cover trees over norm-augmented vectors, searched best first.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm; a query q gets a 0.  Then
|q - x|^2 = |q|^2 + M^2 - 2 qx, so a node with all its vectors within `radius` of its centre bounds their inner
products with q from above and below.  Each level of a tree covers a node's vectors by balls of a smaller
radius around some of them, the node's own centre first.

Vectors are dealt into shards by hash, one tree each.  Queries come in blocks to every shard and are answered
one block after the other, all queries of a block together, so a task holds one tree and some blocks, however
many queries there are.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalfold.llm.components import stored

SHARD_ROWS = 131_072
QUERY_BLOCK = 64
BASE = 1.3  # radius of a level over that of the next one
LEAF = 32
NET_BATCH = 256
EXACT = 1 << 53
NONE = -(1 << 63)  # below every score
FIRST_ROUND, LAST_ROUND = 4, 256  # nodes of a round of the search
VERIFY_ROWS = 4096


def products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products with a query, or with the columns of several; past 53 bits by whole numbers, past 63 bits an error."""
    most = int(np.abs(points).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(points.shape[-1], 1)
    if most < EXACT:
        return (points.astype(float, copy=False) @ query.astype(float)).astype(np.int64)
    if most < 1 << 63:
        return points.astype(np.int64) @ query.astype(np.int64)
    found = points.astype(np.int64).astype(object) @ query.astype(object)
    return np.array(found.tolist(), np.int64)


@dataclass
class Tree:
    """Nodes in arrays; a node's vectors, and its children, stand next to each other."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray  # in the order of the leaves
    norm: np.ndarray  # the greatest squared norm
    centre: np.ndarray  # per node: its centre's place in `points`
    radius: np.ndarray
    first: np.ndarray  # its vectors
    end: np.ndarray
    child: np.ndarray  # its children; none for a leaf
    child_end: np.ndarray
    single: np.ndarray  # the label of all its vectors ...
    mixed: np.ndarray  # ... or True

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as arrays:
            tree = Tree(**dict(arrays))
        if int(np.abs(tree.points).max(initial=0)) < 1 << 26:
            tree.points = tree.points.astype(float)  # holds the same integers
        return tree


def _net(x: np.ndarray, members: np.ndarray, centre: int, radius: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres more than `radius` apart that cover the members, the nearest of each member and its distance."""
    away = lambda some: np.sqrt(np.maximum(
        (x[members] ** 2).sum(1)[:, None] + (x[some] ** 2).sum(1) - 2 * x[members] @ x[some].T, 0))
    chosen = [centre]
    near, owner = away([centre])[:, 0], np.zeros(len(members), np.int64)
    while True:
        open_ = np.flatnonzero(near > radius)[:NET_BATCH]
        if not len(open_):
            return chosen, owner, near
        some = members[open_]
        gaps = np.sqrt(np.maximum((x[some] ** 2).sum(1)[:, None] + (x[some] ** 2).sum(1) - 2 * x[some] @ x[some].T, 0))
        fresh, covered = [], np.zeros(len(some), bool)
        for i in range(len(some)):
            if not covered[i]:
                fresh.append(i)
                covered |= gaps[i] <= radius
                covered[i] = True
        distances = away(some[fresh])
        distances[open_[fresh], np.arange(len(fresh))] = 0.0
        best = distances.argmin(axis=1)
        least = distances[np.arange(len(members)), best]
        closer = least < near
        near = np.where(closer, least, near)
        owner = np.where(closer, best + len(chosen), owner)
        chosen += some[fresh].tolist()


def build(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, base: float = BASE, leaf: int = LEAF) -> Tree:
    """The cover tree of distinct rows."""
    floats = points.astype(float)
    squares = (floats**2).sum(axis=1)
    norm = squares.max(initial=0)
    x = np.column_stack([floats, np.sqrt(np.maximum(norm - squares, 0))])
    everything = np.arange(len(ids))
    centre = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    far = np.sqrt(((x - x[centre]) ** 2).sum(axis=1).max())
    nodes: list[list] = [[centre, far, everything, 0, 0]]  # centre, radius, members, children
    levels, at = [far / base], 0
    while at < len(nodes):
        middle, radius, members, *_ = nodes[at]
        level = levels[at]
        if len(members) > leaf and radius > 0:
            while level >= radius:  # levels that this node alone covers
                level /= base
            chosen, owner, near = _net(x, members, middle, level)
            reach = np.zeros(len(chosen))
            np.maximum.at(reach, owner, near)
            order = np.argsort(owner, kind="stable")
            parts = np.split(members[order], np.cumsum(np.bincount(owner, minlength=len(chosen)))[:-1])
            nodes[at][3], nodes[at][4] = len(nodes), len(nodes) + len(chosen)
            for c, r, part in zip(chosen, reach.tolist(), parts, strict=True):
                nodes.append([c, r, part, 0, 0])
                levels.append(level / base)
        at += 1
    # Leaves give the order of the vectors; a node's range is that of its leaves.
    first, end, order, place = [0] * len(nodes), [0] * len(nodes), [], 0
    todo = [(0, False)]
    while todo:
        n, done = todo.pop()
        _, _, members, c, ce = nodes[n]
        if done:
            end[n] = place
        elif c == ce:
            first[n], place = place, place + len(members)
            end[n] = place
            order.append(members)
        else:
            first[n] = place
            todo.append((n, True))
            todo += [(i, False) for i in range(ce - 1, c - 1, -1)]
    order = np.concatenate(order)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    labels = labels[order]
    low = np.array([labels[a:b].min() for a, b in zip(first, end, strict=True)])
    high = np.array([labels[a:b].max() for a, b in zip(first, end, strict=True)])
    small = np.int16 if np.abs(points).max(initial=0) < 1 << 15 else np.int64
    column = lambda i, t: np.array([n[i] for n in nodes], t)
    return Tree(ids[order], labels, points[order].astype(small), np.array(norm), back[column(0, np.int64)], column(1, float), np.array(first),
                np.array(end), column(3, np.int64), column(4, np.int64), low, low != high)


@dataclass
class Best:
    """The first rows of one window."""

    scores: np.ndarray
    ids: np.ndarray


class _Firsts:
    """The first k (score, id) of every window of a block of queries."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k  # a row per query, a column per window
        self.least = np.full(low.shape, NONE)  # the k-th score, and its id
        self.last = np.full(low.shape, NONE)
        self.key, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def wanted(self, upper: np.ndarray, lower: np.ndarray | None = None) -> np.ndarray:
        """Which (node, query) may hold a row for a window, by the bounds of its scores."""
        some = np.zeros(upper.shape, bool)
        for w in range(self.low.shape[1]):
            high = self.high[:, w]
            fits = np.minimum(upper, high) >= np.maximum(self.low[:, w], self.least[:, w])
            some |= fits if lower is None else fits & (lower <= high)
        return some

    def add(self, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Take in the (row, query) pairs of `scores` that fit."""
        need, top = np.maximum(self.low, self.least), self.high
        row, query = np.nonzero(fits & (scores >= need.min(axis=1)) & (scores <= top.max(axis=1)))
        if not len(row):
            return
        score, id_, width = scores[row, query], ids[row], self.low.shape[1]
        key, value, name = [self.key], [self.scores], [self.ids]
        for w in range(width):
            least = self.least[query, w]
            on = (score >= need[query, w]) & (score <= top[query, w]) & ((score != least) | (id_ < self.last[query, w]))
            key.append(query[on] * width + w)
            value.append(score[on])
            name.append(id_[on])
        key, value, name = (np.concatenate(x) for x in (key, value, name))
        order = np.lexsort((name, -value, key))
        key = key[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        kept = order[rank < self.k]
        self.key, self.scores, self.ids = key[rank < self.k], value[kept], name[kept]
        full = order[rank == self.k - 1]
        at = np.unravel_index(key[rank == self.k - 1], self.low.shape)
        self.least[at], self.last[at] = value[full], name[full]

    def of(self, query: int, window: int) -> Best:
        a, b = np.searchsorted(self.key, query * self.low.shape[1] + window + np.array([0, 1]))
        return Best(self.scores[a:b], self.ids[a:b])


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges, and which range each is of."""
    sizes = end - first
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of], of


def search_block(
    tree: Tree, queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, labels: np.ndarray, same: bool, but: np.ndarray,
    seen: list[int] | None = None,
) -> _Firsts:
    """First k rows of each window (least and greatest score) of each query, with its label or with another one.

    Higher scores come first, ties by id; the row `but` of a query does not count.  Nodes are taken by the upper
    bound of their scores, for all queries at a time and more of them each round; for a query, a node whose bounds
    are outside its windows, or below what each has already, is left out.  Scores are exact integers.  `seen`
    collects the number of verified pairs of vector and query.
    """
    best = _Firsts(low, high, k)
    if not len(tree.ids) or not low.size:
        return best
    width = tree.points.shape[1]
    q = np.zeros((width, len(queries)), np.int64)
    q[: min(width, queries.shape[1])] = queries.T[:width]
    total = (queries.astype(float) ** 2).sum(axis=1) + float(tree.norm)
    slack = 1e-9 * total + 1e-6
    top = high.max(axis=1)

    def verify(scores: np.ndarray, places: np.ndarray, active: np.ndarray) -> None:
        if seen is not None:
            seen[0] += int(active.sum())
        ids = tree.ids[places]
        fits = active & ((tree.labels[places][:, None] == labels) == same) & (ids[:, None] != but)
        best.add(scores, ids, fits)

    nodes, upper, take = np.zeros(1, np.int64), np.full((1, len(queries)), np.inf), FIRST_ROUND
    while len(nodes):
        keys = np.minimum(upper, top).max(axis=1)
        order = np.argsort(-keys, kind="stable")
        now, later = order[:take], order[take:]
        some, active = nodes[now], best.wanted(upper[now]) & (upper[now] > -np.inf)
        nodes, upper, take = nodes[later], upper[later], min(2 * take, LAST_ROUND)
        leaf = tree.child[some] == tree.child_end[some]
        ends = leaf & active.any(axis=1)
        places, of = _ranges(tree.first[some[ends]], tree.end[some[ends]])
        for i in range(0, len(places), VERIFY_ROWS):
            part, mine = places[i : i + VERIFY_ROWS], active[ends][of[i : i + VERIFY_ROWS]]
            verify(products(tree.points[part], q), part, mine)
        inner = ~leaf & active.any(axis=1)
        kids, of = _ranges(tree.child[some[inner]], tree.child_end[some[inner]])
        active = active[inner][of] & (tree.mixed[kids][:, None] | ((tree.single[kids][:, None] == labels) == same))
        kids, active = kids[active.any(axis=1)], active[active.any(axis=1)]
        if not len(kids):
            continue
        scores = products(tree.points[tree.centre[kids]], q)
        alone = tree.end[kids] - tree.first[kids] == 1
        verify(scores[alone], tree.centre[kids[alone]], active[alone])
        kids, scores, active = kids[~alone], scores[~alone], active[~alone]
        away = np.sqrt(np.maximum(total - 2.0 * scores, 0))
        radius = (tree.radius[kids] * (1 + 1e-9) + 1e-6)[:, None]
        above = (total - np.maximum(away - radius, 0) ** 2) / 2 + slack
        below = (total - (away + radius) ** 2) / 2 - slack
        above[~(active & best.wanted(above, below))] = -np.inf
        go = (above > -np.inf).any(axis=1)
        nodes, upper = np.concatenate([nodes, kids[go]]), np.concatenate([upper, above[go]])
    return best


def search(
    tree: Tree, query: np.ndarray, windows: list[tuple[int, int]], k: int, label: int, same: bool, but: int, seen: list[int] | None = None
) -> list[Best]:
    """`search_block` for one query: the first k rows of each of its windows."""
    low, high = (np.array([w], np.int64) for w in zip(*windows, strict=True))
    one = search_block(tree, np.asarray(query)[None], low, high, k, np.array([label]), same, np.array([but]), seen)
    return [one.of(0, w) for w in range(len(windows))]


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def integer_vectors(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x); null where the vector is null or holds a null or a number that is not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def build_index(rows: DataFrame, shards: int, *, base: float = BASE, leaf: int = LEAF) -> DataFrame:
    """(shard, tree): rows (id, label, vector), equal rows once, dealt by hash into trees of all of them."""

    def plant(table: pa.Table) -> pa.Table:
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        points = _matrix(table.column("vector").combine_chunks())
        order = np.lexsort((*points.T[::-1], labels, ids))  # one order, however the rows came
        tree = build(ids[order], labels[order], points[order], base, leaf)
        return pa.table({"shard": table.column("shard").slice(0, 1), "tree": pa.array([tree.dump()], pa.large_binary()).cast(pa.binary())})

    dealt = rows.distinct().withColumn("shard", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(plant, "shard int, tree binary")


def search_index(index: DataFrame, queries: DataFrame, shards: int, k: int, same: bool, *, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, target, id, score): first k rows of every shard for each query and target.

    `queries` has query, id, label, vector and targets, an array of (target, low, high) windows.  The index comes
    first in each task, then one block of queries after the other.
    """
    n = queries.count()
    some = queries.select(F.pmod(F.xxhash64("query"), F.lit(n // block + 1)).alias("block"), F.struct("query", "id", "label", "vector", "targets").alias("q"))
    blocks = some.groupBy("block").agg(F.collect_list("q").alias("queries"))
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("binary").alias("tree"), "block", "queries")
    given = index.select("shard", "tree", F.lit(-1).cast("long").alias("block"), F.lit(None).cast(asked.schema["queries"].dataType).alias("queries"))
    work = given.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "block")

    def answer(tree: Tree, some: list[dict]) -> pa.RecordBatch:
        windows = [sorted({(t["low"], t["high"]) for t in q["targets"]}) for q in some]
        bounds = np.zeros((2, len(some), max(map(len, windows))), np.int64)
        bounds[:] = np.array([1, -1])[:, None, None] << 62  # nothing is in a window that is not there
        for i, w in enumerate(windows):
            bounds[:, i, : len(w)] = np.array(w).T
        vectors = np.zeros((len(some), max(len(q["vector"]) for q in some)), np.int64)
        for i, q in enumerate(some):
            vectors[i, : len(q["vector"])] = q["vector"]
        labels, ids = (np.array([q[c] for q in some], np.int64) for c in ("label", "id"))
        found = search_block(tree, vectors, *bounds, k, labels, same, ids)
        asked = [(q["query"], t["target"], found.of(i, windows[i].index((t["low"], t["high"])))) for i, q in enumerate(some) for t in q["targets"]]
        sizes = [len(best.ids) for *_, best in asked]
        columns = [np.repeat(np.array(list(c), np.int64), sizes) for c in list(zip(*asked, strict=True))[:2]]
        columns += [np.concatenate([getattr(best, c) for *_, best in asked]) for c in ("ids", "scores")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "target", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shard = None, -1
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                raw = row.column("tree")[0].as_py()
                if raw is not None:
                    tree, shard = Tree.load(raw), row.column("shard")[0].as_py()
                    continue
                if tree is None or shard != row.column("shard")[0].as_py():
                    continue  # a shard without rows
                yield answer(tree, row.column("queries")[0].as_py())

    return work.mapInArrow(run, "query long, target long, id long, score long")


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector", positives: int = 5,
    negatives: int = 10, low_percent: int = 30, high_percent: int = 90, shard_rows: int = SHARD_ROWS, base: float = BASE, leaf: int = LEAF,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of all anchors.

    `anchor` is a condition over the columns of `rows`; vectors are arrays of whole numbers.  An anchor's
    positives are the first `positives` rows of its label, other than rows of its own id.  For each of them come the first `negatives`
    rows of other labels with low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score.
    Higher inner products come first, ties by the smaller id; rank counts from 1.

    Rows with a null id, label or vector, or a null component, take no part.  Rows equal in id, label and
    vector count once; rows that share an id but differ are rows of their own (as anchors too).  Missing components
    of shorter vectors count as 0.  An empty table, or no anchor, gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    columns = F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label")
    base_rows = rows.select(*columns, F.col(f"`{vector_col}`").cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks")).where(good)
    kept = stored(base_rows, "vectors")
    n = kept.count()
    shards = max(n // shard_rows + 1, min(spark.sparkContext.defaultParallelism, n // 256 + 1))
    index = stored(build_index(kept.drop("asks"), shards, base=base, leaf=leaf), "cover-trees")
    key = F.xxhash64("id", "label", "vector").alias("query")
    anchors = kept.where("asks").select(key, "id", "label", "vector").distinct()
    least, most = F.lit(-(1 << 62)).cast("long"), F.lit(1 << 62).cast("long")
    one = F.array(F.struct(F.lit(0).cast("long").alias("target"), least.alias("low"), most.alias("high")))
    near = search_index(index, anchors.withColumn("targets", one), shards, positives, True)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    first = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    first = stored(first.select("query", F.col("rank").cast("long").alias("target"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scaled = first.select("query", "target", F.expr(f"-{low_percent} * positive_score").alias("low"), F.expr(f"{high_percent} * positive_score").alias("high"))
    # Scores of a window: from the smallest to the largest whole number within its percentages.
    window = F.expr("struct(target, -((low - pmod(low, 100)) div 100) AS low, (high - pmod(high, 100)) div 100 AS high)")
    asked = scaled.groupBy("query").agg(F.collect_list(window).alias("targets"))
    hard = search_index(index, anchors.join(asked, "query"), shards, negatives, False)
    order = Window.partitionBy("query", "target").orderBy(F.desc("score"), "id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    told = first.join(anchors.select("query", F.col("id").alias("anchor_id")), "query")
    return ranked.join(told, ["query", "target"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
