"""Hard negatives against brute force: trees alone, and the whole operator on odd tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalfold.llm import cover_tree as ct


def vectors(rng, n, clusters=6, dims=12):
    middles = rng.integers(-200, 200, (clusters, dims))
    points = middles[rng.integers(0, clusters, n)] + rng.integers(-9, 10, (n, dims))
    points[: n // 5] = rng.integers(-200, 200, (n // 5, dims))
    points[n // 2 : n // 2 + n // 10] = points[0]  # equal vectors of different rows
    return points


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_brute_force_and_leaves_nodes_out(seed):
    rng = np.random.default_rng(seed)
    n = [1, 40, 700, 1500, 700, 300][seed]
    points, ids, labels = vectors(rng, n), rng.permutation(n), rng.integers(0, 4, n)
    tree = ct.Tree.load(ct.build(ids, labels, points).dump())
    for a, b, c, r in zip(tree.first, tree.end, tree.centre, tree.radius, strict=True):  # covering radii hold
        x = np.column_stack([tree.points, np.sqrt(np.maximum(tree.norm - (tree.points**2).sum(1), 0))])
        assert np.sqrt(((x[a:b] - x[c]) ** 2).sum(1)).max() <= r * (1 + 1e-9) + 1e-6
    seen, asked = [0], 0
    for i in range(0, n, max(n // 40, 1)):
        scores = points @ points[i]
        for same, windows, k in ((True, [(-(1 << 62), 1 << 62)], 5), (False, [(int(.3 * s), int(.9 * s)) for s in (90_000, 60_000)], 10)):
            got = ct.search(tree, points[i], windows, k, labels[i], same, ids[i], seen)
            asked += n
            for (low, high), best in zip(windows, got, strict=True):
                fits = ((labels == labels[i]) == same) & (ids != ids[i]) & (scores >= low) & (scores <= high)
                want = sorted(zip((-scores[fits]).tolist(), ids[fits].tolist(), strict=True))[:k]
                assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == want
    if n > 500:
        assert seen[0] < 0.6 * asked  # clustered vectors: most nodes are never opened


def test_products_are_exact():
    big = np.array([[1 << 30, 3], [-(1 << 30), 1]])
    assert ct.products(big, np.array([1 << 31, 1])).tolist() == [(1 << 61) + 3, -(1 << 61) + 1]
    with pytest.raises(OverflowError):
        ct.products(np.array([[1 << 40]]), np.array([1 << 40]))


def brute(rows, asks):
    rows = sorted({(i, la, tuple(v)) for i, la, v in rows if i is not None and la is not None and v is not None and None not in v})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = Counter()
    for i, la, v in rows:
        if not asks(i):
            continue
        scored = sorted((-dot(v, w), j, lb) for j, lb, w in rows if j != i)
        for minus, j, _ in [s for s in scored if s[2] == la][:5]:
            hard = [(-m, k) for m, k, lb in scored if lb != la and 30 * -minus <= 100 * -m <= 90 * -minus][:10]
            for rank, (score, k) in enumerate(hard, 1):
                want[i, j, rank, k, -minus, score] += 1
    return want


@pytest.mark.parametrize("shard_rows", [100_000, 90])
def test_mining_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(3)
    points = vectors(rng, 500).tolist()
    rows = [(i, int(la), p) for i, (la, p) in enumerate(zip(rng.integers(0, 3, 500), points, strict=True))]
    rows += [rows[5]] * 200 + [(5, 0, points[7]), (900, None, points[1]), (901, 1, None), (None, 1, points[1]), (902, 1, [1, None]), (903, 1, [5, 5]), (904, 2, []), (-20, 1, points[3])]
    rows += [(1000 + i, 1, points[9]) for i in range(60)] + [(2000 + i, 2, points[9]) for i in range(60)]  # ties
    schema = "vec_id long, label int, vector array<long>, query string, shard string, score int, target int, asks string"
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], schema).repartition(4)
    got = ct.mine_hard_negatives(docs, F.col("vec_id") % 20 == 0, shard_rows=shard_rows)
    want = brute(rows, lambda i: i % 20 == 0)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 500
    assert ct.mine_hard_negatives(docs.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ct.mine_hard_negatives(docs, F.lit(False)).count() == 0


def test_integer_vectors(spark):
    rows = [([0.5, -0.001, 3.0],), ([1.0, None],), ([float("nan")],), ([float("inf")],), (None,), ([],)]
    got = spark.createDataFrame(rows, "v array<float>").select(ct.integer_vectors(F.col("v")).alias("q")).collect()
    assert [r["q"] for r in got] == [[128, -1, 768], None, None, None, None, []]


def test_a_block_of_queries_goes_down_together(monkeypatch):
    """The steps of a search do not grow with the queries of its block, and each query gets its own rows."""
    rng = np.random.default_rng(8)
    points, ids, labels = vectors(rng, 1500), rng.permutation(1500), rng.integers(0, 4, 1500)
    tree, calls, plain = ct.Tree.load(ct.build(ids, labels, points).dump()), [0], ct.products
    monkeypatch.setattr(ct, "products", lambda *a: calls.__setitem__(0, calls[0] + 1) or plain(*a))
    some = np.arange(0, 1500, 25)
    low, high = (np.tile(np.array(x), (len(some), 1)) for x in ([20_000, -5000, 1], [60_000, 90_000, 0]))  # the last is empty
    found = ct.search_block(tree, points[some], low, high, 10, labels[some], False, ids[some])
    assert calls[0] < len(some)
    for n, i in enumerate(some):
        scores = points @ points[i]
        for w in range(3):
            fits = (labels != labels[i]) & (ids != ids[i]) & (scores >= low[n, w]) & (scores <= high[n, w])
            best = found.of(n, w)
            assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == sorted(zip((-scores[fits]).tolist(), ids[fits].tolist(), strict=True))[:10]
