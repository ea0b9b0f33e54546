import numpy as np
import pytest

from voxloom.llm import neighbours


def plain(rows, k, every):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 6 and None not in v and np.isfinite(v).all() and np.any(v):
            fine.setdefault((i, tuple(np.float32(x) for x in v)), np.array(v, np.float32).astype(np.float64))
    out = []
    for (q, _), a in fine.items():
        if q % every == 0:
            found = sorted((-np.cumsum(a * b)[-1], i) for (i, _), b in fine.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def rows_of(kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    if kind == "ties":
        x[50:250] = x[20]
        x[300:] = np.round(x[300:])
    if kind == "clusters":
        x = x * 0.05 + np.eye(6, dtype=np.float32)[rng.integers(0, 6, 400)] * 3
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 6), (1040, [float("nan")] + [1.0] * 5), (1060, [None] + [1.0] * 5), (1080, [1.0] * 5), (None, [1.0] * 6), (1100, [float("inf")] * 6), rows[20], rows[21]]
    return [*rows, *odd]


@pytest.mark.parametrize("kind", ["random", "ties", "clusters"])
def test_against_brute_force(spark, kind):
    rows = rows_of(kind)
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, v int")
    got = sorted(tuple(r) for r in neighbours.search_all(df, k=20, every=20).collect())
    assert got == plain(rows, 20, 20)


def test_few_rows_and_none(spark):
    kinds = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0, 2.0])], kinds)
    assert neighbours.search_all(one).count() == 0
    assert neighbours.search_all(one.limit(0)).count() == 0
    two = one.union(spark.createDataFrame([(3, [2.0, 0.5]), (40, [0.0, -1.0])], kinds))
    assert sorted(tuple(r) for r in neighbours.search_all(two).collect()) == [(0, 1, 3, 3.0), (0, 2, 40, -2.0), (40, 1, 3, -0.5), (40, 2, 0, -2.0)]


def test_heap_gives_pairs_by_summed_distance_and_bounds_prune():
    rng = np.random.default_rng(9)
    c = rng.normal(size=(30, 8)) * 5
    x = c[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 8)) * 0.1
    books = [neighbours.k_means(x[:, :4], 16), neighbours.k_means(x[:, 4:], 16)]
    cells = np.stack([neighbours.nearest(x[:, :4], books[0]), neighbours.nearest(x[:, 4:], books[1])], 1)
    shard = neighbours.Shard(np.arange(3000), x, cells, books)
    far = [((b - h) ** 2).sum(1) for b, h in zip(books, (x[0, :4], x[0, 4:]), strict=True)]
    seen = list(shard.pairs(far))
    assert set(seen) == set(shard.lists) and len(seen) == len(shard.lists)
    sums = [far[0][i] + far[1][j] for i, j in seen]
    assert sums == sorted(sums)
    ids, scores = shard.search(0, x[0], 10)
    want = np.lexsort((np.arange(3000), -(x @ x[0])))
    assert ids.tolist() == [i for i in want if i][:10]
