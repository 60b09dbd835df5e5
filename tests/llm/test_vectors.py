import math

import numpy as np

from pyspark.sql import functions as F

from cairnflow.llm import maxscore, projections

SCHEMA = "vec_id long, embedding array<float>, score string"


def vectors(rng, n=400, dim=24):
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dim)) * np.where(rng.random(n) < 0.5, 0.08, 1.0)[:, None]
    rows = [(i, [float(np.float32(v)) for v in row], "x") for i, row in enumerate(x)]
    rows += [(1000 + i, rows[5][1], "x") for i in range(30)]
    rows += [(2000, None, "x"), (2100, [float("nan")] * dim, "x"), (2200, [0.0] * dim, "x"), (2300, [1.0, None], None), (2400, [float("inf")] + [1.0] * (dim - 1), "x"), (2500, [1.0, 2.0], "x"), (None, rows[7][1], "x"), (7, rows[7][1], "x")]
    return rows


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_equals_brute_force(spark):
    rows = vectors(np.random.default_rng(1))
    df = spark.createDataFrame(rows, SCHEMA)
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and good(v)]
    want = []
    for place, (i, q) in enumerate(ints):  # every row asks for itself, those of equal id too
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(ints) if other != place)[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    for shard_rows in (8192, 50, 7):
        got = maxscore.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=shard_rows)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_large_scores_stay_exact():
    rows = np.array([[2**30, 1], [2**30, 0], [-(2**30), 5]], dtype=np.int64)
    asks = np.array([[2**30, 1]], dtype=np.int64)
    shard = maxscore.Shard(rows, np.array([1, 2, 3]), np.array([1, 2, 3]))
    assert shard.best(asks[0], 9, 2) == [(1, 2**60 + 1), (2, 2**60)] and shard.best(asks[0], 1, 2) == [(2, 2**60), (3, -(2**60) + 5)]


def test_thresholds_split_terms_and_lose_nothing():
    rng = np.random.default_rng(3)
    rows = (rng.standard_normal((3000, 32)) * 300 * np.linspace(3, 0.05, 32)).astype(np.int64)
    shard = maxscore.Shard(rows, rng.permutation(3000), np.arange(3000))
    for name in range(0, 3000, 300):
        order = np.argsort(shard.names)
        scores = shard.ints[order] @ rows[name]
        ids = shard.ids[order]
        want = [(int(ids[i]), int(scores[i])) for i in sorted((i for i in range(3000) if i != name), key=lambda i: (-scores[i], ids[i]))[:10]]
        for floor in (None, want[-1][1], want[-1][1] - 5000):
            assert shard.best(rows[name], name, 10, floor) == want
        assert [x for x in shard.best(rows[name], name, 10, want[3][1]) if x[1] >= want[3][1]] == [x for x in want if x[1] >= want[3][1]]


def test_near_vectors_equal_brute_force(spark):
    rows = vectors(np.random.default_rng(2))
    df = spark.createDataFrame(rows, SCHEMA)
    dim = 24
    x = [np.array(list(v) + [0.0] * (dim - len(v))) if good(v) and any(v) else None for _, v, _ in rows]
    link = [[False] * len(rows) for _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.95 - 1e-12:
                link[i][j] = link[j][i] = True
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = [(r[0], sum(link[i]), least.get(find(i)), r[0] is not None and r[0] == least.get(find(i))) for i, r in enumerate(rows)]
    for settings in ({}, {"group_rows": 20, "recall": 0.999999}, {"group_rows": 100, "chunk": 8, "recall": 0.99999}):  # one group; keys; pairs of chunks
        got = projections.near_vectors(df, **settings)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert projections.near_vectors(df.limit(0)).count() == 0


def test_recall_calibration():
    assert projections.least_collisions(16, 3.0, 0.999) == 15
    assert projections.least_collisions(10, 1.0, 0.5) == 7


def test_defaults_keep_the_recall_with_counting():
    least = projections.least_collisions(projections.PROJECTIONS, projections.WINDOW, 1 - (1 - projections.RECALL) / 2)
    p = math.erf(projections.WINDOW / math.sqrt(2))
    passed = sum(math.comb(projections.PROJECTIONS, c) * p**c * (1 - p) ** (projections.PROJECTIONS - c) for c in range(least, projections.PROJECTIONS + 1))
    assert least < projections.PROJECTIONS and passed >= 0.999


def test_keys_find_pairs_at_the_limit():
    rng = np.random.default_rng(6)
    a = projections._unit(rng.standard_normal((4000, 64)))
    side = rng.standard_normal((4000, 64))
    side = projections._unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side
    spread = math.sqrt(0.1)
    for n in (10_000, 1_000_000):
        cells, keys = projections.keys_for(n, spread, 0.999)
        x, y = (projections._keys(v, cells, keys, spread, 1) for v in (a, b))
        assert (x == y).any(axis=1).mean() > 0.996
        assert (x[:2000] == x[2000:]).mean() < 4 * projections.GROUP_ROWS / n
    sizes = [projections.keys_for(n, spread, 0.999)[1] for n in (10**3, 10**5, 10**7, 10**9)]
    assert sizes == sorted(sizes) and sizes[3] < 100 * sizes[0]
    assert projections.keys_for(100, spread, 0.999) == (0, 1)
