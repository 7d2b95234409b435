from collections import Counter

import numpy as np
import pytest

from quernel.llm import pivots


@pytest.mark.parametrize("block", [4096, 7])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    x = [list(map(float, base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0, 0.02, 0.1, 0.2]))) for _ in range(250)]
    x += [x[0]] * 5 + [[2 * a for a in x[1]], None, [], [0.0] * 16, [None, *x[2][1:]], [float("nan"), *x[2][1:]], [float("inf"), *x[2][1:]], x[3][:8], x[3][:8]]
    rows = [(i, v, 1) for i, v in enumerate(x)] + [(None, x[0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(df, block=block).collect()}
    ok = lambda v: v and all(a is not None and np.isfinite(a) for a in v) and any(v)
    n = len(x)
    root, links, pairs = list(range(n)), Counter(), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok(x[i]) and ok(x[j]) and len(x[i]) == len(x[j]):
                a, b = np.array(x[i]), np.array(x[j])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    links[i] += 1
                    links[j] += 1
                    pairs += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    assert got.pop(None) == (0, None, False)
    assert all(got[i][0] <= links[i] for i in range(n))
    assert sum(g[0] for g in got.values()) >= 0.97 * 2 * pairs
    assert sum(got[i][1] == find(i) for i in range(n)) >= 0.97 * n
    assert all(got[i] == (0, i, True) for i in (257, 258, 259, 260, 261)) and got[0][0] >= 5


def test_empty(spark):
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rows_that_repeat_an_id(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 16))
    near = lambda v: [float(t) for t in v + rng.normal(size=16) * 0.02]
    rows = [(1, a.tolist()), (1, b.tolist()), (2, near(a)), (3, near(b)), (4, rng.normal(size=16).tolist())]
    got = sorted(tuple(r) for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_first_lists():
    rng = np.random.default_rng(3)
    a = np.array([rng.permutation(12)[:6] for _ in range(200)])
    b = np.array([rng.permutation(12)[:6] for _ in range(200)])
    lists = lambda p: {(min(x, y), max(x, y)) for i, x in enumerate(p[:3]) for y in p[i + 1 :]}
    first, second = pivots.first_lists(a, b, 3)
    for x, y, p, q in zip(a.tolist(), b.tolist(), first, second, strict=True):
        assert (p, q) == min(lists(x) & lists(y), default=(-1, -1))


def test_oracle_with_planted_links(spark):
    duckdb = pytest.importorskip("duckdb")
    from quernel.llm import queries

    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 16))
    rows = [(i, [float(t) for t in base[i % 6] + rng.normal(size=16) * rng.choice([0.02, 0.1])]) for i in range(60)] + [(60, None), (61, [0.0] * 16), (3, [float(t) for t in base[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    c = duckdb.connect()
    c.register("embeddings", df.toArrow())
    want = sorted(c.sql(queries.oracle_sql()["op9_pivots"]).fetchall())
    got = sorted(tuple(r) for r in pivots.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want and sum(r[1] for r in got) > 100
