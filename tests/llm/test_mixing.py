import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from quernel.llm import mixing


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", None, "z"]
    return [(i, " ".join("w" * rng.randint(1, 4) for _ in range(int(rng.paretovariate(1.2) * 3))), rng.choices(sources, [60, 10, 10, 5, 5, 1])[0]) for i in range(n)]


def water_fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by the stated rule, one stopped source after another, in fractions."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped = {}
    while True:
        left, open_ = sum(sizes.values()) - sum(stopped.values()), [s for s in order if s not in stopped]
        due = {s: Fraction(left * weight[s], sum(weight[x] for x in open_)) for s in open_}
        over = [s for s in open_ if due[s] > most * sizes[s]]
        if not over:
            return {s: float(x) for s, x in (due | stopped).items()}
        stopped[over[0]] = most * sizes[over[0]]


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, None: 100}, {"a": 0, "b": 5}, {"a": 0}, {f"s{i}": i * i % 17 for i in range(40)}, {"é": 900, "z": 1, "B": 2, "𝄞": 3, "\uffee": 4}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, words long")
    assert {r.source: r.target for r in mixing.targets(df).collect()} == pytest.approx(water_fill(sizes))


def test_pivotal_keeps_words_and_expectations():
    rng = np.random.default_rng(0)
    p, w = rng.random(12), np.sort(rng.integers(1, 50, 12))[::-1]
    total = np.zeros(12)
    for _ in range(4000):
        out = mixing.pivotal(p, w, rng.random(12))
        assert abs((out * w).sum() - (p * w).sum()) < 1e-6 and sum(1e-9 < x < 1 - 1e-9 for x in out) <= 1
        total += out
    assert np.abs(total / 4000 - p).max() < 0.04


@pytest.mark.parametrize("group_rows, fan_in", [(20_000, 32), (20, 2)])
def test_mix(spark, group_rows, fan_in):
    rows = [*corpus(), (5000, None, "a"), (5001, "", "a"), (None, "x y", "a"), (3, "x y", "b"), (3, "x y", "b")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, size int, target string")
    got = mixing.mix(df, group_rows=group_rows, fan_in=fan_in)
    out = sorted(got.collect(), key=str)
    assert out == sorted(mixing.mix(df, group_rows=group_rows, fan_in=fan_in).collect(), key=str)
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    assert sorted(r["size"] for r in out) == sorted(words) and len(out) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    assert target == pytest.approx(water_fill(size))
    big = max(words)
    for s in size:
        assert abs(taken[s] - target[s]) <= (big if group_rows < 1000 else min(big, max(150, 0.05 * target[s])))


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_ids_come_back_and_equal_rows_split(spark):
    ids = [2**53 + 1, 2**53 + 3, -(2**63), None]
    rows = [(i, "w " * 7, "a") for i in ids] + [(9, "v " * 3, "b")] * 9000 + [(8, "v " * 70_000, "c")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), group_rows=100).collect()
    assert {r.doc_id for r in out} == {*ids, 8, 9} and len(out) == len(rows)
    taken = sum(r.taken for r in out if r.source == "b")
    assert abs(taken - next(r.target for r in out if r.source == "b")) <= 3


def test_with_copies_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5, 6), (2, "a", "s", 7, 8), (None, "c", "t", 9, 1)], "doc_id long, text string, source string, copies int, key int")
    out = mixing.with_copies(docs, mixing.mix(docs.select("doc_id", "text", "source")))
    assert out.columns == [*docs.columns, "copies_1"] and all(r.copies_1 > 0 for r in out.collect())


def test_with_copies_drops_rows_not_taken_before_the_join(spark):
    """The join gets the rows that the mix takes, and null ids, but not the others."""
    docs = spark.createDataFrame([(i, "one two", "a") for i in range(400)] + [(None, "one", "a")] * 3, "doc_id long, text string, source string")
    mixed = spark.createDataFrame([(i, int(i % 4 == 0) * 2) for i in range(400)] + [(None, 1), (None, 0), (None, 1)], "doc_id long, copies long")
    out = mixing.with_copies(docs, mixed)
    got = [(r.doc_id, r.copies) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(i, 2) for i in range(0, 400, 4)] + [(None, 2)] * 3, key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "test(" in plan and "Join" in plan and plan.index("Join") < plan.index("ArrowEvalPython")
