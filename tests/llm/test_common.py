import random

import numpy as np
import pytest

from quernel.llm import _common as C


@pytest.mark.parametrize("few", [C.FEW_ROWS, 0])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(C, "FEW_ROWS", few)
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bit_field(spark):
    ids = np.arange(0, 5000, 7)
    field = C.bit_field(spark.createDataFrame([(int(i),) for i in ids], "i long"), ["i"], 18)
    assert C.held(field, C.joint(ids), 18).all()
    assert C.held(field, C.joint(np.arange(10**6, 10**6 + 5000)), 18).mean() < 0.01


def test_groups_span_batches():
    import pyarrow as pa

    k = np.repeat([1, 2, 5, 9], [3, 10, 1, 6])
    t = pa.table({"k": k, "v": np.arange(len(k))})
    for size in (1, 2, 7, 100):
        got = [(g.column("k")[0].as_py(), g.column("v").to_pylist()) for g in C.groups(t.to_batches(size), ["k"])]
        assert got == [(x, np.arange(len(k))[k == x].tolist()) for x in (1, 2, 5, 9)]


def test_lookup_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(C, "FEW_ROWS", 0)
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS x")
    table = spark.range(20_000).selectExpr("if(id % 3 = 0, 7, id) AS k").groupBy("k").count().where("k < 15000").withColumnRenamed("count", "w")
    got = C.lookup(rows, table, "k", "w", "left")
    assert got.count() == 20_000 and got.where("w is not null").count() == rows.where("k < 15000").count() and got.where("k = 7").select("w").distinct().count() == 1
    assert C.lookup(rows, table, "k", "w").count() == rows.where("k < 15000").count()


def test_without_is_exact_where_fields_are_full(spark, monkeypatch):
    """Fields of 64 bits are full, so every row is looked up; ids both gone and kept go, null ids stay."""
    rows = spark.createDataFrame([(i if i < 3000 else None, f"t{i}") for i in range(3010)] + [(7, "again"), (8, "again")], "id long, t string")
    gone = spark.createDataFrame([(i,) for i in range(0, 3000, 7)] * 2 + [(8,)], "x long")
    kept = spark.createDataFrame([(i,) for i in range(3000) if i % 7] + [(14,)], "y long")
    want = sorted(r.t for r in rows.collect() if r.id is None or (r.id % 7 and r.id != 8))
    for bits in (None, 6):
        if bits:
            monkeypatch.setattr(C, "field_bits", lambda n: bits)
        out = C.without(rows, "id", gone, kept)
        assert out.columns == rows.columns and sorted(r.t for r in out.collect()) == want
