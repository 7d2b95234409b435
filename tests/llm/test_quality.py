import random
import zlib

import numpy as np
import pytest

from quernel.llm import quality

SCHEMA = "doc_id long, text string, score double"


def corpus(n=1200):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiouhlmnrst") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        w = [word() for _ in range(rng.randint(20, 80))]
        text = " ".join(w).capitalize() + "." if good else " ".join(x + rng.choice(["###", "%%%"]) for x in w) if rng.random() < 0.5 else " ".join(x for x in w[:5] for _ in range(15))
        docs.append((i, text, 1.0))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    extra = [(None, "Plain words here and there.", 1.0), (9000, None, 1.0), (9001, "", 1.0), (0, docs[0][1], 1.0), (9002, "long words " * 30000, 1.0)]
    df, lab = spark.createDataFrame(docs + extra, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab, epochs=30)
    out = model.transform(df).collect()
    assert len(out) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    truth = dict((i, q) for i, q, _ in labels)
    test = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.93
    assert abs(model.prior - 0.8) < 0.12
    kept = model.keep(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in out if r.predicted)
    assert {r.doc_id: r.score for r in model.transform(df).where("doc_id = 0").collect()}.keys() == {0}


def test_held_out_labels_do_not_count(spark):
    docs, labels = corpus(400)
    df = spark.createDataFrame(docs, SCHEMA)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    score = lambda lab: [(r.doc_id, r.score) for r in quality.fit(df, spark.createDataFrame(lab, "doc_id long, quality int, toxic int"), epochs=3).transform(df).orderBy("doc_id").collect()]
    assert score(labels) == score(turned)


def test_prior_estimate():
    rng = np.random.default_rng(3)
    pos, neg = rng.normal(1, 1, (3000, 3)), rng.normal(-2, 1, (3000, 3))
    for pi in (0.3, 0.7):
        k = int(3000 * pi)
        assert abs(quality.estimate_prior(pos, np.vstack([rng.normal(1, 1, (k, 3)), neg[: 3000 - k]])) - pi) < 0.1


@pytest.mark.parametrize("n", [0, 3])
def test_without_labels(spark, n):
    df = spark.createDataFrame([(i, "x", 1.0) for i in range(n)], SCHEMA)
    out = quality.classify(df, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [r.score for r in out] == [0.5] * n


def test_clashing_columns_and_repeated_ids(spark):
    docs, labels = corpus(300)
    rows = [(i, t, True, 1, 2, 0.5) for i, t, _ in docs] + [(7, docs[7][1], False, 3, 4, 0.1)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, positive boolean, i int, x int, held_out double")
    lab = spark.createDataFrame([(i, q, t, 1, "z") for i, q, t in labels], "doc_id long, quality int, toxic int, i int, text string")
    out = quality.classify(df, lab, epochs=2).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert quality.fit(df, lab, epochs=2).keep(df).columns == df.columns
    assert not quality.classify(spark.createDataFrame([(None, "a b c")], "doc_id long, text string"), lab).first().held_out
