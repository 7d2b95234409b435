import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import jaccard


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(texts, n=5, percent=80):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    base = [[word() for _ in range(rng.choice([1, 3, 6, 20, 60, 150, 300]))] for _ in range(25)]
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w += passage
        texts.append(" ".join(w))
    return texts + [None, "", " \n\t", "A b C d E", "a B c D e", "É ß x y z w", texts[0], texts[0].upper(), texts[1].replace(" ", "\n")]


@pytest.mark.parametrize("hot, block, exact", [(256, 2048, False), (5, 16, False), (5, 16, True)])
def test_against_brute_force(spark, hot, block, exact):
    texts = corpus(hot)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.cluster(df, hot=hot, block=block, exact=exact).collect()}
    assert got.pop(None)[1] is None
    assert got == dict(enumerate(brute(texts)))


def test_shingle_counts():
    for t in [None, "", "a", "a b c d", "a b c d e", "a b c d e f a b c d e f", "x " * 50, "É é ß ẞ   a"]:
        w = words(t)
        want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(jaccard.shingles(t)) == len(want)


def test_traversal_loses_no_pair():
    sets = [jaccard.shingles(t) for t in corpus(3)]
    sets = [s for s in sets if len(s)]
    n = np.array([len(s) for s in sets])
    p, _ = jaccard.join_group(n, np.arange(len(n)), [jaccard.bitmap(s).tobytes() for s in sets], 80)
    got = {tuple(sorted(x)) for x in p.tolist()}
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                assert (j, i) in got


def test_empty(spark):
    assert jaccard.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_that_share_an_id_are_compared_each(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "x " * 9000), (4, "x " * 9000)]
    got = sorted(tuple(r) for r in jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1), (4, 1, 4), (4, 1, 4)]


def test_keep_one_keeps_all_columns(spark):
    a = " ".join(f"w{i}" for i in range(30))
    rows = [(5, a, "p"), (3, a, "q"), (None, a, "r"), (7, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string").withColumn("copies", F.lit(1)).withColumn("_q_id", F.lit(2))
    got = jaccard.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.gone for r in got.collect()) == ["q", "r", "s"]
