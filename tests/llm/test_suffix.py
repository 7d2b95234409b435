import hashlib
import random
from collections import Counter

import pytest

from quernel.llm import suffix


def brute(texts, length):
    b = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in b for i in range(len(x) - length + 1))
    out = []
    for x in b:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_against_brute_force(spark, group):
    rng = random.Random(group)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared = [word(n) for n in (15, 20, 21, 30, 60, 90)]
    texts = ["".join(rng.choice([word(rng.randint(0, 30)), rng.choice(shared)]) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    texts += [None, "", "x", "a" * 100, "ab" * 40, "ab" * 11, texts[3], texts[3], texts[5] + "z", shared[2], shared[3][:20]]
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs, 20, 16, group).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, brute(texts, 20)))


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 20).count() == 0
