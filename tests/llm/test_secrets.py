import math
import random
import time

from quernel.llm import secrets


def test_scan_and_redact(spark):
    rng = random.Random(9)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    found = {}
    docs = []
    for i in range(120):
        kind = i % 6
        s = [hexa(18), hexa(40), key(), hexa(40), "4337166598464399", "user_profile_123"][kind]
        text = [f"some words password={s} more", f'then token = "{s}" and on', f"left here {s} right", f"see commit {s} for it", f"number {s} was called", f"in src/{s}.py it is"][kind]
        docs.append((i, text, "web", 1))
        if kind < 3:
            found[i] = s
    docs += [(500, None, None, 1), (501, "", "web", 1), (None, f"password={hexa(20)}", "web", 1), (502, "plain " * 40000, "web", 1), (503, "\ue000 text \ue001", "web", 1), (0, docs[0][1], "web", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, start int")
    model = secrets.train(secrets.labelled_findings(spark, 3000), secrets.learn(df, least=2))
    got = secrets.scan(df, model, path="source").collect()
    hit = {r.doc_id: r.candidate for r in got}
    assert sum(hit.get(i) == s for i, s in found.items()) >= 0.97 * len(found)
    assert len([i for i in hit if i is not None and i not in found]) <= 2
    by_id = {d: t for d, t, *_ in docs}
    assert all(by_id[r.doc_id][r.start : r.end] == r.candidate for r in got)
    out = secrets.redact(df, model, path="source")
    assert out.columns == df.columns and out.count() == len(docs)
    text = {r.doc_id: r.text for r in out.collect()}
    assert all(s not in text[i] for i, s in found.items() if hit.get(i) == s) and text[4] == by_id[4] and text[500] is None and "[SECRET]" in text[None]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    model = secrets.train(secrets.labelled_findings(spark, 400), trees=3)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.scan(none, model).count() == 0 and secrets.redact(none, model).count() == 0


def test_work_grows_with_the_number_of_candidates(spark):
    rng = random.Random(5)
    hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(20))
    model = secrets.train(secrets.labelled_findings(spark, 400), trees=3)
    many = [hexa() for _ in range(20_000)]
    text = "é " + " ".join(f"password={x}" for x in many)
    docs = spark.createDataFrame([(1, text, "\ue000")], "doc_id long, text string, key string")
    began = time.time()
    found = secrets.candidates(docs).orderBy("i").collect()
    assert [r.candidate for r in found] == many and all(text[r.start : r.end] == r.candidate for r in found)
    got = secrets.redact(docs, model).first()
    hit = {r.candidate for r in secrets.scan(docs, model).collect()}
    assert got.text == "é " + " ".join("password=" + ("[SECRET]" if x in hit else x) for x in many) and got.key == "\ue000" and len(hit) > 10_000
    assert time.time() - began < 90


def test_redact_keeps_marks_and_repeated_rows(spark):
    model = secrets.train(secrets.labelled_findings(spark, 3000))
    s = "4f8a91c07be2d53a66"
    rows = [(1, f"\ue000 password={s} \ue001"), (1, f"\ue000 password={s} \ue001"), (2, f"password={s}"), (2, f"password={s}"), (None, f"x password={s}")]
    got = sorted((r.doc_id or 0, r.text) for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    assert got == [(0, "x password=[SECRET]"), (1, "\ue000 password=[SECRET] \ue001"), (1, "\ue000 password=[SECRET] \ue001"), (2, "password=[SECRET]"), (2, "password=[SECRET]")]


def test_learned_language(spark):
    docs = spark.createDataFrame([(1, "the cat the hat THE thé"), (2, None)], "doc_id long, text string")
    language = secrets.learn(docs, least=2)
    assert [tuple(r) for r in language.words.collect()] == [("the", 3)]
    chances = language.chances.first().chances
    t, h = 19, 7
    assert len(chances) == 676 and abs(chances[t * 26 + h] - math.log(5 / 30)) < 1e-9  # th 4 times of 4 pairs that start with t
    found = spark.createDataFrame([("", "theqz12", "", "", 1.0)], "before string, candidate string, after string, path string, label double")
    r = secrets._known(found, language).first()
    assert abs(r.f_vocabulary - 0) < 1e-9 and r.f_chance < 0
