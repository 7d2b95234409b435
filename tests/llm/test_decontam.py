import random

import pytest

from quernel.llm import decontam


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(500):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 80 if rng.random() < 0.1 else 12))) for _ in range(2))
        d, start, end = decontam.nearest(p, t, len(p))
        assert d == distance(p, t) and distance(p, t[start:end]) == d


@pytest.mark.parametrize("block", [2_000_000, 120])
def test_against_brute_force(spark, block):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(3, 15)).capitalize()) for i in range(12)] + [(90, None), (91, " "), (None, text(10))]

    def edited(s, n):
        s = list(s)
        for _ in range(n):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], ["q"], [s[k], "q"]])
        return "".join(s)

    docs = []
    for i in range(80):
        item = rng.choice(items[:12])[1]
        leak = rng.choice(["", item.upper(), item.replace(" ", "\n  "), edited(item, rng.choice([0, 1, 3, 6, 12])), item[: len(item) // 2], item + " " + item])
        docs.append((i, f"{text(rng.randint(0, 20))} {leak} {text(rng.randint(0, 20))}", "x"))
    docs += [(100, None, "x"), (101, "", "x"), (None, items[0][1], "x"), (102, "İ " + items[1][1], "x"), (102, "İ " + items[1][1], "x")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, distance string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(df, bench, budget=0.1, block_chars=block).collect()
    want = set()
    for d, t, _ in docs:
        for i, s in items:
            norm, item = decontam.normalise(t), decontam.normalise(s)
            if item and distance(item, norm) <= int(0.1 * len(item)):
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in got} == want
    by_id, of = {d: t for d, t, _ in docs}, dict(items)
    for r in got:
        item = decontam.normalise(of[r.item_id])
        assert distance(item, decontam.normalise(by_id[r.doc_id][r.start : r.end])) == r.distance <= int(0.1 * len(item))
    kept = decontam.decontaminate(df, bench, budget=0.1, block_chars=block).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(d) for d, *_ in docs if d not in {w[0] for w in want})


def test_item_that_repeats_itself_at_the_start_of_a_text():
    options = " ".join(f"({c}) The second train catches up at {n} p.m." for c, n in zip("ABCD", (3, 4, 5, 6), strict=True))
    item = f"{options} Which one is right, if two trains leave the same station, the first of them at noon with 60 km an hour, the second at one o'clock with 80 km an hour, and neither of them stops anywhere on the way nor changes its speed before they meet again on the line?"
    norm = decontam.normalise(item)
    matcher = decontam.Matcher([(1, item)], 0.06)
    for text in (item, item + " So they say.", item[:40] + "q" + item[41:] + " So they say.", "They ask: " + item):
        (got,) = matcher.find(text)
        assert got[3] == distance(norm, decontam.normalise(text)) and distance(norm, decontam.normalise(text[got[1] : got[2]])) == got[3]


def test_passages_with_up_to_a_tenth_of_edits(spark):
    rng = random.Random(11)
    items = [(i, " ".join("".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(12, 50)))) for i in range(20)]
    docs = []
    for i, s in items:
        s = list(s)
        for _ in range(int(0.1 * len(s))):
            s[rng.randrange(len(s))] = "q"
        docs.append((i, "so they say " + "".join(s) + " and more"))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()) == [(i, i) for i, _ in items]
    assert decontam.decontaminate(df, bench).count() == 0


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontam.find_leaks(none, items).count() == 0
    assert decontam.find_leaks(some, items.where("item_id > 1")).count() == 0
    assert decontam.decontaminate(some, items.where("item_id > 1")).count() == 1
