"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage of a document by at most k = floor(budget n) edits.
It is split into k + 1 pieces, one of which such a passage must hold unchanged. One Aho-Corasick pass over
a whole text finds all piece hits; hits of an item whose diagonals lie near each other are one candidate
place, and Myers' bit-parallel algorithm computes the least edit distance of the item to any passage there.
An edit changes at most GRAM of an item's distinct GRAM-character strings, so a place that lacks more than k GRAM
of them can't hold the item and is left without computing the distance.

Both sides are compared in lower case with white space runs as one blank; positions are reported in code
points of the text as it stands. Items go to the workers in blocks of at most `block_chars` characters, one
pass over the documents a block, so what is sent is bounded whatever the benchmark's size.

Defined results: null or empty texts and items match nothing; an item counts wherever its characters stand, inside
words too; items alike are reported each under its own id, a repeated row of items once; a null item_id is reported as
null; texts of any length are searched whole; repeated rows get findings each; a document without findings has
no row; empty tables give no findings; further columns are passed over (and kept by `decontaminate`).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map

GRAM = 6

_BUILT: dict = {}


def normalise(text: str | None) -> str:
    """Lower case (only where that keeps a character one character), white space runs as single blanks, trimmed."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return " ".join(low.split())


def grams(text: str) -> set[str]:
    """The distinct strings of GRAM characters in text."""
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def offsets(text: str) -> list[tuple[int, int]]:
    """(start in the normalised text, start in the text) of each word."""
    out, at = [], 0
    for m in re.finditer(r"\S+", text):
        out.append((at, m.start()))
        at += m.end() - m.start() + 1
    return out


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of text nearest to pattern, the first such end; None if above most."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    for i, c in enumerate(text):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, i + 1
            if not best:
                break
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
    return (best, end) if end >= 0 else None


def nearest(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest passage within most edits."""
    found = myers(pattern, text, most)
    if found is None:
        return None
    d, end = found
    back = myers(pattern[::-1], text[:end][::-1][: len(pattern) + d], d)  # the shortest passage of this end
    return d, end - (back[1] if back else len(pattern)), end


class Matcher:
    """Finds the items (id, text) in texts; pieces of all items stand in one automaton."""

    def __init__(self, items: list[tuple[int | None, str]], budget: float):
        import ahocorasick

        self.items, pieces = [], {}
        for item_id, text in items:
            norm = normalise(text)
            if not norm:
                continue
            k = int(budget * len(norm) + 1e-9)
            cuts = [len(norm) * i // (k + 1) for i in range(k + 2)]
            self.items.append((item_id, norm, k, grams(norm)))
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(norm[a:b], []).append((len(self.items) - 1, b))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, uses)
        self.automaton.make_automaton()

    def places(self, norm: str) -> dict[int, list[int]]:
        """Diagonals (where the item would start) by item."""
        out: dict[int, list[int]] = {}
        for end, uses in self.automaton.iter(norm):
            for i, b in uses:
                out.setdefault(i, []).append(end + 1 - b)
        return out

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item id, start, end, distance) of each place of text that holds an item, in code points of text."""
        if not text or not self.items:
            return []
        norm = normalise(text)
        hits = self.places(norm)
        if not hits:
            return []
        out = []
        for i, diagonals in hits.items():
            item_id, item, k, parts = self.items[i]
            least = len(parts) - k * GRAM
            group: list[int] = []
            for d in [*sorted(set(diagonals)), None]:
                if d is not None and (not group or d - group[-1] <= 2 * k + 1):
                    group.append(d)
                    continue
                for window in self._windows(group, len(item)):
                    # all pieces of an unchanged passage hit on its own diagonal, so only these need a look
                    same = next((x for x in window if x >= 0 and norm.startswith(item, x)), None)
                    if same is not None:
                        got = (0, same, same + len(item))
                    else:
                        base = max(0, window[0] - k)
                        place = norm[base : window[-1] + len(item) + k]
                        got = nearest(item, place, k) if least <= 0 or len(parts & grams(place)) >= least else None
                        got = got and (got[0], got[1] + base, got[2] + base)
                    if got:
                        out.append((item_id, got[1], got[2], got[0]))
                group = [d]
        if not out:
            return []
        words = offsets(text)
        starts = [a for a, _ in words]

        def at(x: int) -> int:
            a, b = words[bisect_right(starts, x) - 1]
            return x - a + b

        return sorted(((i, at(a), at(b - 1) + 1, d) for i, a, b, d in out if b > a), key=lambda x: (x[1], x[2], x[0] is None, x[0] or 0))

    @staticmethod
    def _windows(group: list[int], size: int):
        """Runs of diagonals of at most an item's length, so that a chain of hits can't make one long window."""
        at = 0
        for i, d in enumerate(group):
            if d - group[at] > size:
                yield group[at:i]
                at = i
        yield group[at:]


def _blocks(items: DataFrame, block_chars: int, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of about block_chars; each is collected on its own."""
    rows = items.where(F.length(text) > 0).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).distinct()
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        yield sorted(((r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _matcher(key: tuple, items: Broadcast, budget: float) -> Matcher:
    """The automaton of a block, built once a worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(items.value, budget)
    return _BUILT[key]


def find_leaks(docs: DataFrame, items: DataFrame, budget: float = 0.1, block_chars: int = 2_000_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start, end, distance: a row for each place of a document that holds a test item."""
    schema, out = "doc_id long, item_id long, start long, end long, distance int", None
    source = docs.select(F.col(doc_id).cast("long"), F.col(text))
    for block in _blocks(items, block_chars, item_id, item_text):
        key, block = (hash(tuple(block)), budget), docs.sparkSession.sparkContext.broadcast(block)

        def go(t: pa.Table, block=block, key=key):
            matcher = _matcher(key, block, budget)
            rows = [(d, *x) for d, s in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True) for x in matcher.find(s)]
            yield pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["doc_id", "item_id", "start", "end", "distance"])

        found = arrow_map(source, go, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, budget: float = 0.1, block_chars: int = 2_000_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text holds a test item; no shuffle."""
    where = docs.columns.index(text)
    for block in _blocks(items, block_chars, item_id, item_text):
        key, block = (hash(tuple(block)), budget), docs.sparkSession.sparkContext.broadcast(block)

        def go(t: pa.Table, block=block, key=key):
            matcher = _matcher(key, block, budget)
            yield t.filter(pa.array([not matcher.find(s) for s in t.column(where).to_pylist()], pa.bool_()))

        docs = arrow_map(docs, go, docs.schema)
    return docs
