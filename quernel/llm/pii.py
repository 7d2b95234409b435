"""Personal data: exact base patterns, and bootstrapped contextual extraction of further identifiers.

Base kinds are e-mail, ip, card and phone (see `base_spans`). Their matches are the seeds of the bootstrap. A
lexical pattern is the two words before a mention, or the word before with the word after. Mentions are the
seeds and all other tokens that look like an identifier (six characters or more, three digits or more, or an
'@'). Patterns and the distinct instances they go with make a graph that Spark scores in rounds: a pattern is as
good as the mean confidence of its instances, an instance as good as the chance that not all of its good
patterns err, seeds count 1. Patterns of a confidence of at least `least` for a kind, with at least `support`
distinct seeds or instances that other good patterns of that kind found, find the identifiers that no base pattern
sees; those are added, of the pattern's kind, where they don't overlap a base span. A pattern takes the kind it is
most confident of (of equals the first by name), anew in each round; rounds go on until patterns and their confidences
stay (`rounds` at most, should kinds take turns for ever).

Positions are code points, ends exclusive. Defined results: null is an empty text, without spans; texts are
scanned whole at linear cost; rows alike get results alike and count once as evidence, since instances are
distinct values; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_map, lookup, materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts where its run of digits does, so later starts need no try
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _MARK, _NOT_DIGIT, _SPACE = re.compile("[0-9]"), re.compile("[0-9@]"), re.compile("[^0-9]+"), re.compile(r"\s")
_EDGE = ".,;:!?\"'()[]{}<>"
_CODE = re.compile(r"[^\W_]+(?:[-_.@/'][^\W_]+)*", re.UNICODE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    end, q = 0, text.find("@")
    while q >= 0:
        r = q
        while r > end and text[r - 1] in _LOCAL:
            r -= 1
        if r < q and (m := _DOMAIN.match(text, q + 1)):
            end = m.end()
            yield r, end
        q = text.find("@", max(q + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost non-overlapping matches of each kind that pass its test."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def _words(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The two words before start and the one after end, lower-cased, digits as 0; found within 80 characters."""
    shape = lambda w: _DIGIT.sub("0", w.lower().strip(_EDGE))
    before = text[max(0, start - 80) : start].split()
    glued = start > 0 and not text[start - 1].isspace()
    if glued and before:  # the mention is the tail of a token, as in id=12345
        before = [*before[:-1], before[-1]]
    after = text[end : end + 80].split(maxsplit=1)
    return (shape(before[-2]) if len(before) > 1 else ""), (shape(before[-1]) if before else ""), (shape(after[0]) if after else "")


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple]:
    """(kind or None, start, end, value, word before last, last word before, word after) of seeds and identifier-like tokens."""
    out = [(k, a, b, text[a:b].lower(), *_words(text, a, b)) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    at, t = 0, 0
    while m := _MARK.search(text, at):
        a = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        stop = _SPACE.search(text, m.end())
        b = stop.start() if stop else len(text)
        at = b
        for code in _CODE.finditer(text, a, b):
            x, y = code.span()
            while t < len(taken) and taken[t][1] <= x:
                t += 1
            value = code.group()
            if y - x >= 6 and (len(_DIGIT.findall(value)) >= 3 or "@" in value) and not (t < len(taken) and taken[t][0] < y):
                out.append((None, x, y, value.lower(), *_words(text, x, y)))
    return out


_MENTION = "struct<kind:string,start:long,end:long,value:string,w2:string,w1:string,after:string>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (a hash of the text), base (array of kind, start, end) and mentions of every row of docs."""
    names = ("kind", "start", "end", "value", "w2", "w1", "after")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    full = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))
    short = pa.list_(pa.struct(list(zip(names[:3], kinds[:3], strict=True))))

    def go(t: pa.Table):
        base, found = [], []
        for s in t.column(2).to_pylist():
            s = s or ""
            spans = base_spans(s)
            base.append([dict(zip(names, x, strict=False)) for x in spans])
            found.append([dict(zip(names, x, strict=True)) for x in mentions(s, spans)])
        yield pa.table({"doc_id": t.column(0), "h": t.column(1), "base": pa.array(base, short), "mentions": pa.array(found, full)})

    rows = docs.select(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)), F.col(text))
    return arrow_map(rows, go, f"doc_id long, h long, base array<struct<kind:string,start:long,end:long>>, mentions array<{_MENTION}>")


def bootstrap(graph: DataFrame, support: int = 4, least: float = 0.8, rounds: int = 25) -> DataFrame:
    """pattern, kind, confidence of the patterns that pass; graph: distinct (pattern, value, kind or null)."""
    seeds = graph.where("kind is not null").groupBy("pattern", "kind").agg(F.count_distinct("value").alias("seeds"))
    size = materialise(graph.groupBy("pattern").agg(F.count_distinct("value").alias("n")), "sizes")
    seeds = materialise(seeds, "seeds")
    open_ = materialise(graph.groupBy("pattern", "value").agg(F.max("kind").alias("any")).where("any is null").select("pattern", "value"), "open")

    def best(evidence: DataFrame) -> DataFrame:
        """The patterns that pass, each with one kind; evidence: pattern, kind, found (seeds and believed instances), worth."""
        rated = evidence.where(F.col("found") >= support).join(size, "pattern").select("pattern", "kind", (F.col("worth") / F.col("n")).alias("confidence")).where(F.col("confidence") >= least)
        first = F.row_number().over(Window.partitionBy("pattern").orderBy(F.desc("confidence"), "kind"))
        return materialise(rated.withColumn("first", first).where("first = 1").drop("first"), "patterns")

    own = seeds.select("pattern", "kind", F.col("seeds").alias("found"), F.col("seeds").cast("double").alias("worth"))
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("pattern", "kind", F.round("confidence", 9)).cast("decimal(38,0)"))).first()
    good = best(own)
    now = state(good)
    for _ in range(rounds if now[0] else 0):
        # an open instance is as good as the chance that not all of its good patterns err; with any it is at least as good as `least`
        value = open_.join(good, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("belief"))
        gained = open_.join(value, "value").groupBy("pattern", "kind").agg(F.count("*").alias("found"), F.sum("belief").alias("worth"))
        good = best(own.unionByName(gained).groupBy("pattern", "kind").agg(F.sum("found").alias("found"), F.sum("worth").alias("worth")))
        before, now = now, state(good)
        if now == before:
            break
    return good


def find(docs: DataFrame, support: int = 4, least: float = 0.8, rounds: int = 25, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end by kind as in KINDS, then start) of every row of docs."""
    scanned = materialise(scan(docs, doc_id, text), "scanned")
    seen = scanned.where(F.size("mentions") > 0).select("doc_id", "h", F.explode("mentions").alias("m")).select("doc_id", "h", "m.*")
    two = F.when((F.col("w1") != "") & (F.col("w2") != ""), F.concat_ws(" ", F.lit("before:"), "w2", "w1"))
    around = F.when((F.col("w1") != "") & (F.col("after") != ""), F.concat_ws(" ", F.lit("around:"), "w1", "after"))
    by = lambda df: df.withColumn("pattern", F.explode(F.array_compact(F.array(two, around))))
    graph = materialise(by(seen).select("pattern", "value", "kind").distinct(), "graph")
    patterns = bootstrap(graph, support, least, rounds)
    open_ = materialise(by(seen.where("kind is null").select("doc_id", "h", "start", "end", "w1", "w2", "after")).select("doc_id", "h", "start", "end", "pattern"), "open")
    told = materialise(open_.groupBy("pattern").agg(F.count("*").alias("uses")).join(patterns, "pattern"), "told")
    found = lookup(open_, told, "pattern", "uses").groupBy("doc_id", "h", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    added = found.groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    every = F.concat("base", F.coalesce("added", F.array().cast(scanned.schema["base"].dataType)))
    ordered = F.transform(F.array_sort(F.transform(every, lambda x: F.struct(rank(x).alias("r"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = scanned.select("doc_id", "h", "base").join(added, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("h").eqNullSafe(F.col("_h")), "left")
    return out.select("doc_id", "base", ordered.alias("spans"))


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
