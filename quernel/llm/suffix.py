"""Removal of repeated byte strings by sampled suffixes.

Every byte covered by a `length`-byte string that also starts anywhere else in the corpus goes. All suffixes
of a corpus don't fit the disk of a cluster that just holds the corpus (see the README), so the suffixes are
sampled by content instead of by position: a suffix is kept where the hash of its first half-length bytes is
the least of some window of half a length. Like a difference cover, the sample holds, of any two equal
strings of `length` bytes, two suffixes at equal offsets. The steps are those of difference-cover sorting:

1. Sampled suffixes get names: the hash of their first half-length bytes. Names held once are done with.
2. Names are refined by what surrounds them (half a length before, a length in all after). A refined name
   held more than once covers its whole surroundings.
3. The remaining suffixes, those of sampled places whose name is repeated but whose surroundings aren't, are
   merged into the groups of their names: each byte shift of a place takes the hash of its `length` bytes,
   and equal ones next to each other in order show which shifts are repeated.

Names are 64-bit hashes. A set of names is told to the tasks that read the texts as a bit field of fixed size;
a false hit costs work and no result, since the joins that follow are exact.

Defined results: null is an empty text; texts under `length` bytes stay as they are; repeated rows of at least
`length` bytes lose everything, as do texts that occur twice under different ids; ids aren't used to match, so
null or repeated ids do no harm; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, bit_field, groups, held, joint, materialise
from ._common import mix64 as _mix
from .jaccard import _BYTE, _powers

_LONG = pa.int64()


class _Hashed:
    """The bytes of a text with prefix sums from which the hash of any range comes."""

    def __init__(self, b: np.ndarray):
        self.b = b
        up, self.down = _powers(len(b) + 1)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])

    def range(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.total[hi] - self.total[lo]) * self.down[lo])


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _sliding(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over each window of w entries, by running it forth and back within blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, fill, x.dtype)
    padded[:n] = x
    m = padded.reshape(-1, w)
    forth, back = op.accumulate(m, 1).ravel(), op.accumulate(m[:, ::-1], 1)[:, ::-1].ravel()
    return op(back[: n - w + 1], forth[w - 1 : n])


def anchors(t: _Hashed, length: int) -> np.ndarray:
    """The sampled places of a text: least hash of a window, all that tie for it."""
    half = length // 2
    window = length - half + 1
    n = len(t.b) - half + 1
    if len(t.b) < length:
        return np.zeros(0, np.int64)
    h = _mix((t.total[half:] - t.total[:-half]) * t.down[:n])
    low = _sliding(h, window, np.minimum, np.uint64(2**64 - 1))
    edge = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), window, np.maximum, np.uint64(0)) == h)


def _surroundings(at: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(at - (length - length // 2), 0), np.minimum(at + length, n)


def _long(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if len(x) else [], _LONG)


def _shifts(text: bytes, length: int) -> np.ndarray:
    """The hash of each window of `length` bytes of a place's surroundings."""
    t = _Hashed(np.frombuffer(text, np.uint8))
    return _mix((t.total[length:] - t.total[:-length]) * t.down[: len(t.b) - length + 1])


def repeated_spans(docs: DataFrame, length: int = 400, field_bits: int = 26, group: int = 4096, text: str = "text") -> DataFrame:
    """key, n, start, end: intervals (they may overlap) whose union is what is repeated, by the text's key and bytes."""
    half = length // 2
    left = length - half
    sc = docs.sparkSession.sparkContext
    texts = docs.where(F.octet_length(text) >= length).select(_key(text).alias("key"), F.col(text).alias("t"))

    def names(t: pa.Table):
        out = [np.zeros(0, np.uint64)]
        for s in t.column(1).to_pylist():
            h = _Hashed(_bytes(s))
            at = anchors(h, length)
            out.append(h.range(at, at + half))
        yield pa.table([_long(np.concatenate(out))], ["name"])

    # 1. names held more than once
    twice = materialise(arrow_map(texts, names, "name long").groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "names")
    field = sc.broadcast(bit_field(twice, ["name"], field_bits))

    def refined(t: pa.Table):
        cols = [[np.zeros(0, np.uint64)] for _ in range(5)]
        for key, s in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
            h = _Hashed(_bytes(s))
            at = anchors(h, length)
            name = h.range(at, at + half)
            ok = held(field.value, joint(name), field_bits)
            at, name = at[ok], name[ok]
            lo, hi = _surroundings(at, len(h.b), length)
            wide = _mix(h.range(lo, hi) + (hi - lo).astype(np.uint64) * np.uint64(1 << 20) + (at - lo).astype(np.uint64))
            for c, x in zip(cols, (name, wide, np.full(len(at), key, np.int64).view(np.uint64), np.full(len(at), len(h.b), np.uint64), at.astype(np.uint64)), strict=True):
                c.append(x)
        yield pa.table([_long(np.concatenate(c)) for c in cols], ["name", "wide", "key", "n", "at"])

    # 2. refined names
    sampled = materialise(arrow_map(texts, refined, "name long, wide long, key long, n long, at long"), "sampled")
    kinds = materialise(sampled.groupBy("name", "wide").agg(F.count("*").alias("c"), F.first("key").alias("key"), F.first("n").alias("n"), F.first("at").alias("at")), "kinds")
    again = kinds.where("c > 1").select("name", "wide")
    spans = lambda df: df.select("key", "n", F.greatest(F.col("at") - left, F.lit(0)).alias("start"), F.least(F.col("at") + length, F.col("n")).alias("end"))
    full = spans(sampled.join(again, ["name", "wide"]))
    # 3. places of a repeated name with surroundings of their own, and one place for each kind of surroundings
    names_of = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("kinds > 1 and least = 1").select("name", "kinds")
    places = materialise(kinds.join(names_of, "name").select("name", "kinds", "key", "n", "at", (F.col("c") == 1).alias("open")), "places")
    wanted = sc.broadcast(bit_field(places, ["key", "n", "at"], field_bits))
    found = arrow_map(texts, _cutter(wanted, length, field_bits), "key long, n long, at long, around binary")
    # a text that occurs again gives its places again
    found = found.dropDuplicates(["key", "n", "at"])
    around = materialise(places.join(found, ["key", "n", "at"]).select("name", "kinds", "key", "n", "at", "open", "around"), "around")

    def shifted(rows: pa.Table) -> np.ndarray:
        """(first, last) repeated shift of each row, -1 if none; shift 0 starts `left` bytes before the place."""
        at, texts_ = rows.column("at").to_numpy(), rows.column("around").to_pylist()
        begin = left - np.minimum(at, left)
        hs = [_shifts(x, length) if len(x) >= length else np.zeros(0, np.uint64) for x in texts_]
        row = np.repeat(np.arange(len(hs)), [len(h) for h in hs])
        col = np.concatenate([b + np.arange(len(h)) for b, h in zip(begin, hs, strict=True)]) if len(row) else row
        return _first_last(row, col, np.concatenate(hs) if hs else np.zeros(0, np.uint64), len(hs))

    def whole(batches):
        for rows in groups(batches, ["name"]):
            p = shifted(rows)
            ok = (p[:, 0] >= 0) & rows.column("open").to_numpy(zero_copy_only=False)
            at = rows.column("at").to_numpy()[ok]
            out = pa.table([rows.column("key").filter(pa.array(ok)), rows.column("n").filter(pa.array(ok)), _long(at - left + p[ok, 0]), _long(at - left + p[ok, 1] + length)], ["key", "n", "start", "end"])
            yield from out.combine_chunks().to_batches()

    schema = "key long, n long, start long, end long"
    small = around.where(F.col("kinds") <= group).repartition("name").sortWithinPartitions("name").mapInArrow(whole, schema)
    # large groups: shifts are dealt out by blocks of 16 and, beyond 65536 kinds, by parts of their hashes
    block = 16

    def dealt(t: pa.Table):
        rows = []
        for name, kinds_, key, n, at, around_ in zip(*(t.column(c).to_pylist() for c in ("name", "kinds", "key", "n", "at", "around")), strict=True):
            if len(around_) < length:
                continue
            h = _shifts(around_, length)
            col = left - min(at, left) + np.arange(len(h))
            part = h % np.uint64(-(-kinds_ // 65536))
            for b in np.unique(col // block):
                for p in np.unique(part[col // block == b]):
                    k = (col // block == b) & (part == p)
                    rows.append((name, int(b), int(p), key, n, at, col[k], h[k].view(np.int64)))
        kinds_of = [_LONG] * 6 + [pa.list_(_LONG)] * 2
        yield pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds_of)], ["name", "blk", "part", "key", "n", "at", "cols", "hs"])

    def merged(batches):
        for rows in groups(batches, ["name", "blk", "part"]):
            cols, hs = rows.column("cols").to_pylist(), rows.column("hs").to_pylist()
            row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
            p = _first_last(row, np.concatenate(cols), np.concatenate([np.array(h, np.int64) for h in hs]).view(np.uint64), len(cols))
            ok = p[:, 0] >= 0
            at = rows.column("at").to_numpy()[ok]
            out = pa.table([rows.column("key").filter(pa.array(ok)), rows.column("n").filter(pa.array(ok)), _long(at - left + p[ok, 0]), _long(at - left + p[ok, 1] + length)], ["key", "n", "start", "end"])
            yield from out.combine_chunks().to_batches()

    large = arrow_map(around.where(F.col("kinds") > group), dealt, "name long, blk long, part long, key long, n long, at long, cols array<long>, hs array<long>")
    large = large.repartition("name", "blk", "part").sortWithinPartitions("name", "blk", "part").mapInArrow(merged, schema)
    return full.unionByName(small).unionByName(large).distinct()


def _cutter(wanted, length: int, field_bits: int):
    """Cuts out the surroundings of wanted places."""

    def cut(t: pa.Table):
        rows = []
        for key, s in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
            b = _bytes(s)
            at = anchors(_Hashed(b), length)
            ids = joint(np.full(len(at), key, np.int64), np.full(len(at), len(b), np.int64), at.astype(np.int64))
            lo, hi = _surroundings(at, len(b), length)
            for k in np.flatnonzero(held(wanted.value, ids, field_bits)):
                rows.append((key, len(b), int(at[k]), b[lo[k] : hi[k]].tobytes()))
        yield pa.table([pa.array([r[i] for r in rows], _LONG if i < 3 else pa.binary()) for i in range(4)], ["key", "n", "at", "around"])

    return cut


def _first_last(row: np.ndarray, col: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """For each row its first and last column whose (column, hash) another row has too; -1 if none."""
    out = np.full((rows, 2), -1, np.int64)
    if not len(row):
        return out
    order = np.lexsort((h, col))
    same = (col[order][1:] == col[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice = np.zeros(len(row), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    r, c = row[twice], col[twice]
    first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    np.minimum.at(first, r, c)
    np.maximum.at(last, r, c)
    ok = last >= 0
    out[ok, 0], out[ok, 1] = first[ok], last[ok]
    return out


def _key(text: str):
    """A 64-bit key of a text; with its number of bytes it stands for the text."""
    return F.xxhash64(F.col(text), F.octet_length(text))


def remove_repeats(docs: DataFrame, length: int = 400, field_bits: int = 26, group: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes), kept_sha256 of every row of docs."""
    spans = repeated_spans(docs, length, field_bits, group, text)
    by_text = materialise(spans.groupBy("key", "n").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("t"), F.xxhash64(body, F.octet_length(body)).alias("key"), F.octet_length(body).cast("long").alias("n"))
    rows = rows.join(by_text, ["key", "n"], "left").select("doc_id", "t", F.transform("spans", lambda x: x["start"]).alias("starts"), F.transform("spans", lambda x: x["end"]).alias("ends"))

    def cut(t: pa.Table):
        out = []
        for d, s, starts, ends in zip(*(c.to_pylist() for c in t.columns), strict=True):
            b, runs, kept, at = s.encode("utf-8", "surrogatepass"), 0, [], 0
            for x, y in sorted(zip(starts or (), ends or (), strict=True)):
                if x > at or not runs:
                    kept.append(b[at:x])
                    runs += 1
                    at = y
                else:
                    at = max(at, y)
            kept = b"".join([*kept, b[at:]])
            out.append((d, len(b), len(b) - len(kept), runs, kept, hashlib.sha256(kept).hexdigest()))
        kinds = [_LONG] * 4 + [pa.binary(), pa.string()]
        yield pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return arrow_map(rows, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
