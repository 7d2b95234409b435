"""N-gram Jaccard join by signature trees.

Words are runs of anything but ASCII white space with A-Z lower-cased; a document's set holds its distinct
n-word shingles as 64-bit hashes (with fewer words, the whole sequence as one; without words it is empty and
links with nothing). Two documents link when 100 |A and B| >= percent |A or B|. The result is the classes of
documents that links connect.

Copies (equal sets) fold into one node first, known by the 64-bit key of one of its texts. The tree above the
leaves is spread over the cluster by routing bits: a node hangs under its least shingle hashes (all, if it has no
more than `k`), so two nodes under different bits have no token in common there and their pair is pruned without
being formed. Below a routing bit stands a signature tree: leaves are nodes with a token bitmap of eight to sixteen
bits a shingle, inner nodes the OR of their children's bitmaps with their range of sizes, and the dual traversal
drops a pair of nodes when the most shingles that members could share (common bits plus collisions), or their sizes,
rule a link out, or when all members are known to be connected. What remains is verified on the exact sets: of the two
ends of a pair the one with more pairs is the hub, the texts of the others pass by its set, which is made once a task.
A pair is formed only under the least bit that both have.

Large classes stay cheap by rounds. First, under each bit all nodes are compared with one leader only, so a group of n
near copies costs n comparisons and then counts as connected. Then the traversal gives each node only the partner
that could share most with it among those not yet connected, again as long as half of such pairs prove to be links; at
last it gives all pairs that are left. No pair is verified twice. Bits of more than `hot` nodes are left out for those
nodes that have `least` other bits, and large bits are dealt out in blocks of `block` nodes of like size, pair of
blocks by pair of blocks. Two linked nodes share none of their least `least` bits with a chance of about
(1 - percent / 100)^least, 1e-14 as set here; where all they share are bits left out, a node with 20 % of its own goes
by its own bits alone with a chance of about 2e-10 (20 of 25), and then only the leader comparison may link it. With
`exact` no chance is left: a node of n shingles hangs under its n - ceil(percent n / 100) + 1 least hashes, no bit is
left out, and any two linked nodes share one of these (the prefix principle); it costs rows in proportion.

Defined results: null text and text without words: 0 shingles, component is the document itself; a null
doc_id gets a null component and takes no part; a repeated row gets the same result each time; texts that share an
id are compared each for itself; an empty table gives an empty result; further columns are not looked at; texts of
any length are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, bit_field, components, drop, field_bits, groups, held, joint, lookup, materialise, measured, mix64 as _mix, without

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order: differences of a polynomial prefix sum over the bytes."""
    b = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    if not len(b):
        return np.zeros(0, np.uint64)
    white = _WHITE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, np.uint64(len(w) if size < n else n), np.uint64)
    for i in range(size):
        h = _mix(h * _BASE + w[i : len(w) - size + 1 + i])
    return np.unique(h)


def _digest(s: np.ndarray) -> int:
    """A 64-bit hash of a set of shingles, 0 for the empty one."""
    both = np.array([int(np.bitwise_xor.reduce(_mix(s * _BASE))) ^ int(s.sum(dtype=np.uint64))] if len(s) else [], np.uint64)
    return int(_mix(both + np.uint64(len(s))).view(np.int64)[0]) if len(s) else 0


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bitmap of 8 to 16 bits a shingle (256 to 2^18 bits) as 64-bit words; halves of a longer one OR into a shorter one."""
    bits = 1 << min(18, max(8, 3 + int(max(1, len(s)) - 1).bit_length()))
    at = np.zeros(bits, bool)
    at[(s >> np.uint64(7)) & np.uint64(bits - 1)] = True
    return np.packbits(at, bitorder="little").view(np.uint64)


def _fold(m: np.ndarray, words: int) -> np.ndarray:
    while m.shape[-1] > words:
        h = m.shape[-1] // 2
        m = m[..., :h] | m[..., h:]
    return m


class Tree:
    """Nodes by level, leaves first: OR bitmaps, ranges of sizes and components, and the most collisions."""

    FAN = 4

    def __init__(self, sig: np.ndarray, n: np.ndarray, comp: np.ndarray):
        collisions = n - np.bitwise_count(sig).sum(1, dtype=np.int64)
        self.levels = [(sig, n, n, comp, comp, collisions)]
        while len(self.levels[-1][1]) > self.FAN:
            at = np.arange(0, len(self.levels[-1][1]), self.FAN)
            ops = (np.bitwise_or, np.minimum, np.maximum, np.minimum, np.maximum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, at, axis=0) for f, x in zip(ops, self.levels[-1], strict=True)))


def traverse(x: Tree, y: Tree, percent: int, chunk: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (leaf of x, leaf of y) that neither overlap bounds, sizes nor components rule out, and what they could share
    to the sum of their sizes; x is y: each pair once."""
    depth = max(len(x.levels), len(y.levels))
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    grown = lambda t, k: k < len(t.levels)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(len(level(x, depth - 1)[1])), np.arange(len(level(y, depth - 1)[1])), indexing="ij"))
    for k in range(depth - 1, -1, -1):
        if x is y:
            i, j = i[i <= j], j[i <= j]
        a, b = level(x, k), level(y, k)
        # sizes within the ratio, and not all of one component
        ok = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i]) & ~((a[3][i] == a[4][i]) & (b[3][j] == b[4][j]) & (a[3][i] == b[3][j]))
        i, j = i[ok], j[ok]
        keep, score = np.ones(len(i), bool), np.zeros(len(i))
        step = max(1, chunk // a[0].shape[1])
        for s in range(0, len(i), step):
            p, q = i[s : s + step], j[s : s + step]
            most = np.bitwise_count(a[0][p] & b[0][q]).sum(1, dtype=np.int64) + np.minimum(a[5][p], b[5][q])
            keep[s : s + step] = most * (100 + percent) >= percent * (a[1][p] + b[1][q])
            score[s : s + step] = most / (a[1][p] + b[1][q])
        i, j, score = i[keep], j[keep], score[keep]
        if k:  # to the children
            ci = [(i[:, None] * Tree.FAN + np.arange(Tree.FAN)) if grown(x, k) else i[:, None], (j[:, None] * Tree.FAN + np.arange(Tree.FAN)) if grown(y, k) else j[:, None]]
            i, j = (np.broadcast_to(c, (len(i), ci[0].shape[1], ci[1].shape[1])).ravel() for c in (ci[0][:, :, None], ci[1][:, None, :]))
            inside = (i < len(level(x, k - 1)[1])) & (j < len(level(y, k - 1)[1]))
            i, j = i[inside], j[inside]
    ok = i < j if x is y else np.ones(len(i), bool)
    return np.stack([i[ok], j[ok]], 1), score[ok]


def _class(n: np.ndarray, percent: int) -> np.ndarray:
    """Size classes so wide that linked documents are in the same or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)


def join_group(n: np.ndarray, comp: np.ndarray, sigs: list[bytes], percent: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows of one routing bit, by a tree for each size class, and their scores; with side, only across sides 0 and 1."""
    by, cls = {}, _class(n, percent)
    for c in np.unique(cls):
        for s in (None,) if side is None else (0, 1):
            k = np.flatnonzero(cls == c) if s is None else np.flatnonzero((cls == c) & (side == s))
            if len(k):
                k = k[np.lexsort((n[k], comp[k]))]
                maps = [np.frombuffer(sigs[i], np.uint64) for i in k]
                words = min(len(m) for m in maps)
                by[c, s] = k, np.stack([_fold(m, words) for m in maps])
    pairs, scores = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    tree = lambda k, sig: Tree(sig, n[k], comp[k])
    for (c, s), (k, sig) in by.items():
        for c2, s2 in ((c, s), (c + 1, s)) if side is None else ((c, 1), (c + 1, 1), (c - 1, 1)) if s == 0 else ():
            if (c2, s2) in by:
                k2, sig2 = by[c2, s2]
                words = min(sig.shape[1], sig2.shape[1])
                x = tree(k, _fold(sig, words))
                y = x if (c2, s2) == (c, s) else tree(k2, _fold(sig2, words))
                p, score = traverse(x, y, percent)
                pairs.append(np.stack([k[p[:, 0]], k2[p[:, 1]]], 1))
                scores.append(score)
    return np.concatenate(pairs), np.concatenate(scores)


def _least_common(bits: np.ndarray, p: np.ndarray, bit: int, chunk: int = 1 << 16) -> np.ndarray:
    """Which pairs of rows have bit as the least bit of both; bits is padded with the greatest long."""
    ok, top = np.zeros(len(p), bool), np.iinfo(np.int64).max
    for s in range(0, len(p), chunk):
        a, b = bits[p[s : s + chunk, 0]], bits[p[s : s + chunk, 1]]
        common = (a[:, :, None] == b[:, None, :]).any(2)
        ok[s : s + chunk] = np.where(common, a, top).min(1) == bit
    return ok


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _key(text: str):
    """A 64-bit key of a text."""
    return F.xxhash64(F.col(text), F.octet_length(text))


def _described(docs: DataFrame, ngram: int, percent: int, k: int, exact: bool, doc_id: str, text: str) -> DataFrame:
    def go(t: pa.Table):
        sets = [shingles(s, ngram) for s in t.column(2).to_pylist()]
        bits = [s[: _prefix(len(s), percent) if exact else k] for s in sets]
        yield pa.table({
            "doc_id": t.column(0), "key": t.column(1), "n": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array([_digest(s) for s in sets], pa.int64()),
            "bits": pa.array([s.view(np.int64) for s in bits], pa.list_(pa.int64())), "sig": pa.array([bitmap(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
        })

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _key(text).alias("key"), F.col(text).alias("t"))
    return arrow_map(rows, go, "doc_id long, key long, n long, digest long, bits array<long>, sig binary")


def _verified(docs: DataFrame, pairs: DataFrame, ngram: int, percent: int, text: str, block: int) -> DataFrame:
    """The pairs (a, b) of text keys that link, by their exact sets, written; only texts with these keys are shuffled."""
    ends = pairs.select(F.col("a").alias("end")).unionByName(pairs.select(F.col("b").alias("end")))
    degree, seen = measured(ends.groupBy("end").agg(F.count("*").alias("pairs")), "degree")
    both = lookup(lookup(pairs, degree.select(F.col("end").alias("a"), F.col("pairs").alias("pa")), "a", "pa"), degree.select(F.col("end").alias("b"), F.col("pairs").alias("pb")), "b", "pb")
    up = (F.col("pa") > F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("a") < F.col("b")))
    hubs = both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("key"), F.ceil(F.greatest("pa", "pb") / block).alias("parts"))
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    # the hub comes first in each of its parts
    hubs = materialise(hubs.select("key", "hub", part.alias("part"), F.lit(1).alias("role")).unionByName(hubs.select(F.col("hub").alias("key"), "hub", part.alias("part"), F.lit(0).alias("role")).distinct()), "hubs")
    bits = field_bits(seen["n"])
    field = docs.sparkSession.sparkContext.broadcast(bit_field(degree, ["end"], bits))

    def wanted(t: pa.Table):
        yield t.filter(pa.array(held(field.value, joint(t.column(0).to_numpy()), bits)))

    texts = arrow_map(docs.where(F.col(text).isNotNull()).select(_key(text).alias("key"), F.col(text).alias("t")), wanted, "key long, t string")
    rows = hubs.join(texts.groupBy("key").agg(F.first("t").alias("t")), "key").select("hub", "part", "role", "key", "t")

    def go(batches):
        at, hub = None, None
        for b in batches:
            out = []
            for h, part, role, key, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingles(t, ngram)
                if role == 0:
                    at, hub = (h, part), s
                elif at == (h, part):
                    both = len(np.intersect1d(hub, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(hub) + len(s) - both):
                        out.append((min(h, key), max(h, key)))
            yield pa.record_batch({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    links = materialise(rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").mapInArrow(go, "a long, b long"), "links")
    field.unpersist()
    drop(degree, hubs)
    return links


def cluster(docs: DataFrame, percent: int = 80, ngram: int = 5, k: int = 25, least: int = 20, hot: int = 256, block: int = 2048, exact: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    described = materialise(_described(docs, ngram, percent, k, exact, doc_id, text), "described")
    # equal sets are one node, named by the least key of its texts
    full = described.where("n > 0 and doc_id is not null")
    nodes = full.groupBy("digest").agg(F.min("key").alias("node"), F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sig").alias("sig"))
    nodes = materialise(nodes, "nodes")
    slim = materialise(described.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")), "slim")
    drop(described)
    under = nodes.select("node", "n", F.explode("bits").alias("bit"))
    by_bit = materialise(under.groupBy("bit").agg(F.count("*").alias("members"), F.min_by("node", F.xxhash64("node")).alias("leader")).where("members > 1"), "bits")
    members = materialise(lookup(under, by_bit, "bit", "members"), "members")
    drop(by_bit)
    # leaders: a node's is the one it shares most bits with
    votes = members.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("votes"), F.min("n").alias("n"))
    stars = votes.where(F.col("votes") >= F.least(F.col("n"), F.lit(k)) * 0.3).groupBy("node").agg(F.max_by("leader", F.struct("votes", "leader")).alias("leader"))
    tried = materialise(stars.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "pairs")
    links = _verified(docs, tried, ngram, percent, text, block)
    # the bits that the traversal uses
    common = members.where(F.lit(not exact) & (F.col("members") > hot)).groupBy("node").agg(F.collect_list("bit").alias("hot_bits"))
    rest = F.array_except("bits", F.coalesce("hot_bits", F.array().cast("array<bigint>")))
    used = F.col("bits") if exact else F.array_sort(F.when(F.size(rest) >= least, F.slice(rest, 1, least)).otherwise(F.col("bits")))
    routed = materialise(nodes.join(common, "node", "left").select("node", "n", "sig", used.alias("bits")), "routed")
    names = materialise(nodes.select("node", "digest", "first", "copies"), "names")
    drop(nodes)
    leaves = materialise(members.join(routed.select("node", F.explode("bits").alias("bit")), ["node", "bit"], "left_semi").select("node", "n", "bit"), "leaves")
    drop(members)
    comp, best = components(links), True
    while True:
        left = materialise(leaves.join(comp, "node", "left").select("bit", "node", "n", F.coalesce("component", "node").alias("comp")), "left")
        under, sizes = _candidates(left, routed, percent, block, best)
        under = materialise(under, "under")
        drop(left, sizes)
        # connecting more nodes only takes pairs away, so a bit that gave none is done with
        bits = materialise(under.groupBy("bit").agg(F.max("total").alias("total")), "bits")
        fewer = materialise(lookup(leaves, bits, "bit", "total").select("node", "n", "bit"), "leaves")
        drop(leaves, bits)
        leaves = fewer
        found, seen = measured(under.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        drop(under)
        if seen["n"]:
            more = _verified(docs, found, ngram, percent, text, block)
            new = more.count()
            if new:
                old, comp = comp, components(more.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))))
                drop(old)
            both = materialise(tried.unionByName(found), "pairs") if best else tried
            drop(more, found, *([tried] if best else []))
            tried = both
        if not best:
            break
        best = bool(seen["n"]) and 2 * new >= seen["n"]
    # classes of copies and links between nodes, back to documents
    classed = materialise(names.join(comp, "node", "left").select("digest", "first", "copies", F.coalesce("component", "node").alias("class")), "classed")
    least_id = materialise(classed.groupBy("class").agg(F.min("first").alias("component"), F.count("*").alias("members")), "least")
    final = materialise(lookup(classed, least_id, "class", "members").select("digest", "copies", "component"), "final")
    out = lookup(slim, final, "digest", "copies", "left")
    out = materialise(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), "classes")
    drop(slim, names, links, tried, routed, leaves, comp, classed, least_id, final)
    return out


def _candidates(left: DataFrame, routed: DataFrame, percent: int, block: int, best: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, bit, total: how many nodes the bit has) that the dual traversal leaves, and the work table it reads besides;
    left: bit, node, n, comp; best: for each node under a bit only the likeliest."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9)
    here = left.withColumn("cls", size_class)
    # how many nodes of each size class a bit has, where not all of them are connected yet
    per = here.groupBy("bit", "cls").agg(F.count("*").alias("m"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    per = per.groupBy("bit").agg(F.sum("m").alias("total"), F.min("c1").alias("c1"), F.max("c2").alias("c2"), F.map_from_entries(F.collect_list(F.struct("cls", "m"))).alias("sizes")).where("c1 <> c2")
    per = materialise(per.select("bit", "total", "sizes"), "sizes")
    # a task is (bit, part): small bits whole; large ones by pairs of blocks of near sizes
    rows = lookup(here, per, "bit", "total")
    blocks = lambda c: F.coalesce(F.ceil(F.element_at("sizes", c) / block).cast("int"), F.lit(0))
    mine = F.pmod(F.xxhash64("node"), blocks(F.col("cls"))).cast("int")
    series = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda c, i, d, j: F.concat_ws(":", c, i, d, j)
    within = F.transform(series(blocks(F.col("cls"))), lambda o: F.struct(name(F.col("cls"), F.least(mine, o), F.col("cls"), F.greatest(mine, o)).alias("part"), F.when(mine <= o, 0).otherwise(1).alias("side")))
    up = F.transform(series(blocks(F.col("cls") + 1)), lambda o: F.struct(name(F.col("cls"), mine, F.col("cls") + 1, o).alias("part"), F.lit(0).alias("side")))
    down = F.transform(series(blocks(F.col("cls") - 1)), lambda o: F.struct(name(F.col("cls") - 1, o, F.col("cls"), mine).alias("part"), F.lit(1).alias("side")))
    whole = F.array(F.struct(F.lit("").alias("part"), F.lit(0).alias("side")))
    parts = F.when(F.col("total") <= block, whole).otherwise(F.concat(within, up, down))
    tasks = rows.select("bit", "total", "node", "n", "comp", F.explode(parts).alias("x")).select("bit", "total", "x.part", "x.side", "node", "n", "comp")
    tasks = tasks.withColumn("task", F.xxhash64("bit", "part")).join(routed.select("node", "sig", "bits"), "node")
    tasks = tasks.repartition("task").sortWithinPartitions("task", "bit")

    def run(batches):
        for rows in groups(batches, ["task", "bit"]):
            n, ids, comp, bit = rows.column("n").to_numpy(), rows.column("node").to_numpy(), rows.column("comp").to_numpy(), rows.column("bit")[0].as_py()
            part = rows.column("part")[0].as_py().split(":")
            across = len(part) == 4 and part[:2] != part[2:]
            p, score = join_group(n, comp, rows.column("sig").to_pylist(), percent, rows.column("side").to_numpy() if across else None)
            lists = rows.column("bits").to_pylist()
            bits = np.full((len(lists), max(map(len, lists))), np.iinfo(np.int64).max)
            for i, x in enumerate(lists):
                bits[i, : len(x)] = x
            ok = _least_common(bits, p, bit)
            p, score = p[ok], score[ok]
            if best and len(p):
                row, other = np.concatenate([p[:, 0], p[:, 1]]), np.concatenate([p[:, 1], p[:, 0]])
                order = np.lexsort((ids[other], -np.concatenate([score, score]), row))
                first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
                p = np.unique(np.sort(np.stack([row[first], other[first]], 1), 1), axis=0)
            a, b, total = ids[p[:, 0]], ids[p[:, 1]], rows.column("total")[0].as_py()
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (np.minimum(a, b), np.maximum(a, b), np.full(len(p), bit), np.full(len(p), total))], ["a", "b", "bit", "total"])

    return tasks.select("task", "bit", "total", "part", "side", "node", "n", "comp", "sig", "bits").mapInArrow(run, "a long, b long, bit long, total long"), per


def keep_one(docs: DataFrame, percent: int = 80, ngram: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class, that of the least id (each row of it where the id repeats); rows without an id stay."""
    classes = cluster(docs, percent, ngram, doc_id=doc_id, text=text)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), row)
    out = without(rows, "id", classes.where("doc_id <> component_id").select("doc_id"), classes.where("doc_id = component_id").select("doc_id"))
    drop(classes)
    return out.select("row.*")
