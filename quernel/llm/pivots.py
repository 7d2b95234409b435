"""Embedding near-duplicates by a pivot-permutation index.

Reference points are fixed random directions, drawn for each number of dimensions from a seed, so nothing is
fitted. A vector is described by its nearest points in their order: `near` of them, the first `lead` of which lead.
It stands in the inverted list of each pair of its points of which one leads; so lists retrieve the vectors that share
two points or more with it, one of them far up in either's order, and the cosine in double precision verifies. Each
pair is counted under one list only, the first that both stand in, so counts need no further deduplication and no list
of pairs leaves a task: a list gives each of its vectors a number of links and the least vector it hangs together with.

Equal vectors fold into one node first, known by a 64-bit hash of its components, with a multiplicity. Lists of more
than `block` vectors are dealt out by pairs of blocks. The number of points grows with the square root of the number
of vectors, without an end, and `near` with its logarithm, so lists stay short and recall above 0.95 (README).

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths don't link; a null vec_id gets 0 links, a null component and kept false; rows
that repeat an id count as vectors of their own, each with the links of its own vector (all with an id equal to their
component are kept); of equally near points the one of lower number counts as nearer; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, components, drop, groups, lookup, materialise, measured


@lru_cache(8)
def points(dims: int, n: int, seed: int) -> np.ndarray:
    """n reference points on the unit sphere of so many dimensions."""
    x = np.random.default_rng([seed, dims]).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # else squares of tiny or huge components under- or overflow
    return x / np.sqrt((x * x).sum(1))[:, None]


def nearest_points(x: np.ndarray, n: int, near: int, seed: int) -> np.ndarray:
    """The numbers of each row's nearest points, nearest first (ties by number)."""
    s = unit(x) @ points(x.shape[1], n, seed).T
    return np.argsort(-s, axis=1, kind="stable")[:, :near]


def first_lists(pa_: np.ndarray, pb: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two permutations the first pair of points (p < q) in whose list both stand; -1 where there is none."""
    k = pa_.shape[1]
    by = np.argsort(pa_, axis=1, kind="stable")
    a, la = np.take_along_axis(pa_, by, 1), by < lead
    same = a[:, :, None] == pb[:, None, :]
    shared, lb = same.any(2), same[:, :, :lead].any(2)
    i, j = np.triu_indices(k, 1)
    ok = shared[:, i] & shared[:, j] & (la[:, i] | la[:, j]) & (lb[:, i] | lb[:, j])
    first, found, at = ok.argmax(1), ok.any(1), np.arange(len(a))
    return np.where(found, a[at, i[first]], -1), np.where(found, a[at, j[first]], -1)


def _list_links(x: np.ndarray, piv: np.ndarray, mult: np.ndarray, pair: tuple[int, int], least: float, lead: int, side: np.ndarray | None, rows: int = 512):
    """(links, label) of a list's vectors: links by multiplicity over pairs counted here; label: least index connected."""
    m = len(x)
    x = unit(x)
    links, label = np.zeros(m, np.int64), np.arange(m)
    ii, jj = [], []
    for a in range(0, m, rows):
        i, j = np.nonzero(x[a : a + rows] @ x.T >= least)
        i = i + a
        ok = i < j if side is None else (side[i] == 0) & (side[j] == 1)
        i, j = i[ok], j[ok]
        for s in range(0, len(i), 1 << 15):
            p, q = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
            first, second = first_lists(piv[p], piv[q], lead)
            here = (first == pair[0]) & (second == pair[1])
            p, q = p[here], q[here]
            np.add.at(links, p, mult[q])
            np.add.at(links, q, mult[p])
            # only what connects is kept on
            low = np.minimum(label[p], label[q])
            np.minimum.at(label, p, low)
            np.minimum.at(label, q, low)
            ii.append(p.astype(np.int32))
            jj.append(q.astype(np.int32))
    if ii and sum(map(len, ii)):
        i, j = np.concatenate(ii), np.concatenate(jj)
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    return links, label


def sizes(total: int) -> tuple[int, int]:
    """How many reference points, and how many of them describe a vector, for so many vectors."""
    bits = max(7, int(np.ceil(np.log2(2 * np.sqrt(max(1, total))))))
    return 1 << bits, 8 + int(np.ceil(1.2 * max(0, bits - 9)))


def near_duplicates(vectors: DataFrame, least: float = 0.9, near: int | None = None, lead: int = 4, seed: int = 3, block: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors; near: points of a description, by default as `sizes` says."""
    v = F.col(embedding).cast("array<double>")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(vec_id).isNotNull()
    node = F.when(F.coalesce(good, F.lit(False)), F.xxhash64(embedding, F.size(embedding))).alias("node")
    rows = materialise(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), node), "rows")
    reps = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), node, F.col(embedding).alias("v")).where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"), F.first("v").alias("v"))
    reps, seen = measured(reps, "vectors")
    n, usual = sizes(seen["n"])
    keep = min(near or usual, n)

    def describe(t: pa.Table):
        ids, vs = t.column("node").to_numpy(), t.column("v").to_pylist()
        size = np.array([len(x) for x in vs])
        for d in np.unique(size):
            k = np.flatnonzero(size == d)
            for s in range(0, len(k), 4096):
                at = k[s : s + 4096]
                p = nearest_points(np.array([vs[i] for i in at], np.float64), n, keep, seed)
                yield pa.table({"node": pa.array(ids[at]), "dims": pa.array(np.full(len(at), d, np.int32)), "piv": pa.array(list(p.astype(np.int32)), pa.list_(pa.int32()))})

    described = materialise(arrow_map(reps.select("node", "v"), describe, "node long, dims int, piv array<int>"), "described")
    # a list for each leading point with each point behind it
    at = lambda i: F.element_at("piv", i)
    behind = lambda i: F.transform(F.slice("piv", i + 1, F.size("piv")), lambda q: F.struct(F.least(at(i), q).alias("p"), F.greatest(at(i), q).alias("q")))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(min(lead, keep - 1))), behind))
    listed = materialise(described.select("node", "dims", F.explode(pairs).alias("k")).select("node", F.struct(F.col("dims").alias("d"), "k.p", "k.q").alias("k")), "listed")
    lists = materialise(listed.groupBy("k").agg(F.count("*").alias("m")).where("m > 1"), "lists")
    blocks = F.ceil(F.col("m") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(mine, o).alias("bi"), F.greatest(mine, o).alias("bj"), F.when(mine <= o, 0).otherwise(1).alias("side")))
    dealt = lookup(listed, lists, "k", "m").select("node", "k", F.explode(others).alias("o")).select("node", "k.*", "o.*")
    keys = ["d", "p", "q", "bi", "bj"]
    heavy = dealt.join(described.select("node", "piv").join(reps.select("node", "v", "mult"), "node"), "node").repartition(*keys).sortWithinPartitions(*keys)

    def verify(batches):
        for t in groups(batches, keys):
            x = np.array(t.column("v").to_pylist(), np.float64)
            ids, side = t.column("node").to_numpy(), t.column("side").to_numpy()
            first = {c: t.column(c)[0].as_py() for c in ("p", "q", "bi", "bj")}
            links, label = _list_links(x, np.array(t.column("piv").to_pylist(), np.int32), t.column("mult").to_numpy(), (first["p"], first["q"]), least, lead, None if first["bi"] == first["bj"] else side)
            k = np.flatnonzero(links)
            yield pa.record_batch({"node": pa.array(ids[k], pa.int64()), "links": pa.array(links[k], pa.int64()), "other": pa.array(ids[label[k]], pa.int64())})

    found = materialise(heavy.select(*keys, "side", "node", "piv", "v", "mult").mapInArrow(verify, "node long, links long, other long"), "links")
    drop(described, listed, lists)
    comp = components(found.where("node <> other"), "node", "other")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    classed = reps.select("node", "first", "mult").join(counted, "node", "left").join(comp, "node", "left")
    classed = materialise(classed.select("node", "first", "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("class")), "classed")
    least_id = materialise(classed.groupBy("class").agg(F.min("first").alias("least"), F.count("*").alias("members")), "least")
    final = materialise(lookup(classed, least_id, "class", "members").select("node", "mult", "n_links", "least"), "final")
    out = lookup(rows, final, "node", "mult", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    out = materialise(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "duplicates")
    drop(rows, reps, found, comp, classed, least_id, final)
    return out
