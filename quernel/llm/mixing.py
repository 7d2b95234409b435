"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target words over source words. Its
whole part is taken outright; the fractional parts are rounded by the pivotal method: two documents with
open probabilities meet, words move from one to the other until one of the two is integral (in which direction is
random, with odds that keep each document's expectation), and the other goes on. Since words move, what a source
takes is its target but for the one document that stays open at last. Documents meet from the largest to the smallest,
so that this is usually a small one. Groups of (source, salt) are rounded in parallel, each leaves at most one open
document, and a reduction tree joins these residuals until one a source is left, which a coin decides.

Targets: sources go by code point with null last and take the weights in turn; each is due its share of all words by
weight, stopped at `max_repeat` times its own words, and what a stopped source can't take is shared again. That is a
water level, found by repeated aggregates over the table of sources; nothing but sums reaches the driver.

Defined results: a null text has size 0; a source of no words has target 0; documents of size 0 get copies
like any other but take 0 words; rows alike in id, source and size are one document taken so many times: their common
mass is rounded together and dealt out, so any number of null or repeated ids splits evenly; an empty table gives an
empty result; further columns of the input are not looked at; ids of all 64 bits come back as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, free_name, lookup, materialise, may_hold, measured, mix64

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def water_level(sources: DataFrame, total: int, max_repeat: int) -> tuple[int, int]:
    """(left, parts): an open source's target is its weight times left / parts; one that would pass its stop takes the stop.

    As the level only rises, who is stopped follows from the level alone. sources: words, weight.
    """
    left, parts, first = total, None, True
    while True:
        over = F.lit(False) if first else F.lit(parts).cast("decimal(38,0)") * max_repeat * F.col("words") < F.lit(left).cast("decimal(38,0)") * F.col("weight")
        stopped, open_ = sources.agg(F.sum(F.when(over, max_repeat * F.col("words").cast("decimal(38,0)")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        now = (total - int(stopped or 0), int(open_ or 0))
        if not first and (now == (left, parts) or not now[1]):
            return now
        (left, parts), first = now, False


def targets(sizes: DataFrame, weights=(1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """The rows of sizes (source, words, ...), one a source, with target (double), written."""
    # places in the order of all sources: places within ranges, and how many sources lie in the ranges before
    order = F.struct(F.col("source").isNull(), "source")
    placed = materialise(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id()), "places")
    place, before, offsets = F.col("place").bitwiseAND((1 << 33) - 1), 0, []
    by_range = F.shiftright("place", 33)
    total = placed.agg(F.sum("words")).first()[0] or 0
    for r in placed.groupBy(by_range.alias("range")).count().orderBy("range").collect():  # a row a partition
        offsets.append((r["range"], before))
        before += r["count"]
    spark = sizes.sparkSession
    ranges = F.broadcast(spark.createDataFrame(offsets, "range long, before long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("before") + place, F.lit(len(weights))) + 1).cast("int"))
    weighed = placed.withColumn("range", by_range).join(ranges, "range").withColumn("weight", weight).drop("range", "before", "place")
    left, parts = water_level(weighed, total, max_repeat)
    stop = max_repeat * F.col("words")
    due = F.lit(left).cast("double") * F.col("weight") / F.lit(max(1, parts)).cast("double")
    over = F.lit(not parts) | (F.lit(parts).cast("decimal(38,0)") * stop < F.lit(left).cast("decimal(38,0)") * F.col("weight"))
    out = materialise(weighed.withColumn("target", F.when(over, stop.cast("double")).otherwise(due)), "targets")
    drop(placed)
    return out


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on id and seed alone."""
    with np.errstate(over="ignore"):
        z = mix64(ids.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
    return (z >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivotal(p: np.ndarray, w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Sequential pivotal rounding of p (each in [0, 1]) that keeps the sum of p w; u: random numbers; at most one entry stays open."""
    out, held = p.astype(np.float64).copy(), -1
    for i in range(len(out)):
        if out[i] < EPS or out[i] > 1 - EPS:
            out[i] = round(out[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - out[a]) * w[a], out[b] * w[b])  # what a can take and b can give
        down = min(out[a] * w[a], (1 - out[b]) * w[b])
        move = up if u[i] * (up + down) < down else -down
        for k, d in ((a, move), (b, -move)):
            x = out[k] + d / w[k]
            out[k] = round(x) if x < EPS or x > 1 - EPS else x
        held = next((k for k in (a, b) if 0 < out[k] < 1), -1)
    return out


_SCHEMA = "doc_id long, source string, size long, rows long, source_size long, target double, copies long, open double, up long"


def mix(docs: DataFrame, weights=(1, 2, 3), max_repeat: int = 3, seed: int = 7, group_rows: int = 4096, fan_in: int = 64, broadcast_sources: int = 100_000, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, source, size, source_size, target, copies (long) and taken (copies times size) of every row of docs.

    Up to broadcast_sources sources (rows of some 50 bytes) go to all tasks; of more, the hot ones only.
    """
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("key")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialise(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")).withColumn("key", key), "sizes")
    by_source = targets(sized.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.count("*").alias("n")), weights, max_repeat)
    sources, most = by_source.agg(F.count("*"), F.max("n")).first()
    plan = by_source.select("key", F.col("words").alias("source_size"), "target", "n")
    told = sized.join(F.broadcast(plan), "key") if sources <= broadcast_sources else lookup(sized, plan, "key", "n")
    # what all rows of a document have in common is whole; of their fractions one row at most stays open
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mass = F.greatest(F.lit(0.0), ratio - F.floor(ratio + EPS)) * F.col("rows")
    copies = F.floor(ratio + EPS).cast("long") * F.col("rows") + F.floor(mass + EPS).cast("long")
    told = told.withColumn("copies", copies).withColumn("open", F.greatest(F.lit(0.0), mass - F.floor(mass + EPS)))
    told = told.withColumn("up", F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n") / group_rows)).cast("long"))

    def rounded(step: int):
        def go(t: pa.Table) -> pa.Table:
            size, ids = t.column("size").to_numpy(), t.column("doc_id").fill_null(-1).to_numpy()
            order = np.lexsort((t.column("doc_id").is_null().to_numpy(), ids, -size))
            t, size, ids = t.take(pa.array(order)), size[order], ids[order]
            p = pivotal(t.column("open").to_numpy(), np.maximum(size, 1), _uniform(np.ascontiguousarray(ids), seed + step))
            return t.set_column(t.schema.get_field_index("open"), "open", pa.array(p))

        return go

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        done = F.col("open").isin(0.0, 1.0)
        return df.where(done), df.where(~done)

    told = told.select(*[c.split()[0] for c in _SCHEMA.split(", ")])
    written = [materialise(told.groupBy("source", "up").applyInArrow(rounded(0), _SCHEMA), "rounded")]
    done, left = split(written[0])
    parts, step, width = [done], 0, -(-(most or 0) // group_rows)
    while width > 1:  # the reduction tree over residuals
        step, width = step + 1, -(-width // fan_in)
        left = left.withColumn("up", F.floor(F.col("up") / fan_in).cast("long"))
        written.append(materialise(left.groupBy("source", "up").applyInArrow(rounded(step), _SCHEMA), "rounded"))
        done, left = split(written[-1])
        parts.append(done)
    coin = F.pmod(F.xxhash64("source", "doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    parts.append(left.withColumn("open", F.when(coin < F.col("open"), 1.0).otherwise(0.0)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    # back to rows: the copies of a document dealt out evenly; numbers in blocks, so that no array is long
    out = out.withColumn("copies", F.col("copies") + F.col("open").cast("long"))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    out = out.withColumn("k", F.explode(numbers(F.ceil(F.col("rows") / 4096))))
    out = out.withColumn("i", F.explode(numbers(F.least(F.lit(4096).cast("long"), F.col("rows") - F.col("k") * 4096)))).withColumn("i", F.col("k") * 4096 + F.col("i"))
    each = F.floor(F.col("copies") / F.col("rows")) + (F.col("i") < F.pmod("copies", "rows")).cast("long")
    out = out.select("doc_id", "source", "size", "source_size", "target", each.cast("long").alias("copies"), (each * F.col("size")).cast("long").alias("taken"))
    drop(sized, by_source)
    return out


def with_copies(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that mixed takes, with their number of copies in a last column `copies` (or the first of copies_1,
    copies_2, ... that docs hasn't).

    An id names one document; each row that repeats it, null ids among them, carries the copies of all its rows. Of the
    rows that the mix doesn't take, few are shuffled: a bit field of the ids taken drops the others where they are.
    """
    key = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit("null")).alias("key")
    n, seen = measured(mixed.groupBy(key("doc_id"), F.col("doc_id").alias("id")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"), "copies")
    taken, id = may_hold(n.select("id").where("id is not null"), seen["n"]), F.col(doc_id).cast("long")
    rows = docs.where(id.isNull() | taken(id)).select(key(doc_id), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return lookup(rows, n.drop("id"), "key", "rows").select("row.*", F.col("copies").alias(free_name(docs, "copies")))
