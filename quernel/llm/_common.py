"""Shared pieces of the corpus operators: work tables, chunked Arrow maps, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker holds at once besides its Arrow batch.
CHUNK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/quernel-work"
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    """The Hadoop file system of path, and path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts its lineage.

    The table goes with `drop`, at the latest when the session's JVM ends.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/quernel-{uuid.uuid4().hex}"
    df.write.parquet(f"{top}/{name}")
    fs, at = _path(spark, top)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(f"{top}/{name}")
    out._quernel_top = top
    return out


def work_folder(spark: SparkSession) -> str:
    """A new folder's path in the shared folder, for files; it goes with `drop`, at the latest when the session's JVM ends."""
    path = f"{shared_dir(spark)}/quernel-{uuid.uuid4().hex}"
    fs, at = _path(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def drop(*tables: DataFrame, folder: str | None = None) -> None:
    """Deletes work tables (and a work folder) that nothing reads any more; shuffle files of finished jobs go with the
    collection that follows."""
    if folder:
        fs, at = _path(tables[0].sparkSession, folder)
        fs.delete(at, True)
    for df in tables:
        fs, at = _path(df.sparkSession, df._quernel_top)
        fs.delete(at, True)
    if tables:
        gc.collect()  # lets go of the plans that Python still holds
        tables[0].sparkSession._jvm.System.gc()


def measured(df: DataFrame, name: str, **sums) -> tuple[DataFrame, dict]:
    """materialise, with the number of rows as n and further aggregates of what was written."""
    out = materialise(df, name)
    return out, out.agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()]).first().asDict()


#: Below so many rows in all, a hot key is no burden for a task and gets no treatment of its own.
FEW_ROWS = 200_000


def lookup(rows: DataFrame, table: DataFrame, on: str, weight: str, how: str = "inner") -> DataFrame:
    """rows joined by `on` with table, which has one row a key and in `weight` about how many of rows that key has.

    Keys of more than a thousandth of all rows, fewer than a thousand in all whatever the size, are broadcast, so their
    rows stay where they are; the others meet by a shuffle. Both inputs should be written tables, they are read twice.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    if total <= FEW_ROWS:
        return rows.join(table, on, how)
    hot = F.col(weight) > max(total / 1000, 1000)
    few, rest = table.where(hot), table.where(~hot)
    there = rows.join(F.broadcast(few), on)
    return there.unionByName(rows.join(F.broadcast(few.select(on)), on, "left_anti").join(rest, on, how).select(*there.columns))


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2, ... that is no column of df."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if x.lower() not in taken)


def arrow_map(df: DataFrame, fn: Callable[[pa.Table], Iterator[pa.Table]], schema: str | StructType) -> DataFrame:
    """mapInArrow in chunks of about CHUNK_BYTES; fn yields tables of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(schema if isinstance(schema, StructType) else df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            n, size = batch.num_rows, batch.get_total_buffer_size()
            step = max(1, n if not size else int(n * CHUNK_BYTES / max(size, CHUNK_BYTES)))
            for at in range(0, n, step):
                for out in fn(pa.Table.from_batches([batch.slice(at, min(step, n - at))])):
                    yield from out.cast(types).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) lead from each u to one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    state = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return state.agg(F.count_if((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("low") == 0)))).first()[0] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the undirected edges, written; component is the smallest node reachable.

    Large-star and small-star rounds, alternating, until all edges lead from a node to its component: each round a
    minimum by node with map-side combining and a join. A node with more than a thousandth of all edges takes part by a
    broadcast of its minimum (fewer than a thousand such nodes), so its neighbours never meet in one task. The edges are
    written after each round.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e, seen = measured(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while seen["n"] and not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        upper = both.where("v > u")
        if seen["n"] <= FEW_ROWS:
            large = upper.join(low.select("u", "m"), "u")
        else:
            hot = F.col("c") > seen["n"] / 500
            few = F.broadcast(low.where(hot).select("u", "m"))
            large = upper.join(few, "u").unionByName(upper.join(few, "u", "left_anti").join(low.where(~hot).select("u", "m"), "u").select("u", "v", "m"))
        # every edge now leads from a node to a smaller one; by the upper end, few edges each
        e2 = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").repartition("u").dropDuplicates(["u", "v"])
        low = e2.groupBy("u").agg(F.min("v").alias("m"))
        small = e2.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new, seen = measured(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        drop(e)
        e = new
    out = materialise(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    drop(e)
    return out


def groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from Arrow batches that are sorted by them; a group may span batches."""
    parts: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
            if parts:
                change[0] |= bool(v[0] != parts[-1].column(k)[-1].as_py())
        at = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            if a == b:
                continue
            if change[a] and parts:
                yield pa.concat_tables(parts).combine_chunks()
                parts = []
            parts.append(t.slice(a, b - a))
    if parts:
        yield pa.concat_tables(parts).combine_chunks()


def mix64(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def joint(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit value for the longs of each row."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + c.view(np.uint64))
    return out


def _places(v: np.ndarray, bits: int):
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        yield mix64(v * np.uint64(salt)) >> np.uint64(64 - bits)


def field_bits(n: int) -> int:
    """The size of a field for n rows: sixteen bits a row, 2^16 to 2^30 in all (128 MB); a fuller field costs work only."""
    return min(30, max(16, 4 + max(1, n).bit_length()))


def bit_field(values: DataFrame, columns: list[str], bits: int) -> np.ndarray:
    """A field of 2^bits bits with two set for each row of longs.

    Tasks OR their rows into a field and emit it in pieces of 64 KB; these are OR-ed in two levels, the first of 512
    tasks each, so no task holds more than some ten MB a level; 2^bits / 8 bytes reach the driver, whatever the number
    of rows. A false hit must cost work only, so an exact join has to follow.
    """
    piece, fan = 1 << 16, 512

    def partial(batches):
        field, seen = np.zeros(1 << bits >> 3, np.uint8), False
        for b in batches:
            for at in _places(joint(*(c.to_numpy(zero_copy_only=False) for c in b.columns)), bits):
                np.bitwise_or.at(field, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            seen = seen or b.num_rows > 0
        slot = TaskContext.get().partitionId() // fan
        for i in range(-(-len(field) // piece)) if seen else ():
            x = field[i * piece : (i + 1) * piece]
            if x.any():
                yield pa.record_batch({"i": pa.array([i], pa.int32()), "slot": pa.array([slot], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})

    def united(t: pa.Table) -> pa.Table:
        x = np.bitwise_or.reduce([np.frombuffer(v.as_buffer(), np.uint8) for v in t.column("x")])
        return pa.table({"i": t.column("i").slice(0, 1), "slot": t.column("slot").slice(0, 1), "x": pa.array([x.tobytes()], pa.binary())})

    schema, out = "i int, slot int, x binary", np.zeros(1 << bits >> 3, np.uint8)
    level = values.select(*columns).mapInArrow(partial, schema)
    if bits > 24:  # a smaller field is of less than a million rows and so of few tasks
        level = level.groupBy("i", "slot").applyInArrow(united, schema)
    for r in level.groupBy("i").applyInArrow(united, schema).collect():
        out[r["i"] * piece : r["i"] * piece + len(r["x"])] = np.frombuffer(r["x"], np.uint8)
    return out


def held(field: np.ndarray, v: np.ndarray, bits: int) -> np.ndarray:
    """Which values (of joint) may be in the field."""
    ok = np.ones(len(v), bool)
    for at in _places(v, bits):
        ok &= (field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return ok


def may_hold(ids: DataFrame, n: int):
    """A function of a long column: whether ids, a written table of n rows of one long column, may hold it; no false no."""
    bits = field_bits(n)
    field = ids.sparkSession.sparkContext.broadcast(bit_field(ids, ids.columns, bits))

    @F.arrow_udf("boolean")
    def test(v: pa.Array) -> pa.Array:
        return pa.array(held(field.value, joint(v.fill_null(0).to_numpy(zero_copy_only=False)), bits))

    return test


def without(rows: DataFrame, id: str, gone: DataFrame, kept: DataFrame) -> DataFrame:
    """rows whose `id` (long) is not in gone; gone and kept, tables of one long column each, hold all ids of rows together.

    A row whose id can't be gone stays and one whose id can't be kept goes, by two bit fields, so rows stay where they
    are. Only the few that may be either are shuffled, to an exact join. A null id stays.
    """
    (gone, n), (kept, m) = (measured(ids.distinct(), "ids") for ids in (gone, kept))
    may_go, may_stay = may_hold(gone, n["n"]), may_hold(kept, m["n"])
    drop(kept)
    unsure = gone.select(F.col(gone.columns[0]).alias(id)).where(may_stay(id))
    sure = rows.where(F.col(id).isNull() | ~may_go(id))
    return sure.unionByName(rows.where(F.col(id).isNotNull() & may_go(id) & may_stay(id)).join(unsure, id, "left_anti").select(*rows.columns))
