"""Incremental upkeep of a chunk table by content hash, and the status of documents."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.work import written
from . import chunking


def manifest_diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """rel_path, status (added, updated, unchanged, removed), hash, old_hash; both sides have rel_path and hash."""
    f, m = files.select("rel_path", "hash"), manifest.select("rel_path", F.col("hash").alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("updated")
    return f.join(m, "rel_path", "full_outer").select("rel_path", status.alias("status"), "hash", "old_hash")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """old with the rows of new inserted or put in place of those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_by_source(chunks: DataFrame, paths: DataFrame, path: str = "source_path") -> DataFrame:
    """chunks without those of the given paths."""
    return chunks.join(paths.select(path).distinct(), path, "left_anti")


def refreshed(old: DataFrame, new: DataFrame, diff: DataFrame, path: str = "source_path") -> DataFrame:
    """The next chunk table: files that changed or went lose their chunks, new ones get theirs; published as one table."""
    stale = diff.where("status in ('updated', 'removed')").select(F.col("rel_path").alias(path))
    fresh = diff.where("status in ('added', 'updated')").select(F.col("rel_path").alias(path))
    return delete_by_source(old, stale, path).unionByName(new.join(fresh, path, "left_semi"))


def next_manifest(manifest: DataFrame, diff: DataFrame, chunks: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """rel_path, hash, chunks, pages after a run; a changed file that gave no chunk, or failed, keeps its old entry."""
    n = chunks.groupBy(F.col("source_path").alias("rel_path")).agg(F.count("*").alias("chunks"), F.max("page").alias("pages"))
    done = diff.where("status in ('added', 'updated')").join(n, "rel_path")
    if failed is not None:
        done = done.join(failed.select("rel_path"), "rel_path", "left_anti")
    done = done.select("rel_path", "hash", "chunks", "pages")
    gone = diff.where("status = 'removed'").select("rel_path")
    return manifest.join(gone, "rel_path", "left_anti").join(done.select("rel_path"), "rel_path", "left_anti").select("rel_path", "hash", "chunks", "pages").unionByName(done)


def report(diff: DataFrame, failed: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: sorted lists of paths by status, failures, and the number of chunks written."""
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("rel_path")))).alias(s)
    lists = diff.agg(*map(names, ("added", "updated", "unchanged", "removed")))
    bad = failed.agg(F.array_sort(F.collect_list(F.struct("rel_path", "error"))).alias("failed"))
    return lists.crossJoin(bad).crossJoin(chunks.agg(F.count("*").alias("chunks_written")))  # each side is one row


def document_status(listing: DataFrame, manifest: DataFrame, failed: DataFrame, warned: DataFrame) -> DataFrame:
    """rel_path, status (error before ok before pending), chunks, error, low_quality."""
    d = listing.select("rel_path").join(manifest.select("rel_path", "chunks"), "rel_path", "left").join(failed.select("rel_path", "error"), "rel_path", "left")
    d = d.join(warned.select("rel_path", F.lit(True).alias("low_quality")).distinct(), "rel_path", "left")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("chunks").isNotNull(), "ok").otherwise("pending")
    return d.select("rel_path", status.alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "error", F.coalesce("low_quality", F.lit(False)).alias("low_quality"))


def collection_stats(chunks: DataFrame) -> DataFrame:
    """One row: count and the sorted distinct source files."""
    return chunks.agg(F.count("*").alias("chunks"), F.array_sort(F.collect_set("source_file")).alias("files"))


def get_by_ids(chunks: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the ids, with what ids carries (their rank, say)."""
    return chunks.join(ids, key)


def append_audit(answers: DataFrame, path: str) -> bool:
    """Appends a JSON line for each answer: question, refused, reason, similarity, sources, sizes. Whether it could be written;
    a failure is logged and goes no further."""
    lines = answers.select(F.unix_timestamp().alias("ts"), "question", "refused", "reason", F.round("top_similarity", 4).alias("top_similarity"), "sources", F.length("answer").alias("answer_chars"), F.round("elapsed_s", 2).alias("elapsed_s"))
    try:
        lines.write.mode("append").json(path)
    except Exception as e:  # whatever keeps the log from being written, the answers stand
        logging.getLogger(__name__).warning("audit not written to %s: %s", path, e)
        return False
    return True


_MANIFEST = "rel_path string, hash string, chunks long, pages int"
_REPORT = "added array<string>, updated array<string>, unchanged array<string>, removed array<string>, failed array<struct<rel_path:string,error:string>>, chunks_written long"
_CHUNK = "chunk_id string, source_path string, source_file string, file_hash string, page int, locator string, section string, chunk_index int, text string, char_count int"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, empty where it isn't there or any of it can't be read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    none = spark.createDataFrame([], schema)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return none
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return none if rows.cache().where("_corrupt is not null").limit(1).count() else rows.drop("_corrupt")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, empty where there is none or it is corrupt (then all files count as new)."""
    return _json(spark, path, _MANIFEST)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select("rel_path", "hash", "chunks", "pages").write.mode("overwrite").json(path)


def write_report(row: DataFrame, path: str) -> None:
    """The report of a run, one JSON line."""
    row.coalesce(1).write.mode("overwrite").json(path)  # one row


def last_report(spark: SparkSession, path: str) -> DataFrame:
    """The report of the last run, no row where there is none."""
    return _json(spark, path, _REPORT)


def run(spark: SparkSession, root: str, folder: str, extract: Callable[[bytes], list[str]] | None = None, reset: bool = False) -> DataFrame:
    """Brings the collection in folder up to date with the files below root; returns the report (one row), which is also written.

    Scan, manifest diff by content hash, load by extension, boilerplate off paged documents, chunks, then one new version of
    the chunk table, with manifest and report beside it in the same version; a version counts from its report on, so a
    run that dies leaves the former one in force. reset: all files count as new.
    """
    versions = published(spark, folder)
    last = f"{folder}/v={versions[-1]}" if versions and not reset else None
    manifest = read_manifest(spark, f"{last}/manifest") if last else spark.createDataFrame([], _MANIFEST)
    old = spark.read.schema(_CHUNK).parquet(f"{last}/chunks") if last else spark.createDataFrame([], _CHUNK)
    here = f"{folder}/v={(versions[-1] if versions else 0) + 1}"
    all_files = files.scan(spark, root, None)
    diff = written(manifest_diff(all_files, manifest), "diff")
    changed = all_files.join(diff.where("status in ('added', 'updated')").select("rel_path"), "rel_path", "left_semi")
    blocks, failed = files.load(changed, extract)
    blocks, failed = written(blocks, "blocks"), written(failed, "failed")
    paged = blocks.where("page is not null").select(F.col("rel_path").alias("doc"), "page", "text", "ord", "locator", "is_row")
    clean = chunking.strip_boilerplate(paged, written(chunking.boilerplate(paged), "boilerplate")).withColumnRenamed("doc", "rel_path")
    blocks = blocks.where("page is null").unionByName(clean.select(*blocks.columns))
    pieces = chunking.chunks(blocks.select("rel_path", "ord", "text", "is_row"))
    about = blocks.select("rel_path", "ord", "is_row", "page", "locator")
    name = F.element_at(F.split("rel_path", "/"), -1)
    new = pieces.join(about, ["rel_path", "ord", "is_row"]).join(diff.select("rel_path", F.col("hash").alias("file_hash")), "rel_path")
    new = written(new.select("chunk_id", F.col("rel_path").alias("source_path"), name.alias("source_file"), "file_hash", "page", "locator", "section", F.col("chunk_index").cast("int").alias("chunk_index"), "text", F.col("char_count").cast("int").alias("char_count")), "chunks")
    # a changed file that gave nothing keeps its former chunks and entry
    gave = diff.where("status = 'removed'").select("rel_path", "status").unionByName(diff.where("status in ('added', 'updated')").join(new.select(F.col("source_path").alias("rel_path")).distinct(), "rel_path", "left_semi").select("rel_path", "status"))
    refreshed(old, new, gave).write.mode("overwrite").parquet(f"{here}/chunks")
    write_manifest(next_manifest(manifest, diff, new, failed), f"{here}/manifest")
    empty = diff.where("status in ('added', 'updated')").join(new.select(F.col("source_path").alias("rel_path")).distinct(), "rel_path", "left_anti").join(failed, "rel_path", "left_anti").select("rel_path", F.lit("no_content").alias("error"))
    write_report(report(diff, failed.unionByName(empty), new), f"{here}/report")
    return last_report(spark, f"{here}/report")


def published(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the complete versions of a collection, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []
    return sorted(int(n[2:]) for n in found if n.startswith("v=") and fs.exists(path(f"{folder}/{n}/report/_SUCCESS")))


def collection(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of the newest complete version, empty where there is none."""
    versions = published(spark, folder)
    return spark.read.schema(_CHUNK).parquet(f"{folder}/v={versions[-1]}/chunks") if versions else spark.createDataFrame([], _CHUNK)
