"""Files and pages to located chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T


def _pieces(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    """Splits at the first separator that occurs (kept at the front of what follows), packs neighbours, recurses on what is too long."""
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[k], separators[k + 1 :]
    if sep:
        head, *tail = text.split(sep)
        parts = [p for p in [head, *(sep + t for t in tail)] if p]
    else:
        parts = list(text)
    out: list[str] = []
    run: list[str] = []

    def pack():
        """Runs of neighbours up to size; each next run starts with the last parts of the one before, up to overlap."""
        held: list[str] = []
        total = 0
        for p in run:
            if held and total + len(p) > size:
                if joined := "".join(held).strip():
                    out.append(joined)
                while held and (total > overlap or total + len(p) > size):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        if joined := "".join(held).strip():
            out.append(joined)
        run.clear()

    for p in parts:
        if len(p) < size:
            run.append(p)
            continue
        pack()
        out.extend(_pieces(p, finer, size, overlap) if finer else [p])
    pack()
    return out


def recursive_split(size: int = X.CHUNK, overlap: int = X.OVERLAP, separators: list[str] = X.SEPARATORS):
    """An Arrow UDF from a text to its pieces of at most size characters."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: _pieces(t, separators, size, overlap) if t else [])

    return split


def text_blocks(files: DataFrame, rel_path: str = "rel_path", text: str = "text") -> DataFrame:
    """rel_path, ord, locator, text: blank-line separated sections; empty ones count for the number but give no block."""
    parts = files.select(F.col(rel_path).alias("rel_path"), F.posexplode(F.split(text, r"\n\s*\n")).alias("p", "raw")).withColumn("text", T.clean_text("raw"))
    return parts.where(F.col("text") != "").select("rel_path", (F.col("p") + 1).alias("ord"), F.concat(F.lit("Bölüm "), F.col("p") + 1).alias("locator"), "text")


def table_blocks(rows: DataFrame, cells: list[str], by: list[str], order: str, per_block: int = 1) -> DataFrame:
    """Blocks of per_block data rows with the header in front; the first row of each table is its header."""
    w = Window.partitionBy(*by).orderBy(order)
    joined = F.array_join(F.array(*[T.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cells]), " | ")
    r = rows.where(F.length(F.regexp_replace(joined, r"[\s|]", "")) > 0).select(*by, F.row_number().over(w).alias("rn"), joined.alias("line"))
    r = r.withColumn("header", F.first("line").over(Window.partitionBy(*by).orderBy("rn"))).where("rn > 1")
    grouped = r.withColumn("block", F.floor((F.col("rn") - 2) / max(1, per_block))).groupBy(*by, "block", "header").agg(F.min(F.col("rn") - 1).alias("start"), F.max(F.col("rn") - 1).alias("end"), F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return grouped.select(*by, "start", "end", F.concat(F.lit(f"{X.TABLE_TAG} "), "header", F.lit("\n"), body).alias("text"))


def page_rows(pages: DataFrame) -> DataFrame:
    """doc, page, ord, is_row, text: pages of three or more table rows, split into their narrative and a block for each row."""
    p = pages.withColumn("lines", F.filter(F.split("text", "\n"), lambda s: T.trim(s) != "")).withColumn("flags", F.transform("lines", T.is_table_row))
    zipped = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.struct(i.alias("i"), F.element_at("lines", i).alias("line"), F.element_at("flags", i).alias("row")))
    p = p.where(F.size("lines") > 0).withColumn("z", zipped).withColumn("rows", F.filter("z", lambda x: x["row"])).where(F.size("rows") >= 3)
    first = F.element_at("rows", 1)["i"]
    above = F.filter("z", lambda x: (x["i"] < first) & (x["i"] >= first - 3) & ~x["row"] & (F.length(T.trim(x["line"])) <= 160))
    p = p.withColumn("header", F.when(F.size(above) > 0, T.trim(F.element_at(above, -1)["line"])))
    story = T.trim(F.array_join(F.transform(F.filter("z", lambda x: ~x["row"]), lambda x: x["line"]), "\n"))
    row = lambda x, n: F.struct((n + 1).alias("ord"), F.lit(True).alias("is_row"), F.concat(F.lit(f"{X.TABLE_TAG} "), F.when(F.col("header").isNotNull(), F.concat("header", F.lit("\n"))).otherwise(""), T.trim(x["line"])).alias("text"))
    blocks = F.concat(F.filter(F.array(F.struct(F.lit(0).alias("ord"), F.lit(False).alias("is_row"), story.alias("text"))), lambda x: F.length(x["text"]) >= 60), F.transform("rows", row))
    return p.select("doc", "page", F.explode(blocks).alias("b")).select("doc", "page", "b.*")


def boilerplate(pages: DataFrame, ratio: float = 0.6, ends: int = 3, shortest: int = 12, least_pages: int = 3) -> DataFrame:
    """doc, line: normalised lines that stand at the head or tail of most of a document's pages; pages: doc, page, text."""
    lines = F.filter(F.split("text", "\r\n|\r|\n"), lambda s: T.trim(s) != "")
    head_tail = lambda a: F.concat(F.slice(a, 1, ends), F.when(F.size(a) > ends, F.slice(a, -ends, ends)).otherwise(a))
    seen = pages.withColumn("_l", lines).select("doc", "page", F.explode(F.array_distinct(F.transform(head_tail(F.col("_l")), T.norm_line))).alias("line")).where(F.length("line") >= shortest)
    counts = seen.groupBy("doc", "line").agg(F.count("*").alias("n"))
    total = pages.groupBy("doc").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    return counts.join(total, "doc").where(F.col("n") >= F.greatest(F.lit(least_pages), F.floor(F.col("pages") * ratio))).select("doc", "line")


def strip_boilerplate(pages: DataFrame, found: DataFrame, ends: int = 3) -> DataFrame:
    """pages with those lines dropped from the first and last lines of each page; text in between stays."""
    sets = found.groupBy("doc").agg(F.collect_set("line").alias("_bp"))
    lines = F.regexp_replace("text", "\r\n?", "\n")
    p = pages.join(sets, "doc", "left").withColumn("_l", F.split(F.regexp_replace(lines, r"\n\z", ""), "\n"))
    drop = lambda x, i: ((i < ends) | (i >= F.size("_l") - ends)) & (T.trim(x) != "") & F.array_contains("_bp", T.norm_line(x))
    kept = T.trim(F.array_join(F.filter("_l", lambda x, i: ~drop(x, i)), "\n"))
    return p.withColumn("text", F.when(F.col("_bp").isNull(), F.col("text")).otherwise(kept)).drop("_bp", "_l")


def with_sections(blocks: DataFrame, doc: str = "rel_path", order: str = "ord", heading=T.detect_heading) -> DataFrame:
    """blocks with section: the last heading at or before each block of its document; blocks without an order come last."""
    w = Window.partitionBy(doc).orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.coalesce(F.last(heading("text"), ignorenulls=True).over(w), F.lit("")))


def chunks(blocks: DataFrame, splitter=None, least: int = X.MIN_CHUNK, articles: bool = True) -> DataFrame:
    """Chunks with ids: rel_path, ord, is_row, section, chunk_index, chunk_id, text, char_count; blocks: rel_path, ord, text, is_row."""
    splitter = splitter or recursive_split()
    b = with_sections(blocks)
    segments = T.split_articles("text") if articles else F.array("text")
    prose = b.where(~F.col("is_row")).select("*", F.posexplode(segments).alias("seg", "segment")).select("rel_path", "ord", "is_row", "section", "seg", F.posexplode(splitter("segment")).alias("part", "piece"))
    rows = b.where("is_row").select("rel_path", "ord", "is_row", "section", F.lit(0).alias("seg"), F.lit(0).alias("part"), F.col("text").alias("piece"))
    kept = prose.unionByName(rows).withColumn("text", T.trim("piece")).where(F.length("text") >= F.when(F.col("is_row"), 1).otherwise(least))
    seq = F.row_number().over(Window.partitionBy("rel_path").orderBy("ord", "seg", "part"))
    kept = kept.withColumn("chunk_index", seq)
    return kept.select("rel_path", "ord", "is_row", "section", "chunk_index", T.chunk_id("rel_path", "ord", "chunk_index", "text").alias("chunk_id"), "text", F.length("text").alias("char_count"))


def merge_warnings(warnings: DataFrame) -> DataFrame:
    """doc, page, score (least), issues (distinct, in order of seq); warnings: doc, page, seq, score, issues."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "issues")))
    return warnings.groupBy("doc", "page").agg(F.min("score").alias("score"), F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["issues"]))).alias("issues"))


def recognised(pages: DataFrame, ocr: Column | None = None, least_chars: int = 60, least_quality: float = 0.65) -> DataFrame:
    """pages with text from the OCR column where the page has too little of its own and OCR found more; adds low_quality."""
    own = F.coalesce("text", F.lit(""))
    found = F.coalesce(T.clean_ocr(ocr), F.lit("")) if ocr is not None else F.lit("")
    use = (F.length(T.trim(own)) < least_chars) & (F.length(found) > F.length(own))
    d = pages.withColumn("_use", use).withColumn("text", F.when(use, found).otherwise(own))
    return d.withColumn("low_quality", F.col("_use") & (T.assess_quality("text")[0] < least_quality)).drop("_use")
