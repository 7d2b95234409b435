"""File scans and readers of plain formats."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = ["pdf", "docx", "txt", "md", "csv", "tsv", "xlsx", "xlsm", "xls", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"]


def scan(spark: SparkSession, root: str, extensions: list[str] | None = EXTENSIONS) -> DataFrame:
    """rel_path, file_name, ext, length, content, hash of the files below root, with extensions=None of all kinds; hidden and
    temporary ones are skipped, and files of no bytes, which Spark doesn't list."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    tail = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    rel = F.substring(tail, F.lit(len(re.sub(r"^[a-z0-9]+:/*", "/", base)) + 1), F.length(tail))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    rows = files.select(rel.alias("rel_path"), name.alias("file_name"), ext.alias("ext"), "length", "content", F.sha2("content", 256).alias("hash"))
    known = F.lit(True) if extensions is None else F.col("ext").isin(extensions)
    return rows.where(known & ~F.col("file_name").rlike(r"^(\.|~\$)"))


def decode(content: bytes) -> str:
    """Text of bytes: by byte order mark, as UTF-8, else as the single-byte Turkish code page."""
    for mark, enc in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(enc, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1254", "replace")


def texts(files: DataFrame) -> DataFrame:
    """rel_path, text of plain text files."""

    @F.pandas_udf("string")
    def as_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(decode)

    return files.where(F.col("ext").isin("txt", "md")).select("rel_path", "hash", as_text("content").alias("text"))


def _delimiter(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return ";" if head.count(";") > head.count(",") else ","


def csv_rows(content: bytes) -> list[list[str]]:
    text = decode(content)
    return [r for r in csv.reader(io.StringIO(text), delimiter=_delimiter(text[:4096])) if any(c.strip() for c in r)]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """(kind, text) of a document's body in order: heading, text, or table (a whole table is one block)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    run = lambda e: "".join((t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in e.iter())
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p" and (text := run(e).strip()):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            heading = style is not None and (style.get(f"{_W}val") or "").lower().startswith(("heading", "title"))
            out.append(("heading" if heading else "text", text))
        elif e.tag == f"{_W}tbl":
            rows = [" | ".join(" ".join(run(p).strip() for p in c.iter(f"{_W}p")).strip() for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
            if rows := [r for r in rows if r.replace("|", "").strip()]:
                out.append(("table", "\n".join(rows)))
    return out


#: Number formats of spreadsheets that are dates by definition of the format.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for f in root.iter(f"{_S}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode") or "")
        if code.lower() != "general" and re.search("[ymdhs]", code, re.IGNORECASE):
            dates.add(int(f.get("numFmtId")))
    styles = root.find(f"{_S}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else ()) if int(x.get("numFmtId") or 0) in dates}


def format_cell(text: str, kind: str | None, dated: bool, epoch: datetime) -> str:
    """A cell as text: a date as dd.mm.yyyy, whole numbers without decimals, others with a comma."""
    if kind == "b":
        return {"1": "True", "0": "False"}.get(text, text)
    if kind == "d" and text:
        return datetime.fromisoformat(text.replace("Z", "")).strftime("%d.%m.%Y")
    if kind not in (None, "n") or not text:
        return text
    x = float(text)
    if dated:
        # the format counts a 29 February 1900, so days before it are one late
        return (epoch + timedelta(days=x + (epoch.year == 1899 and x < 60))).strftime("%d.%m.%Y")
    return str(int(x)) if x.is_integer() else repr(x).replace(".", ",")


def xlsx_rows(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows) of visible sheets; values, not formulas; merged ranges filled from their first cell; blank rows dropped."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out, dates, book = [], _date_styles(z), ElementTree.fromstring(z.read("xl/workbook.xml"))
        late = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_S}workbookPr"))
        epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        for sheet in book.iter(f"{_S}sheet"):
            if sheet.get("state", "visible") != "visible":
                continue
            target = rels[sheet.get(f"{_R}id")]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            cells: dict[tuple[int, int], str] = {}
            for c in root.iter(f"{_S}c"):
                v, kind = c.find(f"{_S}v"), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else "" if v is None else v.text or ""
                text = strings[int(text)] if kind == "s" and text else format_cell(text, kind, int(c.get("s") or 0) in dates, epoch)
                cells[_cell(c.get("r"))] = text.strip()
            for m in root.iter(f"{_S}mergeCell"):
                (r1, c1), (r2, c2) = map(_cell, m.get("ref").split(":"))
                for k in ((r, c) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)):
                    cells[k] = cells.get(k) or cells.get((r1, c1), "")
            if cells:
                width = max(c for _, c in cells) + 1
                rows = [[cells.get((r, c), "") for c in range(width)] for r in sorted({r for r, _ in cells})]
                out.append((sheet.get("name"), [r for r in rows if any(r)]))
        return out


def _cell(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def table_rows(files: DataFrame) -> DataFrame:
    """rel_path, sheet, rn (1 is the header), cells of csv, tsv and xlsx files; a file that can't be read gives none and shows in `failures`."""

    def go(it):
        for pdf in it:
            out = []
            for path, ext, content in zip(pdf["rel_path"], pdf["ext"], pdf["content"], strict=True):
                try:
                    sheets = [("", csv_rows(content))] if ext in ("csv", "tsv") else xlsx_rows(content)
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
                    continue
                out += [(path, s, i + 1, r) for s, rows in sheets for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["rel_path", "sheet", "rn", "cells"])

    return files.where(F.col("ext").isin("csv", "tsv", "xlsx", "xlsm")).select("rel_path", "ext", "content").mapInPandas(go, "rel_path string, sheet string, rn long, cells array<string>")


def document_blocks(files: DataFrame) -> DataFrame:
    """rel_path, ord, kind, text of docx files."""

    def go(it):
        for pdf in it:
            out = []
            for path, content in zip(pdf["rel_path"], pdf["content"], strict=True):
                try:
                    out += [(path, i + 1, k, t) for i, (k, t) in enumerate(docx_blocks(content))]
                except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(out, columns=["rel_path", "ord", "kind", "text"])

    return files.where(F.col("ext") == "docx").select("rel_path", "content").mapInPandas(go, "rel_path string, ord long, kind string, text string")


def failures(files: DataFrame, *read: DataFrame) -> DataFrame:
    """rel_path, error of the files that none of the readers got anything from."""
    seen = None
    for r in read:
        p = r.select("rel_path")
        seen = p if seen is None else seen.unionByName(p)
    return files.join(seen.distinct(), "rel_path", "left_anti").select("rel_path", F.lit("no_content").alias("error"))


def pages(files: DataFrame, extract) -> DataFrame:
    """doc, page, text through a pluggable extractor (bytes → list of page texts) for formats that need a library or OCR."""

    def go(it):
        for pdf in it:
            out = [(p, i + 1, t) for p, c in zip(pdf["rel_path"], pdf["content"], strict=True) for i, t in enumerate(extract(c))]
            yield pd.DataFrame(out, columns=["doc", "page", "text"])

    return files.select("rel_path", "content").mapInPandas(go, "doc string, page int, text string")


#: Which reader takes a file, by extension.
FAMILIES = {"txt": "text", "md": "text", "csv": "table", "tsv": "table", "xlsx": "table", "xlsm": "table", "docx": "document", "pdf": "pages", **dict.fromkeys(("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"), "pages")}


def load(files: DataFrame, extract: Callable[[bytes], list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, failed) of files of any kind, each by the reader of its extension.

    blocks: rel_path, ord, page (null but for pages), locator, text, is_row; failed: rel_path, error (`unsupported` for an
    extension without a reader, pdf and images without extract among them; `no_content` for a file that gave nothing).
    """
    from ..operators import chunking

    family = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), F.col("ext")), F.lit("none"))
    routed = files.withColumn("family", family)
    no_page = F.lit(None).cast("int").alias("page")
    parts = [chunking.text_blocks(texts(files)).select("rel_path", F.col("ord").cast("long").alias("ord"), no_page, "locator", "text", F.lit(False).alias("is_row"))]
    docs = document_blocks(files)
    parts.append(docs.select("rel_path", "ord", no_page, F.concat(F.lit("Bölüm "), "ord").alias("locator"), "text", F.lit(False).alias("is_row")))
    rows = table_rows(files).withColumn("line", F.array_join("cells", " | "))
    tables = chunking.table_blocks(rows.select("rel_path", "sheet", "rn", "line"), ["line"], ["rel_path", "sheet"], "rn")
    place = F.concat(F.when(F.col("sheet") != "", F.concat("sheet", F.lit(" "))).otherwise(""), F.lit("Satır "), F.col("start").cast("string"))
    order = F.row_number().over(Window.partitionBy("rel_path").orderBy("sheet", "start")).cast("long")
    parts.append(tables.select("rel_path", order.alias("ord"), no_page, place.alias("locator"), "text", F.lit(True).alias("is_row")))
    taken = [k for k, v in FAMILIES.items() if v != "pages" or extract]
    if extract:
        paged = pages(routed.where("family = 'pages'"), extract).where(F.length(F.trim("text")) > 0)
        parts.append(paged.select(F.col("doc").alias("rel_path"), F.col("page").cast("long").alias("ord"), "page", F.concat(F.lit("Sayfa "), "page").alias("locator"), "text", F.lit(False).alias("is_row")))
    blocks = parts[0]
    for p in parts[1:]:
        blocks = blocks.unionByName(p)
    none = routed.where(~F.col("ext").isin(taken)).select("rel_path", F.lit("unsupported").alias("error"))
    return blocks, none.unionByName(failures(routed.where(F.col("ext").isin(taken)), blocks))
