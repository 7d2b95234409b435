"""Text search and leak scan over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Patterns of lines that should not be published: (name, regular expression), as plain rules.
LEAK_PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("home_path", r"(?:/home/|/Users/|[A-Za-z]:\\Users\\)[A-Za-z0-9._-]+"),
    ("secret", r"(?i)\b(?:api[_-]?key|token|secret|password)\b\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{12,}"),
]


def find_text(docs: DataFrame, terms: list[str], regex: bool = False, shown: int = 15, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, doc_id, hits (of the term in all), snippet: the first `shown` documents of each term, by id."""
    t = F.col(text)
    parts = []
    for term in terms:
        hit = t.rlike(f"(?iu){term}") if regex else F.contains(T.tr_lower(t), T.tr_lower(F.lit(term)))
        parts.append(docs.where(hit).select(F.lit(term).alias("term"), F.col(doc_id).alias("doc_id"), T.highlight(t, F.lit(term)).alias("snippet")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = out.groupBy("term").agg(F.count("*").alias("hits"))
    top = out.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).where(F.col("rank") <= shown)
    return top.join(F.broadcast(total), "term").select("term", "doc_id", "hits", "rank", "snippet")  # one row a term


def leak_scan(files: DataFrame, terms: list[str], patterns=LEAK_PATTERNS, skip: str = r"(?i)\.(?:png|jpe?g|gif|pdf|zip|exe|bin|ico)$", path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no, kind: lines that hold a listed term (in any case) or match a pattern; binary suffixes are skipped."""
    lines = files.where(~F.coalesce(F.col(path).cast("string").rlike(skip), F.lit(False))).select(F.col(path).alias("path"), F.posexplode(F.split(text, "\r?\n")).alias("p", "line"))
    kinds = [F.when(F.contains(T.tr_lower("line"), T.tr_lower(F.lit(t))), F.lit(f"term:{t}")) for t in terms] + [F.when(F.col("line").rlike(p), F.lit(k)) for k, p in patterns]
    return lines.select("path", (F.col("p") + 1).alias("line_no"), F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def leak_counts(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("findings"), F.count_distinct("path").alias("files"))
