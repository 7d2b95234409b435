"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, mixing, pii, pivots, quality, secrets, suffix, urlgraph, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(secrets.labelled_findings(spark), secrets.learn(docs)), path="source")
    return found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("secret_sha256"), F.round("score", 6).alias("score"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(_read(spark, sf_dir, "documents"), percent=80, ngram=5)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_read(spark, sf_dir, "documents"), length=400).drop("kept")


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_urlgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(_read(spark, sf_dir, "pages"), urlgraph.rules_table(spark, RULES))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op9_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_read(spark, sf_dir, "embeddings"), least=0.9)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_read(spark, sf_dir, "pages"), least_bytes=0, bodies=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict:
    return {"op1_quality": op1_quality, "op2_mixing": op2_mixing, "op3_secrets": op3_secrets, "op4_decontamination": op4_decontamination, "op5_jaccard": op5_jaccard, "op6_suffix_dedup": op6_suffix_dedup, "op7_urlgraph": op7_urlgraph, "op8_pii": op8_pii, "op9_pivots": op9_pivots, "op10_warc": op10_warc}


#: Sets, links and their closure in plain SQL; small tables only.
_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM s LEFT JOIN c ON doc_id = a
"""


#: All pairs of usable vectors by cosine in double precision, and the closure of their links; small tables only.
_PIVOTS = """
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS k, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, k, e, sqrt(list_dot_product(e, e)) AS n, len(e) AS d FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.k AS a, b.k AS b, b.vec_id AS bv FROM g a JOIN g b ON a.k <> b.k AND a.d = b.d WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT a, b, bv FROM p UNION SELECT r.a, p.b, p.bv FROM r JOIN p ON r.b = p.a),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a), c AS (SELECT a, min(bv) AS least FROM r GROUP BY a),
o AS (SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id FROM v LEFT JOIN l ON v.k = l.a LEFT JOIN c ON v.k = c.a)
SELECT *, coalesce(vec_id = component_id, FALSE) AS kept FROM o
"""

#: Digests in base 32 by five bits of each two hexadecimal digits; of equal payloads the largest page_id is the response.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY h) AS newest,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((instr('0123456789abcdef', h[(5 * i) // 4 + 1]) - 1) * 16
  + instr('0123456789abcdef', h[(5 * i) // 4 + 2]) - 1) >> (3 - (5 * i) % 4)) & 31)::BIGINT, 1)), '') AS digest FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS DISTINCT FROM newest AND newest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM newest AND newest IS NOT NULL THEN newest END AS refers_to FROM d
"""


#: Hexadecimal windows of 400 bytes, cut from blocks of 512 places; those found twice, their runs, and what stays between runs.
_SUFFIX = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT *, length(x) // 2 AS n FROM d),
p AS (SELECT k, n, o, substr(x, 2 * o + 1, 1822) AS y FROM (SELECT k, n, x, unnest(range(0, n - 399, 512)) AS o FROM n WHERE n >= 400)),
w AS (SELECT k, o + j AS i, md5_number(substr(y, 2 * j + 1, 800)) AS h FROM (SELECT k, o, y, unnest(range(least(512, n - 399 - o))) AS j FROM p)),
s AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT k, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS step FROM s),
b AS (SELECT k, i, sum(CASE WHEN step <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM g),
r AS (SELECT k, run, min(i) AS lo, max(i) + 400 AS hi FROM b GROUP BY k, run),
a AS (SELECT k, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi, sum(hi - lo) AS gone FROM r GROUP BY k)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(lo), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN lo IS NULL THEN x ELSE array_to_string(list_transform(range(len(lo) + 1), lambda j: substr(x, 2 * (CASE WHEN j = 0 THEN 0 ELSE hi[j] END) + 1, 2 * ((CASE WHEN j = len(lo) THEN n ELSE lo[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE hi[j] END)))), '') END)) AS kept_sha256
FROM n LEFT JOIN a USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard": _JACCARD, "op6_suffix_dedup": _SUFFIX, "op9_pivots": _PIVOTS, "op10_warc": _WARC}
