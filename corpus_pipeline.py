"""From raw documents to a training mix, in five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents; the last adds `copies`, how often the mix takes a document.

Defined results: a null text is scored as an empty one, has no copy, no leak and no secret, and is mixed with size 0 if
the classifier keeps it; rows with a null doc_id pass the near-copy stage as they are; repeated rows are copies of one id,
kept or dropped together; an empty table stays empty; texts of any length are taken whole; further columns, whatever their
names, are carried through (where documents have a column `copies`, the count is `copies_1`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import decontam, jaccard, mixing, quality, secrets
from quernel.llm._common import drop, materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (fitted on the labels of documents that aren't held out) scores 0.3 or more."""
    return quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).keep(docs, threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the 5-gram Jaccard join at 0.8, that of the least id."""
    return jaccard.keep_one(docs, percent=80, ngram=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials masked and n_chars counted anew."""
    scanner = secrets.train(secrets.labelled_findings(spark), secrets.learn(docs))
    return secrets.redact(docs, scanner, path="source").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many copies it takes of each."""
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    return mixing.with_copies(docs, mixed)


STAGES = [("quality", keep_good), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("secrets", mask_secrets), ("mixing", mix_sources)]

#: A trained classifier and forest can't be put in SQL; tests/llm/test_pipeline.py holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        drop(*last)
        last = [docs]
    return docs
