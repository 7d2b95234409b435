"""Scoring of answers against cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import stats as S
from ..functions import text as T


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds issues and passed to answered cases: type, refused, answer, sources, expect_keywords, expect_any, expect_source, forbid_keywords."""
    text = T.eval_normalize("answer")
    none = F.array().cast("array<string>")
    arr = lambda c: F.coalesce(c, none)
    missing = F.transform(F.filter(arr("expect_keywords"), lambda k: ~T.value_in(text, k)), lambda k: F.concat(F.lit("missing:"), k))
    any_ = F.when((F.size(arr("expect_any")) > 0) & ~F.exists(arr("expect_any"), lambda k: T.value_in(text, k)), F.array(F.lit("none_of_expected"))).otherwise(none)
    files = T.eval_normalize(F.array_join(arr("sources"), " "))
    source = F.when(F.coalesce("expect_source", F.lit("")) != "", F.when(~F.contains(files, T.eval_normalize("expect_source")), F.array(F.lit("missing_source"))).otherwise(none)).otherwise(none)
    forbidden = F.transform(F.filter(arr("forbid_keywords"), lambda k: T.value_in(text, k)), lambda k: F.concat(F.lit("forbidden:"), k))
    bare = F.when(F.size(arr("sources")) == 0, F.array(F.lit("no_sources"))).otherwise(none)
    must = F.when(~F.col("refused"), F.array(F.lit("should_refuse"))).otherwise(none)
    issues = F.when(F.col("type") == "must_refuse", must).when((F.col("type") == "trap") & F.col("refused"), F.array(F.lit("trap_refused"))).when(F.col("refused"), F.array(F.lit("false_refusal"))).otherwise(F.concat(missing, any_, source, forbidden, bare))
    return rows.withColumn("issues", issues).withColumn("passed", (F.size("issues") == 0) | ((F.col("type") == "trap") & F.col("refused")))


def p95(x: str):
    """The value at position floor(0.95 n) of the sorted values, the first at least."""
    v = F.array_sort(F.collect_list(x))
    return F.when(F.size(v) == 0, 0.0).otherwise(F.element_at(v, F.greatest(F.lit(1), F.floor(F.size(v) * 0.95).cast("int"))))


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All ratios in one pass, by groups if given; rows: type, refused, passed, elapsed_s, n_sources, n_flagged."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    must, plain, made = F.col("type") == "must_refuse", ~F.col("type").isin("must_refuse", "trap"), ~F.col("refused")
    ratios = {
        "success": (F.col("passed"), F.lit(True)), "refusal": (must & F.col("refused"), must), "false_refusal": (plain & F.col("refused"), plain), "sourced": (plain & (F.col("n_sources") > 0), plain),
        "false_alarm": (made & F.col("passed") & (F.col("n_flagged") > 0), made & F.col("passed")), "caught": (made & ~F.col("passed") & (F.col("n_flagged") > 0), made & ~F.col("passed")),
    }
    cols = [f(c).alias(f"{k}_{s}") for k, v in ratios.items() for s, f, c in (("ok", n, v[0]), ("n", n, v[1]))]
    agg = rows.groupBy(*(by or [])).agg(F.count("*").alias("cases"), *cols, F.round(F.coalesce(F.median("elapsed_s"), F.lit(0.0)), 2).alias("p50"), F.round(p95("elapsed_s"), 2).alias("p95"))
    return agg.select(*(by or []), "cases", *[S.ratio_summary(F.col(f"{k}_ok"), F.col(f"{k}_n")).alias(k) for k in ratios], "p50", "p95")


def outages(rows: DataFrame, order: str = "pos", streak: int = 3) -> DataFrame:
    """Runs of at least `streak` outage rows in a row: start, length; rows: run, pos, answer, raw_answer, issues."""
    text = T.eval_normalize(F.concat_ws(" ", F.coalesce("answer", F.lit("")), F.coalesce("raw_answer", F.lit("")), F.array_join(F.coalesce("issues", F.array().cast("array<string>")), " ")))
    hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in X.OUTAGE])
    return streaks(rows.withColumn("hit", hit), "hit", ["run"], order, streak)


def streaks(rows: DataFrame, hit: str, by: list[str], order: str, least: int) -> DataFrame:
    """Unbroken runs of true `hit`, at least that long: by, start, length."""
    w = Window.partitionBy(*by).orderBy(order)
    island = rows.withColumn("_g", F.sum(F.when(F.col(hit), 0).otherwise(1)).over(w)).where(hit)
    return island.groupBy(*by, "_g").agg(F.min(order).alias("start"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_g")


def sweep(settings: DataFrame, scored: DataFrame) -> DataFrame:
    """Settings by success, best first, then by fewer false refusals; scored: setting_id, type, refused, passed."""
    plain = ~F.col("type").isin("must_refuse", "trap")
    agg = scored.groupBy("setting_id").agg(F.avg(F.col("passed").cast("int")).alias("success"), F.avg(F.when(plain, F.col("refused").cast("int"))).alias("false_refusal"))
    return settings.join(agg, "setting_id").orderBy(F.desc("success"), "false_refusal", "setting_id")


def same_files(chunks: DataFrame, declared: list[str]) -> DataFrame:
    """One row: does the collection hold exactly the declared files."""
    return chunks.agg((F.array_sort(F.collect_set("source_file")) == F.array(*map(F.lit, sorted(declared)))).alias("agrees"))


CASE_SCHEMA = "question string, type string, expect_keywords array<string>, expect_any array<string>, expect_source string, forbid_keywords array<string>, note string"


def read_cases(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Cases of YAML files (rows with rel_path and content, as sources.files.scan gives them), with their file."""

    def go(it):
        import pandas as pd
        import yaml

        names = [c.split()[0] for c in CASE_SCHEMA.split(", ")]
        for pdf in it:
            rows = [(p, *(c.get(n, "answerable" if n == "type" else None) for n in names)) for p, b in zip(pdf["rel_path"], pdf["content"], strict=True) for c in yaml.safe_load(b) or []]
            yield pd.DataFrame(rows, columns=["rel_path", *names])

    return files.select("rel_path", "content").mapInPandas(go, f"rel_path string, {CASE_SCHEMA}")


def clamp_settings(top_k, final_k, min_similarity, temperature):
    """Settings within their ranges."""
    within = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    return F.struct(within(top_k, 5, 50).alias("top_k"), within(final_k, 2, 12).alias("final_k"), within(min_similarity, 0.1, 0.8).alias("min_similarity"), within(temperature, 0.0, 1.0).alias("temperature"))
