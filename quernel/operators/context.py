"""Prompt context under a character budget, and history windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X


def fit_budget(configured: Column, num_ctx: Column, num_predict: Column, chars_per_token: Column, system_len: Column, question_len: Column) -> Column:
    """Characters left for sources: at most configured, at least 600."""
    room = F.floor((num_ctx - num_predict - 96) * chars_per_token) - (system_len + question_len + 400)
    return F.greatest(F.lit(600), F.least(configured, room)).cast("long")


def block(label: Column, source: Column, locator: Column, section: Column, text: Column) -> Column:
    """A numbered source block of the prompt."""
    part = F.when(F.coalesce(section, F.lit("")) == "", "").otherwise(F.concat(F.lit(X.BLOCK_SECTION), section))
    head = F.concat(F.lit(X.BLOCK_OPEN), label.cast("string"), F.lit(X.BLOCK_SOURCE), F.coalesce(source, F.lit(X.NO_SOURCE)), F.lit(X.BLOCK_PLACE), F.coalesce(locator, F.lit(X.NO_PLACE)), part)
    return F.concat(head, F.lit(X.BLOCK_RULE), F.coalesce(text, F.lit("")), F.lit(X.BLOCK_RULE.rstrip("\n")))


def within_budget(rows: DataFrame, size: str, budget: Column, by: list[str], order: str) -> DataFrame:
    """Rows of each group while their running size stays in the budget; the first row always."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(w))
    return rows.where((F.col("used") <= budget) | (F.col("_rn") == 1)).drop("_rn")


def contexts(rows: DataFrame, budget: int = 9000) -> DataFrame:
    """qid, context, n_blocks; rows: qid, final_rank, source, locator, section, text."""
    b = rows.withColumn("block", block(F.col("final_rank"), F.col("source"), F.col("locator"), F.col("section"), F.col("text"))).withColumn("size", F.length("block"))
    kept = within_budget(b, "size", F.lit(budget), ["qid"], "final_rank")
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"), F.count("*").alias("n_blocks"))


#: A plain prompt; users bring their own wording with the same four places.
TEMPLATE = "Sources ({count}):\n{context}\n\nQuestion: {question}\nIf the sources don't answer it, reply: {refusal}"


def prompts(rows: DataFrame, questions: DataFrame, template: str = TEMPLATE, system: str = "", budget: int = 9000, refusal: str = X.REFUSAL) -> DataFrame:
    """qid, system, prompt: the template with the number of all sources, those within the budget, the question and the refusal sentence."""
    n = rows.groupBy("qid").agg(F.count("*").alias("n"))
    c = questions.select("qid", F.regexp_replace("question", r"(?U)^\s+|\s+$", "").alias("question")).join(contexts(rows, budget), "qid", "left").join(n, "qid", "left")
    of = {"count": F.coalesce("n", F.lit(0)).cast("string"), "context": F.coalesce("context", F.lit("")), "question": F.coalesce("question", F.lit("")), "refusal": F.lit(refusal)}
    # by pieces, so that what is put in is not searched for places
    parts = [of[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(count|context|question|refusal)\}", template))]
    return c.select("qid", F.lit(system).alias("system"), F.concat(*parts).alias("prompt"))


def confidence(pool: DataFrame, answers: DataFrame, least: float = X.LOW_CONFIDENCE) -> DataFrame:
    """answers with top_similarity (the greatest of a question's pool, 0 without one) and low_confidence: answered, and that is under least."""
    top = pool.groupBy("qid").agg(F.max("similarity").alias("top_similarity"))
    d = answers.join(top, "qid", "left").withColumn("top_similarity", F.coalesce("top_similarity", F.lit(0.0)))
    return d.withColumn("low_confidence", ~F.col("refused") & (F.col("top_similarity") < least))


def last_turns(turns: DataFrame, n: int = 2, cut: int = 300) -> DataFrame:
    """conv_id, turn, history: for each question the n question-answer pairs before it, answers cut; turns: conv_id, turn, question, answer."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct("turn", "question", F.left("answer", F.lit(cut)).alias("answer"))).over(w))


def needs_rewrite(question: Column, history: Column) -> Column:
    """Is a question short enough, with a history, to be put anew before the search."""
    return (F.size(history) > 0) & (F.regexp_count(question, F.lit(r"(?U)\S+")) <= 12)


def rewritten(output: Column, question: Column) -> Column:
    """The first line of a rewriter's output, at most 300 characters; the question where it is empty."""
    from ..functions.text import trim

    out = F.regexp_replace(trim(output), '^"+|"+$', "")
    return F.when(F.coalesce(out, F.lit("")) == "", question).otherwise(F.left(F.substring_index(out, "\n", 1), F.lit(300)))
