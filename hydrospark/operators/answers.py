"""Answers to questions: search, prompt, a draft held against the evidence, else extracts; and how well they are grounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.narrative import respects
from ..functions.prompts import extractive, grounding, prompt, retrieval_query
from .evidence import allowed_numbers
from .retrieval import overlap_search

PASSAGES = "array<struct<id: string, title: string, text: string>>"


def found_passages(questions: DataFrame, passages: DataFrame, k: int = 3) -> DataFrame:
    """(question, passages): the best `k` passages (passage, title, text) of each question that has any, in rank order."""
    hits = overlap_search(passages, questions, k).select("question", "passage", "rank").join(passages.select("passage", "title", "text"), "passage")
    each = F.sort_array(F.collect_list(F.struct("rank", F.col("passage").cast("string").alias("id"), "title", "text")))  # k a question
    return hits.groupBy("question").agg(F.transform(each, lambda x: F.struct(x["id"], x["title"], x["text"])).alias("passages"))


def prompted(questions: DataFrame, passages: DataFrame, cards: DataFrame | None = None, system: str = "", k: int = 3) -> DataFrame:
    """Questions (question, text, and as far as there are any: evidence_id, turns) with their passages, evidence card and prompt.

    A question without text is searched for by its card's indicators. A card is one of `cards` (see evidence.evidence); it is put into the prompt as JSON.
    """
    x = questions if "turns" in questions.columns else questions.withColumn("turns", F.lit(None).cast("array<struct<role: string, text: string>>"))
    x = x if "evidence_id" in x.columns else x.withColumn("evidence_id", F.lit(None).cast("string"))
    if cards is not None:
        held = cards.select("evidence_id", F.struct("comparisons", "contributing", "confidence", "extent_m2", "extent_change_m2", "date").alias("card"), F.to_json(F.struct(*cards.columns)).alias("json"))
        x = x.join(held, "evidence_id", "left")
    else:
        x = x.withColumns({"card": F.lit(None).cast("struct<contributing: array<string>, confidence: double>"), "json": F.lit(None).cast("string")})
    query = F.coalesce(F.nullif(F.col("text"), F.lit("")), retrieval_query(F.col("card.contributing")))
    x = x.join(found_passages(x.select("question", query.alias("text")), passages, k), "question", "left")
    x = x.withColumn("passages", F.coalesce("passages", F.array().cast(PASSAGES)))
    return x.withColumn("prompt", prompt(F.lit(system), F.col("passages"), F.col("json"), F.col("turns"), F.coalesce("text", F.lit(""))))


def answered(questions: DataFrame, passages: DataFrame, cards: DataFrame | None = None, drafts: DataFrame | None = None, k: int = 3) -> DataFrame:
    """(question, answer, source_ids, evidence_id, source, confidence, reasons, grounded) of each question.

    Without passages and card the answer says that nothing is known (template). With `drafts` (question, draft: null or blank where the model gave none) a draft is the answer if all its numbers are the
    card's; one that isn't (llm_rejected), none (llm_unreachable, or llm for a blank one) and no drafts at all (llm_disabled) leave the extracts of passages and card.
    """
    x = prompted(questions, passages, cards, k=k)
    has_card = F.col("card").isNotNull()
    none = (F.size("passages") == 0) & ~has_card
    comparisons = F.col("card.comparisons") if cards is not None else F.lit(None).cast("array<struct<indicator: string, value: double, mean: double, std: double, sigma: double, crossed: boolean>>")
    if drafts is None:
        x = x.withColumns({"kept": F.lit(None).cast("string"), "source": F.when(none, "template").otherwise("llm_disabled")})
    else:
        x = x.join(drafts.select("question", F.col("draft").alias("draft"), F.lit(True).alias("tried")), "question", "left")
        text = F.nullif(F.trim("draft"), F.lit(""))
        good = F.lit(True)
        if cards is not None:
            x = x.select("*", *(F.col(f"card.{c}").alias(c) for c in ("comparisons", "confidence", "extent_m2", "extent_change_m2", "date")))
            good = ~has_card | text.isNull() | respects(text, allowed_numbers())
        source = F.when(none, "template").when(F.col("draft").isNull(), "llm_unreachable").when(~good, "llm_rejected").otherwise("llm")
        x = x.withColumn("source", source).withColumn("kept", F.when(F.col("source") == "llm", text))
        x = x.drop("comparisons", "confidence", "extent_m2", "extent_change_m2", "date")
    g = grounding(F.col("passages"), F.col("card.confidence"), F.col("source"))
    answer = F.coalesce("kept", extractive(F.col("passages"), comparisons, F.col("card.contributing")))
    x = x.withColumn("g", g)
    return x.select("question", answer.alias("answer"), F.transform("passages", lambda p: p["id"]).alias("source_ids"), F.when(has_card, F.col("evidence_id")).alias("evidence_id"), "source", "g.*")
