"""Chunks, prompts, citations and grounded answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .narrative import stripped

# The words of each citation group, in the order in which groups are tried.
CITATION_WORDS = {
    "recreation": ("swim", "health", "toxic", "cyanotoxin", "who", "skin"), "chlorophyll": ("ndci", "chlorophyll", "red edge", "705"),
    "sediment": ("spm", "turbidity", "sediment", "scattering", "665"), "water_index": ("mndwi", "ndwi", "swir", "water index"),
    "calibration": ("baseline", "calibr", "sigma", "anomaly", "z-score"),
}


# The headings and closing lines of answers and prompts.
EVIDENCE_HEADING = "=== CURRENT WATER BODY PIPELINE DATA ===\nThis is real-time satellite analysis data for the water body the user is viewing:"
BASE_HEADING = "📚 **From the knowledge base:**"
CARD_HEADING = "\n📊 **Current pipeline evidence:**"
CROSSED, WITHIN = "⚠️ threshold crossed", "within normal range"
NOT_CONFIGURED = "\n⚠️ *Note: Language model is not configured. Set LLM_PROVIDER=gemini and LLM_API_KEY in your environment to enable AI-generated answers.*"
NOT_KNOWN = "I don't have that in my knowledge base."


def _two(e: Column) -> Column:
    return F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))


def general(x: Column, digits: int = 4) -> Column:
    """A number with `digits` significant digits and no zeros behind, in powers of ten below 1e-4 and from 10**digits on; halves go to the even digit."""
    size = F.abs(x)
    near = F.floor(F.log10(size)).cast("int")
    m = F.bround(size / F.pow(F.lit(10.0), near - (digits - 1))).cast("long")
    over = m >= 10**digits
    e, m = near + over.cast("int"), F.when(over, m / 10).otherwise(m).cast("long").cast("string")
    trim = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.concat(trim(F.concat(F.substring(m, 1, 1), F.lit("."), F.substring(m, 2, digits))), _two(e))
    small = trim(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), m))
    plain = F.when(e < 0, small).otherwise(trim(F.concat(F.substring(m, F.lit(1), e + 1), F.lit("."), F.substring(m, e + 2, F.lit(digits)))))
    text = F.when(size == 0, "0").when(F.isnan(x), "nan").when(size == float("inf"), "inf").when((e < -4) | (e >= digits), power).otherwise(plain)
    return F.concat(F.when(x < 0, "-").otherwise(""), text)


def shortest(x: Column) -> Column:
    """A number in digits that give it back (older JVMs use one or two more than they need), with at least one behind the point, in powers of ten below 1e-4 and from 1e16 on; null: None."""
    size = F.abs(x)
    zeros = lambda t: F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", ".0")
    parts = F.split(x.cast("string"), "E")
    power = F.concat(F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", ""), _two(F.get(parts, F.lit(1)).cast("int")))
    decimal = lambda kind: zeros(x.cast(kind).cast("string"))
    out = F.when(size == 0, x.cast("string")).when((size < 1e-4) | (size >= 1e16), power).when(size < 1e-3, decimal("decimal(38,24)")).when(size >= 1e7, decimal("decimal(38,10)"))
    return F.when(x.isNull(), "None").otherwise(out.otherwise(x.cast("string")))


def citation(question: Column, answer: Column, other: str = "corpus") -> Column:
    """The first group one of whose words occurs in question or answer."""
    text, out = F.lower(F.concat_ws(" ", question, answer)), None
    for group, words in CITATION_WORDS.items():
        hit = text.rlike("|".join(words))
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise(other)


def listed(text: Column, least: int = 3, most: int = 4) -> Column:
    """The lines of a list without their marks; fewer than `least` lines give none, of more the first `most` stay."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: stripped(F.regexp_replace(stripped(x), r"^[0-9.\-*• ]+", ""))), lambda x: x != "")
    return F.when(F.size(lines) >= least, F.slice(lines, 1, most)).otherwise(F.array().cast("array<string>"))


def prompt(system: Column, passages: Column, evidence: Column, turns: Column, question: Column, turn_limit: int = 6) -> Column:
    """Blocks in their order: system text, passages (id, title, text) or that there are none, evidence as JSON, the last turns (role, text), the question."""
    found = F.transform(passages, lambda p: F.concat(F.lit("[Source: "), p["id"], F.lit("]\nTitle: "), p["title"], F.lit("\n"), p["text"]))
    blank = lambda a: F.size(F.coalesce(a, F.array())) == 0
    none = F.array(F.lit("=== KNOWLEDGE BASE ===\n(No relevant passages found for this question.)"))
    base = F.when(blank(passages), none).otherwise(F.concat(F.array(F.lit("=== KNOWLEDGE BASE ===\nUse these passages to answer the question:")), found))
    data = F.when(evidence.isNotNull(), F.array(F.lit(EVIDENCE_HEADING), evidence)).otherwise(F.array().cast("array<string>"))
    last = F.slice(turns, F.greatest(F.lit(1), F.size(turns) - turn_limit + 1), turn_limit)
    said = F.transform(last, lambda t: F.concat(F.when(t["role"] == "user", "User: ").otherwise("Assistant: "), t["text"]))
    talk = F.when(blank(turns), F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("=== CONVERSATION HISTORY ===")), said))
    return F.array_join(F.concat(F.array(system), base, data, talk, F.array(F.concat(F.lit("=== USER QUESTION ===\n"), question))), "\n\n")


def retrieval_query(contributing: Column) -> Column:
    """What to search for where nobody asked: from the indicators of a card, or without a card (null)."""
    names = F.when(F.size(contributing) > 0, F.array_join(contributing, " ")).otherwise("indicator baseline anomaly")
    card = F.concat(F.lit("alert explanation "), names, F.lit(" sigma threshold why flagged interpretation"))
    return F.when(contributing.isNull(), "water quality indicator baseline confidence disclaimer").otherwise(card)


def grounding(passages: Column, confidence: Column, source: Column) -> Column:
    """(confidence, reasons, grounded) of an answer from its passages, the confidence of its evidence (null: none) and where its text comes from."""
    some, card = F.size(F.coalesce(passages, F.array())) > 0, confidence.isNotNull()
    why = F.array(F.when(some, "corpus"), F.when(card, "pipeline_evidence"), F.when(source != "llm", source), F.when(~some & ~card, "not_in_corpus"))
    value = F.when(card, confidence).when(some, 0.75).otherwise(0.2)
    return F.struct(value.alias("confidence"), F.array_compact(why).alias("reasons"), ((some | card) & (source != "template")).alias("grounded"))


def extractive(passages: Column, comparisons: Column, contributing: Column) -> Column:
    """An answer without a language model: the passages (id, title, text), then one line per comparison of a card (null: none), what is flagged, and a note; nothing to say: a sentence that tells so."""
    found = F.transform(passages, lambda p: F.concat(F.lit("\n**["), p["id"], F.lit("] "), p["title"], F.lit("**\n"), p["text"]))
    base = F.when(F.size(passages) > 0, F.concat(F.array(F.lit(BASE_HEADING)), found))
    sigma = lambda r: F.when(r["sigma"].isNull(), "n/a").otherwise(F.concat(F.when(r["sigma"] < 0, "-").otherwise(""), F.format_string("%.2fσ", F.bround(F.abs(r["sigma"]), 2))))
    line = lambda r: F.concat(
        F.lit("• **"), r["indicator"], F.lit("**: value "), general(r["value"]), F.lit(", baseline "), general(r["mean"]), F.lit(" ± "), shortest(r["std"]), F.lit(", deviation "), sigma(r),
        F.lit(" — "), F.when(r["crossed"], CROSSED).otherwise(WITHIN),
    )
    card = F.when(comparisons.isNotNull(), F.concat(F.array(F.lit(CARD_HEADING)), F.transform(comparisons, line)))
    flagged = F.when(F.size(contributing) > 0, F.array(F.concat(F.lit("• **Flagged indicators**: "), F.array_join(contributing, ", "))))
    none = F.array().cast("array<string>")
    lines = F.concat(*(F.coalesce(x, none) for x in (base, card, flagged)))
    return F.when(F.size(lines) == 0, NOT_KNOWN).otherwise(F.array_join(F.concat(lines, F.array(F.lit(NOT_CONFIGURED))), "\n"))


def cited(passages: Column) -> Column:
    """(text, sources) of passages (topic, citation, text): topics in front of their texts; a missing topic or citation gets a stand-in."""
    topic = lambda p: F.coalesce(p["topic"], F.lit("Hydrology Publication"))
    sources = F.transform(passages, lambda p: F.struct(topic(p).alias("topic"), F.coalesce(p["citation"], F.concat(F.lit("Indexed Corpus · "), topic(p))).alias("citation")))
    return F.struct(F.array_join(F.transform(passages, lambda p: F.concat(F.lit("["), topic(p), F.lit("]\n"), p["text"])), "\n\n").alias("text"), sources.alias("sources"))
