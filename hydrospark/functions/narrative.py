"""Text templates, numbers in texts and the check of a text against evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(day: Column) -> Column:
    return F.concat(F.substring(day, 1, 4), F.lit("-"), F.substring(day, 5, 2), F.lit("-"), F.substring(day, 7, 2), F.lit("T00:00:00Z"))


def numbers_in_text(text: Column) -> Column:
    """All numbers, with their signs, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def close_to(left: Column, right: Column) -> Column:
    gap = F.abs(left - right)
    return (gap <= 1e-6) | ((gap < 1) & (gap <= F.greatest(F.lit(0.05), 0.001 * F.abs(right))))


def respects(text: Column, allowed: Column) -> Column:
    """Whether every number in the text is close to an allowed one."""
    return F.forall(numbers_in_text(text), lambda n: F.exists(allowed, lambda a: close_to(n, a)))


def narrative_source(draft: Column, allowed: Column, enabled: Column) -> Column:
    return F.when(~enabled, "llm_disabled").when(draft.isNull(), "llm_unreachable").when(respects(draft, allowed), "llm").otherwise("llm_rejected")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def heading_chunks(text: Column) -> Column:
    """Parts of a Markdown text, cut before each heading, trimmed; blank ones are kept for their place and dropped later."""
    return F.transform(F.split(text, r"\n(?=#)"), stripped)


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def chunk_title(chunk: Column, path: Column) -> Column:
    """The first level-one heading of a chunk, else the file's name without its ending."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    heading = stripped(F.regexp_extract(chunk, r"(?m)^# (.*)$", 1))
    return F.when(heading != "", heading).otherwise(stem)


def chunk_rows(text: Column, path: Column) -> Column:
    """Heading chunks as (id, title, text), numbered with the blank ones counted, blank ones left out."""
    placed = F.transform(heading_chunks(text), lambda x, i: F.struct(F.concat(path, F.lit("#"), i.cast("string")).alias("id"), chunk_title(x, path).alias("title"), x.alias("text")))
    return F.filter(placed, lambda x: x["text"] != "")
