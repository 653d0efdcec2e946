"""Reading classifier answers with built-in JSON and regex functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import rules

FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def answer_json(raw: Column) -> Column:
    """The last fenced block that is valid JSON, or the whole text if nothing is fenced."""
    blocks = F.regexp_extract_all(raw, F.lit(FENCE), 1)
    tried = F.when(F.size(blocks) > 0, F.reverse(blocks)).otherwise(F.array(raw))
    trimmed = F.transform(
        tried, lambda b: F.regexp_replace(b, rf"^[{rules.WS}]+|[{rules.WS}]+$", ""))
    return F.try_element_at(F.filter(trimmed, lambda b: F.try_parse_json(b).isNotNull()), F.lit(1))


def answer_field(answer: Column, key: str) -> Column:
    """The text under a top-level key of the answer object; null when the key is absent."""
    return F.get_json_object(answer, f"$.{key}")


def first_word(text: Column) -> Column:
    """Leading letters of an answer, lower case: 'No, it is a score' gives 'no'."""
    lowered = F.lower(F.regexp_replace(text, rf"^[{rules.WS}]+", ""))
    return F.regexp_extract(lowered, r"^[a-z]*", 0)
