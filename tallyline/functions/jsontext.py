"""JSON out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.exprs import col


def first_text(blocks: str | Column) -> Column:
    """Text of the first block of type ``text`` in ARRAY<STRUCT<type, text>>; NULL if none."""
    return F.get(F.filter(col(blocks), lambda b: b["type"] == "text"), F.lit(0))["text"]


def candidate(raw: str | Column) -> Column:
    """From the first ``{`` to the last ``}`` once code fences are gone; NULL if there is none."""
    unfenced = F.regexp_replace(F.regexp_replace(col(raw), "(?i)```json", ""), "```", "")
    return F.nullif(F.regexp_extract(unfenced, r"(?s)\{.*\}", 0), F.lit(""))


def strict_variant(text: str | Column) -> Column:
    """Parse text that must be exactly one JSON value; NULL otherwise.

    The plain parser ignores anything after a complete value. Here the text is
    parsed as the first element of a two-element array that ends in the text's
    own checksum, so extra values or closing brackets move the checksum away.
    """
    text = col(text)
    seal = F.md5(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]')))
    sealed = F.try_variant_get(pair, "$[1]", "string") == seal
    return F.when(sealed, F.try_variant_get(pair, "$[0]", "variant"))
