"""Query op6: the language of every document."""

from __future__ import annotations

from .language import identify
from .shared import table


def op6_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict = {}
