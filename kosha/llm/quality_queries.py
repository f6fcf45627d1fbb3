"""Query op7: quality rules over every document."""

from __future__ import annotations

from .quality_rules import judge
from .shared import table


def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES: dict = {}
