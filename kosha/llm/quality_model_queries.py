"""Query op9: a quality score for every document."""

from __future__ import annotations

from .quality_model import score_documents
from .shared import table


def op9_quality_classifier(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict = {}
