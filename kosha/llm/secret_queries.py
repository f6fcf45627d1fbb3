"""Query op10: secrets in every document."""

from __future__ import annotations

from .secret_scan import scan_secrets
from .shared import table


def op10_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES: dict = {}
