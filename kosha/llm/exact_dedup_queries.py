"""Query op12: groups of equal documents, by a digest index."""

from __future__ import annotations

from .exact_dedup import DigestIndex, duplicate_groups
from .shared import scratch, table


def op12_exact_dedup(spark, sf_dir):
    index = DigestIndex(spark, f"{scratch(spark)}/digests")
    return duplicate_groups(table(spark, sf_dir, "documents"), index).withColumnRenamed("id", "doc_id")


ORACLES = {
    "op12_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
}
QUERIES = {"op12_exact_dedup": op12_exact_dedup}
