"""Query op2: pages to WARC archives and back."""

from __future__ import annotations

from .shared import table
from .warc import archive_round_trip


def op2_warc(spark, sf_dir):
    return archive_round_trip(spark, table(spark, sf_dir, "pages"))


ORACLES = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(encode(html)) AS payload_digest,
  CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM t
"""
}
QUERIES = {"op2_warc": op2_warc}
