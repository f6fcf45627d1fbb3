"""Query op8: a verdict for the URL of every page."""

from __future__ import annotations

from .shared import table
from .url_filter import judge_urls

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op8_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLES = {
    "op8_url_filter": f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_RULE_ROWS}),
u AS (
  SELECT page_id,
    coalesce(CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
    coalesce(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
n AS (SELECT *, row_number() OVER () AS rn FROM u),
hits AS (
  SELECT rn, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY rn ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
  FROM n JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM n LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (rn)
"""
}
QUERIES = {"op8_url_filter": op8_url_filter}
