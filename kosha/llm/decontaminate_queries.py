"""Query op4: benchmark windows in every document."""

from __future__ import annotations

from .decontaminate import contamination
from .shared import table


def op4_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLES = {
    "op4_decontaminate": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS gram FROM (SELECT item, w, n, unnest(generate_series(1, CAST(len(w) - n + 1 AS BIGINT))) AS s FROM iw)),
d AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM grams),
dw AS (SELECT rn, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram FROM (SELECT rn, w, n, unnest(generate_series(1, CAST(len(w) - n + 1 AS BIGINT))) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT rn, dw.n, s, item FROM dw JOIN grams ON dw.n = grams.n AND dw.gram = grams.gram),
pos AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY rn),
it AS (SELECT rn, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rn) LEFT JOIN it USING (rn)
"""
}
QUERIES = {"op4_decontaminate": op4_decontaminate}
