"""Query op3: classes of documents with similar sets of word n-grams."""

from __future__ import annotations

from .jaccard import jaccard_classes
from .shared import table


def op3_ngram_jaccard(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
# All pairs that share a shingle, and everything that their links reach.
ORACLES = {
    "op3_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS gram FROM d),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM g a JOIN g b USING (gram) WHERE a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(r, there) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.there),
c AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = there GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""
}
