"""Query op13: codes of all embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .shared import table
from .vector_codes import codebooks_digest, compress


def op13_vector_codes(spark, sf_dir):
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _assigned(k: int) -> str:
    """Nearest entry of every part by the codebooks cb{k}: vec, part, entry and squared distance."""
    return f"""a{k} AS (SELECT vec, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT vec, q.part, entry, sum((x - c) * (x - c)) AS d FROM q JOIN cb{k} c ON q.part = c.part AND q.pos = c.pos GROUP BY ALL) GROUP BY ALL)"""


def _moved(k: int) -> str:
    """Codebooks cb{k + 1} from the assignments a{k}."""
    return f"""cb{k + 1} AS (SELECT cb{k}.part, cb{k}.entry, cb{k}.pos, coalesce(m.c, cb{k}.c) AS c FROM cb{k} LEFT JOIN (
  SELECT q.part, entry, pos, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS c FROM q JOIN a{k} USING (vec, part) GROUP BY ALL) m USING (part, entry, pos))"""


ORACLES = {
    "op13_vector_codes": f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS vec, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec, (i - 1) // (w // 16) AS part, (i - 1) % (w // 16) AS pos, CAST(floor(256 * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec, v, len(v) AS w, unnest(generate_series(1, len(v))) AS i FROM k)),
cb0 AS (SELECT part, vec AS entry, pos, x AS c FROM q WHERE vec < 64),
{_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
coded AS (SELECT vec, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec),
books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM cb2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN k USING (vec), books
"""
}
QUERIES = {"op13_vector_codes": op13_vector_codes}
