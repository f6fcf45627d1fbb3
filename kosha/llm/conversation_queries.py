"""Query op11: the trie of rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .conversation_trie import NODE, digest_ends, number_turns, prefix_trie
from .shared import keep, table

NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of an empty text


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of rebuilt conversations: the first h turns of conversation c - c % 5, then c's own after its first h; h is crc32 of c in decimal, modulo 9."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    lengths = keep(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "lengths")
    plan = lengths.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("source"))
    plan = plan.join(lengths.select(F.col("conv_id").alias("source"), F.col("n").alias("there")), "source", "left")
    plan = plan.withColumn("shared", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    plan = keep(plan.select("conv_id", "source", "h", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "plan")
    heads = turns.where("pos <= 8").withColumnRenamed("conv_id", "source")  # a conversation serves five at most
    front = plan.where("shared > 0").join(heads, "source").where("pos <= shared").select("conv_id", "pos", "k1", "k2", "n_bytes")
    own = turns.where(F.col("pos") > h).join(plan, "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "k1", "k2", "n_bytes")
    return front.unionByName(own), plan.select("conv_id", "n_turns")


def op11_conversation_trie(spark, sf_dir):
    nodes, ends = prefix_trie(*rebuild(keep(number_turns(table(spark, sf_dir, "conversations")), "numbered")))
    return nodes.join(digest_ends(ends), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "preorder", "subtree_end"
    )


_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))), "
    "lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
)
# Preorder places depend on the order of children, which the contract leaves open: they are the Spark rule (by least member) written with paths.
ORACLES = {
    "op11_conversation_trie": f"""
WITH t AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS k,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(k ORDER BY pos) AS ks, CAST({_CRC} % 9 AS INTEGER) AS h FROM t GROUP BY conv_id),
b AS (SELECT c.conv_id, list_concat(coalesce(s.ks[1:c.h], []), c.ks[c.h + 1:]) AS seq FROM c LEFT JOIN c s ON s.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, d AS depth, seq[1:d] AS path, len(seq) AS n FROM (SELECT conv_id, seq, unnest(generate_series(0, len(seq))) AS d FROM b)),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM p GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(path[depth].x)) END AS saving FROM n LEFT JOIN kids USING (path)),
way AS (SELECT o.path, o.depth, list(a.conv_id ORDER BY a.depth) AS key FROM (SELECT path, depth, unnest(generate_series(0, depth)) AS d FROM own) o JOIN n a ON a.path = o.path[1:d] GROUP BY ALL),
ranked AS (SELECT path, row_number() OVER (ORDER BY key, depth) - 1 AS preorder FROM way),
sub AS (SELECT up AS path, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(saving) AS saved_tokens, count(*) AS size FROM (SELECT n_children, saving, unnest(list_transform(generate_series(0, depth), lambda d: path[1:d])) AS up FROM own) GROUP BY up)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256,
  preorder, CAST(preorder + size AS BIGINT) AS subtree_end
FROM own JOIN sub USING (path) JOIN ranked USING (path) LEFT JOIN n up ON own.depth > 0 AND up.path = own.path[1:own.depth - 1]
"""
}
QUERIES = {"op11_conversation_trie": op11_conversation_trie}
