"""Queries of fuzzy, containment and alias matching (J07 to J09, J17, J22, J34, S23) and of column alignment (S36) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.functions import text as X
from kosha.operators import matching as M
from kosha.sources import adapters as D

from .registry import register

# Names of funds from part: a directory with plans, of which every supplier looks for one under a misprinted name.
_NAME = "p_name || ' ' || p_brand || ' ' || p_type || ' Fund - ' || CASE p_partkey % 3 WHEN 0 THEN 'Direct Plan' WHEN 1 THEN 'Regular Plan' ELSE 'Exchange Traded Scheme' END"
_WORDS = "trim(regexp_replace(replace(replace(lower(name), 'exchange traded fund', 'etf'), 'exchange traded scheme', 'etf'), '[^a-z0-9]+', ' ', 'g'))"
_MISPRINT = "substr(name, 1, 2 + CAST(s_suppkey % 9 AS INTEGER)) || CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE '' END || substr(name, 4 + CAST(s_suppkey % 9 AS INTEGER))"
_ASKED_PLAN = "CASE s_suppkey % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'regular' END"
_ASKED_HOUSE = "CASE WHEN s_suppkey % 4 > 0 THEN p_brand END"


def _directory(spark, sf):
    return D.read(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.expr(_NAME).alias("name"), F.col("p_brand").alias("house"))


@register("j34_fuzzy_candidates", f"""WITH d AS (SELECT p_partkey AS code, {_NAME} AS name, p_brand AS house FROM part),
a AS (SELECT s_suppkey AS id, {_MISPRINT} AS name, {_ASKED_HOUSE} AS house, {_ASKED_PLAN} AS plan FROM supplier JOIN (SELECT p_partkey, p_brand, {_NAME} AS name FROM part) p ON p_partkey = s_suppkey * 19 + 3),
x AS (SELECT id, code, a.house AS ah, d.house AS dh, plan, a.n AS t, d.n AS n FROM (SELECT *, {_WORDS} AS n FROM a) a, (SELECT *, {_WORDS} AS n FROM d) d),
r0 AS (SELECT *, 1 - levenshtein(t, n) / greatest(length(t), length(n)) AS r FROM x),
r1 AS (SELECT *, least(1.0, greatest(0.0, r + CASE WHEN ah = dh THEN 0.15 ELSE 0 END)) AS r_a FROM r0 WHERE t = n OR r >= 0.85 - 1e-9),
r2 AS (SELECT *, least(1.0, greatest(0.0, r_a + CASE WHEN list_contains(string_split(n, ' '), 'etf') THEN CASE WHEN list_contains(string_split(t, ' '), 'etf') THEN 0.05 ELSE -0.3 END ELSE 0 END)) AS r_b FROM r1),
r3 AS (SELECT *, least(1.0, greatest(0.0, r_b + CASE WHEN len(regexp_extract_all(t, '\\d+')) > 0 THEN CASE WHEN list_has_any(regexp_extract_all(t, '\\d+'), regexp_extract_all(n, '\\d+')) THEN 0.05 ELSE -0.2 END ELSE 0 END)) AS r_c FROM r2),
r4 AS (SELECT id, code, CASE WHEN t = n THEN 1.0 ELSE least(1.0, greatest(0.0, r_c + CASE WHEN plan IS NULL THEN 0 WHEN contains(n, plan) THEN 0.05 WHEN contains(n, CASE plan WHEN 'direct' THEN 'regular' ELSE 'direct' END) THEN -0.05 ELSE 0 END)) END AS ratio FROM r3)
SELECT id, code, round(ratio, 6) AS ratio, CAST(row_number() OVER (PARTITION BY id ORDER BY r4.ratio DESC, code) AS INTEGER) AS k FROM r4 WHERE r4.ratio >= 0.55 QUALIFY k <= 3""")
def j34(spark, sf):
    named = D.read(spark, sf, "part").select("p_partkey", "p_brand", F.expr(_NAME).alias("name"))
    found = D.read(spark, sf, "supplier").join(named, F.col("p_partkey") == F.col("s_suppkey") * 19 + 3)
    asked = found.select(F.col("s_suppkey").alias("id"), F.expr(_MISPRINT).alias("name"), F.expr(_ASKED_HOUSE).alias("house"), F.expr(_ASKED_PLAN).alias("plan"))
    return M.candidates(asked, _directory(spark, sf)).withColumn("ratio", F.round("ratio", 6))


# Keys of funds without marks, some inside the title of a document; suppliers ask for them whole, cut, or with a title around.
_KEY = "regexp_replace(lower(p_name || p_brand || p_type), '[^a-z0-9]+', '', 'g')"
_KNOWN = "CASE p_partkey % 5 WHEN 0 THEN 'statementof' || key ELSE key END"
_ASKED = "CASE s_suppkey % 5 WHEN 0 THEN key WHEN 1 THEN substr(key, 3) WHEN 2 THEN 'portfolioof' || key || 'march' WHEN 3 THEN substr(key, 1, 13) || 'zz' ELSE substr(key, 1, 5) END"
_HELD = "(contains(a.name, k.name) OR contains(k.name, a.name)) AND least(length(a.name), length(k.name)) >= 8"
_SHARE = "least(length(a.name), length(k.name)) / greatest(length(a.name), length(k.name))"
_BOUND = f"""p AS (SELECT *, {_KEY} AS key FROM part), k AS (SELECT DISTINCT {_KNOWN} AS name, p_type AS house FROM p),
a AS (SELECT s_suppkey AS id, {_ASKED} AS name, CASE WHEN s_suppkey % 3 > 0 THEN p_type ELSE 'OTHER' END AS house FROM supplier JOIN p ON p_partkey = s_suppkey * 19 + 3)"""


def _parts(spark, sf):
    key = X.norm_name(F.concat("p_name", "p_brand", "p_type"))
    return D.read(spark, sf, "part").withColumn("key", key)


def _asked(spark, sf):
    found = D.read(spark, sf, "supplier").join(_parts(spark, sf), F.col("p_partkey") == F.col("s_suppkey") * 19 + 3)
    return found.select(F.col("s_suppkey").alias("id"), F.expr(_ASKED).alias("name"), F.expr("CASE WHEN s_suppkey % 3 > 0 THEN p_type ELSE 'OTHER' END").alias("house"))


@register("j08_j09_containment_binding", f"""WITH {_BOUND},
x AS (SELECT id, k.name, k.house, CASE WHEN a.name = k.name THEN CASE WHEN a.house = k.house THEN 0 ELSE 1 END WHEN a.house = k.house THEN 2 ELSE 3 END AS tier, {_SHARE} AS ratio
  FROM a JOIN k ON a.name = k.name OR ({_HELD} AND {_SHARE} >= 0.25) WHERE length(a.name) >= 6)
SELECT id, tier, round(ratio, 6) AS ratio, name, house FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, x.ratio DESC, name, house) = 1""")
def j09(spark, sf):
    known = _parts(spark, sf).select(F.expr(_KNOWN).alias("name"), F.col("p_type").alias("house"))
    return M.bind_by_containment(_asked(spark, sf), known).withColumn("ratio", F.round("ratio", 6))


@register("j07_match_universe", f"""WITH {_BOUND},
u AS (SELECT p_partkey AS row, {_KNOWN} AS name, CASE WHEN p_size % 2 = 0 THEN 'Regular' WHEN p_size % 3 = 0 THEN 'Direct' END AS plan, CASE WHEN p_size % 7 > 0 THEN CAST(p_retailprice AS DOUBLE) END AS aum FROM p),
x AS (SELECT id, k.*, CASE WHEN a.name = k.name THEN 0 WHEN {_HELD} AND length(k.name) >= 6 AND least(length(a.name), length(k.name)) >= greatest(8, CAST(floor(greatest(length(a.name), length(k.name)) * 0.55) AS INTEGER)) THEN 1
    WHEN length(k.name) >= 12 AND substr(k.name, 1, 12) = substr(a.name, 1, 12) THEN 2 END AS tier FROM a, u k)
SELECT id, tier, row AS key FROM x WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, CASE WHEN lower(plan) = 'regular' THEN 0 ELSE 1 END, coalesce(aum, 0) DESC, row) = 1""")
def j07(spark, sf):
    plan = F.when(F.col("p_size") % 2 == 0, "Regular").when(F.col("p_size") % 3 == 0, "Direct")
    aum = F.when(F.col("p_size") % 7 > 0, F.col("p_retailprice").cast("double"))
    universe = _parts(spark, sf).select(F.col("p_partkey").alias("key"), F.expr(_KNOWN).alias("name"), plan.alias("plan"), aum.alias("aum"))
    return M.match_universe(_asked(spark, sf).select("id", "name"), universe)


# Labels are what parts are called; aliases are names and types of parts, and targets what they are parts of.
_LABEL = "trim(regexp_replace(lower(CASE p_size % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_name || ' ' || p_brand || ' ' || p_type WHEN 2 THEN substr(p_name, 2) ELSE p_type || p_name || ' of ' || p_brand END), '[^a-z0-9]+', ' ', 'g'))"
_LABELS = f"labels AS (SELECT DISTINCT {_LABEL} AS label FROM part)"
_PAIRS = """f AS (SELECT DISTINCT lower(p_name) AS name, lower(p_type) AS kind FROM part),
aliases AS (SELECT alias, target, dense_rank() OVER (ORDER BY target) AS family_rank, row_number() OVER (ORDER BY target, length(alias), alias) AS rank
  FROM (SELECT DISTINCT name || ' ' || kind AS alias, kind AS target FROM f UNION SELECT DISTINCT name, split_part(name, ' ', 2) FROM f UNION SELECT DISTINCT split_part(name, ' ', 2), split_part(name, ' ', 2) FROM f))"""


def _labels(spark, sf):
    return D.read(spark, sf, "part").select(F.expr(_LABEL.replace(", 'g'", "")).alias("label")).distinct()


def _aliases(spark, sf):
    f = D.read(spark, sf, "part").select(F.lower("p_name").alias("name"), F.lower("p_type").alias("kind")).distinct()
    last = F.split_part("name", F.lit(" "), F.lit(2))
    rows = f.select(F.concat_ws(" ", "name", "kind").alias("alias"), F.col("kind").alias("target")).union(f.select("name", last)).union(f.select(last, last)).distinct()
    targets = rows.groupBy("target").agg(F.array_sort(F.collect_set(F.struct(F.length("alias").alias("n"), "alias"))).alias("a"))
    families = targets.withColumn("family_rank", F.dense_rank().over(Window.orderBy("target")))  # one row a target
    flat = families.select("target", "family_rank", F.posexplode("a").alias("j", "a"))
    return flat.select("a.alias", "target", "family_rank", (F.col("family_rank") * 1_000_000 + F.col("j")).alias("rank"))


@register("j22_match_label", f"""WITH {_LABELS}, {_PAIRS},
x AS (SELECT label, alias, target, rank, list_distinct(list_filter(string_split(label, ' '), lambda w: w <> '')) AS lw, list_distinct(string_split(alias, ' ')) AS aw FROM labels, aliases),
s AS (SELECT *, CASE WHEN label = alias THEN 2.0 ELSE len(list_intersect(lw, aw)) / (len(lw) + len(aw) - len(list_intersect(lw, aw))) + CASE WHEN starts_with(label, substr(alias, 1, 8)) OR starts_with(alias, substr(label, 1, 8)) THEN 0.15 ELSE 0.0 END END AS score FROM x WHERE len(list_intersect(lw, aw)) > 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, rank) = 1)
SELECT label, CASE WHEN score >= 0.72 THEN target END AS target, CASE WHEN score >= 0.72 THEN alias END AS alias, round(least(1.0, score), 6) AS score FROM labels LEFT JOIN b USING (label)""")
def j22(spark, sf):
    return M.match_aliases(_labels(spark, sf), _aliases(spark, sf), "score").withColumn("score", F.round("score", 6))


@register("s23_map_headers", f"""WITH {_LABELS}, {_PAIRS},
e AS (SELECT label, target, alias FROM labels JOIN aliases ON label = alias QUALIFY row_number() OVER (PARTITION BY label ORDER BY rank) = 1),
h AS (SELECT label, target, alias, family_rank FROM labels JOIN aliases ON contains(label, alias) OR contains(alias, label) WHERE label NOT IN (SELECT label FROM e) QUALIFY row_number() OVER (PARTITION BY label, target ORDER BY rank) = 1),
b AS (SELECT label, target, alias FROM h QUALIFY row_number() OVER (PARTITION BY label ORDER BY length(alias) DESC, family_rank) = 1)
SELECT label, coalesce(e.target, b.target) AS target, coalesce(e.alias, b.alias) AS alias FROM labels LEFT JOIN e USING (label) LEFT JOIN b USING (label)""")
def s23(spark, sf):
    return M.match_aliases(_labels(spark, sf), _aliases(spark, sf), "longest").drop("score")


@register("j17_first_keyword", f"""WITH {_LABELS}, {_PAIRS}
SELECT label, target, alias FROM labels LEFT JOIN (SELECT label, target, alias FROM labels JOIN aliases ON contains(' ' || label || ' ', ' ' || alias || ' ')
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY label <> alias, rank) = 1) USING (label)""")
def j17(spark, sf):
    return M.match_aliases(_labels(spark, sf), _aliases(spark, sf), "first").drop("score")


# Figures of an order stand at its prices and anchors at its quantities, both as places on a page.
_SIDES = """g AS (SELECT l_orderkey AS id, list(x ORDER BY x) AS xs, list(a ORDER BY a) AS anchors FROM (
  SELECT l_orderkey, (l_partkey * 37 % 600)::DOUBLE AS x, (CAST(l_quantity AS INTEGER) * 12)::DOUBLE AS a FROM lineitem WHERE l_partkey IS NOT NULL) GROUP BY 1)"""


@register("s36_align_columns", f"""WITH RECURSIVE {_SIDES},
dp AS (SELECT id, xs, anchors, 0 AS i, list_transform(range(len(anchors) + 1), lambda k: 0.0::DOUBLE) AS costs, [] :: DOUBLE[][] AS rows FROM g
  UNION ALL SELECT id, xs, anchors, i + 1, made, list_append(rows, made) FROM (SELECT id, xs, anchors, i, rows,
    list_reduce(list_concat([['Infinity'::DOUBLE]], list_transform(range(1, len(anchors) + 1), lambda j: [j::DOUBLE])),
      lambda r, q: list_append(r, least(CASE WHEN abs(xs[i + 1] - anchors[q[1]::INTEGER]) <= 75 THEN costs[q[1]::INTEGER] + abs(xs[i + 1] - anchors[q[1]::INTEGER]) ELSE 'Infinity'::DOUBLE END, costs[q[1]::INTEGER + 1] + 75, r[len(r)] + 75))) AS made FROM dp WHERE i < len(xs))),
t AS (SELECT id, xs, anchors, list_concat([list_transform(range(len(anchors) + 1), lambda k: 0.0::DOUBLE)], rows) AS c FROM dp WHERE i = len(xs)),
back AS (SELECT id, xs, anchors, c, len(xs) AS i, len(anchors) AS j, NULL::INTEGER AS x, NULL::INTEGER AS anchor FROM t
  UNION ALL SELECT id, xs, anchors, c, CASE WHEN move < 2 THEN i - 1 ELSE i END, CASE WHEN move <> 1 THEN j - 1 ELSE j END, CASE WHEN move = 0 THEN i - 1 END, CASE WHEN move = 0 THEN j - 1 END FROM (
    SELECT *, CASE WHEN abs(xs[i] - anchors[j]) <= 75 AND c[i][j] + abs(xs[i] - anchors[j]) <= least(c[i][j + 1], c[i + 1][j]) + 75 THEN 0 WHEN c[i][j + 1] <= c[i + 1][j] THEN 1 ELSE 2 END AS move FROM back WHERE i > 0 AND j > 0))
SELECT id, CAST(x AS INTEGER) AS x, CAST(anchor AS INTEGER) AS anchor FROM back WHERE x IS NOT NULL""")
def s36(spark, sf):
    rows = D.read(spark, sf, "lineitem").where("l_partkey IS NOT NULL").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 37 % 600).cast("double").alias("x"), (F.col("l_quantity").cast("int") * 12).cast("double").alias("a"))
    sides = rows.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.sort_array(F.collect_list("a")).alias("anchors"))
    return sides.select("id", F.inline(M.align_columns(F.col("xs"), F.col("anchors"))))
