"""Queries of listings (Q), joins (J) and aggregations (G) with their oracles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kosha.operators import catalog as C
from kosha.operators import portfolio as P
from kosha.sources import adapters as D

from . import sql
from .registry import register

S, H, SEC, BO = sql.SCHEMES, sql.HOLDINGS, sql.SECURITIES, sql.BONDS


def _r(df, n=4):
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("q01_list_schemes", f"WITH {S}, {H}, {SEC} SELECT scheme_id, fund_name, amc, category, aum FROM schemes WHERE category = (SELECT r_name FROM region WHERE r_regionkey = 1) AND contains(lower(fund_name), 'supplier#') AND scheme_id IN (SELECT scheme_id FROM holdings JOIN securities USING (isin) WHERE cap = 'mid' AND sector = 'Brand#2') ORDER BY aum DESC NULLS LAST, fund_name LIMIT 10 OFFSET 2")
def q01(spark, sf):
    name = D.read(spark, sf, "region").where("r_regionkey = 1").first()["r_name"]
    return C.list_schemes(D.schemes(spark, sf), D.holdings(spark, sf), D.securities(spark, sf), category=name, search="Supplier#", cap="mid", sector="Brand#2", limit=10, offset=2)


@register("q02_get_scheme", f"WITH {S} SELECT * FROM schemes WHERE scheme_id = 7")
def q02(spark, sf):
    return D.schemes(spark, sf).where("scheme_id = 7")


@register("q03_find_schemes", f"WITH {S} SELECT * FROM schemes WHERE scheme_id IN (3, 5)")
def q03(spark, sf):
    names = spark.createDataFrame([("SUPPLIER 000000003",), ("supplier#000000005",), ("nobody",)], "name string")
    return C.find_schemes(D.schemes(spark, sf), names)


@register("q04_list_securities", f"WITH {SEC} SELECT isin, name, sector, cap, source_count FROM securities WHERE confirmed_equity = 1.0 AND contains(name, 'ring') ORDER BY source_count DESC, name, isin LIMIT 20")
def q04(spark, sf):
    s = D.securities(spark, sf).where((F.col("confirmed_equity") == 1.0) & C.contains("name", "RING")).select("isin", "name", "sector", "cap", "source_count")
    return C.page(s, [F.desc("source_count"), F.col("name"), F.col("isin")], 20)


@register("q05_get_security", f"WITH {SEC} SELECT * FROM securities WHERE isin = 42")
def q05(spark, sf):
    return D.securities(spark, sf).where("isin = 42")


@register("q06_security_usage", f"WITH {H} SELECT scheme_id, isin, round(market_value, 4) AS market_value, round(weight, 4) AS weight FROM holdings WHERE isin = 42 ORDER BY holdings.weight DESC, scheme_id LIMIT 15")
def q06(spark, sf):
    return _r(C.security_usage(D.holdings(spark, sf), 42, 15))


@register("q07_mapping", f"WITH {H}, {SEC}, f AS (SELECT isin, scheme_id, weight, name, row_number() OVER (PARTITION BY isin ORDER BY weight DESC, scheme_id) AS k FROM holdings JOIN securities USING (isin) WHERE contains(name, 'red')) SELECT isin, scheme_id, name, round(weight, 4) AS weight FROM f WHERE k = 1 ORDER BY f.weight DESC, isin LIMIT 25")
def q07(spark, sf):
    return _r(C.mapping(D.holdings(spark, sf), D.securities(spark, sf), "Red", 25).select("isin", "scheme_id", "name", "weight"))


@register("q08_list_bonds", f"WITH {BO} SELECT isin, name, coupon, price FROM bonds WHERE date_diff('month', settle, maturity) < 999 AND maturity < settle + INTERVAL 120 MONTH AND maturity >= settle + INTERVAL 60 MONTH AND segment = 'PROMO' ORDER BY coupon DESC, isin LIMIT 30")
def q08(spark, sf):
    return C.list_bonds(D.bonds(spark, sf), segment="PROMO", bucket="5-10y", sort="coupon", limit=30).select("isin", "name", "coupon", "price")


@register("q10_api_filters", f"WITH {S} SELECT 'amc' AS facet, amc AS value FROM schemes GROUP BY ALL UNION ALL SELECT 'category', category FROM schemes GROUP BY ALL")
def q10(spark, sf):
    return C.facets(D.schemes(spark, sf), ["amc", "category"]).select("facet", "value")


@register("j01_holdings_with_securities", f"WITH {H}, {SEC} SELECT scheme_id, isin, name, sector, cap, round(weight, 4) AS weight FROM holdings LEFT JOIN securities USING (isin)")
def j01(spark, sf):
    return _r(D.holdings(spark, sf).join(D.securities(spark, sf), "isin", "left").select("scheme_id", "isin", "name", "sector", "cap", "weight"))


@register("j02_schemes_by_cap", f"WITH {S}, {H}, {SEC} SELECT DISTINCT scheme_id, fund_name FROM schemes JOIN holdings USING (scheme_id) JOIN securities USING (isin) WHERE cap = 'small' AND weight > 0.5")
def j02(spark, sf):
    want = D.holdings(spark, sf).where("weight > 0.5").join(D.securities(spark, sf).where("cap = 'small'"), "isin", "left_semi")
    return D.schemes(spark, sf).join(want, "scheme_id", "left_semi").select("scheme_id", "fund_name")


@register("j03_scheme_counts", f"WITH {S}, {H} SELECT schemes.scheme_id, count(isin) AS n, round(coalesce(sum(weight), 0), 4) AS total FROM schemes LEFT JOIN (SELECT * FROM holdings WHERE isin % 3 = 0 AND scheme_id % 4 <> 0) h USING (scheme_id) GROUP BY 1")
def j03(spark, sf):
    h = D.holdings(spark, sf).where("isin % 3 = 0 AND scheme_id % 4 <> 0").groupBy("scheme_id").agg(F.count("isin").alias("n"), F.sum("weight").alias("total"))
    return _r(D.schemes(spark, sf).select("scheme_id").join(h, "scheme_id", "left").select("scheme_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total")))


@register("j04_bond_enrichment", f"WITH {BO}, {SEC} SELECT bonds.isin, coalesce(CASE WHEN bonds.isin % 3 = 0 THEN bonds.name END, sector) AS issuer, coupon FROM bonds LEFT JOIN securities USING (isin)")
def j04(spark, sf):
    b = D.bonds(spark, sf).withColumn("own", F.when(F.col("isin") % 3 == 0, F.col("name")))
    return b.join(D.securities(spark, sf).select("isin", "sector"), "isin", "left").select("isin", F.coalesce("own", "sector").alias("issuer"), "coupon")


_OVER = f"{H}, h AS (SELECT scheme_id // 12 AS set_id, * FROM holdings), o AS (SELECT a.set_id, a.scheme_id AS a, b.scheme_id AS b, sum(least(a.weight, b.weight)) AS overlap, count(*) AS common FROM h a JOIN h b USING (set_id, isin) WHERE a.scheme_id <= b.scheme_id GROUP BY ALL)"


def _overlaps(spark, sf):
    """Sets of at most 12 schemes that together hold every scheme."""
    return P.overlap(D.holdings(spark, sf).withColumn("set_id", F.expr("scheme_id div 12")), "set_id", "scheme_id", "isin")


@register("j06_overlap_matrix", f"WITH {_OVER} SELECT set_id, a, b, round(overlap, 4) AS overlap, common FROM o")
def j06(spark, sf):
    return _r(_overlaps(spark, sf))


@register("g18_top_overlap_pairs", f"WITH {_OVER} SELECT set_id, a, b, round(overlap, 4) AS overlap FROM o WHERE a < b QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY o.overlap DESC, a, b) <= 5")
def g18(spark, sf):
    o = _overlaps(spark, sf).where("a < b").select("set_id", "a", "b", "overlap")
    return _r(C.top_of_each(o, "set_id", [F.desc("overlap"), F.col("a"), F.col("b")], 5))


@register("j24_identity_coalesce", "SELECT p_partkey AS isin, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_name END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END, p_type) AS name FROM part")
def j24(spark, sf):
    p = D.read(spark, sf, "part").withColumnRenamed("p_partkey", "isin")
    a = p.where("isin % 2 = 0").select("isin", F.col("p_name").alias("n1"))
    b = p.where("isin % 3 = 0").select("isin", F.col("p_brand").alias("n2"))
    return p.select("isin", F.col("p_type").alias("n3")).join(a, "isin", "left").join(b, "isin", "left").select("isin", F.coalesce("n1", "n2", "n3").alias("name"))


@register("g01_meta_stats", f"WITH {S} SELECT count(*) AS schemes, count(DISTINCT amc) AS amcs, count(aum) AS with_aum, round(100.0 * count(aum) / count(*), 2) AS aum_pct FROM schemes")
def g01(spark, sf):
    return D.schemes(spark, sf).agg(F.count(F.lit(1)).alias("schemes"), F.countDistinct("amc").alias("amcs"), F.count("aum").alias("with_aum"), F.round(100.0 * F.count("aum") / F.count(F.lit(1)), 2).alias("aum_pct"))


@register("g02_g07_holdings_stats", f"WITH {H} SELECT scheme_id, count(*) AS n, count_if(weight > 0) AS n_long, round(max(weight), 4) AS top_weight, arg_max(isin, (weight, isin)) AS top_isin, round(sum(weight), 4) AS total FROM holdings GROUP BY 1")
def g02(spark, sf):
    return _r(P.scheme_stats(D.holdings(spark, sf), "scheme_id"))


def _lines(spark, sf):
    return D.read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("scheme_id"), F.col("l_partkey").alias("isin"), F.col("l_returnflag").alias("source"), F.col("l_extendedprice").alias("market_value"), F.expr("CASE WHEN l_orderkey % 3 = 0 THEN l_tax END").alias("coupon"),
        F.expr("CASE WHEN l_orderkey % 5 <> 0 THEN l_linestatus END").alias("label"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("o"), F.expr("CASE WHEN l_orderkey % 7 <> 0 THEN l_discount * 100 END").alias("weight"))


@register("g03_merge_snapshot", "SELECT l_suppkey AS scheme_id, l_partkey AS isin, round(sum(l_extendedprice), 4) AS market_value, count(*) AS parts, arg_min(l_tax, (l_orderkey, l_linenumber, l_extendedprice)) FILTER (l_orderkey % 3 = 0) AS coupon, arg_min(l_linestatus, (l_orderkey, l_linenumber, l_extendedprice)) FILTER (l_orderkey % 5 <> 0) AS label FROM lineitem GROUP BY 1, 2")
def g03(spark, sf):
    return _r(P.merge_snapshot(_lines(spark, sf), ["scheme_id", "isin"], "o"))


@register("g05_best_source", "WITH c AS (SELECT l_suppkey AS scheme_id, l_returnflag AS source, count(*) FILTER (l_orderkey % 7 <> 0) AS n FROM lineitem GROUP BY ALL) SELECT scheme_id, arg_max(source, (n, CASE source WHEN 'A' THEN -1 WHEN 'N' THEN -2 ELSE -3 END)) AS source FROM c GROUP BY 1")
def g05(spark, sf):
    return P.pick_source(_lines(spark, sf), "scheme_id", "source", {"A": 1, "N": 2, "R": 3}).select("scheme_id", "source").distinct()


@register("g04_shadow_guard", "WITH k AS (SELECT DISTINCT l_suppkey AS scheme_id, l_returnflag AS source, l_partkey % 20 AS k FROM lineitem), n AS (SELECT scheme_id, source AS other, count(*) AS n FROM k GROUP BY ALL), c AS (SELECT a.scheme_id, a.source, b.source AS other, count(*) AS common FROM k a JOIN k b USING (scheme_id, k) WHERE a.source <> b.source GROUP BY ALL) SELECT scheme_id, source, other, common, n FROM c JOIN n USING (scheme_id, other) WHERE common >= 0.85 * n")
def g04(spark, sf):
    return P.shadowed(_lines(spark, sf).withColumn("k", F.pmod("isin", F.lit(20))), "scheme_id", "source", "k")


@register("g06_weight_repair", """WITH r AS (SELECT l_suppkey AS scheme_id, l_partkey AS isin, sum(l_extendedprice) AS mv, sum(CASE WHEN l_suppkey % 3 = 0 THEN l_discount / 3 WHEN l_suppkey % 3 = 1 THEN l_discount * 9 END) AS pct FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(pct) OVER w AS total, max(pct) OVER w AS top, count(pct) OVER w AS k, sum(mv) OVER w AS v FROM r WINDOW w AS (PARTITION BY scheme_id))
SELECT scheme_id, isin, CASE WHEN k > 0 AND top <= 100 AND total <= 120 THEN 'stated' WHEN v > 0 THEN 'market_value' ELSE 'equal' END AS rule, round(CASE WHEN k > 0 AND top <= 100 AND total <= 120 THEN pct WHEN v > 0 THEN 100 * mv / v ELSE 0 END, 4) AS weight FROM t""")
def g06(spark, sf):
    r = D.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("scheme_id"), F.col("l_partkey").alias("isin")).agg(F.sum("l_extendedprice").alias("market_value"), F.sum(F.expr("CASE WHEN l_suppkey % 3 = 0 THEN l_discount / 3 WHEN l_suppkey % 3 = 1 THEN l_discount * 9 END")).alias("pct"))
    return _r(P.repair_weights(r, "scheme_id").select("scheme_id", "isin", "rule", "weight"))


@register("g08_bond_facets", f"WITH {BO} SELECT 'segment' AS facet, segment AS value, count(*) AS n FROM bonds GROUP BY ALL UNION ALL SELECT 'freq', CAST(freq AS VARCHAR), count(*) FROM bonds GROUP BY ALL")
def g08(spark, sf):
    return C.facets(D.bonds(spark, sf), ["segment", "freq"])


@register("g09_bond_coverage", f"WITH {BO} SELECT CASE WHEN coupon = 0 THEN 'zero coupon' WHEN isin % 5 = 0 THEN 'missing' ELSE 'present' END AS status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM bonds GROUP BY 1")
def g09(spark, sf):
    g = D.bonds(spark, sf).groupBy(F.when(F.col("coupon") == 0, "zero coupon").when(F.col("isin") % 5 == 0, "missing").otherwise("present").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return _r(g.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))))


@register("g14_concentration", f"WITH {H}, k AS (SELECT *, row_number() OVER (PARTITION BY scheme_id ORDER BY weight DESC, isin) AS k FROM holdings) SELECT scheme_id, round(sum(weight) FILTER (k <= 1), 4) AS top1, round(sum(weight) FILTER (k <= 5), 4) AS top5, round(sum(weight) FILTER (k <= 10), 4) AS top10, round(sum(weight * weight), 4) AS hhi FROM k GROUP BY 1")
def g14(spark, sf):
    return _r(P.concentration(D.holdings(spark, sf), "scheme_id"))


@register("g11_sector_split", f"WITH {H}, {SEC}, g AS (SELECT scheme_id, sector, sum(weight) AS w FROM holdings JOIN securities USING (isin) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY scheme_id ORDER BY w DESC, sector) AS k FROM g) SELECT scheme_id, CASE WHEN k <= 8 THEN sector ELSE 'Others' END AS sector, round(sum(w), 4) AS weight FROM k GROUP BY ALL")
def g11(spark, sf):
    return _r(P.sector_split(D.holdings(spark, sf).join(D.securities(spark, sf), "isin"), "scheme_id", "sector"))


@register("g17_overlap_concentration", f"WITH {H} SELECT isin, round(sum(weight), 4) AS weight, count(*) AS schemes FROM holdings GROUP BY 1 ORDER BY sum(weight) DESC, isin LIMIT 10")
def g17(spark, sf):
    g = D.holdings(spark, sf).groupBy("isin").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("schemes"))
    return _r(C.page(g, [F.desc("weight"), F.col("isin")], 10))


@register("g34_modal_name", "WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand AS sector, arg_max(p_name, (n, length(p_name), p_name)) AS name FROM c GROUP BY 1")
def g34(spark, sf):
    c = D.read(spark, sf, "part").groupBy(F.col("p_brand").alias("sector"), "p_name").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("sector").agg(F.max_by("p_name", F.struct("n", F.length("p_name").alias("l"), "p_name")).alias("name"))


@register("g36_latest_nav_index", f"WITH {sql.NAV}, {sql.BENCH}, u AS (SELECT CAST(scheme_id AS VARCHAR) AS code, d, nav FROM nav UNION ALL SELECT 'INDEX', d, nav FROM bench) SELECT code, max(d) AS d, round(arg_max(nav, d), 4) AS nav FROM u GROUP BY 1")
def g36(spark, sf):
    u = D.nav(spark, sf).select(F.col("scheme_id").cast("string").alias("code"), "d", "nav").unionByName(D.benchmark_nav(spark, sf).select(F.lit("INDEX").alias("code"), "d", "nav"))
    return _r(u.groupBy("code").agg(F.max("d").alias("d"), F.max_by("nav", "d").alias("nav")))


@register("j16_look_through", """WITH RECURSIVE units AS (SELECT CAST(l_suppkey AS VARCHAR) AS fund, CASE WHEN l_partkey % 50 < 12 THEN CAST(l_partkey % 10 AS VARCHAR) ELSE 'P' || l_partkey % 50 END AS isin, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL),
sh AS (SELECT fund, isin AS child, weight / sum(weight) OVER (PARTITION BY fund) AS share FROM units),
t(portfolio, isin, weight, path, lv) AS (SELECT s_suppkey // 50, CAST(s_suppkey AS VARCHAR), 2.0::DOUBLE, []::VARCHAR[], 0 FROM supplier UNION ALL SELECT portfolio, child, t.weight * share, list_append(path, t.isin), lv + 1 FROM t JOIN sh ON t.isin = sh.fund WHERE NOT list_contains(path, t.isin) AND lv < 3)
SELECT portfolio, isin, round(sum(weight), 4) AS weight FROM t WHERE isin NOT IN (SELECT fund FROM units) OR list_contains(path, isin) OR lv = 3 GROUP BY ALL""")
def j16(spark, sf):
    child = F.expr("CASE WHEN l_partkey % 50 < 12 THEN cast(l_partkey % 10 AS string) ELSE concat('P', l_partkey % 50) END")
    units = D.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("fund"), child.alias("isin")).agg(F.sum("l_quantity").alias("weight"))
    items = D.read(spark, sf, "supplier").select(F.expr("s_suppkey div 50").alias("portfolio"), F.col("s_suppkey").cast("string").alias("isin"), F.lit(2.0).alias("weight"))
    return _r(P.look_through(items, units, depth=3))
