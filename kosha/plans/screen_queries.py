"""Queries of junk names, holdings, tickets and stocks (Q12, Q13, Q16, J14) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.operators import screens as S
from kosha.sources import adapters as D

from .registry import register

_NAMES = "CASE p_partkey % 8 WHEN 0 THEN upper(p_type) WHEN 1 THEN p_name || ' fund' WHEN 2 THEN 'Top 10 Holdings by ' || p_name WHEN 3 THEN 'Sheet' || p_size || ' ' || p_name WHEN 4 THEN p_type || p_size WHEN 5 THEN 'Returns ' || p_name WHEN 6 THEN substr(p_name, 1, 4) ELSE '  ' END"


@register("q12_junk_names", "SELECT p_partkey AS k, p_partkey % 8 IN (0, 2, 3, 4, 5, 7) AS junk FROM part")
def q12(spark, sf):
    return D.read(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.is_junk_name(F.expr(_NAMES)).alias("junk"))


_COMPANY = "CASE p_partkey % 10 WHEN 0 THEN 'Top 10 Holdings' WHEN 1 THEN '# ' || p_name WHEN 2 THEN 'Quantity' WHEN 3 THEN p_name || ' Returns (Annualised)' ELSE p_name END"
_ISIN = "CASE p_partkey % 3 WHEN 0 THEN 'IN' || lpad(CAST(p_partkey AS VARCHAR(20)), 10, '0') WHEN 1 THEN 'NA' ELSE NULL END"
_SECTION = "CASE p_size % 4 WHEN 0 THEN 'Total Market Value of the portfolio' WHEN 1 THEN 'Equity' END"


@register("q13_looks_like_holding", """SELECT p_partkey AS k, CASE WHEN p_partkey % 10 < 4 THEN false WHEN p_partkey % 3 = 0 THEN p_size < 45 ELSE p_size % 4 > 0 AND (p_size < 45 AND p_partkey % 7 > 0 OR p_partkey % 5 > 0 OR p_partkey % 11 = 0) END AS holding FROM part""")
def q13(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    percent = F.when((k % 3 == 0) | (k % 7 > 0), F.when(size < 45, size / 10.0).otherwise(5000.0))
    quantity = F.when(k % 11 == 0, "1,250").otherwise("n/a")
    return D.read(spark, sf, "part").select(k.alias("k"), S.looks_like_holding(F.expr(_COMPANY), F.expr(_ISIN), F.expr(_SECTION), percent, F.when(k % 5 > 0, F.col("p_retailprice").cast("double")), quantity).alias("holding"))


# A ticket for each supplier and month; of some the month is not known.
_TICKETS = "t AS (SELECT l_suppkey, CASE WHEN l_suppkey % 9 = 0 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m') END AS month, CASE WHEN l_suppkey % 7 > 0 THEN round(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 7, 2) END AS coverage_pct, CASE (l_suppkey + month(l_shipdate)) % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'CLOSED' ELSE 'MANUAL' END AS status FROM lineitem GROUP BY l_suppkey, strftime(l_shipdate, '%Y-%m'), month(l_shipdate))"


@register("q16_select_tickets", f"WITH {_TICKETS} SELECT n_name AS amc, s_name AS scheme, month, coverage_pct FROM t JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE status = 'OPEN' ORDER BY CASE WHEN month = 'unknown' THEN '' ELSE month END, coalesce(coverage_pct, 0), n_name, s_name LIMIT 200")
def q16(spark, sf):
    k, d = F.col("l_suppkey"), F.col("l_shipdate")
    rows = D.read(spark, sf, "lineitem").groupBy(k, F.date_format(d, "yyyy-MM").alias("ym"), F.month(d).alias("m")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("q"))
    status = F.when((k + F.col("m")) % 3 == 0, "OPEN").when((k + F.col("m")) % 3 == 1, "CLOSED").otherwise("MANUAL")
    tickets = rows.select(k.alias("scheme_id"), F.when(k % 9 == 0, "unknown").otherwise(F.col("ym")).alias("month"), F.when(k % 7 > 0, F.round(F.col("q") / 7, 2)).alias("coverage_pct"), status.alias("status"))
    named = tickets.join(D.schemes(spark, sf).select("scheme_id", F.col("fund_name").alias("scheme"), "amc"), "scheme_id")
    return S.select_tickets(named, 200).select("amc", "scheme", "month", "coverage_pct")


_ITEMS = "i AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'in' || p_partkey END AS isin, CASE s_suppkey % 3 WHEN 0 THEN upper(p_name || ' ' || p_brand) WHEN 1 THEN substr(p_name || ' ' || p_brand, 3) ELSE 'zz' END AS name FROM supplier JOIN part ON p_partkey = s_suppkey * 19 + 3)"


@register("j14_resolve_stocks", f"""WITH {_ITEMS}, s AS (SELECT 'IN' || p_partkey AS isin, lower(p_name || ' ' || p_brand) AS name, CASE WHEN p_size % 2 = 0 THEN lower(p_type || ' ' || p_name || ' ' || p_brand) ELSE '' END AS aliases FROM part WHERE p_partkey % 7 > 0)
SELECT id, tier, s_isin AS isin FROM (SELECT id, s.isin AS s_isin, CASE WHEN upper(i.isin) = s.isin THEN 0 WHEN lower(i.name) = s.name THEN 1 WHEN length(i.name) >= 3 AND (contains(s.name, lower(i.name)) OR contains(aliases, lower(i.name))) THEN 2 END AS tier FROM i, s) WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, s_isin) = 1""")
def j14(spark, sf):
    part = D.read(spark, sf, "part").withColumn("label", F.concat_ws(" ", "p_name", "p_brand"))
    k = F.col("s_suppkey")
    items = D.read(spark, sf, "supplier").join(part, F.col("p_partkey") == k * 19 + 3).select(k.alias("id"), F.when(k % 4 == 0, F.concat(F.lit("in"), F.col("p_partkey").cast("string"))).alias("isin"), F.when(k % 3 == 0, F.upper("label")).when(k % 3 == 1, F.substring("label", 3, 100)).otherwise("zz").alias("name"))
    securities = part.where("p_partkey % 7 > 0").select(F.concat(F.lit("IN"), F.col("p_partkey").cast("string")).alias("isin"), F.col("label").alias("name"), F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_type", "label")).alias("aliases"))
    return S.resolve_stocks(items, securities)
