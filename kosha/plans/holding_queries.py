"""Queries of enriched holdings (K09, G44) and of schemes with their own plan's series and benchmark (A14, A17, J18) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.operators import holdings as H
from kosha.sources import adapters as D

from . import sql
from .registry import register

# Lines of schemes: parts they hold, with the name, yield and hedge that their number gives.
_SCHEME_LINES = f"""{sql.HOLDINGS}, b AS (SELECT p_partkey AS k, p_name, p_brand, p_size, p_retailprice FROM part),
l AS (SELECT scheme_id, k, 'IN' || k AS isin, CASE k % 4 WHEN 0 THEN round(p_size / 5.0, 2) || '% ' || p_name || ' (15/06/2031)' ELSE p_name END AS company, CASE WHEN k % 6 = 0 THEN 'CRISIL AAA' ELSE p_brand END AS sector, CASE WHEN k % 5 < 2 THEN 'debt' WHEN k % 5 = 2 THEN 'stocks' ELSE '' END AS given,
  CASE WHEN k % 3 > 0 THEN round((k % 80) / 10.0 * CASE WHEN scheme_id % 4 = 0 THEN 0.01 ELSE 1.0 END, 4) END AS y, weight, CASE WHEN k % 7 = 1 THEN weight * 0.25 END AS hedged, CASE WHEN k % 7 = 2 THEN weight * 0.9 WHEN k % 14 = 1 THEN weight * 0.75 WHEN k % 14 = 8 THEN weight * 0.5 END AS unhedged,
  CASE k % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END AS confirmed, CASE WHEN p_size <= 15 THEN 'large' WHEN p_size <= 35 THEN 'mid' ELSE 'small' END AS cap FROM holdings JOIN b ON isin = k)"""


def _lines(spark, sf):
    k, size = F.col("k"), F.col("p_size")
    part = D.read(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_size")
    rows = D.holdings(spark, sf).join(part, F.col("isin") == k)
    rate = F.round(size / 5.0, 2)
    y = F.round((k % 80) / 10.0 * F.when(F.col("scheme_id") % 4 == 0, 0.01).otherwise(1.0), 4)
    return rows.select(
        "scheme_id", "k", F.concat(F.lit("IN"), k.cast("string")).alias("isin"), F.when(k % 4 == 0, F.concat(rate.cast("string"), F.lit("% "), "p_name", F.lit(" (15/06/2031)"))).otherwise(F.col("p_name")).alias("company"),
        F.when(k % 6 == 0, "CRISIL AAA").otherwise(F.col("p_brand")).alias("sector"), F.when(k % 5 < 2, "debt").when(k % 5 == 2, "stocks").otherwise("").alias("asset_class"), F.when(k % 3 > 0, y.cast("string")).alias("yield_text"), F.col("weight").alias("percent_nav"),
        F.when(k % 7 == 1, F.col("weight") * 0.25).alias("pct_hedged"), F.when(k % 7 == 2, F.col("weight") * 0.9).when(k % 14 == 1, F.col("weight") * 0.75).when(k % 14 == 8, F.col("weight") * 0.5).alias("pct_unhedged"),
    )


def _enriched(spark, sf):
    securities = D.securities(spark, sf).select(F.concat(F.lit("IN"), F.col("isin").cast("string")).alias("isin"), "cap", "confirmed_equity")
    b = D.bonds(spark, sf).where("isin % 2 = 0")
    bonds = b.select(F.concat(F.lit("IN"), F.col("isin").cast("string")).alias("isin"), "coupon", "maturity", F.when(F.col("isin") % 4 == 0, "AA").alias("rating"), (F.col("isin") % 90 / 9.0).alias("ytm")).withColumnRenamed("maturity", "maturity_date")
    return H.enrich_holdings(_lines(spark, sf).drop("k"), securities, bonds)


_ENRICHED = f"""{_SCHEME_LINES}, {sql.BONDS}, cat AS (SELECT isin AS bk, coupon AS bc, maturity AS bm, CASE WHEN isin % 4 = 0 THEN 'AA' END AS br, nullif(round(isin % 90 / 9.0, 4), 0) AS b_y FROM bonds WHERE isin % 2 = 0),
c1 AS (SELECT *, CASE WHEN given <> '' THEN given WHEN confirmed > 0 THEN 'stocks' ELSE 'debt' END AS kind FROM l),
c2 AS (SELECT * EXCLUDE (isin), CASE WHEN kind <> 'stocks' AND confirmed = 1 THEN '' ELSE isin END AS isin FROM c1),
c3 AS (SELECT c2.*, CASE WHEN kind = 'debt' THEN coalesce(CASE WHEN k % 4 = 0 THEN nullif(round(p / 5.0, 2), 0) END, bc) END AS coupon, CASE WHEN kind = 'debt' THEN coalesce(CASE WHEN k % 4 = 0 THEN DATE '2031-06-15' END, bm) END AS maturity_date,
  CASE WHEN kind = 'debt' THEN coalesce(CASE WHEN regexp_matches(upper(sector), 'A|B|SOV|NR') THEN sector END, br) END AS rating, CASE WHEN kind = 'debt' THEN coalesce(nullif(y, 0), b_y, y) END AS ytm0 FROM (SELECT c2.*, p_size AS p FROM c2 JOIN part ON p_partkey = k) c2 LEFT JOIN cat ON c2.isin = 'IN' || bk),
c4 AS (SELECT *, CASE WHEN max(nullif(ytm0, 0)) OVER (PARTITION BY scheme_id) < 1 AND ytm0 <> 0 THEN round(ytm0 * 100, 4) ELSE ytm0 END AS ytm, kind = 'stocks' AND (coalesce(hedged, 0) <> 0 OR unhedged IS NOT NULL) AS split FROM c3),
c5 AS (SELECT *, CASE WHEN split THEN round(CASE WHEN unhedged IS NULL THEN greatest(weight - coalesce(hedged, 0), 0) WHEN abs(unhedged + coalesce(hedged, 0) - weight) > greatest(0.02, 0.01 * weight) THEN least(unhedged, greatest(weight - coalesce(hedged, 0), 0)) ELSE unhedged END, 6) ELSE weight END AS net FROM c4),
enriched AS (SELECT scheme_id, isin, company, kind AS asset_class, coupon, maturity_date, rating, ytm, net AS percent_nav, CASE WHEN split THEN weight END AS percent_raw, false AS derived FROM c5
  UNION ALL SELECT scheme_id, '', 'Futures & Options (hedged equity leg)', 'future_options', NULL, NULL, NULL, NULL, round(sum(hedged), 6), NULL, true FROM c5 WHERE split GROUP BY scheme_id HAVING sum(hedged) > 1e-9)"""


@register("k09_enriched_holdings", f"WITH {_ENRICHED} SELECT scheme_id, isin, company, asset_class, round(coupon, 4) + 0.0 AS coupon, maturity_date, rating, round(ytm, 3) + 0.0 AS ytm, round(percent_nav, 6) + 0.0 AS percent_nav, round(percent_raw, 4) + 0.0 AS percent_raw, derived FROM enriched")
def k09(spark, sf):
    e = _enriched(spark, sf)
    r = lambda c, n: (F.round(c, n) + 0.0).alias(c)
    return e.select("scheme_id", "isin", "company", "asset_class", r("coupon", 4), "maturity_date", "rating", r("ytm", 3), r("percent_nav", 6), r("percent_raw", 4), "derived")


@register("g44_hedge_summary", f"""WITH {_ENRICHED} SELECT scheme_id, round(coalesce(sum(CASE WHEN asset_class = 'stocks' THEN coalesce(percent_raw, percent_nav) END), 0), 4) + 0.0 AS gross_equity_pct, round(coalesce(sum(CASE WHEN asset_class = 'stocks' THEN percent_nav END), 0), 4) + 0.0 AS net_equity_pct,
  round(coalesce(sum(CASE WHEN derived THEN percent_nav END), 0), 4) + 0.0 AS hedged_pct, count(percent_raw) AS n_hedged, count(percent_raw) > 0 AS has_hedge FROM enriched GROUP BY 1""")
def g44(spark, sf):
    s = H.hedge_summary(_enriched(spark, sf))
    return s.select("scheme_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("gross_equity_pct", "net_equity_pct", "hedged_pct")], "n_hedged", "has_hedge")


# Schemes of a direct and a regular plan; one of four has a code without prices, one of five none.
_TEXT = "CASE s_suppkey % 7 WHEN 0 THEN 'Alpha Nifty 50 Equal Weight' WHEN 1 THEN 'Beta Nifty Next 50' WHEN 2 THEN 'Gamma Bank' WHEN 3 THEN 'Delta Midcap' WHEN 4 THEN 'Epsilon Bees' WHEN 5 THEN 'Zeta Momentum' ELSE 'Eta Focused' END"
_INDEX = "CASE WHEN s_suppkey % 11 = 0 THEN 'nifty_it' END"
_CATEGORY = "CASE WHEN s_suppkey % 6 = 5 THEN 'Debt' ELSE 'Equity' END"
_DIRECT = "CASE WHEN s_suppkey % 4 > 0 THEN 'D' || s_suppkey END"
_REGULAR = "CASE WHEN s_suppkey % 5 > 0 THEN 'R' || s_suppkey END"
_NAMED = """CASE WHEN s_suppkey % 11 = 0 THEN 'NIFTY IT' WHEN s_suppkey % 6 = 5 THEN NULL ELSE CASE s_suppkey % 7 WHEN 0 THEN 'NIFTY 50 EQUAL WEIGHT' WHEN 1 THEN 'NIFTY NEXT 50' WHEN 2 THEN 'NIFTY BANK' WHEN 3 THEN 'NIFTY MIDCAP 150' WHEN 4 THEN 'NIFTY 50' WHEN 5 THEN 'NIFTY200 MOMENTUM 30' ELSE 'NIFTY 500' END END"""


def _schemes(spark, sf):
    return D.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("scheme_id"), F.expr(_DIRECT).alias("direct"), F.expr(_REGULAR).alias("regular"), F.expr(_INDEX).alias("index_name"), F.expr(_CATEGORY).alias("category"), F.expr(_TEXT).alias("fund_name"))


def _prices(spark, sf):
    """Direct plans of schemes by three have no prices."""
    nav = D.nav(spark, sf)
    direct = nav.where("scheme_id % 3 > 0").select(F.concat(F.lit("D"), F.col("scheme_id").cast("string")).alias("code"), "d", "nav")
    return direct.unionByName(nav.select(F.concat(F.lit("R"), F.col("scheme_id").cast("string")).alias("code"), "d", (F.col("nav") * 0.99).alias("nav")))


def _indices(spark, sf):
    """Every index but one has the series of the benchmark."""
    b = D.benchmark_nav(spark, sf)
    names = D.read(spark, sf, "supplier").select(F.expr(_NAMED).alias("index")).where("index IS NOT NULL AND index <> 'NIFTY BANK'").distinct()
    return names.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").select("index", "d", "nav")


_PLAN = f"""{sql.NAV}, sch AS (SELECT s_suppkey AS scheme_id, {_NAMED} AS index, CASE WHEN s_suppkey % 4 > 0 AND s_suppkey % 3 > 0 THEN 'direct' WHEN s_suppkey % 5 > 0 THEN 'regular' END AS plan FROM supplier),
pn AS (SELECT scheme_id, plan, d, CASE WHEN plan = 'direct' THEN nav ELSE nav * 0.99 END AS nav FROM nav JOIN sch USING (scheme_id) WHERE plan IS NOT NULL)"""


@register("a17_plan_series", f"WITH {_PLAN} SELECT scheme_id, plan, d, round(nav, 6) AS nav FROM pn")
def a17(spark, sf):
    return H.plan_series(_schemes(spark, sf), _prices(spark, sf)).withColumn("nav", F.round("nav", 6))


@register("j18_benchmark_index", f"SELECT s_suppkey AS scheme_id, {_NAMED} AS index FROM supplier")
def j18(spark, sf):
    c = F.col
    return _schemes(spark, sf).select("scheme_id", H.benchmark_of(c("index_name"), c("category"), c("fund_name")).alias("index"))


@register("a14_scheme_analytics", f"""WITH {_PLAN}, {sql.BENCH}, r AS (SELECT scheme_id, d, nav / lag(nav) OVER (PARTITION BY scheme_id ORDER BY d) - 1 AS ret, date_diff('day', lag(d) OVER (PARTITION BY scheme_id ORDER BY d), d) AS gap FROM pn), bret AS (SELECT d, nav / lag(nav) OVER (ORDER BY d) - 1 AS b FROM bench),
j AS (SELECT scheme_id, count(*) AS n, date_diff('day', min(d), max(d)) AS span, covar_samp(ret, b) / var_samp(b) AS beta, avg(ret) AS m, avg(b) AS mb, stddev_samp(ret - b) AS sd FROM r JOIN bret USING (d) JOIN sch USING (scheme_id) WHERE ret IS NOT NULL AND b IS NOT NULL AND index IS NOT NULL AND index <> 'NIFTY BANK' GROUP BY 1),
a AS (SELECT scheme_id, count(*) AS n, max(d) AS as_of, CASE WHEN date_diff('day', min(d), max(d)) >= 90 THEN power(arg_max(nav, d) / arg_min(nav, d), 365.25 / date_diff('day', min(d), max(d))) - 1 END AS cagr FROM pn GROUP BY 1), g AS (SELECT scheme_id, coalesce(max(gap), 0) AS max_gap FROM r GROUP BY 1)
SELECT sch.scheme_id, CASE WHEN index = 'NIFTY BANK' THEN 'NIFTY BANK (series unavailable)' ELSE index END AS benchmark, plan AS plan_used, a.n, as_of, round(cagr, 6) AS cagr_inception, CASE WHEN j.n >= 30 AND span >= 365 THEN round(beta, 6) END AS beta, CASE WHEN j.n >= 30 AND span >= 365 THEN round((m - beta * mb) * 252, 6) END AS alpha,
  CASE WHEN j.n >= 30 AND span >= 365 THEN round(sd * sqrt(252), 6) END AS tracking_error, CAST(max_gap AS INTEGER) AS max_gap, CASE WHEN plan IS NULL THEN 'no price history for this scheme' END AS error FROM sch LEFT JOIN a USING (scheme_id) LEFT JOIN j USING (scheme_id) LEFT JOIN g USING (scheme_id)""")
def a14(spark, sf):
    found = H.scheme_analytics(_schemes(spark, sf), _prices(spark, sf), _indices(spark, sf), "2001-11-05")
    r = lambda c: F.round(c, 6).alias(c)
    return found.select("scheme_id", "benchmark", "plan_used", "n", "as_of", r("cagr_inception"), r("beta"), r("alpha"), r("tracking_error"), "max_gap", "error")
