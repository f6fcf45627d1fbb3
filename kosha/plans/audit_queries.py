"""Queries of audits (E01, G29) and of samples checked against three sources (J29) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.functions import documents as X
from kosha.operators import audits as A
from kosha.operators import merge as M
from kosha.sources import adapters as D

from . import sql
from .registry import register

# A scheme-month is a supplier's month of shipments; its class goes by the supplier, and some have no key.
_AUDITS = """s AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS m, CASE l_suppkey % 4 WHEN 0 THEN 'factsheet_topn' WHEN 1 THEN 'full_portfolio' WHEN 2 THEN 'fortnightly' ELSE 'unknown' END AS class, CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS w FROM lineitem),
g AS (SELECT l_suppkey, m, class, count(*) AS n, round(coalesce(sum(w), 0), 6) AS c, max(w) AS top, count(w) AS k FROM s GROUP BY ALL),
audits AS (SELECT n_name AS amc, s_name AS fund, CAST(m AS DATE) AS month, class, n AS n_holdings, c AS coverage_pct, l_suppkey % 13 > 0 AS keyable, c > 105 OR coalesce(top > 100, false) AS suspect,
  CASE WHEN class = 'factsheet_topn' AND k > 0 AND n BETWEEN 8 AND 12 AND top <= 100 THEN 'top10_fallback' WHEN class <> 'factsheet_topn' AND c BETWEEN 95 AND 105 THEN 'complete_100' ELSE 'escalate' END AS tier
  FROM g JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""


def _audits(spark, sf):
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    kind = F.when(F.col("l_suppkey") % 4 == 0, "factsheet_topn").when(F.col("l_suppkey") % 4 == 1, "full_portfolio").when(F.col("l_suppkey") % 4 == 2, "fortnightly").otherwise("unknown")
    w = F.when(F.col("l_partkey") % 19 != 0, F.col("l_quantity").cast("double"))
    rows = D.read(spark, sf, "lineitem").select(F.struct(F.col("l_suppkey").alias("s"), month.alias("month")).alias("set_id"), kind.alias("kind"), w.alias("w"))
    found = X.tiers(rows, "set_id", "kind", "w").select(F.col("set_id.s").alias("scheme_id"), F.col("set_id.month").alias("month"), F.col("kind").alias("class"), "tier", "coverage_pct", "n_holdings", "escalate", "suspect")
    schemes = D.schemes(spark, sf).select("scheme_id", F.col("fund_name").alias("fund"), "amc")
    return found.join(schemes, "scheme_id").withColumn("keyable", F.col("scheme_id") % 13 > 0)


_ROLLED = """SELECT amc, month, class, CAST(4 * grouping(amc) + 2 * grouping(month) + grouping(class) AS BIGINT) AS level, count(*) AS n_schemes, count_if(n_holdings > 0) AS n_with_holdings, CAST(sum(n_holdings) AS BIGINT) AS n_holding_rows,
  count_if(tier = 'complete_100') AS n_complete_100, count_if(tier = 'top10_fallback') AS n_top10_fallback, count_if(tier = 'escalate') AS n_escalate, count_if(tier = 'escalate' OR suspect) AS n_escalated, count_if(suspect) AS n_suspect, count_if(NOT keyable) AS n_unkeyable
FROM audits GROUP BY GROUPING SETS ((amc, month, class), (amc), (month), (class), ())"""


@register("e01_g29_audit_roll_up", f"WITH {_AUDITS} {_ROLLED}")
def e01(spark, sf):
    return A.roll_up(_audits(spark, sf))


@register("e01_merged_totals", f"WITH {_AUDITS} {_ROLLED}")
def e01_merged(spark, sf):
    """Totals up to a day, stored, and those of later months merged into them: the same as those of all months at once."""
    a = _audits(spark, sf)
    return A.merge_totals(A.roll_up(a.where("month < '1997-01-01'")), A.roll_up(a.where("month >= '1997-01-01'")))


@register("g29_worst_offenders", f"""WITH {_AUDITS}, c AS (SELECT amc, fund, month, coverage_pct, tier, suspect FROM audits),
h AS (SELECT 'house' AS list, row_number() OVER (PARTITION BY amc ORDER BY coverage_pct, amc, fund, month) AS k, * FROM c QUALIFY k <= 5),
a AS (SELECT 'all' AS list, row_number() OVER (ORDER BY coverage_pct, amc, fund, month) AS k, * FROM c QUALIFY k <= 15),
u AS (SELECT 'suspect' AS list, row_number() OVER (ORDER BY coverage_pct DESC, amc, fund, month) AS k, * FROM c WHERE suspect QUALIFY k <= 20)
SELECT list, CAST(k AS INTEGER) AS k, amc, fund, month, coverage_pct, tier FROM (SELECT * FROM h UNION ALL SELECT * FROM a UNION ALL SELECT * FROM u)""")
def g29(spark, sf):
    return A.worst(_audits(spark, sf))


@register("j29_three_way_check", f"""WITH {sql.NAV}, last AS (SELECT scheme_id, max(d) AS d, arg_max(nav, d) AS nav FROM nav GROUP BY 1),
t AS (SELECT s_nationkey AS stratum, scheme_id, d, nav FROM last JOIN supplier ON s_suppkey = scheme_id QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256(CAST(scheme_id AS VARCHAR)), scheme_id) <= 3),
l AS (SELECT scheme_id, CASE WHEN scheme_id % 4 = 0 THEN d - 1 ELSE d END AS d, CASE WHEN scheme_id % 5 = 0 THEN nav * 1.001 ELSE nav END AS nav FROM last WHERE scheme_id % 11 <> 0),
s AS (SELECT scheme_id, nav + 0.004 * (scheme_id % 4) AS nav FROM last WHERE scheme_id % 6 <> 1)
SELECT stratum, count(*) AS n, count(l.scheme_id) AS live_checked, count_if(coalesce(l.d = t.d, false)) AS date_current, count_if(coalesce(abs(l.nav - t.nav) < 1e-4, false)) AS nav_match, count_if(coalesce(abs(s.nav - t.nav) < 0.01, false)) AS stored_match
FROM t LEFT JOIN l USING (scheme_id) LEFT JOIN s USING (scheme_id) GROUP BY 1""")
def j29(spark, sf):
    last = M.latest_wins(D.nav(spark, sf), ["scheme_id"], ["d"]).withColumnsRenamed({"d": "date", "nav": "value"})
    strata = D.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("scheme_id"), F.col("s_nationkey").alias("stratum"))
    picked = A.smallest_hashes(last.join(strata, "scheme_id"), "scheme_id", "stratum", 3)
    live = last.where("scheme_id % 11 <> 0").select("scheme_id", F.expr("CASE WHEN scheme_id % 4 = 0 THEN date_sub(date, 1) ELSE date END").alias("date"), F.expr("CASE WHEN scheme_id % 5 = 0 THEN value * 1.001D ELSE value END").alias("value"))
    stored = last.where("scheme_id % 6 <> 1").select("scheme_id", (F.col("value") + 0.004 * (F.col("scheme_id") % 4)).alias("value"))
    of_sample = lambda df: df.join(picked.select("scheme_id"), "scheme_id", "left_semi")
    checked = A.three_way(picked.select("scheme_id", "date", "value"), of_sample(live), of_sample(stored), "scheme_id").join(strata, "scheme_id")
    one = lambda c: F.sum(c.cast("long"))
    return checked.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), one(F.contains("only", F.lit("l"))).alias("live_checked"), *[one(F.col(c)).alias(c) for c in ("date_current", "nav_match", "stored_match")])
