"""Queries of names, documents, corporate-action subjects and bond texts (N); the oracles know what each made-up text states."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.functions import documents as X
from kosha.functions import text as T
from kosha.sources import adapters as D

from .registry import register


_FILE = "CASE k % 6 WHEN 0 THEN 'x/Fact-Sheet_' || k WHEN 1 THEN 'y/monthly_portfolio_' || k WHEN 2 THEN 'FORTNIGHTLY portfolio' WHEN 3 THEN 'scan-' || k WHEN 4 THEN 'Portfolio ' || k END"
_NAME = "CASE WHEN k % 6 = 4 AND k % 4 = 0 THEN 'Top 10 Holdings' WHEN k % 5 = 0 THEN 'BSE Top 10 Banks ETF' END"


@register("n21_document_class", "SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'factsheet_topn' WHEN 1 THEN 'full_portfolio' WHEN 2 THEN 'fortnightly' WHEN 4 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'factsheet_topn' ELSE 'full_portfolio' END ELSE 'unknown' END AS class FROM supplier")
def n21(spark, sf):
    k = D.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    t = k.select("k", F.expr(_FILE).alias("file"), F.expr(_NAME).alias("name"))
    return t.select("k", X.document_class(F.col("file"), F.col("name")).alias("class"))


_SETS = ["l_suppkey * 10 + l_linenumber AS set_id", "CASE l_suppkey % 4 WHEN 0 THEN 'factsheet_topn' WHEN 1 THEN 'full_portfolio' WHEN 2 THEN 'fortnightly' END AS kind", "CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_quantity * CASE WHEN l_suppkey % 3 = 0 THEN 0.05 ELSE 0.04 END END AS w"]


@register("n22_tiers", f"""WITH r AS (SELECT {', '.join(_SETS)} FROM lineitem), g AS (SELECT set_id, coalesce(kind, 'unknown') AS kind, count(*) AS n, round(coalesce(sum(w), 0), 6) AS c, max(w) AS top, count(w) AS k FROM r GROUP BY ALL),
t AS (SELECT *, CASE WHEN kind = 'factsheet_topn' AND k > 0 AND n BETWEEN 8 AND 12 AND top <= 100 THEN 'top10_fallback' WHEN kind <> 'factsheet_topn' AND c BETWEEN 95 AND 105 THEN 'complete_100' ELSE 'escalate' END AS tier FROM g)
SELECT set_id, kind, tier, c AS coverage_pct, n AS n_holdings, tier = 'escalate' OR c > 105 OR coalesce(top > 100, false) AS escalate, c > 105 OR coalesce(top > 100, false) AS suspect FROM t""")
def n22(spark, sf):
    rows = D.read(spark, sf, "lineitem").selectExpr(*_SETS)
    return X.tiers(rows.withColumn("w", F.concat(F.col("w").cast("string"), F.lit(" %"))), "set_id", "kind", "w")


_SUBJECT = """CASE k % 11 WHEN 10 THEN concat('Stock Split Rs 10/- Rs 2/- Dividend Rs ', k % 5 + 1, ' Per Share') WHEN 9 THEN concat('Interim Div - Rs ', k % 6 + 1, '/- Per Share + Face Value Split (Sub-Division) - From Rs 10/- Per Share To Re 1/- Per Share') WHEN 0 THEN concat('Interim Dividend - Rs ', k % 40 + 1, ' Per Share') WHEN 1 THEN concat('Agm/Div-Rs.', k % 7 + 1, '..50/- Per Equity Share') WHEN 2 THEN concat('Dividend Rs 2 Per Share + Special Dividend Re ', k % 5 + 1, ' Pershare') WHEN 3 THEN concat('Dividend - Rs ', k % 30 + 4, ' Per Share (Including Special Dividend Rs 3 Per Share)')
 WHEN 4 THEN concat('Bonus ', k % 4 + 1, ':', k % 3 + 1) WHEN 5 THEN concat('Face Value Split (Sub-Division) - From Rs ', k % 5 + 5, '/- Per Share To Re 1/- Per Share') WHEN 6 THEN concat('Fv Splt Frm Rs 10 To Rs 2 and Bonus 1:', k % 2 + 1) WHEN 7 THEN 'Bonus 1:1 Preference shares' ELSE 'Annual General Meeting' END"""


@register("n24_subject_events", """SELECT s_suppkey AS k, CASE s_suppkey % 11 WHEN 9 THEN s_suppkey % 6 + 1.0 WHEN 0 THEN s_suppkey % 40 + 1.0 WHEN 1 THEN s_suppkey % 7 + 1.5 WHEN 2 THEN s_suppkey % 5 + 3.0 WHEN 3 THEN s_suppkey % 30 + 4.0 END AS dividend,
CASE s_suppkey % 11 WHEN 9 THEN 10.0 WHEN 10 THEN 5.0 WHEN 4 THEN (s_suppkey % 4 + s_suppkey % 3 + 2.0) / (s_suppkey % 3 + 1) WHEN 5 THEN s_suppkey % 5 + 5.0 WHEN 6 THEN 5.0 * (2 + s_suppkey % 2) / (s_suppkey % 2 + 1) END AS split FROM supplier""")
def n24(spark, sf):
    k = D.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    return k.withColumn("s", F.expr(_SUBJECT)).select("k", *[v.alias(n) for n, v in X.subject_events(F.col("s")).items()])


@register("n25_n28_bond_texts", """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey % 12 + 0.25 END AS coupon, CAST(CASE s_suppkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 12 WHEN 3 THEN 1 END AS DOUBLE) AS payments, CASE s_suppkey % 5 WHEN 0 THEN 0.01 WHEN 2 THEN 0.1 WHEN 3 THEN 0.01 ELSE 1.0 END AS scale FROM supplier""")
def n25(spark, sf):
    k = D.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    t = k.select("k", F.expr("CASE k % 4 WHEN 3 THEN 'plain note' WHEN 2 THEN concat('GOI FRB ', k % 12, '.25% 2030') ELSE concat('NCD ', k % 12, '.25 % 2031') END").alias("a"), F.expr("CASE k % 6 WHEN 0 THEN ' Half-yearly' WHEN 1 THEN 'Quarterly' WHEN 2 THEN 'monthly' WHEN 3 THEN 'Annual' WHEN 4 THEN '0' END").alias("b"), F.expr("CASE k % 5 WHEN 0 THEN 'Rs. in Lakhs' WHEN 1 THEN '(₹ in crores)' WHEN 2 THEN 'INR in million' WHEN 3 THEN 'Figures in Lacs' ELSE 'no unit' END").alias("c"))
    return t.select("k", X.coupon(F.col("a")).alias("coupon"), X.payments_a_year(F.col("b")).cast("double").alias("payments"), X.unit_scale(F.col("c")).alias("scale"))


@register("n35_quarter_start", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(CASE WHEN month(o_orderdate) % 3 = 1 AND day(o_orderdate) < 10 THEN date_trunc('quarter', o_orderdate) - INTERVAL 3 MONTH ELSE date_trunc('quarter', o_orderdate) END AS DATE) AS start FROM orders")
def n35(spark, sf):
    d = D.read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return d.select("d", X.quarter_start(F.col("d")).alias("start"))


_TAIL = "CASE k % 9 WHEN 7 THEN ' Beta-Direct' WHEN 8 THEN ' Multi-Income' WHEN 0 THEN ' - Direct Plan - Growth' WHEN 1 THEN ' - Regular - IDCW' WHEN 2 THEN ' Direct Growth Option' WHEN 3 THEN ' - Growth (Monthly Payout)' WHEN 4 THEN ' - Income Distribution cum Capital Withdrawal' ELSE '' END"


@register("n03_n04_names", """SELECT s_suppkey AS k, 'Alpha Fund ' || s_suppkey || CASE s_suppkey % 9 WHEN 4 THEN ' - Income Distribution cum' WHEN 7 THEN ' Beta-Direct' WHEN 8 THEN ' Multi-Income' ELSE '' END AS navall, ['adityabirlasunlife', 'iciciprudential', 'iciciprudential', 'kotak', 'nippon', 'plainvalue'][CAST(s_suppkey % 6 + 1 AS INTEGER)] || 'fund' || s_suppkey || 'directplan' AS canon FROM supplier""")
def n03(spark, sf):
    k = D.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    brands = F.array(*map(F.lit, ("Aditya Birla SL", "ICICI Pru", "ICICI Prudential", "Kotak Mahindra", "Nippon India", "Plain Value")))
    t = k.select("k", F.concat(F.lit("Alpha Fund "), F.col("k"), F.expr(_TAIL)).alias("a"), F.concat(F.get(brands, (F.col("k") % 6).cast("int")), F.lit(" Fund "), F.col("k"), F.lit(" - Direct Plan - Growth")).alias("b"))
    return t.select("k", T.strip_plan_navall(F.col("a")).alias("navall"), T.canon_name(F.col("b")).alias("canon"))


@register("n05_clean_scheme_text", "SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 5 THEN 'UTI CHILDREN''S ' || s_suppkey ELSE 'Beta Fund ' || s_suppkey END AS name FROM supplier")
def n05(spark, sf):
    k = D.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    t = k.withColumn("t", F.expr("CASE k % 6 WHEN 0 THEN concat('Beta Fund ', k, '\\nan open ended scheme') WHEN 1 THEN concat('Beta Fund ', k, ' (An open ended equity scheme)') WHEN 2 THEN concat('Beta Fund ', k, ' - 31 July 2026') WHEN 3 THEN concat('Portfolio of Beta Fund ', k, ' as on 31-Jul-2026') WHEN 4 THEN concat('IB21-Beta Fund ', k) ELSE concat('UTI CHILDREN 039 S ', k) END"))
    return t.select("k", T.clean_scheme_text(F.col("t")).alias("name"))


@register("n26_n38_segments", """SELECT s_suppkey AS k, CASE s_suppkey % 8 WHEN 0 THEN 'G-Sec' WHEN 1 THEN 'T-Bill' WHEN 2 THEN 'State Govt / SDL' WHEN 3 THEN 'STRIPPED Debt' WHEN 4 THEN 'Certificate of Deposit' ELSE 'Corporate Bond' END AS segment, CASE WHEN s_suppkey % 9 > 0 THEN round(s_suppkey % 9 / 7, 6) END AS ter FROM supplier""")
def n26(spark, sf):
    k = D.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    t = k.select("k", F.expr("CASE k % 8 WHEN 0 THEN ' gs' WHEN 1 THEN 'TB' WHEN 2 THEN 'Sg' WHEN 3 THEN 'VZ' WHEN 4 THEN 'CD ' WHEN 5 THEN 'XX' WHEN 6 THEN '' END").alias("s"), F.concat((F.col("k") % 9 / 7).cast("string"), F.lit("%")).alias("t"))
    return t.select("k", X.segment(F.col("s")).alias("segment"), X.expense_ratio(F.col("t")).alias("ter"))
