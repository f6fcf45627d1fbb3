"""Queries of fundamental records (U) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.operators import fundamentals as U
from kosha.sources import adapters as D

from .registry import register

# Yearly records of each supplier from its line items; some items are left out by number.
_SUMS = "sum(l_extendedprice * (1 - l_discount)) / 1e4 AS s, sum(l_extendedprice * l_tax) / 1e4 AS t, sum(l_quantity) AS q, sum(l_extendedprice * l_discount) / 1e4 AS d"
RECORDS = f"""g AS (SELECT l_suppkey AS isin, year(l_shipdate) AS fy, {_SUMS} FROM lineitem GROUP BY ALL),
rec AS (SELECT isin, fy, CASE WHEN isin % 7 <> 0 THEN s END AS revenue_from_operations, CASE WHEN isin % 7 = 0 THEN s END AS interest_earned, t AS other_income, CASE WHEN isin % 3 <> 0 THEN s + t END AS total_income, CASE WHEN isin % 11 = 0 THEN s * 5 + 200 ELSE s * 0.7 END AS total_expenses, q * 0.2 AS other_expenses, s * 0.4 AS cost_of_materials, q * 0.1 AS depreciation_amortisation, d * 0.3 AS finance_costs,
  CASE WHEN isin % 5 = 0 THEN t * 0.1 END AS exceptional_items, s * 0.2 AS pbt, CASE WHEN isin % 13 = 0 THEN -s ELSE s * 0.15 END AS pat, s * 0.1 + d AS cfo, CASE WHEN isin % 4 <> 0 THEN s * 0.15 / 2 END AS eps_basic, CASE WHEN isin % 2 = 0 THEN s * 0.01 END AS dps, s * 2 + q AS total_assets, CASE WHEN isin % 6 <> 0 THEN s END AS total_equity, CASE WHEN isin % 9 = 0 THEN s * 3 WHEN isin % 9 < 4 THEN s + q END AS total_liabilities,
  s * 0.2 AS share_capital, s * 0.8 AS reserves_surplus, CASE WHEN isin % 8 <> 0 THEN d END AS borrowings_non_current, CASE WHEN isin % 8 < 5 THEN t END AS borrowings_current, q * 0.05 AS cash_equivalents, s * 0.1 + q * 0.3 AS trade_receivables, q * 3.0 AS ppe_net, CASE WHEN isin % 10 = 0 THEN 0.1 ELSE 2.0 END AS face_value FROM g)"""


def records(spark, sf):
    df = D.read(spark, sf, "lineitem").selectExpr("l_suppkey AS isin", "year(l_shipdate) AS fy", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    g = df.groupBy("isin", "fy").agg(*[F.expr(x.strip()) for x in _SUMS.replace("AS s, ", "AS s|").replace("AS t, ", "AS t|").replace("AS q, ", "AS q|").split("|")])
    c, k = F.col, lambda n: F.col("isin") % n
    s, t, q, d = c("s"), c("t"), c("q"), c("d")
    items = {
        "revenue_from_operations": F.when(k(7) != 0, s), "interest_earned": F.when(k(7) == 0, s), "other_income": t, "total_income": F.when(k(3) != 0, s + t), "total_expenses": F.when(k(11) == 0, s * 5 + 200).otherwise(s * 0.7), "other_expenses": q * 0.2, "cost_of_materials": s * 0.4, "depreciation_amortisation": q * 0.1, "finance_costs": d * 0.3,
        "exceptional_items": F.when(k(5) == 0, t * 0.1), "pbt": s * 0.2, "pat": F.when(k(13) == 0, -s).otherwise(s * 0.15), "cfo": s * 0.1 + d, "eps_basic": F.when(k(4) != 0, s * 0.15 / 2), "dps": F.when(k(2) == 0, s * 0.01), "total_assets": s * 2 + q, "total_equity": F.when(k(6) != 0, s), "total_liabilities": F.when(k(9) == 0, s * 3).when(k(9) < 4, s + q),
        "share_capital": s * 0.2, "reserves_surplus": s * 0.8, "borrowings_non_current": F.when(k(8) != 0, d), "borrowings_current": F.when(k(8) < 5, t), "cash_equivalents": q * 0.05, "trade_receivables": s * 0.1 + q * 0.3, "ppe_net": q * 3.0, "face_value": F.when(k(10) == 0, 0.1).otherwise(2.0),
    }
    return g.select("isin", "fy", *[v.alias(n) for n, v in items.items()])


def _r(df, n=4):
    return df.select(*[(F.round(c, n) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


DERIVED = f"""{RECORDS}, de AS (SELECT * REPLACE (CASE WHEN revenue_from_operations IS NULL THEN interest_earned + coalesce(other_income, 0) ELSE revenue_from_operations END AS revenue_from_operations, CASE WHEN total_equity IS NULL THEN share_capital + reserves_surplus ELSE total_equity END AS total_equity,
  CASE WHEN total_liabilities IS NULL THEN total_assets - CASE WHEN total_equity IS NULL THEN share_capital + reserves_surplus ELSE total_equity END ELSE total_liabilities END AS total_liabilities),
  coalesce(total_income, revenue_from_operations) - total_expenses + depreciation_amortisation + finance_costs - coalesce(exceptional_items, 0) AS ebitda, CASE WHEN borrowings_non_current IS NOT NULL OR borrowings_current IS NOT NULL THEN coalesce(borrowings_non_current, 0) + coalesce(borrowings_current, 0) END AS total_debt FROM rec)"""
_D = ("ebitda", "total_debt", "revenue_from_operations", "total_equity", "total_liabilities")


@register("u05_derived_items", f"WITH {DERIVED} SELECT isin, fy, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in _D)} FROM de")
def u05(spark, sf):
    return _r(U.derive_items(records(spark, sf)).select("isin", "fy", *_D))


@register("u04_validate_statement", f"""WITH {RECORDS} SELECT isin, fy, concat_ws(',', CASE WHEN abs(total_assets) > 1e-9 AND abs(total_assets - total_equity - total_liabilities) / abs(total_assets) > 0.005 THEN 'identity_assets_ne' END, CASE WHEN revenue_from_operations < 0 THEN 'revenue_negative' END,
CASE WHEN pbt <> 0 AND abs(pat) > abs(pbt) * 3 + 1 THEN 'pat_exceeds_pbt' END, CASE WHEN coalesce(total_income, revenue_from_operations) > 0 AND total_expenses > coalesce(total_income, revenue_from_operations) * 3 + 100 THEN 'expenses_far_above_income' END) AS issues FROM rec""")
def u04(spark, sf):
    return U.issues(records(spark, sf)).select("isin", "fy", F.array_join("issues", ",").alias("issues"))


_SHARES = """la AS (SELECT isin, arg_max(pat, fy) AS pat, arg_max(eps_basic, fy) FILTER (eps_basic IS NOT NULL) AS eps FROM rec GROUP BY 1),
sh AS (SELECT isin, CASE WHEN isin % 4 <> 0 AND pat <> 0 AND eps > 0 THEN pat * 1e7 / eps WHEN isin % 10 <> 0 THEN sc * 1e7 / 2 END AS shares FROM la JOIN (SELECT isin, arg_max(share_capital, fy) AS sc FROM rec GROUP BY 1) USING (isin))"""


def _shares(spark, sf):
    r = records(spark, sf)
    ttm = r.where("isin % 3 = 1").groupBy("isin").agg(F.max_by("pat", "fy").alias("pat"), F.max_by("eps_basic", "fy").alias("eps_basic"))
    return U.shares_outstanding(ttm, r.withColumn("end", F.col("fy")).withColumn("annual", F.lit(True)))


@register("u06_shares_outstanding", f"WITH {RECORDS}, {_SHARES} SELECT isin, round(shares, 2) AS shares FROM sh")
def u06(spark, sf):
    return _r(_shares(spark, sf), 2)


_PS = f"""{DERIVED}, {_SHARES}, lt AS (SELECT isin, max(fy) AS fy FROM de GROUP BY 1), fa AS (SELECT de.*, shares, 50.0 + isin % 400 AS price FROM de JOIN lt USING (isin, fy) LEFT JOIN sh USING (isin)),
ps AS (SELECT isin, price, eps_basic AS eps, dps, round(total_equity * 1e7 / shares, 2) AS bvps, round(revenue_from_operations * 1e7 / shares, 2) AS sps, round(cfo * 1e7 / shares, 2) AS cfps, round(price * shares / 1e7, 1) AS market_cap_cr, CASE WHEN shares IS NOT NULL THEN round(total_debt - coalesce(cash_equivalents, 0), 1) END AS net_debt_cr, round(price * shares / 1e7 + total_debt - coalesce(cash_equivalents, 0), 1) AS ev_cr, ebitda FROM fa)"""


def _per_share(spark, sf):
    latest = U.derive_items(records(spark, sf))
    names = ["eps_basic", "dps", "total_equity", "revenue_from_operations", "cfo", "total_debt", "cash_equivalents", "ebitda"]
    latest = latest.groupBy("isin").agg(F.max_by(F.struct(*names), "fy").alias("x")).select("isin", "x.*").withColumn("price", 50.0 + F.col("isin") % 400)
    return U.per_share(latest.join(_shares(spark, sf), "isin", "left"))


_PSN = "bvps sps cfps market_cap_cr net_debt_cr ev_cr".split()


@register("u07_per_share_base", f"WITH {_PS} SELECT isin, price, round(eps, 4) AS eps, round(dps, 4) AS dps, {', '.join(_PSN)} FROM ps")
def u07(spark, sf):
    return _r(_per_share(spark, sf).select("isin", "price", "eps", "dps", *_PSN))


@register("u12_valuation", f"""WITH {_PS}, v AS (SELECT *, isin % 5 / 20 - 0.05 AS g FROM ps) SELECT isin, round(CASE WHEN eps > 0 THEN price / eps END, 4) AS pe, round(CASE WHEN bvps > 0 THEN price / bvps END, 4) AS pb, round(CASE WHEN sps > 0 THEN price / sps END, 4) AS ps, round(CASE WHEN cfps > 0 THEN price / cfps END, 4) AS pcf, round(100 * dps / price, 2) AS dividend_yield_pct, round(CASE WHEN eps > 0 THEN 100 * eps / price END, 2) AS earnings_yield_pct,
round(CASE WHEN ebitda > 0 THEN ev_cr / ebitda END, 4) + 0.0 AS ev_ebitda, CASE WHEN g > 0 AND eps > 0 THEN round(price / eps / (g * 100), 2) END AS peg, CASE WHEN eps > 0 AND bvps > 0 THEN round(sqrt(22.5 * bvps * eps), 2) END AS graham_number FROM v""")
def u12(spark, sf):
    base = _per_share(spark, sf)
    return _r(U.valuation(base, base.select("isin", (F.col("isin") % 5 / 20 - 0.05).alias("rev_cagr"))))


@register("u15_beneish", f"""WITH {DERIVED}, p AS (SELECT c.isin, c.fy, (c.trade_receivables / c.revenue_from_operations) / (b.trade_receivables / b.revenue_from_operations) AS dsri, ((b.revenue_from_operations - b.cost_of_materials) / b.revenue_from_operations) / ((c.revenue_from_operations - c.cost_of_materials) / c.revenue_from_operations) AS gmi, c.revenue_from_operations / b.revenue_from_operations AS sgi,
(b.depreciation_amortisation / b.ppe_net) / (c.depreciation_amortisation / c.ppe_net) AS depi, (c.other_expenses / c.revenue_from_operations) / (b.other_expenses / b.revenue_from_operations) AS sgai, (c.total_liabilities / c.total_assets) / (b.total_liabilities / b.total_assets) AS lvgi, (c.pbt - c.cfo) / abs(c.total_assets) AS tata FROM de c JOIN de b ON b.isin = c.isin AND b.fy = c.fy - 1),
m AS (SELECT isin, fy, -4.84 + 0.92 * dsri + 0.528 * gmi + 0.404 + 0.892 * sgi + 0.115 * depi - 0.172 * sgai + 4.679 * tata - 0.327 * lvgi AS m FROM p) SELECT isin, fy, round(m, 3) AS m_score, m > -1.78 AS flagged FROM m""")
def u15(spark, sf):
    return U.beneish(U.derive_items(records(spark, sf)))
