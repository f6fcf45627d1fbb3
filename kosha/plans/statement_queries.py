"""Queries of statements to the end (U16 to U18, U20 to U22) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.operators import annual_table as T
from kosha.sources import adapters as D

from .fundamental_queries import RECORDS, records
from .registry import register

# What the yearly records of fundamental_queries lack; suppliers by 17 have no yearly records at all.
_EXTRA = {
    "tax_expense": "pbt * 0.25", "inventory": "CASE WHEN isin % 5 <> 1 THEN cost_of_materials * 0.2 END", "trade_payables": "other_expenses * 0.5", "total_current_assets": "cash_equivalents + trade_receivables + cost_of_materials * 0.2",
    "total_current_liabilities": "CASE WHEN isin % 7 <> 3 THEN other_expenses * 2 END", "capex": "CASE WHEN isin % 3 <> 2 THEN depreciation_amortisation * 1.2 END", "total_debt": "CASE WHEN borrowings_non_current IS NOT NULL THEN borrowings_non_current * 2 END",
    "ebitda": "CASE WHEN isin % 4 = 1 THEN total_expenses * 0.3 END", "shares_outstanding": "CASE WHEN isin % 3 = 0 THEN share_capital * 100 END",
}
_ANNUAL = f'{RECORDS}, ann AS (SELECT *, make_date(fy, 12, 31) AS "end", ' + ", ".join(f"{v} AS {k}" for k, v in _EXTRA.items()) + " FROM rec WHERE isin % 17 <> 0)"
_QUARTERS = """qs AS (SELECT l_suppkey AS isin, year(l_shipdate) AS fy, quarter(l_shipdate) AS q, sum(l_extendedprice * (1 - l_discount)) / 1e4 AS s, sum(l_extendedprice * l_tax) / 1e4 AS t FROM lineitem GROUP BY ALL),
quarters AS (SELECT isin, fy, q, last_day(make_date(fy, q * 3, 1)) AS "end", CASE WHEN isin % 7 <> 0 THEN s * CASE WHEN isin % 9 = 0 THEN 0.9 ELSE 1.0 END END AS revenue_from_operations, s + t AS total_income, s * 0.2 AS pbt, s * 0.15 AS pat,
  CASE WHEN isin % 4 <> 0 THEN s * 0.15 / 2 END AS eps_basic, CASE WHEN q = 4 THEN 'Audited' ELSE 'Unaudited' END AS audit, q = 2 AS derived FROM qs WHERE NOT (isin % 6 = 1 AND q = 3))"""
_FLOWS = ("revenue_from_operations", "total_income", "total_expenses", "cost_of_materials", "depreciation_amortisation", "finance_costs", "exceptional_items", "pbt", "pat", "cfo", "capex", "tax_expense", "eps_basic", "dps")
_TTM = "ttm AS (SELECT isin, \"end\", " + ", ".join(f"{x} * 1.05 AS {x}" for x in _FLOWS) + " FROM ann WHERE isin % 5 <> 2 QUALIFY row_number() OVER (PARTITION BY isin ORDER BY fy DESC) = 1)"


def _annual(spark, sf):
    return records(spark, sf).where("isin % 17 <> 0").selectExpr("*", "make_date(fy, 12, 31) AS end", *[f"{v} AS {k}" for k, v in _EXTRA.items()])


def _quarters(spark, sf):
    g = D.read(spark, sf, "lineitem").selectExpr("l_suppkey AS isin", "year(l_shipdate) AS fy", "quarter(l_shipdate) AS q", "l_extendedprice * (1 - l_discount) AS s", "l_extendedprice * l_tax AS t").groupBy("isin", "fy", "q").agg((F.sum("s") / 1e4).alias("s"), (F.sum("t") / 1e4).alias("t"))
    return g.where("NOT (isin % 6 = 1 AND q = 3)").selectExpr(
        "isin", "fy", "q", "last_day(make_date(fy, q * 3, 1)) AS end", "CASE WHEN isin % 7 <> 0 THEN s * CASE WHEN isin % 9 = 0 THEN 0.9D ELSE 1.0D END END AS revenue_from_operations", "s + t AS total_income", "s * 0.2 AS pbt", "s * 0.15 AS pat",
        "CASE WHEN isin % 4 <> 0 THEN s * 0.15 / 2 END AS eps_basic", "CASE WHEN q = 4 THEN 'Audited' ELSE 'Unaudited' END AS audit", "q = 2 AS derived",
    )


def _ttm(spark, sf):
    from pyspark.sql.window import Window

    last = _annual(spark, sf).where("isin % 5 <> 2").withColumn("k", F.row_number().over(Window.partitionBy("isin").orderBy(F.desc("fy")))).where("k = 1")
    return last.select("isin", "end", *[(F.col(x) * 1.05).alias(x) for x in _FLOWS])


def _fixed(df, n=4):
    return df.select(*[(F.round(c, n) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _means(x):
    return f"coalesce(({x} + p_{x}) / 2, {x})"


_EBITDA = "coalesce(nullif(ebitda, 0), coalesce(nullif(total_income, 0), nullif(revenue_from_operations, 0)) - total_expenses + depreciation_amortisation + finance_costs - coalesce(exceptional_items, 0))"
_REV = "nullif(revenue_from_operations, 0)"
_MARGINS = {
    "gross_margin_pct": f"round(({_REV} - cost_of_materials) / abs({_REV}) * 100, 2)", "ebitda_margin_pct": f"round({_EBITDA} / {_REV} * 100, 2)", "operating_margin_pct": f"round((pbt + finance_costs) / {_REV} * 100, 2)",
    "net_margin_pct": f"round(pat / {_REV} * 100, 2)", "roe_pct": f"round(pat / nullif({_means('total_equity')}, 0) * 100, 2)", "roa_pct": f"round(pat / nullif({_means('total_assets')}, 0) * 100, 2)",
    "roce_pct": f"round((pbt + finance_costs) / nullif(total_debt + {_means('total_equity')}, 0) * 100, 2)",
}
_METRICS = _MARGINS | {
    "debt_to_equity": f"round(total_debt / nullif({_means('total_equity')}, 0), 4)", "current_ratio": "round(total_current_assets / nullif(total_current_liabilities, 0), 2)", "interest_coverage": "round((pbt + finance_costs) / CASE WHEN finance_costs > 0 THEN finance_costs END, 1)",
    "fcf_cr": "round(cfo - capex, 1)", "ocf_to_pat": "round(cfo / nullif(pat, 0), 2)", "revenue_yoy_pct": "round(revenue_from_operations / abs(nullif(p_revenue_from_operations, 0)) * 100 - 100, 2)",
    "pat_yoy_pct": "round(pat / abs(nullif(p_pat, 0)) * 100 - 100, 2)", "eps_yoy_pct": "round(eps_basic / abs(nullif(p_eps_basic, 0)) * 100 - 100, 2)",
}
_SHARED = ("revenue_from_operations", "total_income", "pbt", "pat", "eps_basic")
_PREV = ("total_equity", "total_assets", "revenue_from_operations", "pat", "eps_basic")
_TABLE = f"""{_ANNUAL}, {_QUARTERS}, five AS (SELECT * FROM ann QUALIFY row_number() OVER (PARTITION BY isin ORDER BY fy DESC) <= 5),
qfive AS (SELECT * FROM quarters WHERE isin NOT IN (SELECT isin FROM ann) QUALIFY row_number() OVER (PARTITION BY isin ORDER BY "end" DESC) <= 5),
y AS (SELECT *, {', '.join(f'lag({x}) OVER w AS p_{x}' for x in _PREV)} FROM five WINDOW w AS (PARTITION BY isin ORDER BY fy)),
z AS (SELECT * EXCLUDE (audit, derived, q), NULL::DOUBLE AS total_equity, {', '.join(f'lag({x}, 4) OVER w AS p_{x}' for x in ('revenue_from_operations', 'pat', 'eps_basic'))} FROM qfive WINDOW w AS (PARTITION BY isin ORDER BY "end")),
all_columns AS (SELECT 'FY' AS period, y.* FROM y UNION ALL BY NAME SELECT 'Q' AS period, z.* FROM z),
tab AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _METRICS.items() if k not in ('debt_to_equity',))}, {_METRICS['debt_to_equity']} AS debt_to_equity FROM all_columns)"""
_SHOWN = ("revenue_from_operations", "pat", "total_assets", "total_equity", "cfo")


@register("u17_u18_annual_table", f"""WITH {_TABLE} SELECT period, isin, fy, "end", {', '.join(f'round({x}, 4) + 0.0 AS {x}' for x in _SHOWN)}, {', '.join(f'{k} + 0.0 AS {k}' for k in _METRICS)} FROM tab""")
def u17(spark, sf):
    return _fixed(T.annual_table(_annual(spark, sf), _quarters(spark, sf)).select("period", "isin", "fy", "end", *_SHOWN, *T.METRICS))


@register("u20_consistency_checks", f"""WITH {_TABLE}, qq AS (SELECT isin, fy, count(revenue_from_operations) AS n, sum(revenue_from_operations) AS s FROM quarters GROUP BY ALL),
x AS (SELECT tab.*, n AS q_n, s AS q_sum, row_number() OVER (PARTITION BY isin ORDER BY "end") AS k, coalesce(nullif(total_income, 0), {_REV}) - total_expenses + depreciation_amortisation + finance_costs - coalesce(exceptional_items, 0) AS bridge FROM tab LEFT JOIN qq USING (isin, fy)),
chk AS (SELECT isin, bool_and(abs(total_assets - total_equity - total_liabilities) / abs(nullif(total_assets, 0)) <= 0.005) AS assets_equal_equity_plus_liabilities, bool_and(abs(ebitda - bridge) / abs(bridge) <= 0.01) AS ebitda_bridge,
  bool_and(CASE WHEN q_n >= 4 THEN abs(q_sum - revenue_from_operations) / abs(revenue_from_operations) <= 0.02 END) AS annual_matches_quarter_sum, bool_and(abs(net_margin_pct - pat / abs({_REV}) * 100) <= 0.02) AS margin_identity,
  arg_min(revenue_from_operations, "end") AS first, arg_max(revenue_from_operations, "end") AS last, count(*) AS n, count(CASE WHEN k > 1 THEN revenue_yoy_pct END) AS m, coalesce(product(CASE WHEN k > 1 THEN 1 + revenue_yoy_pct / 100 END), 1) AS grown FROM x GROUP BY isin)
SELECT isin, assets_equal_equity_plus_liabilities, ebitda_bridge, annual_matches_quarter_sum, CASE WHEN first > 0 AND last > 0 AND m = n - 1 THEN abs(grown - last / first) / abs(last / first) <= 0.01 END AS growth_chain_revenue, margin_identity FROM chk""")
def u20(spark, sf):
    return T.consistency_checks(T.annual_table(_annual(spark, sf), _quarters(spark, sf)), _quarters(spark, sf))


_LIST = "string_agg(CASE WHEN {0} THEN CAST(fy AS VARCHAR) END, ', ' ORDER BY fy)"


@register("u20_table_warnings", f"""WITH {_TABLE}, {_TTM}, wrn AS (SELECT isin, max(period) AS period, count(*) AS n, {_LIST.format('cfo IS NULL')} AS cf, {_LIST.format('total_assets IS NULL OR total_equity IS NULL')} AS bs, {_LIST.format('coalesce(revenue_from_operations, 0) = 0')} AS rev, {_LIST.format('pat < 0')} AS loss, arg_max(net_margin_pct, "end") AS margin FROM tab GROUP BY isin)
SELECT isin, concat_ws(' ', CASE WHEN n < 2 THEN 'Only 1 fiscal year available: multi-year metrics are limited.' END, CASE WHEN period = 'FY' THEN 'Cash-flow items missing for ' || cf || '.' END, CASE WHEN period = 'FY' THEN 'Balance-sheet items missing for ' || bs || '.' END,
  'No revenue recorded for ' || rev || '.', 'Loss years: ' || loss || '.', CASE WHEN abs(margin - round(t.pat / nullif(t.revenue_from_operations, 0) * 100, 2)) > 5 THEN 'The trailing net margin is more than 5 points from that of the last year.' END) AS warnings FROM wrn LEFT JOIN ttm t USING (isin)""")
def u20_warnings(spark, sf):
    return T.table_warnings(T.annual_table(_annual(spark, sf), _quarters(spark, sf)), _ttm(spark, sf)).select("isin", F.array_join("warnings", " ").alias("warnings"))


@register("u21_quarterly_grid", f"""WITH {_QUARTERS}, ys AS (SELECT DISTINCT isin, fy FROM quarters), five AS (SELECT * FROM ys QUALIFY row_number() OVER (PARTITION BY isin ORDER BY fy DESC) <= 5), slots AS (SELECT isin, fy, CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS q FROM five)
SELECT isin, fy, slots.q, "end", {', '.join(f'round({x}, 4) + 0.0 AS {x}' for x in _SHARED)}, audit, coalesce(derived, false) AS derived FROM slots LEFT JOIN quarters USING (isin, fy, q)""")
def u21(spark, sf):
    return _fixed(T.quarterly_grid(_quarters(spark, sf)))


_BALANCE = ("total_equity", "total_debt", "cash_equivalents", "total_assets", "total_current_assets", "total_current_liabilities", "inventory", "trade_receivables", "trade_payables")
_NPM, _ATO, _EM = f"pat / {_REV}", f"{_REV} / nullif({_means('total_assets')}, 0)", f"{_means('total_assets')} / nullif({_means('total_equity')}, 0)"
_TAXB, _INTB = "pat / nullif(pbt, 0)", "pbt / nullif(pbt + finance_costs, 0)"


def _days(a, b):
    return f"round({a} / nullif({b}, 0) * 365, 1)"


_THREE = f"({_NPM}) IS NOT NULL AND ({_ATO}) IS NOT NULL AND ({_EM}) IS NOT NULL"
_INV, _RECV, _PAY = _days("inventory", "cost_of_materials"), _days("trade_receivables", "revenue_from_operations"), _days("trade_payables", "cost_of_materials")
_FAMILIES = _MARGINS | {
    "roic_pct": f"CASE WHEN total_debt + {_means('total_equity')} > 0 THEN round((pbt + finance_costs) * (1 - greatest(0.0, least(1.0, tax_expense / nullif(pbt, 0)))) / (total_debt + {_means('total_equity')}) * 100, 2) END",
    "npm": f"CASE WHEN {_THREE} THEN round({_NPM}, 4) END", "dupont_turnover": f"CASE WHEN {_THREE} THEN round({_ATO}, 3) END", "equity_multiplier": f"CASE WHEN {_THREE} THEN round({_EM}, 2) END", "roe_check": f"CASE WHEN {_THREE} THEN round({_NPM} * ({_ATO}) * ({_EM}), 4) END",
    "tax_burden": f"CASE WHEN {_THREE} AND ({_INTB}) IS NOT NULL THEN round({_TAXB}, 4) END", "interest_burden": f"CASE WHEN {_THREE} AND ({_TAXB}) IS NOT NULL THEN round({_INTB}, 4) END", "roe_5way": f"CASE WHEN {_THREE} THEN round(({_TAXB}) * ({_INTB}) * ({_NPM}) * ({_ATO}) * ({_EM}), 4) END",
    "current_ratio": "round(total_current_assets / nullif(total_current_liabilities, 0), 2)", "quick_ratio": "round((total_current_assets - inventory) / nullif(total_current_liabilities, 0), 2)", "cash_ratio": "round(cash_equivalents / nullif(total_current_liabilities, 0), 2)",
    "wc_to_sales_pct": f"round((total_current_assets - total_current_liabilities) / {_REV} * 100, 2)", "debt_to_equity": "round(total_debt / nullif(total_equity, 0), 2)", "debt_to_ebitda": f"round(total_debt / nullif({_EBITDA}, 0), 2)",
    "net_debt_to_ebitda": f"round(coalesce(total_debt - cash_equivalents, total_debt) / nullif({_EBITDA}, 0), 2)", "interest_coverage": "round((pbt + finance_costs) / CASE WHEN finance_costs > 0 THEN finance_costs END, 1)",
    "asset_turnover": "round(revenue_from_operations / nullif(total_assets, 0), 4)", "inventory_turnover": "round(cost_of_materials / nullif(inventory, 0), 4)", "inventory_days": _INV, "receivable_days": _RECV, "payable_days": _PAY, "cash_conversion_cycle": f"round({_INV} + {_RECV} - {_PAY}, 1)",
    "fcf_cr": "round(cfo - capex, 1)", "fcf_margin_pct": f"round((cfo - capex) / {_REV} * 100, 2)", "ocf_to_pat": "round(cfo / nullif(pat, 0), 2)", "capex_to_sales_pct": f"round(capex / {_REV} * 100, 2)", "fcf_to_ebitda_pct": f"round((cfo - capex) / nullif({_EBITDA}, 0) * 100, 2)",
}


@register("u16_compute_fundamentals", f"""WITH {_ANNUAL}, {_QUARTERS}, {_TTM}, o AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY fy DESC) AS k, lag(revenue_from_operations) OVER (PARTITION BY isin ORDER BY fy) AS p FROM ann),
l AS (SELECT isin, "end" AS as_of, {', '.join(_BALANCE)} FROM o WHERE k = 1), b AS (SELECT isin, {', '.join(f'{x} AS p_{x}' for x in _PREV)} FROM o WHERE k = 2),
m AS (SELECT l.*, NULL::DOUBLE AS ebitda, {', '.join('t.' + x for x in _FLOWS)}, {', '.join('p_' + x for x in _PREV)} FROM l LEFT JOIN ttm t USING (isin) LEFT JOIN b USING (isin)),
gro AS (SELECT isin, count(*) AS annual_count, round(avg(CASE WHEN p > 0 AND revenue_from_operations IS NOT NULL THEN CASE WHEN revenue_from_operations > p THEN 1.0 ELSE 0.0 END END), 2) AS positive_revenue_years,
  round(max(CASE WHEN k = 1 THEN pat END) / abs(nullif(max(CASE WHEN k = 2 THEN pat END), 0)) - 1, 4) AS pat_yoy, max(CASE WHEN k = 1 THEN revenue_from_operations END) AS r1, max(CASE WHEN k = least(3, annual_n - 1) + 1 THEN revenue_from_operations END) AS r0, least(3, max(annual_n) - 1) AS span
  FROM (SELECT *, count(*) OVER (PARTITION BY isin) AS annual_n FROM o) GROUP BY isin), q AS (SELECT isin, count(*) AS quarter_count FROM quarters GROUP BY 1)
SELECT isin, as_of, {', '.join(f'round({v}, 4) + 0.0 AS {k}' for k, v in _FAMILIES.items())}, pat_yoy + 0.0 AS pat_yoy, CASE WHEN span > 0 AND r0 > 0 AND r1 > 0 THEN round(power(r1 / r0, 1.0 / span) - 1, 4) + 0.0 END AS revenue_cagr_3y, positive_revenue_years + 0.0 AS positive_revenue_years, annual_count, coalesce(quarter_count, 0) AS quarter_count
FROM m JOIN gro USING (isin) LEFT JOIN q USING (isin)""")
def u16(spark, sf):
    prices = D.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("isin"), (50.0 + F.col("s_suppkey") % 97).alias("price"))
    found = T.compute_fundamentals(_annual(spark, sf), _quarters(spark, sf), _ttm(spark, sf), prices)
    return _fixed(found.select("isin", "as_of", *_FAMILIES, "pat_yoy", "revenue_cagr_3y", "positive_revenue_years", "annual_count", "quarter_count"))


@register("u22_fundamental_snapshot", f"""WITH {_ANNUAL}, {_QUARTERS}, {_TTM}, have AS (SELECT isin FROM ann UNION SELECT isin FROM quarters), o AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY fy DESC) AS k FROM ann),
l AS (SELECT isin, total_equity, total_debt, cash_equivalents, nullif(shares_outstanding, 0) AS sh FROM o WHERE k = 1), s AS (SELECT isin, list(round(pat / nullif(total_equity, 0), 4) + 0.0 ORDER BY fy) FILTER (WHERE total_equity <> 0) AS roe, list(round(pat / {_REV}, 4) + 0.0 ORDER BY fy) FILTER (WHERE revenue_from_operations <> 0) AS mar FROM o WHERE k <= 5 GROUP BY 1)
SELECT isin, round(t.eps_basic, 4) + 0.0 AS eps, round(nullif(total_equity, 0) * 1e7 / sh, 4) + 0.0 AS bvps, round(nullif(t.revenue_from_operations, 0) * 1e7 / sh, 4) + 0.0 AS sps, round(nullif(t.cfo, 0) * 1e7 / sh, 4) + 0.0 AS cfps, round((total_debt - coalesce(cash_equivalents, 0)) * 1e7 / sh, 4) + 0.0 AS net_debt_total, round(t.dps, 4) + 0.0 AS dps_ttm,
  array_to_string(coalesce(roe, []), ',') AS roe_series, array_to_string(coalesce(mar, []), ',') AS margin_series, round((t.pat - t.cfo) / abs(nullif(total_equity, 0)), 4) + 0.0 AS accruals, round(total_debt / nullif(total_equity, 0), 4) + 0.0 AS leverage
FROM have LEFT JOIN l USING (isin) LEFT JOIN ttm t USING (isin) LEFT JOIN s USING (isin)""")
def u22(spark, sf):
    from pyspark.sql.window import Window

    a = _annual(spark, sf)
    balance = a.withColumn("k", F.row_number().over(Window.partitionBy("isin").orderBy(F.desc("fy")))).where("k = 1")
    found = T.snapshot(a, _quarters(spark, sf), _ttm(spark, sf).withColumnRenamed("eps_basic", "eps"), balance).drop("ebitda_total")
    text = lambda c: F.array_join(F.transform(c, lambda x: (F.round(x, 4) + 0.0).cast("string")), ",")
    return _fixed(found.withColumns({"roe_series": text("roe_series"), "margin_series": text("margin_series")}))
