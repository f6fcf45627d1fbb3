"""Fundamental records (amounts in crore): derived items, identity checks, shares, per-share values, valuation and the manipulation score.

A record is a row; items that a table lacks are not known.  What is missing gives
null, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CRORE = 1e7  # fixed value
ITEMS = (
    "revenue_from_operations", "total_income", "other_income", "interest_earned", "total_expenses", "other_expenses", "cost_of_materials", "depreciation_amortisation", "finance_costs", "exceptional_items", "pbt", "pat", "cfo", "eps_basic", "dps",
    "total_assets", "total_equity", "total_liabilities", "share_capital", "reserves_surplus", "borrowings_non_current", "borrowings_current", "cash_equivalents", "trade_receivables", "ppe_net", "ebitda", "total_debt", "net_worth", "face_value",
)


def with_items(records: DataFrame) -> DataFrame:
    """records with every item as a column, null where the table has none."""
    return records.withColumns({c: F.lit(None).cast("double") for c in ITEMS if c not in records.columns})


def derive_items(records: DataFrame) -> DataFrame:
    """Fill EBITDA, debt, a bank's revenue, equity, net worth and liabilities from other items where they are not given."""
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    r = with_items(records)
    income = F.coalesce(F.nullif("total_income", F.lit(0.0)), "revenue_from_operations")
    r = r.withColumn("ebitda", F.coalesce("ebitda", income - c("total_expenses") + c("depreciation_amortisation") + c("finance_costs") - zero("exceptional_items")))
    r = r.withColumn("total_debt", F.coalesce("total_debt", F.when(F.coalesce("borrowings_non_current", "borrowings_current").isNotNull(), zero("borrowings_non_current") + zero("borrowings_current"))))
    r = r.withColumn("revenue_from_operations", F.coalesce("revenue_from_operations", c("interest_earned") + zero("other_income")))
    r = r.withColumn("total_equity", F.coalesce("total_equity", c("share_capital") + c("reserves_surplus")))
    return r.withColumn("net_worth", F.coalesce("net_worth", "total_equity")).withColumn("total_liabilities", F.coalesce("total_liabilities", c("total_assets") - c("total_equity")))


def issues(records: DataFrame) -> DataFrame:
    """records with issues: the names of the identity checks that a record fails; empty where it is clean or cannot be checked."""
    c = F.col
    income = F.coalesce(F.nullif("total_income", F.lit(0.0)), "revenue_from_operations")
    checks = {
        "identity_assets_ne": (F.abs("total_assets") > 1e-9) & (F.abs(c("total_assets") - c("total_equity") - c("total_liabilities")) / F.nullif(F.abs("total_assets"), F.lit(0.0)) > 0.005),
        "revenue_negative": c("revenue_from_operations") < 0,
        "pat_exceeds_pbt": (c("pbt") != 0) & (F.abs("pat") > F.abs("pbt") * 3 + 1),
        "expenses_far_above_income": (income > 0) & (c("total_expenses") > income * 3 + 100),
    }
    return with_items(records).withColumn("issues", F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in checks.items()]), lambda x: x.isNotNull()))


def shares_outstanding(ttm: DataFrame, records: DataFrame) -> DataFrame:
    """isin, shares: profit over basic earnings a share, trailing, else of the last year; else capital over face value (0.5 and over) of the last record with both.

    ttm: isin, pat, eps_basic.  records: isin, end, annual, pat, eps_basic, share_capital, face_value.
    """
    c = F.col
    bridge = lambda pat, eps: F.when((pat != 0) & (eps > 0), pat * CRORE / eps)
    paid = F.when((c("share_capital") != 0) & (c("face_value") >= 0.5), c("share_capital") * CRORE / c("face_value"))
    g = records.groupBy("isin").agg(F.max_by(F.struct("pat", "eps_basic"), F.when(c("annual"), c("end"))).alias("y"), F.max_by(paid, F.when(paid.isNotNull(), c("end"))).alias("paid"))
    j = g.join(ttm.select("isin", c("pat").alias("t_pat"), c("eps_basic").alias("t_eps")), "isin", "full")
    return j.select("isin", F.coalesce(bridge(c("t_pat"), c("t_eps")), bridge(c("y.pat"), c("y.eps_basic")), "paid").alias("shares"))


def per_share(facts: DataFrame) -> DataFrame:
    """Per-share values and market value from price, shares and trailing or latest items of each isin.

    facts: isin, price, shares, eps_basic, dps, total_equity,
    revenue_from_operations, cfo, total_debt, cash_equivalents, ebitda.
    """
    c = F.col
    each = lambda x: F.when(c("shares") != 0, F.round(c(x) * CRORE / c("shares"), 2))
    value = F.when((c("price") != 0) & (c("shares") != 0), c("price") * c("shares") / CRORE)
    debt = F.when(value.isNotNull(), c("total_debt") - F.coalesce("cash_equivalents", F.lit(0.0)))
    return facts.select("isin", "price", c("eps_basic").alias("eps"), "dps", each("total_equity").alias("bvps"), each("revenue_from_operations").alias("sps"), each("cfo").alias("cfps"), F.round(value, 1).alias("market_cap_cr"), F.round(debt, 1).alias("net_debt_cr"), F.round(value + debt, 1).alias("ev_cr"), "ebitda")


def valuation(base: DataFrame, growth: DataFrame) -> DataFrame:
    """Multiples and yields from per_share, and the growth-adjusted multiple with growth (isin, rev_cagr as a fraction); only positive bases count."""
    c = F.col
    price = F.when(c("price") != 0, c("price"))
    over = lambda x: price / F.when(c(x) > 0, c(x))
    g = F.when(c("rev_cagr") > 0, c("rev_cagr"))
    return base.join(growth, "isin", "left").select(
        "isin", over("eps").alias("pe"), over("bvps").alias("pb"), over("sps").alias("ps"), over("cfps").alias("pcf"), F.round(100 * F.nullif("dps", F.lit(0.0)) / price, 2).alias("dividend_yield_pct"), F.round(100 * F.when(c("eps") > 0, c("eps")) / price, 2).alias("earnings_yield_pct"),
        (c("ev_cr") / F.when(c("ebitda") > 0, c("ebitda"))).alias("ev_ebitda"), F.round(over("eps") / (g * 100), 2).alias("peg"), F.round(F.sqrt(22.5 * F.when(c("bvps") > 0, c("bvps")) * F.when(c("eps") > 0, c("eps"))), 2).alias("graham_number"),
    )


def beneish(years: DataFrame) -> DataFrame:
    """isin, fy, m_score, flagged (over -1.78) of every year that has the one before and the four indices that the score needs.

    Indices compare a year with the one before; other missing ones count as 1.
    """
    w = W.partitionBy("isin").orderBy("fy")
    r = with_items(years)
    c = F.col
    before = {x: F.when(F.lag("fy").over(w) == c("fy") - 1, F.lag(x).over(w)) for x in ("trade_receivables", "revenue_from_operations", "cost_of_materials", "depreciation_amortisation", "ppe_net", "other_expenses", "total_liabilities", "total_assets")}
    r = r.withColumns({f"p_{x}": v for x, v in before.items()})
    ratio = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    some = lambda x: F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(1.0))
    present = lambda x: F.nullif(x, F.lit(0.0))
    sales, sales1 = "revenue_from_operations", "p_revenue_from_operations"
    margin = lambda p: ratio(present(c(p + sales)) - c(p + "cost_of_materials"), c(p + sales))
    indices = {
        "dsri": ratio(ratio(c("trade_receivables"), c(sales)), ratio(present(c("p_trade_receivables")), c(sales1))),
        "gmi": ratio(margin("p_"), margin("")),
        "sgi": ratio(c(sales), c(sales1)),
        "depi": ratio(ratio(present(c("p_depreciation_amortisation")), some(c("p_ppe_net"))), ratio(c("depreciation_amortisation"), some(c("ppe_net")))),
        "sgai": ratio(ratio(c("other_expenses"), some(c(sales))), ratio(present(c("p_other_expenses")), some(c(sales1)))),
        "lvgi": ratio(ratio(c("total_liabilities"), some(c("total_assets"))), ratio(present(c("p_total_liabilities")), present(c("p_total_assets")))),
        "tata": ratio(c("pbt") - c("cfo"), F.abs("total_assets")),
    }
    r = r.select("isin", "fy", *[v.alias(k) for k, v in indices.items()]).where("dsri IS NOT NULL AND gmi IS NOT NULL AND sgi IS NOT NULL AND tata IS NOT NULL")
    # The weights of the score; the asset quality index counts as 1.
    m: Column = -4.84 + 0.920 * c("dsri") + 0.528 * c("gmi") + 0.404 + 0.892 * some(c("sgi")) + 0.115 * some(c("depi")) - 0.172 * some(c("sgai")) + 4.679 * c("tata") - 0.327 * some(c("lvgi"))
    return r.select("isin", "fy", F.round(m, 3).alias("m_score"), (m > -1.78).alias("flagged"))
