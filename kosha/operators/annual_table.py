"""Statements to the end: ratio families, yearly columns with their metrics and checks, the grid of quarters, and what factor scores take from them.

Amounts are in crore; records have isin, end (period end) and the items of
fundamentals.ITEMS and MORE, those that a table lacks being unknown.  What is
missing or has no base gives null, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fundamentals as U

MORE = ("tax_expense", "inventory", "trade_payables", "total_current_assets", "total_current_liabilities", "capex", "shares_outstanding")
# Items that a year's record lends to the trailing twelve months, which have flows only; the lines of a yearly table; those of the grid of quarters.
BALANCE = (
    "total_equity", "total_debt", "cash_equivalents", "total_assets", "reserves_surplus", "total_current_assets", "total_current_liabilities", "inventory", "trade_receivables", "trade_payables",
    "borrowings_non_current", "borrowings_current", "ppe_net",
)
METRICS = (
    "gross_margin_pct", "ebitda_margin_pct", "operating_margin_pct", "net_margin_pct", "roe_pct", "roa_pct", "roce_pct", "debt_to_equity", "current_ratio", "interest_coverage", "fcf_cr", "ocf_to_pat", "revenue_yoy_pct",
    "pat_yoy_pct", "eps_yoy_pct",
)
QUARTER_ITEMS = ("revenue_from_operations", "total_income", "pbt", "pat", "eps_basic")
YEARS = 5

c = F.col


def complete(records: DataFrame) -> DataFrame:
    r = U.with_items(records)
    return r.withColumns({m: F.lit(None).cast("double") for m in MORE if m not in r.columns})


def _some(x: Column) -> Column:
    return F.when(x != 0, x)


def _ratio(a: Column, b: Column) -> Column:
    return a / _some(b)


def _pct(a: Column, b: Column) -> Column:
    return F.round(_ratio(a, b) * 100, 2)


def _ebitda(p: str = "") -> Column:
    g = lambda x: c(p + x)
    income = F.coalesce(_some(g("total_income")), _some(g("revenue_from_operations")))
    bridge = income - g("total_expenses") + g("depreciation_amortisation") + g("finance_costs") - F.coalesce(g("exceptional_items"), F.lit(0.0))
    return F.coalesce(_some(g("ebitda")), bridge)


def _ebit() -> Column:
    return c("pbt") + c("finance_costs")


def _mean(item: str) -> Column:
    """A balance, averaged with that of the record before where there is one (columns prev_*)."""
    return F.coalesce((c(item) + c(f"prev_{item}")) / 2, c(item))


def _margins() -> dict[str, Column]:
    revenue, equity, assets = c("revenue_from_operations"), _mean("total_equity"), _mean("total_assets")
    invested = c("total_debt") + equity
    return {
        "gross_margin_pct": F.round((_some(revenue) - c("cost_of_materials")) / F.abs(revenue) * 100, 2),
        "ebitda_margin_pct": _pct(_ebitda(), revenue),
        "operating_margin_pct": _pct(_ebit(), revenue),
        "net_margin_pct": _pct(c("pat"), revenue),
        "roe_pct": _pct(c("pat"), equity),
        "roa_pct": _pct(c("pat"), assets),
        "roce_pct": _pct(_ebit(), invested),
    }


def _yoy(item: str) -> Column:
    before = _some(c(f"prev_{item}"))
    return F.round(c(item) / F.abs(before) * 100 - 100, 2)


def year_metrics() -> dict[str, Column]:
    """The metrics of a yearly column, from a complete record with the one before as prev_*."""
    fcf = c("cfo") - c("capex")
    return {
        **_margins(),
        "debt_to_equity": _ratio(c("total_debt"), _mean("total_equity")),
        "current_ratio": F.round(_ratio(c("total_current_assets"), c("total_current_liabilities")), 2),
        "interest_coverage": F.round(_ebit() / F.when(c("finance_costs") > 0, c("finance_costs")), 1),
        "fcf_cr": F.round(fcf, 1),
        "ocf_to_pat": F.round(_ratio(c("cfo"), c("pat")), 2),
        "revenue_yoy_pct": _yoy("revenue_from_operations"),
        "pat_yoy_pct": _yoy("pat"),
        "eps_yoy_pct": _yoy("eps_basic"),
    }


PREV = ("total_equity", "total_assets", "revenue_from_operations", "pat", "eps_basic")


def _with_prev(rows: DataFrame, back: Column | int = 1, by: str = "isin", order: str = "end") -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    before = {p: (F.lag(p).over(w) if isinstance(back, int) and back == 1 else F.when(c("period") == "FY", F.lag(p, 1).over(w)).otherwise(F.lag(p, 4).over(w))) for p in PREV}
    return rows.withColumns({f"prev_{p}": v for p, v in before.items()})


def annual_table(annuals: DataFrame, quarters: DataFrame) -> DataFrame:
    """isin, period, fy, end, the items and METRICS of the last five years, or of the last five quarters where no year is known.

    annuals and quarters: isin, fy, end and items; of records with one end any
    one counts.  A year is compared with the column before, a quarter with the
    one four columns before, if the table has it.
    """
    have = complete(annuals).dropDuplicates(["isin", "end"])
    rest = complete(quarters).join(have.select("isin").distinct(), "isin", "left_anti").dropDuplicates(["isin", "end"])
    cols = ["isin", "fy", "end", *U.ITEMS, *MORE]
    rows = have.select(F.lit("FY").alias("period"), *cols).unionByName(rest.select(F.lit("Q").alias("period"), *cols))
    last = rows.withColumn("k", F.row_number().over(Window.partitionBy("isin").orderBy(F.desc("end")))).where(c("k") <= YEARS)
    table = _with_prev(last, c("period"))
    return table.withColumns(year_metrics()).drop("k", *[f"prev_{p}" for p in PREV])


def _all(condition: Column) -> Column:
    """Whether the condition holds wherever it can be checked; null if it nowhere can."""
    return F.bool_and(condition)


def _near(a: Column, b: Column, share: float) -> Column:
    return F.when(F.abs(b) <= 1e-9, F.abs(a - b) <= 1e-9).otherwise(F.abs(a - b) / F.abs(b) <= share)


def consistency_checks(table: DataFrame, quarters: DataFrame) -> DataFrame:
    """isin and five checks of the yearly table: true, false, or null where it can't be checked."""
    sums = quarters.groupBy("isin", "fy").agg(F.count("revenue_from_operations").alias("q_n"), F.sum("revenue_from_operations").alias("q_sum"))
    t = table.join(sums, ["isin", "fy"], "left").withColumn("k", F.row_number().over(Window.partitionBy("isin").orderBy("end")))
    revenue, assets = c("revenue_from_operations"), F.when(F.abs("total_assets") > 1e-9, c("total_assets"))
    income = F.coalesce(_some(c("total_income")), _some(revenue))
    bridge = income - c("total_expenses") + c("depreciation_amortisation") + c("finance_costs") - F.coalesce(c("exceptional_items"), F.lit(0.0))
    known = F.when(revenue.isNotNull(), F.struct("end", revenue.alias("v")))
    g = t.groupBy("isin").agg(
        _all(F.abs(assets - c("total_equity") - c("total_liabilities")) / F.abs(assets) <= 0.005).alias("assets_equal_equity_plus_liabilities"),
        _all(_near(c("ebitda"), bridge, 0.01)).alias("ebitda_bridge"),
        _all(F.when(c("q_n") >= 4, _near(c("q_sum"), revenue, 0.02))).alias("annual_matches_quarter_sum"),
        _all(F.abs(c("net_margin_pct") - c("pat") / F.abs(_some(revenue)) * 100) <= 0.02).alias("margin_identity"),
        F.min(known)["v"].alias("first"), F.max(known)["v"].alias("last"), F.count(F.lit(1)).alias("n"), F.count(F.when(c("k") > 1, c("revenue_yoy_pct"))).alias("n_yoy"), F.product(F.when(c("k") > 1, 1 + c("revenue_yoy_pct") / 100)).alias("grown"),
    )
    chain = F.when((c("first") > 0) & (c("last") > 0) & (c("n_yoy") == c("n") - 1), _near(F.coalesce("grown", F.lit(1.0)), c("last") / c("first"), 0.01))
    return g.select("isin", "assets_equal_equity_plus_liabilities", "ebitda_bridge", "annual_matches_quarter_sum", chain.alias("growth_chain_revenue"), "margin_identity")


def table_warnings(table: DataFrame, ttm: DataFrame) -> DataFrame:
    """isin and warnings: what the table lacks and where it breaks, in order of years; a table of quarters is not warned of missing balances and cash flows."""
    years = lambda cond: F.array_sort(F.collect_list(F.when(cond, c("fy"))))  # noqa: E731  five at most
    g = table.groupBy("isin").agg(
        F.max("period").alias("period"), F.count(F.lit(1)).alias("n"), years(c("cfo").isNull()).alias("cf"), years(c("total_assets").isNull() | c("total_equity").isNull()).alias("bs"),
        years(F.coalesce(c("revenue_from_operations") == 0, F.lit(True))).alias("rev"), years(c("pat") < 0).alias("loss"), F.max_by("net_margin_pct", "end").alias("margin"),
    ).join(ttm.select("isin", _pct(c("pat"), c("revenue_from_operations")).alias("now")), "isin", "left")
    fy = c("period") == "FY"
    listed = lambda text, of, when=F.lit(True): F.when(when & (F.size(of) > 0), F.concat(F.lit(text), F.array_join(c(of).cast("array<string>"), ", "), F.lit(".")))
    few = F.when(c("n") < 2, F.concat(F.lit("Only "), c("n").cast("string"), F.lit(" fiscal year available: multi-year metrics are limited.")))
    apart = F.when(F.abs(c("margin") - c("now")) > 5, "The trailing net margin is more than 5 points from that of the last year.")
    warnings = F.array(few, listed("Cash-flow items missing for ", "cf", fy), listed("Balance-sheet items missing for ", "bs", fy), listed("No revenue recorded for ", "rev"), listed("Loss years: ", "loss"), apart)
    return g.select("isin", F.filter(warnings, lambda x: x.isNotNull()).alias("warnings"))


def quarterly_grid(quarters: DataFrame) -> DataFrame:
    """isin, fy, q, end, QUARTER_ITEMS, audit and derived of the four quarters of the last five fiscal years that have any; quarters without a record are null.

    quarters: isin, fy, q (1 to 4), end, items, audit, derived; of several
    records of a quarter the one with the earliest end counts.
    """
    values = [x for x in QUARTER_ITEMS if x in quarters.columns]
    years = quarters.where("fy IS NOT NULL").select("isin", "fy").distinct().withColumn("k", F.row_number().over(Window.partitionBy("isin").orderBy(F.desc("fy")))).where(c("k") <= YEARS)
    slots = years.select("isin", "fy", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("q"))
    first = quarters.groupBy("isin", "fy", "q").agg(F.min_by(F.struct("end", *values, "audit", "derived"), "end").alias("r"))
    found = slots.join(first, ["isin", "fy", "q"], "left")
    return found.select("isin", "fy", "q", "r.end", *[f"r.{v}" for v in values], "r.audit", F.coalesce("r.derived", F.lit(False)).alias("derived"))


def compute_fundamentals(annuals: DataFrame, quarters: DataFrame, ttm: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per isin: per-share values, all ratio families, growth, scores' inputs and counts.

    annuals, quarters: isin, end and items; ttm: isin, end and flows; prices:
    isin, price.  Balances come from the last annual record; averages take the
    one before it.  Without trailing flows, ratios of flows are null.
    """
    a = complete(annuals).dropDuplicates(["isin", "end"]).withColumn("k", F.row_number().over(Window.partitionBy("isin").orderBy(F.desc("end"))))
    n_of = lambda df, name: df.groupBy("isin").agg(F.count(F.lit(1)).alias(name))
    latest, before = a.where("k = 1"), a.where("k = 2")
    flows = [x for x in (*U.ITEMS, *MORE) if x in ttm.columns and x not in BALANCE]
    t = complete(ttm.select("isin", *flows))
    t = t.select("isin", *[x for x in (*U.ITEMS, *MORE) if x not in BALANCE])
    base = latest.select("isin", c("end").alias("as_of"), *BALANCE).join(t, "isin", "full")
    base = base.join(before.select("isin", *[c(p).alias(f"prev_{p}") for p in PREV]), "isin", "left")
    records = complete(annuals).withColumn("annual", F.lit(True)).select("isin", "end", "annual", "pat", "eps_basic", "share_capital", "face_value")
    records = records.unionByName(complete(quarters).withColumn("annual", F.lit(False)).select("isin", "end", "annual", "pat", "eps_basic", "share_capital", "face_value"))
    shares = U.shares_outstanding(complete(ttm), records)
    base = base.join(shares, "isin", "left").join(prices.select("isin", "price"), "isin", "left")
    revenue, pat, fcf, ebitda = c("revenue_from_operations"), c("pat"), c("cfo") - c("capex"), _ebitda()
    tax_rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _ratio(c("tax_expense"), c("pbt"))))
    invested = c("total_debt") + _mean("total_equity")
    npm, turns, multiple = _ratio(pat, revenue), _ratio(revenue, _mean("total_assets")), _ratio(_mean("total_assets"), _mean("total_equity"))
    three = npm.isNotNull() & turns.isNotNull() & multiple.isNotNull()
    burden, interest = _ratio(pat, c("pbt")), _ratio(c("pbt"), _ebit())
    days = lambda x, y: F.round(_ratio(x, y) * 365, 1)
    inv, recv, pay = days(c("inventory"), c("cost_of_materials")), days(c("trade_receivables"), revenue), days(c("trade_payables"), c("cost_of_materials"))
    net_debt = F.coalesce(c("total_debt") - c("cash_equivalents"), c("total_debt"))
    per = lambda x: F.when(c("shares") != 0, F.round(c(x) * U.CRORE / c("shares"), 2))
    value = _some(c("price")) * _some(c("shares")) / U.CRORE
    families = {
        **_margins(),
        "roic_pct": F.when(invested > 0, _pct(_ebit() * (1 - tax_rate), invested)),
        "npm": F.when(three, F.round(npm, 4)), "dupont_turnover": F.when(three, F.round(turns, 3)), "equity_multiplier": F.when(three, F.round(multiple, 2)), "roe_check": F.when(three, F.round(npm * turns * multiple, 4)),
        "tax_burden": F.when(three & interest.isNotNull(), F.round(burden, 4)), "interest_burden": F.when(three & burden.isNotNull(), F.round(interest, 4)), "roe_5way": F.when(three, F.round(burden * interest * npm * turns * multiple, 4)),
        "current_ratio": F.round(_ratio(c("total_current_assets"), c("total_current_liabilities")), 2), "quick_ratio": F.round(_ratio(c("total_current_assets") - c("inventory"), c("total_current_liabilities")), 2),
        "cash_ratio": F.round(_ratio(c("cash_equivalents"), c("total_current_liabilities")), 2), "wc_to_sales_pct": _pct(c("total_current_assets") - c("total_current_liabilities"), revenue),
        "debt_to_equity": F.round(_ratio(c("total_debt"), c("total_equity")), 2), "debt_to_ebitda": F.round(_ratio(c("total_debt"), ebitda), 2), "net_debt_to_ebitda": F.round(_ratio(net_debt, ebitda), 2),
        "interest_coverage": F.round(_ebit() / F.when(c("finance_costs") > 0, c("finance_costs")), 1),
        "asset_turnover": _ratio(revenue, c("total_assets")), "inventory_turnover": _ratio(c("cost_of_materials"), c("inventory")), "inventory_days": inv, "receivable_days": recv, "payable_days": pay, "cash_conversion_cycle": F.round(inv + recv - pay, 1),
        "fcf_cr": F.round(fcf, 1), "fcf_margin_pct": _pct(fcf, revenue), "ocf_to_pat": F.round(_ratio(c("cfo"), pat), 2), "capex_to_sales_pct": _pct(c("capex"), revenue), "fcf_to_ebitda_pct": _pct(fcf, ebitda),
        "shares_outstanding_cr": F.round(_some(c("shares")) / U.CRORE, 3), "eps": F.coalesce(_some(c("eps_basic")), F.round(_some(pat) * U.CRORE / _some(c("shares")), 2), c("eps_basic")), "bvps": per("total_equity"), "sps": per("revenue_from_operations"), "cfps": per("cfo"), "market_cap_cr": F.round(value, 1),
        "ev_cr": F.round(value + c("total_debt") - F.coalesce("cash_equivalents", F.lit(0.0)), 1),
    }
    out = base.select("isin", "as_of", *[v.alias(k) for k, v in families.items()])
    counts = n_of(a, "annual_count").join(n_of(complete(quarters), "quarter_count"), "isin", "full")
    return out.join(growth_summary(a.drop("k")), "isin", "left").join(counts, "isin", "left").na.fill(0, ["annual_count", "quarter_count"])


def growth_summary(annuals: DataFrame) -> DataFrame:
    """isin, growth of the last year against the one before as fractions, compound growth over up to three years, and the share of years in which revenue rose."""
    w = Window.partitionBy("isin").orderBy("end")
    back = Window.partitionBy("isin").orderBy(F.desc("end"))
    a = annuals.withColumn("k", F.row_number().over(back)).withColumn("p", F.lag("revenue_from_operations").over(w))
    at = lambda item, k: F.max(F.when(c("k") == k, c(item)))
    rises = F.when((c("p") > 0) & c("revenue_from_operations").isNotNull(), (c("revenue_from_operations") > c("p")).cast("double"))
    items = ("revenue_from_operations", "pat", "eps_basic")
    g = a.groupBy("isin").agg(F.count(F.lit(1)).alias("n"), F.avg(rises).alias("rises"), *[at(i, k).alias(f"{i}_{k}") for i in items for k in (1, 2, 3, 4)])
    span = F.least(F.lit(3), c("n") - 1)
    change = lambda i: F.round(c(f"{i}_1") / F.abs(_some(c(f"{i}_2"))) - 1, 4)

    def compound(i):
        start = F.when(span == 1, c(f"{i}_2")).when(span == 2, c(f"{i}_3")).when(span == 3, c(f"{i}_4"))
        return F.when((start > 0) & (c(f"{i}_1") > 0), F.round(F.pow(c(f"{i}_1") / start, 1 / span) - 1, 4))

    return g.select("isin", change("revenue_from_operations").alias("revenue_yoy"), change("pat").alias("pat_yoy"), change("eps_basic").alias("eps_yoy"), compound("revenue_from_operations").alias("revenue_cagr_3y"), compound("pat").alias("pat_cagr_3y"), F.round("rises", 2).alias("positive_revenue_years"))


def snapshot(annuals: DataFrame, quarters: DataFrame, ttm: DataFrame, balance: DataFrame) -> DataFrame:
    """isin and what factor scores take from statements: values per share, the last five years' returns and margins, accruals and leverage.

    ttm: isin, eps, dps and flows; balance: isin, total_equity, total_debt,
    cash_equivalents.  Shares are those of the last record with some, years
    before quarters.
    """
    counted = lambda df, rank: complete(df).select("isin", F.struct(F.lit(rank).alias("rank"), "end").alias("o"), _some(c("shares_outstanding")).alias("shares"))
    shares = counted(annuals, 1).unionByName(counted(quarters, 0)).where("shares IS NOT NULL").groupBy("isin").agg(F.max_by("shares", "o").alias("shares"))
    last = complete(annuals).withColumn("k", F.row_number().over(Window.partitionBy("isin").orderBy(F.desc("end")))).where(c("k") <= YEARS)
    dated = lambda x: F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct("end", x.alias("v"))))), lambda s: s["v"])  # noqa: E731  five at most
    series = last.groupBy("isin").agg(dated(_ratio(c("pat"), c("total_equity"))).alias("roe_series"), dated(_ratio(c("pat"), c("revenue_from_operations"))).alias("margin_series"))
    have = annuals.select("isin").union(quarters.select("isin")).distinct()
    t = complete(ttm.withColumnRenamed("eps", "eps_ttm")).select("isin", "eps_ttm", "dps", c("revenue_from_operations").alias("rev"), c("cfo").alias("t_cfo"), c("ebitda").alias("t_ebitda"), c("pat").alias("ni"))
    j = have.join(shares, "isin", "left").join(t, "isin", "left").join(balance.select("isin", "total_equity", "total_debt", "cash_equivalents"), "isin", "left").join(series, "isin", "left")
    each = lambda x: _some(x) * U.CRORE / c("shares")
    debt = c("total_debt") - F.coalesce("cash_equivalents", F.lit(0.0))
    none = F.array().cast("array<double>")
    return j.select(
        "isin", c("eps_ttm").alias("eps"), each(c("total_equity")).alias("bvps"), each(c("rev")).alias("sps"), each(c("t_cfo")).alias("cfps"), each(c("t_ebitda")).alias("ebitda_total"), (debt * U.CRORE / c("shares")).alias("net_debt_total"), c("dps").alias("dps_ttm"),
        F.coalesce("roe_series", none).alias("roe_series"), F.coalesce("margin_series", none).alias("margin_series"), ((c("ni") - c("t_cfo")) / F.abs(_some(c("total_equity")))).alias("accruals"), _ratio(c("total_debt"), c("total_equity")).alias("leverage"),
    )
