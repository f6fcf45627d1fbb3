"""Cross-sectional factors: momentum, low volatility, value and quality of all securities at once, ranked against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import held

INVERTED = ("vol_252", "downside_dev", "beta", "max_drawdown")  # small is strong; max_drawdown as the reference ranks it


def _back(closes: DataFrame) -> DataFrame:
    return closes.where("close is not null").withColumn("k", F.row_number().over(W.partitionBy("isin").orderBy(F.desc("d"))))


def momentum(closes: DataFrame) -> DataFrame:
    """Returns over 12, 6 and 3 months less the last, in bars of 21; needs 201 closes."""
    at = lambda n: F.max(F.when(F.col("k") == n + 1, F.col("close")))
    b = _back(closes).withColumn("ret", F.col("close") / F.lag("close").over(W.partitionBy("isin").orderBy("d")) - 1)
    g = b.groupBy("isin").agg(F.count(F.lit(1)).alias("n"), at(21).alias("c1"), at(63).alias("c3"), at(126).alias("c6"), at(252).alias("c12"), F.stddev_samp(F.when(F.col("k") <= 252, F.col("ret"))).alias("sd"))
    ok = F.col("n") >= 201
    r12 = F.col("c1") / F.col("c12") - 1
    return g.select(
        "isin", F.when(ok, r12).alias("ret_12_1"), F.when(ok, F.col("c1") / F.col("c6") - 1).alias("ret_6_1"), F.when(ok, F.col("c1") / F.col("c3") - 1).alias("ret_3_1"), F.when(ok, F.try_divide(r12, F.nullif(F.col("sd") * 252**0.5, F.lit(0.0)))).alias("ret_12_1_risk_adj")
    )


def low_volatility(closes: DataFrame, bench: DataFrame) -> DataFrame:
    """Volatility, downside deviation (30 falls), beta (60 common days) and drawdown over 252 bars; needs 180 closes."""
    w = W.partitionBy("isin").orderBy("d")
    b = _back(closes).where("k <= 253").withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).withColumn("dd", F.col("close") / F.max("close").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    m = bench.select("d", (F.col("nav") / F.lag("nav").over(W.orderBy("d")) - 1).alias("m"))  # one row for each trading day
    b = b.join(m, "d", "left")
    falls = F.when(F.col("ret") < 0, F.col("ret"))
    pair = F.col("ret").isNotNull() & F.col("m").isNotNull()
    g = b.groupBy("isin").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("ret").alias("sd"), F.stddev_samp(falls).alias("ds"), F.count(falls).alias("nf"), F.count(F.when(pair, 1)).alias("np"), F.covar_samp(F.when(pair, F.col("ret")), F.when(pair, F.col("m"))).alias("cov"), F.var_samp(F.when(pair, F.col("m"))).alias("var"), F.min("dd").alias("md")
    )
    ok = F.col("n") >= 180
    return g.select(
        "isin", F.when(ok, F.col("sd") * 252**0.5).alias("vol_252"), F.when(ok & (F.col("nf") >= 30), F.col("ds") * 252**0.5).alias("downside_dev"), F.when(ok & (F.col("np") >= 60), F.try_divide(F.col("cov"), F.nullif("var", F.lit(0.0)))).alias("beta"), F.when(ok, F.col("md")).alias("max_drawdown")
    )


def value_metrics(prices: DataFrame, facts: DataFrame) -> DataFrame:
    """Yields on the price, and EBITDA over enterprise value.

    prices: isin, price.  facts, per share: isin, eps, bvps, sps, cfps, dps, ebitda,
    net_debt.  What is missing or out of range (only earnings may be negative) gives
    null; without a positive price all is null.
    """
    c = F.col
    j = prices.join(facts, "isin")
    price = F.when(c("price") > 0, c("price"))
    over = lambda x: F.when(c(x) > 0, c(x)) / price
    value = price + F.coalesce("net_debt", F.lit(0.0))
    return j.select(
        "isin", (F.when(c("eps") != 0, c("eps")) / price).alias("earnings_yield"), over("bvps").alias("book_yield"), over("sps").alias("sales_yield"), over("cfps").alias("cashflow_yield"),
        (F.when(c("ebitda") > 0, c("ebitda")) / F.when(value > 0, value)).alias("ev_ebitda_inv"), over("dps").alias("dividend_yield"),
    )


def quality_metrics(years: DataFrame, scores: DataFrame) -> DataFrame:
    """Return on equity and its steadiness, accruals, leverage, margin trend and score, each so that more is better.

    years: isin, fy, roe, margin, pat, cfo, assets, leverage.  scores: isin,
    piotroski (0 to 9).  Steadiness and trend need three years with a value.
    """
    c = F.col
    at = F.count("margin").over(W.partitionBy("isin").orderBy("fy").rowsBetween(W.unboundedPreceding, 0)).cast("double")
    last = lambda x: F.max_by(x, "fy")
    g = years.withColumn("x", F.when(c("margin").isNotNull(), at)).groupBy("isin").agg(
        F.max_by("roe", F.when(c("roe").isNotNull(), c("fy"))).alias("roe_level"), F.count("roe").alias("n"), F.avg("roe").alias("m"), F.stddev_samp("roe").alias("sd"),
        last((c("pat") - c("cfo")) / F.nullif(c("assets"), F.lit(0.0))).alias("accruals"), last("leverage").alias("lev"), F.count("margin").alias("k"), F.regr_slope("margin", "x").alias("slope"),
    )
    steady = F.when((c("n") >= 3) & (c("m") != 0), -c("sd") / F.abs("m"))
    return g.join(scores, "isin", "left").select(
        "isin", "roe_level", steady.alias("roe_stability"), (-c("accruals")).alias("accruals_inv"), F.when(c("lev") >= 0, -c("lev")).alias("leverage_inv"), F.when(c("k") >= 3, c("slope")).alias("margin_slope"), (c("piotroski") / 9).alias("piotroski_scaled")
    )


def long_form(wide: DataFrame) -> DataFrame:
    cols = [c for c in wide.columns if c != "isin"]
    return wide.unpivot("isin", cols, "component", "value").where("value is not null AND NOT isnan(value)")


SLICES = 64  # tasks over which the ranks of one component are spread


def rank_components(values: DataFrame, by: tuple[str, ...] = ("component",)) -> DataFrame:
    """Percentile rank of each component's z-score, the sign turned for the inverted set; needs 5 values.

    Means and deviations are aggregated, and scores are dealt into SLICES by
    approximate quantiles: a rank is the number of scores in lower slices and
    the rank within its own, so no task sees a whole universe.  Equal scores
    share a slice.
    """
    values = held(values)
    points = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    facts = values.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile_approx("value", points, 1000).alias("cuts")).where("n >= 5")
    scored = lambda x: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (x - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)))
    sign = F.when(F.col("component").isin(*INVERTED), -1.0).otherwise(1.0)
    z = values.join(facts, list(by)).withColumn("z", scored(F.col("value"))).withColumn("s", sign * F.col("z"))
    z = z.withColumn("slice", F.size(F.filter("cuts", lambda c: sign * scored(c) < F.col("s")))).select("isin", *by, "n", "z", "s", "slice")
    sizes = z.groupBy(*by, "slice").agg(F.count(F.lit(1)).alias("k"))  # at most SLICES rows a component
    below = sizes.withColumn("below", F.coalesce(F.sum("k").over(W.partitionBy(*by).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("k")
    within = F.rank().over(W.partitionBy(*by, "slice").orderBy("s"))
    return z.join(below, [*by, "slice"]).select("isin", *by, "z", (100 * (F.col("below") + within - 1) / (F.col("n") - 1)).alias("rank"))


def factor_scores(closes: DataFrame, bench: DataFrame, more: dict[str, DataFrame] | None = None) -> DataFrame:
    """isin, one composite for each factor (the mean of its ranks, three at least) and multi, their mean where two at least are there.

    more: further factors by name, such as value and quality, as wide tables of
    components by isin.  The components of all factors are ranked together.
    """
    groups = {"momentum": momentum(closes), "lowvol": low_volatility(closes, bench), **(more or {})}
    values = None
    for name, wide in groups.items():
        part = long_form(wide).withColumn("factor", F.lit(name))
        values = part if values is None else values.unionByName(part)
    ranks = rank_components(values, ("factor", "component"))
    own = lambda name: F.when(F.col("factor") == name, F.col("rank"))
    out = ranks.groupBy("isin").agg(*[F.when(F.count(own(name)) >= 3, F.avg(own(name))).alias(name) for name in groups])
    there = F.filter(F.array(*[F.col(g) for g in groups]), lambda x: x.isNotNull())
    scored = out.where(F.size(there) > 0)
    return scored.withColumn("multi", F.when(F.size(there) >= 2, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)))


def sector_relative(scores: DataFrame, sectors: DataFrame, factors: tuple[str, ...] = ("momentum", "lowvol")) -> DataFrame:
    """isin, sector and each factor, to six decimals, ranked within the sector; sectors with fewer than 5 scored securities have none."""
    rows = scores.select("isin", *factors).unpivot("isin", list(factors), "component", "value").where("value is not null").withColumn("value", F.round("value", 6)).join(sectors.select("isin", "sector"), "isin")
    ranked = rank_components(rows.withColumn("component", F.concat(F.lit("sector_"), "component")), ("sector", "component"))
    return ranked.groupBy("isin", "sector").agg(*[F.max(F.when(F.col("component") == f"sector_{f}", F.col("rank"))).alias(f) for f in factors])


def screen(scores: DataFrame, factor: str, top_n: int, ascending: bool = False) -> DataFrame:
    """The best securities by a factor; the number is held between 1 and 200."""
    order = F.col(factor).asc_nulls_last() if ascending else F.col(factor).desc_nulls_last()
    return scores.where(F.col(factor).isNotNull()).orderBy(order, "isin").limit(max(1, min(top_n, 200)))
