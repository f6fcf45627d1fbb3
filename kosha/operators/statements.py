"""Financial statements: quarters from cumulative records, trailing twelve months, ratios, growth and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ITEMS = ("revenue", "expenses", "tax", "pat")


def cumulate(quarters: DataFrame, items=ITEMS) -> DataFrame:
    """Cumulative records (Q1, H1, 9M, FY) of each fiscal year, as filings report them."""
    w = W.partitionBy("isin", "fy").orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    whole = F.count(F.lit(1)).over(w) == F.col("q")
    kind = F.element_at(F.array(*map(F.lit, ("Q1", "H1", "9M", "FY"))), F.col("q"))
    return quarters.select("isin", "fy", "q", "end", kind.alias("kind"), whole.alias("whole"), *[F.sum(c).over(w).alias(c) for c in items]).where("whole").drop("whole")


def derive_quarters(records: DataFrame, items=ITEMS) -> DataFrame:
    """Quarters within a fiscal year: each cumulative record less the one before; null where that is missing."""
    w = W.partitionBy("isin", "fy").orderBy("q")
    follows = (F.col("q") == 1) | (F.lag("q").over(w) == F.col("q") - 1)
    return records.select("isin", "fy", "q", "end", (F.col("q") > 1).alias("derived"), *[F.when(follows, F.col(c) - F.when(F.col("q") > 1, F.lag(c).over(w)).otherwise(0.0)).alias(c) for c in items])


def ttm(quarters: DataFrame, items=ITEMS) -> DataFrame:
    """Sums of the last four quarters, if they follow each other."""
    w = W.partitionBy("isin").orderBy(F.desc("end"))
    last = quarters.withColumn("k", F.row_number().over(w)).where("k <= 4")
    g = last.groupBy("isin").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("end"), F.max(F.col("fy") * 4 + F.col("q")).alias("hi"), F.min(F.col("fy") * 4 + F.col("q")).alias("lo"), *[F.sum(c).alias(c) for c in items])
    return g.where("n = 4 AND hi - lo = 3").select("isin", "end", *items)


def annual(quarters: DataFrame, items=ITEMS) -> DataFrame:
    return quarters.groupBy("isin", "fy").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in items]).where("n = 4").drop("n")


def with_balance(years: DataFrame) -> DataFrame:
    """Stand-in balance items from flows, for ratios over data without a balance sheet."""
    w = W.partitionBy("isin").orderBy("fy").rowsBetween(W.unboundedPreceding, 0)
    return years.withColumn("equity", F.sum("pat").over(w)).withColumn("assets", F.col("equity") + 0.5 * F.col("revenue")).withColumn("debt", 0.2 * F.col("revenue")).withColumn("cfo", F.col("pat") + 0.5 * F.col("tax"))


def ratios(years: DataFrame) -> DataFrame:
    """Margins, returns on average balances, leverage, cash quality; null where a base is missing or not positive."""
    w = W.partitionBy("isin").orderBy("fy")
    pos = lambda c: F.when(c > 0, c)
    mean = lambda c: pos((F.col(c) + F.coalesce(F.lag(c).over(w), F.col(c))) / 2)
    return years.select(
        "isin", "fy",
        (100 * F.col("pat") / pos(F.col("revenue"))).alias("net_margin"), (100 * (F.col("revenue") - F.col("expenses")) / pos(F.col("revenue"))).alias("operating_margin"), (100 * F.col("pat") / mean("equity")).alias("roe"),
        (100 * F.col("pat") / mean("assets")).alias("roa"), (F.col("debt") / pos(F.col("equity"))).alias("debt_to_equity"), (F.col("cfo") / pos(F.col("pat"))).alias("cfo_to_pat"), (F.col("revenue") / mean("assets")).alias("asset_turnover"), (F.col("assets") / pos(F.col("equity"))).alias("multiplier"),
    )


def growth(years: DataFrame, item: str) -> DataFrame:
    """Yearly growth against the size of the year before, and three-year compound growth between positive values."""
    w = W.partitionBy("isin").orderBy("fy")
    p, p3 = F.when(F.lag("fy").over(w) == F.col("fy") - 1, F.lag(item).over(w)), F.when(F.lag("fy", 3).over(w) == F.col("fy") - 3, F.lag(item, 3).over(w))
    return years.select("isin", "fy", F.when(p != 0, 100 * (F.col(item) - p) / F.abs(p)).alias("yoy"), F.when((p3 > 0) & (F.col(item) > 0), 100 * (F.pow(F.col(item) / p3, 1 / 3) - 1)).alias("cagr3"))


def multi_year(years: DataFrame, item: str) -> DataFrame:
    """Mean, deviation, variation and the slope of a line through the years."""
    g = years.groupBy("isin").agg(F.count(F.lit(1)).alias("n"), F.avg(item).alias("mean"), F.stddev_samp(item).alias("sd"), F.regr_slope(item, F.col("fy").cast("double")).alias("slope"))
    return g.select("isin", "n", "mean", "sd", F.try_divide("sd", F.abs("mean")).alias("cv"), F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").otherwise("flat").alias("trend"))


def piotroski(years: DataFrame) -> DataFrame:
    """Tests of profitability, leverage and efficiency: their sum and how many could be judged."""
    w = W.partitionBy("isin").orderBy("fy")
    roa, lev, turn, margin = F.col("pat") / F.col("assets"), F.col("debt") / F.col("assets"), F.col("revenue") / F.col("assets"), (F.col("revenue") - F.col("expenses")) / F.col("revenue")
    y = years.where("assets > 0 AND revenue > 0").withColumn("roa", roa).withColumn("lev", lev).withColumn("turn", turn).withColumn("margin", margin)
    tests = [F.col("pat") > 0, F.col("cfo") > 0, F.col("roa") > F.lag("roa").over(w), F.col("cfo") > F.col("pat"), F.col("lev") < F.lag("lev").over(w), F.col("margin") > F.lag("margin").over(w), F.col("turn") > F.lag("turn").over(w)]
    return y.select("isin", "fy", sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0)).alias("score"), sum((t.isNotNull().cast("int") for t in tests), F.lit(0)).alias("evaluable"))


def altman(years: DataFrame) -> DataFrame:
    """Z score with zones; null unless every term is there."""
    a = F.when(F.col("assets") > 0, F.col("assets"))
    z = 1.2 * (F.col("equity") - F.col("debt")) / a + 1.4 * F.col("equity") / a + 3.3 * (F.col("revenue") - F.col("expenses")) / a + 0.6 * F.col("equity") / F.when(F.col("debt") > 0, F.col("debt")) + F.col("revenue") / a
    return years.select("isin", "fy", z.alias("z"), F.when(z > 2.99, "safe").when(z >= 1.81, "grey").when(z < 1.81, "distress").alias("zone"))
