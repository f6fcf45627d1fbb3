"""Holdings: snapshots, source choice, weights, overlap, look-through and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kosha.functions import classes as K


def merge_snapshot(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each security of a snapshot: sums of amounts, first known coupon and label."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return rows.groupBy(*keys).agg(F.sum("market_value").alias("market_value"), F.count(F.lit(1)).alias("parts"), first("coupon").alias("coupon"), first("label").alias("label"))


def pick_source(rows: DataFrame, scheme: str, source: str, priority: dict[str, int]) -> DataFrame:
    """The rows of each scheme's best source: most securities with a weight, then priority; one pass over source sums."""
    rank = F.create_map(*[F.lit(x) for p in priority.items() for x in p])
    best = rows.groupBy(scheme, source).agg(F.count("weight").alias("n")).withColumn("p", rank[F.col(source)])
    best = best.groupBy(scheme).agg(F.max_by(source, F.struct(F.col("n"), (-F.col("p")).alias("p"))).alias(source))
    return rows.join(best, [scheme, source])


def shadowed(rows: DataFrame, scheme: str, source: str, key: str, share: float = 0.85) -> DataFrame:
    """Pairs of sources of one scheme of which the first holds at least `share` of the keys of the second."""
    sizes = rows.groupBy(scheme, source).agg(F.countDistinct(key).alias("n"))
    keys = rows.select(scheme, source, key).distinct()
    common = keys.join(keys.withColumnRenamed(source, "other"), [scheme, key]).where(F.col(source) != F.col("other")).groupBy(scheme, source, "other").agg(F.count(F.lit(1)).alias("common"))
    sizes = sizes.withColumnRenamed(source, "other")
    return common.join(sizes, [scheme, "other"]).where(F.col("common") >= share * F.col("n")).select(scheme, source, "other", "common", "n")


def repair_weights(rows: DataFrame, scheme: str) -> DataFrame:
    """Weights where they are plausible (none over 100, sum up to 120), else market value shares, else equal shares."""
    w = W.partitionBy(scheme)
    total, top, known = F.sum("pct").over(w), F.max("pct").over(w), F.count("pct").over(w)
    value = F.sum("market_value").over(w)
    good = (known > 0) & (top <= 100) & (total <= 120)
    return rows.withColumn("rule", F.when(good, "stated").when(value > 0, "market_value").otherwise("equal")).withColumn(
        "weight", F.when(good, F.col("pct")).when(value > 0, 100 * F.col("market_value") / value).otherwise(100 / F.count(F.lit(1)).over(w))
    )


def scheme_stats(rows: DataFrame, scheme: str) -> DataFrame:
    return rows.groupBy(scheme).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("weight") > 0).alias("n_long"), F.max("weight").alias("top_weight"), F.max_by("isin", F.struct("weight", "isin")).alias("top_isin"), F.sum("weight").alias("total"))


def overlap(rows: DataFrame, by: str, scheme: str, key: str) -> DataFrame:
    """Sum of the smaller weights on common keys for each pair of schemes of a set (by); the diagonal is a scheme's total.

    The join is on the set and the key; a set has at most 12 schemes, so a key meets as many rows.
    """
    a = rows.groupBy(by, F.col(scheme).alias("a"), key).agg(F.sum("weight").alias("wa"))
    b = rows.groupBy(by, F.col(scheme).alias("b"), key).agg(F.sum("weight").alias("wb"))
    return a.join(b, [by, key]).where("a <= b").groupBy(by, "a", "b").agg(F.sum(F.least("wa", "wb")).alias("overlap"), F.count(F.lit(1)).alias("common"))


def concentration(rows: DataFrame, scheme: str) -> DataFrame:
    """Shares of the largest 1, 5 and 10 holdings and the Herfindahl index."""
    k = F.row_number().over(W.partitionBy(scheme).orderBy(F.desc("weight"), "isin"))
    top = lambda n: F.sum(F.when(F.col("k") <= n, F.col("weight")))
    return rows.withColumn("k", k).groupBy(scheme).agg(top(1).alias("top1"), top(5).alias("top5"), top(10).alias("top10"), F.sum(F.pow("weight", F.lit(2))).alias("hhi"))


def sector_split(rows: DataFrame, scheme: str, group: str, most: int = 8) -> DataFrame:
    """The largest groups of each scheme, the rest as Others."""
    g = rows.groupBy(scheme, group).agg(F.sum("weight").alias("weight"))
    k = F.row_number().over(W.partitionBy(scheme).orderBy(F.desc("weight"), group))
    return g.withColumn(group, F.when(k <= most, F.col(group)).otherwise("Others")).groupBy(scheme, group).agg(F.sum("weight").alias("weight"))


def look_through(items: DataFrame, units: DataFrame, depth: int = 10) -> DataFrame:
    """Leaves of portfolios whose lines may be funds: (portfolio, isin, weight).

    items: portfolio, isin, weight.  units: fund, isin, weight.  A line that is a
    fund not visited yet is replaced by its holdings, scaled to its weight; one
    already visited stays as it is, so weights always add up.  Each level is one
    join; levels end at `depth`.
    """
    shares = units.select("fund", F.col("isin").alias("child"), (F.col("weight") / F.sum("weight").over(W.partitionBy("fund"))).alias("share"))
    rows = items.select("portfolio", "isin", "weight", F.array().cast("array<string>").alias("path"))
    for _ in range(depth):
        rows = rows.join(shares, (F.col("isin") == F.col("fund")) & ~F.array_contains("path", F.col("fund")), "left").select(
            "portfolio", F.coalesce("child", "isin").alias("isin"), (F.col("weight") * F.coalesce("share", F.lit(1.0))).alias("weight"), F.when(F.col("fund").isNotNull(), F.concat("path", F.array("fund"))).otherwise(F.col("path")).alias("path")
        )
    return rows.groupBy("portfolio", "isin").agg(F.sum("weight").alias("weight"))


# Patterns that move a holding to another asset class in an analysis.
GOLD = r"(?i)\bgold\b"
RATED = r"(?i)AAA|AA\+|AA|A1\+|BBB|A\+|SOV|SOVEREIGN"
DEBT_TEXT = r"(?i)government security|state government|g-sec|gsec|sovereign|treasury|t-bill|tbill|\bsdl\b|\bgoi\b|net current assets|net receivables"
CASH_FUND = r"(?i)money market|liquid|savings|overnight|low duration|ultra short|tbill|t-bill|treasury"


def reclassified(holdings: DataFrame) -> DataFrame:
    """holdings with asset_class as an analysis counts it: gold by name; rated or sovereign paper among others is debt; fund units and rated untagged lines are no equity."""
    company, sector, asset = (F.coalesce(c, F.lit("")) for c in ("company", "sector", "asset_class"))
    like = lambda c, p: F.rlike(c, F.lit(p))
    unit = F.startswith(F.upper(F.coalesce("isin", F.lit(""))), F.lit("INF"))
    stocks = F.when(unit & like(company, CASH_FUND), "cash_equivalents").when(unit, "debt").when((F.coalesce("cap", F.lit("na")) == "na") & like(sector, RATED), "debt").otherwise("stocks")
    loose = asset.isin("", "other")
    found = (
        F.when(like(company, GOLD) | like(sector, GOLD), "gold")
        .when(loose & (like(sector, RATED) | like(F.concat_ws(" ", company, sector), DEBT_TEXT)), "debt")
        .when(loose, "other")
        .when(asset == "stocks", stocks)
        .otherwise(asset)
    )
    return holdings.withColumn("asset_class", found)


def portfolio_splits(holdings: DataFrame, by: str) -> DataFrame:
    """by, block, label, value: shares of each portfolio by asset class, equity sector, market cap, credit and instrument.

    holdings: by, isin, company, sector, section, cap, asset_class, rating, weight
    (effective, in percent).  Untagged equity is spread over the tagged caps in
    proportion, so these add up to the equity share.  One pass labels every line
    for every block, one aggregation sums them.
    """
    h = reclassified(holdings)
    c = F.col
    stocks, debt = c("asset_class") == "stocks", c("asset_class") == "debt"
    bucket = K.cap_bucket(c("company"), c("sector"), c("isin"), c("asset_class"), c("cap"))
    cap = F.when(stocks & bucket.isin("large", "mid", "small", "microcap", "ipo"), bucket)
    sector = F.coalesce(F.nullif(F.trim(c("sector")), F.lit("")), F.lit("na"))
    labels = {
        "asset": c("asset_class"),
        "sector": F.when(stocks, sector),
        "cap": cap,
        "credit": F.when(debt, K.credit_bucket(c("rating"), c("sector"), c("section"), c("company"))),
        "instrument": F.when(debt, K.instrument_type(c("company"), c("sector"), c("section"))),
    }
    rows = h.select(by, "weight", F.inline(F.array(*[F.struct(F.lit(k).alias("block"), v.alias("label")) for k, v in labels.items()]))).where("label IS NOT NULL")
    sums = rows.groupBy(by, "block", "label").agg(F.sum("weight").alias("value"))
    w = W.partitionBy(by)
    equity = F.sum(F.when((c("block") == "asset") & (c("label") == "stocks"), c("value"))).over(w)
    tagged = F.sum(F.when(c("block") == "cap", c("value"))).over(w)
    scale = F.when((c("block") == "cap") & (tagged > 0) & (equity > tagged * 1.0001), equity / tagged).otherwise(1.0)
    return sums.withColumn("value", c("value") * scale)


def portfolio_summary(holdings: DataFrame, by: str, as_of: str) -> DataFrame:
    """One row for each portfolio: holdings, the largest 1, 5 and 10, debt share, debt yield and its cover, average maturity in years at as_of.

    Beside the columns of portfolio_splits: yield (a number), maturity_date.
    Yields of a portfolio whose largest is below 1 are fractions, all of them.
    """
    h = reclassified(holdings)
    c = F.col
    debt = c("asset_class") == "debt"
    k = F.row_number().over(W.partitionBy(by).orderBy(F.desc("weight"), "isin"))
    top_yield = F.max(F.when(debt & (c("yield") > 0), c("yield"))).over(W.partitionBy(by))
    percent = F.when(top_yield < 1, c("yield") * 100).otherwise(c("yield"))
    years = F.datediff("maturity_date", F.lit(as_of).cast("date")) / 365.25
    h = h.withColumns({"k": k, "y": F.when(debt, percent), "m": F.when(debt & years.between(-1, 60), years)})
    top = lambda n: F.sum(F.when(c("k") <= n, c("weight")))
    mean = lambda x: F.try_divide(F.sum(c("weight") * c(x)), F.nullif(F.sum(F.when(c(x).isNotNull(), c("weight"))), F.lit(0.0)))
    n_debt = F.count_if(debt)
    return h.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_holdings"), top(1).alias("top1_pct"), top(5).alias("top5_pct"), top(10).alias("top10_pct"), F.coalesce(F.sum(F.when(debt, c("weight"))), F.lit(0.0)).alias("debt_pct"), n_debt.alias("n_debt_holdings"),
        mean("y").alias("ytm_pct"), F.when(n_debt > 0, 100 * F.count("y") / n_debt).alias("ytm_cover"), mean("m").alias("avg_maturity_yrs"),
    )


def fund_attribution(lines: DataFrame, by: str, fund: str) -> DataFrame:
    """by, fund, asset_class, value, share: what each fund of a portfolio brings of each asset class, and its part of that class.

    lines: the columns of portfolio_splits with the fund that holds each line.
    """
    sums = reclassified(lines).groupBy(by, fund, "asset_class").agg(F.sum("weight").alias("value"))
    return sums.withColumn("share", F.try_divide(F.col("value"), F.nullif(F.sum("value").over(W.partitionBy(by, "asset_class")), F.lit(0.0))))
