"""The reference entities of the test data: schemes, holdings, NAV series, bars, transactions, bonds and statements.

Every adapter has a DuckDB twin in kosha.plans.sql, written independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walk(returns: DataFrame, key: str) -> DataFrame:
    """Level 100 * exp(sum of log returns) for each key, by date."""
    w = W.partitionBy(key).orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    return returns.withColumn("nav", 100 * F.exp(F.sum(F.log(1 + F.col("r"))).over(w)))


def _return():
    return (F.avg((F.col("l_discount") - 0.05) * 0.4) + 0.0004).alias("r")


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scheme_id, d, nav: one series for each supplier."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scheme_id"), F.col("l_shipdate").cast("date").alias("d"), "l_discount")
    return walk(rows.groupBy("scheme_id", "d").agg(_return()), "scheme_id").select("scheme_id", "d", "nav")


def benchmark_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, nav of the index over all line items."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"), "l_discount")
    return walk(rows.groupBy("d").agg(_return()).withColumn("k", F.lit(0)), "k").select("d", "nav")


def bars(spark: SparkSession, sf_dir: str, by: str = "p_type") -> DataFrame:
    """isin, d, open, high, low, close, volume: one series for each p_type or p_brand."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(by).alias("isin"))
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("d"), "l_discount", "l_tax", "l_quantity").join(part, "l_partkey")
    days = rows.groupBy("isin", "d").agg(_return(), F.max("l_tax").alias("up"), F.min("l_tax").alias("down"), F.sum("l_quantity").cast("double").alias("volume"))
    w = W.partitionBy("isin").orderBy("d")
    days = walk(days, "isin").withColumnRenamed("nav", "close").withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    return days.select(
        "isin", "d", "open", (F.greatest("open", "close") * (1 + F.col("up") / 4)).alias("high"), (F.least("open", "close") * (1 - F.col("down") / 4)).alias("low"), "close", "volume"
    )


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isin, name, sector, cap, section, confirmed_equity, source_count."""
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("isin"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("sector"),
        F.when(size <= 15, "large").when(size <= 35, "mid").otherwise("small").alias("cap"),
        F.col("p_type").alias("section"),
        F.when(F.pmod("p_partkey", F.lit(3)) == 0, 0.0).when(F.pmod("p_partkey", F.lit(3)) == 1, 0.5).otherwise(1.0).alias("confirmed_equity"),
        F.pmod("p_partkey", F.lit(7)).cast("int").alias("source_count"),
    )


def schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scheme_id, fund_name, amc, category, aum."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    aum = F.when(F.pmod("s_suppkey", F.lit(17)) != 0, F.col("s_acctbal").cast("double"))
    return joined.select(F.col("s_suppkey").alias("scheme_id"), F.col("s_name").alias("fund_name"), F.col("n_name").alias("amc"), F.col("r_name").alias("category"), aum.alias("aum"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scheme_id, isin, market_value, weight (percent of the scheme)."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("scheme_id"), F.col("l_partkey").alias("isin")).agg(F.sum(F.col("l_extendedprice").cast("double")).alias("market_value"))
    return rows.withColumn("weight", 100 * F.col("market_value") / F.sum("market_value").over(W.partitionBy("scheme_id")))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """portfolio_id, tx_id, d, tx_type, amount."""
    kind = F.create_map(*[F.lit(x) for p in TX_TYPES.items() for x in p])
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("portfolio_id"), F.col("o_orderkey").alias("tx_id"), F.col("o_orderdate").cast("date").alias("d"), kind[F.substring("o_orderpriority", 1, 1)].alias("tx_type"), F.col("o_totalprice").cast("double").alias("amount")
    )


TX_TYPES = {"1": "Purchase", "2": "SIP", "3": "Redemption", "4": "Switch In", "5": "Dividend Payout"}


def statements(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    """isin, fy, q, end, revenue, expenses, tax: one row for each supplier and fiscal quarter (April to March).

    With exact, revenue is summed in decimals (six places of price and discount),
    so that it does not depend on the order of rows where it stands between two
    whole numbers.
    """
    d = F.col("l_shipdate").cast("date")
    q = (F.floor(F.pmod(F.month(d) - 4, F.lit(12)) / 3) + 1).cast("int")
    fy = F.when(F.month(d) >= 4, F.year(d) + 1).otherwise(F.year(d))
    gross, price = F.col("l_extendedprice").cast("double"), F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount"))
    if exact:
        price = F.col("l_extendedprice").cast("decimal(18,6)") * (1 - F.col("l_discount").cast("decimal(8,6)"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("isin"), fy.alias("fy"), q.alias("q"), price.alias("rev"), (gross * F.col("l_tax")).alias("tax"), (gross * 0.6).alias("exp"), F.col("l_quantity").cast("double").alias("qty"))
    out = rows.groupBy("isin", "fy", "q").agg(F.sum("rev").alias("revenue"), F.sum("exp").alias("expenses"), F.sum("tax").alias("tax"), F.sum("qty").alias("quantity"))
    end = F.last_day(F.make_date(F.when(F.col("q") == 4, F.col("fy")).otherwise(F.col("fy") - 1), F.when(F.col("q") == 4, 3).otherwise(F.col("q") * 3 + 3), F.lit(1)))
    return out.withColumn("end", end).withColumn("pat", F.col("revenue") - F.col("expenses") - F.col("tax"))


def bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isin, name, coupon (percent), price, maturity, settle, freq, segment."""
    k = F.col("p_partkey").cast("int")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("isin"),
        F.col("p_name").alias("name"),
        (F.when(F.pmod(k, F.lit(11)) == 0, 0.0).otherwise(4.0 + F.col("p_size") / 10.0)).alias("coupon"),
        (80.0 + F.pmod(k, F.lit(41)) + F.col("p_retailprice").cast("double") / 1000).alias("price"),
        F.date_add(F.lit("2002-01-01").cast("date"), (200 + F.pmod(k * 37, F.lit(5000))).cast("int")).alias("maturity"),
        F.lit("2002-01-01").cast("date").alias("settle"),
        F.when(F.pmod(k, F.lit(2)) == 0, 2).otherwise(1).alias("freq"),
        F.col("p_type").alias("segment"),
    )
