"""Listing, lookup and facet queries over schemes, securities, holdings and bonds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contains(column: str, text: str) -> Column:
    """Literal, case-insensitive substring search: no wildcard needs escaping."""
    return F.contains(F.lower(F.col(column)), F.lit(text.lower()))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order; Spark keeps only limit + offset rows of each task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_of_each(df: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows of each group in a total order."""
    return df.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("k") <= limit).drop("k")


def list_schemes(schemes: DataFrame, holdings: DataFrame | None = None, securities: DataFrame | None = None, amc=None, category=None, search=None, cap=None, sector=None, limit=50, offset=0) -> DataFrame:
    """Schemes that meet every given condition, by size; conditions on securities are semi-joins, so no scheme repeats."""
    out = schemes
    for column, value in (("amc", amc), ("category", category)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if search:
        out = out.where(contains("fund_name", search))
    if cap or sector:
        want = securities
        want = want.where(F.col("cap") == cap) if cap else want
        want = want.where(F.col("sector") == sector) if sector else want
        out = out.join(holdings.join(want.select("isin"), "isin", "left_semi").select("scheme_id"), "scheme_id", "left_semi")
    return page(out, [F.col("aum").desc_nulls_last(), F.col("fund_name"), F.col("scheme_id")], limit, offset)


def find_schemes(schemes: DataFrame, names: DataFrame) -> DataFrame:
    """Schemes by names, whatever their case and punctuation."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return schemes.join(names.select(key(F.col("name")).alias("k")).distinct(), key(F.col("fund_name")) == F.col("k"), "left_semi")


def security_usage(holdings: DataFrame, isin, limit: int) -> DataFrame:
    return page(holdings.where(F.col("isin") == isin), [F.col("weight").desc(), F.col("scheme_id")], limit)


def mapping(holdings: DataFrame, securities: DataFrame, text: str, limit: int) -> DataFrame:
    """The heaviest holding of each security whose name has the text."""
    found = holdings.join(securities.where(contains("name", text)), "isin")
    k = F.row_number().over(W.partitionBy("isin").orderBy(F.desc("weight"), "scheme_id"))
    return page(found.withColumn("k", k).where("k = 1").drop("k"), [F.col("weight").desc(), F.col("isin")], limit)


def maturity_bucket(months: Column) -> Column:
    return F.when(months < 12, "<1y").when(months < 36, "1-3y").when(months < 60, "3-5y").when(months < 120, "5-10y").otherwise("10y+")


def list_bonds(bonds: DataFrame, segment=None, bucket=None, sort: str = "coupon", ascending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    out = bonds.withColumn("bucket", maturity_bucket(F.months_between("maturity", "settle")))
    out = out.where(F.col("segment") == segment) if segment else out
    out = out.where(F.col("bucket") == bucket) if bucket else out
    order = F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_last()
    return page(out, [order, F.col("isin")], limit, offset)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows for each value of each column, in one pass over the data."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))
