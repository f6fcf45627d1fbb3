"""Bond mathematics: present value, duration, yield to maturity, current yield."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kosha.functions.documents import payments_a_year


def price_at(y: Column, coupon: Column, n: Column, first: Column, freq: Column) -> Column:
    """Dirty price of 100 face: n coupons at first, first + 1, ... periods, at the annual yield y (not 0) compounded freq times, in closed form."""
    growth, c = 1 + y / freq, coupon / freq
    return c * F.pow(growth, -first) * (1 - F.pow(growth, -n)) / (1 - 1 / growth) + 100 * F.pow(growth, -(first + n - 1))


def schedule(bonds: DataFrame) -> DataFrame:
    """Adds years to maturity, coupons left (n), the first of them (in periods from now, over 0 and up to 1) and accrued interest."""
    periods = F.col("years") * F.col("freq")
    part = periods - F.floor(periods)
    on_date = part < 1e-9
    out = bonds.withColumn("years", F.datediff("maturity", "settle") / 365.25)
    out = out.withColumn("first", F.when(on_date, 1.0).otherwise(part)).withColumn("n", F.greatest(F.lit(1), F.when(on_date, F.round(periods)).otherwise(F.floor(periods) + 1)).cast("int"))
    return out.withColumn("accrued", F.col("coupon") / F.col("freq") * (1 - F.col("first")))


def bisect(f, low: float, high: float, steps: int = 60) -> Column:
    """Zero of a falling function of a yield between low and high; null where it is below 0 at low.

    The interval halves at each step, so only its lower end is carried along.
    """
    width = high - low

    def step(at, k):
        half = F.lit(width) / F.pow(F.lit(2.0), k)
        return at + F.when(f(at + half) > 0, half).otherwise(0.0)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(low), step)
    return F.when(f(F.lit(low)) >= 0, found)


def with_ytm(bonds: DataFrame) -> DataFrame:
    """Yield to maturity from clean prices above 0 and up to 300; zero-coupon bonds in closed form, annual, below 0 at prices over 100."""
    b = schedule(bonds)
    dirty = F.col("price") + F.col("accrued")
    solved = bisect(lambda y: price_at(y, F.col("coupon"), F.col("n"), F.col("first"), F.col("freq")) - dirty, 1e-6, 6.0)
    zero = F.pow(100 / F.col("price"), 1 / F.col("years")) - 1
    fair = (F.col("price") > 0) & (F.col("price") <= 300) & (F.col("years") > 0)
    return b.withColumn("ytm", F.when(fair, F.when(F.coalesce("coupon", F.lit(0.0)) <= 0, zero).otherwise(solved)))


def with_duration(bonds: DataFrame) -> DataFrame:
    """Macaulay and modified duration in years at the yield to maturity."""
    per, c = F.col("ytm") / F.col("freq"), F.col("coupon") / F.col("freq")
    weighted = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda acc, k: acc + (F.col("first") + k) * c / F.pow(1 + per, F.col("first") + k))
    last = F.col("first") + F.col("n") - 1
    total = price_at(F.col("ytm"), F.col("coupon"), F.col("n"), F.col("first"), F.col("freq"))
    macaulay = F.when(F.col("coupon") == 0, F.col("years")).otherwise((weighted + last * 100 / F.pow(1 + per, last)) / total / F.col("freq"))
    modified = F.when(F.col("coupon") == 0, macaulay / (1 + F.col("ytm"))).otherwise(macaulay / (1 + per))
    return bonds.withColumn("macaulay", macaulay).withColumn("modified", modified)


def current_yield(coupon: Column, price: Column) -> Column:
    return F.when(price > 0, 100 * coupon / price)


def resolve_yield(bonds: DataFrame) -> DataFrame:
    """The best yield known, with its source: last trade and weighted average where above 0, computed, current yield, none."""
    ladder = [("last_trade", F.when(F.col("trade_yield") > 0, F.col("trade_yield"))), ("weighted", F.when(F.col("weighted_yield") > 0, F.col("weighted_yield"))), ("computed", 100 * F.col("ytm")), ("current_yield", current_yield(F.col("coupon"), F.col("price")))]
    pick = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("yield"), F.lit(n).alias("source"))) for n, v in ladder], F.struct(F.lit(None).cast("double").alias("yield"), F.lit("n/a").alias("source")))
    return bonds.withColumn("p", pick).select("*", F.col("p.yield").alias("yield"), F.col("p.source").alias("source")).drop("p")


def ytm_from_price(bonds: DataFrame, as_of: str) -> DataFrame:
    """bonds with ytm_pct (four decimals) and ytm_source from the last traded price.

    bonds: isin, coupon, price, last_price, maturity, segment, coupon_freq (text),
    last_trade_date, trade_date.  A price of 0 is none; yields settle on the last
    trade, else the trade, else as_of; without a frequency treasury bills pay once
    a year and others twice.
    """
    c = F.col
    price = F.coalesce(F.nullif("price", F.lit(0.0)), "last_price")
    freq = F.coalesce(payments_a_year(c("coupon_freq")), F.when(c("segment") == "T-Bill", 1).otherwise(2))
    settle = F.coalesce("last_trade_date", "trade_date", F.lit(as_of).cast("date"))
    b = with_ytm(bonds.withColumns({"price": price, "freq": freq, "settle": settle}))
    kind = F.when(F.coalesce("coupon", F.lit(0.0)) <= 0, "computed: money-market zero-coupon").otherwise("computed: computed from coupon+price+maturity")
    return b.withColumn("ytm_pct", F.round(100 * c("ytm"), 4)).withColumn("ytm_source", F.when(c("ytm").isNotNull(), kind))
