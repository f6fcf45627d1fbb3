"""NAV series analytics: cleaning, returns, windows, rolling returns, risk, benchmark statistics, comparison.

Every function takes long tables (key, d, nav) and works on all series at once;
windows are per key, so one job replaces a loop over files.  Short histories give
nulls, never zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kosha import conventions as C

from .joins import small


def clean_series(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One positive value for each key and date, the last in `order`, by date."""
    last = F.max_by("nav", F.struct(*order))
    return rows.where(F.col("d").isNotNull() & (F.col("nav") > 0)).groupBy(key, "d").agg(last.alias("nav"))


def daily_returns(nav: DataFrame, key: str) -> DataFrame:
    """Return on the point before; null at the first one and where either value is not positive."""
    prev = F.lag("nav").over(W.partitionBy(key).orderBy("d"))
    return nav.withColumn("ret", F.when((prev > 0) & (F.col("nav") > 0), F.col("nav") / prev - 1))


def cagr(start: Column, end: Column, days: Column) -> Column:
    return F.when((start > 0) & (end > 0) & (days > 0), F.pow(end / start, C.DAYS_PER_YEAR / days) - 1)


def window_info(nav: DataFrame, key: str, years: float) -> DataFrame:
    """Growth over the last `years` up to the series' last date: start, end, days, points, complete and CAGR."""
    need = round(years * C.DAYS_PER_YEAR)
    last = F.max("d").over(W.partitionBy(key))
    inside = nav.withColumn("last", last).where(F.col("d") >= F.date_sub("last", need))
    out = inside.groupBy(key).agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count(F.lit(1)).alias("points"), F.min_by("nav", "d").alias("first"), F.max_by("nav", "d").alias("latest"))
    days = F.datediff("end", "start")
    complete = days >= need - 5
    return out.select(key, "start", "end", days.alias("days"), "points", complete.alias("complete"), F.when(complete, cagr(F.col("first"), F.col("latest"), days)).alias("cagr"))


def rolling_returns(nav: DataFrame, key: str, window: int = C.ROLLING_WINDOW_DAYS, slack: int = C.ROLLING_GAP_SLACK_DAYS) -> DataFrame:
    """Return on the first point of the last `window` days, kept where that is nearly a whole window back."""
    n = nav.withColumn("day", F.datediff("d", F.lit("1970-01-01")))
    base = F.first(F.struct("day", "nav")).over(W.partitionBy(key).orderBy("day").rangeBetween(-window, 0))
    return n.withColumn("base", base).where(F.col("day") - F.col("base.day") >= window - slack).select(key, "d", (F.col("nav") / F.col("base.nav") - 1).alias("ret"))


def rolling_distribution(nav: DataFrame, key: str) -> DataFrame:
    """Windows, share of positive ones, best, worst and upper median of the one-year rolling returns; null below 30 points or windows."""
    points = nav.groupBy(key).agg(F.count(F.lit(1)).alias("points"))
    sorted_ = F.sort_array(F.collect_list("ret"))
    agg = rolling_returns(nav, key).groupBy(key).agg(F.count(F.lit(1)).alias("windows"), F.avg((F.col("ret") > 0).cast("int")).alias("up"), F.max("ret").alias("best"), F.min("ret").alias("worst"), F.element_at(sorted_, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("mid"))
    enough = (F.col("points") >= C.MIN_POINTS_FOR_STATS) & (F.col("windows") >= C.MIN_POINTS_FOR_STATS)
    return points.join(agg, key, "left").select(key, F.coalesce("windows", F.lit(0)).alias("windows"), *[F.when(enough, c).alias(a) for c, a in ((F.round(F.col("up") * 100, 1), "positive_pct"), (F.col("best"), "best"), (F.col("worst"), "worst"), (F.col("mid"), "median"))])


def greedy_stride(points: DataFrame, key: str, step: int = 7) -> DataFrame:
    """Points at least `step` days after the one kept before: a fold over the sorted dates of each series."""
    days = F.sort_array(F.collect_list(F.struct(F.datediff("d", F.lit("1970-01-01")).alias("day"), F.col("ret"))))
    zero = F.struct(F.lit(-(10**6)).alias("last"), F.array().cast("array<struct<day:int,ret:double>>").alias("kept"))

    def fold(acc, x):
        take = x["day"] - acc["last"] >= step
        return F.struct(F.when(take, x["day"]).otherwise(acc["last"]).alias("last"), F.when(take, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    kept = points.groupBy(key).agg(days.alias("xs")).select(key, F.explode(F.aggregate("xs", zero, fold, lambda a: a["kept"])).alias("x"))
    return kept.select(key, F.date_add(F.lit("1970-01-01").cast("date"), F.col("x.day")).alias("d"), F.col("x.ret").alias("ret"))


def drawdowns(nav: DataFrame, key: str) -> DataFrame:
    """Fall from the running maximum at every date."""
    peak = F.max("nav").over(W.partitionBy(key).orderBy("d").rowsBetween(W.unboundedPreceding, 0))
    return nav.withColumn("drawdown", F.col("nav") / peak - 1)


def max_drawdown(nav: DataFrame, key: str) -> DataFrame:
    return drawdowns(nav, key).groupBy(key).agg(F.min("drawdown").alias("max_drawdown"))


def risk(nav: DataFrame, key: str, years: int = 3, rf_pct: float = C.DEFAULT_RF_PCT) -> DataFrame:
    """Volatility, Sharpe and Sortino over the last `years`, with the reason where the window is too short."""
    last = F.max("d").over(W.partitionBy(key))
    inside = nav.withColumn("last", last).where(F.col("d") >= F.date_sub("last", round(years * C.DAYS_PER_YEAR))).drop("last")
    r = daily_returns(inside, key)
    rf = rf_pct / 100
    below = F.when(F.col("ret").isNotNull(), F.least(F.col("ret") - rf / C.TRADING_DAYS, F.lit(0.0)))
    out = r.groupBy(key).agg(
        F.count(F.lit(1)).alias("points"), F.datediff(F.max("d"), F.min("d")).alias("days"), F.stddev_samp("ret").alias("sd"), F.sqrt(F.avg(below * below)).alias("dd"), F.min_by("nav", "d").alias("s"), F.max_by("nav", "d").alias("e")
    )
    few, short = F.col("points") < C.MIN_POINTS_FOR_STATS, F.col("days") < C.MIN_RISK_WINDOW_DAYS
    ok = ~few & ~short
    growth = cagr(F.col("s"), F.col("e"), F.col("days"))
    vol, down = F.col("sd") * C.TRADING_DAYS**0.5, F.col("dd") * C.TRADING_DAYS**0.5
    return out.select(
        key,
        "points",
        "days",
        F.when(ok, vol).alias("volatility"),
        F.when(ok, F.try_divide(growth - rf, F.nullif(vol, F.lit(0.0)))).alias("sharpe"),
        F.when(ok, F.try_divide(growth - rf, F.nullif(down, F.lit(0.0)))).alias("sortino"),
        F.when(few, "too few points").when(short, "span below one year").alias("risk_unavailable"),
    )


def benchmark_stats(nav: DataFrame, bench: DataFrame, key: str) -> DataFrame:
    """Beta, alpha, tracking error, information ratio and R squared on common dates; null below 30 dates or one year."""
    mine = daily_returns(nav, key).where("ret is not null")
    theirs = daily_returns(bench.withColumn("k", F.lit(0)), "k").where("ret is not null").select("d", F.col("ret").alias("b"))
    diff = F.col("ret") - F.col("b")
    out = mine.join(theirs, "d").groupBy(key).agg(
        F.count(F.lit(1)).alias("common"), F.datediff(F.max("d"), F.min("d")).alias("span"), F.covar_samp("ret", "b").alias("cov"), F.var_samp("b").alias("var"), F.avg("ret").alias("m"), F.avg("b").alias("mb"), F.stddev_samp(diff).alias("sd"), F.avg(diff).alias("md"), F.corr("ret", "b").alias("rho")
    )
    ok = (F.col("common") >= C.MIN_POINTS_FOR_STATS) & (F.col("span") >= C.MIN_RISK_WINDOW_DAYS) & (F.col("var") > 0)
    beta = F.col("cov") / F.col("var")
    return out.select(
        key,
        "common",
        F.when(ok, beta).alias("beta"),
        F.when(ok, (F.col("m") - beta * F.col("mb")) * C.TRADING_DAYS).alias("alpha"),
        F.when(ok, F.col("sd") * C.TRADING_DAYS**0.5).alias("tracking_error"),
        F.when(ok & (F.col("sd") > 0), F.col("md") / F.col("sd") * C.TRADING_DAYS**0.5).alias("information_ratio"),
        F.when(ok, F.col("rho") * F.col("rho")).alias("r_squared"),
    )


def series_analytics(nav: DataFrame, bench: DataFrame, key: str, rf_pct: float = C.DEFAULT_RF_PCT) -> DataFrame:
    """Growth over 1, 3 and 5 years and since inception, risk, drawdown and benchmark statistics of every series.

    One pass of windows over each series and one aggregation; the index, a row for
    each day, is joined by date.
    """
    need = {y: round(y * C.DAYS_PER_YEAR) for y in (1, 3, 5)}
    by_day, rf = W.partitionBy(key).orderBy("d"), rf_pct / 100
    index = daily_returns(bench.withColumn("k", F.lit(0)), "k").where("ret is not null").select("d", F.col("ret").alias("b"))
    rows = nav.withColumns({
        "last": F.max("d").over(W.partitionBy(key)),
        "before": F.lag("d").over(by_day),
        "ret": F.when((F.lag("nav").over(by_day) > 0) & (F.col("nav") > 0), F.col("nav") / F.lag("nav").over(by_day) - 1),
        "peak": F.max("nav").over(by_day.rowsBetween(W.unboundedPreceding, 0)),
    }).join(small(index), "d", "left")
    inside = {y: F.col("d") >= F.date_sub("last", n) for y, n in need.items()}
    ret3 = F.when(F.col("before") >= F.date_sub("last", need[3]), F.col("ret"))
    below = F.when(ret3.isNotNull(), F.least(ret3 - rf / C.TRADING_DAYS, F.lit(0.0)))
    both = F.col("ret").isNotNull() & F.col("b").isNotNull()
    mine, theirs, day = (F.when(both, F.col(c)) for c in ("ret", "b", "d"))
    ends = []
    for y in need:
        d = F.when(inside[y], F.col("d"))
        ends += [F.min(d).alias(f"s{y}"), F.min_by("nav", d).alias(f"n{y}"), F.count(d).alias(f"k{y}")]
    g = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("inception"), F.max("d").alias("as_of"), F.min_by("nav", "d").alias("first"), F.max_by("nav", "d").alias("e"), *ends,
        F.stddev_samp(ret3).alias("sd3"), F.sqrt(F.avg(below * below)).alias("dd3"), F.min(F.col("nav") / F.col("peak") - 1).alias("max_drawdown"),
        F.count(day).alias("common"), F.datediff(F.max(day), F.min(day)).alias("span"), F.covar_samp(mine, theirs).alias("cov"), F.var_samp(theirs).alias("var"), F.avg(mine).alias("m"), F.avg(theirs).alias("mb"),
        F.stddev_samp(mine - theirs).alias("sd"), F.corr(mine, theirs).alias("rho"),
    )
    years, days3 = [], F.datediff("as_of", "s3")
    for y, n in need.items():
        days = F.datediff("as_of", f"s{y}")
        years += [F.when(days >= n - 5, cagr(F.col(f"n{y}"), F.col("e"), days)).alias(f"cagr_{y}y"), (days >= n - 5).alias(f"complete_{y}y")]
    few, short = F.col("k3") < C.MIN_POINTS_FOR_STATS, days3 < C.MIN_RISK_WINDOW_DAYS
    growth, year = cagr(F.col("n3"), F.col("e"), days3), C.TRADING_DAYS**0.5
    ratio = lambda c: F.when(~few & ~short, F.try_divide(growth - rf, F.nullif(F.col(c) * year, F.lit(0.0))))
    ok, beta = (F.col("common") >= C.MIN_POINTS_FOR_STATS) & (F.col("span") >= C.MIN_RISK_WINDOW_DAYS) & (F.col("var") > 0), F.col("cov") / F.col("var")
    whole = F.datediff("as_of", "inception")
    return g.select(
        key, "n", "inception", "as_of", F.when(whole >= C.MIN_CAGR_WINDOW_DAYS, cagr(F.col("first"), F.col("e"), whole)).alias("cagr_inception"), *years,
        F.when(~few & ~short, F.col("sd3") * year).alias("volatility"), ratio("sd3").alias("sharpe"), ratio("dd3").alias("sortino"), F.when(few, "too few points").when(short, "span below one year").alias("risk_unavailable"),
        "max_drawdown", F.when(ok, beta).alias("beta"), F.when(ok, (F.col("m") - beta * F.col("mb")) * C.TRADING_DAYS).alias("alpha"), F.when(ok, F.col("sd") * year).alias("tracking_error"), F.when(ok, F.col("rho") * F.col("rho")).alias("r_squared"),
    )


def asof_fill(grid: DataFrame, series: DataFrame, key: str | list[str]) -> DataFrame:
    """The last value at or before each grid date, for each series: a union and a running last value instead of a range join."""
    keys = [key] if isinstance(key, str) else key
    asked = grid.select(*keys, "d", F.lit(None).cast("double").alias("nav"), F.lit(True).alias("asked"))
    both = asked.unionByName(series.select(*keys, "d", "nav", F.lit(False).alias("asked")))
    w = W.partitionBy(*keys).orderBy("d", "asked").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("value", F.last("nav", ignorenulls=True).over(w)).where("asked").select(*keys, "d", F.col("value").alias("nav"))


def _grids(nav: DataFrame, by: str, key: str, lines: DataFrame) -> DataFrame:
    """by, key, d: the dates of the densest series of each set (least key on ties), for every line (by, key)."""
    dense = nav.groupBy(by, key).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.max_by(key, F.struct("n", (-F.col(key)).alias("k"))).alias(key))
    return lines.select(by, key).distinct().join(nav.join(dense, [by, key], "left_semi").select(by, "d"), by)


def compare(nav: DataFrame, by: str, key: str) -> DataFrame:
    """Growth of the series of each set over their common window, on the grid of the densest one, rebased to 100.

    nav: by (the set, of at most 12 series), key (a number), d, nav.
    """
    common = nav.groupBy(by, key).agg(F.min("d").alias("s"), F.max("d").alias("e")).groupBy(by).agg(F.max("s").alias("s"), F.min("e").alias("e"))
    inside = nav.join(small(common), by).where(F.col("d").between(F.col("s"), F.col("e")))
    filled = asof_fill(_grids(inside, by, key, nav), nav, [by, key])
    first = F.first("nav").over(W.partitionBy(by, key).orderBy("d"))
    return filled.withColumn("rebased", 100 * F.col("nav") / first)


def portfolio_blend(nav: DataFrame, weights: DataFrame, by: str, key: str) -> DataFrame:
    """Value of weighted portfolios on the densest grid of each, every series at 100 on its first valued grid date; days on which one has no value yet are skipped.

    weights (by, key, weight) are scaled to 100 for each portfolio, of at most 50
    lines; nav: key (a number), d, nav.
    """
    lines = weights.groupBy(by, key).agg(F.sum("weight").alias("w"))
    total = lines.groupBy(by).agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("lines"))
    mine = nav.join(small(lines), key)
    filled = asof_fill(_grids(mine, by, key, lines), mine, [by, key]).where("nav is not null")
    base = F.first("nav").over(W.partitionBy(by, key).orderBy("d"))
    valued = filled.withColumn("rel", F.col("nav") / base).join(small(lines), [by, key])
    sums = valued.groupBy(by, "d").agg(F.sum(F.col("rel") * F.col("w")).alias("x"), F.count(F.lit(1)).alias("k"))
    return sums.join(small(total), by).where(F.col("k") == F.col("lines")).select(by, "d", (100 * F.col("x") / F.col("total")).alias("nav"))


def completeness(nav: DataFrame, key: str, as_of: str, max_gap: int = 10, max_age: int = 7) -> DataFrame:
    """Points, largest gap, age of the last point at as_of, and whether the history is whole."""
    gap = F.datediff("d", F.lag("d").over(W.partitionBy(key).orderBy("d")))
    out = nav.withColumn("gap", gap).groupBy(key).agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"), F.datediff(F.lit(as_of).cast("date"), F.max("d")).alias("age"))
    return out.withColumn("complete", (F.col("max_gap") <= max_gap) & (F.col("age") <= max_age))
