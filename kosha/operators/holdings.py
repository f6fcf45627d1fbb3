"""Holdings of schemes with what other tables know of them, and a scheme's own series with its own benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.conventions import MIN_POINTS_FOR_STATS, MIN_RISK_WINDOW_DAYS, TRADING_DAYS
from kosha.functions import classes as K

from . import series as S

c = F.col
HEDGED_LEG = "Futures & Options (hedged equity leg)"


def enrich_holdings(holdings: DataFrame, securities: DataFrame, bonds: DataFrame) -> DataFrame:
    """Every holding with its refined class, market cap, debt details and effective weight, and one line for each scheme's hedged equity.

    holdings: scheme_id, isin, company, sector, asset_class, yield_text,
    percent_nav, pct_hedged, pct_unhedged.  securities: isin, cap,
    confirmed_equity.  bonds: isin, coupon, maturity_date, rating, ytm.

    A line that is no stock but has the isin of a confirmed equity loses it.  A
    debt line's own text comes first, the catalog of bonds fills what is
    missing.  A hedged stock counts with its unhedged part: that which is stated,
    or the whole less the hedge if it is not or does not add up and is larger.
    Debt yields of a scheme whose largest is under 1 are fractions, all of them.
    """
    s = securities.select(c("isin").alias("s_isin"), "cap", "confirmed_equity")
    h = holdings.join(s, c("isin") == c("s_isin"), "left").drop("s_isin")
    kind = K.refine_asset_class(c("asset_class"), c("confirmed_equity"), c("isin"))
    mistaken = (kind != "stocks") & F.coalesce(c("confirmed_equity") == 1, F.lit(False))
    h = h.withColumn("mistaken", mistaken).withColumn("asset_class", F.when(mistaken, K.refine_asset_class(c("asset_class"), c("confirmed_equity"), F.lit(""))).otherwise(kind))
    h = h.withColumn("isin", F.when(c("mistaken"), F.lit("")).otherwise(c("isin"))).drop("mistaken")

    debt = c("asset_class") == "debt"
    told = K.debt_details(c("company"), c("yield_text"), c("sector"))
    b = bonds.select(c("isin").alias("b_isin"), c("coupon").alias("b_coupon"), c("maturity_date").alias("b_maturity"), c("rating").alias("b_rating"), F.when(c("ytm") > 0, F.round("ytm", 4)).alias("b_ytm"))
    h = h.join(b, c("isin") == c("b_isin"), "left")
    given = lambda x: F.nullif(x, F.lit(0.0))
    filled = {"coupon": F.coalesce(given(told["coupon"]), c("b_coupon"), told["coupon"]), "maturity_date": F.coalesce(told["maturity_date"], c("b_maturity")), "rating": F.coalesce(F.nullif(told["rating"], F.lit("")), c("b_rating")), "ytm": F.coalesce(given(told["ytm"]), c("b_ytm"), told["ytm"])}
    h = h.withColumns({k: F.when(debt, v) for k, v in filled.items()}).drop("b_isin", "b_coupon", "b_maturity", "b_rating", "b_ytm")
    of_scheme = Window.partitionBy("scheme_id")
    top = F.max(F.when(debt & (c("ytm") != 0), c("ytm"))).over(of_scheme)
    h = h.withColumn("ytm", F.when((top < 1) & (c("ytm") != 0), F.round(c("ytm") * 100, 4)).otherwise(c("ytm")))

    gross, hedged = c("percent_nav"), F.coalesce("pct_hedged", F.lit(0.0))
    split = (c("asset_class") == "stocks") & gross.isNotNull() & ((hedged != 0) | c("pct_unhedged").isNotNull())
    rest = F.greatest(gross - hedged, F.lit(0.0))
    apart = F.abs(c("pct_unhedged") + hedged - gross) > F.greatest(F.lit(0.02), 0.01 * gross)
    net = F.coalesce(F.when(apart, F.least(c("pct_unhedged"), rest)).otherwise(c("pct_unhedged")), rest)
    h = h.withColumn("hedge", F.when(split, hedged)).withColumn("percent_raw", F.when(split, gross)).withColumn("percent_nav", F.when(split, F.round(net, 6)).otherwise(gross)).withColumn("derived", F.lit(False))
    legs = h.groupBy("scheme_id").agg(F.sum("hedge").alias("hedge")).where("hedge > 1e-9")
    leg = {"scheme_id": c("scheme_id"), "isin": F.lit(""), "company": F.lit(HEDGED_LEG), "sector": F.lit("Derivatives"), "asset_class": F.lit("future_options"), "percent_nav": F.round("hedge", 6), "derived": F.lit(True)}
    out = [f for f in h.columns if f != "hedge"]
    types = dict(h.dtypes)
    return h.select(*out).unionByName(legs.select(*[(leg[f] if f in leg else F.lit(None)).cast(types[f]).alias(f) for f in out]))


def hedge_summary(enriched: DataFrame) -> DataFrame:
    """scheme_id, gross and net equity, hedged part, and whether any line is hedged, of enriched holdings."""
    stock = c("asset_class") == "stocks"
    g = enriched.groupBy("scheme_id").agg(
        F.coalesce(F.sum(F.when(stock, F.coalesce("percent_raw", "percent_nav"))), F.lit(0.0)).alias("gross_equity_pct"), F.coalesce(F.sum(F.when(stock, c("percent_nav"))), F.lit(0.0)).alias("net_equity_pct"),
        F.coalesce(F.sum(F.when(c("derived"), c("percent_nav"))), F.lit(0.0)).alias("hedged_pct"), F.count(F.when(c("percent_raw").isNotNull(), 1)).alias("n_hedged"),
    )
    return g.withColumn("has_hedge", c("n_hedged") > 0)


# The index that a fund is compared with, by the first pattern that its category and name have.
BENCHMARKS = (
    (r"nifty\s*500\s*equal\s*weight", "NIFTY 500 EQUAL WEIGHT"), (r"equal\s*weight", "NIFTY 50 EQUAL WEIGHT"), (r"nifty\s*next\s*100", "NIFTY NEXT 100"), (r"nifty\s*next\s*50|junior", "NIFTY NEXT 50"), (r"200\s*momentum\s*30", "NIFTY200 MOMENTUM 30"),
    (r"100\s*alpha\s*30", "NIFTY100 ALPHA 30"), (r"200\s*quality\s*30", "NIFTY200 QUALITY 30"), (r"100\s*low\s*volatility\s*30", "NIFTY100 LOW VOLATILITY 30"), (r"200\s*value\s*30", "NIFTY200 VALUE 30"), (r"50\s*value\s*20", "NIFTY 50 VALUE 20"),
    (r"500\s*momentum\s*50", "NIFTY500 MOMENTUM 50"), (r"momentum", "NIFTY200 MOMENTUM 30"), (r"\balpha\b", "NIFTY100 ALPHA 30"), (r"quality", "NIFTY200 QUALITY 30"), (r"low\s*volatility", "NIFTY100 LOW VOLATILITY 30"), (r"\bvalue\b", "NIFTY200 VALUE 30"),
    (r"nifty\s*500", "NIFTY 500"), (r"nifty\s*200", "NIFTY 200"), (r"nifty\s*100", "NIFTY 100"), (r"nifty\s*50\b", "NIFTY 50"), (r"cnx\s*nifty\b|bees\b", "NIFTY 50"), (r"midcap\s*150|mid\s*cap\s*150", "NIFTY MIDCAP 150"),
    (r"smallcap\s*250|small\s*cap\s*250", "NIFTY SMALLCAP 250"), (r"midcap|mid\s*cap", "NIFTY MIDCAP 150"), (r"smallcap|small\s*cap", "NIFTY SMALLCAP 250"), (r"large\s*cap|largecap", "NIFTY 100"), (r"total\s*market", "NIFTY TOTAL MARKET"),
    (r"nifty\s*bank|\bbanks?\b|banking", "NIFTY BANK"), (r"\bit\b", "NIFTY IT"), (r"pharma", "NIFTY PHARMA"), (r"health\s*care|healthcare", "NIFTY HEALTHCARE"), (r"fmcg", "NIFTY FMCG"), (r"auto\b|automobiles?", "NIFTY AUTO"), (r"energy", "NIFTY ENERGY"),
    (r"\bmetals?\b", "NIFTY METAL"), (r"\bpower\b", "NIFTY POWER"), (r"consumption", "NIFTY INDIA CONSUMPTION"), (r"infrastructure", "NIFTY INFRASTRUCTURE"), (r"\bcpse\b", "NIFTY CPSE"), (r"\bpsu\b", "NIFTY PSE"), (r"\bmnc\b", "NIFTY MNC"),
    (r"dividend", "NIFTY DIVIDEND OPPORTUNITIES 50"),
)
DEFAULT_BENCHMARK = "NIFTY 500"


def benchmark_of(tracked: Column, category: Column, fund_name: Column) -> Column:
    """The index a fund tracks, else, for equity funds, that of its name, else a broad one; others have none."""
    own = F.nullif(F.trim(F.coalesce(tracked, F.lit(""))), F.lit(""))
    equity = F.lower(F.coalesce(category, F.lit(""))) == "equity"
    text = F.lower(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(fund_name, F.lit(""))))
    return F.coalesce(F.upper(F.regexp_replace(own, "_", " ")), F.when(equity, _first(text)))


def _first(text: Column) -> Column:
    out = F.lit(DEFAULT_BENCHMARK)
    for pattern, name in reversed(BENCHMARKS):
        out = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(out)
    return out


def plan_series(schemes: DataFrame, prices: DataFrame) -> DataFrame:
    """scheme_id, plan, d and nav of each scheme: of the direct plan if that has prices, else of the regular one.

    schemes: scheme_id, direct, regular (codes of plans, or null).  prices: code,
    d, nav; only positive ones count.
    """
    codes = schemes.select("scheme_id", F.inline(F.array(F.struct(F.lit("direct").alias("plan"), c("direct").alias("code")), F.struct(F.lit("regular").alias("plan"), c("regular").alias("code"))))).where("code IS NOT NULL")
    good = prices.where("nav > 0")
    priced = codes.join(good.select("code").distinct(), "code", "left_semi")
    used = priced.groupBy("scheme_id").agg(F.min_by(F.struct("plan", "code"), "plan").alias("u")).select("scheme_id", "u.plan", "u.code")
    return used.join(good, "code").select("scheme_id", "plan", "d", "nav")


def scheme_analytics(schemes: DataFrame, prices: DataFrame, indices: DataFrame, as_of: str) -> DataFrame:
    """Growth, risk, history and the statistics against its own benchmark of every scheme, over its own plan's series.

    schemes: scheme_id, direct, regular, index_name, category, fund_name.
    indices: index, d, nav.  benchmark is the index's name, with a remark where
    it has no series; error tells why a scheme has no figures.
    """
    nav = plan_series(schemes, prices)
    named = schemes.select("scheme_id", benchmark_of(c("index_name"), c("category"), c("fund_name")).alias("index"))
    own = S.series_analytics(nav, indices.where("false").select("d", "nav"), "scheme_id").drop("beta", "alpha", "tracking_error", "r_squared")
    mine = S.daily_returns(nav, "scheme_id").where("ret IS NOT NULL").join(named, "scheme_id")
    theirs = S.daily_returns(indices, "index").where("ret IS NOT NULL").select("index", "d", c("ret").alias("b"))
    apart = c("ret") - c("b")
    g = mine.join(theirs, ["index", "d"]).groupBy("scheme_id").agg(
        F.count(F.lit(1)).alias("common"), F.datediff(F.max("d"), F.min("d")).alias("span"), F.covar_samp("ret", "b").alias("cov"), F.var_samp("b").alias("var"), F.avg("ret").alias("m"), F.avg("b").alias("mb"), F.stddev_samp(apart).alias("sd")
    )
    ok, beta = (c("common") >= MIN_POINTS_FOR_STATS) & (c("span") >= MIN_RISK_WINDOW_DAYS) & (c("var") > 0), c("cov") / c("var")
    against = g.select("scheme_id", F.when(ok, beta).alias("beta"), F.when(ok, (c("m") - beta * c("mb")) * TRADING_DAYS).alias("alpha"), F.when(ok, c("sd") * TRADING_DAYS**0.5).alias("tracking_error"))
    known = indices.select("index").distinct().withColumn("known", F.lit(True))
    label = F.when(c("index").isNotNull(), F.when(c("known"), c("index")).otherwise(F.concat(c("index"), F.lit(" (series unavailable)"))))
    plans = nav.groupBy("scheme_id").agg(F.first("plan").alias("plan_used"))
    history = S.completeness(nav, "scheme_id", as_of)
    base = named.join(known, "index", "left").select("scheme_id", label.alias("benchmark"))
    out = base.join(plans, "scheme_id", "left").join(own, "scheme_id", "left").join(against, "scheme_id", "left").join(history, "scheme_id", "left")
    return out.withColumn("error", F.when(c("plan_used").isNull(), "no price history for this scheme"))
