"""Queries of the cross-sectional factors (X) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.operators import factors as X
from kosha.sources import adapters as D

from . import sql
from .registry import register

B = sql.bars("p_brand")
MOM = f"""{B}, mk AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY d DESC) AS k, close / lag(close) OVER (PARTITION BY isin ORDER BY d) - 1 AS ret FROM bars),
mg AS (SELECT isin, count(*) AS n, max(close) FILTER (k = 22) AS c1, max(close) FILTER (k = 64) AS c3, max(close) FILTER (k = 127) AS c6, max(close) FILTER (k = 253) AS c12, stddev_samp(ret) FILTER (k <= 252) AS sd FROM mk GROUP BY 1),
mom AS (SELECT isin, c1 / c12 - 1 AS ret_12_1, c1 / c6 - 1 AS ret_6_1, c1 / c3 - 1 AS ret_3_1, (c1 / c12 - 1) / nullif(sd * sqrt(252), 0) AS ret_12_1_risk_adj FROM mg WHERE n >= 201)"""
LOW = f"""{sql.BENCH}, bm AS (SELECT d, nav / lag(nav) OVER (ORDER BY d) - 1 AS m FROM bench), lk AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY d DESC) AS k FROM bars),
lr AS (SELECT isin, d, close / lag(close) OVER w - 1 AS ret, close / max(close) OVER w - 1 AS dd FROM lk WHERE k <= 253 WINDOW w AS (PARTITION BY isin ORDER BY d)), lj AS (SELECT * FROM lr LEFT JOIN bm USING (d)),
low AS (SELECT isin, stddev_samp(ret) * sqrt(252) AS vol_252, CASE WHEN count(*) FILTER (ret < 0) >= 30 THEN stddev_samp(ret) FILTER (ret < 0) * sqrt(252) END AS downside_dev, CASE WHEN count(*) FILTER (ret IS NOT NULL AND m IS NOT NULL) >= 60 THEN covar_samp(ret, m) / nullif(var_samp(m) FILTER (ret IS NOT NULL), 0) END AS beta, min(dd) AS max_drawdown FROM lj GROUP BY 1 HAVING count(*) >= 180)"""


def _ranks(t, cols, out):
    z = ", ".join(f"greatest(-3, least(3, ({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0))) * {-1 if c in X.INVERTED else 1} AS {c}" for c in cols)
    return f"{out}z AS (SELECT isin, {z} FROM {t}), {out} AS (SELECT isin, ({' + '.join(f'100 * percent_rank() OVER (ORDER BY {c})' for c in cols)}) / {len(cols)} AS score FROM {out}z)"


_M, _L = ("ret_12_1", "ret_6_1", "ret_3_1", "ret_12_1_risk_adj"), ("vol_252", "downside_dev", "beta", "max_drawdown")
SCORES = f"{MOM}, {LOW}, {_ranks('mom', _M, 'rm')}, {_ranks('low', _L, 'rl')}, scores AS (SELECT isin, rm.score AS momentum, rl.score AS lowvol, (rm.score + rl.score) / 2 AS multi FROM rm FULL JOIN rl USING (isin))"


# Yearly facts of each series from the line items, and ratios per share of a fixed number of shares.
FACTS = """fy AS (SELECT p_brand AS isin, year(l_shipdate) AS fy, sum(l_extendedprice * (1 - l_discount)) / 1e5 AS revenue, sum(l_extendedprice * (0.35 - l_tax - l_discount)) / 1e5 AS pat, sum(l_extendedprice * (0.3 - l_tax)) / 1e5 AS cfo, sum(l_quantity) / 1e2 AS assets, sum(l_extendedprice * l_discount) / 1e5 AS debt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
yr AS (SELECT *, 100 * pat / nullif(assets - debt, 0) AS roe, CASE WHEN revenue > 0 AND fy % 4 <> 0 THEN 100 * pat / revenue END AS margin, debt / nullif(assets - debt, 0) AS leverage FROM fy),
la AS (SELECT isin, arg_max(pat, fy) AS eps, arg_max(assets - debt, fy) AS bvps, arg_max(revenue, fy) AS sps, arg_max(cfo, fy) AS cfps, CASE WHEN length(isin) % 2 = 0 THEN arg_max(pat, fy) * 0.3 END AS dps, arg_max(pat + cfo, fy) AS ebitda, arg_max(debt, fy) AS net_debt, count(*) % 10 AS piotroski FROM yr GROUP BY 1)"""
VALUE = f"""{FACTS}, px AS (SELECT isin, arg_max(close, d) AS price FROM bars GROUP BY 1), val AS (SELECT isin, CASE WHEN eps <> 0 THEN eps / price END AS earnings_yield, CASE WHEN bvps > 0 THEN bvps / price END AS book_yield, CASE WHEN sps > 0 THEN sps / price END AS sales_yield, CASE WHEN cfps > 0 THEN cfps / price END AS cashflow_yield,
  CASE WHEN ebitda > 0 AND price + coalesce(net_debt, 0) > 0 THEN ebitda / (price + coalesce(net_debt, 0)) END AS ev_ebitda_inv, CASE WHEN dps > 0 THEN dps / price END AS dividend_yield FROM px JOIN la USING (isin) WHERE price > 0)"""
QUALITY = """ma AS (SELECT isin, margin, CAST(row_number() OVER (PARTITION BY isin ORDER BY fy) AS DOUBLE) AS x FROM yr WHERE margin IS NOT NULL), ms AS (SELECT isin, CASE WHEN count(*) >= 3 THEN regr_slope(margin, x) END AS margin_slope FROM ma GROUP BY 1),
qu AS (SELECT isin, arg_max(roe, fy) AS roe_level, CASE WHEN count(roe) >= 3 AND avg(roe) <> 0 THEN -stddev_samp(roe) / abs(avg(roe)) END AS roe_stability, -arg_max((pat - cfo) / nullif(assets, 0), fy) AS accruals_inv, CASE WHEN arg_max(leverage, fy) >= 0 THEN -arg_max(leverage, fy) END AS leverage_inv, any_value(margin_slope) AS margin_slope, any_value(piotroski) / 9 AS piotroski_scaled FROM yr JOIN la USING (isin) LEFT JOIN ms USING (isin) GROUP BY 1)"""
_V = ("earnings_yield", "book_yield", "sales_yield", "cashflow_yield", "ev_ebitda_inv", "dividend_yield")
_Q = ("roe_level", "roe_stability", "accruals_inv", "leverage_inv", "margin_slope", "piotroski_scaled")


def _years(spark, sf):
    c = F.col
    p = D.read(spark, sf, "part").select(c("p_partkey").alias("l_partkey"), c("p_brand").alias("isin"))
    rows = D.read(spark, sf, "lineitem").select("l_partkey", F.year("l_shipdate").alias("fy"), "l_extendedprice", "l_discount", "l_tax", "l_quantity").join(p, "l_partkey")
    price = c("l_extendedprice")
    fy = rows.groupBy("isin", "fy").agg(
        (F.sum(price * (1 - c("l_discount"))) / 1e5).alias("revenue"), (F.sum(price * (0.35 - c("l_tax") - c("l_discount"))) / 1e5).alias("pat"), (F.sum(price * (0.3 - c("l_tax"))) / 1e5).alias("cfo"), (F.sum("l_quantity") / 1e2).alias("assets"), (F.sum(price * c("l_discount")) / 1e5).alias("debt")
    )
    equity = F.nullif(c("assets") - c("debt"), F.lit(0.0))
    return fy.select("*", (100 * c("pat") / equity).alias("roe"), F.when((c("revenue") > 0) & (c("fy") % 4 != 0), 100 * c("pat") / c("revenue")).alias("margin"), (c("debt") / equity).alias("leverage"))


def _facts(years):
    c, last = F.col, lambda x: F.max_by(x, "fy")
    return years.groupBy("isin").agg(
        last(c("pat")).alias("eps"), last(c("assets") - c("debt")).alias("bvps"), last(c("revenue")).alias("sps"), last(c("cfo")).alias("cfps"), F.when(F.length("isin") % 2 == 0, last(c("pat")) * 0.3).alias("dps"), last(c("pat") + c("cfo")).alias("ebitda"), last(c("debt")).alias("net_debt"), (F.count(F.lit(1)) % 10).alias("piotroski")
    )


def _value(spark, sf):
    price = D.bars(spark, sf, "p_brand").groupBy("isin").agg(F.max_by("close", "d").alias("price"))
    return X.value_metrics(price, _facts(_years(spark, sf)))


def _quality(spark, sf):
    years = _years(spark, sf)
    return X.quality_metrics(years, _facts(years).select("isin", "piotroski"))


def _r(df):
    return df.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sel(cols):
    return "isin, " + ", ".join(f"round({c}, 5) AS {c}" for c in cols)


@register("x01_momentum", f"WITH {MOM} SELECT {_sel(_M)} FROM mom")
def x01(spark, sf):
    return _r(X.momentum(D.bars(spark, sf, "p_brand")))


@register("x02_low_volatility", f"WITH {B}, {LOW} SELECT {_sel(_L)} FROM low")
def x02(spark, sf):
    return _r(X.low_volatility(D.bars(spark, sf, "p_brand"), D.benchmark_nav(spark, sf)))


@register("x04_rank_component", f"WITH {MOM}, z AS (SELECT isin, greatest(-3, least(3, (ret_12_1 - avg(ret_12_1) OVER ()) / stddev_samp(ret_12_1) OVER ())) AS z FROM mom) SELECT isin, 'ret_12_1' AS component, round(z, 5) AS z, round(100 * percent_rank() OVER (ORDER BY z), 5) AS rank FROM z")
def x04(spark, sf):
    return _r(X.rank_components(X.long_form(X.momentum(D.bars(spark, sf, "p_brand")).select("isin", "ret_12_1"))))


@register("x03_value", f"WITH {B}, {VALUE} SELECT {_sel(_V)} FROM val")
def x03_value(spark, sf):
    return _r(_value(spark, sf))


@register("x03_quality", f"WITH {FACTS}, {QUALITY} SELECT {_sel(_Q)} FROM qu")
def x03_quality(spark, sf):
    return _r(_quality(spark, sf))


def _loose_ranks(t, cols, out):
    """Mean of the ranks that are there, of three components at least; a component with fewer than 5 values has none."""
    z = ", ".join(f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER () >= 5 THEN greatest(-3, least(3, ({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_samp({c}) OVER (), 0), 1))) END AS {c}" for c in cols)
    parts = " UNION ALL ".join(f"SELECT isin, 100 * percent_rank() OVER (ORDER BY {c}) AS r FROM {out}z WHERE {c} IS NOT NULL" for c in cols)
    return f"{out}z AS (SELECT isin, {z} FROM {t}), {out} AS (SELECT isin, avg(r) AS score FROM ({parts}) GROUP BY 1 HAVING count(*) >= 3)"


ALL_SCORES = f"""{SCORES}, {VALUE}, {QUALITY}, {_loose_ranks('val', _V, 'rv')}, {_loose_ranks('qu', _Q, 'rq')}, every AS (SELECT isin, momentum, lowvol, rv.score AS value, rq.score AS quality FROM scores FULL JOIN rv USING (isin) FULL JOIN rq USING (isin)),
final AS (SELECT *, CASE WHEN len(list_filter([momentum, lowvol, value, quality], lambda x: x IS NOT NULL)) >= 2 THEN list_avg([momentum, lowvol, value, quality]) END AS multi FROM every)"""
_ALL = ("momentum", "lowvol", "value", "quality", "multi")


def _all_scores(spark, sf):
    return X.factor_scores(D.bars(spark, sf, "p_brand"), D.benchmark_nav(spark, sf), {"value": _value(spark, sf), "quality": _quality(spark, sf)})


@register("x05_x06_x07_factor_scores", f"WITH {ALL_SCORES} SELECT {_sel(_ALL)} FROM final")
def x06(spark, sf):
    return _r(_all_scores(spark, sf))


_SEC = "CASE WHEN length(isin) % 2 = 0 THEN 'even' ELSE 'odd' END"
_WZ = "greatest(-3, least(3, ({0} - avg({0}) OVER s) / coalesce(nullif(stddev_samp({0}) OVER s, 0), 1)))"


@register("x06_sector_relative", f"""WITH {ALL_SCORES}, a AS (SELECT isin, {_SEC} AS sector, f, v FROM (SELECT isin, 'momentum' AS f, round(momentum, 6) AS v FROM final UNION ALL SELECT isin, 'lowvol', round(lowvol, 6) FROM final) WHERE v IS NOT NULL), z AS (SELECT *, {_WZ.format('v')} AS z, count(*) OVER s AS n FROM a WINDOW s AS (PARTITION BY sector, f)),
r AS (SELECT isin, sector, f, 100 * percent_rank() OVER (PARTITION BY sector, f ORDER BY z) AS r FROM z WHERE n >= 5) SELECT isin, sector, round(max(r) FILTER (f = 'momentum'), 5) AS momentum, round(max(r) FILTER (f = 'lowvol'), 5) AS lowvol FROM r GROUP BY ALL""")
def x06_sector(spark, sf):
    scores = _all_scores(spark, sf)
    return _r(X.sector_relative(scores, scores.select("isin", F.when(F.length("isin") % 2 == 0, "even").otherwise("odd").alias("sector"))))


@register("q14_screen", f"WITH {ALL_SCORES} SELECT {_sel(_ALL)} FROM final WHERE multi IS NOT NULL ORDER BY final.multi DESC, isin LIMIT 10")
def q14(spark, sf):
    return _r(X.screen(_all_scores(spark, sf), "multi", 10))
