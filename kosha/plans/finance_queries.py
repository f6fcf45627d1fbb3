"""Queries of cash flows (F), fixed income (K) and statements (U) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.operators import fixed_income as K
from kosha.operators import flows as L
from kosha.operators import statements as U
from kosha.sources import adapters as D

from . import sql
from .registry import register

T, BO, ST = sql.TRANSACTIONS, sql.BONDS, sql.STATEMENTS
KIND = "CASE WHEN tx_type IN ('Purchase', 'SIP') THEN 'in' WHEN tx_type = 'Redemption' THEN 'out' WHEN tx_type = 'Switch In' THEN 'neutral' WHEN tx_type = 'Dividend Payout' THEN 'income' ELSE 'other' END"


def _r(df, n=4):
    return df.select(*[(F.round(c, n) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("n23_f01_cas_transactions", f"WITH {T}, k AS (SELECT *, {KIND} AS kind FROM tx) SELECT portfolio_id, tx_id, d, kind, CASE kind WHEN 'in' THEN amount WHEN 'out' THEN -amount ELSE 0 END AS flow FROM k WHERE amount > 0")
def f01(spark, sf):
    t = D.transactions(spark, sf).where("amount > 0").withColumn("kind", L.flow_kind(F.col("tx_type")))
    return t.select("portfolio_id", "tx_id", "d", "kind", L.signed(F.col("kind"), F.col("amount")).alias("flow"))


def _scheme_tx(spark, sf):
    t = D.transactions(spark, sf).withColumn("kind", L.flow_kind(F.col("tx_type")))
    f = L.signed(F.col("kind"), F.col("amount"))
    return t.select("portfolio_id", F.pmod("tx_id", F.lit(7)).alias("scheme_id"), "d", f.alias("amount"), (f / 100).alias("units")).where("amount <> 0")


_STX = f"{T}, k AS (SELECT *, {KIND} AS kind FROM tx), st AS (SELECT portfolio_id, tx_id % 7 AS scheme_id, d, CASE kind WHEN 'in' THEN amount WHEN 'out' THEN -amount ELSE 0 END AS amount FROM k), stx AS (SELECT *, amount / 100 AS units FROM st WHERE amount <> 0)"


@register("f02_opening_units", f"WITH {_STX}, m AS (SELECT portfolio_id, scheme_id, sum(units) AS moved, count(*) * 1000.0 AS end_units FROM stx GROUP BY ALL) SELECT portfolio_id, scheme_id, round(greatest(0, end_units - moved), 4) AS opening FROM m")
def f02(spark, sf):
    t = _scheme_tx(spark, sf)
    ends = t.groupBy("portfolio_id", "scheme_id").agg((F.count(F.lit(1)) * 1000.0).alias("end_units"))
    return _r(L.opening_units(ends, t, ["portfolio_id", "scheme_id"]).select("portfolio_id", "scheme_id", "opening"))


_PATH = f"""{sql.NAV}, {_STX}, ln AS (SELECT DISTINCT portfolio_id, scheme_id FROM stx), fi AS (SELECT portfolio_id, min(d) AS f FROM stx GROUP BY 1),
dy AS (SELECT DISTINCT portfolio_id, d FROM (SELECT portfolio_id, nav.d FROM ln JOIN nav USING (scheme_id) UNION ALL SELECT portfolio_id, d FROM stx) JOIN fi USING (portfolio_id) WHERE d >= f),
gr AS (SELECT ln.portfolio_id, ln.scheme_id, d FROM ln JOIN dy USING (portfolio_id)), mo AS (SELECT portfolio_id, scheme_id, d, sum(units) AS u, sum(amount) AS fl FROM stx GROUP BY ALL),
hv AS (SELECT gr.*, coalesce(sum(u) OVER (PARTITION BY portfolio_id, scheme_id ORDER BY d), 0) AS held, coalesce(fl, 0) AS fl FROM gr LEFT JOIN mo USING (portfolio_id, scheme_id, d)),
pv AS (SELECT hv.*, nav.nav FROM hv ASOF LEFT JOIN nav ON nav.scheme_id = hv.scheme_id AND nav.d <= hv.d), path AS (SELECT portfolio_id, d, sum(held * nav) AS value, sum(fl) AS flow FROM pv GROUP BY ALL)"""


@register("f04_f05_value_path", f"WITH {_PATH} SELECT portfolio_id, d, round(value, 2) AS value, round(flow, 2) AS flow FROM path")
def f05(spark, sf):
    path = L.value_path(_scheme_tx(spark, sf), D.nav(spark, sf), "portfolio_id", "scheme_id")
    cents = lambda c: (F.signum(c) * F.floor(F.abs(c) * 100 + 0.5) / 100 + 0.0).alias(c)  # noqa: E731  as SQL rounds; F.round makes a decimal of each number
    return path.select("portfolio_id", "d", cents("value"), cents("flow"))


@register("f07_f09_twr", f"""WITH {_PATH}, rr AS (SELECT *, lag(value) OVER (PARTITION BY portfolio_id ORDER BY d) AS p FROM path), r2 AS (SELECT *, (value - flow - p) / p AS r FROM rr WHERE p > 0), r3 AS (SELECT *, abs(r) > 0.2 AS art FROM r2 WHERE NOT (abs(r) < 1e-6 AND flow = 0)),
ch AS (SELECT *, exp(sum(CASE WHEN art THEN 0 ELSE ln(1 + r) END) OVER (PARTITION BY portfolio_id ORDER BY d)) AS x FROM (SELECT * REPLACE (CASE WHEN art THEN 0 ELSE r END AS r) FROM r3)), dd AS (SELECT *, x / greatest(1, max(x) OVER (PARTITION BY portfolio_id ORDER BY d)) - 1 AS dd FROM ch),
sp AS (SELECT portfolio_id, date_diff('day', min(d), max(d)) AS span FROM path GROUP BY 1), g AS (SELECT portfolio_id, arg_max(x, d) AS x, count_if(art) AS artifacts, min(dd) AS dd FROM dd GROUP BY 1)
SELECT portfolio_id, round(x - 1, 4) AS twr, artifacts, CAST(span AS INTEGER) AS span, CASE WHEN span >= 90 THEN round(power(x, 365.25 / span) - 1, 4) END AS annualised, CASE WHEN artifacts = 0 THEN round(dd, 4) END AS max_drawdown FROM g JOIN sp USING (portfolio_id)""")
def f07(spark, sf):
    return _r(L.chained(L.path_summary(_scheme_tx(spark, sf), D.nav(spark, sf), "portfolio_id", "scheme_id"), "portfolio_id"))


_FL = "fl AS (SELECT o_custkey AS portfolio_id, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 3 = 0 THEN 1.1 ELSE -1.0 END * o_totalprice AS amount FROM orders)"


@register("f10_xirr", f"""WITH RECURSIVE {_FL}, z AS (SELECT portfolio_id, date_diff('day', min(d) OVER (PARTITION BY portfolio_id), d) / 365.25 AS t, amount AS a FROM fl),
e AS (SELECT portfolio_id, sum(a / power(0.01, t)) AS lo, sum(a / power(11, t)) AS hi FROM z GROUP BY 1),
b(portfolio_id, i, lo, hi, s) AS (SELECT portfolio_id, 0, -0.99::DOUBLE, 10::DOUBLE, sign(lo) FROM e WHERE lo * hi < 0 UNION ALL
SELECT portfolio_id, i + 1, CASE WHEN sg = s THEN (lo + hi) / 2 ELSE lo END, CASE WHEN sg = s THEN hi ELSE (lo + hi) / 2 END, s FROM (SELECT b.portfolio_id, i, lo, hi, s, sign(sum(a / power(1 + (lo + hi) / 2, t))) AS sg FROM b JOIN z USING (portfolio_id) WHERE i < 60 GROUP BY ALL))
SELECT e.portfolio_id, round((b.lo + b.hi) / 2, 4) + 0.0 AS xirr FROM e LEFT JOIN b ON b.portfolio_id = e.portfolio_id AND i = 60""")
def f10(spark, sf):
    fl = D.read(spark, sf, "orders").select(F.col("o_custkey").alias("portfolio_id"), F.col("o_orderdate").cast("date").alias("d"), (F.when(F.col("o_orderkey") % 3 == 0, 1.1).otherwise(-1.0) * F.col("o_totalprice")).alias("amount"))
    return _r(L.xirr(fl, "portfolio_id", 60))


_SCH = f"""{BO}, b1 AS (SELECT *, date_diff('day', settle, maturity) / 365.25 AS years FROM bonds), b2 AS (SELECT *, years * freq - floor(years * freq) AS part FROM b1),
b3 AS (SELECT *, CASE WHEN part < 1e-9 THEN 1.0 ELSE part END AS first, greatest(1, CAST(CASE WHEN part < 1e-9 THEN round(years * freq) ELSE floor(years * freq) + 1 END AS INTEGER)) AS n FROM b2), sch AS (SELECT *, coupon / freq * (1 - first) AS accrued FROM b3)"""


def _pv(y):
    return f"(list_sum(list_transform(range(0, n), lambda k: coupon / freq / power(1 + {y} / freq, first + k))) + 100 / power(1 + {y} / freq, first + n - 1))"


_YTM = f"""{_SCH}, yb(isin, i, lo, hi) AS (SELECT isin, 0, 1e-6::DOUBLE, 6.0::DOUBLE FROM sch WHERE coupon > 0 AND {_pv('1e-6')} >= price + accrued UNION ALL
SELECT isin, i + 1, CASE WHEN {_pv('((lo + hi) / 2)')} > price + accrued THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_pv('((lo + hi) / 2)')} > price + accrued THEN hi ELSE (lo + hi) / 2 END FROM yb JOIN sch USING (isin) WHERE i < 60),
yt AS (SELECT sch.*, CASE WHEN coupon = 0 THEN power(100 / price, 1 / years) - 1 ELSE (lo + hi) / 2 END AS ytm FROM sch LEFT JOIN yb ON yb.isin = sch.isin AND i = 60)"""


@register("k01_present_value", f"WITH {_SCH} SELECT isin, n, round(first, 6) AS first, round(accrued, 6) + 0.0 AS accrued, round({_pv('0.07')}, 6) AS price7 FROM sch")
def k01(spark, sf):
    b = K.schedule(D.bonds(spark, sf))
    return _r(b.select("isin", "n", "first", "accrued", K.price_at(F.lit(0.07), F.col("coupon"), F.col("n"), F.col("first"), F.col("freq")).alias("price7")), 6)


@register("k03_ytm", f"WITH RECURSIVE {_YTM} SELECT isin, round(ytm, 6) AS ytm FROM yt")
def k03(spark, sf):
    return _r(K.with_ytm(D.bonds(spark, sf)).select("isin", "ytm"), 6)


_MAC = "CASE WHEN coupon = 0 THEN CASE WHEN ytm IS NOT NULL THEN years END ELSE (list_sum(list_transform(range(0, n), lambda k: (first + k) * coupon / freq / power(1 + ytm / freq, first + k))) + (first + n - 1) * 100 / power(1 + ytm / freq, first + n - 1)) / " + _pv("ytm") + " / freq END"


@register("k02_k08_duration", f"WITH RECURSIVE {_YTM}, m AS (SELECT *, {_MAC} AS mac FROM yt WHERE ytm IS NOT NULL) SELECT isin, round(mac, 5) AS macaulay, round(CASE WHEN coupon = 0 THEN mac / (1 + ytm) ELSE mac / (1 + ytm / freq) END, 5) AS modified FROM m")
def k02(spark, sf):
    return _r(K.with_duration(K.with_ytm(D.bonds(spark, sf)).where("ytm is not null")).select("isin", "macaulay", "modified"), 5)


# The bonds with what a catalogue has of trades; frequencies as texts.
_TRADED = BO.replace("bonds AS (SELECT", "raw AS (SELECT") + """, bonds AS (SELECT isin, name, coupon, CASE WHEN isin % 5 = 0 THEN price - 1 ELSE price END AS price, maturity, CASE WHEN isin % 3 = 0 THEN DATE '2001-12-01' WHEN isin % 3 = 1 THEN DATE '2001-11-15' ELSE DATE '2002-01-01' END AS settle,
  CASE isin % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN CASE WHEN segment = 'PROMO' THEN 1 ELSE 2 END ELSE 1 END AS freq, segment FROM raw)"""


@register("k06_ytm_from_price", f"WITH RECURSIVE {_YTM.replace(BO, _TRADED)} SELECT isin, round(100 * ytm, 4) AS ytm_pct, CASE WHEN ytm IS NOT NULL THEN CASE WHEN coupon = 0 THEN 'computed: money-market zero-coupon' ELSE 'computed: computed from coupon+price+maturity' END END AS ytm_source FROM yt")
def k06(spark, sf):
    c, k = F.col, F.col("isin")
    b = D.bonds(spark, sf).drop("freq", "settle").withColumns({
        "last_price": c("price") - 1, "price": F.when(k % 5 != 0, c("price")).otherwise(0.0), "segment": F.when(c("segment") == "PROMO", "T-Bill").otherwise(c("segment")),
        "coupon_freq": F.when(k % 4 == 0, "Half yearly").when(k % 4 == 1, "quarterly").when(k % 4 == 3, "Annual"), "last_trade_date": F.when(k % 3 == 0, F.lit("2001-12-01").cast("date")), "trade_date": F.when(k % 3 == 1, F.lit("2001-11-15").cast("date")),
    })
    return K.ytm_from_price(b, "2002-01-01").select("isin", "ytm_pct", "ytm_source")


@register("k04_current_yield", f"WITH {BO} SELECT isin, round(100 * coupon / price, 6) AS cy FROM bonds")
def k04(spark, sf):
    return _r(D.bonds(spark, sf).select("isin", K.current_yield(F.col("coupon"), F.col("price")).alias("cy")), 6)


@register("k05_resolve_yield", f"WITH RECURSIVE {_YTM} SELECT isin, CASE WHEN isin % 4 = 0 THEN 'last_trade' WHEN isin % 4 = 1 THEN 'weighted' WHEN ytm IS NOT NULL THEN 'computed' WHEN coupon > 0 THEN 'current_yield' ELSE 'n/a' END AS source, round(CASE WHEN isin % 4 = 0 THEN 7.5 WHEN isin % 4 = 1 THEN 7.25 WHEN ytm IS NOT NULL THEN 100 * ytm WHEN coupon > 0 THEN 100 * coupon / price END, 4) AS yield FROM yt")
def k05(spark, sf):
    b = K.with_ytm(D.bonds(spark, sf)).withColumn("trade_yield", F.when(F.col("isin") % 4 == 0, 7.5)).withColumn("weighted_yield", F.when(F.col("isin") % 4 == 1, 7.25))
    return _r(K.resolve_yield(b).select("isin", "source", "yield"))


@register("k07_months_to_maturity", f"WITH {BO} SELECT isin, CAST(date_diff('day', settle, maturity) AS INTEGER) AS days, round(date_diff('day', settle, maturity) / 365.25, 4) AS years FROM bonds")
def k07(spark, sf):
    days = F.datediff("maturity", "settle")
    return _r(D.bonds(spark, sf).select("isin", days.alias("days"), (days / 365.25).alias("years")))


_I = "round(revenue, 2) AS revenue, round(expenses, 2) AS expenses, round(tax, 2) AS tax, round(pat, 2) AS pat"
_CUM = f"{ST}, cu AS (SELECT isin, fy, q, \"end\", sum(revenue) OVER w AS revenue, sum(expenses) OVER w AS expenses, sum(tax) OVER w AS tax, sum(pat) OVER w AS pat, count(*) OVER w = q AS whole FROM statements WINDOW w AS (PARTITION BY isin, fy ORDER BY q))"


@register("u01_cumulative_records", f"WITH {_CUM} SELECT isin, fy, q, \"end\", ['Q1', 'H1', '9M', 'FY'][q] AS kind, {_I} FROM cu WHERE whole")
def u01(spark, sf):
    return _r(U.cumulate(D.statements(spark, sf)), 2)


@register("u02_quarter_derivation", f"WITH {_CUM} SELECT s.isin, s.fy, s.q, s.\"end\", s.q > 1 AS derived, round(s.revenue, 2) AS revenue, round(s.expenses, 2) AS expenses, round(s.tax, 2) AS tax, round(s.pat, 2) AS pat FROM statements s JOIN cu USING (isin, fy, q) WHERE whole")
def u02(spark, sf):
    return _r(U.derive_quarters(U.cumulate(D.statements(spark, sf))), 2)


@register("u03_ttm", f"WITH {ST}, k AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY \"end\" DESC) AS k FROM statements), g AS (SELECT isin, max(\"end\") AS \"end\", sum(revenue) AS revenue, sum(expenses) AS expenses, sum(tax) AS tax, sum(pat) AS pat FROM k WHERE k <= 4 GROUP BY 1 HAVING count(*) = 4 AND max(fy * 4 + q) - min(fy * 4 + q) = 3) SELECT isin, \"end\", {_I} FROM g")
def u03(spark, sf):
    return _r(U.ttm(D.statements(spark, sf)), 2)


_YR = f"{ST}, an AS (SELECT isin, fy, sum(revenue) AS revenue, sum(expenses) AS expenses, sum(tax) AS tax, sum(pat) AS pat FROM statements GROUP BY ALL HAVING count(*) = 4), eq AS (SELECT *, sum(pat) OVER (PARTITION BY isin ORDER BY fy) AS equity, 0.2 * revenue AS debt, pat + 0.5 * tax AS cfo FROM an), yr AS (SELECT *, equity + 0.5 * revenue AS assets FROM eq)"


def _years(spark, sf):
    return U.with_balance(U.annual(D.statements(spark, sf)))


def _avg(c):
    return f"nullif(greatest(({c} + coalesce(lag({c}) OVER w, {c})) / 2, 0), 0)"


@register("u08_u09_u10_ratios", f"""WITH {_YR} SELECT isin, fy, round(100 * pat / nullif(greatest(revenue, 0), 0), 4) + 0.0 AS net_margin, round(100 * (revenue - expenses) / nullif(greatest(revenue, 0), 0), 4) + 0.0 AS operating_margin, round(100 * pat / {_avg('equity')}, 4) + 0.0 AS roe, round(100 * pat / {_avg('assets')}, 4) + 0.0 AS roa,
round(debt / nullif(greatest(equity, 0), 0), 4) + 0.0 AS debt_to_equity, round(cfo / nullif(greatest(pat, 0), 0), 4) + 0.0 AS cfo_to_pat, round(revenue / {_avg('assets')}, 4) + 0.0 AS asset_turnover, round(assets / nullif(greatest(equity, 0), 0), 4) + 0.0 AS multiplier FROM yr WINDOW w AS (PARTITION BY isin ORDER BY fy)""")
def u08(spark, sf):
    return _r(U.ratios(_years(spark, sf)))


@register("u11_growth", f"WITH {_YR}, l AS (SELECT *, CASE WHEN lag(fy) OVER w = fy - 1 THEN lag(pat) OVER w END AS p, CASE WHEN lag(fy, 3) OVER w = fy - 3 THEN lag(pat, 3) OVER w END AS p3 FROM yr WINDOW w AS (PARTITION BY isin ORDER BY fy)) SELECT isin, fy, round(100 * (pat - p) / nullif(abs(p), 0), 4) + 0.0 AS yoy, CASE WHEN p3 > 0 AND pat > 0 THEN round(100 * (power(pat / p3, 1 / 3) - 1), 4) + 0.0 END AS cagr3 FROM l")
def u11(spark, sf):
    return _r(U.growth(_years(spark, sf), "pat"))


@register("u19_multi_year", f"WITH {_YR}, g AS (SELECT isin, count(*) AS n, avg(revenue) AS m, stddev_samp(revenue) AS sd, regr_slope(revenue, fy) AS s FROM yr GROUP BY 1) SELECT isin, n, round(m, 2) + 0.0 AS mean, round(sd, 2) + 0.0 AS sd, round(sd / abs(m), 2) + 0.0 AS cv, CASE WHEN s > 0 THEN 'up' WHEN s < 0 THEN 'down' ELSE 'flat' END AS trend FROM g")
def u19(spark, sf):
    return _r(U.multi_year(_years(spark, sf), "revenue"), 2)


@register("u13_piotroski", f"""WITH {_YR}, y AS (SELECT *, pat / assets AS roa, debt / assets AS lev, revenue / assets AS turn, (revenue - expenses) / revenue AS margin FROM yr WHERE assets > 0 AND revenue > 0), t AS (SELECT isin, fy, [pat > 0, cfo > 0, roa > lag(roa) OVER w, cfo > pat, lev < lag(lev) OVER w, margin > lag(margin) OVER w, turn > lag(turn) OVER w] AS x FROM y WINDOW w AS (PARTITION BY isin ORDER BY fy))
SELECT isin, fy, CAST(len(list_filter(x, lambda v: v)) AS INTEGER) AS score, CAST(len(list_filter(x, lambda v: v IS NOT NULL)) AS INTEGER) AS evaluable FROM t""")
def u13(spark, sf):
    return U.piotroski(_years(spark, sf))


@register("u14_altman", f"WITH {_YR}, z AS (SELECT isin, fy, 1.2 * (equity - debt) / nullif(greatest(assets, 0), 0) + 1.4 * equity / nullif(greatest(assets, 0), 0) + 3.3 * (revenue - expenses) / nullif(greatest(assets, 0), 0) + 0.6 * equity / nullif(greatest(debt, 0), 0) + revenue / nullif(greatest(assets, 0), 0) AS z FROM yr) SELECT isin, fy, round(z, 4) + 0.0 AS z, CASE WHEN z > 2.99 THEN 'safe' WHEN z >= 1.81 THEN 'grey' WHEN z < 1.81 THEN 'distress' END AS zone FROM z")
def u14(spark, sf):
    return _r(U.altman(_years(spark, sf)))


# Schemes 5 and 6 count as schemes without a NAV here.
def _some_nav(spark, sf):
    return D.nav(spark, sf).where("scheme_id NOT IN (5, 6)")


@register("f03_unvalued_schemes", f"WITH {_STX} SELECT scheme_id, round(sum(amount), 2) AS excluded_cash, count(*) AS n FROM stx WHERE scheme_id IN (5, 6) GROUP BY 1")
def f03(spark, sf):
    return _r(L.valued_only(_scheme_tx(spark, sf), _some_nav(spark, sf), "scheme_id")[1], 2)


@register("f06_holding_period", f"""WITH {_PATH}, e AS (SELECT portfolio_id, min(d) AS low, max(d) AS last FROM path WHERE abs(value) >= 1 GROUP BY 1), m AS (SELECT portfolio_id, max(d) AS moved FROM stx GROUP BY 1),
i AS (SELECT path.*, count(*) OVER (PARTITION BY portfolio_id) AS n FROM path JOIN e USING (portfolio_id) JOIN m USING (portfolio_id) WHERE d BETWEEN low AND greatest(last, moved)) SELECT portfolio_id, count(*) AS days, min(d) AS first, max(d) AS last, round(sum(flow), 2) AS flow FROM i WHERE n > 1 GROUP BY 1""")
def f06(spark, sf):
    tx = _scheme_tx(spark, sf)
    return _r(L.path_summary(tx, D.nav(spark, sf), "portfolio_id", "scheme_id", bounded=True).select("portfolio_id", "days", "first", "last", "flow"), 2)


@register("a18_a19_market_weights", f"""WITH {sql.NAV}, {_STX}, su AS (SELECT portfolio_id, scheme_id, sum(units) AS u FROM stx GROUP BY ALL), it AS (SELECT portfolio_id, scheme_id, CASE WHEN (portfolio_id + scheme_id) % 5 <> 0 THEN u END AS units, CAST(10 + scheme_id AS DOUBLE) AS weight FROM su), px AS (SELECT scheme_id, arg_max(nav, d) AS nav FROM nav WHERE scheme_id <> 6 GROUP BY 1),
r AS (SELECT it.*, CASE WHEN nav > 0 THEN units * nav END AS v FROM it LEFT JOIN px USING (scheme_id) WHERE units IS NULL OR units > 0), w AS (SELECT *, bool_or(units IS NOT NULL AND v IS NULL) OVER p AS stuck, sum(v) OVER p AS total FROM r WINDOW p AS (PARTITION BY portfolio_id))
SELECT portfolio_id, scheme_id, round(units, 4) AS units, CASE WHEN NOT stuck AND v IS NOT NULL AND total > 0 THEN round(100 * v / total, 4) ELSE weight END AS weight, CASE WHEN NOT stuck AND v IS NOT NULL AND total > 0 THEN round(v, 2) END AS current_value, CASE WHEN stuck THEN 'cost' WHEN units IS NULL THEN 'manual' ELSE 'market' END AS pricing_basis FROM w""")
def a19(spark, sf):
    c = F.col
    items = _scheme_tx(spark, sf).groupBy("portfolio_id", "scheme_id").agg(F.sum("units").alias("u"))
    items = items.select("portfolio_id", "scheme_id", F.when((c("portfolio_id") + c("scheme_id")) % 5 != 0, c("u")).alias("units"), (c("scheme_id") + 10).cast("double").alias("weight"))
    prices = L.latest_nav(D.nav(spark, sf).where("scheme_id <> 6").withColumn("source", F.lit(1)), "scheme_id")
    return L.reweight(items, prices, "portfolio_id", "scheme_id").withColumn("units", F.round("units", 4))


# Of three portfolios one has a statement from the beginning; schemes 5 and 6 have no NAV.
_MOVEMENT = f"""{sql.NAV}, {_STX}, vn AS (SELECT * FROM nav WHERE scheme_id NOT IN (5, 6)), va AS (SELECT * FROM stx WHERE scheme_id IN (SELECT scheme_id FROM vn)),
op AS (SELECT portfolio_id, scheme_id, greatest(0, CASE WHEN portfolio_id % 3 = 0 THEN sum(units) ELSE count(*) * 1000.0 END - sum(units)) AS opening FROM va GROUP BY portfolio_id, scheme_id),
g0 AS (SELECT portfolio_id, min(d) AS first_tx, sum(amount) AS net_flow, coalesce(sum(amount) FILTER (amount > 0), 0) AS cash_in, coalesce(sum(amount) FILTER (amount < 0), 0) AS cash_out FROM va GROUP BY 1), g1 AS (SELECT portfolio_id, sum(opening) AS opening_units FROM op GROUP BY 1),
g2 AS (SELECT portfolio_id, min(vn.d) AS first_nav FROM (SELECT DISTINCT portfolio_id, scheme_id FROM va) JOIN vn USING (scheme_id) GROUP BY 1), g AS (SELECT *, opening_units >= 1 AS partial, CASE WHEN opening_units >= 1 THEN least(first_tx, first_nav) ELSE first_tx END AS from_day FROM g0 JOIN g1 USING (portfolio_id) JOIN g2 USING (portfolio_id)),
tx2 AS (SELECT portfolio_id, scheme_id, d, units, amount FROM va UNION ALL SELECT portfolio_id, scheme_id, from_day, opening, 0 FROM op JOIN g USING (portfolio_id) WHERE opening > 0)"""


@register("f11_portfolio_movement", f"""WITH RECURSIVE {_MOVEMENT}, ln AS (SELECT DISTINCT portfolio_id, scheme_id FROM tx2), fi AS (SELECT portfolio_id, min(d) AS f FROM tx2 GROUP BY 1),
dy AS (SELECT DISTINCT portfolio_id, d FROM (SELECT portfolio_id, vn.d FROM ln JOIN vn USING (scheme_id) UNION ALL SELECT portfolio_id, d FROM tx2) JOIN fi USING (portfolio_id) WHERE d >= f),
gr AS (SELECT ln.portfolio_id, ln.scheme_id, d FROM ln JOIN dy USING (portfolio_id)), mo AS (SELECT portfolio_id, scheme_id, d, sum(units) AS u, sum(amount) AS fl FROM tx2 GROUP BY ALL),
hv AS (SELECT gr.*, coalesce(sum(u) OVER (PARTITION BY portfolio_id, scheme_id ORDER BY d), 0) AS held, coalesce(fl, 0) AS fl FROM gr LEFT JOIN mo USING (portfolio_id, scheme_id, d)),
pv AS (SELECT hv.*, vn.nav FROM hv ASOF LEFT JOIN vn ON vn.scheme_id = hv.scheme_id AND vn.d <= hv.d), whole AS (SELECT portfolio_id, d, sum(held * nav) AS value, sum(fl) AS flow FROM pv GROUP BY ALL HAVING sum(held * nav) IS NOT NULL),
bd AS (SELECT portfolio_id, min(whole.d) AS low, greatest(max(whole.d), max(moved)) AS high FROM whole JOIN (SELECT portfolio_id, max(d) AS moved FROM va GROUP BY 1) mv USING (portfolio_id) WHERE abs(value) >= 1 GROUP BY portfolio_id),
path AS (SELECT whole.* FROM whole JOIN bd USING (portfolio_id) WHERE d BETWEEN low AND high QUALIFY count(*) OVER (PARTITION BY portfolio_id) > 1),
rr AS (SELECT *, lag(value) OVER (PARTITION BY portfolio_id ORDER BY d) AS p FROM path), r2 AS (SELECT *, (value - flow - p) / p AS r FROM rr WHERE p > 0), r3 AS (SELECT *, abs(r) > 0.2 AS art FROM r2 WHERE NOT (abs(r) < 1e-6 AND flow = 0)),
ch AS (SELECT *, exp(sum(CASE WHEN art THEN 0 ELSE ln(1 + CASE WHEN art THEN 0 ELSE r END) END) OVER (PARTITION BY portfolio_id ORDER BY d)) AS x FROM r3), dd AS (SELECT *, x / greatest(1, max(x) OVER (PARTITION BY portfolio_id ORDER BY d)) - 1 AS dd FROM ch),
tw AS (SELECT portfolio_id, arg_max(x, d) AS x, count_if(art) AS artifacts, min(dd) AS dd FROM dd GROUP BY 1), sp AS (SELECT portfolio_id, min(d) AS start, max(d) AS "end", arg_max(value, d) AS terminal_value, date_diff('day', min(d), max(d)) AS days FROM path GROUP BY 1),
ov AS (SELECT portfolio_id, sum(opening * nav) AS opening_value FROM (SELECT op.portfolio_id, op.opening, op.scheme_id, start FROM op JOIN sp USING (portfolio_id) WHERE opening > 0) q ASOF JOIN vn ON vn.scheme_id = q.scheme_id AND vn.d <= q.start GROUP BY 1),
cf AS (SELECT portfolio_id, start AS d, -coalesce(opening_value, 0) AS amount FROM sp LEFT JOIN ov USING (portfolio_id) UNION ALL SELECT portfolio_id, d, -amount FROM va WHERE portfolio_id IN (SELECT portfolio_id FROM sp) UNION ALL SELECT portfolio_id, "end", terminal_value FROM sp),
z AS (SELECT portfolio_id, date_diff('day', min(d) OVER (PARTITION BY portfolio_id), d) / 365.25 AS t, amount AS a FROM cf), e AS (SELECT portfolio_id, sum(a / power(0.01, t)) AS lo, sum(a / power(11, t)) AS hi FROM z GROUP BY 1),
b(portfolio_id, i, lo, hi, s) AS (SELECT portfolio_id, 0, -0.99::DOUBLE, 10::DOUBLE, sign(lo) FROM e WHERE lo * hi < 0 UNION ALL
SELECT portfolio_id, i + 1, CASE WHEN sg = s THEN (lo + hi) / 2 ELSE lo END, CASE WHEN sg = s THEN hi ELSE (lo + hi) / 2 END, s FROM (SELECT b.portfolio_id, i, lo, hi, s, sign(sum(a / power(1 + (lo + hi) / 2, t))) AS sg FROM b JOIN z USING (portfolio_id) WHERE i < 60 GROUP BY ALL)),
un AS (SELECT portfolio_id, count(DISTINCT scheme_id) AS unvalued_schemes, count(*) AS unvalued_tx, sum(amount) AS unvalued_flow FROM stx WHERE scheme_id NOT IN (SELECT scheme_id FROM vn) GROUP BY 1)
SELECT g.portfolio_id, start, "end", CAST(days AS INTEGER) AS days, partial, round(opening_units, 2) AS opening_units, round(coalesce(opening_value, 0), 2) + 0.0 AS opening_value, round(terminal_value, 2) AS terminal_value, round(net_flow, 2) AS net_flow, round(cash_in, 2) AS cash_in, round(cash_out, 2) AS cash_out, round(x - 1, 4) + 0.0 AS twr,
  CASE WHEN days >= 90 THEN round(power(x, 365.25 / days) - 1, 4) + 0.0 END AS annualised, CASE WHEN days >= 90 THEN round((b.lo + b.hi) / 2, 4) + 0.0 END AS xirr, artifacts, CASE WHEN artifacts = 0 THEN round(dd, 4) + 0.0 END AS max_drawdown, coalesce(unvalued_schemes, 0) AS unvalued_schemes, coalesce(unvalued_tx, 0) AS unvalued_tx, round(coalesce(unvalued_flow, 0), 2) AS unvalued_flow
FROM g JOIN sp USING (portfolio_id) JOIN tw USING (portfolio_id) LEFT JOIN ov USING (portfolio_id) LEFT JOIN b ON b.portfolio_id = g.portfolio_id AND i = 60 LEFT JOIN un ON un.portfolio_id = g.portfolio_id""")
def f11(spark, sf):
    t = _scheme_tx(spark, sf)
    whole = F.col("portfolio_id") % 3 == 0
    ends = t.groupBy("portfolio_id", "scheme_id").agg(F.sum("units").alias("u"), F.count(F.lit(1)).alias("n")).select("portfolio_id", "scheme_id", F.when(whole, F.col("u")).otherwise(F.col("n") * 1000.0).alias("end_units"))
    m = L.movement(ends, t, _some_nav(spark, sf), "portfolio_id", "scheme_id")
    r = lambda c, n: (F.round(c, n) + 0.0).alias(c)
    money, rates = ("opening_units", "opening_value", "terminal_value", "net_flow", "cash_in", "cash_out", "unvalued_flow"), ("twr", "annualised", "xirr", "max_drawdown")
    return m.select("portfolio_id", "start", "end", "days", "partial", *[r(x, 2) for x in money], *[r(x, 4) for x in rates], "artifacts", "unvalued_schemes", "unvalued_tx")
