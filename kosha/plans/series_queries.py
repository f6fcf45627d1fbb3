"""Queries of the NAV series family (A) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.operators import series as S
from kosha.sources import adapters as D

from . import sql
from .registry import register

K = "scheme_id"


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("a01_clean_series", """SELECT l_suppkey AS scheme_id, CAST(l_shipdate AS DATE) AS d, arg_max(nav, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS nav
FROM (SELECT *, CASE WHEN l_orderkey % 17 <> 0 THEN l_extendedprice - 2000 END AS nav FROM lineitem) WHERE nav > 0 GROUP BY ALL""")
def a01(spark, sf):
    rows = D.read(spark, sf, "lineitem").withColumn("nav", F.when(F.pmod("l_orderkey", F.lit(17)) != 0, F.col("l_extendedprice") - 2000))
    rows = rows.withColumn("d", F.col("l_shipdate").cast("date")).withColumnRenamed("l_suppkey", K)
    return S.clean_series(rows, K, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])


@register("a02_daily_returns", f"WITH {sql.NAV} SELECT scheme_id, d, round(nav, 6) AS nav, round(nav / lag(nav) OVER (PARTITION BY scheme_id ORDER BY d) - 1, 6) AS ret FROM nav")
def a02(spark, sf):
    return _rounded(S.daily_returns(D.nav(spark, sf), K))


@register("a03_cagr_between", f"WITH {sql.NAV} SELECT scheme_id, round(power(arg_max(nav, d) / arg_min(nav, d), 365.25 / date_diff('day', min(d), max(d))) - 1, 6) AS cagr FROM nav GROUP BY 1 HAVING min(d) < max(d)")
def a03(spark, sf):
    n = D.nav(spark, sf).groupBy(K).agg(F.min_by("nav", "d").alias("s"), F.max_by("nav", "d").alias("e"), F.datediff(F.max("d"), F.min("d")).alias("days")).where("days > 0")
    return _rounded(n.select(K, S.cagr(F.col("s"), F.col("e"), F.col("days")).alias("cagr")))


@register("a04_window_cagr", f"""WITH {sql.NAV}, w AS (SELECT *, max(d) OVER (PARTITION BY scheme_id) AS last FROM nav),
g AS (SELECT scheme_id, min(d) AS start, max(d) AS "end", count(*) AS points, arg_min(nav, d) AS f, arg_max(nav, d) AS l FROM w WHERE d >= last - 1096 GROUP BY 1),
h AS (SELECT *, date_diff('day', start, "end") AS days FROM g)
SELECT scheme_id, start, "end", CAST(days AS INTEGER) AS days, points, days >= 1091 AS complete, CASE WHEN days >= 1091 THEN round(power(l / f, 365.25 / days) - 1, 6) END AS cagr FROM h""")
def a04(spark, sf):
    return _rounded(S.window_info(D.nav(spark, sf), K, 3))


_ROLL = f"""{sql.NAV}, rb AS (SELECT scheme_id, d, nav, first_value(nav) OVER w AS bn, first_value(d) OVER w AS bd FROM nav WINDOW w AS (PARTITION BY scheme_id ORDER BY d RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW)),
roll AS (SELECT scheme_id, d, nav / bn - 1 AS ret FROM rb WHERE date_diff('day', bd, d) >= 355)"""


@register("a05_rolling_returns", f"WITH {_ROLL} SELECT scheme_id, d, round(ret, 6) AS ret FROM roll")
def a05(spark, sf):
    return _rounded(S.rolling_returns(D.nav(spark, sf), K))


@register("a06_rolling_distribution", f"""WITH {_ROLL}, p AS (SELECT scheme_id, count(*) AS points FROM nav GROUP BY 1),
g AS (SELECT scheme_id, count(*) AS windows, round(100 * avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END), 1) AS up, max(ret) AS b, min(ret) AS w, list_sort(list(ret))[count(*) // 2 + 1] AS m FROM roll GROUP BY 1)
SELECT scheme_id, coalesce(windows, 0) AS windows, CASE WHEN points >= 30 AND windows >= 30 THEN up END AS positive_pct, CASE WHEN points >= 30 AND windows >= 30 THEN round(b, 6) END AS best,
CASE WHEN points >= 30 AND windows >= 30 THEN round(w, 6) END AS worst, CASE WHEN points >= 30 AND windows >= 30 THEN round(m, 6) END AS median FROM p LEFT JOIN g USING (scheme_id)""")
def a06(spark, sf):
    return _rounded(S.rolling_distribution(D.nav(spark, sf), K))


@register("a07_rolling_points", f"""WITH RECURSIVE {_ROLL}, o AS (SELECT scheme_id, d, ret, row_number() OVER (PARTITION BY scheme_id ORDER BY d) AS i FROM roll),
t(scheme_id, i, d, ret, last, keep) AS (SELECT scheme_id, i, d, ret, d, true FROM o WHERE i = 1 UNION ALL
SELECT o.scheme_id, o.i, o.d, o.ret, CASE WHEN date_diff('day', t.last, o.d) >= 7 THEN o.d ELSE t.last END, date_diff('day', t.last, o.d) >= 7 FROM t JOIN o ON o.scheme_id = t.scheme_id AND o.i = t.i + 1)
SELECT scheme_id, d, round(ret, 6) AS ret FROM t WHERE keep""")
def a07(spark, sf):
    return _rounded(S.greedy_stride(S.rolling_returns(D.nav(spark, sf), K), K))


@register("a08_max_drawdown", f"WITH {sql.NAV}, p AS (SELECT scheme_id, nav / max(nav) OVER (PARTITION BY scheme_id ORDER BY d) - 1 AS dd FROM nav) SELECT scheme_id, round(min(dd), 6) AS max_drawdown FROM p GROUP BY 1")
def a08(spark, sf):
    return _rounded(S.max_drawdown(D.nav(spark, sf), K))


_RISK = f"""{sql.NAV}, rw AS (SELECT *, max(d) OVER (PARTITION BY scheme_id) AS last FROM nav), ri AS (SELECT * FROM rw WHERE d >= last - 1096),
rr AS (SELECT *, nav / lag(nav) OVER (PARTITION BY scheme_id ORDER BY d) - 1 AS ret FROM ri),
rg AS (SELECT scheme_id, count(*) AS points, date_diff('day', min(d), max(d)) AS days, stddev_samp(ret) * sqrt(252) AS vol, sqrt(avg(power(least(ret - 0.06 / 252, 0), 2)) FILTER (WHERE ret IS NOT NULL)) * sqrt(252) AS dn, arg_min(nav, d) AS s, arg_max(nav, d) AS e FROM rr GROUP BY 1),
risk AS (SELECT *, points >= 30 AND days >= 365 AS ok, CASE WHEN days > 0 THEN power(e / s, 365.25 / days) - 1 END AS g FROM rg)"""


@register("a09_a10_a11_risk", f"""WITH {_RISK} SELECT scheme_id, points, CAST(days AS INTEGER) AS days, CASE WHEN ok THEN round(vol, 6) END AS volatility, CASE WHEN ok THEN round((g - 0.06) / nullif(vol, 0), 6) END AS sharpe, CASE WHEN ok THEN round((g - 0.06) / nullif(dn, 0), 6) END AS sortino,
CASE WHEN points < 30 THEN 'too few points' WHEN days < 365 THEN 'span below one year' END AS risk_unavailable FROM risk""")
def a09(spark, sf):
    return _rounded(S.risk(D.nav(spark, sf), K))


_BSTAT = f"""{sql.NAV}, {sql.BENCH}, m1 AS (SELECT scheme_id, d, nav / lag(nav) OVER (PARTITION BY scheme_id ORDER BY d) - 1 AS ret FROM nav), b1 AS (SELECT d, nav / lag(nav) OVER (ORDER BY d) - 1 AS b FROM bench),
bj AS (SELECT * FROM m1 JOIN b1 USING (d) WHERE ret IS NOT NULL AND b IS NOT NULL),
bg AS (SELECT scheme_id, count(*) AS common, date_diff('day', min(d), max(d)) AS span, covar_samp(ret, b) / var_samp(b) AS beta, avg(ret) AS m, avg(b) AS mb, stddev_samp(ret - b) AS sd, avg(ret - b) AS md, corr(ret, b) AS rho FROM bj GROUP BY 1)"""


@register("a12_benchmark_stats", f"""WITH {_BSTAT} SELECT scheme_id, common, CASE WHEN common >= 30 AND span >= 365 THEN round(beta, 6) END AS beta, CASE WHEN common >= 30 AND span >= 365 THEN round((m - beta * mb) * 252, 6) END AS alpha,
CASE WHEN common >= 30 AND span >= 365 THEN round(sd * sqrt(252), 6) END AS tracking_error, CASE WHEN common >= 30 AND span >= 365 AND sd > 0 THEN round(md / sd * sqrt(252), 6) END AS information_ratio, CASE WHEN common >= 30 AND span >= 365 THEN round(rho * rho, 6) END AS r_squared FROM bg""")
def a12(spark, sf):
    return _rounded(S.benchmark_stats(D.nav(spark, sf), D.benchmark_nav(spark, sf), K))


def _years(y):
    need = round(y * 365.25)
    return f"""y{y} AS (SELECT scheme_id, date_diff('day', min(d), max(d)) >= {need - 5} AS complete_{y}y, CASE WHEN date_diff('day', min(d), max(d)) >= {need - 5} THEN round(power(arg_max(nav, d) / arg_min(nav, d), 365.25 / date_diff('day', min(d), max(d))) - 1, 6) END AS cagr_{y}y FROM rw WHERE d >= last - {need} GROUP BY 1)"""


@register("a13_series_analytics", f"""WITH {_RISK}, {_BSTAT.replace(sql.NAV + ", ", "")}, {_years(1)}, {_years(3)}, {_years(5)},
a AS (SELECT scheme_id, count(*) AS n, min(d) AS inception, max(d) AS as_of, CASE WHEN date_diff('day', min(d), max(d)) >= 90 THEN round(power(arg_max(nav, d) / arg_min(nav, d), 365.25 / date_diff('day', min(d), max(d))) - 1, 6) END AS cagr_inception FROM nav GROUP BY 1),
p AS (SELECT scheme_id, nav / max(nav) OVER (PARTITION BY scheme_id ORDER BY d) - 1 AS dd FROM nav), q AS (SELECT scheme_id, round(min(dd), 6) AS max_drawdown FROM p GROUP BY 1)
SELECT scheme_id, n, inception, as_of, cagr_inception, cagr_1y, complete_1y, cagr_3y, complete_3y, cagr_5y, complete_5y, CASE WHEN ok THEN round(vol, 6) END AS volatility, CASE WHEN ok THEN round((g - 0.06) / nullif(vol, 0), 6) END AS sharpe, CASE WHEN ok THEN round((g - 0.06) / nullif(dn, 0), 6) END AS sortino,
CASE WHEN points < 30 THEN 'too few points' WHEN days < 365 THEN 'span below one year' END AS risk_unavailable, max_drawdown, CASE WHEN common >= 30 AND span >= 365 THEN round(beta, 6) END AS beta, CASE WHEN common >= 30 AND span >= 365 THEN round((m - beta * mb) * 252, 6) END AS alpha,
CASE WHEN common >= 30 AND span >= 365 THEN round(sd * sqrt(252), 6) END AS tracking_error, CASE WHEN common >= 30 AND span >= 365 THEN round(rho * rho, 6) END AS r_squared
FROM a LEFT JOIN y1 USING (scheme_id) LEFT JOIN y3 USING (scheme_id) LEFT JOIN y5 USING (scheme_id) LEFT JOIN risk USING (scheme_id) LEFT JOIN q USING (scheme_id) LEFT JOIN bg USING (scheme_id)""")
def a13(spark, sf):
    return _rounded(S.series_analytics(D.nav(spark, sf), D.benchmark_nav(spark, sf), K))


# Sets of at most 12 schemes for a comparison, of at most 50 for a portfolio; together they hold every scheme.
@register("a15_compare_schemes", f"""WITH {sql.NAV}, ns AS (SELECT scheme_id // 12 AS set_id, * FROM nav), sp AS (SELECT set_id, scheme_id, min(d) AS s, max(d) AS e FROM ns GROUP BY ALL), cm AS (SELECT set_id, max(s) AS s, min(e) AS e FROM sp GROUP BY 1),
ins AS (SELECT ns.* FROM ns JOIN cm ON ns.set_id = cm.set_id AND ns.d BETWEEN cm.s AND cm.e), ct AS (SELECT set_id, scheme_id, count(*) AS n FROM ins GROUP BY ALL), de AS (SELECT set_id, scheme_id FROM ct QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY n DESC, scheme_id) = 1),
grid AS (SELECT set_id, d FROM ins JOIN de USING (set_id, scheme_id)), filled AS (SELECT g.set_id, s.scheme_id, g.d, n.nav FROM sp s JOIN grid g USING (set_id) ASOF LEFT JOIN nav n ON n.scheme_id = s.scheme_id AND n.d <= g.d)
SELECT set_id, scheme_id, d, round(nav, 6) AS nav, round(100 * nav / first_value(nav) OVER (PARTITION BY set_id, scheme_id ORDER BY d), 6) AS rebased FROM filled""")
def a15(spark, sf):
    return _rounded(S.compare(D.nav(spark, sf).withColumn("set_id", F.expr("scheme_id div 12")), "set_id", K))


@register("a16_portfolio_blend", f"""WITH {sql.NAV}, w AS (SELECT s_suppkey // 50 AS portfolio_id, s_suppkey AS scheme_id, CAST(1 + s_suppkey % 5 AS DOUBLE) AS weight FROM supplier), t AS (SELECT portfolio_id, sum(weight) AS total, count(*) AS n FROM w GROUP BY 1), mine AS (SELECT portfolio_id, nav.* FROM nav JOIN w USING (scheme_id)),
ct AS (SELECT portfolio_id, scheme_id, count(*) AS n FROM mine GROUP BY ALL), de AS (SELECT portfolio_id, scheme_id FROM ct QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY n DESC, scheme_id) = 1), grid AS (SELECT portfolio_id, d FROM mine JOIN de USING (portfolio_id, scheme_id)),
filled AS (SELECT g.portfolio_id, s.scheme_id, g.d, n.nav FROM w s JOIN grid g USING (portfolio_id) ASOF LEFT JOIN nav n ON n.scheme_id = s.scheme_id AND n.d <= g.d), v AS (SELECT portfolio_id, scheme_id, d, nav / first_value(nav) OVER (PARTITION BY portfolio_id, scheme_id ORDER BY d) AS rel FROM filled WHERE nav IS NOT NULL)
SELECT portfolio_id, d, round(100 * sum(rel * weight) / any_value(total), 6) AS nav FROM v JOIN w USING (portfolio_id, scheme_id) JOIN t USING (portfolio_id) GROUP BY portfolio_id, d HAVING count(*) = any_value(n)""")
def a16(spark, sf):
    w = D.read(spark, sf, "supplier").select(F.expr("s_suppkey div 50").alias("portfolio_id"), F.col("s_suppkey").alias(K), (1.0 + F.pmod("s_suppkey", F.lit(5))).alias("weight"))
    return _rounded(S.portfolio_blend(D.nav(spark, sf), w, "portfolio_id", K))


@register("a20_history_completeness", f"""WITH {sql.NAV}, g AS (SELECT scheme_id, d, date_diff('day', lag(d) OVER (PARTITION BY scheme_id ORDER BY d), d) AS gap FROM nav)
SELECT scheme_id, count(*) AS points, CAST(coalesce(max(gap), 0) AS INTEGER) AS max_gap, CAST(date_diff('day', max(d), DATE '2001-11-05') AS INTEGER) AS age, coalesce(max(gap), 0) <= 30 AND date_diff('day', max(d), DATE '2001-11-05') <= 7 AS complete FROM g GROUP BY 1""")
def a20(spark, sf):
    return S.completeness(D.nav(spark, sf), K, "2001-11-05", max_gap=30)


@register("j25_benchmark_alignment", f"WITH {sql.NAV}, {sql.BENCH} SELECT scheme_id, d, round(nav.nav, 6) AS nav, round(bench.nav, 6) AS bench FROM nav JOIN bench USING (d)")
def j25(spark, sf):
    return _rounded(D.nav(spark, sf).join(D.benchmark_nav(spark, sf).withColumnRenamed("nav", "bench"), "d"))


@register("j26_asof_valuation", f"""WITH {sql.NAV}, grid AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), filled AS (SELECT s.scheme_id, g.d, n.nav FROM (SELECT DISTINCT scheme_id FROM nav) s CROSS JOIN grid g ASOF LEFT JOIN nav n ON n.scheme_id = s.scheme_id AND n.d <= g.d) SELECT scheme_id, d, round(nav, 6) AS nav FROM filled""")
def j26(spark, sf):
    nav = D.nav(spark, sf)
    dates = D.read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return _rounded(S.asof_fill(nav.select(K).distinct().crossJoin(dates), nav, K))


@register("g42_nav_file_audit", f"WITH {sql.NAV} SELECT scheme_id, count(*) AS points, min(d) AS first, max(d) AS last, CASE WHEN count(*) < 500 THEN 'stub' ELSE 'ok' END AS status FROM nav GROUP BY 1")
def g42(spark, sf):
    return D.nav(spark, sf).groupBy(K).agg(F.count(F.lit(1)).alias("points"), F.min("d").alias("first"), F.max("d").alias("last")).withColumn("status", F.when(F.col("points") < 500, "stub").otherwise("ok"))


@register("q15_date_range", f"WITH {sql.NAV} SELECT scheme_id, d, round(nav, 6) AS nav FROM nav WHERE d BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'")
def q15(spark, sf):
    return _rounded(D.nav(spark, sf).where(F.col("d").between("1998-01-01", "1998-06-30")))


@register("s10_nav_plan", f"WITH {sql.NAV} SELECT scheme_id, count(*) AS points, round(arg_min(nav, d), 6) AS first, round(arg_max(nav, d), 6) AS last FROM nav WHERE d >= DATE '1999-01-01' GROUP BY 1")
def s10(spark, sf):
    return _rounded(D.nav(spark, sf).where("d >= '1999-01-01'").groupBy(K).agg(F.count(F.lit(1)).alias("points"), F.min_by("nav", "d").alias("first"), F.max_by("nav", "d").alias("last")))
