"""Queries of the technical indicators (I) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.operators import technical as T
from kosha.sources import adapters as D

from . import sql
from .registry import ORACLES, register

B = sql.bars()


def _r(df):
    return df.select(*[(F.round(c, 5) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _full(x, n, value):
    return f"CASE WHEN count({x}) OVER (PARTITION BY isin ORDER BY d ROWS {n - 1} PRECEDING) = {n} THEN {value} END"


def _f(agg, n):
    return f"{agg} OVER (PARTITION BY isin ORDER BY d ROWS {n - 1} PRECEDING)"


def _sma(x, n):
    return _full(x, n, _f(f"avg({x})", n))


def _lag(c, k=1):
    return f"lag({c}, {k}) OVER (PARTITION BY isin ORDER BY d)"


def _hi(n):
    return _full("high", n, _f("max(high)", n))


def _lo(n):
    return _full("low", n, _f("min(low)", n))


def _ind(name, f, cols, extra=""):
    """Register indicator f over the bars; cols: name -> SQL over table x, which extra may define from bars."""
    body = ", ".join(f"round({v}, 5) + 0.0 AS {k}" for k, v in cols.items())
    x = extra or ", x AS (SELECT * FROM bars)"

    @register(name, f"WITH {B}{x} SELECT isin, d, {body} FROM x")
    def run(spark, sf):
        return _r(f(D.bars(spark, sf)))


_ind("i01_sma", lambda b: b.select("isin", "d", T.sma(F.col("close"), 20).alias("sma20"), T.sma(F.col("close"), 200).alias("sma200")), {"sma20": _sma("close", 20), "sma200": _sma("close", 200)})
_TR = f"CASE WHEN {_lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')})) END"
_ind("i05_true_range", lambda b: b.select("isin", "d", T.true_range().alias("tr")), {"tr": _TR})
_ind("i12_ichimoku", T.ichimoku, {"tenkan": "tenkan", "kijun": "kijun", "span_a": _lag("ab", 26), "span_b": _lag("m52", 26), "chikou": "lead(close, 26) OVER (PARTITION BY isin ORDER BY d)"},
     f", y AS (SELECT *, ({_hi(9)} + {_lo(9)}) / 2 AS tenkan, ({_hi(26)} + {_lo(26)}) / 2 AS kijun, ({_hi(52)} + {_lo(52)}) / 2 AS m52 FROM bars), x AS (SELECT *, (tenkan + kijun) / 2 AS ab FROM y)")
_ind("i13_vortex", T.vortex, {"plus": _full("tr", 14, f"{_f('sum(vp)', 14)} / {_f('sum(tr)', 14)}"), "minus": _full("tr", 14, f"{_f('sum(vm)', 14)} / {_f('sum(tr)', 14)}")}, f", x AS (SELECT *, {_TR} AS tr, abs(high - {_lag('low')}) AS vp, abs(low - {_lag('high')}) AS vm FROM bars)")
_ind("i16_stochastic", T.stochastic, {"k": "k", "dd": _sma("k", 3)}, f", x AS (SELECT *, CASE WHEN {_hi(14)} = {_lo(14)} THEN 50 ELSE 100 * (close - {_lo(14)}) / ({_hi(14)} - {_lo(14)}) END AS k FROM bars)")
_ind("i18_i21_roc_momentum", T.roc, {"roc": f"100 * (close / {_lag('close', 10)} - 1)", "momentum": f"close - {_lag('close', 10)}"})
_ind("i19_williams_r", T.williams, {"r": f"CASE WHEN {_hi(14)} = {_lo(14)} THEN -50 ELSE -100 * ({_hi(14)} - close) / ({_hi(14)} - {_lo(14)}) END"})
_ind("i20_cci", T.cci, {"cci": "CASE WHEN len(xs) = 20 THEN CASE WHEN mad = 0 THEN 0 ELSE (tp - m) / (0.015 * mad) END END"},
     f", y AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), z AS (SELECT *, list(tp) OVER w AS xs, avg(tp) OVER w AS m FROM y WINDOW w AS (PARTITION BY isin ORDER BY d ROWS 19 PRECEDING)), x AS (SELECT *, list_sum(list_transform(xs, lambda v: abs(v - m))) / 20 AS mad FROM z)")
_UP = lambda n: _full("tr", n, f"{_f('sum(bp)', n)} / {_f('sum(tr)', n)}")
_ind("i23_ultimate", T.ultimate, {"uo": f"100 * (4 * {_UP(7)} + 2 * {_UP(14)} + {_UP(28)}) / 7"}, f", y AS (SELECT *, {_lag('close')} AS pc FROM bars), x AS (SELECT *, CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END AS bp, CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END AS tr FROM y)")
_ind("i24_awesome", T.awesome, {"ao": f"{_sma('mp', 5)} - {_sma('mp', 34)}"}, ", x AS (SELECT *, (high + low) / 2 AS mp FROM bars)")
_ind("i25_bollinger", T.bollinger, {"mid": "mid", "upper": "mid + 2 * sd", "lower": "mid - 2 * sd", "pct_b": "(close - mid + 2 * sd) / nullif(4 * sd, 0)", "bandwidth": "4 * sd / mid"}, f", x AS (SELECT *, {_sma('close', 20)} AS mid, {_full('close', 20, _f('stddev_pop(close)', 20))} AS sd FROM bars)")
_ind("i28_historical_volatility", T.historical_volatility, {"hv": _full("lr", 20, _f("stddev_samp(lr)", 20) + " * sqrt(252) * 100")}, f", x AS (SELECT *, ln(close / {_lag('close')}) AS lr FROM bars)")
_ind("i29_donchian", T.donchian, {"upper": _hi(20), "lower": _lo(20), "mid": f"({_hi(20)} + {_lo(20)}) / 2"})
_ind("i30_ulcer", T.ulcer, {"ulcer": "CASE WHEN len(xs) = 14 THEN sqrt(list_sum(list_transform(range(1, 15), lambda i: power(100 * (xs[i] / list_max(xs[1:i]) - 1), 2))) / 14) END"}, ", x AS (SELECT *, list(close) OVER (PARTITION BY isin ORDER BY d ROWS 13 PRECEDING) AS xs FROM bars)")
_ind("i31_obv", T.obv, {"obv": "sum(sv) OVER (PARTITION BY isin ORDER BY d)"}, f", x AS (SELECT *, CASE WHEN close > {_lag('close')} THEN volume WHEN close < {_lag('close')} THEN -volume ELSE 0 END AS sv FROM bars)")
_ind("i32_mfi", T.mfi, {"mfi": _full("flow", 14, f"CASE WHEN {_f('sum(p)', 14)} = 0 AND {_f('sum(n)', 14)} = 0 THEN NULL WHEN {_f('sum(n)', 14)} = 0 THEN 100 ELSE 100 - 100 / (1 + {_f('sum(p)', 14)} / {_f('sum(n)', 14)}) END")},
     f", y AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), z AS (SELECT *, {_lag('tp')} AS pt FROM y), x AS (SELECT *, CASE WHEN pt IS NOT NULL THEN tp * volume END AS flow, CASE WHEN tp > pt THEN tp * volume ELSE 0 END AS p, CASE WHEN tp < pt THEN tp * volume ELSE 0 END AS n FROM z)")
_ind("i33_vwap", T.vwap, {"vwap": _full("tv", 20, f"{_f('sum(tv)', 20)} / nullif({_f('sum(volume)', 20)}, 0)")}, ", x AS (SELECT *, (high + low + close) / 3 * volume AS tv FROM bars)")
_ind("i34_cmf", T.cmf, {"cmf": _full("mv", 20, f"{_f('sum(mv)', 20)} / nullif({_f('sum(volume)', 20)}, 0)")}, ", x AS (SELECT *, CASE WHEN high = low THEN 0 ELSE (2 * close - high - low) / (high - low) * volume END AS mv FROM bars)")
_ind("i35_pvt", T.pvt, {"pvt": "sum(v) OVER (PARTITION BY isin ORDER BY d)"}, f", x AS (SELECT *, coalesce(volume * (close / {_lag('close')} - 1), 0) AS v FROM bars)")
_ind("i36_eom", T.eom, {"eom": _sma("v", 14)}, f", y AS (SELECT *, (high + low) / 2 AS mid FROM bars), x AS (SELECT *, CASE WHEN high > low THEN (mid - {_lag('mid')}) / nullif(volume / 10000 / nullif(high - low, 0), 0) END AS v FROM y)")
_ind("i11_aroon", T.aroon, {"up": _full("high", 26, "100.0 * (25 - (i - ui)) / 25"), "down": _full("low", 26, "100.0 * (25 - (i - li)) / 25"), "osc": f"{_full('high', 26, '100.0 * (li - i + i - ui) / -25')}"},
     ", y AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY d) AS i FROM bars), x AS (SELECT *, (max({'h': high, 'i': i}) OVER w).i AS ui, -(min({'l': low, 'i': -i}) OVER w).i AS li FROM y WINDOW w AS (PARTITION BY isin ORDER BY d ROWS 25 PRECEDING))")


def _per(name, f, query):
    @register(name, query)
    def run(spark, sf):
        return _r(f(D.bars(spark, sf)))


_per("i06_cross_events", T.crosses, f"WITH {B}, y AS (SELECT *, {_sma('close', 50)} - {_sma('close', 200)} AS x FROM bars), z AS (SELECT *, {_lag('x')} AS px FROM y) SELECT isin, d, CASE WHEN x > 0 THEN 'up' ELSE 'down' END AS \"cross\" FROM z WHERE (px <= 0 AND x > 0) OR (px >= 0 AND x < 0)")
_per("i37_pivot_points", T.pivots, f"WITH {B}, l AS (SELECT isin, arg_max(high, d) AS h, arg_max(low, d) AS l, arg_max(close, d) AS c FROM bars GROUP BY 1), q AS (SELECT *, (h + l + c) / 3 AS p FROM l) SELECT isin, round(p, 5) AS p, round(2 * p - l, 5) AS r1, round(2 * p - h, 5) AS s1, round(p + h - l, 5) AS r2, round(p - h + l, 5) AS s2, round(h + 2 * (p - l), 5) AS r3, round(l - 2 * (h - p), 5) AS s3 FROM q")
_FIB = ", ".join(f"round(CASE WHEN up THEN hi - {r} * (hi - lo) ELSE lo + {r} * (hi - lo) END, 5) AS f{int(r * 1000)}" for r in (0.236, 0.382, 0.5, 0.618, 0.786))
_per("i38_fibonacci", T.fibonacci, f"WITH {B}, k AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY d DESC) AS k FROM bars), g AS (SELECT isin, max(high) AS hi, min(low) AS lo, any_value(close) FILTER (WHERE k = 1) AS c FROM k WHERE k <= 120 GROUP BY 1), u AS (SELECT *, c >= (hi + lo) / 2 AS up FROM g) SELECT isin, round(hi, 5) AS hi, round(lo, 5) AS lo, up AS rising, {_FIB} FROM u")
_FRACTALS = """y AS (SELECT *, count(*) OVER b = 5 AND count(*) OVER a = 5 AS w, high > max(high) OVER b AND high > max(high) OVER a AS h, low < min(low) OVER b AND low < min(low) OVER a AS l, row_number() OVER (PARTITION BY isin ORDER BY d DESC) AS age FROM bars
WINDOW b AS (PARTITION BY isin ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY isin ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""
_LEVELS = "list_transform(list_sort(list_distinct(list({0}) FILTER (WHERE {1})), '{2}')[1:8], lambda x: round(x, 5))"


@register("i39_swing_levels", f"WITH {B}, {_FRACTALS} SELECT isin, array_to_string({_LEVELS.format('high', 'h', 'DESC')}, ',') AS resistance, array_to_string({_LEVELS.format('low', 'l', 'ASC')}, ',') AS support FROM y WHERE w AND (h OR l) AND age <= 250 GROUP BY isin")
def i39_swing_levels(spark, sf):
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x, 5).cast("string")), ",").alias(c)
    return T.swing_levels(D.bars(spark, sf)).select("isin", text("resistance"), text("support"))


_per("i40_week52_position", T.week52, f"WITH {B}, k AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY d DESC) AS k FROM bars), g AS (SELECT isin, max(close) AS hi, min(close) AS lo, arg_max(close, d) AS c FROM k WHERE k <= 252 GROUP BY 1 HAVING count(*) >= 60) SELECT isin, round(hi, 5) AS hi, round(lo, 5) AS lo, round(100 * (c - lo) / nullif(hi - lo, 0), 5) AS position FROM g")
_BARS4 = "rb AS (SELECT isin, d, round(open, 4) AS o, round(high, 4) AS h, round(low, 4) AS l, round(close, 4) AS c FROM bars)"
_SHAPES = {
    "doji": "h > l AND abs(c - o) <= 0.1 * (h - l)",
    "hammer": "h > l AND c <> o AND least(o, c) - l >= 2 * abs(c - o) AND h - greatest(o, c) <= 0.35 * abs(c - o) AND trend < 0",
    "hanging_man": "h > l AND c <> o AND least(o, c) - l >= 2 * abs(c - o) AND h - greatest(o, c) <= 0.35 * abs(c - o) AND trend >= 0",
    "shooting_star": "h > l AND c <> o AND h - greatest(o, c) >= 2 * abs(c - o) AND least(o, c) - l <= 0.35 * abs(c - o) AND trend > 0",
    "inverted_hammer": "h > l AND c <> o AND h - greatest(o, c) >= 2 * abs(c - o) AND least(o, c) - l <= 0.35 * abs(c - o) AND trend <= 0",
    "bullish_engulfing": "c > o AND c1 < o1 AND c >= o1 AND o <= c1 AND c - o > o1 - c1",
    "bearish_engulfing": "c < o AND c1 > o1 AND o >= c1 AND c <= o1 AND o - c > c1 - o1",
    "morning_star": "c2 < o2 AND abs(c1 - o1) <= 0.4 * (o2 - c2) AND c > o AND c > (o2 + c2) / 2 AND trend < 0",
    "evening_star": "c1 > o1 AND c2 <> o2 AND abs(c1 - o1) <= 0.4 * abs(c2 - o2) AND c < o AND c < (o2 + c2) / 2 AND trend > 0",
    "three_white_soldiers": "c > o AND c1 > o1 AND c2 > o2 AND c > c1 AND c1 > c2",
    "three_black_crows": "c < o AND c1 < o1 AND c2 < o2 AND c < c1 AND c1 < c2",
    "piercing_line": "c1 < o1 AND c > o AND o < c1 AND c > (o1 + c1) / 2 AND c < o1",
    "dark_cloud_cover": "c1 > o1 AND c < o AND o > c1 AND c > o1 AND c < (o1 + c1) / 2",
}
_per("i41_candlesticks", lambda b: T.candles(b.select("isin", "d", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")])), f"""WITH {B}, {_BARS4},
y AS (SELECT *, {_lag('o')} AS o1, {_lag('c')} AS c1, {_lag('o', 2)} AS o2, {_lag('c', 2)} AS c2, row_number() OVER (PARTITION BY isin ORDER BY d) AS i,
  CASE WHEN count(*) OVER w >= 3 THEN sign(c - first_value(c) OVER w) ELSE 0 END AS trend FROM rb WINDOW w AS (PARTITION BY isin ORDER BY d ROWS 5 PRECEDING))
""" + " UNION ALL ".join(f"SELECT isin, d, '{k}' AS pattern, '{T.CANDLES[k]}' AS direction FROM y WHERE i > 2 AND {v}" for k, v in _SHAPES.items()))
_ind("i04_windowed_sigma", lambda b: b.select("isin", "d", T.full(F.col("close"), 20, F.stddev_pop("close").over(T.frame(20))).alias("sigma")), {"sigma": _full("close", 20, f"sqrt(greatest(0, {_f('var_pop(close)', 20)}))")})


def _recursive(name, cols, query=None):
    @register(name, query)
    def run(spark, sf):
        return _r(T.recursive_indicators(D.bars(spark, sf), tuple(cols)))


def _ema_cte(out, n, source, value, key="i"):
    """A recursive average over source(isin, i, value): seed at row n of the valid ones."""
    return f"{out}(isin, i, e) AS (SELECT isin, {n}, avg({value}) FROM {source} WHERE {key} <= {n} GROUP BY 1 HAVING count(*) = {n} UNION ALL SELECT s.isin, s.{key}, t.e + 2.0 / {n + 1} * (s.{value} - t.e) FROM {out} t JOIN {source} s ON s.isin = t.isin AND s.{key} = t.i + 1)"


def _wilder_cte(out, n, source, value):
    return f"{out}(isin, i, e) AS (SELECT isin, {n}, avg({value}) FROM {source} WHERE i <= {n} GROUP BY 1 HAVING count(*) = {n} UNION ALL SELECT s.isin, s.i, t.e - t.e / {n} + s.{value} / {n} FROM {out} t JOIN {source} s ON s.isin = t.isin AND s.i = t.i + 1)"


_NUM = "num AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY d) AS i FROM bars)"
_recursive("i02_ema", ["ema12", "ema26"], f"WITH RECURSIVE {B}, {_NUM}, {_ema_cte('a', 12, 'num', 'close')}, {_ema_cte('b', 26, 'num', 'close')} SELECT num.isin, d, round(a.e, 5) AS ema12, round(b.e, 5) AS ema26 FROM num LEFT JOIN a USING (isin, i) LEFT JOIN b USING (isin, i)")
_recursive("i07_macd", ["macd", "macd_signal", "macd_hist"], f"WITH RECURSIVE {B}, {_NUM}, {_ema_cte('a', 12, 'num', 'close')}, {_ema_cte('b', 26, 'num', 'close')}, m AS (SELECT isin, i - 25 AS i, a.e - b.e AS v FROM a JOIN b USING (isin, i)), {_ema_cte('s', 9, 'm', 'v')} SELECT num.isin, d, round(m.v, 5) AS macd, round(s.e, 5) AS macd_signal, round(m.v - s.e, 5) AS macd_hist FROM num LEFT JOIN m ON m.isin = num.isin AND m.i = num.i - 25 LEFT JOIN s ON s.isin = num.isin AND s.i = num.i - 25")
_TRN = f"trn AS (SELECT isin, d, row_number() OVER (PARTITION BY isin ORDER BY d) - 1 AS i, {_TR} AS v, greatest(close - {_lag('close')}, 0) AS up, greatest({_lag('close')} - close, 0) AS dn FROM bars), trs AS (SELECT * FROM trn WHERE i >= 1)"
_recursive("i03_i26_wilder_atr", ["atr14"], f"WITH RECURSIVE {B}, {_TRN}, {_wilder_cte('a', 14, 'trs', 'v')} SELECT trn.isin, d, round(a.e, 5) AS atr14 FROM trn LEFT JOIN a USING (isin, i)")
_recursive("i15_rsi", ["rsi14"], f"WITH RECURSIVE {B}, {_TRN}, {_wilder_cte('u', 14, 'trs', 'up')}, {_wilder_cte('w', 14, 'trs', 'dn')} SELECT trn.isin, d, round(CASE WHEN w.e = 0 THEN 100 ELSE 100 - 100 / (1 + u.e / w.e) END, 5) AS rsi14 FROM trn LEFT JOIN u USING (isin, i) LEFT JOIN w USING (isin, i)")
_recursive("i27_keltner", ["keltner_upper", "keltner_mid", "keltner_lower"], f"WITH RECURSIVE {B}, {_NUM}, {_TRN}, {_ema_cte('m', 20, 'num', 'close')}, {_wilder_cte('a', 10, 'trs', 'v')} SELECT num.isin, d, round(m.e + 2 * a.e, 5) AS keltner_upper, round(m.e, 5) AS keltner_mid, round(m.e - 2 * a.e, 5) AS keltner_lower FROM num LEFT JOIN m USING (isin, i) LEFT JOIN a ON a.isin = num.isin AND a.i = num.i - 1")
_MOVES = f"""trn AS (SELECT isin, d, row_number() OVER (PARTITION BY isin ORDER BY d) - 1 AS i, {_TR} AS v, high - {_lag('high')} AS hm, {_lag('low')} - low AS lm, greatest(close - {_lag('close')}, 0) AS up, greatest({_lag('close')} - close, 0) AS dn FROM bars),
trs AS (SELECT *, CASE WHEN hm > lm AND hm > 0 THEN hm ELSE 0 END AS p, CASE WHEN lm > hm AND lm > 0 THEN lm ELSE 0 END AS m FROM trn WHERE i >= 1)"""
_DI = f"{_wilder_cte('a', 14, 'trs', 'v')}, {_wilder_cte('pw', 14, 'trs', 'p')}, {_wilder_cte('mw', 14, 'trs', 'm')}, di AS (SELECT isin, i, 100 * pw.e / a.e AS p, 100 * mw.e / a.e AS m FROM a JOIN pw USING (isin, i) JOIN mw USING (isin, i)), dx AS (SELECT isin, i - 13 AS i, 100 * abs(p - m) / (p + m) AS v FROM di), {_wilder_cte('ax', 14, 'dx', 'v')}"
_recursive("i08_adx", ["plus_di", "minus_di", "adx14"], f"WITH RECURSIVE {B}, {_MOVES}, {_DI} SELECT trn.isin, d, round(di.p, 5) AS plus_di, round(di.m, 5) AS minus_di, round(ax.e, 5) AS adx14 FROM trn LEFT JOIN di USING (isin, i) LEFT JOIN ax ON ax.isin = trn.isin AND ax.i = trn.i - 13")
_ST = f"""{_wilder_cte('ar', 10, 'trs', 'v')}, sb AS (SELECT num.isin, num.d, num.i, num.close, {_lag('close').replace('OVER (PARTITION BY isin ORDER BY d)', 'OVER (PARTITION BY num.isin ORDER BY num.d)')} AS pc, (high + low) / 2 + 3 * ar.e AS bu, (high + low) / 2 - 3 * ar.e AS bl FROM num LEFT JOIN ar ON ar.isin = num.isin AND ar.i = num.i - 1),
st(isin, i, u, l, side) AS (SELECT isin, i, bu, bl, 1 FROM sb WHERE i = 11 UNION ALL
  SELECT isin, i, u, l, CASE WHEN was = 1 AND close < l THEN -1 WHEN was = -1 AND close > u THEN 1 ELSE was END FROM (
    SELECT sb.isin, sb.i, sb.close, st.side AS was, CASE WHEN bu < st.u OR pc > st.u THEN bu ELSE st.u END AS u, CASE WHEN bl > st.l OR pc < st.l THEN bl ELSE st.l END AS l FROM st JOIN sb ON sb.isin = st.isin AND sb.i = st.i + 1))"""
_recursive("i09_supertrend", ["supertrend", "supertrend_side"], f"WITH RECURSIVE {B}, {_NUM}, {_TRN}, {_ST} SELECT sb.isin, d, round(CASE side WHEN 1 THEN l ELSE u END, 5) AS supertrend, CAST(side AS DOUBLE) AS supertrend_side FROM sb LEFT JOIN st USING (isin, i)")
_SAR = f"""sn AS (SELECT *, {_lag('low')} AS l1, {_lag('low', 2)} AS l2, {_lag('high')} AS h1, {_lag('high', 2)} AS h2 FROM num),
sr(isin, i, sar, x, af, up) AS (SELECT isin, i, low, high, CAST(0.02 AS DOUBLE), true FROM sn WHERE i = 1 UNION ALL
  SELECT isin, i, CASE WHEN turn THEN x ELSE s END, CASE WHEN turn AND up THEN low WHEN turn THEN high ELSE x END, CASE WHEN turn THEN 0.02 ELSE af END, up <> turn FROM (
    SELECT *, CASE WHEN up THEN low < s ELSE high > s END AS turn FROM (
      SELECT n.isin, n.i, n.low, n.high, r.up, CASE WHEN r.up THEN least(sar + af * (x - sar), l1, l2) ELSE greatest(sar + af * (x - sar), h1, h2) END AS s,
        CASE WHEN r.up THEN greatest(x, n.high) ELSE least(x, n.low) END AS x, CASE WHEN (r.up AND n.high > x) OR (NOT r.up AND n.low < x) THEN least(af + 0.02, 0.2) ELSE af END AS af
      FROM sr r JOIN sn n ON n.isin = r.isin AND n.i = r.i + 1)))"""
_recursive("i10_parabolic_sar", ["sar"], f"WITH RECURSIVE {B}, {_NUM}, {_SAR} SELECT num.isin, d, round(sar, 5) AS sar FROM num LEFT JOIN sr USING (isin, i)")
_recursive("i14_trix", ["trix15"], f"WITH RECURSIVE {B}, {_NUM}, {_ema_cte('e1', 15, 'num', 'close')}, s1 AS (SELECT isin, i - 14 AS i, e AS v FROM e1), {_ema_cte('e2', 15, 's1', 'v')}, s2 AS (SELECT isin, i - 14 AS i, e AS v FROM e2), {_ema_cte('e3', 15, 's2', 'v')}, t AS (SELECT isin, i + 28 AS i, 100 * (e / lag(e) OVER (PARTITION BY isin ORDER BY i) - 1) AS v FROM e3) SELECT num.isin, d, round(v, 5) AS trix15 FROM num LEFT JOIN t USING (isin, i)")
_RSI = f"{_wilder_cte('u', 14, 'trs', 'up')}, {_wilder_cte('w', 14, 'trs', 'dn')}, rs AS (SELECT isin, i, CASE WHEN w.e = 0 THEN 100 ELSE 100 - 100 / (1 + u.e / w.e) END AS rsi14 FROM u JOIN w USING (isin, i))"
_W14 = "OVER (PARTITION BY isin ORDER BY i ROWS 13 PRECEDING)"
_W3 = "OVER (PARTITION BY isin ORDER BY i ROWS 2 PRECEDING)"
_recursive("i17_stoch_rsi", ["stoch_rsi_k", "stoch_rsi_d"], f"""WITH RECURSIVE {B}, {_TRN}, {_RSI}, k0 AS (SELECT isin, i, CASE WHEN max(rsi14) {_W14} = min(rsi14) {_W14} THEN 50 ELSE 100 * (rsi14 - min(rsi14) {_W14}) / (max(rsi14) {_W14} - min(rsi14) {_W14}) END AS k, count(*) {_W14} AS n FROM rs),
k1 AS (SELECT isin, i, CASE WHEN count(*) {_W3} = 3 THEN avg(k) {_W3} END AS k FROM k0 WHERE n = 14), k2 AS (SELECT isin, i, k, CASE WHEN count(k) {_W3} = 3 THEN avg(k) {_W3} END AS dd FROM k1) SELECT trn.isin, d, round(k, 5) AS stoch_rsi_k, round(dd, 5) AS stoch_rsi_d FROM trn LEFT JOIN k2 USING (isin, i)""")
_recursive("i22_tsi", ["tsi"], f"WITH RECURSIVE {B}, mv AS (SELECT isin, d, row_number() OVER (PARTITION BY isin ORDER BY d) - 1 AS i, close - {_lag('close')} AS m FROM bars), ms AS (SELECT *, abs(m) AS am FROM mv WHERE i >= 1), {_ema_cte('a1', 25, 'ms', 'm')}, {_ema_cte('b1', 25, 'ms', 'am')}, a2 AS (SELECT isin, i - 24 AS i, e AS v FROM a1), b2 AS (SELECT isin, i - 24 AS i, e AS v FROM b1), {_ema_cte('a3', 13, 'a2', 'v')}, {_ema_cte('b3', 13, 'b2', 'v')}, t AS (SELECT isin, i + 24 AS i, 100 * a3.e / b3.e AS v FROM a3 JOIN b3 USING (isin, i)) SELECT mv.isin, d, round(v, 5) AS tsi FROM mv LEFT JOIN t USING (isin, i)")

# Events.
_per("i43_rsi_zone_exits", lambda b: T.rsi_zone_exits(T.recursive_indicators(b, ("rsi14",))), f"WITH RECURSIVE {B}, {_TRN}, {_RSI}, z AS (SELECT isin, i, CASE WHEN rsi14 >= 70 THEN 'overbought' WHEN rsi14 <= 30 THEN 'oversold' ELSE 'mid' END AS zone FROM rs), p AS (SELECT *, lag(zone) OVER (PARTITION BY isin ORDER BY i) AS was FROM z) SELECT p.isin, d, 'rsi_exit_' || was AS kind, CASE was WHEN 'oversold' THEN 'up' ELSE 'down' END AS direction FROM p JOIN trn USING (isin, i) WHERE zone = 'mid' AND was <> 'mid'")
_PIVOTS = """pv AS (SELECT isin, d, i, close, count(*) OVER b = 5 AND count(*) OVER a = 5 AND close > max(close) OVER b AND close > max(close) OVER a AS is_high, count(*) OVER b = 5 AND count(*) OVER a = 5 AND close < min(close) OVER b AND close < min(close) OVER a AS is_low FROM num
WINDOW b AS (PARTITION BY isin ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY isin ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""


@register("i42_divergences", f"""WITH RECURSIVE {B}, {_NUM}, {_TRN}, {_RSI}, {_PIVOTS},
q AS (SELECT pv.*, rsi14, row_number() OVER (PARTITION BY pv.isin, is_high ORDER BY pv.i DESC) AS age FROM pv LEFT JOIN rs ON rs.isin = pv.isin AND rs.i = pv.i - 1 WHERE is_high OR is_low)
SELECT z.isin, z.d, CASE WHEN z.is_low THEN 'regular_bullish_divergence' ELSE 'regular_bearish_divergence' END AS kind FROM q z JOIN q a ON a.isin = z.isin AND a.is_high = z.is_high AND z.age = 1 AND a.age = 2
WHERE z.i - a.i <= 60 AND CASE WHEN z.is_low THEN z.close < a.close AND z.rsi14 > a.rsi14 ELSE z.close > a.close AND z.rsi14 < a.rsi14 END""")
def i42_divergences(spark, sf):
    b = D.bars(spark, sf)
    return T.divergences(b, T.recursive_indicators(b, ("rsi14",)))


# The last bar of each series: readings from the oracles of the single indicators, votes written anew.
_LAST = {"i02_ema": "ema12 ema26", "i07_macd": "macd macd_signal", "i08_adx": "plus_di minus_di adx14", "i09_supertrend": "supertrend supertrend_side", "i10_parabolic_sar": "sar", "i14_trix": "trix15", "i15_rsi": "rsi14", "i22_tsi": "tsi", "i01_sma": "sma20 sma200", "i11_aroon": "up down", "i12_ichimoku": "tenkan kijun span_a span_b", "i13_vortex": "plus minus", "i16_stochastic": "k", "i18_i21_roc_momentum": "roc", "i19_williams_r": "r", "i20_cci": "cci", "i23_ultimate": "uo", "i24_awesome": "ao", "i25_bollinger": "pct_b", "i32_mfi": "mfi", "i33_vwap": "vwap", "i34_cmf": "cmf"}


def _readings_sql() -> str:
    parts = ", ".join(f"t_{k} AS ({ORACLES[k]})" for k in _LAST)
    joins = " ".join(f"LEFT JOIN t_{k} USING (isin, d)" for k in _LAST)
    return f"""WITH RECURSIVE {B}, {parts}, ob AS (SELECT isin, d, sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER (PARTITION BY isin ORDER BY d) AS obv FROM (SELECT *, {_lag('close')} AS pc FROM bars)),
nb AS (SELECT isin, d, close, volume, {_lag('close')} AS pc, {_sma('close', 50)} AS sma50, {_sma('volume', 20)} AS vs, row_number() OVER (PARTITION BY isin ORDER BY d DESC) AS age, count(*) OVER (PARTITION BY isin) AS n FROM bars),
os AS (SELECT isin, d, obv - {_lag('obv', 20)} AS slope FROM ob),
l AS (SELECT * FROM nb LEFT JOIN os USING (isin, d) {joins} WHERE age = 1 AND n >= 30)"""


_VOTES = {
    "t": ["CASE WHEN close > sma50 THEN 1 ELSE -1 END|close IS NOT NULL AND sma50 IS NOT NULL", "CASE WHEN sma50 > sma200 THEN 1 ELSE -1 END|sma50 IS NOT NULL AND sma200 IS NOT NULL", "CASE WHEN macd > macd_signal THEN 1 ELSE -1 END|macd_signal IS NOT NULL", "CASE WHEN macd > 0 THEN 1 ELSE -1 END|macd IS NOT NULL", "CASE WHEN plus_di > minus_di THEN 1 ELSE -1 END|adx14 >= 20", "supertrend_side|supertrend_side IS NOT NULL",
          "CASE WHEN span_a IS NULL OR span_b IS NULL THEN CASE WHEN close > kijun THEN 1 ELSE -1 END WHEN close > greatest(span_a, span_b) THEN 1 WHEN close < least(span_a, span_b) THEN -1 ELSE 0 END|kijun IS NOT NULL"],
    "m": [f"greatest(-1, least(1, ({v}) / {n}.0))|{c} IS NOT NULL" for v, n, c in (("rsi14 - 50", 25, "rsi14"), ("roc", 15, "roc"), ("k - 50", 40, "k"), ("cci", 150, "cci"), ("mfi - 50", 35, "mfi"))],
    "v": ["least(1, abs(greatest(-1, least(1, cmf / 0.25))) * 1.5) * CASE WHEN cmf > 0 THEN 1 ELSE -1 END|cmf IS NOT NULL", "CASE WHEN close > vwap THEN 1 ELSE -1 END|vwap IS NOT NULL", "CASE WHEN close > pc THEN 1 ELSE -1 END|volume / vs >= 1.5 AND pc IS NOT NULL", "sign(slope)|slope IS NOT NULL"],
}
_SCORES = ", ".join(f"100 * list_avg([{', '.join(f'CASE WHEN {c} THEN CAST({v} AS DOUBLE) END' for v, c in (x.split('|') for x in votes))}]) AS {k}x" for k, votes in _VOTES.items())


@register("i44_composite_score", f"""{_readings_sql()}, s AS (SELECT isin, {_SCORES} FROM l),
w AS (SELECT *, (coalesce(tx * 0.4, 0) + coalesce(mx * 0.35, 0) + coalesce(vx * 0.25, 0)) / ((tx IS NOT NULL)::INT * 0.4 + (mx IS NOT NULL)::INT * 0.35 + (vx IS NOT NULL)::INT * 0.25) AS total FROM s),
c AS (SELECT *, CAST(round_even(round(total, 9), 0) AS BIGINT) AS composite FROM w)
SELECT isin, composite, CASE WHEN composite >= 25 THEN 'bullish' WHEN composite <= -25 THEN 'bearish' ELSE 'neutral' END AS bias, CAST(round_even(round(tx, 9), 0) AS BIGINT) AS trend, CAST(round_even(round(mx, 9), 0) AS BIGINT) AS momentum, CAST(round_even(round(vx, 9), 0) AS BIGINT) AS volume_score FROM c""")
def i44_composite_score(spark, sf):
    return T.composite_score(T.latest_readings(D.bars(spark, sf)))


def _side(x):
    return f"CASE WHEN {x} THEN 'bullish' WHEN NOT ({x}) THEN 'bearish' END"


def _band(v, low, high):
    return f"CASE WHEN {v} <= {low} THEN 'bearish' WHEN {v} >= {high} THEN 'bullish' WHEN {v} IS NOT NULL THEN 'neutral' END"


_SIGNALS = {
    **{x: (x, _side(f"close > {x}")) for x in ("sma20", "sma50", "sma200", "ema12", "ema26")},
    "macd": ("macd", f"coalesce({_side('macd > macd_signal')}, 'neutral')"),
    "adx": ("adx14", "CASE WHEN adx14 >= 20 AND plus_di > minus_di THEN 'bullish' WHEN adx14 >= 20 THEN 'bearish' ELSE 'neutral' END"),
    "supertrend": ("supertrend", _side("supertrend_side > 0")),
    "psar": ("sar", _side("close > sar")),
    "aroon": ("up", "CASE WHEN up > 70 AND up > down THEN 'bullish' WHEN down > 70 AND down > up THEN 'bearish' ELSE 'neutral' END"),
    "vortex": ("plus", f"coalesce({_side('plus > minus')}, 'neutral')"),
    "trix": ("trix15", "CASE WHEN trix15 = 0 THEN 'neutral' WHEN trix15 > 0 THEN 'bullish' WHEN trix15 < 0 THEN 'bearish' END"),
    "ichimoku": ("kijun", "CASE WHEN close > greatest(tenkan, kijun) AND (span_a IS NULL OR span_b IS NULL OR close > greatest(span_a, span_b)) AND tenkan IS NOT NULL AND kijun IS NOT NULL THEN 'bullish' WHEN close < least(tenkan, kijun) AND (span_a IS NULL OR span_b IS NULL OR close < least(span_a, span_b)) AND tenkan IS NOT NULL AND kijun IS NOT NULL THEN 'bearish' ELSE 'neutral' END"),
    "rsi_14": ("rsi14", _band("rsi14", 30, 55)),
    "roc_10": ("roc", f"coalesce({_side('roc > 0')}, 'neutral')"),
    "williams_r": ("r", _band("r", -80, -50)),
    "cci_20": ("cci", _band("cci", -100, 100)),
    "tsi": ("tsi", f"coalesce({_side('tsi > 0')}, 'neutral')"),
    "ultimate_osc": ("uo", _band("uo", 40, 60)),
    "awesome_osc": ("ao", f"coalesce({_side('ao > 0')}, 'neutral')"),
    "bollinger_20_2": ("pct_b", "CASE WHEN pct_b >= 1 THEN 'bullish' WHEN pct_b <= 0 THEN 'bearish' ELSE 'neutral' END"),
    "mfi_14": ("mfi", _band("mfi", 20, 55)),
    "rolling_vwap_20d": ("vwap", f"coalesce({_side('close > vwap')}, 'neutral')"),
    "cmf_20": ("cmf", _band("cmf", -0.05, 0.05)),
}


@register("i45_technical_signals", f"{_readings_sql()} " + " UNION ALL ".join(f"SELECT isin, '{k}' AS name, round(CAST({v} AS DOUBLE), 5) + 0.0 AS value, {s} AS signal FROM l" for k, (v, s) in _SIGNALS.items()))
def i45_technical_signals(spark, sf):
    return T.signals(T.latest_readings(D.bars(spark, sf))).withColumn("value", F.round("value", 5) + 0.0)


@register("i45_technical_events", f"""WITH RECURSIVE {B}, a AS ({ORACLES['i06_cross_events']}), b AS ({ORACLES['i07_macd']}), c AS ({ORACLES['i09_supertrend']}), z AS ({ORACLES['i43_rsi_zone_exits']}), v AS ({ORACLES['i42_divergences']}),
m AS (SELECT isin, d, macd - macd_signal AS x, lag(macd - macd_signal) OVER (PARTITION BY isin ORDER BY d) AS px FROM b), f AS (SELECT isin, d, supertrend_side AS s, lag(supertrend_side) OVER (PARTITION BY isin ORDER BY d) AS was FROM c WHERE supertrend_side IS NOT NULL),
e AS (SELECT isin, d, CASE "cross" WHEN 'up' THEN 'golden_cross' ELSE 'death_cross' END AS kind, "cross" AS direction FROM a UNION ALL SELECT isin, d, 'macd_cross', CASE WHEN x > 0 THEN 'up' ELSE 'down' END FROM m WHERE (px <= 0 AND x > 0) OR (px >= 0 AND x < 0)
UNION ALL SELECT * FROM z UNION ALL SELECT isin, d, 'supertrend_flip', CASE WHEN s > 0 THEN 'up' ELSE 'down' END FROM f WHERE s <> was UNION ALL SELECT isin, d, kind, CASE WHEN kind LIKE '%bullish%' THEN 'up' ELSE 'down' END FROM v)
SELECT isin, d, kind, direction FROM (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY d DESC, kind) AS k FROM e) WHERE k <= 40""")
def i45_technical_events(spark, sf):
    return T.technical_events(D.bars(spark, sf))
