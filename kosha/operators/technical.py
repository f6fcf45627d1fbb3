"""Technical indicators over bars (isin, d, open, high, low, close, volume).

Indicators with fixed frames are window expressions over one sort for each
series.  Recurrences (exponential and Wilder averages, trailing states) run once
over each series in one grouped pandas function.  A window with a null, or too
short a history, gives null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def series():
    return W.partitionBy("isin").orderBy("d")


def frame(n: int):
    return series().rowsBetween(-(n - 1), 0)


def full(x: Column, n: int, value: Column) -> Column:
    """value where all n rows of the frame stand and have x."""
    return F.when((F.count(x).over(frame(n)) == n), value)


def sma(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x).over(frame(n)))


def prev(c: str, k: int = 1) -> Column:
    return F.lag(c, k).over(series())


def true_range() -> Column:
    pc = prev("close")
    return F.when(pc.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def highest(n: int, c: str = "high") -> Column:
    return full(F.col(c), n, F.max(c).over(frame(n)))


def lowest(n: int, c: str = "low") -> Column:
    return full(F.col(c), n, F.min(c).over(frame(n)))


def aroon(bars: DataFrame, n: int = 25) -> DataFrame:
    """Bars since the extreme of n + 1 bars, the latest of equal ones."""
    b = bars.withColumn("i", F.row_number().over(series()))
    up = F.max(F.struct("high", "i")).over(frame(n + 1))["i"]
    down = F.min(F.struct(F.col("low"), (-F.col("i")).alias("i"))).over(frame(n + 1))["i"]
    b = b.withColumn("up", full(F.col("high"), n + 1, 100.0 * (n - (F.col("i") - up)) / n)).withColumn("down", full(F.col("low"), n + 1, 100.0 * (n - (F.col("i") + down)) / n))
    return b.select("isin", "d", "up", "down", (F.col("up") - F.col("down")).alias("osc"))


def ichimoku(bars: DataFrame) -> DataFrame:
    mid = lambda n: (highest(n) + lowest(n)) / 2
    b = bars.withColumn("tenkan", mid(9)).withColumn("kijun", mid(26)).withColumn("m52", mid(52)).withColumn("ab", (F.col("tenkan") + F.col("kijun")) / 2)
    return b.select("isin", "d", "tenkan", "kijun", prev("ab", 26).alias("span_a"), prev("m52", 26).alias("span_b"), F.lead("close", 26).over(series()).alias("chikou"))


def vortex(bars: DataFrame, n: int = 14) -> DataFrame:
    b = bars.withColumn("tr", true_range()).withColumn("vp", F.abs(F.col("high") - prev("low"))).withColumn("vm", F.abs(F.col("low") - prev("high")))
    s = lambda c: full(F.col("tr"), n, F.sum(c).over(frame(n)))
    return b.select("isin", "d", F.try_divide(s("vp"), s("tr")).alias("plus"), F.try_divide(s("vm"), s("tr")).alias("minus"))


def stochastic(bars: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    h, low = highest(n), lowest(n)
    b = bars.withColumn("k", F.when(h == low, 50.0).otherwise(100 * (F.col("close") - low) / F.nullif(h - low, F.lit(0.0))))
    return b.select("isin", "d", "k", sma(F.col("k"), smooth).alias("dd"))


def roc(bars: DataFrame, n: int = 10) -> DataFrame:
    p = prev("close", n)
    return bars.select("isin", "d", F.when(p > 0, 100 * (F.col("close") / p - 1)).alias("roc"), F.when(p > 0, F.col("close") - p).alias("momentum"))


def williams(bars: DataFrame, n: int = 14) -> DataFrame:
    h, low = highest(n), lowest(n)
    return bars.select("isin", "d", F.when(h == low, -50.0).otherwise(-100 * (h - F.col("close")) / F.nullif(h - low, F.lit(0.0))).alias("r"))


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    b = bars.withColumn("tp", typical()).withColumn("xs", F.collect_list("tp").over(frame(n))).withColumn("m", sma(F.col("tp"), n))
    mad = F.aggregate("xs", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("m"))) / n
    b = b.withColumn("mad", mad)
    return b.select("isin", "d", F.when(F.col("m").isNotNull(), F.when(F.col("mad") == 0, 0.0).otherwise((F.col("tp") - F.col("m")) / F.nullif(0.015 * F.col("mad"), F.lit(0.0)))).alias("cci"))


def ultimate(bars: DataFrame) -> DataFrame:
    pc = prev("close")
    low = F.least("low", pc)
    b = bars.withColumn("bp", F.when(pc.isNotNull(), F.col("close") - low)).withColumn("tr", F.when(pc.isNotNull(), F.greatest("high", pc) - low))
    part = lambda n: F.try_divide(full(F.col("tr"), n, F.sum("bp").over(frame(n))), F.sum("tr").over(frame(n)))
    return b.select("isin", "d", (100 * (4 * part(7) + 2 * part(14) + part(28)) / 7).alias("uo"))


def awesome(bars: DataFrame) -> DataFrame:
    b = bars.withColumn("mp", (F.col("high") + F.col("low")) / 2)
    return b.select("isin", "d", (sma(F.col("mp"), 5) - sma(F.col("mp"), 34)).alias("ao"))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    b = bars.withColumn("mid", sma(F.col("close"), n)).withColumn("sd", full(F.col("close"), n, F.stddev_pop("close").over(frame(n))))
    up, low = F.col("mid") + k * F.col("sd"), F.col("mid") - k * F.col("sd")
    return b.select("isin", "d", "mid", up.alias("upper"), low.alias("lower"), F.try_divide(F.col("close") - low, F.nullif(up - low, F.lit(0.0))).alias("pct_b"), F.try_divide(up - low, F.col("mid")).alias("bandwidth"))


def historical_volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    b = bars.withColumn("lr", F.log(F.col("close") / prev("close")))
    return b.select("isin", "d", full(F.col("lr"), n, F.stddev_samp("lr").over(frame(n)) * 252**0.5 * 100).alias("hv"))


def donchian(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.select("isin", "d", highest(n).alias("upper"), lowest(n).alias("lower"), ((highest(n) + lowest(n)) / 2).alias("mid"))


def ulcer(bars: DataFrame, n: int = 14) -> DataFrame:
    b = bars.withColumn("xs", F.collect_list("close").over(frame(n)))
    zero = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("ss"))

    def step(a, x):
        peak = F.greatest(a["peak"], x)
        fall = 100 * (x / peak - 1)
        return F.struct(peak.alias("peak"), (a["ss"] + fall * fall).alias("ss"))

    return b.select("isin", "d", F.when(F.size("xs") == n, F.aggregate("xs", zero, step, lambda a: F.sqrt(a["ss"] / n))).alias("ulcer"))


def obv(bars: DataFrame) -> DataFrame:
    c, pc = F.col("close"), prev("close")
    b = bars.withColumn("sv", F.when(c > pc, F.col("volume")).when(c < pc, -F.col("volume")).otherwise(0.0))
    return b.select("isin", "d", F.sum("sv").over(series().rowsBetween(W.unboundedPreceding, 0)).alias("obv"))


def mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    b = bars.withColumn("tp", typical())
    b = b.withColumn("pt", prev("tp")).withColumn("flow", F.when(F.col("pt").isNotNull(), F.col("tp") * F.col("volume")))
    b = b.withColumn("pos", F.when(F.col("tp") > F.col("pt"), F.col("flow")).otherwise(0.0)).withColumn("neg", F.when(F.col("tp") < F.col("pt"), F.col("flow")).otherwise(0.0))
    p, q = (full(F.col("flow"), n, F.sum(c).over(frame(n))) for c in ("pos", "neg"))
    return b.select("isin", "d", F.when((p == 0) & (q == 0), None).when(q == 0, 100.0).otherwise(100 - 100 / (1 + p / F.nullif(q, F.lit(0.0)))).alias("mfi"))


def vwap(bars: DataFrame, n: int = 20) -> DataFrame:
    b = bars.withColumn("tv", typical() * F.col("volume"))
    return b.select("isin", "d", F.try_divide(full(F.col("tv"), n, F.sum("tv").over(frame(n))), F.nullif(F.sum("volume").over(frame(n)), F.lit(0.0))).alias("vwap"))


def cmf(bars: DataFrame, n: int = 20) -> DataFrame:
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    b = bars.withColumn("mv", F.when(h == low, 0.0).otherwise((2 * c - h - low) / F.nullif(h - low, F.lit(0.0)) * F.col("volume")))
    return b.select("isin", "d", F.try_divide(full(F.col("mv"), n, F.sum("mv").over(frame(n))), F.nullif(F.sum("volume").over(frame(n)), F.lit(0.0))).alias("cmf"))


def pvt(bars: DataFrame) -> DataFrame:
    b = bars.withColumn("x", F.coalesce(F.col("volume") * (F.col("close") / prev("close") - 1), F.lit(0.0)))
    return b.select("isin", "d", F.sum("x").over(series().rowsBetween(W.unboundedPreceding, 0)).alias("pvt"))


def eom(bars: DataFrame, n: int = 14) -> DataFrame:
    mid = (F.col("high") + F.col("low")) / 2
    b = bars.withColumn("mid", mid)
    box = F.col("volume") / 10_000 / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    b = b.withColumn("x", F.try_divide(F.col("mid") - prev("mid"), F.nullif(box, F.lit(0.0))))
    return b.select("isin", "d", sma(F.col("x"), n).alias("eom"))


def pivots(bars: DataFrame) -> DataFrame:
    """Classic pivot points of the last bar."""
    last = bars.groupBy("isin").agg(F.max_by(F.struct("high", "low", "close"), "d").alias("b"))
    h, low, c = F.col("b.high"), F.col("b.low"), F.col("b.close")
    p = (h + low + c) / 3
    return last.select("isin", p.alias("p"), (2 * p - low).alias("r1"), (2 * p - h).alias("s1"), (p + h - low).alias("r2"), (p - h + low).alias("s2"), (h + 2 * (p - low)).alias("r3"), (low - 2 * (h - p)).alias("s3"))


def fibonacci(bars: DataFrame, n: int = 120) -> DataFrame:
    """Retracements of the range of the last n bars: from the high down in an uptrend, else from the low up.

    The trend is up where the last close is not below the middle of the range.
    """
    b = bars.withColumn("k", F.row_number().over(W.partitionBy("isin").orderBy(F.desc("d")))).where(F.col("k") <= n)
    g = b.groupBy("isin").agg(F.max("high").alias("hi"), F.min("low").alias("lo"), F.max_by("close", "d").alias("c"))
    g = g.withColumn("rising", F.coalesce(F.col("c") >= (F.col("hi") + F.col("lo")) / 2, F.lit(False)))
    level = lambda r: F.when(F.col("rising"), F.col("hi") - r * (F.col("hi") - F.col("lo"))).otherwise(F.col("lo") + r * (F.col("hi") - F.col("lo")))
    return g.select("isin", "hi", "lo", "rising", *[level(r).alias(f"f{int(r * 1000)}") for r in (0.236, 0.382, 0.5, 0.618, 0.786)])


def fractals(bars: DataFrame, k: int = 5) -> DataFrame:
    """Strict highs and lows among k bars on either side."""
    before, after = series().rowsBetween(-k, -1), series().rowsBetween(1, k)
    whole = (F.count("d").over(before) == k) & (F.count("d").over(after) == k)
    hi = whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))
    lo = whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))
    b = bars.withColumn("is_high", hi).withColumn("is_low", lo)
    return b.where("is_high OR is_low").select("isin", "d", "is_high", "is_low")


def swing_levels(bars: DataFrame, k: int = 5, lookback: int = 250, most: int = 8) -> DataFrame:
    """isin, resistance (highest first) and support (lowest first): the `most` outermost distinct fractals of the last `lookback` bars."""
    recent = bars.withColumn("age", F.row_number().over(W.partitionBy("isin").orderBy(F.desc("d")))).where(F.col("age") <= lookback + k)
    found = fractals(recent, k).join(recent.select("isin", "d", "age", "high", "low"), ["isin", "d"]).where(F.col("age") <= lookback)
    levels = found.groupBy("isin").agg(F.collect_set(F.when(F.col("is_high"), F.col("high"))).alias("r"), F.collect_set(F.when(F.col("is_low"), F.col("low"))).alias("s"))
    return levels.select("isin", F.slice(F.sort_array("r", asc=False), 1, most).alias("resistance"), F.slice(F.sort_array("s"), 1, most).alias("support"))


def week52(bars: DataFrame) -> DataFrame:
    b = bars.where("close is not null").withColumn("k", F.row_number().over(W.partitionBy("isin").orderBy(F.desc("d")))).where("k <= 252")
    g = b.groupBy("isin").agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("hi"), F.min("close").alias("lo"), F.max_by("close", "d").alias("c")).where("n >= 60")
    return g.select("isin", "hi", "lo", F.try_divide(100 * (F.col("c") - F.col("lo")), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("position"))


def crosses(bars: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """Dates on which the difference of two averages changes its sign."""
    b = bars.withColumn("x", sma(F.col("close"), fast) - sma(F.col("close"), slow)).withColumn("px", prev("x"))
    return b.where("(px <= 0 AND x > 0) OR (px >= 0 AND x < 0)").select("isin", "d", F.when(F.col("x") > 0, "up").otherwise("down").alias("cross"))


# The patterns and the direction that each stands for.
CANDLES = {
    "doji": "neutral", "hammer": "bullish", "hanging_man": "bearish", "shooting_star": "bearish", "inverted_hammer": "bullish",
    "bullish_engulfing": "bullish", "bearish_engulfing": "bearish", "morning_star": "bullish", "evening_star": "bearish",
    "three_white_soldiers": "bullish", "three_black_crows": "bearish", "piercing_line": "bullish", "dark_cloud_cover": "bearish",
}


def candles(bars: DataFrame) -> DataFrame:
    """isin, d, pattern, direction: candlestick patterns by the geometry of up to three bars, from the third bar on.

    Hammers and stars depend on the trend of the closes of five bars back to now,
    of which three at least must stand.
    """
    names = ("open", "high", "low", "close")
    o, h, low, c = (F.col(x) for x in names)
    past = F.struct(*[F.lag(x, k).over(series()).alias(f"{x}{k}") for x in ("open", "close") for k in (1, 2)], F.row_number().over(series()).alias("i"))
    window = series().rowsBetween(-5, 0)
    first, n = F.first("close", ignorenulls=True).over(window), F.count("close").over(window)
    b = bars.withColumn("p", past).withColumn("up", (n >= 3) & (c > first)).withColumn("down", (n >= 3) & (c < first))
    o1, c1, o2, c2 = (F.col(f"p.{x}") for x in ("open1", "close1", "open2", "close2"))
    body, span, body1 = F.abs(c - o), h - low, F.abs(c1 - o1)
    upper, lower = h - F.greatest(o, c), F.least(o, c) - low
    green, red, green1, red1, green2, red2 = c > o, c < o, c1 > o1, c1 < o1, c2 > o2, c2 < o2
    long_lower = (span > 0) & (body > 0) & (lower >= 2 * body) & (upper <= 0.35 * body)
    long_upper = (span > 0) & (body > 0) & (upper >= 2 * body) & (lower <= 0.35 * body)
    small = (c2 != o2) & (body1 <= 0.4 * F.abs(c2 - o2))
    middle1, middle2 = (o1 + c1) / 2, (o2 + c2) / 2
    up, down = F.col("up"), F.col("down")
    rules = {
        "doji": (span > 0) & (body <= 0.1 * span),
        "hammer": long_lower & down,
        "hanging_man": long_lower & ~down,
        "shooting_star": long_upper & up,
        "inverted_hammer": long_upper & ~up,
        "bullish_engulfing": green & red1 & (c >= o1) & (o <= c1) & (body > body1),
        "bearish_engulfing": red & green1 & (o >= c1) & (c <= o1) & (body > body1),
        "morning_star": red2 & small & green & (c > middle2) & down,
        "evening_star": green1 & small & red & (c < middle2) & up,
        "three_white_soldiers": green & green1 & green2 & (c > c1) & (c1 > c2),
        "three_black_crows": red & red1 & red2 & (c < c1) & (c1 < c2),
        "piercing_line": red1 & green & (o < c1) & (c > middle1) & (c < o1),
        "dark_cloud_cover": green1 & red & (o > c1) & (c > o1) & (c < middle1),
    }
    found = F.filter(F.array(*[F.when(v, F.struct(F.lit(k).alias("pattern"), F.lit(CANDLES[k]).alias("direction"))) for k, v in rules.items()]), lambda x: x.isNotNull())
    whole = F.col("p.i") > 2
    for x in (o, h, low, c, o1, c1):
        whole = whole & x.isNotNull()
    return b.where(whole).select("isin", "d", F.inline(found))


# Recurrences: plain loops over one series, at most as long as its trading days.


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Seed: mean of the first n consecutive valid values; nulls pause."""
    out, run, value, k = np.full(len(x), np.nan), [], None, 2 / (n + 1)
    for i, v in enumerate(x):
        if np.isnan(v):
            run = [] if value is None else run
            continue
        if value is None:
            run.append(v)
            if len(run) == n:
                value = sum(run) / n
        else:
            value += k * (v - value)
        if value is not None:
            out[i] = value
    return out


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Seed: mean of the first n valid values; then previous - previous / n + value / n."""
    out, seed, value = np.full(len(x), np.nan), [], None
    for i, v in enumerate(x):
        if np.isnan(v):
            continue
        if value is None:
            seed.append(v)
            if len(seed) == n:
                value = sum(seed) / n
        else:
            value = value - value / n + v / n
        if value is not None:
            out[i] = value
    return out


def _shift(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([np.nan], x[:-1]))


def rsi(c: np.ndarray, n: int = 14) -> np.ndarray:
    d = c - _shift(c)
    up, down = wilder(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n), wilder(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(up), np.nan, np.where(down == 0, 100.0, 100 - 100 / (1 + up / down)))


def _supertrend(h, low, c, atr, k):
    """Level and direction (1 rising, -1 falling); bands follow from the first bar with an average range, which counts as rising."""
    level, side = np.full(len(c), np.nan), np.full(len(c), np.nan)
    upper, lower, rising = np.nan, np.nan, True
    for i in np.flatnonzero(~np.isnan(atr + h + low + c)):
        mid, width = (h[i] + low[i]) / 2, k * atr[i]
        first, before = np.isnan(upper), c[i - 1] if i else np.nan
        if first or mid + width < upper or before > upper:
            upper = mid + width
        if first or mid - width > lower or before < lower:
            lower = mid - width
        if not first:
            rising = c[i] >= lower if rising else c[i] > upper
        level[i], side[i] = (lower, 1.0) if rising else (upper, -1.0)
    return level, side


def _sar(h, low, step=0.02, most=0.2):
    """Stop and reverse: rising from the first bar with a range, whose low is the first stop and whose high the first extreme."""
    out, whole = np.full(len(h), np.nan), np.flatnonzero(~np.isnan(h + low))
    sar = None
    for i in whole:
        if sar is None:
            rising, sar, extreme, speed = True, low[i], h[i], step
        else:
            sar += speed * (extreme - sar)
            near = (low if rising else h)[max(0, i - 2) : i]
            near = near[~np.isnan(near)]
            if len(near):
                sar = min(sar, near.min()) if rising else max(sar, near.max())
            if h[i] > extreme if rising else low[i] < extreme:
                extreme, speed = (h[i] if rising else low[i]), min(most, speed + step)
            if low[i] < sar if rising else h[i] > sar:
                rising, sar, extreme, speed = not rising, extreme, (low[i] if rising else h[i]), step
        out[i] = sar
    return out


RECURSIVE = ("ema12", "ema26", "macd", "macd_signal", "macd_hist", "rsi14", "atr14", "plus_di", "minus_di", "adx14", "supertrend", "supertrend_side", "sar", "trix15", "tsi", "keltner_upper", "keltner_mid", "keltner_lower", "stoch_rsi_k", "stoch_rsi_d")


def _recursive(pdf: pd.DataFrame, wanted: tuple[str, ...]) -> pd.DataFrame:
    pdf = pdf.sort_values("d")
    h, low, c = (pdf[x].to_numpy(dtype=float) for x in ("high", "low", "close"))
    known: dict = {}

    def get(name):
        if name not in known:
            known.update(_compute(name, h, low, c, get))
        return known[name]

    with np.errstate(divide="ignore", invalid="ignore"):
        columns = {x: get(x) for x in wanted}
    return pd.DataFrame({"isin": pdf["isin"].to_numpy(), "d": pdf["d"].to_numpy(), **columns})


def _compute(name, h, low, c, get) -> dict:
    """The series called name, with those that come along; get gives the ones that it builds on."""
    pc = _shift(c)
    if name == "true_range":
        return {name: np.where(np.isnan(pc), np.nan, np.maximum(h - low, np.maximum(abs(h - pc), abs(low - pc))))}
    if name in ("ema12", "ema20", "ema26"):
        return {name: ema(c, int(name[3:]))}
    if name == "macd":
        return {name: get("ema12") - get("ema26")}
    if name == "macd_signal":
        return {name: ema(get("macd"), 9)}
    if name == "macd_hist":
        return {name: get("macd") - get("macd_signal")}
    if name == "rsi14":
        return {name: rsi(c)}
    if name in ("atr10", "atr14"):
        return {name: wilder(get("true_range"), int(name[3:]))}
    if name in ("plus_di", "minus_di"):
        up, down = h - _shift(h), _shift(low) - low
        moves = {"plus_di": np.where((up > down) & (up > 0), up, 0.0), "minus_di": np.where((down > up) & (down > 0), down, 0.0)}
        return {k: 100 * wilder(np.where(np.isnan(up), np.nan, v), 14) / get("atr14") for k, v in moves.items()}
    if name == "adx14":
        p, m = get("plus_di"), get("minus_di")
        return {name: wilder(100 * abs(p - m) / (p + m), 14)}
    if name in ("supertrend", "supertrend_side"):
        return dict(zip(("supertrend", "supertrend_side"), _supertrend(h, low, c, get("atr10"), 3.0), strict=True))
    if name == "sar":
        return {name: _sar(h, low)}
    if name == "trix15":
        triple = ema(ema(ema(c, 15), 15), 15)
        return {name: 100 * (triple / _shift(triple) - 1)}
    if name == "tsi":
        return {name: 100 * ema(ema(c - pc, 25), 13) / ema(ema(abs(c - pc), 25), 13)}
    if name.startswith("keltner_"):
        mid, width = get("ema20"), get("atr10")
        return {"keltner_mid": mid, "keltner_upper": mid + 2 * width, "keltner_lower": mid - 2 * width}
    r = pd.Series(get("rsi14"))
    least, most = r.rolling(14).min(), r.rolling(14).max()
    k = pd.Series(np.where(most == least, 50.0, 100 * (r - least) / (most - least))).where(most.notna()).rolling(3).mean()
    return {"stoch_rsi_k": k.to_numpy(), "stoch_rsi_d": k.rolling(3).mean().to_numpy()}


def recursive_indicators(bars: DataFrame, wanted: tuple[str, ...] = RECURSIVE) -> DataFrame:
    """The wanted recurrences of every series in one pass; one group is one series of trading days."""
    schema = "isin string, d date, " + ", ".join(f"{c} double" for c in wanted)
    got = bars.select("isin", "d", "high", "low", "close").groupBy("isin").applyInPandas(lambda pdf: _recursive(pdf, tuple(wanted)), schema)
    return got.select("isin", "d", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in wanted])


# Readings of the last bar, events and scores.


def price_pivots(bars: DataFrame, k: int = 5) -> DataFrame:
    """isin, d, i (place of the bar from 1), is_high, is_low: closes strictly beyond those of k bars on either side."""
    b = bars.select("isin", "d", F.row_number().over(series()).alias("i"), F.col("close").alias("high"), F.col("close").alias("low"))
    return fractals(b, k).join(b.select("isin", "d", "i"), ["isin", "d"])


def divergences(bars: DataFrame, rsi_of: DataFrame, lookback: int = 60) -> DataFrame:
    """isin, d, kind: where the last two pivots of the closes, at most `lookback` bars apart, go against the RSI."""
    b = bars.select("isin", "d", "close").join(rsi_of.select("isin", "d", "rsi14"), ["isin", "d"])
    found = price_pivots(bars).join(b, ["isin", "d"])
    point = F.struct("i", "d", "close", "rsi14")
    out = None
    for side, kind in (("is_low", "regular_bullish_divergence"), ("is_high", "regular_bearish_divergence")):
        last = found.where(side).withColumn("p", F.lag(point).over(W.partitionBy("isin").orderBy("i"))).groupBy("isin").agg(F.max_by(F.struct(point.alias("b"), F.col("p").alias("a")), "i").alias("x"))
        a, z = (lambda c: F.col(f"x.a.{c}")), (lambda c: F.col(f"x.b.{c}"))
        lower = (z("close") < a("close")) & (z("rsi14") > a("rsi14"))
        higher = (z("close") > a("close")) & (z("rsi14") < a("rsi14"))
        part = last.where((z("i") - a("i") <= lookback) & (lower if side == "is_low" else higher)).select("isin", z("d").alias("d"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def rsi_zone_exits(rsi_of: DataFrame) -> DataFrame:
    """isin, d, kind, direction: bars on which the RSI comes back from 70 and over or 30 and under."""
    zone = F.when(F.col("rsi14") >= 70, "overbought").when(F.col("rsi14") <= 30, "oversold").otherwise("mid")
    z = rsi_of.where("rsi14 IS NOT NULL").withColumn("zone", zone).withColumn("was", F.lag("zone").over(series()))
    return z.where("zone = 'mid' AND was <> 'mid'").select("isin", "d", F.concat(F.lit("rsi_exit_"), "was").alias("kind"), F.when(F.col("was") == "oversold", "up").otherwise("down").alias("direction"))


def technical_events(bars: DataFrame, most: int = 40) -> DataFrame:
    """isin, d, kind, direction: the last `most` events of each series: crosses, zone exits, supertrend flips and divergences."""
    lines = recursive_indicators(bars, ("macd", "macd_signal", "rsi14", "supertrend_side"))
    cross = crosses(bars).select("isin", "d", F.when(F.col("cross") == "up", "golden_cross").otherwise("death_cross").alias("kind"), F.col("cross").alias("direction"))
    m = lines.withColumn("x", F.col("macd") - F.col("macd_signal")).withColumn("px", prev("x")).where("(px <= 0 AND x > 0) OR (px >= 0 AND x < 0)")
    m = m.select("isin", "d", F.lit("macd_cross").alias("kind"), F.when(F.col("x") > 0, "up").otherwise("down").alias("direction"))
    flips = lines.where("supertrend_side IS NOT NULL").withColumn("was", prev("supertrend_side")).where("was <> supertrend_side")
    flips = flips.select("isin", "d", F.lit("supertrend_flip").alias("kind"), F.when(F.col("supertrend_side") > 0, "up").otherwise("down").alias("direction"))
    apart = divergences(bars, lines).select("isin", "d", "kind", F.when(F.contains("kind", F.lit("bullish")), "up").otherwise("down").alias("direction"))
    rows = cross.unionByName(m).unionByName(rsi_zone_exits(lines)).unionByName(flips).unionByName(apart)
    return rows.withColumn("k", F.row_number().over(W.partitionBy("isin").orderBy(F.desc("d"), "kind"))).where(F.col("k") <= most).drop("k")


def latest_readings(bars: DataFrame, least: int = 30) -> DataFrame:
    """One row for each series of at least `least` bars: its last bar with every reading that signals and scores need."""
    b = bars.withColumns({"n": F.row_number().over(series()), "prev_close": prev("close"), "sma20": sma(F.col("close"), 20), "sma50": sma(F.col("close"), 50), "sma200": sma(F.col("close"), 200), "volume_sma20": sma(F.col("volume"), 20)})
    parts = {
        "aroon": aroon(bars).select("isin", "d", F.col("up").alias("aroon_up"), F.col("down").alias("aroon_down")),
        "ichimoku": ichimoku(bars).drop("chikou"),
        "vortex": vortex(bars).select("isin", "d", F.col("plus").alias("vi_plus"), F.col("minus").alias("vi_minus")),
        "stochastic": stochastic(bars).select("isin", "d", F.col("k").alias("stoch_k")),
        "roc": roc(bars),
        "williams": williams(bars).withColumnRenamed("r", "williams_r"),
        "cci": cci(bars),
        "ultimate": ultimate(bars),
        "awesome": awesome(bars),
        "bollinger": bollinger(bars).select("isin", "d", "pct_b"),
        "obv": obv(bars).withColumn("obv_slope", F.col("obv") - prev("obv", 20)),
        "mfi": mfi(bars),
        "vwap": vwap(bars),
        "cmf": cmf(bars),
        "recursive": recursive_indicators(bars, ("ema12", "ema26", "macd", "macd_signal", "plus_di", "minus_di", "adx14", "supertrend", "supertrend_side", "sar", "trix15", "rsi14", "tsi")),
    }
    last = lambda df: df.groupBy("isin").agg(F.max_by(F.struct(*[c for c in df.columns if c != "isin"]), "d").alias("x")).select("isin", "x.*")
    out = last(b).where(F.col("n") >= least)
    for part in parts.values():
        out = out.join(last(part).drop("d"), "isin", "left")
    return out


def _sign(condition: Column) -> Column:
    return F.when(condition, 1.0).when(~condition, -1.0)


def _mean(votes: list[Column]) -> Column:
    """Mean of the votes that are not null; null without any."""
    there = F.filter(F.array(*votes), lambda v: v.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.size(there))


def composite_score(readings: DataFrame) -> DataFrame:
    """isin, composite, bias, trend, momentum, volume_score from latest_readings: votes of three kinds, weighted 40, 35 and 25."""
    c = F.col
    clip = lambda v, limit: F.when(v.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / limit)))
    top, bottom = F.greatest("span_a", "span_b"), F.least("span_a", "span_b")
    cloud = c("span_a").isNotNull() & c("span_b").isNotNull()
    trend = [
        _sign(c("close") > c("sma50")),
        _sign(c("sma50") > c("sma200")),
        _sign(c("macd") > c("macd_signal")),
        _sign(c("macd") > 0),
        F.when(c("adx14") >= 20, _sign(c("plus_di") > c("minus_di"))),
        c("supertrend_side"),
        F.when(cloud, F.when(c("close") > top, 1.0).when(c("close") < bottom, -1.0).otherwise(0.0)).otherwise(_sign(c("close") > c("kijun"))),
    ]
    momentum = [clip(c("rsi14") - 50, 25), clip(c("roc"), 15), clip(c("stoch_k") - 50, 40), clip(c("cci"), 150), clip(c("mfi") - 50, 35)]
    flow = clip(c("cmf"), 0.25)
    surge = (c("volume") / c("volume_sma20") >= 1.5) & c("prev_close").isNotNull()
    volume = [
        F.least(F.lit(1.0), F.abs(flow) * 1.5) * F.when(flow > 0, 1.0).otherwise(-1.0),
        _sign(c("close") > c("vwap")),
        F.when(surge, _sign(c("close") > c("prev_close"))),
        F.signum(c("obv_slope")),
    ]
    b = readings.select("isin", (100 * _mean(trend)).alias("t"), (100 * _mean(momentum)).alias("m"), (100 * _mean(volume)).alias("v"))
    weights = {"t": 0.40, "m": 0.35, "v": 0.25}
    total = sum((F.coalesce(c(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(c(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    b = b.withColumn("composite", F.when(weight > 0, F.bround(F.round(total / F.nullif(weight, F.lit(0.0)), 9))))
    bias = F.when(c("composite") >= 25, "bullish").when(c("composite") <= -25, "bearish").when(c("composite").isNotNull(), "neutral")
    whole = lambda k, name: F.bround(F.round(k, 9)).cast("long").alias(name)
    return b.select("isin", c("composite").cast("long").alias("composite"), bias.alias("bias"), whole("t", "trend"), whole("m", "momentum"), whole("v", "volume_score"))


def signals(readings: DataFrame) -> DataFrame:
    """isin, name, value, signal in long form from latest_readings; a reading without a value is neutral or has no signal."""
    c = F.col
    side = lambda x: F.when(x, "bullish").when(~x, "bearish")
    neutral = lambda x: F.coalesce(x, F.lit("neutral"))
    band = lambda v, bear, bull: F.when(v <= bear, "bearish").when(v >= bull, "bullish").when(v.isNotNull(), "neutral")
    high, low = F.greatest("tenkan", "kijun"), F.least("tenkan", "kijun")
    cloud = c("span_a").isNotNull() & c("span_b").isNotNull()
    both = c("tenkan").isNotNull() & c("kijun").isNotNull()
    above = both & (c("close") > high) & (~cloud | (c("close") > F.greatest("span_a", "span_b")))
    below = both & (c("close") < low) & (~cloud | (c("close") < F.least("span_a", "span_b")))
    rows = {
        **{x: (c(x), side(c("close") > c(x))) for x in ("sma20", "sma50", "sma200", "ema12", "ema26")},
        "macd": (c("macd"), neutral(side(c("macd") > c("macd_signal")))),
        "adx": (c("adx14"), neutral(F.when(c("adx14") >= 20, side(c("plus_di") > c("minus_di"))))),
        "supertrend": (c("supertrend"), side(c("supertrend_side") > 0)),
        "psar": (c("sar"), side(c("close") > c("sar"))),
        "aroon": (c("aroon_up"), neutral(F.when((c("aroon_up") > 70) & (c("aroon_up") > c("aroon_down")), "bullish").when((c("aroon_down") > 70) & (c("aroon_down") > c("aroon_up")), "bearish"))),
        "vortex": (c("vi_plus"), neutral(side(c("vi_plus") > c("vi_minus")))),
        "trix": (c("trix15"), F.when(c("trix15") == 0, "neutral").otherwise(side(c("trix15") > 0))),
        "ichimoku": (c("kijun"), F.when(above, "bullish").when(below, "bearish").otherwise("neutral")),
        "rsi_14": (c("rsi14"), band(c("rsi14"), 30, 55)),
        "roc_10": (c("roc"), neutral(side(c("roc") > 0))),
        "williams_r": (c("williams_r"), band(c("williams_r"), -80, -50)),
        "cci_20": (c("cci"), band(c("cci"), -100, 100)),
        "tsi": (c("tsi"), neutral(side(c("tsi") > 0))),
        "ultimate_osc": (c("uo"), band(c("uo"), 40, 60)),
        "awesome_osc": (c("ao"), neutral(side(c("ao") > 0))),
        "bollinger_20_2": (c("pct_b"), neutral(F.when(c("pct_b") >= 1, "bullish").when(c("pct_b") <= 0, "bearish"))),
        "mfi_14": (c("mfi"), band(c("mfi"), 20, 55)),
        "rolling_vwap_20d": (c("vwap"), neutral(side(c("close") > c("vwap")))),
        "cmf_20": (c("cmf"), band(c("cmf"), -0.05, 0.05)),
    }
    return readings.select("isin", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value"), s.alias("signal")) for k, (v, s) in rows.items()])))
