"""Portfolio analysis, rules, fundamentals, indicators and factors on small rows, with nulls and empty tables."""

import datetime as dt

import numpy as np
import pytest

from kosha.functions import classes
from kosha.operators import fleet, fundamentals, portfolio, rules, technical

LINE = "p int, isin string, company string, sector string, section string, cap string, asset_class string, rating string, weight double, yield double, maturity_date date"


def test_portfolio_analysis(spark):
    day = dt.date(2030, 1, 1)
    rows = [
        (1, "INE1", "Alpha", "Banks", "Equity", "large", "stocks", None, 40.0, None, None),
        (1, "INE2", "Beta", "Auto", "Equity", "na", "stocks", None, 20.0, None, None),  # untagged: spread over the tagged caps
        (1, "INF1", "X Liquid Fund", "", "", None, "stocks", None, 10.0, None, None),
        (1, "IN01", "GOI 2030", "SOV", None, None, "", None, 20.0, 0.07, day),
        (1, "INE3", "Gold ETF", None, None, None, "other", None, 10.0, None, None),
        (2, None, None, None, None, None, None, None, 100.0, None, None),
    ]
    frame = spark.createDataFrame(rows, LINE)
    got = {(r.p, r.block, r.label): r.value for r in portfolio.portfolio_splits(frame, "p").collect()}
    assert got[1, "asset", "stocks"] == 60 and got[1, "cap", "large"] == pytest.approx(60) and got[1, "asset", "cash_equivalents"] == 10
    assert got[1, "asset", "gold"] == 10 and got[1, "credit", "Sovereign/GSec"] == 20 and got[1, "instrument", "Govt / SDL / T-Bill"] == 20
    assert got[2, "asset", "other"] == 100 and got[1, "sector", "Banks"] == 40
    s = {r.p: r for r in portfolio.portfolio_summary(frame, "p", "2029-01-01").collect()}
    assert s[1].ytm_pct == pytest.approx(7) and s[1].debt_pct == 20 and s[1].avg_maturity_yrs == pytest.approx(365 / 365.25) and s[1].top1_pct == 40
    assert s[2].ytm_pct is None and s[2].n_debt_holdings == 0 and s[2].ytm_cover is None
    assert portfolio.portfolio_splits(frame.where("false"), "p").count() == 0


def test_asset_classes(spark):
    rows = [("Equity", "a", "INE"), (None, None, None), ("Futures", "x", ""), ("", "x", "AUG26"), ("TREPS", "", ""), ("", "ADR of x", "US12"), ("NCD", "", ""), ("", "91 day T-Bill", "")]
    frame = spark.createDataFrame(rows, "section string, company string, isin string")
    got = [r[0] for r in frame.select(classes.asset_class(frame.section, frame.company, frame.isin)).collect()]
    assert got == ["stocks", "", "future_options", "future_options", "cash_equivalents", "international", "debt", "debt"]


def test_rules_report_what_cannot_be_judged(spark):
    metrics = spark.createDataFrame([(1, "top1", 5.0), (2, "top5", None)], "p int, metric string, value double")
    listed = spark.createDataFrame([("a", "top1", "<=", 6.0), ("b", "top5", ">=", 1.0), ("c", "top1", "<=", None)], "rule string, metric string, op string, bound double")
    got = {(r.p, r.rule): r.passed for r in fleet.evaluate_rules(metrics, listed, "p").collect()}
    assert got == {(1, "a"): True, (1, "b"): None, (1, "c"): None, (2, "a"): None, (2, "b"): None, (2, "c"): None}
    c = {r.p: (r.evaluated, r.compliance_pct) for r in fleet.compliance(fleet.evaluate_rules(metrics, listed, "p"), "p").collect()}
    assert c == {1: (1, 100.0), 2: (0, None)}


def test_rules_in_text(spark):
    frame = spark.createDataFrame([(1, "Max 10% single stock. Max 20% sector. Min 30% debt. Max 5% cash. Max top-5 25%. Max scheme overlap 30%."), (2, None), (3, ""), (4, "MIN 5 schemes; minimum gold = 2.5 %")], "k int, text string")
    got = sorted((r.k, r.rule_type, r.field, r.value) for r in rules.parse_rules(frame, "k").collect())
    assert got == [(1, "max_asset", "cash_equivalents", 5.0), (1, "max_sector", "sector", 20.0), (1, "max_single_stock", "single stock", 10.0), (1, "max_top5", "top 5 concentration", 25.0), (1, "min_asset", "debt", 30.0), (4, "min_asset", "gold", 2.5), (4, "min_schemes", "schemes", 5.0)]
    assert [(r.k, r.note) for r in rules.unparsed(frame, "k").collect()] == [(1, "Max scheme overlap 30%")]


def test_fundamentals_without_items(spark):
    frame = spark.createDataFrame([("a", 2020, 100.0), ("a", 2022, 150.0), ("b", 2020, None)], "isin string, fy int, revenue_from_operations double")
    assert fundamentals.beneish(frame).count() == 0
    assert all(r.ebitda is None and r.total_debt is None for r in fundamentals.derive_items(frame).collect())
    assert all(r.issues == [] for r in fundamentals.issues(frame).collect())


def test_stop_and_reverse_starts_rising_at_the_first_bar():
    high, low = np.array([np.nan, 10.0, 11.0, 12.0, 9.0]), np.array([np.nan, 9.0, 10.0, 11.0, 5.0])
    got = technical._sar(high, low)
    assert np.isnan(got[0]) and got[1] == 9.0 and got[2] == 9.0  # held at the low of the bar before
    assert got[4] == 12.0  # reversed at the extreme


def test_supertrend_starts_rising_and_flips():
    close = np.array([100.0] * 12 + [50.0] * 3)
    high, low = close + 1, close - 1
    atr = technical.wilder(np.concatenate(([np.nan], np.full(14, 2.0))), 10)
    level, side = technical._supertrend(high, low, close, atr, 3.0)
    assert np.isnan(side[9]) and side[10] == 1 and level[10] == 94 and side[12] == -1


def test_candles(spark):
    day = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(4)]
    bars = [("a", day[0], 10.0, 11.0, 9.0, 9.5, 1.0), ("a", day[1], 9.5, 10.0, 8.0, 8.5, 1.0), ("a", day[2], 8.0, 10.2, 7.9, 10.0, 1.0), ("a", day[3], 10.0, None, 9.0, 9.0, 1.0)]
    frame = spark.createDataFrame(bars, "isin string, d date, open double, high double, low double, close double, volume double")
    assert {(r.d, r.pattern, r.direction) for r in technical.candles(frame).collect()} == {(day[2], "bullish_engulfing", "bullish")}
    assert technical.candles(frame.where("false")).count() == 0 and technical.latest_readings(frame).count() == 0
