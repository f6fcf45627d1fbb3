"""Enriched holdings, own series, movement, calendar, screens and ranks against stated rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from kosha.operators import calendar as N
from kosha.operators import factors, fleet, flows, holdings, screens

D = datetime.date


def test_hedged_and_mistaken_lines(spark):
    lines = spark.createDataFrame(
        [
            (1, "INE1", "Alpha", "Banks", "stocks", None, 5.0, 2.0, None), (1, "INE2", "Beta", "IT", "", None, 4.0, 1.0, 3.0), (1, "INE3", "Gamma", "IT", "", None, 4.0, 1.0, 2.5), (1, "INE4", "Delta", "IT", "stocks", None, 3.0, None, None),
            (1, "INE4", "6.98% Gujarat SDL (26/11/2032)", "SOV", "debt", "0.07", 6.0, None, None), (1, "INB1", "Plain bond", "CRISIL AAA", "debt", None, 2.0, None, None), (2, "INB1", "Plain bond", "", "debt", "7.5%", 2.0, None, None),
        ],
        "scheme_id int, isin string, company string, sector string, asset_class string, yield_text string, percent_nav double, pct_hedged double, pct_unhedged double",
    )
    securities = spark.createDataFrame([("INE1", "large", 1.0), ("INE2", "mid", 0.5), ("INE3", "mid", 1.0), ("INE4", "small", 1.0)], "isin string, cap string, confirmed_equity double")
    bonds = spark.createDataFrame([("INB1", 8.25, D(2030, 1, 1), "AA", 0.08)], "isin string, coupon double, maturity_date date, rating string, ytm double")
    rows = holdings.enrich_holdings(lines, securities, bonds).collect()
    got = {(r.scheme_id, r.company): r for r in rows}
    assert got[1, "Alpha"].percent_nav == 3.0 and got[1, "Beta"].percent_nav == 3.0 and got[1, "Gamma"].percent_nav == 2.5 and got[1, "Delta"].percent_raw is None
    leg = got[1, holdings.HEDGED_LEG]
    assert leg.percent_nav == 4.0 and leg.derived and leg.asset_class == "future_options" and (2, holdings.HEDGED_LEG) not in got
    loan = got[1, "6.98% Gujarat SDL (26/11/2032)"]
    assert loan.isin == "" and loan.asset_class == "debt" and loan.coupon == 6.98 and loan.maturity_date == D(2032, 11, 26) and loan.ytm == 7.0
    assert got[1, "Plain bond"].coupon == 8.25 and got[1, "Plain bond"].ytm == 8.0 and got[2, "Plain bond"].ytm == 7.5 and got[2, "Plain bond"].rating == "AA"
    s = {r.scheme_id: r for r in holdings.hedge_summary(holdings.enrich_holdings(lines, securities, bonds)).collect()}
    assert s[1].gross_equity_pct == 16.0 and s[1].net_equity_pct == 11.5 and s[1].hedged_pct == 4.0 and s[1].has_hedge and not s[2].has_hedge


def test_plans_and_benchmarks(spark):
    schemes = spark.createDataFrame([(1, "d1", "r1"), (2, "d2", "r2"), (3, None, "r3"), (4, "d4", None)], "scheme_id int, direct string, regular string")
    prices = spark.createDataFrame([("d1", D(2024, 1, 1), 1.0), ("r1", D(2024, 1, 1), 2.0), ("d2", D(2024, 1, 1), 0.0), ("r2", D(2024, 1, 1), 3.0), ("r3", D(2024, 1, 2), 4.0)], "code string, d date, nav double")
    assert sorted((r.scheme_id, r.plan, r.nav) for r in holdings.plan_series(schemes, prices).collect()) == [(1, "direct", 1.0), (2, "regular", 3.0), (3, "regular", 4.0)]
    names = [(None, "Equity", "HDFC Nifty 500 Equal Weight", "NIFTY 500 EQUAL WEIGHT"), ("nifty_it", "Debt", "x", "NIFTY IT"), (" ", "Debt", "Bank", None), (None, "equity", "Plain", "NIFTY 500"), (None, "Equity", "Axis Commodities", "NIFTY 500"), (None, None, "Bank", None)]
    frame = spark.createDataFrame([(i, *n[:3]) for i, n in enumerate(names)], "i int, a string, b string, c string")
    assert [r.x for r in frame.select("i", holdings.benchmark_of(F.col("a"), F.col("b"), F.col("c")).alias("x")).orderBy("i").collect()] == [n[3] for n in names]


def test_movement_of_a_portfolio(spark):
    """One scheme at 10, 11 and 12; 5 units were held before, 10 are bought, and a scheme without prices is left out."""
    start = D(2024, 1, 1)
    nav = spark.createDataFrame([("s", start, 10.0), ("s", D(2024, 1, 2), 11.0), ("s", D(2024, 1, 3), 12.0)], "k string, d date, nav double")
    tx = spark.createDataFrame([("p", "s", D(2024, 1, 2), 10.0, 110.0), ("p", "none", D(2024, 1, 2), 1.0, 70.0)], "p string, k string, d date, units double, amount double")
    ends = spark.createDataFrame([("p", "s", 15.0), ("p", "none", 1.0)], "p string, k string, end_units double")
    r = flows.movement(ends, tx, nav, "p", "k").first()
    assert (r.start, r.end, r.days, r.partial, r.opening_units) == (start, D(2024, 1, 3), 2, True, 5.0)
    assert r.opening_value == 50.0 and r.terminal_value == 180.0 and r.net_flow == 110.0 and r.unvalued_schemes == 1 and r.unvalued_flow == 70.0
    assert r.twr == pytest.approx(1.1 * 12 / 11 - 1) and r.annualised is None and r.xirr is None and r.artifacts == 0


def test_calendar(spark):
    frame = spark.createDataFrame([(1, D(2024, 8, 16), datetime.datetime(2024, 8, 16, 23, 0)), (2, D(2024, 8, 19), datetime.datetime(2024, 8, 19, 22, 59)), (3, D(2024, 8, 15), datetime.datetime(2024, 8, 15, 23, 30))], "i int, d date, t timestamp_ntz")
    off = ["2024-08-15"]
    got = frame.select("i", N.is_publish_day(F.col("d"), off).alias("p"), N.prev_publish_day(F.col("d"), off).alias("b"), N.expected_latest(F.col("t"), off).alias("e"), N.publish_days_between(F.lit("2024-08-13").cast("date"), F.col("d"), off).alias("n")).orderBy("i").collect()
    assert [(r.p, r.b, r.e, r.n) for r in got] == [(True, D(2024, 8, 14), D(2024, 8, 16), 2), (True, D(2024, 8, 16), D(2024, 8, 16), 3), (False, D(2024, 8, 14), D(2024, 8, 14), 1)]


def test_tickets_and_stocks(spark):
    tickets = spark.createDataFrame([("OPEN", "2024-02", 5.0, "a", "x"), ("OPEN", "2024-13", 9.0, "b", "y"), ("CLOSED", "2020-01", 0.0, "a", "z"), ("OPEN", "2024-01", None, "a", "w"), ("OPEN", "2024-02", 5.0, "a", "v")], "status string, month string, coverage_pct double, amc string, scheme string")
    assert [r.scheme for r in screens.select_tickets(tickets).collect()] == ["y", "w", "v", "x"] and [r.scheme for r in screens.select_tickets(tickets, 2).collect()] == ["y", "w"]
    securities = spark.createDataFrame([("IN1", "Alpha Industries", None), ("IN2", "Beta", "Old Alpha Name"), ("IN3", "alpha", None)], "isin string, name string, aliases string")
    items = spark.createDataFrame([(1, " in2 ", "zzz"), (2, None, "ALPHA"), (3, "", "Industries"), (4, None, "old alpha"), (5, "IN9", None), (6, None, "ph")], "id int, isin string, name string")
    assert sorted(map(tuple, screens.resolve_stocks(items, securities).collect())) == [(1, 0, "IN2"), (2, 1, "IN3"), (3, 2, "IN1"), (4, 2, "IN2")]


def test_ranks_over_slices_equal_ranks_over_all(spark):
    rows = [(str(i), c, float((i * 37) % 211 if c == "a" else i % 7)) for i in range(600) for c in ("a", "vol_252")] + [("x", "few", 1.0)] * 4
    frame = spark.createDataFrame(rows, "isin string, component string, value double").repartition(5)
    got = {(r.isin, r.component): r["rank"] for r in factors.rank_components(frame).collect()}
    assert len(got) == 1200
    for c, sign in (("a", 1), ("vol_252", -1)):
        values = [sign * v for _, k, v in rows if k == c]
        for i, k, v in rows:
            if k == c:
                assert got[i, k] == pytest.approx(100 * sum(x < sign * v for x in values) / 599)


def test_folds_pass_over_long_histories(spark):
    events = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 5 END AS u", "id AS t", "id % 11 AS v", "id % 13 = 12 AS ok").withColumn("v", F.col("v").cast("double"))
    got = {r.u: (r.observations, r.q) for r in fleet.q_values(events, "u", ["t"], "v").collect()}
    want = {}
    for i in range(30_000):
        u = 7 if i % 3 == 0 else i % 5
        n, q = want.get(u, (0, 0.0))
        want[u] = n + 1, max(0.0, round(0.8 * q + 0.2 * (i % 11), 2))
    assert got == want
    assert {r.u: r.state for r in fleet.states(events, "u", ["t"]).collect()} == {7: "MANUAL", 0: "MANUAL", 1: "MANUAL", 2: "MANUAL", 3: "MANUAL", 4: "MANUAL"}
    assert fleet.q_values(events.where("false"), "u", ["t"], "v").count() == 0
