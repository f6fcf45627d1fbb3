"""Hand-computed anchors of the analytics engines, sources and streams."""

import datetime as dt
import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kosha.operators import fixed_income, flows, merge, portfolio, series, technical
from kosha.sources import files
from kosha.streaming import nav_stream

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
D = dt.date


def test_registry_imports_without_a_session():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_xirr(spark):
    f = spark.createDataFrame([(1, D(2020, 1, 1), -100.0), (1, D(2021, 1, 1), 110.0), (2, D(2020, 1, 1), 100.0)], "p int, d date, amount double")
    got = {r.p: r.xirr for r in flows.xirr(f, "p").collect()}
    assert got[1] == pytest.approx(0.0998, abs=2e-3) and got[2] is None


def test_bond_duration(spark):
    # A day short of whole years of 365.25 days: a day more would mean one more coupon, due at once.
    rows = [("zero5", 0.0, 100 / 1.06**5, D(2025, 1, 1), 1), ("two10", 10.0, 103.5666, D(2021, 12, 31), 1), ("one8", 8.0, 100.0, D(2020, 12, 31), 1), ("more", 10.0, 103.5666, D(2022, 1, 1), 1)]
    b = spark.createDataFrame([(*r[:4], D(2020, 1, 1), r[4]) for r in rows], "isin string, coupon double, price double, maturity date, settle date, freq int")
    got = {r.isin: r for r in fixed_income.with_duration(fixed_income.with_ytm(b)).collect()}
    assert got["zero5"].modified == pytest.approx(4.717, abs=5e-3)
    assert got["two10"].macaulay == pytest.approx(1.9106, abs=5e-3) and got["two10"].modified == pytest.approx(1.7691, abs=5e-3)
    assert got["one8"].macaulay == pytest.approx(1, abs=5e-3) and got["one8"].modified == pytest.approx(0.9259, abs=5e-3)
    assert (got["two10"].n, got["more"].n) == (2, 3) and got["more"].accrued == pytest.approx(9.986, abs=1e-3)
    over = fixed_income.with_ytm(b.withColumn("price", F.lit(104.0))).where("coupon = 0").first()
    assert over.ytm == pytest.approx((100 / 104) ** (1 / over.years) - 1)  # below 0


def test_rsi_anchor():
    closes = [44.3389, 44.0902, 44.1497, 43.6124, 44.3278, 44.8264, 45.0955, 45.4245, 45.8433, 46.0826, 45.8931, 46.0328, 45.6140, 46.2820, 46.2820]
    assert technical.rsi(np.array(closes))[14] == pytest.approx(70.46, abs=0.1)


def test_averages_handle_nulls():
    x = np.array([1, np.nan, 2, 3, 4, np.nan, 5.0])
    e = technical.ema(x, 3)
    assert np.isnan(e[:4]).all() and e[4] == 3 and np.isnan(e[5]) and e[6] == 4
    w = technical.wilder(x, 3)
    assert w[3] == 2 and w[4] == pytest.approx(2 - 2 / 3 + 4 / 3)


def test_series_gates(spark):
    rows = [("s", D(2020, 1, 1) + dt.timedelta(days=i), 100.0 + i) for i in range(20)] + [("s", None, 5.0)]
    n = series.clean_series(spark.createDataFrame(rows, "k string, d date, nav double"), "k", ["nav"])
    r = series.risk(n, "k").first()
    assert r.volatility is None and r.risk_unavailable == "too few points" and n.count() == 20
    assert series.max_drawdown(n, "k").first().max_drawdown == 0


def test_opening_units(spark):
    ends = spark.createDataFrame([("a", 1000.0)], "k string, end_units double")
    tx = spark.createDataFrame([("a", 500.0), ("a", -200.0)], "k string, units double")
    assert flows.opening_units(ends, tx, ["k"]).first().opening == 700


def test_look_through_keeps_weights(spark):
    items = spark.createDataFrame([(1, "A", 60.0), (1, "x", 40.0)], "portfolio int, isin string, weight double")
    units = spark.createDataFrame([("A", "B", 50.0), ("A", "y", 50.0), ("B", "A", 30.0), ("B", "z", 70.0)], "fund string, isin string, weight double")
    got = {r.isin: r.weight for r in portfolio.look_through(items, units).collect()}
    assert sum(got.values()) == pytest.approx(100) and got == pytest.approx({"x": 40, "y": 30, "A": 9, "z": 21})


def test_by_priority(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted(tuple(r)[:2] for r in merge.by_priority([a, b], ["k"]).collect()) == [(1, "a"), (2, "b")]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"amc": "X", "as_of": "2024", "schemes": {"F": {"holdings": [{"company": "c", "isin": "i", "percent_nav": "1,234.5%"}]}}}))
    assert files.scheme_documents(spark, str(tmp_path / "a.json")).first().percent_nav == 1234.5
    (tmp_path / "n.txt").write_text("101;;;;12.5;;;01-Jan-2024\nHeader\nx;;;;1;;;01-Jan-2024\n102;;;;n/a;;;01-Jan-2024\n")
    assert [r.code for r in files.nav_report(spark, str(tmp_path / "n.txt")).collect()] == ["101"]
    (tmp_path / "p.csv").write_text("ISIN,TIMESTAMP,OPEN,HIGH,LOW,CLOSE,TOTTRDQTY,SERIES\nA,01-Jan-2024,1,2,1,2,10,EQ\nB,01-Jan-2024,1,2,1,2,10,GB\n")
    assert [(r.isin, r.d) for r in files.price_days(spark, str(tmp_path / "p.csv")).collect()] == [("A", D(2024, 1, 1))]
    both = tmp_path / "both"
    both.mkdir()
    (both / "old.csv").write_text((tmp_path / "p.csv").read_text())
    (both / "new.csv").write_text("TradDt,TckrSymb,ISIN,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol\n2024-07-08,S,C,EQ,3,4,3,4,5\n2024-07-08,S,E,EQ,3,4,3,0,5\n")
    assert sorted((r.isin, r.d, r.close) for r in files.price_days(spark, str(both)).collect()) == [("A", D(2024, 1, 1), 2.0), ("C", D(2024, 7, 8), 4.0)]
    (tmp_path / "w.json").write_text(json.dumps({"NIFTY": {"ine1 ": 5, "RELIANCE": 7.5, "bad": "x"}, "EMPTY": {}}))
    assert sorted(map(str, (tuple(r) for r in files.index_weights(spark, str(tmp_path / "w.json")).collect()))) == ["('NIFTY', 'INE1', None, 5.0)", "('NIFTY', None, 'RELIANCE', 7.5)"]


def test_upsert_stream_equals_batch(spark, tmp_path):
    drops = tmp_path / "in"
    drops.mkdir()
    for k in range(3):
        lines = [{"scheme_id": i, "d": "2024-01-01", "nav": 10.0 * k + i, "received": f"2024-01-0{k + 1}T00:00:00"} for i in range(k, 4)]
        (drops / f"{k}.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    stream = nav_stream.read_drops(spark, str(drops), files=1)
    nav_stream.upsert_revisions(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = sorted((r.scheme_id, r.nav) for r in nav_stream.versions(spark, str(tmp_path / "t")).collect())
    assert got == [(0, 0.0), (1, 11.0), (2, 22.0), (3, 23.0)]


def test_plans_stay_in_the_jvm(spark):
    import __spark_entry__

    for name in ("a13_series_analytics", "i25_bollinger", "j06_overlap_matrix"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "ReadSchema" in plan
    assert F is not None
