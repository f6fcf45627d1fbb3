"""Names, subjects and headings of documents; sheets of two layouts; yearly tables: against stated rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from kosha.functions import documents as X
from kosha.functions import text as T
from kosha.operators import annual_table as A
from kosha.operators import sheets as S


def applied(spark, values, f):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in frame.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


NAMES = {
    "Alpha Fund - Direct (G)": ("Alpha Fund", "Alpha Fund"),
    "Alpha Fund-Direct": ("Alpha Fund", "Alpha Fund-Direct"),
    "Multi-Income": ("Multi-Income", "Multi-Income"),
    "Beta Equity:Growth Plan": ("Beta Equity:Growth Plan", "Beta Equity:Growth"),
    "Beta  Fund - Regular Plan - Monthly IDCW": ("Beta  Fund - Regular Plan - Monthly IDCW", "Beta Fund"),
    "Gamma Fund (An open ended scheme of long wording)": ("Gamma Fund", "Gamma Fund (An open ended scheme of long wording)"),
    "Gamma Fund (Series 3)": ("Gamma Fund (Series 3)", "Gamma Fund (Series 3)"),
    "Direct": ("Direct", ""),
    " Plain ": ("Plain", "Plain"),
    "Delta Fund – Reg (IDCW) - Growth": ("Delta Fund", "Delta Fund"),
}


def test_plans_are_stripped(spark):
    assert applied(spark, list(NAMES), T.strip_plan) == [a for a, _ in NAMES.values()]
    got = dict(zip(NAMES, applied(spark, list(NAMES), T.strip_plan_navall), strict=True))
    for name in ("Alpha Fund-Direct", "Multi-Income", "Gamma Fund (Series 3)", "Direct", " Plain ", "Beta  Fund - Regular Plan - Monthly IDCW"):
        assert got[name] == NAMES[name][1], name
    assert got["Beta Equity:Growth Plan"] == "Beta Equity:Growth" and got["Alpha Fund - Direct (G)"] == "Alpha Fund"
    assert applied(spark, ["Beta Equity:Growth Plan", None], T.canon_name) == ["betaequitygrowthplan", None]


HEADINGS = {
    "Beta Fund\nAn open ended scheme": "Beta Fund",
    "Beta Fund (An open ended equity scheme)": "Beta Fund",
    "Beta Fund (G)": "Beta Fund (G)",
    "HSBC FLEXI CAP FUND 31 JUL 2026": "HSBC FLEXI CAP FUND",
    "Portfolio of Kotak Nifty 50 ETF as on 31-Jul-2026": "Kotak Nifty 50 ETF",
    "portfolio of Kotak Nifty 50 ETF": "Kotak Nifty 50 ETF",
    "Kotak as on the move": "Kotak as on the move",
    "IB21-Groww Nifty Fund - ": "Groww Nifty Fund",
    "UTI CHILDREN 039 S Fund": "UTI CHILDREN'S Fund",
    "": "",
    None: "",
    "X": "X",
}


def test_headings_of_documents(spark):
    assert applied(spark, list(HEADINGS), T.clean_scheme_text) == list(HEADINGS.values())


# Subjects as they are announced, misprints included: dividend, shares after for one before.
SUBJECTS = {
    "Dividend - Rs 13 Per Share": (13.0, None),
    "Interim Dividend Rs.8/- Per Share": (8.0, None),
    "Agm/Div-Rs.5/- Per Share": (5.0, None),
    "Interim Dividend - 14.50 Per Share": (14.5, None),
    "Annual General Meeting/Dividend Rs:- 6.50/- Per Share": (6.5, None),
    "Annual General Meeting/Dividend - Rs 62..50/- Per Share": (62.5, None),
    "Dividend - Rs 0 .70 Per Share": (0.7, None),
    "Dividend Rs - 26 Pr Share": (26.0, None),
    "Dividend Re 1 Pershare": (1.0, None),
    "Final Dividend - Rs 3 Per Equity Share": (3.0, None),
    "Agm/Dividend - 100%": (None, None),
    "Distribution - Rs 2 Per Unit Consists Of Rs 1.70 Per Unit As Interest": (None, None),
    "Annual General Meeting/Dividend - Rs  Per Share": (None, None),
    "Buy Back": (None, None),
    "": (None, None),
    None: (None, None),
    "Bonus 1:1": (None, 2.0),
    "Bonus 2:5": (None, 1.4),
    "Bonus- 1:2": (None, 1.5),
    "Bonus 1 : 1": (None, 2.0),
    "Annual General Meeting/Dividend - Rs 2.50 Per Share/Bonus 1:10 (Revised)": (2.5, 1.1),
    "Scheme Of Arrangement - Bonus Debentures 6:1": (None, None),
    "Scheme Of Arangement- Bonus - 1 Debenture For 1 Equity Share Held": (None, None),
    "Sch Of Agmt- Bonus Deb1:1": (None, None),
    "Bonus Ncrps 1:116": (None, None),
    "Bonus Preference Shares 21:1": (None, None),
    "Bonus 1 : 1250": (None, None),
    "Face Value Split (Sub-Division) - From Rs 10/- Per Share To Re 1/- Per Share": (None, 10.0),
    "Face Value Split From Rs.10/- To Rs.2/-": (None, 5.0),
    "Stock Split - From Rs 10 To Rs 5": (None, 2.0),
    "Face Value Split From Rs.5/- To Rs.2/-": (None, 2.5),
    "Fv Splt Frm Rs 10 To Rs 2": (None, 5.0),
    "Fv Split Rs.10/- To Rs.2/": (None, 5.0),
    "Fv Split Rs.10/- To Re.1/Record Date Revised": (None, 10.0),
    "Bonus 1:1 And Face Value Split Rs.10/- To Rs.5/- Per Share": (None, 4.0),
    "Interim Div - Rs 6/- Per Share + Face Value Split (Sub-Division) - From Rs 10/- Per Share To Re 1/- Per Share": (6.0, 10.0),
    "Stock Split Rs 10/- Rs 2/- Dividend Rs 5 Per Share": (None, 5.0),
    "Face Value Split From Rs 10 To Rs 2 Dividend Rs 5 Per Share": (5.0, 5.0),
    "Interim Dividend Rs 11 Per Share/ Special Dividend Rs 46 Per Share": (57.0, None),
    "Dividend-Rs.8.50 Per Share (Including Special Dividend Of Rs.2/- Per Share).": (8.5, None),
    "Scheme Of Demerger": (None, None),
}


def test_subjects_of_corporate_actions(spark):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(SUBJECTS)], "i int, s string")
    got = frame.select("i", *[v.alias(k) for k, v in X.subject_events(F.col("s")).items()]).orderBy("i").collect()
    for r, (subject, (dividend, split)) in zip(got, SUBJECTS.items(), strict=True):
        assert r.dividend == dividend and (r.split is None) == (split is None) and (split is None or r.split == pytest.approx(split)), (subject, r)


def test_bond_texts(spark):
    assert applied(spark, ["7.25% 2031", "GOI FRB 7.2% 2031", "plain", None, "8 % x 9%"], X.coupon) == [7.25, None, None, None, 8.0]
    assert applied(spark, ["Half-yearly", "SEMI annual", "2", "Quarterly", "4x", "monthly", "12", "Yearly", "annual", "1", "6", "0", "none", "", None, "x"], X.payments_a_year) == [2, 2, 2, 4, 4, 12, 12, 1, 1, 1, 6, None, None, None, None, None]


def sheet_rows(spark, sheets):
    rows = [("f", name, n, cells) for name, lines in sheets.items() for n, cells in enumerate(lines)]
    return spark.createDataFrame(rows, "file string, sheet string, n int, cells array<string>")


TWO = {
    "A": [
        ["Portfolio as on 31-Jan-2026"], [], ["", "Name of the\nInstrument", "ISIN", "Rating / Industry^", "Quantity", "Market/Fair Value", "% to NAV"],
        [None, "EQUITY & EQUITY RELATED", None], [None, "(a) Listed / awaiting listing", ""], ["1", "Alpha Ltd", "INE001A01036", "Banks", "1,000", "12.5", "1.2"], ["2", "Beta Ltd", "", "IT", "5", "", ""],
        ["", "Total", "", "", "", "12.5", "1.2"], ["", "", "", "", "", "", ""], ["", "Reverse Repo / TREPS", "", "", "", "", ""], ["", "Treps", "", "", "", "(3.5)", "0.1"], ["", "Net something", "", "", "", "7", "0.2"], ["", "A name alone"], ["", "GRAND TOTAL", "", "", "", "1,000.5", "100"],
    ],
    "B": [["ISIN Code", "Issuer", "Coupon (%)", "Qty", "Yield to Maturity", "Market value (Rs in Lakh)"], ["DEBT INSTRUMENTS", "", "", "", "", ""], ["INE002A07AB9", "Gamma NCD", "7.5", "10", "8.1", "100"], ["Total", "", "", "", "", "100"]],
    "C": [["nothing", "here"], ["x", "y"]],
}


def test_sheets_of_two_layouts(spark):
    rows = sheet_rows(spark, TWO)
    named = {r.sheet: (r.header_n, r["at"]) for r in S.named_columns(rows).collect()}
    assert named["A"] == (2, {"company": 1, "isin": 2, "sector": 3, "quantity": 4, "market_value": 5, "percent_nav": 6})
    assert named["B"] == (0, {"isin": 0, "company": 1, "coupon": 2, "quantity": 3, "yield": 4, "market_value": 5})
    got = {(r.sheet, r.company): r for r in S.holdings_of_sheets(rows).collect()}
    assert set(got) == {("A", "Alpha Ltd"), ("A", "Beta Ltd"), ("A", "Net something"), ("B", "Gamma NCD")}
    assert got["A", "Alpha Ltd"].section == "(a) Listed / awaiting listing" and got["A", "Net something"].section == "Treps" and got["B", "Gamma NCD"].section == "DEBT INSTRUMENTS"
    assert got["A", "Alpha Ltd"].nav == 1000.5 and got["B", "Gamma NCD"].nav is None and got["B", "Gamma NCD"].coupon == "7.5"
    assert S.holdings_of_sheets(rows.where("false")).count() == 0


def test_numbers_of_cells(spark):
    assert applied(spark, ["1,234.5", "(5)", "₹ 7", "8%", "n/a", "-", "", None, "1e3", "abc", ".5", "(x)"], S.number) == [1234.5, -5.0, 7.0, 8.0, None, None, None, None, 1000.0, None, 0.5, None]


def test_blocks_of_derivatives(spark):
    rows = sheet_rows(spark, {
        "DerivativeX": [
            ["Disclosure regarding Derivatives", "", "of the month"], ["A. Hedging Positions through Futures as on today"], ["Scheme", "Underlying", "Long / Short", "Current price", "Margin maintained"], ["X1", "Nifty Index", "-75", "24,000", "10"], ["X1", "Bank Nifty", "25", "", ""],
            ["", "", "", "99", "1"], ["Total number of contracts", "notional", "profit"], ["B. Other than Hedging Positions through Options : Nil"], ["Total %age of existing assets hedged through futures", "4.5%"], ["C. Hedging position through swaps", ""], ["no", "header", "5"], ["7", "8"],
        ],
        "Other": [["A. Hedging Positions through Futures as on today"], ["Underlying", "Long"], ["Nifty", "5"]],
    })
    got = S.derivative_positions(rows).orderBy("sheet", "block", "n").collect()
    assert [(r.kind, r.hedging, r.nil, r.role, r.underlying, r.quantity, r.side) for r in got] == [
        ("futures", True, False, "position", "Nifty Index", -75.0, "short"), ("futures", True, False, "position", "Bank Nifty", 25.0, "long"), ("futures", True, False, "subtotal", None, None, None),
        ("options", False, True, None, None, None, None), ("swaps", True, False, "subtotal", None, None, None),
    ]
    totals = {r.kind: r.n_positions for r in S.derivative_totals(S.derivative_positions(rows)).collect()}
    assert totals == {"futures": 2, "options": 0, "swaps": 0}


def statement(fy, **items):
    return {"isin": "A", "fy": fy, "end": datetime.date(fy, 3, 31), **{k: float(v) if v is not None else None for k, v in items.items()}}


def frame(spark, rows):
    keys = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {"isin": "string", "fy": "int", "end": "date", "q": "int", "audit": "string", "derived": "boolean"}
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], ", ".join(f"`{k}` {kinds.get(k, 'double')}" for k in keys))


def test_yearly_table_and_checks(spark):
    years = [statement(2018 + i, revenue_from_operations=100 * 1.1**i, pat=10 * 1.1**i, total_assets=200, total_equity=100 + 10 * i, total_liabilities=100 - 10 * i, cfo=None if i == 6 else 12, capex=5, finance_costs=2, pbt=13, eps_basic=1 + i, total_current_assets=30, total_current_liabilities=0) for i in range(7)]
    quarters = frame(spark, [statement(2024, revenue_from_operations=40, q=q) | {"q": q, "end": datetime.date(2024, q * 3, 1), "audit": "Audited", "derived": False} for q in (1, 2, 4)] + [{"isin": "B", "fy": 2024, "q": 1, "end": datetime.date(2024, 1, 1), "revenue_from_operations": 5.0, "audit": None, "derived": True}])
    table = A.annual_table(frame(spark, [*years, years[-1]]), quarters)
    rows = {(r.isin, r.fy): r for r in table.collect()}
    assert sorted(rows) == [("A", y) for y in range(2020, 2025)] + [("B", 2024)] and rows["B", 2024].period == "Q"
    r = rows["A", 2021]
    assert r.revenue_yoy_pct == pytest.approx(10.0) and r.roe_pct == pytest.approx(round(10 * 1.1**3 / 125 * 100, 2)) and r.current_ratio is None and r.interest_coverage == 7.5 and r.fcf_cr == 7.0 and r.net_margin_pct == 10.0
    assert rows["A", 2020].revenue_yoy_pct is None and rows["A", 2020].roe_pct == pytest.approx(round(12.1 / 120 * 100, 2))
    checks = {r.isin: r for r in A.consistency_checks(table, quarters).collect()}
    assert (checks["A"].assets_equal_equity_plus_liabilities, checks["A"].growth_chain_revenue, checks["A"].margin_identity, checks["A"].annual_matches_quarter_sum, checks["A"].ebitda_bridge) == (True, True, True, None, None)
    warnings = {r.isin: r.warnings for r in A.table_warnings(table, frame(spark, [{"isin": "A", "pat": 1.0, "revenue_from_operations": 100.0}])).collect()}
    assert warnings["A"] == ["Cash-flow items missing for 2024.", "The trailing net margin is more than 5 points from that of the last year."] and warnings["B"][0].startswith("Only 1")
    grid = A.quarterly_grid(quarters).where("isin = 'A'").orderBy("q").collect()
    assert [(g.q, g.revenue_from_operations, g.audit) for g in grid] == [(1, 40.0, "Audited"), (2, 40.0, "Audited"), (3, None, None), (4, 40.0, "Audited")]
    snapshot = A.snapshot(frame(spark, years), quarters, frame(spark, [{"isin": "A", "eps": 2.0, "dps": 1.0, "pat": 20.0, "cfo": 10.0, "revenue_from_operations": 100.0}]), frame(spark, [{"isin": "A", "total_equity": 50.0, "total_debt": 25.0, "cash_equivalents": None}]))
    s = {r.isin: r for r in snapshot.collect()}
    assert s["A"].accruals == pytest.approx(0.2) and s["A"].leverage == 0.5 and s["A"].bvps is None and len(s["A"].roe_series) == 5 and s["B"].roe_series == []
