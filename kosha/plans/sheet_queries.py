"""Queries of portfolio sheets (S22, S43, S24) with their oracles: sheets are written from holdings, then read."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.operators import sheets as S
from kosha.sources import adapters as D

from .registry import register

# One file for each nation, one sheet for each supplier, in two layouts; sections are types of parts.
_LINES = """l AS (SELECT s_nationkey AS file, l_suppkey AS sheet, p_type, p_partkey, p_name, p_brand, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, round(CAST(sum(CAST(l_extendedprice AS DOUBLE)) AS DOUBLE)) AS mv
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"""
_SECTIONS = {"ECONOMY": "Debt Instruments", "SMALL": "EQUITY & EQUITY RELATED", "MEDIUM": "(b) Unlisted", "PROMO": "Government Securities (Central/State)", "STANDARD": "Reverse Repo / TREPS", "LARGE": "MONEY MARKET"}
_LAYOUTS = [
    ["Sr No", "Name of the Instrument", "ISIN", "Rating / Industry^", "Quantity", "Market/Fair Value (Rs. in Lacs)", "% to NAV"],
    ["ISIN Code", "Company Name", "Sector", "Market Value", "Qty", "Yield", "Unhedged % to NAV"],
]


def _cells(*cs):
    return F.array(*[F.lit(c) if isinstance(c, (str, type(None))) else c for c in cs])


def _lines(spark, sf):
    part, supplier = D.read(spark, sf, "part"), D.read(spark, sf, "supplier")
    rows = D.read(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    g = rows.groupBy(F.col("s_nationkey").cast("string").alias("file"), F.col("l_suppkey").cast("string").alias("sheet"), "p_type", "p_partkey", "p_name", "p_brand")
    return g.agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.round(F.sum(F.col("l_extendedprice").cast("double"))).alias("mv"))


def _sheets(spark, sf):
    """Title, blank row, header, and for each type of part a heading, its lines and a total."""
    lines = _lines(spark, sf)
    second = F.col("sheet").cast("long") % 2 == 1
    isin = F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("IN"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("5"))).otherwise("")
    qty = F.when(F.col("p_partkey") % 3 > 0, F.format_number("quantity", 0)).otherwise("")
    mv = F.format_number("mv", 2)
    cells = F.when(second, _cells(isin, F.col("p_name"), F.col("p_brand"), mv, qty, "6.5%", "")).otherwise(_cells("1", F.concat("p_name", F.lit("\n")), isin, F.col("p_brand"), qty, mv, None))
    names = F.create_map(*[F.lit(x) for kv in _SECTIONS.items() for x in kv])
    heading = names[F.col("p_type")]
    sections = lines.groupBy("file", "sheet", "p_type").agg(F.sum("mv").alias("mv"))
    sheets = lines.groupBy("file", "sheet").agg(F.sum("mv").alias("mv"))
    total = F.format_number("mv", 2)
    row = lambda df, kind, key, c: df.select("file", "sheet", *[x if isinstance(x, F.Column) else F.lit(x) for x in kind], key.alias("key"), c.alias("cells"))
    none, ty = F.lit("").alias("t"), F.col("p_type").alias("t")
    parts = [
        row(sheets, (F.lit(0).alias("o"), none, F.lit(0).alias("p")), F.lit(0).cast("long"), _cells("Monthly Portfolio", None, "as on 31-Jan-1998")),
        row(sheets, (F.lit(1).alias("o"), none, F.lit(0).alias("p")), F.lit(0).cast("long"), _cells(None, None)),
        row(sheets, (F.lit(2).alias("o"), none, F.lit(0).alias("p")), F.lit(0).cast("long"), F.when(second, _cells(*_LAYOUTS[1])).otherwise(_cells(*_LAYOUTS[0]))),
        row(sections, (F.lit(3).alias("o"), ty, F.lit(0).alias("p")), F.lit(0).cast("long"), F.when(second, _cells(heading, None)).otherwise(_cells(None, heading, None))),
        row(lines, (F.lit(3).alias("o"), ty, F.lit(1).alias("p")), F.col("p_partkey").cast("long"), cells),
        row(sections, (F.lit(3).alias("o"), ty, F.lit(2).alias("p")), F.lit(0).cast("long"), F.when(second, _cells("Total", None, None, total)).otherwise(_cells(None, "Total", None, None, None, total))),
        row(sheets, (F.lit(4).alias("o"), none, F.lit(0).alias("p")), F.lit(0).cast("long"), F.when(second, _cells("Grand Total", None, None, total)).otherwise(_cells(None, "GRAND TOTAL", None, None, None, total))),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    n = F.row_number().over(Window.partitionBy("file", "sheet").orderBy("o", "t", "p", "key")) - 1
    return union.withColumn("n", n).select("file", "sheet", "n", "cells")


_HEADING = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SECTIONS.items()) + " END"


@register("s22_sheet_holdings", f"""WITH {_LINES}, g AS (SELECT file, sheet, sum(mv) AS nav FROM l GROUP BY ALL)
SELECT CAST(file AS VARCHAR) AS file, CAST(sheet AS VARCHAR) AS sheet, {_HEADING} AS section, p_name AS company, CASE WHEN p_partkey % 4 > 0 THEN 'IN' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '5' ELSE '' END AS isin, p_brand AS sector,
  CASE WHEN p_partkey % 3 > 0 THEN CAST(quantity AS DOUBLE) END AS quantity, mv AS market_value, nav FROM l JOIN g USING (file, sheet)""")
def s22(spark, sf):
    found = S.holdings_of_sheets(_sheets(spark, sf))
    return found.select("file", "sheet", "section", "company", "isin", "sector", S.number(F.col("quantity")).alias("quantity"), S.number(F.col("market_value")).alias("market_value"), "nav")


@register("s43_header_rows", f"""WITH {_LINES}, s AS (SELECT DISTINCT file, sheet FROM l), k AS (SELECT * FROM (VALUES (0, 'company', 1), (0, 'isin', 2), (0, 'sector', 3), (0, 'quantity', 4), (0, 'market_value', 5), (0, 'percent_nav', 6),
  (1, 'isin', 0), (1, 'company', 1), (1, 'sector', 2), (1, 'market_value', 3), (1, 'quantity', 4), (1, 'yield', 5), (1, 'unhedged_pct_nav', 6)) v(layout, kind, place))
SELECT CAST(file AS VARCHAR) AS file, CAST(sheet AS VARCHAR) AS sheet, 2 AS header_n, kind, place FROM s JOIN k ON sheet % 2 = layout""")
def s43(spark, sf):
    return S.named_columns(_sheets(spark, sf)).select("file", "sheet", "header_n", F.explode("at").alias("kind", "place"))


# Disclosures of derivatives: one sheet for each supplier, whose parts are positions in blocks by type.
_BLOCKS = {"ECONOMY": "A. Hedging Positions through Futures", "SMALL": "B. Other than Hedging Positions through Futures", "MEDIUM": "C. Hedging Position through Put Options", "PROMO": "D. Other than Hedging Positions through Options : Nil", "STANDARD": "E. Hedging Positions through swaps", "LARGE": "F. Transactions in Credit Default Swaps"}
_KINDS = {"ECONOMY": ("futures", True), "SMALL": ("futures", False), "MEDIUM": ("options", True), "PROMO": ("options", False), "STANDARD": ("swaps", True), "LARGE": ("credit_derivatives", True)}


def _disclosures(spark, sf):
    lines = _lines(spark, sf)
    titles = F.create_map(*[F.lit(x) for kv in _BLOCKS.items() for x in kv])
    sections = lines.select("file", "sheet", "p_type").distinct()
    three = F.col("p_type").isin("ECONOMY", "STANDARD")
    sign = F.when(F.col("p_partkey") % 2 == 0, -1).otherwise(1) * F.col("quantity")
    cells = F.when(three, _cells(F.col("p_name"), sign.cast("string"), F.format_number("mv", 2))).otherwise(_cells(F.col("p_brand"), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 1, F.col("quantity").cast("string")).otherwise("-"), F.when(F.col("p_partkey") % 2 == 0, F.col("quantity").cast("string")).otherwise(""), F.format_number("mv", 2)))
    head = F.when(three, _cells("Underlying", "Long / Short", "Notional Value")).otherwise(_cells("Industry", "Security", "Long", "Short", "Market Value"))
    live = lines.where("p_type <> 'PROMO'")
    rows = [
        lines.select("file", "sheet").distinct().select("file", "sheet", F.lit("").alias("t"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("key"), _cells("Derivative Disclosure", "of the month").alias("cells")),
        sections.select("file", "sheet", F.col("p_type").alias("t"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("key"), _cells(titles[F.col("p_type")], None).alias("cells")),
        sections.where("p_type <> 'PROMO'").select("file", "sheet", F.col("p_type").alias("t"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("key"), head.alias("cells")),
        live.select("file", "sheet", F.col("p_type").alias("t"), F.lit(2).alias("p"), F.col("p_partkey").cast("long").alias("key"), cells.alias("cells")),
        sections.where("p_type <> 'PROMO'").select("file", "sheet", F.col("p_type").alias("t"), F.lit(3).alias("p"), F.lit(0).cast("long").alias("key"), _cells(None, None, "1,000", "(5)").alias("cells")),
    ]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return union.withColumn("n", F.row_number().over(Window.partitionBy("file", "sheet").orderBy("t", "p", "key")) - 1).select("file", F.concat(F.lit("D"), "sheet").alias("sheet"), "n", "cells")


_KIND_ROWS = ", ".join(f"('{t}', '{k}', {str(h).lower()})" for t, (k, h) in _KINDS.items())


@register("s24_derivative_totals", f"""WITH {_LINES}, k(p_type, kind, hedging) AS (VALUES {_KIND_ROWS}), q AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN -quantity ELSE quantity END AS signed, p_type IN ('ECONOMY', 'STANDARD') AS three FROM l)
SELECT CAST(file AS VARCHAR) AS file, 'D' || sheet AS sheet, kind, hedging, p_type = 'PROMO' AS nil, count_if(p_type <> 'PROMO') AS n_positions,
  CAST(sum(CASE WHEN p_type <> 'PROMO' AND NOT three THEN mv ELSE 0 END) AS DOUBLE) AS market_value, CAST(sum(CASE WHEN three THEN mv ELSE 0 END) AS DOUBLE) AS notional, CAST(sum(CASE WHEN p_type = 'PROMO' THEN 0 ELSE signed END) AS DOUBLE) AS quantity
FROM q JOIN k USING (p_type) GROUP BY ALL""")
def s24(spark, sf):
    return S.derivative_totals(S.derivative_positions(_disclosures(spark, sf))).drop("block")
