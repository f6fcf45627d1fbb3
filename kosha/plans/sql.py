"""DuckDB twins of kosha.sources.adapters, as common table expressions."""

R = "avg((CAST(l_discount AS DOUBLE) - 0.05) * 0.4) + 0.0004"
NAV = f"""nr AS (SELECT l_suppkey AS scheme_id, CAST(l_shipdate AS DATE) AS d, {R} AS r FROM lineitem GROUP BY ALL),
nav AS (SELECT scheme_id, d, 100 * exp(sum(ln(1 + r)) OVER (PARTITION BY scheme_id ORDER BY d)) AS nav FROM nr)"""
BENCH = f"""br AS (SELECT CAST(l_shipdate AS DATE) AS d, {R} AS r FROM lineitem GROUP BY ALL),
bench AS (SELECT d, 100 * exp(sum(ln(1 + r)) OVER (ORDER BY d)) AS nav FROM br)"""


def bars(by: str = "p_type") -> str:
    return f"""pr AS (SELECT {by} AS isin, CAST(l_shipdate AS DATE) AS d, {R} AS r, max(CAST(l_tax AS DOUBLE)) AS up, min(CAST(l_tax AS DOUBLE)) AS down, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
pc AS (SELECT *, 100 * exp(sum(ln(1 + r)) OVER (PARTITION BY isin ORDER BY d)) AS close FROM pr),
po AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY isin ORDER BY d), close) AS open FROM pc),
bars AS (SELECT isin, d, open, greatest(open, close) * (1 + up / 4) AS high, least(open, close) * (1 - down / 4) AS low, close, volume FROM po)"""


SECURITIES = """securities AS (SELECT p_partkey AS isin, p_name AS name, p_brand AS sector, CASE WHEN p_size <= 15 THEN 'large' WHEN p_size <= 35 THEN 'mid' ELSE 'small' END AS cap, p_type AS section,
  CASE p_partkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END AS confirmed_equity, CAST(p_partkey % 7 AS INTEGER) AS source_count FROM part)"""
SCHEMES = """schemes AS (SELECT s_suppkey AS scheme_id, s_name AS fund_name, n_name AS amc, r_name AS category, CASE WHEN s_suppkey % 17 <> 0 THEN CAST(s_acctbal AS DOUBLE) END AS aum
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
HOLDINGS = """hm AS (SELECT l_suppkey AS scheme_id, l_partkey AS isin, sum(CAST(l_extendedprice AS DOUBLE)) AS market_value FROM lineitem GROUP BY ALL),
holdings AS (SELECT *, 100 * market_value / sum(market_value) OVER (PARTITION BY scheme_id) AS weight FROM hm)"""
TRANSACTIONS = """tx AS (SELECT o_custkey AS portfolio_id, o_orderkey AS tx_id, CAST(o_orderdate AS DATE) AS d,
  CASE o_orderpriority[1] WHEN '1' THEN 'Purchase' WHEN '2' THEN 'SIP' WHEN '3' THEN 'Redemption' WHEN '4' THEN 'Switch In' WHEN '5' THEN 'Dividend Payout' END AS tx_type, CAST(o_totalprice AS DOUBLE) AS amount FROM orders)"""
STATEMENTS = """sr AS (SELECT l_suppkey AS isin, CASE WHEN month(l_shipdate) >= 4 THEN year(l_shipdate) + 1 ELSE year(l_shipdate) END AS fy, (month(l_shipdate) + 8) % 12 // 3 + 1 AS q,
  CAST(l_extendedprice AS DOUBLE) AS g, CAST(l_discount AS DOUBLE) AS di, CAST(l_tax AS DOUBLE) AS t, CAST(l_quantity AS DOUBLE) AS qty FROM lineitem),
sg AS (SELECT isin, fy, q, sum(g * (1 - di)) AS revenue, sum(g * 0.6) AS expenses, sum(g * t) AS tax, sum(qty) AS quantity FROM sr GROUP BY ALL),
statements AS (SELECT *, last_day(make_date(CASE WHEN q = 4 THEN fy ELSE fy - 1 END, CASE WHEN q = 4 THEN 3 ELSE q * 3 + 3 END, 1)) AS "end", revenue - expenses - tax AS pat FROM sg)"""
BONDS = """bonds AS (SELECT p_partkey AS isin, p_name AS name, CASE WHEN p_partkey % 11 = 0 THEN 0.0 ELSE 4.0 + p_size / 10.0 END AS coupon, 80.0 + p_partkey % 41 + CAST(p_retailprice AS DOUBLE) / 1000 AS price,
  CAST(DATE '2002-01-01' + CAST(200 + p_partkey * 37 % 5000 AS INTEGER) AS DATE) AS maturity, DATE '2002-01-01' AS settle, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS freq, p_type AS segment FROM part)"""
