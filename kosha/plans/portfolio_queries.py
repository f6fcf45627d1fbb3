"""Queries of holding classes (N), portfolio and debt analysis (G) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.functions import classes as K
from kosha.operators import portfolio as P
from kosha.operators import rules as R
from kosha.sources import adapters as D

from .registry import register

# Texts of the lines, dealt by number: sections, names, sectors, identifiers and ratings as disclosures have them.
SECTIONS = ["Equity & Equity related", "Treasury Bills", "Certificate of Deposit", "NCD & Bonds", "Index Futures", "TREPS / Reverse Repo", "Foreign Equity", "Commercial Paper", "", "Units of Mutual Funds", "Net Receivables", "Preference Shares", "State Government SDL"]
NAMES = ["Alpha Industries Ltd", "7.26% GOI (14/01/2029)", "Bank CD 91 day", "8.5% Beta Finance NCD (30/06/2026)", "NIFTY Future Aug", "Gold Exchange Traded Fund", "Gamma Liquid Fund", "Delta Overnight Fund", "Epsilon CP", "Zeta Motors Ltd", "182 Day T-Bill", "Put option strike 100", "Eta 6.1 % Bonds (01/02/2031)", "Theta REIT", "Tri-party Repo", "Iota Savings"]
SECTORS = ["Banks", "CRISIL AAA", "SOV", "IND AA+", "Auto", "ICRA A1+", "", "Unrated", "Software", "CARE BBB"]
ISINS = ["INE", "US0", "INF", "IN0", "AUG26", "LU1", ""]
RATINGS = [None, "CRISIL AA", "", "NR", "ICRA A+", "SOVEREIGN", "BB", "XX-LONG-NAME"]


def _pick(values, key, step):
    return F.get(F.array(*[F.lit(v) for v in values]), F.expr(f"cast(pmod(({key} * {step}) div 7 + {key}, {len(values)}) as int)"))


def lines(spark, sf):
    """isin_key, isin, company, section, sector, cap, rating, yield_text, confirmed_equity of one line for each part."""
    p = D.read(spark, sf, "part").withColumn("k", F.col("p_partkey"))
    isin = _pick(ISINS, "k", 3)
    return p.select(
        F.col("k").alias("key"), F.when(isin == "AUG26", isin).otherwise(F.concat(isin, F.lpad(F.col("k").cast("string"), 9, "0"))).alias("isin"), _pick(NAMES, "k", 5).alias("company"), _pick(SECTIONS, "k", 2).alias("section"), _pick(SECTORS, "k", 4).alias("sector"),
        F.when(F.col("p_size") <= 10, "large").when(F.col("p_size") <= 20, "Mid").when(F.col("p_size") <= 30, "small").when(F.col("p_size") <= 35, "sme").when(F.col("p_size") <= 40, "ipo").otherwise("na").alias("cap"), _pick(RATINGS, "k", 6).alias("rating"),
        F.when(F.col("k") % 4 != 0, F.concat((F.col("k") % 900 / 100).cast("string"), F.when(F.col("k") % 3 == 0, F.lit("%")).otherwise(F.lit("")))).alias("yield_text"), F.when(F.col("k") % 4 == 1, 1.0).when(F.col("k") % 4 == 2, 0.5).when(F.col("k") % 4 == 3, 0.0).alias("confirmed_equity"),
    )


def _list(values):
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values, step):
    return f"{_list(values)}[CAST((k * {step} // 7 + k) % {len(values)} + 1 AS INTEGER)]"


LINES = f"""ln AS (SELECT k AS key, CASE WHEN i = 'AUG26' THEN i ELSE i || lpad(CAST(k AS VARCHAR), 9, '0') END AS isin, * EXCLUDE (i) FROM (SELECT p_partkey AS k, {_sql_pick(ISINS, 3)} AS i, {_sql_pick(NAMES, 5)} AS company, {_sql_pick(SECTIONS, 2)} AS section, {_sql_pick(SECTORS, 4)} AS sector,
  CASE WHEN p_size <= 10 THEN 'large' WHEN p_size <= 20 THEN 'Mid' WHEN p_size <= 30 THEN 'small' WHEN p_size <= 35 THEN 'sme' WHEN p_size <= 40 THEN 'ipo' ELSE 'na' END AS cap, {_sql_pick(RATINGS, 6)} AS rating, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 900 / 100 END AS ytm, CASE p_partkey % 4 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.0 END AS confirmed FROM (SELECT *, p_partkey AS k FROM part)))"""


def _has(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_FOREIGN = "regexp_matches(isin, '^(" + "|".join(K.FOREIGN) + ")')"
_ASSET = f"""CASE WHEN regexp_matches(isin, '^[A-Z]{{3}}[0-9]{{2}}$') OR {_has('lower(section)', K.DERIVATIVE_SECTION)} OR regexp_matches(lower(company), 'future|((\\bcall\\b|\\bput\\b)\\s+option)|\\boptions?\\b\\s*(trading|book)|\\bf&o\\b|\\bstrike\\b') THEN 'future_options'
  WHEN {_has('lower(section)', K.CASH_SECTION)} THEN 'cash_equivalents' WHEN {_FOREIGN} OR {_has('lower(section)', K.FOREIGN_SECTION)} THEN 'international' WHEN {_has('lower(section)', K.DEBT_SECTION)} OR {_has('lower(company)', K.DEBT_NAME)} THEN 'debt' WHEN {_has('lower(section)', K.EQUITY_SECTION)} THEN 'stocks' ELSE '' END"""
_REFINED = f"CASE WHEN asset <> '' THEN asset WHEN regexp_matches(isin, '^[A-Z]{{3}}[0-9]{{2}}$') THEN 'future_options' WHEN {_FOREIGN} THEN 'international' WHEN confirmed > 0 THEN 'stocks' WHEN confirmed = 0 THEN 'debt' ELSE 'other' END"


def _classed(spark, sf):
    c = F.col
    found = lines(spark, sf).withColumn("found", K.asset_class(c("section"), c("company"), c("isin")))
    return found.withColumn("asset_class", K.refine_asset_class(c("found"), c("confirmed_equity"), c("isin")))


CLASSED = f"{LINES}, c0 AS (SELECT *, {_ASSET} AS asset FROM ln), cl AS (SELECT *, {_REFINED} AS asset_class FROM c0)"


@register("n10_n11_asset_class", f"WITH {CLASSED} SELECT key, asset AS found, asset_class FROM cl")
def n10(spark, sf):
    return _classed(spark, sf).select("key", "found", "asset_class")


_TEXT = "lower(company || ' ' || sector)"
_CAP = f"""CASE WHEN asset_class = 'debt' OR {_has(_TEXT, K.DEBT_WORDS)} OR regexp_matches({_TEXT}, '\\b(cp|cd)\\b') THEN 'debt' WHEN regexp_matches(lower(company), '\\b(fund|etf)\\b') OR starts_with(isin, 'INF') THEN 'fund units' WHEN lower(cap) IN ('large', 'mid', 'small', 'ipo') THEN lower(cap) WHEN lower(cap) IN ('sme', 'microcap') THEN 'microcap' ELSE 'unclassified' END"""
_R = "coalesce(nullif(trim(upper(coalesce(rating, ''))), ''), nullif(regexp_extract(upper(sector), 'AAA|AA\\+?|A1\\+?|A\\+?|BBB\\+?|BB\\+?|B\\+?'), ''), nullif(regexp_extract(upper(section), 'AAA|AA\\+?|A1\\+?|A\\+?|BBB\\+?|BB\\+?|B\\+?'), ''), '')"
_ALL = "upper(section || ' ' || sector || ' ' || company)"
_CREDIT = f"""CASE WHEN {_R} IN ('', 'NA', '-', 'UNRATED', 'NR') THEN CASE WHEN {_has(_ALL, K.SOVEREIGN_TEXT)} THEN 'Sovereign/GSec' ELSE 'Unrated/Other' END {' '.join(f"WHEN contains({_R}, '{b}') THEN '{b}'" for b in K.CREDIT)} WHEN {_has(_R, K.SOVEREIGN)} OR {_R} = 'SOV' THEN 'Sovereign/GSec' ELSE substr({_R}, 1, 8) END"""
_S, _T = "upper(section)", "upper(company || ' ' || sector)"
_INSTRUMENT = f"""CASE WHEN regexp_matches({_S}, 'TREASURY|T-BILL|TBILL|GOVERNMENT|G-SEC|GILT|SDL') OR regexp_matches({_T}, 'TREASURY|T-BILL|TBILL|GOVT|G-SEC|GOI|GILT|SDL') THEN 'Govt / SDL / T-Bill' WHEN regexp_matches({_S} || chr(10) || {_T}, 'CERTIFICATE OF DEPOSIT') OR regexp_matches({_S}, '\\bCD\\b') THEN 'Certificate of Deposit'
  WHEN regexp_matches({_S} || chr(10) || {_T}, 'COMMERCIAL PAPER') OR regexp_matches({_S}, '\\bCP\\b') THEN 'Commercial Paper' WHEN regexp_matches({_S} || chr(10) || {_T}, 'NCD') OR contains({_T}, 'NON CONVERTIBLE') THEN 'NCD' WHEN regexp_matches({_S} || chr(10) || {_T}, 'BOND|DEBENTURE') THEN 'Corporate Bond' WHEN regexp_matches({_S} || chr(10) || {_T}, 'REPO|TREPS') THEN 'Repo / TREPS'
  WHEN regexp_matches({_S} || chr(10) || {_T}, 'MONEY MARKET') THEN 'Money Market' WHEN regexp_matches({_T}, '(^|\\s)C\\.?D\\.?(\\s|$)|\\sCP\\s|\\sCP$') THEN CASE WHEN contains({_T}, 'CD') THEN 'Certificate of Deposit' ELSE 'Commercial Paper' END WHEN regexp_matches({_T}, 'SOVEREIGN|\\bSOV\\b') THEN 'Govt / SDL / T-Bill' WHEN regexp_matches({_T}, 'A1\\+|A\\s?[0-9]|A-1') THEN 'Money Market' WHEN regexp_matches({_T}, 'AAA|AA|A|BBB|BB|B') THEN 'Corporate Bond' ELSE 'Other' END"""


@register("n13_n14_n15_holding_buckets", f"WITH {CLASSED} SELECT key, {_CAP} AS cap_bucket, {_CREDIT} AS credit, {_INSTRUMENT} AS instrument, NOT regexp_matches({_S}, 'DERIVATIVE|FUTURE|OPTION|SWAP|DEBT|CASH|NET|RECEIVABLE') AS equity_section FROM cl")
def n13(spark, sf):
    c = F.col
    h = _classed(spark, sf)
    return h.select("key", K.cap_bucket(c("company"), c("sector"), c("isin"), c("asset_class"), c("cap")).alias("cap_bucket"), K.credit_bucket(c("rating"), c("sector"), c("section"), c("company")).alias("credit"), K.instrument_type(c("company"), c("sector"), c("section")).alias("instrument"), K.is_equity_section(c("section")).alias("equity_section"))


@register("n16_debt_details", f"WITH {LINES} SELECT key, CAST(nullif(regexp_extract(company, '([0-9]{{1,2}}(\\.[0-9]+)?)\\s*%', 1), '') AS DOUBLE) AS coupon, try_strptime(regexp_extract(company, '\\(([0-9/]{{10}})\\)', 1), '%d/%m/%Y')::DATE AS maturity_date, CAST(ytm AS DOUBLE) AS ytm, CASE WHEN regexp_matches(sector, '(?i)A|B|SOV|NR|UNRATED') THEN trim(sector) END AS rating FROM ln")
def n16(spark, sf):
    c = F.col
    return lines(spark, sf).select("key", *[v.alias(k) for k, v in K.debt_details(c("company"), c("yield_text"), c("sector")).items()])


def effective(spark, sf):
    """Effective holdings of portfolios of 50 schemes: weights in percent of the portfolio, with the texts of the lines."""
    h = D.read(spark, sf, "lineitem").groupBy(F.expr("l_suppkey div 50").alias("portfolio_id"), F.col("l_partkey").alias("key")).agg(F.sum("l_extendedprice").alias("value"))
    total = h.groupBy("portfolio_id").agg(F.sum("value").alias("total"))
    c = F.col
    details = K.debt_details(c("company"), c("yield_text"), c("sector"))
    rows = _classed(spark, sf).select("key", "isin", "company", "sector", "section", "cap", "asset_class", "rating", details["ytm"].alias("yield"), details["maturity_date"].alias("maturity_date"))
    return h.join(total, "portfolio_id").join(rows, "key").withColumn("weight", 100 * c("value") / c("total"))


_GOLD, _RATED = "regexp_matches({0}, '(?i)\\bgold\\b')", "regexp_matches(sector, '(?i)AAA|AA|A1\\+|BBB|A\\+|SOV')"
_DEBT_TEXT = "regexp_matches(company || ' ' || sector, '(?i)government security|state government|g-sec|gsec|sovereign|treasury|t-bill|tbill|\\bsdl\\b|\\bgoi\\b|net current assets|net receivables')"
EFFECTIVE = f"""{CLASSED}, pv AS (SELECT l_suppkey // 50 AS portfolio_id, l_partkey AS key, sum(l_extendedprice) AS value FROM lineitem GROUP BY ALL), e0 AS (SELECT portfolio_id, 100 * value / sum(value) OVER (PARTITION BY portfolio_id) AS weight, cl.* FROM pv JOIN cl USING (key)),
ef AS (SELECT * REPLACE (CASE WHEN {_GOLD.format('company')} OR {_GOLD.format('sector')} THEN 'gold' WHEN asset_class = 'other' AND ({_RATED} OR {_DEBT_TEXT}) THEN 'debt' WHEN asset_class = 'stocks' AND starts_with(isin, 'INF') THEN CASE WHEN regexp_matches(company, '(?i)money market|liquid|savings|overnight|low duration|ultra short|tbill|t-bill|treasury') THEN 'cash_equivalents' ELSE 'debt' END
  WHEN asset_class = 'stocks' AND cap = 'na' AND {_RATED} THEN 'debt' ELSE asset_class END AS asset_class) FROM e0)"""


@register("g11_g12_g13_portfolio_splits", f"""WITH {EFFECTIVE}, b AS (SELECT portfolio_id, 'asset' AS block, asset_class AS label, weight FROM ef UNION ALL SELECT portfolio_id, 'sector', coalesce(nullif(trim(sector), ''), 'na'), weight FROM ef WHERE asset_class = 'stocks'
UNION ALL SELECT portfolio_id, 'cap', {_CAP}, weight FROM ef WHERE asset_class = 'stocks' AND {_CAP} IN ('large', 'mid', 'small', 'microcap', 'ipo') UNION ALL SELECT portfolio_id, 'credit', {_CREDIT}, weight FROM ef WHERE asset_class = 'debt' UNION ALL SELECT portfolio_id, 'instrument', {_INSTRUMENT}, weight FROM ef WHERE asset_class = 'debt'),
s AS (SELECT portfolio_id, block, label, sum(weight) AS value FROM b GROUP BY ALL), t AS (SELECT portfolio_id, sum(value) FILTER (block = 'asset' AND label = 'stocks') AS e, sum(value) FILTER (block = 'cap') AS c FROM s GROUP BY 1)
SELECT portfolio_id, block, label, round(CASE WHEN block = 'cap' AND c > 0 AND e > c * 1.0001 THEN value * e / c ELSE value END, 4) AS value FROM s JOIN t USING (portfolio_id)""")
def g11(spark, sf):
    return P.portfolio_splits(effective(spark, sf), "portfolio_id").withColumn("value", F.round("value", 4))


@register("g14_g15_g16_portfolio_summary", f"""WITH {EFFECTIVE}, k AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, isin) AS rk, try_strptime(regexp_extract(company, '\\(([0-9/]{{10}})\\)', 1), '%d/%m/%Y')::DATE AS mat, max(ytm) FILTER (asset_class = 'debt' AND ytm > 0) OVER (PARTITION BY portfolio_id) AS ty FROM ef),
d AS (SELECT *, CASE WHEN asset_class = 'debt' THEN CASE WHEN ty < 1 THEN ytm * 100 ELSE ytm END END AS y, CASE WHEN asset_class = 'debt' AND date_diff('day', DATE '2024-06-01', mat) / 365.25 BETWEEN -1 AND 60 THEN date_diff('day', DATE '2024-06-01', mat) / 365.25 END AS m FROM k)
SELECT portfolio_id, count(*) AS n_holdings, round(sum(weight) FILTER (rk <= 1), 4) AS top1_pct, round(sum(weight) FILTER (rk <= 5), 4) AS top5_pct, round(sum(weight) FILTER (rk <= 10), 4) AS top10_pct, round(sum(weight) FILTER (asset_class = 'debt'), 4) AS debt_pct, count_if(asset_class = 'debt') AS n_debt_holdings,
  round(sum(weight * y) / sum(weight) FILTER (y IS NOT NULL), 4) AS ytm_pct, round(100.0 * count(y) / count_if(asset_class = 'debt'), 4) AS ytm_cover, round(sum(weight * m) / sum(weight) FILTER (m IS NOT NULL), 4) AS avg_maturity_yrs FROM d GROUP BY 1""")
def g14(spark, sf):
    s = P.portfolio_summary(effective(spark, sf), "portfolio_id", "2024-06-01")
    return s.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


# Rule texts by number; the oracle knows what each of them states.
def _texts(spark, sf):
    return D.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.expr("""CASE s_suppkey % 4 WHEN 0 THEN concat('Max ', s_suppkey % 20 + 1, '% single stock. MAXIMUM ', s_suppkey % 30 + 5, ' % sector; Min 30% debt. Keep calm, carry on')
      WHEN 1 THEN concat('maximum cash = ', s_suppkey % 10, '%; max top-5 concentration ', s_suppkey % 40 + 10, '.25%, max 12 schemes') WHEN 2 THEN concat('Review yearly. Min large-cap allocation: ', s_suppkey % 50, '.5%. Max overlap between schemes 30%. min 20 holdings and max foreign 8%')
      ELSE CASE WHEN s_suppkey % 8 = 3 THEN 'No rules here.' END END""").alias("text"))


_STATED = {
    0: [("max_single_stock", "single stock", "<=", "s_suppkey % 20 + 1", "%", "high"), ("max_sector", "sector", "<=", "s_suppkey % 30 + 5", "%", "high"), ("min_asset", "debt", ">=", "30", "%", "high")],
    1: [("max_asset", "cash_equivalents", "<=", "s_suppkey % 10", "%", "high"), ("max_top5", "top 5 concentration", "<=", "s_suppkey % 40 + 10.25", "%", "medium"), ("max_schemes", "schemes", "<=", "12", "count", "low")],
    2: [("min_large_cap", "large cap", ">=", "s_suppkey % 50 + 0.5", "%", "medium"), ("max_overlap", "scheme overlap", "<=", "30", "%", "high"), ("min_holdings", "holdings", ">=", "20", "count", "medium"), ("max_asset", "international", "<=", "8", "%", "high")],
}


@register("r01_parse_rules", " UNION ALL ".join(f"SELECT s_suppkey AS k, '{t}' AS rule_type, '{f}' AS field, '{o}' AS operator, CAST({v} AS DOUBLE) AS value, '{u}' AS unit, '{s}' AS severity FROM supplier WHERE s_suppkey % 4 = {m}" for m, rows in _STATED.items() for t, f, o, v, u, s in rows))
def r01(spark, sf):
    return R.parse_rules(_texts(spark, sf), "k")


@register("r01_unparsed_notes", "SELECT s_suppkey AS k, 'Keep calm, carry on' AS note FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, x FROM supplier, (VALUES ('Review yearly'), ('and')) v(x) WHERE s_suppkey % 4 = 2 UNION ALL SELECT s_suppkey, 'No rules here' FROM supplier WHERE s_suppkey % 8 = 3")
def r01_notes(spark, sf):
    return R.unparsed(_texts(spark, sf), "k")


STRATEGY = "Max 1% single stock. Max 20% sector. Min 30% debt, min 20% equity; max 5% international. Max hybrid 1%. Min large-cap 10%. Max top-5 3%. Max 60 schemes. Min 500 holdings. Max overlap 40%."


def _judged(spark, sf):
    e = effective(spark, sf)
    schemes = D.read(spark, sf, "lineitem").select(F.expr("l_suppkey div 50").alias("portfolio_id"), "l_suppkey").distinct().groupBy("portfolio_id").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric", F.lit("schemes"))
    metrics = R.rule_metrics(P.portfolio_splits(e, "portfolio_id"), P.portfolio_summary(e, "portfolio_id", "2024-06-01"), schemes, "portfolio_id")
    return R.judge(metrics, R.parse_rules(spark.createDataFrame([(1, STRATEGY)], "k int, text string"), "k"), "portfolio_id")


_STRATEGY = "('max_single_stock', 'single stock', '<=', 1.0, 'high'), ('max_sector', 'sector', '<=', 20.0, 'high'), ('min_asset', 'debt', '>=', 30.0, 'high'), ('min_asset', 'stocks', '>=', 20.0, 'high'), ('max_asset', 'international', '<=', 5.0, 'high'), ('max_asset', 'other', '<=', 1.0, 'high'), ('min_large_cap', 'large cap', '>=', 10.0, 'medium'), ('max_top5', 'top 5 concentration', '<=', 3.0, 'medium'), ('max_schemes', 'schemes', '<=', 60.0, 'low'), ('min_holdings', 'holdings', '>=', 500.0, 'medium'), ('max_overlap', 'scheme overlap', '<=', 40.0, 'high')"
_ACTUALS = f"""{EFFECTIVE}, a AS (SELECT portfolio_id, asset_class, sum(weight) AS w FROM ef GROUP BY ALL), se AS (SELECT portfolio_id, max(w) AS w FROM (SELECT portfolio_id, sum(weight) AS w FROM ef WHERE asset_class = 'stocks' GROUP BY portfolio_id, coalesce(nullif(trim(sector), ''), 'na')) GROUP BY 1),
cb AS (SELECT portfolio_id, {_CAP} AS cap_bucket, weight FROM ef WHERE asset_class = 'stocks'), cp AS (SELECT portfolio_id, sum(weight) FILTER (cap_bucket = 'large') * greatest(1, sum(weight) / sum(weight) FILTER (cap_bucket IN ('large', 'mid', 'small', 'microcap', 'ipo'))) AS w FROM cb GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, isin) AS rk FROM ef), t AS (SELECT portfolio_id, sum(weight) FILTER (rk <= 1) AS t1, sum(weight) FILTER (rk <= 5) AS t5, count(*) AS n FROM k GROUP BY 1), sc AS (SELECT l_suppkey // 50 AS portfolio_id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1),
ru(rule_type, field, operator, bound, severity) AS (VALUES {_STRATEGY}),
j AS (SELECT t.portfolio_id, ru.*, CASE WHEN rule_type LIKE '%_asset' THEN coalesce((SELECT w FROM a WHERE a.portfolio_id = t.portfolio_id AND asset_class = field), 0) WHEN rule_type = 'max_single_stock' THEN t1 WHEN rule_type = 'max_sector' THEN se.w WHEN rule_type = 'min_large_cap' THEN cp.w WHEN rule_type = 'max_top5' THEN t5 WHEN rule_type = 'max_schemes' THEN sc.n WHEN rule_type = 'min_holdings' THEN t.n END AS actual
FROM t JOIN se USING (portfolio_id) JOIN cp USING (portfolio_id) JOIN sc USING (portfolio_id), ru)"""


@register("r03_r06_strategy_analysis", f"WITH {_ACTUALS} SELECT portfolio_id, rule_type, field, operator, CAST(bound AS DOUBLE) AS bound, round(actual, 4) AS actual, CASE WHEN actual IS NULL THEN 'n/a' WHEN CASE operator WHEN '<=' THEN actual <= bound ELSE actual >= bound END THEN 'pass' ELSE 'fail' END AS verdict, round(CASE operator WHEN '<=' THEN bound - actual ELSE actual - bound END, 4) AS headroom, severity FROM j")
def r03(spark, sf):
    verdict = F.when(F.col("passed"), "pass").when(~F.col("passed"), "fail").otherwise("n/a")
    return _judged(spark, sf).select("portfolio_id", "rule_type", "field", "operator", "bound", F.round("actual", 4).alias("actual"), verdict.alias("verdict"), F.round("headroom", 4).alias("headroom"), "severity")


@register("g19_g20_fund_attribution", f"""WITH {EFFECTIVE.replace("SELECT l_suppkey // 50 AS portfolio_id, l_partkey AS key,", "SELECT l_suppkey // 50 AS portfolio_id, l_suppkey AS scheme_id, l_partkey AS key,").replace("e0 AS (SELECT portfolio_id,", "e0 AS (SELECT portfolio_id, scheme_id,")}, s AS (SELECT portfolio_id, scheme_id, asset_class, sum(weight) AS w FROM ef GROUP BY ALL)
SELECT portfolio_id, scheme_id, asset_class, round(w, 4) AS value, round(w / sum(w) OVER (PARTITION BY portfolio_id, asset_class), 4) AS share FROM s""")
def g19(spark, sf):
    h = D.read(spark, sf, "lineitem").groupBy(F.expr("l_suppkey div 50").alias("portfolio_id"), F.col("l_suppkey").alias("scheme_id"), F.col("l_partkey").alias("key")).agg(F.sum("l_extendedprice").alias("value"))
    total = h.groupBy("portfolio_id").agg(F.sum("value").alias("total"))
    rows = h.join(total, "portfolio_id").join(_classed(spark, sf), "key").withColumn("weight", 100 * F.col("value") / F.col("total")).drop("value")
    a = P.fund_attribution(rows, "portfolio_id", "scheme_id")
    return a.select("portfolio_id", "scheme_id", "asset_class", F.round("value", 4).alias("value"), F.round("share", 4).alias("share"))


@register("r07_allocations", f"""WITH pl AS (SELECT s_suppkey AS plan_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 70 END AS equity, s_suppkey % 40 AS debt, s_suppkey % 11 AS international, s_suppkey % 33 AS large FROM supplier), ru(rule_type, field, operator, bound, severity) AS (VALUES {_STRATEGY}),
j AS (SELECT plan_id, ru.*, CASE field WHEN 'debt' THEN debt WHEN 'stocks' THEN coalesce(equity, 0) WHEN 'international' THEN international WHEN 'other' THEN 0 WHEN 'large cap' THEN large END AS actual FROM pl, ru)
SELECT plan_id, rule_type, field, CAST(actual AS DOUBLE) AS actual, CASE WHEN actual IS NULL THEN 'n/a' WHEN CASE operator WHEN '<=' THEN actual <= bound ELSE actual >= bound END THEN 'pass' ELSE 'fail' END AS verdict FROM j""")
def r07(spark, sf):
    k = F.col("s_suppkey")
    plans = D.read(spark, sf, "supplier").select(k.alias("plan_id"), F.when(k % 4 != 0, k % 70).alias("equity"), (k % 40).alias("debt"), (k % 11).alias("international"), (k % 33).alias("large"))
    j = R.judge(R.allocation_metrics(plans, "plan_id"), R.parse_rules(spark.createDataFrame([(1, STRATEGY)], "k int, text string"), "k"), "plan_id")
    return j.select("plan_id", "rule_type", "field", "actual", F.when(F.col("passed"), "pass").when(~F.col("passed"), "fail").otherwise("n/a").alias("verdict"))


@register("r05_remark_directions", f"""WITH {EFFECTIVE}, s AS (SELECT portfolio_id, coalesce(nullif(trim(sector), ''), 'na') AS sector, sum(weight) AS w FROM ef WHERE asset_class = 'stocks' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY w DESC, sector) AS k FROM s),
h AS (SELECT portfolio_id, weight, row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, isin) AS k FROM ef)
SELECT portfolio_id, 'by sector' AS remark, round(sum(w) FILTER (k <= 5), 2) AS actual FROM k GROUP BY 1 UNION ALL SELECT portfolio_id, 'plain', round(sum(weight) FILTER (k <= 5), 2) FROM h GROUP BY 1""")
def r05(spark, sf):
    e = effective(spark, sf)
    none = spark.createDataFrame([], "portfolio_id long, metric string, value double")
    metrics = R.rule_metrics(P.portfolio_splits(e, "portfolio_id"), P.portfolio_summary(e, "portfolio_id", "2024-06-01"), none, "portfolio_id")
    stated = spark.createDataFrame([("max_top5", "top 5 concentration", "<=", 50.0, "medium", "measured by Sector"), ("max_top5", "top 5 concentration", "<=", 51.0, "medium", None)], "rule_type string, field string, operator string, value double, severity string, remark string")
    j = R.judge(metrics, stated, "portfolio_id")
    return j.select("portfolio_id", F.when(F.col("bound") == 50, "by sector").otherwise("plain").alias("remark"), F.round("actual", 2).alias("actual"))
