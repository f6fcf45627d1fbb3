"""Queries of text (N), merging (M, J), fleet (E), rules (R), sources (S) and data quality (G) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.functions import text as X
from kosha.operators import calendar as N
from kosha.operators import fleet as E
from kosha.operators import merge as M
from kosha.operators import portfolio as P
from kosha.sources import adapters as D

from . import sql
from .registry import register


def _r(df, n=4):
    return df.select(*[(F.round(c, n) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sup(spark, sf):
    return D.read(spark, sf, "supplier")


@register("n01_norm_name", "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS k FROM supplier")
def n01(spark, sf):
    return _sup(spark, sf).select("s_suppkey", X.norm_name(F.col("s_name")).alias("k"))


_PLANNED = "CASE s_suppkey % 8 WHEN 0 THEN s_name || ' - Direct (G)' WHEN 1 THEN s_name || ' (Regular) - Growth' WHEN 2 THEN 'Growth ' || s_name WHEN 3 THEN s_name || '-IDCWM [An open ended scheme.]' WHEN 4 THEN s_name || ':Growth Plan' WHEN 5 THEN s_name || ' Direct Growth' WHEN 6 THEN s_name || ' (Series 3)' ELSE s_name || ' – Reg (Monthly IDCW)' END"


@register("n02_n03_strip_plan", "SELECT s_suppkey, CASE s_suppkey % 8 WHEN 2 THEN 'Growth ' || s_name WHEN 4 THEN s_name || ':Growth Plan' WHEN 5 THEN s_name || ' Direct Growth' WHEN 6 THEN s_name || ' (Series 3)' ELSE s_name END AS fund FROM supplier")
def n02(spark, sf):
    return _sup(spark, sf).select("s_suppkey", X.strip_plan(F.expr(_PLANNED)).alias("fund"))


_NUM = "CASE s_suppkey % 6 WHEN 0 THEN '(1,234.5)' WHEN 1 THEN '₹ 2,000' WHEN 2 THEN 'n/a' WHEN 3 THEN '-' WHEN 4 THEN s_suppkey || '.25%' ELSE '' END"


@register("t_parse_number", "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN -1234.5 WHEN 1 THEN 2000.0 WHEN 4 THEN s_suppkey + 0.25 END AS v FROM supplier")
def parse_number(spark, sf):
    return _sup(spark, sf).select("s_suppkey", X.parse_number(F.expr(_NUM)).alias("v"))


_DATE = "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd-MMM-yyyy') WHEN 2 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE 'soon' END"


@register("n37_parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) ELSE DATE '1900-01-01' END AS d FROM orders")
def n37(spark, sf):
    return D.read(spark, sf, "orders").select("o_orderkey", F.coalesce(X.parse_date(F.expr(_DATE)), F.lit("1900-01-01").cast("date")).alias("d"))


@register("n27_period_helpers", "SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS fy, CAST((month(o_orderdate) + 8) % 12 // 3 + 1 AS INTEGER) AS q FROM orders")
def n27(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return D.read(spark, sf, "orders").select("o_orderkey", X.fiscal_year(d).alias("fy"), X.quarter_of(d).alias("q"))


@register("n09_n10_first_match", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring') THEN 'ring' WHEN regexp_matches(p_name, '^(red|blue)') THEN 'coloured' WHEN regexp_matches(p_type, 'PROMO|ECONOMY') THEN 'cheap' ELSE 'other' END AS class FROM part")
def n09(spark, sf):
    c = F.concat_ws(" ; ", "p_name", "p_type")
    return D.read(spark, sf, "part").select("p_partkey", X.first_match(c, [("ring", "ring"), ("^(red|blue)", "coloured"), ("PROMO|ECONOMY", "cheap")], "other").alias("class"))


@register("n34_bands", "SELECT s_suppkey, CASE WHEN s_acctbal >= 7500 THEN 'strong' WHEN s_acctbal >= 2500 THEN 'fair' ELSE 'weak' END AS band FROM supplier")
def n34(spark, sf):
    return _sup(spark, sf).select("s_suppkey", X.band(F.col("s_acctbal"), [(7500, "strong"), (2500, "fair")], "weak").alias("band"))


@register("n33_fingerprint", "SELECT s_suppkey, substr(sha256('key=' || s_suppkey || chr(10) || 'nation=' || s_nationkey), 1, 8) AS f FROM supplier")
def n33(spark, sf):
    return _sup(spark, sf).select("s_suppkey", X.fingerprint(("nation", F.col("s_nationkey")), ("key", F.col("s_suppkey"))).alias("f"))


@register("n19_n20_scale_repair", "WITH h AS (SELECT l_suppkey AS k, l_partkey AS p, sum(l_discount) / 100 AS w FROM lineitem GROUP BY ALL) SELECT k, p, round(CASE WHEN max(w) OVER (PARTITION BY k) BETWEEN 1e-9 AND 2 THEN w * 100 ELSE w END, 4) AS w FROM h")
def n19(spark, sf):
    from pyspark.sql import Window as W

    h = D.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p")).agg((F.sum("l_discount") / 100).alias("w"))
    return _r(h.withColumn("w", F.when(F.max("w").over(W.partitionBy("k")).between(1e-9, 2), F.col("w") * 100).otherwise(F.col("w"))))


_V01 = ", ".join(f"CASE WHEN {x} > {hi} AND {x} / 100 <= {hi} THEN {x} / 100 ELSE {x} END AS {k}" for k, x, hi in (("ter", "CAST(l_quantity AS DOUBLE)", 0.05), ("ytm", "CAST(l_quantity AS DOUBLE)", 0.35), ("duration", "CAST(l_extendedprice AS DOUBLE)", 60.0)))


@register("v01_normalize_metric", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_V01} FROM lineitem")
def v01(spark, sf):
    from kosha.conventions import normalize_metric

    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return D.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", normalize_metric(q, "ter").alias("ter"), normalize_metric(q, "ytm").alias("ytm"), normalize_metric(p, "duration").alias("duration"))


@register("m01_latest_wins", "SELECT l_partkey AS k, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS price, max(l_shipdate)::DATE AS d FROM lineitem GROUP BY 1")
def m01(spark, sf):
    r = D.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_extendedprice").alias("price"))
    return M.latest_wins(r, ["k"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "price"]).select("k", "price", F.col("l_shipdate").cast("date").alias("d"))


@register("m02_append_new", f"WITH {sql.NAV}, b AS (SELECT * FROM nav WHERE d < DATE '2001-01-01'), f AS (SELECT scheme_id, d, nav + 1 AS nav FROM nav WHERE d >= DATE '2000-12-01') SELECT scheme_id, d, round(nav, 4) AS nav FROM b UNION ALL SELECT scheme_id, d, round(nav, 4) FROM f ANTI JOIN b USING (scheme_id, d)")
def m02(spark, sf):
    n = D.nav(spark, sf)
    return _r(M.append_new(n.where("d < '2001-01-01'"), n.where("d >= '2000-12-01'").withColumn("nav", F.col("nav") + 1), ["scheme_id", "d"]))


@register("m04_m05_source_priority", f"WITH {sql.NAV}, u AS (SELECT 0 AS p, scheme_id, d, nav FROM nav WHERE scheme_id % 3 = 0 UNION ALL SELECT 1, scheme_id, d, nav + 1 FROM nav WHERE scheme_id % 2 = 0 UNION ALL SELECT 2, scheme_id, d, nav + 2 FROM nav) SELECT scheme_id, d, CAST(min(p) AS INTEGER) AS p, round(arg_min(nav, p), 4) AS nav FROM u GROUP BY scheme_id, d")
def m04(spark, sf):
    n = D.nav(spark, sf)
    return _r(M.by_priority([n.where("scheme_id % 3 = 0"), n.where("scheme_id % 2 = 0").withColumn("nav", F.col("nav") + 1), n.withColumn("nav", F.col("nav") + 2)], ["scheme_id", "d"]))


@register("m07_split_adjustment", f"WITH {sql.NAV}, s AS (SELECT scheme_id, DATE '1997-01-01' + CAST(x * 400 AS INTEGER) AS sd, x + 2.0 AS num, 1.0 AS den FROM (SELECT DISTINCT scheme_id FROM nav WHERE scheme_id % 2 = 0), range(0, 3) r(x)) SELECT nav.scheme_id, d, round(nav.nav * coalesce(product(den / num), 1), 5) AS adjusted FROM nav LEFT JOIN s ON s.scheme_id = nav.scheme_id AND sd > d GROUP BY nav.scheme_id, d, nav.nav")
def m07(spark, sf):
    n = D.nav(spark, sf).withColumnRenamed("nav", "price")
    x = spark.range(3)
    s = n.where("scheme_id % 2 = 0").select("scheme_id").distinct().crossJoin(x).select("scheme_id", F.expr("date_add(date'1997-01-01', cast(id * 400 as int))").alias("d"), (F.col("id") + 2.0).alias("num"), F.lit(1.0).alias("den"))
    return _r(M.adjust_for_splits(n, s, "scheme_id").select("scheme_id", "d", "adjusted"), 5)


@register("j31_m09_fill_empty", "SELECT p_partkey AS k, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_name END, p_type) AS name, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_brand END, 'B') AS brand FROM part")
def j31(spark, sf):
    p = D.read(spark, sf, "part")
    main = p.select(F.col("p_partkey").alias("k"), F.expr("CASE WHEN p_partkey % 3 <> 0 THEN p_name END").alias("name"), F.expr("CASE WHEN p_partkey % 5 <> 0 THEN p_brand END").alias("brand"))
    return M.fill_empty(main, p.select(F.col("p_partkey").alias("k"), F.col("p_type").alias("name"), F.lit("B").alias("brand")), "k")


@register("j07_j13_tiered_resolution", """WITH l AS (SELECT c_custkey AS id, c_custkey % 150 AS n, CASE c_custkey % 3 WHEN 0 THEN 'supplier' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') WHEN 1 THEN 'supplier0000' || c_custkey % 10 ELSE 'none' END AS name FROM customer),
r AS (SELECT s_suppkey AS rid, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS k, s_acctbal FROM supplier), m AS (SELECT id, rid, 0 AS tier, s_acctbal FROM l JOIN r ON l.name = k UNION ALL SELECT id, rid, 1, s_acctbal FROM l JOIN r ON substr(l.name, 1, 12) = substr(k, 1, 12))
SELECT id, arg_max(rid, (-tier, s_acctbal, rid)) AS rid, CAST(min(tier) AS INTEGER) AS tier FROM m GROUP BY 1""")
def j07(spark, sf):
    left = D.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('supplier', lpad(cast(c_custkey % 150 as string), 9, '0')) WHEN 1 THEN concat('supplier0000', c_custkey % 10) ELSE 'none' END").alias("name"))
    right = _sup(spark, sf).select(F.col("s_suppkey").alias("rid"), X.norm_name(F.col("s_name")).alias("key"), "s_acctbal")
    return M.resolve(left, right, [(F.col("name"), F.col("key")), (F.substring("name", 1, 12), F.substring("key", 1, 12))], "id", "rid", [F.col("s_acctbal"), F.col("rid").alias("tie")])


@register("j21_token_lookup", """WITH p AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM p), q AS (SELECT x AS q, unnest(string_split(x, ' ')) AS w FROM (VALUES ('ring red'), ('small gear box'), ('zzz')) v(x)), c AS (SELECT q, p_name, count(*) AS n FROM q JOIN t USING (w) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, p_name) AS k FROM c) SELECT q, p_name, n FROM k WHERE k = 1""")
def j21(spark, sf):
    from pyspark.sql import Window as W

    names = D.read(spark, sf, "part").select("p_name").distinct()
    words = names.select("p_name", F.explode(F.split("p_name", " ")).alias("w"))
    asked = spark.createDataFrame([("ring red",), ("small gear box",), ("zzz",)], "q string").select("q", F.explode(F.split("q", " ")).alias("w"))
    c = words.join(F.broadcast(asked), "w").groupBy("q", "p_name").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("n"), "p_name"))).where("k = 1").drop("k")


@register("e08_last_status", """WITH e AS (SELECT *, ts > max(ts) OVER (PARTITION BY user_id) - INTERVAL 24 HOUR AS recent FROM events) SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, count_if(recent AND event_type <> 'error') AS ok_24h, count_if(recent AND event_type = 'error') AS error_24h, count(*) AS n FROM e GROUP BY 1""")
def e08(spark, sf):
    return E.last_status(D.read(spark, sf, "events"))


@register("e09_rate_limit", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) <= 2 AS passes FROM events")
def e09(spark, sf):
    return E.sliding_counts(D.read(spark, sf, "events"), 6 * 3600, 2)


@register("e03_q_update", """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), t(user_id, i, q) AS (SELECT DISTINCT user_id, 0, 0.0::DOUBLE FROM o UNION ALL SELECT o.user_id, o.i, greatest(0, round(0.8 * q + 0.2 * value, 2)) FROM t JOIN o ON o.user_id = t.user_id AND o.i = t.i + 1)
SELECT user_id, max(i) AS observations, round(arg_max(q, i), 1) AS q FROM t GROUP BY 1""")
def e03(spark, sf):
    e = D.read(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return _r(E.q_values(e, "user_id", ["ts", "event_id"], "value"), 1)


@register("e02_state_machine", """WITH RECURSIVE o AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), t(user_id, i, s, f) AS (SELECT DISTINCT user_id, 0, 'OPEN', 0 FROM o UNION ALL
SELECT o.user_id, o.i, CASE WHEN s <> 'OPEN' THEN s WHEN ok THEN 'CLOSED' WHEN f + 1 >= 3 THEN 'MANUAL' ELSE 'OPEN' END, CASE WHEN ok THEN 0 ELSE f + 1 END FROM t JOIN o ON o.user_id = t.user_id AND o.i = t.i + 1) SELECT user_id, arg_max(s, i) AS state, max(i) AS n FROM t GROUP BY 1""")
def e02(spark, sf):
    e = D.read(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("ok"))
    return E.states(e, "user_id", ["ts", "event_id"])


@register("e04_decay", "SELECT user_id, round(max(value) * power(0.95, greatest(0, date_diff('day', max(ts)::DATE, DATE '2024-06-01') // 30)), 4) AS score FROM events GROUP BY 1")
def e04(spark, sf):
    g = D.read(spark, sf, "events").groupBy("user_id").agg(F.max("value").alias("q"), F.max("ts").cast("date").alias("seen"))
    return _r(E.decay(g, "2024-06-01").select("user_id", "score"))


_RULES = [("r1", "top1", "<=", 1.0), ("r2", "top5", "<=", 3.0), ("r3", "top10", ">=", 4.0), ("r4", "unknown", "<=", 1.0)]
_METRICS = f"""{sql.HOLDINGS}, k AS (SELECT *, row_number() OVER (PARTITION BY scheme_id ORDER BY weight DESC, isin) AS k FROM holdings), m AS (SELECT scheme_id, 'top' || n AS metric, sum(weight) FILTER (k <= n) AS value FROM k, (VALUES (1), (5), (10)) v(n) GROUP BY ALL), r(rule, metric, op, bound) AS (VALUES ('r1', 'top1', '<=', 1.0), ('r2', 'top5', '<=', 3.0), ('r3', 'top10', '>=', 4.0), ('r4', 'unknown', '<=', 1.0)),
x AS (SELECT s.scheme_id, rule, r.metric, value, bound, CASE op WHEN '<=' THEN value <= bound ELSE value >= bound END AS passed, CASE op WHEN '<=' THEN bound - value ELSE value - bound END AS headroom FROM (SELECT DISTINCT scheme_id FROM holdings) s, r LEFT JOIN m ON m.scheme_id = s.scheme_id AND m.metric = r.metric)"""


def _results(spark, sf):
    c = P.concentration(D.holdings(spark, sf), "scheme_id").unpivot("scheme_id", ["top1", "top5", "top10"], "metric", "value")
    return E.evaluate_rules(c, spark.createDataFrame(_RULES, "rule string, metric string, op string, bound double"), "scheme_id")


@register("r02_r03_r04_evaluate_rules", f"WITH {_METRICS} SELECT scheme_id, rule, metric, round(value, 4) AS value, CAST(bound AS DOUBLE) AS bound, passed, round(headroom, 4) + 0.0 AS headroom FROM x")
def r02(spark, sf):
    return _r(_results(spark, sf))


@register("r06_compliance", f"WITH {_METRICS} SELECT scheme_id, count(passed) AS evaluated, count_if(passed) AS passed, round(100.0 * count_if(passed) / count(passed), 1) AS compliance_pct FROM x GROUP BY 1")
def r06(spark, sf):
    return E.compliance(_results(spark, sf), "scheme_id")


@register("g22_coverage", "SELECT p_brand AS brand, count_if(p_partkey % 4 <> 0) AS base, round(100 * sum(CASE p_partkey % 4 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0 END) / count_if(p_partkey % 4 <> 0), 2) AS coverage FROM part GROUP BY 1")
def g22(spark, sf):
    s = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'present' WHEN 2 THEN 'found' ELSE 'missing' END")
    return E.coverage_score(D.read(spark, sf, "part").select(F.col("p_brand").alias("brand"), s.alias("status")), "brand")


@register("g23_freshness", f"WITH {sql.NAV}, l AS (SELECT scheme_id, date_diff('day', max(d), DATE '2001-11-10') AS age FROM nav GROUP BY 1) SELECT count(*) AS n, round(100 * avg(CASE WHEN age <= 10 THEN 1.0 ELSE 0 END), 2) AS fresh_pct, CAST(max(age) AS INTEGER) AS max_age, median(age) AS median_age FROM l")
def g23(spark, sf):
    a = D.nav(spark, sf).groupBy("scheme_id").agg(F.datediff(F.lit("2001-11-10").cast("date"), F.max("d")).alias("age"))
    return a.agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col("age") <= 10).cast("int")), 2).alias("fresh_pct"), F.max("age").alias("max_age"), F.median("age").alias("median_age"))


@register("g37_index_weights", "WITH k AS (SELECT p_brand AS b, p_partkey AS p, CASE WHEN p_partkey % 10 = 0 THEN 0.5 END AS w FROM part) SELECT b, p, round(coalesce(w, (100 - coalesce(sum(w) OVER (PARTITION BY b), 0)) / (count(*) OVER (PARTITION BY b) - count(w) OVER (PARTITION BY b))), 5) AS weight FROM k")
def g37(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("b")
    k = D.read(spark, sf, "part").select(F.col("p_brand").alias("b"), F.col("p_partkey").alias("p"), F.expr("CASE WHEN p_partkey % 10 = 0 THEN 0.5D END").alias("w"))
    rest = (100 - F.coalesce(F.sum("w").over(w), F.lit(0.0))) / (F.count(F.lit(1)).over(w) - F.count("w").over(w))
    return _r(k.select("b", "p", F.coalesce("w", rest).alias("weight")), 5)


@register("m14_missing_lists", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def m14(spark, sf):
    return D.read(spark, sf, "customer").select("c_custkey").join(D.read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register("s29_table_rows", r"""WITH l AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+ [a-z]+')) AS m FROM conversations) SELECT conv_id, turn, m AS company, count(*) AS n FROM l GROUP BY ALL""")
def s29(spark, sf):
    c = D.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+ [a-z]+"), F.lit(0))).alias("company")).groupBy("conv_id", "turn", "company").agg(F.count(F.lit(1)).alias("n"))


@register("s27_html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def s27(spark, sf):
    return D.read(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


_HOLIDAYS = ["1996-08-15", "1997-10-02", "1998-01-26", "1998-12-25", "2001-10-02"]
_OPEN = "isodow({0}) < 6 AND {0} NOT IN (" + ", ".join(f"DATE '{h}'" for h in _HOLIDAYS) + ")"


@register("n29_publication_calendar", f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), c AS (SELECT d, unnest(generate_series(1, 30)) AS k FROM d), b AS (SELECT d, max(CAST(d - CAST(k AS INTEGER) AS DATE)) AS prev FROM c WHERE {_OPEN.format('CAST(d - CAST(k AS INTEGER) AS DATE)')} GROUP BY d)
SELECT d, {_OPEN.format('d')} AS published, prev FROM d JOIN b USING (d)""")
def n29(spark, sf):
    d = D.read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return d.select("d", N.is_publish_day(F.col("d"), _HOLIDAYS).alias("published"), N.prev_publish_day(F.col("d"), _HOLIDAYS).alias("prev"))


@register("n30_nav_freshness", f"""WITH n AS (SELECT l_suppkey AS scheme_id, max(CAST(l_shipdate AS DATE)) - CAST(l_suppkey * l_suppkey % 90 AS INTEGER) AS last FROM lineitem GROUP BY l_suppkey), e AS (SELECT scheme_id, CASE WHEN scheme_id % 7 > 0 THEN CAST(last AS DATE) END AS last, CASE WHEN scheme_id % 2 = 0 THEN TIMESTAMP '2001-11-06 23:30:00' ELSE TIMESTAMP '2001-11-05 22:00:00' END AS now FROM n),
x AS (SELECT scheme_id, last, CASE WHEN hour(now) >= 23 THEN DATE '2001-11-06' ELSE DATE '2001-11-02' END AS expected FROM e), g AS (SELECT scheme_id, any_value(last) AS last, any_value(expected) AS expected, count_if(coalesce({_OPEN.format('day')}, false)) AS gap FROM (SELECT *, CAST(unnest(CASE WHEN expected > last THEN generate_series(last + 1, expected, INTERVAL 1 DAY) ELSE [NULL] END) AS DATE) AS day FROM x) GROUP BY scheme_id)
SELECT scheme_id, expected, CASE WHEN last IS NOT NULL THEN CAST(gap AS INTEGER) END AS gap, CASE WHEN last IS NULL THEN 'no_history' WHEN gap = 0 THEN 'current' WHEN gap = 1 THEN 'lag1' WHEN gap <= 6 THEN 'stale_recent' WHEN gap < 45 THEN 'stale_deep' ELSE 'dead_suspect' END AS bucket FROM g""")
def n30(spark, sf):
    c = F.col
    last = F.date_sub(F.max(c("l_shipdate").cast("date")), F.expr("cast(l_suppkey * l_suppkey % 90 as int)"))
    n = D.read(spark, sf, "lineitem").groupBy(c("l_suppkey")).agg(last.alias("d")).withColumnRenamed("l_suppkey", "scheme_id")
    now = F.when(c("scheme_id") % 2 == 0, F.lit("2001-11-06 23:30:00")).otherwise(F.lit("2001-11-05 22:00:00")).cast("timestamp_ntz")
    n = n.select("scheme_id", F.when(c("scheme_id") % 7 > 0, c("d")).alias("last"), N.expected_latest(now, _HOLIDAYS).alias("expected"))
    n = n.withColumn("gap", N.publish_days_between(c("last"), c("expected"), _HOLIDAYS))
    return n.select("scheme_id", "expected", "gap", N.freshness(c("gap")).alias("bucket"))


_LEDGER = "lg AS (SELECT user_id, event_type AS strategy, count(*) AS observations, round(avg(value), 4) AS q FROM events GROUP BY ALL), pb AS (SELECT user_id, min(event_type) AS best_strategy, CASE WHEN user_id % 7 = 0 THEN 'manual' WHEN user_id % 7 = 1 THEN NULL ELSE max(event_type) END AS candidate FROM events GROUP BY user_id)"


@register("e06_promotions", f"WITH {_LEDGER}, j AS (SELECT pb.*, coalesce(observations >= 3 AND q >= 5 AND candidate <> best_strategy AND candidate <> 'manual', false) AS promoted FROM pb LEFT JOIN lg ON lg.user_id = pb.user_id AND lg.strategy = pb.candidate) SELECT user_id, CASE WHEN promoted THEN candidate ELSE best_strategy END AS best_strategy, promoted FROM j")
def e06(spark, sf):
    e = D.read(spark, sf, "events")
    ledger = e.groupBy("user_id", F.col("event_type").alias("strategy")).agg(F.count(F.lit(1)).alias("observations"), F.round(F.avg("value"), 4).alias("q"))
    books = e.groupBy("user_id").agg(F.min("event_type").alias("best_strategy"), F.max("event_type").alias("m"))
    candidate = F.when(F.col("user_id") % 7 == 0, "manual").when(F.col("user_id") % 7 != 1, F.col("m"))
    return E.promotions(books.withColumn("candidate", candidate), ledger, "user_id")


@register("e07_reward", "SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN coalesce(CASE WHEN event_id % 5 <> 0 THEN event_id % 4 END, 0) + 2.0 * (event_id % 7) ELSE 0.0 END AS reward FROM events")
def e07(spark, sf):
    c = F.col
    e = D.read(spark, sf, "events")
    return e.select("event_id", E.reward(F.when(c("event_id") % 5 != 0, c("event_id") % 4), c("event_id") % 7, c("user_id") % 3 != 0).alias("reward"))
