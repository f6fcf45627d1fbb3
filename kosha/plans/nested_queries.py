"""Queries of merging in arrays (M08, M10), nested records (S20) and debt identity (N17, J05) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kosha.operators import identity as I
from kosha.operators import nested as N
from kosha.operators import portfolio as P
from kosha.sources import adapters as D

from . import sql
from .registry import register

# Stored payments of a supplier are those of its odd months, announced ones those of most months, some with another amount.
_MONTHS = """m AS (SELECT l_suppkey AS k, strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS date, year(l_shipdate) * 12 + month(l_shipdate) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
old AS (SELECT k, date, value FROM m WHERE n % 2 = 1), new AS (SELECT k, date, CASE WHEN n % 5 = 0 THEN value + 0.5 ELSE value END AS value FROM m WHERE n % 3 > 0)"""


@register("m08_merge_events", f"""WITH {_MONTHS},
j AS (SELECT coalesce(old.k, new.k) AS k, coalesce(old.date, new.date) AS date, coalesce(new.value, old.value) AS value, old.k IS NULL AS added, coalesce(abs(new.value - old.value) > 1e-9, false) AS updated FROM old FULL JOIN new ON old.k = new.k AND old.date = new.date)
SELECT k, count(*) AS n, count_if(added) AS added, count_if(updated) AS updated, string_agg(date || '=' || CAST(round(value * 2) AS BIGINT), ',' ORDER BY date) AS merged FROM j GROUP BY k""")
def m08(spark, sf):
    day = F.trunc(F.col("l_shipdate").cast("date"), "month")
    months = D.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), day.alias("day")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value"))
    months = months.withColumn("n", F.year("day") * 12 + F.month("day")).withColumn("date", F.date_format("day", "yyyy-MM-dd"))
    event = F.struct("date", "value")
    changed = F.struct("date", F.when(F.col("n") % 5 == 0, F.col("value") + 0.5).otherwise(F.col("value")).alias("value"))
    sides = months.groupBy("k").agg(F.collect_list(F.when(F.col("n") % 2 == 1, event)).alias("old"), F.collect_list(F.when(F.col("n") % 3 > 0, changed)).alias("new"))
    same = lambda a, b: F.abs(a - b) <= 1e-9
    done = sides.select("k", N.merge_events(F.col("old"), F.col("new"), same).alias("m"))
    text = F.array_join(F.transform("m.merged", lambda x: F.concat_ws("=", x["date"], F.round(x["value"] * 2).cast("long").cast("string"))), ",")
    return done.select("k", F.size("m.merged").cast("long").alias("n"), F.col("m.added").cast("long").alias("added"), F.col("m.updated").cast("long").alias("updated"), text.alias("merged"))


# A quarter's stored record is derived for odd years, the incoming one for every third quarter; some quarters have one of them only.
@register("m10_merge_records", f"""WITH {sql.STATEMENTS}, r AS (SELECT isin AS k, fy * 10 + q AS p, fy, q, CAST(round(revenue) AS BIGINT) AS v FROM statements),
old AS (SELECT k, p, v, fy % 2 = 1 AS derived FROM r WHERE p % 4 > 0), new AS (SELECT k, p, CASE WHEN p % 5 = 0 THEN v ELSE v + 1 END AS v, p % 3 = 0 AS derived FROM r WHERE p % 7 > 0),
j AS (SELECT coalesce(old.k, new.k) AS k, coalesce(old.p, new.p) AS p, old.k IS NULL AS added, coalesce(old.derived AND NOT new.derived, false) AS takes, old.v AS ov, new.v AS nv, old.derived AS od, new.derived AS nd FROM old FULL JOIN new ON old.k = new.k AND old.p = new.p)
SELECT k, count(*) AS n, count_if(added) AS added, count_if(takes) AS changed, CAST(sum(CASE WHEN added OR takes THEN nv ELSE ov END) AS BIGINT) AS total, count_if(CASE WHEN added OR takes THEN nd ELSE od END) AS derived FROM j GROUP BY k""")
def m10(spark, sf):
    s = D.statements(spark, sf, exact=True).select(F.col("isin").alias("k"), (F.col("fy") * 10 + F.col("q")).alias("p"), "fy", F.round("revenue").cast("long").alias("v"))
    old = F.when(F.col("p") % 4 > 0, F.struct("p", F.struct("v", (F.col("fy") % 2 == 1).alias("derived")).alias("r")))
    new = F.when(F.col("p") % 7 > 0, F.struct("p", F.struct(F.when(F.col("p") % 5 == 0, F.col("v")).otherwise(F.col("v") + 1).alias("v"), (F.col("p") % 3 == 0).alias("derived")).alias("r")))
    sides = s.groupBy("k").agg(F.map_from_entries(F.collect_list(old)).alias("old"), F.map_from_entries(F.collect_list(new)).alias("new"))
    done = sides.select("k", N.merge_records(F.col("old"), F.col("new")).alias("m")).withColumn("r", F.map_values("m.merged"))
    total = F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["v"])
    derived = F.size(F.filter("r", lambda x: x["derived"]))
    return done.select("k", F.size("r").cast("long").alias("n"), F.col("m.added").cast("long").alias("added"), F.col("m.changed").cast("long").alias("changed"), total.alias("total"), derived.cast("long").alias("derived"))


# A feed for each brand and size: its parts are records, nested as deep as the size says, under keys of three fashions.
@register("s20_nested_records", """SELECT 'IN' || p_partkey AS isin, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS name, CAST(p_size AS VARCHAR) AS coupon, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS segment, p_size % 6 AS depth FROM part WHERE p_partkey % 11 > 0 AND p_partkey % 3 < 2""")
def s20(spark, sf):
    p = D.read(spark, sf, "part").withColumn("isin", F.when(F.col("p_partkey") % 11 > 0, F.concat(F.lit("IN"), F.col("p_partkey").cast("string"))).otherwise(""))
    kinds = [
        F.to_json(F.struct("isin", F.col("p_name").alias("security_name"), F.col("p_size").alias("couponRate"), F.col("p_type").alias("sector"))),
        F.to_json(F.struct(F.col("isin").alias("ISIN"), F.col("p_name").alias("AN"), F.struct(F.col("isin").alias("isin")).alias("inner"), F.col("p_size").alias("rate"))),
        F.to_json(F.struct(F.array(F.struct("isin")).alias("rows"), F.col("p_name").alias("name"), F.col("isin").alias("securityISIN"))),
    ]
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, kinds[0]).when(k == 1, kinds[1]).otherwise(kinds[2])
    p = p.withColumn("depth", F.col("p_size") % 6).withColumn("text", text)
    wrap = F.concat(F.repeat(F.lit('{"n": 1, "rows": [], "data": '), F.col("depth").cast("int")), F.col("text"), F.repeat(F.lit("}"), F.col("depth").cast("int")))
    return p.select("depth", F.inline(N.find_records(wrap))).select("isin", "name", "coupon", "segment", "depth")


# Lines of bonds: every third house gives no ISIN, and instruments are written with or without marks, or given in columns.
_LINES = """b AS (SELECT p_partkey AS isin, p_name, p_size, 4 + p_size / 10.0 AS rate, CAST(DATE '2030-01-01' + CAST(p_size * 31 AS INTEGER) AS DATE) AS due, upper(regexp_replace(p_name, ' +', ' ', 'g')) AS issuer FROM part)"""
_TRUE_KEY = "CASE WHEN isin % 7 > 0 THEN issuer || '|C' || CAST(CAST(round(rate, 4) AS DOUBLE) AS VARCHAR) || '|M' || strftime(due, '%Y-%m-%d') END"


def _lines(spark, sf):
    p = D.read(spark, sf, "part")
    rate, due = 4 + F.col("p_size") / 10.0, F.date_add(F.lit("2030-01-01").cast("date"), (F.col("p_size") * 31).cast("int"))
    day = lambda f: F.date_format(due, f)
    shape = F.col("p_partkey") % 7
    text = rate.cast("decimal(6,2)").cast("string")
    company = F.when(shape == 0, F.col("p_name")).when(shape <= 2, F.concat(text, F.lit("% "), F.col("p_name"), F.lit(" Ltd. ("), day("dd/MM/yyyy"), F.lit(")")))
    company = company.when(shape <= 4, F.concat(F.lit("The "), F.col("p_name"), F.lit(" "), text, F.lit(" "), day("dd-MM-yyyy"))).otherwise(F.concat(F.col("p_name"), F.lit(" Pvt Limited")))
    given = shape > 4
    return p.select(F.col("p_partkey").alias("isin"), company.alias("company"), F.when(given, rate).cast("double").alias("coupon"), F.when(given, day("yyyy-MM-dd")).alias("maturity_date"))


@register("n17_debt_key", f"WITH {_LINES} SELECT isin, {_TRUE_KEY} AS key FROM b")
def n17(spark, sf):
    return _lines(spark, sf).select("isin", I.debt_key(F.col("company"), F.col("coupon"), F.col("maturity_date")).alias("key"))


_SET_LINES = f"{sql.HOLDINGS}, {_LINES}, l AS (SELECT scheme_id // 12 AS set_id, scheme_id, CASE WHEN scheme_id % 3 > 0 THEN CAST(isin AS VARCHAR) END AS isin, {_TRUE_KEY} AS dk, CASE WHEN isin % 7 = 0 THEN p_name END AS name, weight FROM holdings JOIN b USING (isin))"
_OVERLAP = "w AS (SELECT set_id, scheme_id, key, sum(weight) AS weight FROM keyed GROUP BY ALL), o AS (SELECT a.set_id, a.scheme_id AS a, b.scheme_id AS b, sum(least(a.weight, b.weight)) AS overlap, count(*) AS common FROM w a JOIN w b USING (set_id, key) WHERE a.scheme_id <= b.scheme_id GROUP BY ALL) SELECT set_id, a, b, round(overlap, 4) AS overlap, common FROM o"


def _set_lines(spark, sf):
    lines = _lines(spark, sf).withColumnRenamed("isin", "part")
    own = F.when(F.col("scheme_id") % 3 > 0, F.col("isin").cast("string"))
    return D.holdings(spark, sf).join(lines, F.col("isin") == F.col("part")).select(F.expr("scheme_id div 12").alias("set_id"), "scheme_id", own.alias("isin"), "company", "coupon", "maturity_date", "weight")


def _overlap(keyed):
    weights = keyed.groupBy("set_id", "scheme_id", "key").agg(F.sum("weight").alias("weight"))
    return P.overlap(weights, "set_id", "scheme_id", "key").withColumn("overlap", F.round("overlap", 4))


@register("j05_overlap_by_instrument", f"WITH {_SET_LINES}, alias AS (SELECT set_id, dk, min(isin) AS alias FROM l WHERE isin IS NOT NULL AND dk IS NOT NULL GROUP BY ALL), keyed AS (SELECT l.*, coalesce(isin, alias, l.dk, name) AS key FROM l LEFT JOIN alias ON l.set_id = alias.set_id AND l.dk = alias.dk), {_OVERLAP}")
def j05(spark, sf):
    return _overlap(I.overlap_keys(_set_lines(spark, sf), "set_id"))


@register("j05_overlap_by_class", f"WITH {_SET_LINES}, c AS (SELECT dk, min(isin) AS class FROM l WHERE isin IS NOT NULL AND dk IS NOT NULL GROUP BY ALL), keyed AS (SELECT l.*, coalesce(class, isin, l.dk, name) AS key FROM l LEFT JOIN c ON l.dk = c.dk), {_OVERLAP}")
def j05_classes(spark, sf):
    return _overlap(I.class_keys(_set_lines(spark, sf), "set_id"))
