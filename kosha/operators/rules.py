"""Strategy rules in plain text: read into rows, and checked against portfolios by kosha.operators.fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERCENT, COUNT = r"([0-9]+(?:\.[0-9]+)?)\s*%", r"([0-9]+)"
# What a rule may be about.  rule, field, unit, severity, sides, the subject before a number, words that
# may follow it there, the subject behind a number.
_STOCK, _SCHEMES = "(?:stock|holding|company|scrip)", r"(?:number\s+of\s+)?schemes?"
SUBJECTS = [
    ("single_stock", "single stock", "%", "high", ("max",), r"(?:single\s+)?" + _STOCK, "weight|concentration", r"(?:single\s+)?" + _STOCK),
    ("sector", "sector", "%", "high", ("max",), "sector", "exposure|weight|concentration", "sector"),
    ("top5", "top 5 concentration", "%", "medium", ("max",), "top[- ]?5", "concentration|weight|holdings", "top[- ]?5"),
    ("top10", "top 10 concentration", "%", "medium", ("max",), "top[- ]?10", "concentration|weight|holdings", "top[- ]?10"),
    ("overlap", "scheme overlap", "%", "high", ("max",), "overlap(?: between schemes)?", "", "overlap"),
    ("schemes", "schemes", "count", "low", ("max", "min"), _SCHEMES, "", _SCHEMES),
    ("holdings", "holdings", "count", "medium", ("min", "max"), "holdings?", "", "holdings?"),
    *[(f"{k.replace(' ', '_')}", k, "%", "medium", ("min", "max"), p, "allocation|exposure|weight|stocks?", p) for k, p in (("large cap", "large[- ]?cap"), ("mid cap", "mid[- ]?cap"), ("small cap", "small[- ]?cap"), ("microcap", "micro[- ]?cap"))],
]
# Names of asset classes in rules, and their keys.
ASSETS = {"debt": "debt", "equity": "stocks", "stock": "stocks", "stocks": "stocks", "gold": "gold", "cash": "cash_equivalents", "cash equivalents": "cash_equivalents", "international": "international", "foreign": "international", "hybrid": "other"}
_ASSET = r"(debt|equity|stocks?|gold|cash(?:\s+equivalents)?|international|foreign|hybrid)"


def _pattern(side: str, before: str, words: str, behind: str, number: str) -> str:
    words = rf"\s*(?:{words})?" if words else ""
    return rf"(?i){side}(?:imum)?\s+(?:{before}{words}\s*[=:]?\s*{number}|{number}\s*{behind})"


def _definitions():
    """(pattern, rule_type, field, operator, unit, severity, numbers of the groups that hold the value) of every rule; field None: by asset name."""
    for name, field, unit, severity, sides, before, words, behind in SUBJECTS:
        for side in sides:
            yield _pattern(side, before, words, behind, PERCENT if unit == "%" else COUNT), f"{side}_{name}", field, ">=" if side == "min" else "<=", unit, severity, (1, 2)
    for side in ("min", "max"):
        yield _pattern(side, _ASSET, "allocation|exposure|weight", _ASSET, PERCENT), f"{side}_asset", None, ">=" if side == "min" else "<=", "%", "high", (2, 3)


def _group(match: Column, pattern: str, numbers) -> Column:
    out = F.lit("")
    for n in reversed(numbers):
        got = F.regexp_extract(match, pattern, n)
        out = F.when(got != "", got).otherwise(out)
    return out


def parse_rules(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, rule_type, field, operator, value, unit, severity: one row for each rule that a text states, matches as often as they stand; a null text has none."""
    keys = F.create_map(*[F.lit(x) for p in ASSETS.items() for x in p])

    def rule(pattern, kind, field, op, unit, severity, numbers):
        def read(m):
            asset = F.regexp_replace(F.lower(_group(m, pattern, (1, 4))), r"\s+", " ")
            what = F.lit(field) if field else F.coalesce(keys[asset], F.lit("other"))
            return F.struct(F.lit(kind).alias("rule_type"), what.alias("field"), F.lit(op).alias("operator"), _group(m, pattern, numbers).cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(severity).alias("severity"))

        return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)), read)

    return texts.where(F.col(text_col).isNotNull()).select(key, F.inline(F.concat(*[rule(*d) for d in _definitions()])))


def unparsed(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, note: what a text says between its rules, less separators."""
    mark = "\u0001"

    def masked(pattern):
        pieces, hits = F.split(F.col(text_col), pattern, -1), F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
        blank = F.transform(hits, lambda h: F.expr("1") * F.length(h))
        return F.split(F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.repeat(F.lit(mark), F.coalesce(F.get(blank, i), F.lit(0))))), ""), "")

    union = F.split(F.col(text_col), "")
    for pattern, *_ in _definitions():
        union = F.zip_with(union, masked(pattern), lambda a, b: F.when(b == mark, b).otherwise(a))
    notes = F.transform(F.split(F.array_join(union, ""), f"{mark}+"), lambda x: F.regexp_replace(x, r"^[ \t.;,\n]+|[ \t.;,\n]+$", ""))
    return texts.where(F.col(text_col).isNotNull()).select(key, F.explode(F.filter(notes, lambda x: x != "")).alias("note"))


# Caps as rules name them.
CAPS = {"large": "large cap", "mid": "mid cap", "small": "small cap", "microcap": "microcap"}


def rule_metrics(splits: DataFrame, summary: DataFrame, more: DataFrame, by: str) -> DataFrame:
    """by, metric, value: what rules are judged by, from portfolio_splits, portfolio_summary and further rows (by, metric, value) such as schemes, schemes:direct (direct stocks counted too) and overlap."""
    caps = F.create_map(*[F.lit(x) for p in CAPS.items() for x in p])
    label = F.when(F.col("block") == "asset", F.concat(F.lit("asset:"), "label")).when(F.col("block") == "cap", F.concat(F.lit("cap:"), F.coalesce(caps[F.col("label")], "label")))
    parts = splits.where("block IN ('asset', 'cap')").select(by, label.alias("metric"), "value")
    sector = splits.where("block = 'sector'").groupBy(by).agg(F.max("value").alias("value")).select(by, F.lit("sector").alias("metric"), "value")
    order = F.row_number().over(W.partitionBy(by).orderBy(F.desc("value"), "label"))
    top = splits.where("block = 'sector'").withColumn("k", order).groupBy(by).agg(*[F.round(F.sum(F.when(F.col("k") <= n, F.col("value"))), 2).alias(f"top{n}:sectors") for n in (5, 10)])
    sector = sector.unionByName(top.unpivot(by, ["top5:sectors", "top10:sectors"], "metric", "value"))
    names = {"single_stock": "top1_pct", "top5": "top5_pct", "top10": "top10_pct", "holdings": "n_holdings"}
    fixed = summary.select(by, F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(v).cast("double").alias("value")) for k, v in names.items()])))
    return parts.unionByName(sector).unionByName(fixed).unionByName(more.select(by, "metric", "value"))


def judge(metrics: DataFrame, stated: DataFrame, by: str, resolved: DataFrame | None = None) -> DataFrame:
    """Each stated rule (from parse_rules) for each portfolio: by, rule_type, field, operator, bound, actual, passed, headroom, severity.

    An asset class that a portfolio lacks is 0 where the portfolio was resolved in
    full (resolved: by; None: all were), else not known; passed is null where the
    actual value is not known.  A column remark of the rules may direct how they are
    measured: the largest sectors instead of holdings, direct stocks among schemes.
    Rules are a short stated list.
    """
    remark = F.lower(F.coalesce("remark", F.lit(""))) if "remark" in stated.columns else F.lit("")
    side = F.regexp_replace("rule_type", "^(min|max)_", "")
    metric = F.when(side == "asset", F.concat(F.lit("asset:"), "field")).when(F.col("field").isin(*CAPS.values()), F.concat(F.lit("cap:"), "field")).otherwise(side)
    metric = F.when(side.isin("top5", "top10") & F.contains(remark, F.lit("sector")), F.concat(side, F.lit(":sectors"))).when((side == "schemes") & F.rlike(remark, F.lit("direct stock|stocks held")), "schemes:direct").otherwise(metric)
    listed = stated.select("rule_type", "field", "operator", F.col("value").alias("bound"), "severity", metric.alias("metric"))
    asked = metrics.select(by).distinct().crossJoin(F.broadcast(listed.agg(F.collect_list(F.struct(*listed.columns)).alias("r")))).select(by, F.inline("r"))  # one row on the right
    if resolved is None:
        asked = asked.withColumn("whole", F.lit(True))
    else:
        asked = asked.join(resolved.select(by).distinct().withColumn("whole", F.lit(True)), by, "left")
    absent = F.when(F.startswith("metric", F.lit("asset:")) & F.coalesce("whole", F.lit(False)), 0.0)
    rows = asked.join(metrics, [by, "metric"], "left").withColumn("actual", F.coalesce("value", absent))
    most = F.col("operator") == "<="
    passed = F.when(most, F.col("actual") <= F.col("bound")).otherwise(F.col("actual") >= F.col("bound"))
    return rows.select(by, "rule_type", "field", "operator", "bound", "actual", passed.alias("passed"), F.when(most, F.col("bound") - F.col("actual")).otherwise(F.col("actual") - F.col("bound")).alias("headroom"), "severity")


# What an allocation plan may state, and the metrics that rules look at.
PLAN = {
    "equity": "asset:stocks", "debt": "asset:debt", "gold": "asset:gold", "international": "asset:international", "cash": "asset:cash_equivalents",
    "large": "cap:large cap", "mid": "cap:mid cap", "small": "cap:small cap", "micro": "cap:microcap",
}


def allocation_metrics(plans: DataFrame, by: str) -> DataFrame:
    """by, metric, value of allocation plans (by and a column for each part, in percent): parts that are not stated are 0; all other metrics are not known."""
    value = lambda k: F.coalesce(F.col(k).cast("double"), F.lit(0.0)) if k in plans.columns else F.lit(0.0)
    return plans.select(by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), value(k).alias("value")) for k, m in PLAN.items()])))
