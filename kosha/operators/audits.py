"""Roll-ups of audits over scheme-months, their merging into stored totals, and samples checked against several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIERS = ("complete_100", "top10_fallback", "escalate")
COUNTS = ("n_schemes", "n_with_holdings", "n_holding_rows", *(f"n_{t}" for t in TIERS), "n_escalated", "n_suspect", "n_unkeyable")


def roll_up(audits: DataFrame, dims: tuple[str, ...] = ("amc", "month", "class")) -> DataFrame:
    """dims, level and counts over all audits, each dimension and all of them together, in one aggregation.

    audits: dims, tier, n_holdings, escalate, suspect, keyable.  level has a bit
    for each dimension that a row is not about (all but the last bit of one
    dimension of three: 3, 5, 6; the total: 7); a null dimension of lower level
    is a value that is null.
    """
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    sets = [list(dims), *([d] for d in dims), []]
    return audits.groupingSets([[F.col(d) for d in s] for s in sets], *map(F.col, dims)).agg(
        F.grouping_id(*dims).cast("long").alias("level"),
        F.count(F.lit(1)).alias("n_schemes"),
        one(F.col("n_holdings") > 0).alias("n_with_holdings"),
        F.coalesce(F.sum("n_holdings"), F.lit(0)).alias("n_holding_rows"),
        *[one(F.col("tier") == t).alias(f"n_{t}") for t in TIERS],
        one(F.col("escalate")).alias("n_escalated"),
        one(F.col("suspect")).alias("n_suspect"),
        one(~F.col("keyable")).alias("n_unkeyable"),
    )


def merge_totals(stored: DataFrame, fresh: DataFrame, dims: tuple[str, ...] = ("amc", "month", "class")) -> DataFrame:
    """Stored totals with those of scheme-months that were not in them yet: counts add up."""
    return stored.unionByName(fresh).groupBy(*dims, "level").agg(*[F.sum(c).alias(c) for c in COUNTS])


def replace_scope(stored: DataFrame, fresh: DataFrame, scope: str) -> DataFrame:
    """Audits of the scopes in fresh in place of their stored ones; those of other scopes stay."""
    return stored.join(fresh.select(scope).distinct(), scope, "left_anti").unionByName(fresh)


def worst(audits: DataFrame, of_each: int = 5, of_all: int = 15, suspects: int = 20) -> DataFrame:
    """list ("house", "all" or "suspect"), k and the audit: lowest coverage of each house, of all, and the highest of those out of scale."""
    cols = ["amc", "fund", "month", "coverage_pct", "tier"]
    low = [F.col("coverage_pct"), F.col("amc"), F.col("fund"), F.col("month")]
    house = audits.withColumn("k", F.row_number().over(Window.partitionBy("amc").orderBy(*low))).where(F.col("k") <= of_each).select(F.lit("house").alias("list"), "k", *cols)

    def top(df: DataFrame, order: list[Column], n: int, name: str) -> DataFrame:
        few = df.orderBy(*order).limit(n)  # n rows, then numbered
        return few.withColumn("k", F.row_number().over(Window.orderBy(*order))).select(F.lit(name).alias("list"), "k", *cols)

    return house.unionByName(top(audits, low, of_all, "all")).unionByName(top(audits.where("suspect"), [F.desc("coverage_pct"), F.col("amc"), F.col("fund"), F.col("month")], suspects, "suspect"))


def smallest_hashes(rows: DataFrame, key: str, stratum: str, k: int) -> DataFrame:
    """The rows of each stratum whose keys have the k smallest SHA-256 digests: a sample that depends on nothing but the keys.

    Samples of parts, put together and sampled again, are the sample of the whole.
    """
    digest = F.sha2(F.col(key).cast("string"), 256)
    ranked = rows.withColumn("__digest", digest).withColumn("__k", F.row_number().over(Window.partitionBy(stratum).orderBy("__digest", key)))
    return ranked.where(F.col("__k") <= k).drop("__digest", "__k")


def three_way(history: DataFrame, live: DataFrame, stored: DataFrame, key: str, near: float = 1e-4, stored_near: float = 0.01) -> DataFrame:
    """One row per key of any source: history, live and stored values side by side, and whether they agree.

    history and live: key, date, value; stored: key, value.  Where one side is
    missing, it does not agree; `only` names the sources that have the key.
    """
    h = history.select(key, F.col("date").alias("h_date"), F.col("value").alias("h_value"), F.lit("h").alias("h"))
    v = live.select(key, F.col("date").alias("l_date"), F.col("value").alias("l_value"), F.lit("l").alias("l"))
    s = stored.select(key, F.col("value").alias("s_value"), F.lit("s").alias("s"))
    both = h.join(v, key, "full").join(s, key, "full")
    agrees = lambda c: F.coalesce(c, F.lit(False))
    return both.select(
        key, "h_date", "h_value", "l_date", "l_value", "s_value",
        agrees(F.col("h_date") == F.col("l_date")).alias("date_current"),
        agrees(F.abs(F.col("h_value") - F.col("l_value")) < near).alias("nav_match"),
        agrees(F.abs(F.col("h_value") - F.col("s_value")) < stored_near).alias("stored_match"),
        F.concat_ws("", "h", "l", "s").alias("only"),
    )
