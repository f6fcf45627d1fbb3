"""Merging of revisions, sources and logs: who wins is always an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import small


def latest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row for each key: the last in order.  One partial aggregation, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return g.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def append_new(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """base and those rows of fresh whose keys it lacks; what stands is never revised."""
    return base.unionByName(fresh.join(base.select(*keys), keys, "left_anti"))


def by_priority(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources in which an earlier one wins each key."""
    rest = [c for c in sources[0].columns if c not in keys]
    union = None
    for i, s in enumerate(sources):
        s = s.select(*keys, *rest, F.lit(i).alias("p"))
        union = s if union is None else union.unionByName(s)
    g = union.groupBy(*keys).agg(F.min_by(F.struct(*rest, F.col("p")), "p").alias("r"))
    return g.select(*keys, *[F.col(f"r.{c}").alias(c) for c in [*rest, "p"]])


def fill_empty(main: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """main with its nulls filled from other; what is known is never overridden."""
    cols = [c for c in main.columns if c != key and c in other.columns]
    o = other.select(key, *[F.col(c).alias(f"o_{c}") for c in cols])
    return main.join(o, key, "left").select(*[F.coalesce(c, f"o_{c}").alias(c) if c in cols else F.col(c) for c in main.columns])


def adjust_for_splits(prices: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Prices times the product of den/num of all later splits: splits of a key are one small array."""
    s = splits.groupBy(key).agg(F.collect_list(F.struct("d", "num", "den")).alias("ss"))
    factor = F.aggregate(F.filter("ss", lambda x: x["d"] > F.col("d")), F.lit(1.0), lambda a, x: a * x["den"] / x["num"])
    return prices.join(s, key, "left").withColumn("factor", F.coalesce(factor, F.lit(1.0))).withColumn("adjusted", F.col("price") * F.col("factor")).drop("ss")


def resolve(left: DataFrame, right: DataFrame, tiers: list[tuple[Column, Column]], left_id: str, right_id: str, prefer: list[Column]) -> DataFrame:
    """Tiered entity resolution: each tier is an equi-join on its own key; the first tier with a match wins, then `prefer`.

    Of the right rows of one key only the preferred one can win, so each left row meets one of them.
    """
    found = None
    for i, (a, b) in enumerate(tiers):
        x = left.select(left_id, a.alias("k")).where("k is not null")
        y = right.select(F.col(right_id), b.alias("k"), F.struct(*prefer).alias("pref")).where("k is not null")
        y = y.groupBy("k").agg(F.max_by(F.struct(right_id, "pref"), "pref").alias("y")).select("k", "y.*")
        hit = x.join(small(y), "k").select(left_id, right_id, "pref", F.lit(i).alias("tier"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(left_id).agg(F.max_by(F.struct(right_id, "tier"), F.struct((-F.col("tier")).alias("t"), "pref")).alias("b"))
    return best.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.col("b.tier").alias("tier"))
