"""Append-only logs: last states, sliding counts, limiters, learning folds and rules."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_status(events: DataFrame) -> DataFrame:
    """Per pipeline: the last event and counts of the 24 hours up to it."""
    end = F.max("ts").over(W.partitionBy("user_id"))
    e = events.withColumn("recent", F.col("ts") > end - F.expr("INTERVAL 24 HOURS"))
    bad = F.col("event_type") == "error"
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count_if(F.col("recent") & ~bad).alias("ok_24h"), F.count_if(F.col("recent") & bad).alias("error_24h"), F.count(F.lit(1)).alias("n"))


def sliding_counts(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Events of the same key in the seconds before each one, and whether the limit lets it pass."""
    w = W.partitionBy("user_id").orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    e = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.withColumn("n", F.count(F.lit(1)).over(w)).select("event_id", "user_id", "n", (F.col("n") <= limit).alias("passes"))


def _folded(events: DataFrame, key: str, order: list[str], value: str, schema: str, start, step, done) -> DataFrame:
    """One row for each key from a fold over its values in order: rows pass one by one, whatever the length of a history."""
    rows = events.select(F.col(key).cast("string").alias("k"), *order, F.col(value).alias("v")).repartition("k").sortWithinPartitions("k", *order)

    def run(batches):
        key_now, state, n = None, None, 0
        for b in batches:
            out = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n and k != key_now:
                    out.append((key_now, n, *done(state)))
                    n = 0
                if not n:
                    key_now, state = k, start
                state, n = step(state, v), n + 1
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=arrow)
        if n:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (key_now, n, *done(state)), strict=True))], schema=arrow)

    names = ["k", "n", schema.split()[0]]
    arrow = pa.schema([("k", pa.string()), ("n", pa.int64()), (names[2], pa.float64() if "double" in schema else pa.string())])
    found = rows.select("k", "v").mapInArrow(run, f"k string, n long, {schema}")
    return found.withColumn(key, F.col("k").cast(events.schema[key].dataType)).drop("k")


def q_values(events: DataFrame, key: str, order: list[str], reward: str) -> DataFrame:
    """Q <- round(0.8 Q + 0.2 R, 2), not below 0, folded over each key's events in order."""

    def step(q, r):
        return max(0.0, round(0.8 * q + 0.2 * r, 2))

    found = _folded(events, key, order, reward, "q double", 0.0, step, lambda q: (q,))
    return found.select(key, F.col("n").alias("observations"), "q")


def states(events: DataFrame, key: str, order: list[str], attempts: int = 3) -> DataFrame:
    """OPEN until a success closes it or `attempts` failures in a row park it as MANUAL; a fold over each key's events in order."""

    def step(at, ok):
        state, fails = at
        if state != "OPEN":
            return at
        if ok:
            return "CLOSED", 0
        return ("MANUAL" if fails + 1 >= attempts else "OPEN"), fails + 1

    found = _folded(events, key, order, "ok", "state string", ("OPEN", 0), step, lambda at: (at[0],))
    return found.select(key, "state", "n")


def decay(scores: DataFrame, as_of: str) -> DataFrame:
    """Scores times 0.95 for each 30 days gone by."""
    steps = F.floor(F.datediff(F.lit(as_of).cast("date"), "seen") / 30)
    return scores.withColumn("score", F.col("q") * F.pow(F.lit(0.95), F.greatest(F.lit(0), steps)))


def evaluate_rules(metrics: DataFrame, rules: DataFrame, by: str) -> DataFrame:
    """Each rule (rule, metric, op, bound) for each portfolio of metrics (by, metric, value).

    A rule whose metric a portfolio lacks, or that has no bound, is reported with
    passed null.  Rules are a short stated list, held as one array.
    """
    listed = rules.agg(F.collect_list(F.struct("rule", "metric", "op", F.col("bound").cast("double").alias("bound"))).alias("rules"))
    asked = metrics.select(by).distinct().crossJoin(F.broadcast(listed)).select(by, F.inline("rules"))  # one row on the right
    r = asked.join(metrics, [by, "metric"], "left")
    most = F.col("op") == "<="
    ok = F.when(most, F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    return r.select(by, "rule", "metric", "value", "bound", ok.alias("passed"), F.when(most, F.col("bound") - F.col("value")).otherwise(F.col("value") - F.col("bound")).alias("headroom"))


def compliance(results: DataFrame, by: str) -> DataFrame:
    n = F.count("passed")
    return results.groupBy(by).agg(n.alias("evaluated"), F.count_if("passed").alias("passed"), F.when(n > 0, F.round(100 * F.count_if("passed") / n, 1)).alias("compliance_pct"))


def coverage_score(rows: DataFrame, by: str) -> DataFrame:
    """Credit of present and half of found-only items over all that disclose."""
    credit = F.when(F.col("status") == "present", 1.0).when(F.col("status") == "found", 0.5).otherwise(0.0)
    base = F.count_if(F.col("status") != "none")
    return rows.groupBy(by).agg(base.alias("base"), F.when(base > 0, F.round(100 * F.sum(F.when(F.col("status") != "none", credit)) / base, 2)).alias("coverage"))


def reward(discovered: Column, downloaded: Column, success: Column) -> Column:
    """What an attempt counts for learning: finds once and saved documents twice, nothing without success."""
    return F.when(success, 1.0 * F.coalesce(discovered, F.lit(0)) + 2.0 * F.coalesce(downloaded, F.lit(0))).otherwise(0.0)


def promotions(playbooks: DataFrame, ledger: DataFrame, by: str, observations: int = 3, least_q: float = 5.0) -> DataFrame:
    """by, best_strategy, promoted: a candidate replaces the best strategy only on its own evidence of enough observations and value.

    playbooks: by, best_strategy, candidate.  ledger: by, strategy, observations, q.
    Empty candidates, "manual" and the strategy that is best already change nothing.
    """
    name = F.nullif(F.trim("candidate"), F.lit(""))
    asked = playbooks.select(by, "best_strategy", F.when(F.coalesce(name != "manual", F.lit(False)), name).alias("strategy"))
    known = asked.join(ledger, [by, "strategy"], "left")
    fresh = F.coalesce((F.col("observations") >= observations) & (F.col("q") >= least_q) & ~F.col("strategy").eqNullSafe(F.trim("best_strategy")), F.lit(False))
    return known.select(by, F.when(fresh, F.col("strategy")).otherwise(F.col("best_strategy")).alias("best_strategy"), fresh.alias("promoted"))
