"""Cash-flow analytics of portfolios: classification, units, time-weighted return and internal rate of return."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kosha import conventions as C

from .joins import held
from .series import asof_fill

# Transaction vocabulary.
INFLOW = ("purchase", "sip", "investment", "additional purchase")
OUTFLOW = ("redemption", "swp", "withdrawal")
BROADCAST_SCHEMES = 200  # about 30 KB of calendar each
ROWS = 200_000  # days of paths that leave a task at once
NEUTRAL = ("switch in", "switch out", "merger in", "merger out")


def flow_kind(tx_type: Column) -> Column:
    t = F.lower(F.trim(tx_type))
    return F.when(t.isin(*INFLOW), "in").when(t.isin(*OUTFLOW), "out").when(t.isin(*NEUTRAL), "neutral").when(F.contains(t, F.lit("dividend payout")), "income").otherwise("other")


def signed(kind: Column, amount: Column) -> Column:
    return F.when(kind == "in", amount).when(kind == "out", -amount).otherwise(0.0)


def opening_units(ends: DataFrame, tx: DataFrame, keys: list[str]) -> DataFrame:
    """Units held before the first transaction: what the end has and the transactions don't explain, never below 0."""
    moved = tx.groupBy(*keys).agg(F.sum("units").alias("moved"))
    return ends.join(moved, keys, "left").withColumn("opening", F.greatest(F.lit(0.0), F.col("end_units") - F.coalesce("moved", F.lit(0.0))))


def value_path(tx: DataFrame, nav: DataFrame, by: str, key: str) -> DataFrame:
    """Daily value and flow of each portfolio: units so far at the last known NAV, summed over its schemes.

    tx: by, key, d, units (signed), amount (signed).  nav: key, d, nav.

    Its days are those of its transactions and the NAVs of its schemes, from its
    first transaction on.  The moves of a portfolio meet in one task; where the
    schemes are few, their NAVs are broadcast and each path is made there as
    arrays, so that its days are never shuffled nor taken apart by scheme.
    """
    keys = _few(tx, key)
    if keys is None:
        return _exploded(tx, nav, by, key)
    made = _moves(tx, by, key).mapInArrow(_walk(_calendars(tx, nav, key, keys), _days), f"at {_type(tx, by)}, d int, value double, flow double")
    return made.select(F.col("at").alias(by), F.date_from_unix_date("d").alias("d"), "value", "flow")


def path_summary(tx: DataFrame, nav: DataFrame, by: str, key: str, bounded: bool = False) -> DataFrame:
    """One row for each portfolio's value path, as value_path has it: days, first, last, terminal_value and flow, and its chain (see twr): counted days, x, artifacts, dd.

    With bounded, of the path within its holding period (see holding_period);
    portfolios without one are left out.
    """
    keys = _few(tx, key)
    if keys is not None:
        found = _moves(tx, by, key).mapInArrow(_walk(_calendars(tx, nav, key, keys), _ends(bounded)), f"at {_type(tx, by)}, {_SUMMARY}")
        return found.withColumns({c: F.date_from_unix_date(c) for c in ("first", "last")}).withColumnRenamed("at", by)
    path = _exploded(tx, nav, by, key)
    path = holding_period(path, tx, by) if bounded else path
    return _chain(path, by).groupBy(by).agg(
        F.count(F.lit(1)).alias("days"), F.min("d").alias("first"), F.max("d").alias("last"), F.max_by("value", "d").alias("terminal_value"), F.sum("flow").alias("flow"),
        F.count_if("counts").alias("counted"), F.max_by("index", "d").alias("x"), F.count_if(F.col("counts") & F.col("artifact")).alias("artifacts"), F.min("dd").alias("dd"),
    )


_SUMMARY = "days long, first int, last int, terminal_value double, flow double, counted long, x double, artifacts long, dd double"


def _few(tx: DataFrame, key: str) -> list | None:
    """The schemes of the transactions, or None if they are more than BROADCAST_SCHEMES."""
    found = [r[0] for r in tx.select(key).where(F.col(key).isNotNull()).distinct().limit(BROADCAST_SCHEMES + 1).collect()]
    return found if len(found) <= BROADCAST_SCHEMES else None


def own_nav(tx: DataFrame, nav: DataFrame, key: str) -> DataFrame:
    """The NAVs of the schemes in tx, if these are few by a filter, which goes down to where the series are made."""
    keys = _few(tx, key)
    return nav if keys is None else nav.where(F.col(key).isin(keys))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _moves(tx: DataFrame, by: str, key: str) -> DataFrame:
    """at (the portfolio), key, d (days), units and amount, a row for each day of a scheme, those of a portfolio in one task and in order."""
    parts = int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number: few moves make many days, so partitions must not be merged by size
    rows = tx.where(F.col(by).isNotNull()).select(F.col(by).alias("at"), F.col(key).alias("key"), F.unix_date("d").alias("d"), F.coalesce("units", F.lit(0.0)).alias("units"), F.coalesce("amount", F.lit(0.0)).alias("amount"))
    moves = rows.repartition(parts, "at").groupBy("at", "key", "d").agg(F.sum("units").alias("units"), F.sum("amount").alias("amount"))
    return moves.sortWithinPartitions("at", "key", "d")


def _calendars(tx: DataFrame, nav: DataFrame, key: str, keys: list):
    """Broadcast: the keys, the first day of all NAVs, and of each key (and of one without NAVs) the price on every day from there, the days with a NAV of its own and the first priced day.

    Arrays have one place more in front, for the days before.
    """
    own = nav.where(F.col(key).isin(keys) & F.col("d").isNotNull()).groupBy(key, "d").agg(F.max("nav").cast("double").alias("nav"))
    t = own.select(F.col(key).alias("key"), F.unix_date("d").alias("d"), "nav").sort("key", "d").toArrow().combine_chunks()
    names = pa.array(keys, t.schema.field("key").type)
    which, day, price, valued = pc.index_in(t["key"], names).to_numpy(), t["d"].to_numpy().astype(np.int64), t["nav"].to_numpy(), t["nav"].is_valid().to_numpy()
    day0 = int(day.min()) if len(day) else 0
    n = int(day.max()) - day0 + 1 if len(day) else 0
    prices, real, start = np.zeros((len(keys) + 1, n + 1)), np.zeros((len(keys) + 1, n + 1), bool), np.full(len(keys) + 1, 1 << 40)
    for k in range(len(keys)):
        real[k, day[which == k] - day0 + 1] = True
        days, p = day[(which == k) & valued], price[(which == k) & valued]
        if len(days):
            start[k] = days[0]
            last = np.searchsorted(days, np.arange(day0, day0 + n), "right") - 1
            prices[k, 1:] = np.where(last < 0, 0.0, p[last])
    return tx.sparkSession.sparkContext.broadcast((keys, day0, prices, real, start))


def _walk(calendars, make):
    """Function of the batches of _moves that yields batches of make(rows): rows are (portfolio's place, days, value, known from, flow, end of moves) of each path; make gets them with the portfolios."""

    def path(key, d, dated, units, amount, day0, prices, real, start):
        fresh = key[1:] != key[:-1]  # moves stand by scheme
        keys, key = key[np.flatnonzero(np.concatenate(([True], fresh)))], np.concatenate(([0], fresh.cumsum()))
        if not dated.all():
            key, d, units, amount = key[dated], d[dated], units[dated], amount[dated]
        n = prices.shape[1] - 1
        slot = d - (day0 - 1)
        low, high = int(slot.min()), int(slot.max())
        open_ = real[keys].any(0)
        if 0 < low and high <= n:
            open_[slot] = True
            slots = np.flatnonzero(open_[low:]) + low
            days, place = slots + (day0 - 1), np.searchsorted(slots, slot)
        else:
            days = np.union1d(np.flatnonzero(open_[max(0, low) :]) + (max(0, low) + day0 - 1), d)
            slots, place = np.clip(days - (day0 - 1), 0, n), np.searchsorted(days, d)
        held = np.bincount(key * len(days) + place, weights=units, minlength=len(keys) * len(days)).reshape(len(keys), len(days))
        value = np.einsum("ij,ij->j", held.cumsum(1, out=held), prices.take(keys, 0).take(slots, 1))
        return days, value, int(np.searchsorted(days, start[keys].min())), np.bincount(place, weights=amount, minlength=len(days)), int(place.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *arrays = calendars.value
        waiting = []

        def paths(t):
            at = t["at"].combine_chunks()
            key = pc.fill_null(pc.index_in(t["key"], pa.array(keys, t.schema.field("key").type)), len(keys)).to_numpy()
            dated, d = t["d"].is_valid().to_numpy(), pc.fill_null(t["d"], 0).to_numpy().astype(np.int64)
            units, amount = t["units"].to_numpy(), t["amount"].to_numpy()
            ends = [*(np.flatnonzero(pc.not_equal(at.slice(1), at.slice(0, len(at) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), len(at)]
            low = 0
            found, rows = [], 0
            for high in ends:
                if dated[low:high].any():
                    found.append((low, *path(key[low:high], d[low:high], dated[low:high], units[low:high], amount[low:high], *arrays)))
                    rows += len(found[-1][1])
                low = high
                if found and (rows >= ROWS or high == len(at)):
                    yield from make(at, found)
                    found, rows = [], 0

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            fresh = np.flatnonzero(pc.not_equal(b["at"].slice(1), b["at"].slice(0, len(b) - 1)).to_numpy(zero_copy_only=False))
            if waiting and waiting[-1]["at"][-1].as_py() != b["at"][0].as_py():
                yield from paths(pa.concat_tables(waiting).combine_chunks())
                waiting = []
            if len(fresh):
                yield from paths(pa.concat_tables([*waiting, t.slice(0, int(fresh[-1]) + 1)]).combine_chunks())
                waiting, t = [], t.slice(int(fresh[-1]) + 1)
            waiting.append(t)
        if waiting:
            yield from paths(pa.concat_tables(waiting).combine_chunks())

    return run


def _days(at: pa.Array, paths: list) -> Iterator[pa.RecordBatch]:
    """at, d, value and flow of all days of the paths; a value is null before any scheme has a price."""
    sizes = [len(p[1]) for p in paths]
    unknown = np.concatenate([np.arange(n) < p[3] for n, p in zip(sizes, paths, strict=True)])
    of = at.take(pa.array(np.repeat([p[0] for p in paths], sizes)))
    columns = [of, pa.array(np.concatenate([p[1] for p in paths]).astype(np.int32)), pa.array(np.concatenate([p[2] for p in paths]), mask=unknown), pa.array(np.concatenate([p[4] for p in paths]))]
    yield pa.RecordBatch.from_arrays(columns, names=["at", "d", "value", "flow"])


def _ends(bounded: bool):
    """Function of paths that gives the columns of path_summary."""

    def chain(value, known, flow):
        value, flow = value[known:], flow[known:]
        prev = value[:-1]
        with np.errstate(all="ignore"):
            r = (value[1:] - flow[1:] - prev) / prev
            size = np.abs(r)
            counts = (prev > 0) & ((size >= 1e-6) | (flow[1:] != 0))
            chains = counts & (size <= C.ARTIFACT_RETURN)
            log = np.cumsum(np.log1p(np.where(chains, r, 0.0)))
        counted = int(np.count_nonzero(counts))
        if not counted:
            return 0, 1.0, 0, None
        index = np.exp(log)
        fall = index / np.maximum(1.0, np.maximum.accumulate(index))
        return counted, float(index[-1]), counted - int(np.count_nonzero(chains)), float(fall[counts].min() - 1)

    def make(at: pa.Array, paths: list) -> Iterator[pa.RecordBatch]:
        rows, of = [], []
        for place, days, value, known, flow, moved in paths:
            if bounded:
                worth = np.flatnonzero(np.abs(value[known:]) >= 1) + known
                low, high = (worth[0], max(worth[-1] + 1, moved)) if len(worth) else (0, 0)
                if high - low < 2:
                    continue
                days, value, flow, known = days[low:high], value[low:high], flow[low:high], 0
            terminal = float(value[-1]) if known < len(days) else None
            of.append(place)
            rows.append((len(days), int(days[0]), int(days[-1]), terminal, float(flow.sum()), *chain(value, known, flow)))
        if rows:
            names = ["days", "first", "last", "terminal_value", "flow", "counted", "x", "artifacts", "dd"]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([at.take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["at", *names])

    return make


def _exploded(tx: DataFrame, nav: DataFrame, by: str, key: str) -> DataFrame:
    """value_path for many schemes.

    Moves become segments of constant units, and the NAV of a scheme one array of
    calendar days; a segment takes its slice of the array.
    """
    tx = tx.where(F.col(by).isNotNull())
    first = tx.groupBy(by).agg(F.min("d").alias("d")).where("d IS NOT NULL")
    opened = tx.select(by, key).distinct().join(first, by).select(by, key, "d", F.lit(0.0).alias("units"), F.lit(0.0).alias("amount"))
    moves = tx.select(by, key, "d", "units", "amount").where("d is not null").unionByName(opened)
    parts = int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number: few moves make many days, so partitions must not be merged by size
    moves = moves.repartition(parts, by).groupBy(by, key, "d").agg(F.sum("units").alias("units"), F.sum("amount").alias("flow"))
    w = W.partitionBy(by, key).orderBy("d")
    sofar = w.rowsBetween(W.unboundedPreceding, 0)
    held = moves.select(by, key, "d", "flow", F.sum(F.coalesce("units", F.lit(0.0))).over(sofar).alias("held"), F.lead("d").over(w).alias("until"))
    days = _calendar(tx, nav, key)
    skip = F.greatest(F.datediff("d", "day0"), F.lit(0))
    size = F.greatest(F.coalesce(F.datediff("until", "day0"), F.size("days")) - skip, F.lit(0))
    move = F.array(F.struct(F.col("d"), F.lit(None).cast("double").alias("price"), F.lit(True).alias("real")))
    cells = F.when(F.col("days").isNull(), move).otherwise(F.concat(move, F.slice("days", skip + 1, size)))
    rows = held.join(days, key, "left").select(by, "held", "flow", F.posexplode(cells).alias("n", "cell"))
    flow = F.when(F.col("n") == 0, F.coalesce("flow", F.lit(0.0))).otherwise(0.0)
    out = rows.groupBy(by, F.col("cell.d").alias("d")).agg(F.sum(F.col("held") * F.col("cell.price")).alias("value"), F.sum(flow).alias("flow"), F.max("cell.real").alias("real"))
    return out.where("real").drop("real")


def _calendar(tx: DataFrame, nav: DataFrame, key: str) -> DataFrame:
    """key, day0, days: every day from the first NAV of a scheme in tx to the last day of all, as (d, price, real); real days have a NAV of their own."""
    own = nav.join(tx.select(key).distinct(), key, "left_semi").where("d is not null").groupBy(key, "d").agg(F.max("nav").alias("nav"))
    last = own.select("d").unionByName(tx.select("d")).agg(F.max("d").alias("last"))
    w = W.partitionBy(key).orderBy("d")
    own = own.crossJoin(F.broadcast(last)).select(key, "d", F.last("nav", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("price"), F.coalesce(F.date_sub(F.lead("d").over(w), 1), "last").alias("to"))
    filled = own.select(key, "price", F.posexplode(F.sequence("d", "to")).alias("n", "d"))
    rows = F.sort_array(F.collect_list(F.struct("d", "price", (F.col("n") == 0).alias("real"))))
    return filled.groupBy(key).agg(F.min("d").alias("day0"), rows.alias("days"))


def twr_days(path: DataFrame, by: str) -> DataFrame:
    """Daily returns free of flows; tiny ones without a flow are skipped, and those over 20 percent are artifacts."""
    return _marked(path, by).where("counts").drop("counts")


def _marked(path: DataFrame, by: str) -> DataFrame:
    """All days of the path with r, artifact and whether the day counts in the chain."""
    prev = F.lag("value").over(W.partitionBy(by).orderBy("d"))
    r = F.when(prev > 0, (F.col("value") - F.col("flow") - prev) / prev)
    rows = path.withColumn("r", r).withColumn("artifact", F.abs("r") > C.ARTIFACT_RETURN)
    return rows.withColumn("counts", F.coalesce(F.col("r").isNotNull() & ~((F.abs("r") < 1e-6) & (F.col("flow") == 0)), F.lit(False)))


def _chain(path: DataFrame, by: str) -> DataFrame:
    """_marked with the chained index and, on days that count, its fall from the running maximum; days that do not count leave the chain as it is."""
    w = W.partitionBy(by).orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    chain = _marked(path, by).withColumn("index", F.exp(F.sum(F.when(F.col("counts") & ~F.col("artifact"), F.log1p("r")).otherwise(0.0)).over(w)))
    return chain.withColumn("dd", F.when(F.col("counts"), F.col("index") / F.greatest(F.lit(1.0), F.max("index").over(w)) - 1))


def twr(path: DataFrame, by: str) -> DataFrame:
    """Chained return, annualised from 90 days on, drawdown of the chain (null with artifacts).

    Days that do not count leave the chain as it is, so one pass gives the span of all days too.
    """
    g = _chain(path, by).groupBy(by).agg(F.max_by("index", "d").alias("x"), F.count_if(F.col("counts") & F.col("artifact")).alias("artifacts"), F.min("dd").alias("dd"), F.min("d").alias("first"), F.max("d").alias("last"), F.count_if("counts").alias("counted"))
    return chained(g, by)


def chained(summary: DataFrame, by: str) -> DataFrame:
    """The returns that path_summary's chains tell (see twr); portfolios without a day that counts are left out."""
    g = summary.where("counted > 0").withColumn("span", F.datediff("last", "first"))
    return g.select(by, (F.col("x") - 1).alias("twr"), "artifacts", "span", F.when(F.col("span") >= C.MIN_CAGR_WINDOW_DAYS, F.pow("x", C.DAYS_PER_YEAR / F.col("span")) - 1).alias("annualised"), F.when(F.col("artifacts") == 0, F.col("dd")).alias("max_drawdown"))


def xirr(flows: DataFrame, by: str, steps: int = 60) -> DataFrame:
    """Rate at which the flows (d, amount) of each portfolio are worth nothing: bisection on [-0.99, 10]; null without a change of sign.

    The flows of one portfolio are one array; each step is a fold over it.
    """
    first = flows.groupBy(by).agg(F.min("d").alias("d0"))
    rows = flows.join(first, by).groupBy(by).agg(F.sort_array(F.collect_list(F.struct((F.datediff("d", "d0") / C.DAYS_PER_YEAR).alias("t"), F.col("amount").alias("a")))).alias("fs"))

    def worth(rate):
        return F.aggregate("fs", F.lit(0.0), lambda acc, f: acc + f["a"] / F.pow(1 + rate, f["t"]))

    low, width = -0.99, 10.99

    def step(at, k):  # the interval halves at each step, so only its lower end is carried along
        half = F.lit(width) / F.pow(F.lit(2.0), k)
        return at + F.when(F.signum(worth(at + half)) == F.signum(F.col("lo")), half).otherwise(0.0)

    rows = rows.withColumn("lo", worth(F.lit(low))).withColumn("hi", worth(F.lit(low + width)))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(low), step)
    return rows.select(by, F.when(F.col("lo") * F.col("hi") < 0, found).alias("xirr"))


def valued_only(tx: DataFrame, nav: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The transactions of schemes that have a NAV, and per scheme the cash of the others: without a value their flows would look like returns."""
    known = nav.where("nav > 0").select(key).distinct()
    excluded = tx.join(known, key, "left_anti").groupBy(key).agg(F.sum("amount").alias("excluded_cash"), F.count(F.lit(1)).alias("n"))
    return tx.join(known, key, "left_semi"), excluded


def holding_period(path: DataFrame, tx: DataFrame, by: str) -> DataFrame:
    """The value path from the first day worth 1 or more through the last such day or transaction, whichever is later; a period of one day is none."""
    ends = path.where(F.abs("value") >= 1).groupBy(by).agg(F.min("d").alias("low"), F.max("d").alias("last"))
    moved = tx.groupBy(by).agg(F.max("d").alias("moved"))
    bounds = ends.join(moved, by, "left").select(by, "low", F.greatest("last", "moved").alias("high"))
    inside = path.join(bounds, by).where(F.col("d").between(F.col("low"), F.col("high"))).drop("low", "high")
    return inside.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(by))).where("n > 1").drop("n")


def latest_nav(navs: DataFrame, key: str) -> DataFrame:
    """key, nav, nav_date: the freshest positive value of all sources (key, d, nav, source), of equal dates that of the last source in order."""
    return navs.where("nav > 0 AND d IS NOT NULL").groupBy(key).agg(F.max_by(F.struct("nav", F.col("d").alias("nav_date")), F.struct("d", "source")).alias("x")).select(key, "x.*")


def reweight(items: DataFrame, prices: DataFrame, by: str, key: str) -> DataFrame:
    """by, key, units, weight, current_value, pricing_basis: weights from market values, all or nothing.

    items: by, key, units, weight.  Lines without units keep their weight (manual),
    lines with none left go.  One line with units and no price keeps the whole
    portfolio on its weights (cost); so does one that has no value at all.
    """
    c = F.col
    rows = items.where("units IS NULL OR units > 0").join(prices.select(key, "nav"), key, "left")
    rows = rows.withColumn("current_value", F.when(c("nav") > 0, c("units") * c("nav")))
    all_of = W.partitionBy(by)
    stuck = F.max(F.when(c("units").isNotNull() & c("current_value").isNull(), 1).otherwise(0)).over(all_of) == 1
    total = F.sum("current_value").over(all_of)
    market = ~stuck & c("current_value").isNotNull() & (total > 0)
    return rows.select(
        by, key, "units", F.when(market, F.round(100 * c("current_value") / total, 4)).otherwise(c("weight")).alias("weight"), F.when(market, F.round("current_value", 2)).alias("current_value"),
        F.when(stuck, "cost").when(c("units").isNull(), "manual").otherwise("market").alias("pricing_basis"),
    )


def movement(ends: DataFrame, tx: DataFrame, nav: DataFrame, by: str, key: str) -> DataFrame:
    """One row for each portfolio: its period, opening and last value, flows, time-weighted and money-weighted return, and what the figures rest on.

    ends: by, key, end_units (of the statement).  tx: by, key, d, units, amount
    (both signed).  nav: key, d, nav.

    Transactions of schemes without a NAV are left out, with their cash, and
    counted.  Units that the transactions don't explain were held before: with
    one unit or more of them a portfolio starts at its first NAV, if that is
    earlier than its first transaction.  The period runs from the first day worth
    1 to the last such day or transaction.  Rates for a year need 90 days.
    """
    c = F.col
    nav = own_nav(tx, nav, key)
    valued, _ = valued_only(tx, nav, key)
    known = nav.where("nav > 0").select(key).distinct()
    left_out = tx.join(known, key, "left_anti").groupBy(by).agg(F.countDistinct(key).alias("unvalued_schemes"), F.count(F.lit(1)).alias("unvalued_tx"), F.sum("amount").alias("unvalued_flow"))
    lines = valued.select(by, key).distinct()
    opening = held(opening_units(ends.join(lines, [by, key], "left_semi"), valued, [by, key]).select(by, key, "opening"))
    days = nav.groupBy(key).agg(F.min("d").alias("first_nav"))
    first_nav = lines.join(days, key).groupBy(by).agg(F.min("first_nav").alias("first_nav"))
    g = valued.groupBy(by).agg(
        F.min("d").alias("first_tx"), F.sum("amount").alias("net_flow"), F.coalesce(F.sum(F.when(c("amount") > 0, c("amount"))), F.lit(0.0)).alias("cash_in"), F.coalesce(F.sum(F.when(c("amount") < 0, c("amount"))), F.lit(0.0)).alias("cash_out")
    )
    g = g.join(opening.groupBy(by).agg(F.sum("opening").alias("opening_units")), by, "left").join(first_nav, by, "left").withColumn("partial", F.coalesce(c("opening_units") >= 1, F.lit(False)))
    g = held(g.withColumn("from_day", F.when(c("partial"), F.least("first_tx", "first_nav")).otherwise(c("first_tx"))))
    before = opening.where("opening > 0").join(g.select(by, "from_day"), by)
    moves = valued.select(by, key, "d", "units", "amount").unionByName(before.select(by, key, c("from_day").alias("d"), c("opening").alias("units"), F.lit(0.0).alias("amount")))
    paths = held(path_summary(moves, nav, by, key, bounded=True))
    ends_of = paths.select(by, c("first").alias("start"), c("last").alias("end"), "terminal_value")
    at_start = before.select(by, key, "opening").join(ends_of.select(by, c("start").alias("d")), by)
    priced = asof_fill(at_start.select(key, "d").distinct(), nav.select(key, "d", "nav"), key)
    opened = at_start.join(priced, [key, "d"]).groupBy(by).agg(F.sum(c("opening") * c("nav")).alias("opening_value"))
    out = g.join(ends_of, by).join(opened, by, "left").withColumn("opening_value", F.coalesce("opening_value", F.lit(0.0))).join(chained(paths, by), by)
    flows = out.select(by, c("start").alias("d"), (-c("opening_value")).alias("amount")).unionByName(valued.join(out.select(by), by, "left_semi").select(by, "d", (-c("amount")).alias("amount"))).unionByName(out.select(by, c("end").alias("d"), c("terminal_value").alias("amount")))
    out = out.join(xirr(flows, by).withColumnRenamed("xirr", "rate"), by, "left").join(left_out, by, "left")
    return out.select(
        by, "start", "end", c("span").alias("days"), "partial", "opening_units", "opening_value", "terminal_value", "net_flow", "cash_in", "cash_out", "twr", "annualised", F.when(c("span") >= C.MIN_CAGR_WINDOW_DAYS, c("rate")).alias("xirr"),
        "artifacts", "max_drawdown", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("unvalued_schemes", "unvalued_tx")], F.coalesce("unvalued_flow", F.lit(0.0)).alias("unvalued_flow"),
    )
