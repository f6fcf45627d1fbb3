"""Structured Streaming: price drops merged as they arrive, daily bars with late data, and sliding counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kosha.operators.merge import latest_wins

NAV_SCHEMA = "scheme_id long, d date, nav double, received timestamp"


def read_drops(spark: SparkSession, folder: str, schema: str = NAV_SCHEMA, files: int = 100) -> DataFrame:
    """A stream of JSON files; malformed lines are dropped, at most `files` files in a batch."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files).json(folder)


def upsert_revisions(stream: DataFrame, table: str, checkpoint: str, keys: tuple[str, ...] = ("scheme_id", "d"), order: tuple[str, ...] = ("received",)):
    """Keep the last received row of each key under `table`, one new version for each batch; the newest is named by its number.

    A batch that runs again after a failure writes the same version again, so
    the result is the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = versions(spark, table, number)
        rows = batch if before is None else before.unionByName(batch)
        latest_wins(rows, list(keys), list(order)).write.mode("overwrite").parquet(f"{table}/v{number:09d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, table: str, below: int | None = None) -> DataFrame | None:
    """The newest complete version, or the newest below a number; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [s.getPath() for s in fs.listStatus(path)]
    names = sorted(p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    names = [n for n in names if below is None or int(n[1:]) < below]
    return spark.read.parquet(f"{table}/{names[-1]}") if names else None


def daily_bars(ticks: DataFrame, late: str = "2 days") -> DataFrame:
    """Open, high, low, close and count for each key and day; ticks later than `late` are dropped with their day's state."""
    order = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), "key")
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("n"))
        .select("key", F.col("window.start").cast("date").alias("d"), "open", "high", "low", "close", "n")
    )


def sliding_status(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by pipeline and status in windows of 24 hours that slide by 6."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "24 hours", "6 hours"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).select("user_id", "event_type", F.col("window.start").alias("start"), "n")


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, as long as its repeats come within `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
