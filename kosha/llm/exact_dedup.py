"""Exact deduplication against a persistent index of digests, in DataFrame functions only.

The index is a Parquet table of one entry for each different text, bucketed and
sorted by digest and partitioned by the batch that brought the entry.  A batch
is first reduced to one row for each digest, then cut down by a sort-merge
anti-join with the entries of all other batches, and what is left is appended.
The index is read by its buckets, so it is never shuffled.  A batch overwrites
its own entries only: one that broke off is simply added again.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (binary SHA-256 of the whole text in UTF-8, null as empty) and row (a number of its own) of every row of docs.

    Write the result before use: row numbers hold for one evaluation.
    """
    return docs.select(*_marks(docs, id_col, text_col))


def _marks(docs: DataFrame, id_col: str, text_col: str) -> list:
    digest = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    return [docs[id_col].alias("id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")]


class DigestIndex:
    """Entries (digest, keep_id, keep_row, batch) below a folder that outlives the session.

    location: a folder in storage that all executors share.  buckets: how many
    buckets a new index gets, by default as many as the session has shuffle
    partitions; an index that exists keeps its own number, which is stored
    beside it.  id_type: the SQL type of ids.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, location = spark, location.rstrip("/")
        try:
            self.buckets = spark.read.schema("buckets int").json(f"{location}/layout").first()["buckets"]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.json(f"{location}/layout")
        self.name = f"kosha_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}, keep_row BIGINT, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )
        self.refresh()

    def refresh(self) -> None:
        """See the batches that other sessions have added."""
        self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, batch: str) -> None:
        """Append an entry for every digest of rows (id, digest, row) that no other batch has: the largest id, then the largest row, stays.

        Null ids stand below all others.  Adding a batch again gives the same
        entries; an empty batch adds none.  A batch's name is made of letters,
        digits, '-' and '_'.
        """
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError(f"not a name for a batch: {batch!r}")
        groups = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("top"))
        known = self.entries().where(F.col("batch") != batch).select("digest")
        fresh = groups.join(known.hint("merge"), "digest", "left_anti").select("digest", F.col("top.id").alias("keep_id"), F.col("top.row").alias("keep_row"))
        placed = keep(fresh, "fresh").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT * FROM {{placed}}", placed=placed)

    def find(self, digests: DataFrame) -> DataFrame:
        """digests (distinct digest, more columns) with the entry of each; those without one are left out."""
        return digests.repartition(self.buckets, "digest").join(self.entries().hint("merge"), "digest")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose text no other batch of the index has, one of each text; the index takes them up.

    Of equal texts in docs the row with the largest id stays (null ids last; of
    repeated rows any one).  A null text counts as an empty one.  Texts are
    equal when their SHA-256 digests are.  All columns are returned as they are,
    whatever their names; docs are written to the shared folder once, so that
    rows keep their numbers.
    """
    held = keep(docs.select(F.struct("*").alias("doc"), *_marks(docs, id_col, text_col)), "batch")
    index.add(held.select("id", "digest", "row"), batch)
    stay = index.entries().where(F.col("batch") == batch).select(F.col("digest").alias("k_digest"), F.col("keep_row"))
    return held.join(stay, (F.col("digest") == F.col("k_digest")) & (F.col("row") == F.col("keep_row")), "left_semi").select("doc.*")


def duplicate_groups(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    docs are added to an empty index in two batches, those with the larger ids
    first, so that the row with the largest id of all equal texts stays.  Null
    ids come last, null texts count as empty, and of rows with equal id and
    text one stays.  An empty table gives an empty result.  Group sizes are
    counted before they are joined; one text that a third of all rows have is
    one row of the table joined, and Spark splits the other side.
    """
    rows = keep(fingerprints(docs, id_col, text_col), "fingerprints")
    middle = rows.agg(F.percentile_approx("id", 0.5)).first()[0]
    late = F.coalesce(F.col("id") > F.lit(middle), F.lit(False))
    index.add(rows.where(late), "0")
    index.add(rows.where(~late), "1")
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = keep(index.find(sizes).drop("batch"), "groups")
    kept = F.col("row") == F.col("keep_row")
    return rows.join(groups, "digest").select("id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
