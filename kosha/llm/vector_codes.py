"""Compression of vectors to codes by integer codebooks.

Components become integers, so that every distance is exact.  Codebooks are
small and travel with the tasks; Arrow batches are scored by
|x|^2 - 2 x.c + |c|^2 in int64, the first of the nearest entries wins, and what
a task's vectors add to each entry is summed before it is shuffled by part and
entry.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, keep, slices


def whole_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and has neither null nor non-finite components."""
    finite = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.where(F.col(vector_col).isNotNull() & finite)


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of a batch's vectors, a row each; products with 256 are exact."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256.0)
    largest = math.isqrt(2**60 // width)  # so much that no sum of squares leaves 63 bits
    if x.size and np.abs(x).max() > largest:
        raise ValueError(f"a component is larger than {largest // 256}: distances would leave 64 bits")
    return x.astype(np.int64).reshape(-1, width)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of ties) and squared distance to it, both (rows, parts), in exact int64.

    x: (rows, width); books: (parts, entries, width / parts).
    """
    parts, _, n = books.shape
    x = x.reshape(len(x), parts, n)
    index, distance = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for p in range(parts):
        away = (books[p] ** 2).sum(1) - 2 * (x[:, p] @ books[p].T)
        index[:, p] = away.argmin(1)
        distance[:, p] = (x[:, p] ** 2).sum(1) + np.take_along_axis(away, index[:, p, None], 1)[:, 0]
    return index, distance


def _entry_sums(rows: DataFrame, vector_col: str, books: np.ndarray) -> DataFrame:
    """part, entry, n and sums (of components) of the vectors nearest to each entry."""
    parts, entries, n = books.shape

    def run(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in slices(batches, 2000):
            x = _integers(b.column(0), parts * n)
            index, _ = nearest(x, books)
            for p in range(parts):
                np.add.at(sums[p], index[:, p], x[:, p * n : p * n + n])
                counts[p] += np.bincount(index[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    sums = rows.select(vector_col).mapInArrow(run, "part long, entry long, n long, sums array<long>")
    return sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(n)])


def fit_codebooks(vectors: DataFrame, width: int, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks (parts, entries, width / parts), int64, of vectors without null or non-finite components.

    They start as the parts of the vectors with the `entries` smallest ids (null
    ids last, equal ids by their components); with fewer vectors there are fewer
    entries.  In each round every entry becomes the floor of the mean of the
    parts nearest to it; unused ones stay.  Without vectors there are no entries.
    All vectors must have `width` components, a multiple of `parts`.  The driver holds
    codebooks only: parts x entries rows a round.
    """
    shape = vectors.agg(F.min(F.size(vector_col)).alias("least"), F.max(F.size(vector_col)).alias("most")).first()
    width = shape["most"]
    if width is None:
        return np.zeros((parts, 0, 0), np.int64)
    if shape["least"] != width or width % parts or not width:
        raise ValueError(f"vectors of {shape['least']} to {width} components can't be cut into {parts} equal parts")
    first = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = _integers(pa.array([list(r["v"]) for r in first], pa.list_(pa.float64())), width)
    books = np.ascontiguousarray(start.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        for r in _entry_sums(vectors, vector_col, books).collect():  # at most parts x entries rows
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(books.shape[2])]
    return books


def encode_vectors(vectors: DataFrame, books: np.ndarray, vector_col: str = "embedding", others: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """Columns `others` of every vector with codes (array of entry indexes, in part order) and error (squared distances summed over parts)."""
    schema = vectors.select(*others).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    width = books.shape[0] * books.shape[2]

    def run(batches):
        for b in slices(batches, 2000):
            index, distance = nearest(_integers(b.column(0), width), books)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, index.size + 1, index.shape[1], dtype=np.int32)), pa.array(index.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], codes, pa.array(distance.sum(1))], names=[*others, "codes", "error"])

    return vectors.select(F.col(vector_col).alias("__v"), *others).mapInArrow(run, f"{fields}, codes array<int>, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes, error, label_error of every whole vector; the codebooks).

    Vectors that are null or hold null or non-finite components are left out, and
    so are those of another length than most of the vectors that `parts` equal
    parts can be cut from (of equally many, the longer).  label_error: errors summed over
    equal labels, null labels together.  Repeated rows stay repeated; an empty
    table gives an empty result.  Other columns are not returned, so their names
    don't matter.  Components beyond 2^30 / 256 / sqrt(width) in size raise,
    since their distances would not fit in 64 bits.
    """
    named = whole_vectors(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")), "v")
    lengths = named.groupBy(F.size("v").alias("width")).count().where((F.col("width") > 0) & (F.col("width") % parts == 0))
    most = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    width = most["width"] if most else parts
    named = named.where(F.size("v") == width)
    books = fit_codebooks(named, width, "id", "v", parts, entries, rounds)
    coded = keep(encode_vectors(named, books, "v", ("id", "label")), "codes")
    totals = broadcast_if_small(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "t_label"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("t_label"))).drop("t_label"), books


def codebooks_text(books: np.ndarray) -> str:
    """All components in decimal, by part, entry and position, comma-joined."""
    return ",".join(map(str, books.ravel().tolist()))


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(codebooks_text(books).encode()).hexdigest()
