"""Running totals over rows of any number, one key or many: ranges of the order are totalled apart, then moved by what stands before them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import keep

_JOIN = {"sum": np.add, "xor": np.bitwise_xor}


def _before(values: np.ndarray, start: np.ndarray, carried: np.int64, kind: str) -> np.ndarray:
    """Total of the values before each one in its group; start: index of the group's first value, -1 where it began in an earlier batch."""
    join = _JOIN[kind]
    before = np.concatenate([np.zeros(1, np.int64), join.accumulate(values)[:-1]])
    base = before[start]
    if kind == "sum":
        return before - np.where(start < 0, -carried, base)
    return before ^ np.where(start < 0, carried, base)


def running(rows: DataFrame, order: list[Column], totals: dict[str, tuple[str, str]], within: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """`columns` of rows (all by default) and, for each name: (column, "sum" or "xor") of totals, the total of that column over the rows that stand before, 0 for the first.

    With `within`, a long column without nulls, totals are those of the rows with
    an equal value.  Totalled columns are longs without nulls, whose sums fit in
    63 bits.  Rows are dealt out by ranges of the order, so neither one value of `within`
    nor the lack of it puts them into one task; what a range carries on is one
    row for each range and value.  Rows of equal order follow each other in any
    order.  rows are read twice.
    """
    columns = columns or rows.columns
    order = [F.col(within), *order] if within else order
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
    schema = T.StructType([*placed.schema.fields, *(T.StructField(n, T.LongType()) for n in totals), T.StructField("__part", T.LongType())])

    def run(batches):
        part, key, carried = TaskContext.get().partitionId(), None, dict.fromkeys(totals, np.int64(0))
        for b in batches:
            if not b.num_rows:
                continue
            first = np.zeros(b.num_rows, bool)
            if within:
                keys = b.column(within).to_numpy()
                first[1:] = keys[1:] != keys[:-1]
                first[0] = key is not None and keys[0] != key
                key = keys[-1]
            start = np.maximum.accumulate(np.where(first, np.arange(b.num_rows), -1))
            out = []
            for name, (column, kind) in totals.items():
                v = b.column(column).to_numpy()
                out.append(_before(v, start, carried[name], kind))
                carried[name] = _JOIN[kind](out[-1][-1], v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out), pa.array(np.full(b.num_rows, part, np.int64))], names=schema.names)

    held = keep(placed.mapInArrow(run, schema), "running")
    own = [within, "__part"] if within else ["__part"]
    merged = {"sum": F.sum, "xor": F.bit_xor}
    pieces = held.groupBy(*own).agg(*[merged[kind](column).alias(f"__{name}") for name, (column, kind) in totals.items()])
    earlier = (Window.partitionBy(within) if within else Window).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    moved = pieces.select(*own, *[merged[kind](f"__{name}").over(earlier).alias(f"__{name}") for name, (_, kind) in totals.items()])
    moved = moved.where(" OR ".join(f"__{name} IS NOT NULL" for name in totals))  # at most one row for each range
    both = held.join(F.broadcast(moved), own, "left")
    add = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    return both.select(*columns, *[add[kind](F.col(name), F.coalesce(f"__{name}", F.lit(0))).alias(name) for name, (_, kind) in totals.items()])
