"""Exact positions of rows within ordered groups, without gathering a group anywhere.

One global range partitioning by group and order spreads even a single huge group over many
partitions. Each sorted partition numbers its own rows in one Arrow pass; only the groups at
a partition's edges can continue elsewhere, so the offsets come from a table of at most two
rows per partition, whose prefix sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import cut, parallelism, ship


def grouped_positions(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], at_most: int | None = None, partitions: int | None = None
) -> DataFrame:
    """Adds ``position`` (1, 2, ... within the group, in the given order).

    ``groups`` are columns of ``df``; nulls form a group like any value. ``order`` must settle all
    ties for the result to be the same in every run. With ``at_most`` only rows up to that
    position stay, and each partition drops the rest before anything is written or joined.
    The numbered rows are written once to the checkpoint folder, since the offsets and the
    result must see the same partitions. An empty input gives an empty result; an input
    column called ``position`` is replaced.
    """
    ship(df.sparkSession)
    df = df.drop("position", "__part", "__ends")
    keys = [F.col(g).asc_nulls_first() for g in groups]
    ranged = df.repartitionByRange(partitions or parallelism(df), *keys, *order).sortWithinPartitions(*keys, *order)
    added = [T.StructField("position", T.LongType()), T.StructField("__part", T.IntegerType()), T.StructField("__ends", T.LongType())]
    numbered = cut(ranged.mapInArrow(_numbering(list(groups), at_most), T.StructType(list(df.schema.fields) + added)))
    # The Arrow pass marked the last row of the first and of the last group of each partition with its position there.
    key = [F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]
    ends = numbered.filter("__ends IS NOT NULL").select(F.col("__part").alias("__p"), F.col("__ends").alias("__n"), *key)
    before = Window.partitionBy(*[f"__g{i}" for i in range(len(groups))]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.withColumn("__before", F.sum("__n").over(before)).filter("__before > 0").drop("__n")
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    # The broadcast side is bounded: at most two rows per partition.
    joined = numbered.join(F.broadcast(offsets), same, "left")
    out = joined.withColumn("position", F.col("position") + F.coalesce("__before", F.lit(0)))
    if at_most is not None:
        out = out.filter(F.col("position") <= at_most)
    return out.select(*df.columns, "position")


def _numbering(groups: list[str], at_most: int | None):
    """Numbers the rows of one sorted partition within each run of equal group values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, held, ended = TaskContext.get().partitionId(), None, 0, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(batch.schema.get_field_index(g)) for g in groups]
            first = np.flatnonzero(np.concatenate([[True], _changes(keys)]))
            position = np.arange(batch.num_rows) - np.repeat(first, np.diff(np.append(first, batch.num_rows))) + 1
            head = [k.slice(0, 1) for k in keys]
            if last is not None and not _changes([pa.concat_arrays([a, b]) for a, b in zip(last, head)])[0]:
                position[: first[1] if len(first) > 1 else None] += seen
            last, seen = [k.slice(batch.num_rows - 1, 1) for k in keys], int(position[-1])
            columns = [*batch.columns, pa.array(position, pa.int64()), pa.array(np.full(batch.num_rows, part, np.int32))]
            out = pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "position", "__part"])
            out = out if at_most is None else out.filter(pa.array(position <= at_most))
            if not out.num_rows:
                continue
            # A row ends its run if the next one has position 1. The last row waits to see that.
            starts = np.flatnonzero(out.column(out.num_columns - 2).to_numpy() == 1)
            if held is not None:
                ends_first = not ended and len(starts) > 0 and starts[0] == 0
                ended = ended or ends_first
                yield _marked(held, [0] if ends_first else [])
            inner = starts[starts > 0]
            rest, held = out.slice(0, out.num_rows - 1), out.slice(out.num_rows - 1, 1)
            if rest.num_rows:
                yield _marked(rest, [] if ended or not len(inner) else [int(inner[0]) - 1])
            ended = ended or len(inner) > 0
        if held is not None:
            yield _marked(held, [0])

    return run


def _marked(batch: pa.RecordBatch, rows: list[int]) -> pa.RecordBatch:
    """Adds ``__ends``: the position at these rows, null elsewhere."""
    at = np.zeros(batch.num_rows, dtype=bool)
    at[rows] = True
    position = batch.column(batch.num_columns - 2).to_numpy()
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(position, pa.int64(), mask=~at)], names=[*batch.schema.names, "__ends"])


def _changes(keys: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first differs from the row before it; nulls and NaNs are equal."""
    out = np.zeros(max(0, len(keys[0]) - 1), dtype=bool)
    for k in keys:
        a, b = k.slice(1), k.slice(0, len(k) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(k.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        out |= differ.to_numpy(zero_copy_only=False)
    return out
