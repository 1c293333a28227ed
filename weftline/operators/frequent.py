"""Joins on keys of any frequency: very frequent keys are joined through a broadcast of bounded size.

Of all keys, at most ``bound`` can have more than a share ``1 / bound`` of all rows. Their side of the join is
broadcast, so their rows stay where they are; all other keys are joined by a shuffle in which none
weighs much.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are broadcast.
FREQUENT_KEYS = 65_536


def frequent_share(bound: int, total: int) -> int:
    """The least count that at most ``bound`` keys can reach when all counts sum to ``total``."""
    return total // bound + 1


def is_small(table: DataFrame) -> bool:
    """Whether Spark estimates the table below the size up to which it broadcasts by itself."""
    limit = int(table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, values: Sequence[str], bound: int = FREQUENT_KEYS) -> DataFrame:
    """``rows`` with the columns ``values`` of ``table``, which has one row for each ``key`` and, as ``count``, how many rows
    have it (or a number in proportion). Rows whose key is null or not in the table are left out.

    ``table`` and ``rows`` are read more than once and should be written tables.
    """
    keep = [F.col(c) for c in rows.columns]
    if is_small(table.select(key, *values)):
        return rows.join(table.select(key, *values), key).select(*keep, *values)
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = F.col(count) >= max(2, frequent_share(bound, total))
    frequent = F.broadcast(table.filter(often).select(key, *values))
    names = F.broadcast(table.filter(often).select(key))
    hot = rows.join(frequent, key).select(*keep, *values)
    cold = rows.join(names, key, "left_anti").join(table.filter(~often).select(key, *values), key).select(*keep, *values)
    return hot.unionByName(cold)


def join_spread(rows: DataFrame, table: DataFrame, key: str, values: Sequence[str], how: str = "inner", bound: int = FREQUENT_KEYS) -> DataFrame:
    """``rows`` with the columns ``values`` of ``table`` (one row for each ``key``), whatever the frequency of a key among the rows;
    the frequent ones are found by a pre-aggregated count. With ``how="left"`` rows without a partner stay, with nulls."""
    keep = [F.col(c) for c in rows.columns]
    right = table.select(key, *values)
    if is_small(right):
        return rows.join(right, key, how).select(*keep, *values)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    often = counts.filter(F.col("__n") >= max(2, frequent_share(bound, total))).select(key)
    names = [r[0] for r in often.collect() if r[0] is not None]  # bounded
    if not names:
        return rows.join(right, key, how).select(*keep, *values)
    listed = F.broadcast(rows.sparkSession.createDataFrame([(n,) for n in names], rows.select(key).schema))
    hot = rows.join(listed, key, "left_semi").join(F.broadcast(right.join(listed, key, "left_semi")), key, how).select(*keep, *values)
    cold = rows.join(listed, key, "left_anti").join(right, key, how).select(*keep, *values)
    return hot.unionByName(cold)
