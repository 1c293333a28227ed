"""The N best items of every group, for millions of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.positions import grouped_positions


def sort_keys(order: Sequence[tuple[str, bool]]) -> list[Column]:
    """Ascending sort columns for (column, descending) pairs; nulls come last either way.
    Descending columns must be numeric."""
    keys = []
    for name, descending in order:
        keys += [F.col(name).isNull(), -F.col(name) if descending else F.col(name)]
    return keys


def top_n(
    df: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, bool]], n: int, distinct: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Keeps the first ``n`` rows of each group in the given order and adds their ``position``.

    ``order`` holds (column, descending) pairs and must settle all ties; nulls in it come last.
    With ``distinct`` only the first row of each distinct value of these columns within the
    group takes part; that choice is a pre-aggregated minimum, so repeated rows shrink before
    the first shuffle. The rows are then sorted once, range-partitioned by group and order, and
    numbered exactly across partitions (see ``grouped_positions``), so a group with a third of
    all rows is spread like any other rows. Null groups are a group. Input columns keep their
    names; one called ``position`` is replaced. A group of fewer than ``n`` rows stays whole;
    an empty table gives an empty result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    df = df.drop("position")
    if distinct:
        rank = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(order))])
        keyed = df.select(F.struct(*df.columns).alias("__row"), rank.alias("__rank"), *[F.col(c).alias(f"__d{i}") for i, c in enumerate([*groups, *distinct])])
        best = keyed.groupBy(*[c for c in keyed.columns if c.startswith("__d")]).agg(F.min(F.struct("__rank", "__row")).alias("__best"))
        df = best.select("__best.__row.*")
    return grouped_positions(df, groups, sort_keys(order), at_most=n, partitions=partitions)
