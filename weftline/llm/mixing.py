"""Mixing records of several sources so that each has its share of the total size.

Systematic sampling: within a source every record expects the same number of copies. The
running sum of these expectations, moved by one random offset, crosses a whole number once
for each copy; so each record is used as often as it expects, or that number rounded up, with equal chances.
Records are taken in order of size: between two crossings all are of nearly one size, so the size drawn differs from the
expected one by the size of the largest record at most, whatever the offset. The running sum is the exact position
times the expectation: no rounding error builds up however many records there are.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.positions import grouped_positions
from weftline.session import cut


@dataclass(frozen=True)
class Mix:
    """``copies``: (id, source, size, copies) of every record of a source with a target, 0 copies included.
    ``report``: one row per source of the records or the targets."""

    copies: DataFrame
    report: DataFrame


def expected_copies(available: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Copies that each record of a source expects.

    Sources that have a target but no size can't contribute: the others share the total in
    proportion to their targets. Without ``total`` it is the largest at which every such source
    reaches its share within its cap. With ``total``, sources at their cap fall short.
    """
    usable = {s: t for s, t in targets.items() if t[0] > 0 and t[1] > 0 and available.get(s, 0) > 0}
    shares = sum(t[0] for t in usable.values())
    if not usable:
        return {}
    if total is None:
        total = min(available[s] * cap * shares / share for s, (share, cap) in usable.items())
    return {s: min(float(cap), total * share / shares / available[s]) for s, (share, cap) in usable.items()}


def mix(records: DataFrame, id_column: str, source_column: str, size_column: str, targets: DataFrame, total: float | None = None, seed: int = 17) -> Mix:
    """Copies of every record so that sources hold their target shares of the total size.

    ``targets`` has source, target_share and max_repeats; one row per source (of repeated rows the
    least share and cap hold), null shares and caps are 0. No record is used more often than its
    source's cap. Records whose source is null, unknown to the targets, or without size take no
    part; the report names all sources. Records of size null or 0 add nothing and have 0 copies.
    Each source has one random offset, which depends on ``seed`` and its name only, so runs repeat exactly.
    The report gives, beside the shares, the size that each source should have (``size_goal``), by how much the
    size it has differs (``size_error``), and what that can be at most (``error_bound``: its largest record). The target
    table is small by nature (a row per source) and is read by the driver.
    """
    sized = cut(records.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.coalesce(F.col(size_column).cast("long"), F.lit(0)).alias("size")))
    wanted = targets.groupBy("source").agg(F.min(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("cap"))
    goal = {r["source"]: (float(r["share"]), int(r["cap"])) for r in wanted.collect() if r["source"] is not None}
    spark = records.sparkSession
    names = spark.createDataFrame([(s,) for s in sorted(goal)], "source string")
    # A row for each source with a target.
    known = sized.join(F.broadcast(names), "source")
    available = {r["source"]: float(r["size"]) for r in known.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    rate = expected_copies(available, goal, total)
    usable = sum(goal[s][0] for s in rate)
    placed = cut(grouped_positions(known.filter("size > 0"), ["source"], [F.col("size"), F.col("id")]))
    start = {s: random.Random(f"{seed}:{s}").random() for s in rate}
    rows = [(s, share, cap, share / usable if s in rate else 0.0, rate.get(s, 0.0), start.get(s, 0.0), rate.get(s, 0.0) * available.get(s, 0.0)) for s, (share, cap) in sorted(goal.items())]
    plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, reachable_share double, rate double, start double, size_goal double")
    drawn = placed.join(F.broadcast(plan), "source").select("id", "source", "size", _crossings(F.col("start"), F.col("rate")).alias("copies"))
    copies = cut(drawn.unionByName(known.filter("size <= 0").withColumn("copies", F.lit(0).cast("long"))))
    used = copies.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.sum("size").alias("size_available"), F.sum(F.col("size") * F.col("copies")).alias("size_used"),
        F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"), F.max("size").cast("double").alias("error_bound"),
    )
    outside = sized.join(F.broadcast(names), "source", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("size_available"))
    everything = used.unionByName(outside, allowMissingColumns=True)
    report = plan.drop("rate", "start").join(everything, "source", "full_outer")
    report = report.na.fill(0, ["target_share", "reachable_share", "max_repeats", "records", "size_available", "size_used", "copies", "most_repeats", "size_goal", "error_bound"])
    report = report.withColumn("size_error", F.col("size_used") - F.col("size_goal"))
    total_used = float(copies.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0)
    report = report.withColumn("actual_share", F.col("size_used") / F.lit(total_used or 1.0))
    return Mix(copies, report)


def _crossings(start: Column, rate: Column) -> Column:
    """Whole numbers that the moved running sum crosses at a record."""
    position = F.col("position")
    return (F.floor(start + rate * position) - F.floor(start + rate * (position - 1))).cast("long")
