"""Group identifiers for records that are linked by pairs, directly or through others.

Seed-tree pruning. In each round every vertex looks at itself and its neighbours and connects
all of them to the smallest of these (``minimum selection``). A vertex that nobody, itself
included, took for a minimum can never become the identifier of its group: it leaves the graph
and is kept as a child of its minimum in a propagation forest. The remaining vertices stay
linked through the minima they heard of. The graph shrinks until no edge is left; the vertices
that never left are the seeds, and their identifiers flow down the forest, last round first.

Once a round leaves at most ``LOCAL_EDGES`` edges, a number that doesn't depend on the data, the same rounds go
on over arrays in one task, which saves the jobs of rounds that have next to nothing to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.frequent import join_counted, join_spread
from weftline.session import cut, drop, ship

#: At most so many edges are handed to one task for the last rounds.
LOCAL_EDGES = 50_000
#: At most so many vertices are handled apart, through a broadcast, for their many neighbours.
FREQUENT_VERTICES = 2_000


def connected_groups(links: DataFrame, left: str, right: str, max_rounds: int = 100, local_edges: int | None = None) -> DataFrame:
    """``(record_id, group_id)``: every value of either column with the smallest of its group.

    A row links its two values; a row with one null names the other value only, and a row
    with two nulls names nothing. Rows may repeat, link a value to itself, and come in any
    direction. Values are compared in their own type's order. Further columns of ``links`` are
    not read, so their names don't matter. An empty table gives an empty result. Rounds grow
    with the logarithm of the longest chain; ``max_rounds`` only guards against a defect.

    Each round's edges are written to the checkpoint folder, and the tables of the round before are removed: lost
    executors cost a round at most. No group, neighbourhood or edge list is ever gathered, but for the last edges, of bounded
    number: all steps are pre-aggregated minima and equi-joins, and the joins on very frequent vertices go
    through a broadcast of their minima, whose number is bounded.
    """
    local_edges = LOCAL_EDGES if local_edges is None else local_edges
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v"))
    pairs = cut(pairs.filter("u IS NOT NULL OR v IS NOT NULL").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    vertices = pairs.select(F.explode(F.array("u", "v")).alias("record_id")).distinct()
    edges = pairs.filter("u != v")
    forest: list[DataFrame] = []
    n_edges = edges.count()
    for _ in range(max_rounds):
        if n_edges <= local_edges:
            break
        heard = cut(_minimum_selection(edges))
        onward, level = _prune(heard)
        forest.append(level)
        last, edges = edges, cut(onward)
        drop(heard, last)
        n_edges = edges.count()
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    known = [cut(_rest_of_forest(edges))] if n_edges else []
    for level in reversed(forest):
        tree = level.filter("NOT stays").select(F.col("v").alias("record_id"), F.col("least").alias("parent"))
        if not known:
            known.append(tree.select("record_id", F.col("parent").alias("group_id")))
            continue
        up = _all(known).select(F.col("record_id").alias("parent"), "group_id")
        named = join_spread(tree, up, "parent", ["group_id"], "left", FREQUENT_VERTICES)
        known.append(cut(named.select("record_id", F.coalesce("group_id", "parent").alias("group_id"))))
    if not known:
        return vertices.select("record_id", F.col("record_id").alias("group_id"))
    return vertices.join(_all(known), "record_id", "left").select("record_id", F.coalesce("group_id", "record_id").alias("group_id"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _minimum_selection(edges: DataFrame) -> DataFrame:
    """``(v, m)``, distinct: ``m`` is the minimum around some neighbour of ``v`` or ``v`` itself."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    around = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    around = cut(around.select("u", F.least("u", "m").alias("m"), "degree"))
    told = join_counted(both, around, "u", "degree", ["m"], FREQUENT_VERTICES)
    own = around.select(F.col("u").alias("v"), "m")
    return told.select("v", "m").unionByName(own).distinct()


def _prune(heard: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next edges; and ``(v, least, stays, n)`` of every vertex: those that don't stay leave as children of their least."""
    least = cut(heard.groupBy("v").agg(F.min("m").alias("least"), F.max(F.col("m") == F.col("v")).alias("stays"), F.count(F.lit(1)).alias("n")))
    # Only vertices that heard of several minima carry edges on; they link these minima.
    onward = join_counted(heard, least.filter("n > 1"), "v", "n", ["least"], FREQUENT_VERTICES).filter("m != least")
    return onward.select(F.least("m", "least").alias("u"), F.greatest("m", "least").alias("v")).distinct(), least


def _rest_of_forest(edges: DataFrame) -> DataFrame:
    """``(record_id, group_id)`` of all vertices of a bounded number of edges but the seeds: the remaining rounds, in one task."""
    ship(edges.sparkSession)
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if tables:
            ends = pa.concat_arrays([b.column(k) for k in (0, 1) for b in tables])
            names = pc.unique(ends)
            names = names.take(pc.sort_indices(names))  # numbers in the order of the names
            number = pc.index_in(ends, names).to_numpy().astype(np.int64)
            seed = seeds(number[: len(number) // 2], number[len(number) // 2 :], len(names))
            child = np.flatnonzero(seed != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(child)), names.take(pa.array(seed[child]))], names=["record_id", "group_id"])

    return edges.coalesce(1).mapInArrow(run, f"record_id {kind}, group_id {kind}")


def seeds(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least vertex linked to each of the vertices 0 to n - 1, by the rounds of the module on arrays."""
    levels = []
    while len(u):
        a, b = np.concatenate([u, v]), np.concatenate([v, u])
        around = np.arange(n)
        np.minimum.at(around, a, b)
        inside = np.unique(a)
        heard = np.unique(np.concatenate([b * n + around[a], inside * n + around[inside]]))
        at, m = heard // n, heard % n  # in order of vertex and minimum
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        least = np.repeat(m[first], np.diff(np.append(first, len(at))))
        stays = np.zeros(n, bool)
        stays[at[at == m]] = True
        leaves = at[first][~stays[at[first]]]
        parent = np.arange(n)
        parent[at[first]] = m[first]
        levels.append((leaves, parent[leaves]))
        onward = m != least
        low, high = least[onward], m[onward]
        edges = np.unique(low * n + high)
        u, v = edges // n, edges % n
    seed = np.arange(n)
    for leaves, parents in reversed(levels):
        seed[leaves] = seed[parents]
    return seed
