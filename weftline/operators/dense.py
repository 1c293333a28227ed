"""Nearest rows by dense vectors: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import top_k
from weftline.session import cut, ship


def nearest(rows: DataFrame, queries: DataFrame, id_column: str, vector_column: str, k: int, block: int = 512) -> DataFrame:
    """``(q, c, sim, rank)``: the k rows most similar to each query row, itself excluded.

    Queries are packed into blocks; each block meets each batch of rows as one matrix product, and
    only k candidates per query leave a batch, so what is shuffled is bounded by the number of
    batches, not of pairs. Exact. Null and empty vectors, and vectors of norm 0, have similarity 0
    with everything and don't appear as candidates; ties go to the smaller id.
    """
    ship(rows.sparkSession)
    all_rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    asked = queries.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    n_blocks = max(1, -(-asked.count() // block))
    packed = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("qs"))
    n_tiles = max(1, -(-all_rows.count() // (4 * block)))
    tiles = all_rows.groupBy(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_tiles)).alias("t")).agg(F.collect_list(F.struct("id", "v")).alias("rs"))
    # Each block of queries goes to each tile once: the stated query set against all rows.
    spread = packed.select("qs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long"))).alias("t"))
    met = spread.join(tiles, "t").select("qs", "rs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_best(batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten(), k) for i in range(batch.num_rows)]
            q, c, s = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["q", "c", "sim"])

    return top_k(cut(met.mapInArrow(run, "q long, c long, sim double")), k)


def _matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.field(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(ids), -1)
    norm = np.sqrt((m * m).sum(axis=1))
    keep = norm > 0
    return ids[keep], m[keep] / norm[keep, None]


def _best(queries: pa.Array, rows: pa.Array, k: int):
    qi, q = _matrix(queries)
    ri, r = _matrix(rows)
    if not len(qi) or not len(ri):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    sim = q @ r.T
    sim[qi[:, None] == ri[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(ri, sim.shape), -sim), axis=1)[:, :k]
    at = np.repeat(np.arange(len(qi)), order.shape[1])
    s = sim[at, order.reshape(-1)]
    real = np.isfinite(s)
    return qi[at][real], ri[order.reshape(-1)][real], s[real]
