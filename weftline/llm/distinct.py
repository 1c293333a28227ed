"""How distinctive a term is for a record, against the whole collection.

``enrichment`` scores by the exact hypergeometric upper tail: drawing as many occurrences as
the record has from all occurrences of the collection, how unlikely is it to draw the term at
least as often as the record holds it? The score is the negative decimal logarithm of that
probability after a false-discovery adjustment over the terms of the record.

``frequency_scores`` gives the max-normalised frequency times ln(N/df) of the same counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.frequent import join_counted
from weftline.session import cut, ship

# Coefficients of the Lanczos approximation of the gamma function (g = 7, n = 9).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def term_counts(records: DataFrame, id_column: str, terms_column: str) -> DataFrame:
    """``(id, term, tf, max_tf, length)``: the counts of every term of every record.

    Counting happens inside Arrow batches, since all terms of a record are in its row: no
    shuffle. Records without terms (null, empty) have no rows; null terms don't count.
    """
    ship(records.sparkSession)
    flat = records.select(F.col(id_column).cast("long").alias("id"), F.array_compact(F.col(terms_column)).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _count(batch)

    flat = flat.filter(F.size("terms") > 0)
    return flat.mapInArrow(run, "id long, term string, tf long, max_tf long, length long")


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists, ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
    words = pc.dictionary_encode(lists.flatten())
    length = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    base = max(1, len(words.dictionary))
    keys, tf = np.unique(row * base + words.indices.to_numpy(), return_counts=True)
    of, word = keys // base, keys % base
    most = np.zeros(len(length), np.int64)
    np.maximum.at(most, of, tf)
    term = words.dictionary.take(pa.array(word)).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(ids[of]), term, pa.array(tf), pa.array(most[of]), pa.array(length[of])], names=["id", "term", "tf", "max_tf", "length"])


def with_statistics(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows with ``df`` (records that have the term) and ``cf`` (its occurrences).

    ``counts`` covers the collection, ``wanted`` are those of its rows to be scored. Terms so frequent
    that few can be are joined by broadcast, so the bulk of all rows stays
    where it is and no frequent term gathers its rows in one task.
    """
    stats = cut(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    return join_counted(wanted, stats, "term", "df", ["df", "cf"])


def frequency_scores(scored: DataFrame, records: int) -> DataFrame:
    """Adds ``score`` = round(tf / max_tf * ln(records / df), 6)."""
    return scored.withColumn("score", F.round(F.col("tf") / F.col("max_tf") * F.log(F.lit(float(records)) / F.col("df")), 6))


def best_terms(scored: DataFrame, score: str = "score") -> DataFrame:
    """``(id, term)``: each record's term of highest score, of equal ones the alphabetically first.

    A pre-aggregated minimum; a record's terms are never gathered."""
    first = F.min(F.struct((-F.col(score)).alias("s"), "term")).alias("first")
    return scored.groupBy("id").agg(first).select("id", "first.term")


def enrichment(scored: DataFrame, occurrences: int) -> DataFrame:
    """Adds ``log10_p``, ``q`` and ``score`` to rows with tf, length and cf.

    ``log10_p`` is the decimal logarithm of the exact probability that ``length`` draws without
    replacement from ``occurrences``, ``cf`` of them the term, hold it at least ``tf`` times. ``q`` is
    the adjusted probability (Benjamini and Hochberg, over the terms of one record), ``score``
    the negative decimal logarithm of the adjusted probability, 0 at least. Equal counts give
    equal scores; a term that is all of the collection scores 0.
    """
    ship(scored.sparkSession)

    @F.pandas_udf("double")
    def tail(tf: pd.Series, length: pd.Series, cf: pd.Series) -> pd.Series:
        return pd.Series(log10_upper_tail(tf.to_numpy(), length.to_numpy(), cf.to_numpy(), occurrences))

    tested = scored.withColumn("log10_p", tail("tf", "length", "cf"))
    # One window over a record's distinct terms: bounded by the record itself.
    record = Window.partitionBy("id").orderBy("log10_p", "term")
    ranked = tested.withColumn("__rank", F.row_number().over(record)).withColumn("__tests", F.count(F.lit(1)).over(Window.partitionBy("id")))
    ranked = ranked.withColumn("__adjusted", F.col("log10_p") + F.log10(F.col("__tests") / F.col("__rank")))
    following = record.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    log_q = F.least(F.lit(0.0), F.min("__adjusted").over(following))
    out = ranked.withColumn("__log_q", log_q).withColumn("q", F.pow(F.lit(10.0), F.col("__log_q"))).withColumn("score", F.abs("__log_q"))
    return out.drop("__rank", "__tests", "__adjusted", "__log_q")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x >= 1."""
    y = np.asarray(x, float) - 1
    series = LANCZOS[0] + sum(c / (y + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = y + 7.5
    return 0.5 * np.log(2 * np.pi) + (y + 0.5) * np.log(t) - t + np.log(series)


#: From here on Stirling's series is exact in double precision.
STIRLING_FROM = 32.0


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * z * z)) / (z * z)) / (z * z)) / z


def log_falling(n: np.ndarray, r: np.ndarray, base: float | np.ndarray = 1.0) -> np.ndarray:
    """log of n (n - 1) ... (n - r + 1) / base ** r.

    As a difference of Stirling's series, in which the large parts cancel by rule and not by subtraction: the error grows with
    the terms drawn and not with n. Where few are left, the two log-gammas are subtracted: then r is nearly n.
    """
    a, b = n + 1.0, n - r + 1.0
    many = b >= STIRLING_FROM
    big_a, big_b = np.where(many, a, STIRLING_FROM), np.where(many, b, STIRLING_FROM)
    step = np.where(many, r, 0.0)
    smooth = step * np.log1p((big_a - base) / base) - (big_b - 0.5) * np.log1p(-step / big_a) - step + _stirling_rest(big_a) - _stirling_rest(big_b)
    plain = log_gamma(np.where(many, 1.0, a)) - log_gamma(np.where(many, 1.0, b)) - np.where(many, 0.0, r) * np.log(base)
    return np.where(many, smooth, plain)


def log10_upper_tail(k, n, marked, total: int) -> np.ndarray:
    """log10 P(X >= k) for X hypergeometric: n draws from ``total`` items, ``marked`` of them marked.

    Exact to about 1e-9 for collections of up to 1e13 items and more. Equal inputs are computed once. The tail is summed term by term from its first, each
    from the one before, until what is left cannot change the sum; where the tail is the larger
    side, the lower side is summed instead and subtracted.
    """
    table = np.stack([np.asarray(k, np.int64), np.asarray(n, np.int64), np.asarray(marked, np.int64)])
    if not table.shape[1]:
        return np.empty(0)
    rows, back = np.unique(table, axis=1, return_inverse=True)
    k, n, marked = (r.astype(float) for r in rows)
    total = float(total)
    least = np.maximum(0, n + marked - total)
    most = np.minimum(n, marked)
    upper = k > (n * marked / total)

    def log_mass(x):
        # log C(marked, x) + log C(total - marked, n - x) - log C(total, n), with total taken out of the two large products.
        own = log_falling(marked, x) - log_gamma(x + 1) + log_falling(n, x) - x * np.log(total + 1)
        return own + log_falling(total - marked, n - x, total + 1) - log_falling(np.full(len(n), total), n, total + 1)

    def summed(x, step, stop, active):
        """log of the mass from x on, in direction step, up to stop."""
        first = np.full(len(x), -np.inf)
        first[active] = log_mass(np.where(active, x, most))[active]
        term, total_sum, x = np.where(active, 1.0, 0.0), np.where(active, 1.0, 0.0), x.copy()
        live = active & (x != stop)
        while live.any():
            i = np.flatnonzero(live)
            a, m, d = x[i], marked[i], n[i]
            if step > 0:
                ratio = (m - a) * (d - a) / ((a + 1) * (total - m - d + a + 1))
            else:
                ratio = a * (total - m - d + a) / ((m - a + 1) * (d - a + 1))
            term[i] *= ratio
            total_sum[i] += term[i]
            x[i] = a + step
            live[i] = (x[i] != stop[i]) & (term[i] > total_sum[i] * 1e-17)
        return first + np.log(np.where(total_sum > 0, total_sum, 1.0))

    possible = k <= most
    above = summed(k, 1, most, possible & upper)
    below_active = possible & ~upper & (k > least)
    below = summed(k - 1, -1, least, below_active)
    with np.errstate(divide="ignore"):
        p = np.where(upper, above, np.where(below_active, np.log1p(-np.exp(np.minimum(below, -1e-300))), 0.0))
    p = np.where(possible, p, -np.inf)
    return (np.minimum(p, 0.0) / np.log(10))[back.reshape(-1)]
