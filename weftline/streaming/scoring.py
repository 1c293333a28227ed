"""Scoring new records as they arrive, and counts of events in time windows (extensions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import TextConfig
from weftline.operators.ranking import top_k
from weftline.operators.similarity import normalised
from weftline.operators.tfidf import idf, term_frequencies, tokenise


def scorer(units: DataFrame, statistics: DataFrame, n_docs: int, config: TextConfig, k: int, sink: Callable[[DataFrame, int], None]):
    """A ``foreachBatch`` function: the k most similar known records of each new one (idx, doc).

    ``units`` are normalised weights of the known records and ``statistics`` their (term, df); unknown terms of a
    new record don't count.
    """

    def score(batch: DataFrame, epoch: int) -> None:
        tf = term_frequencies(tokenise(batch, config)).join(statistics.select("term", "df"), "term")
        weighted = tf.select("idx", "term", "df", (F.col("tf") * idf(F.col("df"), n_docs)).alias("w"))
        new = normalised(weighted).select(F.col("idx").alias("q"), "term", F.col("u").alias("uq"))
        met = new.join(units.select(F.col("idx").alias("c"), "term", "u"), "term").groupBy("q", "c").agg(F.sum(F.col("uq") * F.col("u")).alias("sim"))
        sink(top_k(met, k), epoch)

    return score


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per kind and tumbling window; works on streams and on tables."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("__t", late)
    out = stamped.groupBy(F.window("__t", width).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total")
