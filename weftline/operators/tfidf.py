"""Term statistics and weights in long form: one row per document and term.

Weights are the term's count over the document's largest count, times the unsmoothed ln(N/df).
The largest count is taken over the terms that stay after pruning. Documents without any term
have no rows here; N counts them all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import TextConfig
from weftline.functions.text import tokens
from weftline.operators.frequent import join_counted
from weftline.operators.positions import grouped_positions
from weftline.session import cut


def tokenise(docs: DataFrame, config: TextConfig = TextConfig(), idx: str = "idx", text: str = "doc") -> DataFrame:
    """``(idx, tokens)``."""
    return docs.select(F.col(idx).alias("idx"), tokens(F.col(text), config).alias("tokens"))


def term_frequencies(tokenised: DataFrame) -> DataFrame:
    """``(idx, term, tf)``."""
    return tokenised.select("idx", F.explode("tokens").alias("term")).groupBy("idx", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_statistics(tf: DataFrame) -> DataFrame:
    """``(term, cf, df)``: occurrences and documents of each term."""
    return tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def pruned(statistics: DataFrame, config: TextConfig) -> DataFrame:
    """MU drops terms that occur once; with MU, DO also drops terms of one document. DO alone does nothing."""
    if not config.single_terms:
        return statistics
    kept = statistics.filter("cf > 1")
    return kept.filter("df > 1") if config.single_document_terms else kept


def vocabulary(tokenised: DataFrame, config: TextConfig = TextConfig()) -> DataFrame:
    """``(term, term_idx, cf, df)``: terms numbered from 0 in the order of their first appearance."""
    seen = tokenised.select("idx", F.posexplode("tokens").alias("pos", "term"))
    first = seen.groupBy("term").agg(F.min(F.struct("idx", "pos")).alias("first"), F.count(F.lit(1)).alias("cf"), F.count_distinct("idx").alias("df"))
    kept = pruned(first, config).select("term", "cf", "df", "first.idx", "first.pos", F.lit(0).alias("all"))
    ordered = grouped_positions(kept, ["all"], [F.col("idx"), F.col("pos")])
    return ordered.select("term", (F.col("position") - 1).alias("term_idx"), "cf", "df")


def vocabulary_size(numbered: DataFrame) -> DataFrame:
    """``(vocabulary_size)``: the largest ordinal plus one."""
    return numbered.agg(F.coalesce(F.max("term_idx") + 1, F.lit(0)).alias("vocabulary_size"))


def weights(tf: DataFrame, n_docs: int, config: TextConfig = TextConfig()) -> DataFrame:
    """``(idx, term, t, tf, df, w)``. Terms that are in every document weigh 0 and stay. ``t`` is a number of the term of no meaning,
    by which vectors are compared instead of by text.

    Rows of frequent terms stay where they are when they meet the statistics; the largest counts need one window over a document's
    own terms.
    """
    statistics = cut(pruned(term_statistics(tf), config).select("term", "df", F.monotonically_increasing_id().alias("t")))
    kept = join_counted(tf, statistics, "term", "df", ["df", "t"])
    most = F.max("tf").over(Window.partitionBy("idx"))
    return kept.select("idx", "term", "t", "tf", "df", (F.col("tf") / most * idf(F.col("df"), n_docs)).alias("w"))


def idf(df: Column, n_docs: int) -> Column:
    return F.log(F.lit(float(n_docs)) / df)


def two_vectors(weighted: DataFrame, a, b) -> DataFrame:
    """``(term, vector_a, vector_b)`` of two documents, 0 where one lacks the term."""
    left = weighted.filter(F.col("idx") == a).select("term", F.col("w").alias("vector_a"))
    right = weighted.filter(F.col("idx") == b).select("term", F.col("w").alias("vector_b"))
    return left.join(right, "term", "full_outer").na.fill(0.0, ["vector_a", "vector_b"])


def word_count_maps(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(idx, counts)``: each document's counts as a map from term ordinals."""
    entries = tf.join(vocab.select("term", "term_idx"), "term").groupBy("idx").agg(F.collect_list(F.struct("term_idx", "tf")).alias("e"))
    return entries.select("idx", F.map_from_entries("e").alias("counts"))


def documents_with_stem(counts: DataFrame, stem: str, column: str = "word_count") -> DataFrame:
    """In how many documents a map of word counts holds a stem."""
    return counts.agg(F.count_if(F.map_contains_key(column, stem)).alias("n_documents"))
