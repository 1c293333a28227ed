"""Cosine similarity of sparse and dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.blocks import sparse_pairs_above
from weftline.session import cut


def normalised(weighted: DataFrame) -> DataFrame:
    """``(idx, term, t, df, u)``, without t and df where they are missing: weights divided by the document's norm. Weights of 0 and documents of norm 0
    vanish: they are similar to nothing."""
    positive = weighted.filter("w > 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("idx")))
    return positive.select(*[c for c in ("idx", "term", "t", "df") if c in weighted.columns], (F.col("w") / norm).alias("u"))


def similar_pairs(weighted: DataFrame, cut_off: float = 0.5, both_directions: bool = False) -> DataFrame:
    """``(i, j, sim)`` of all pairs with a cosine above ``cut_off``, ``i < j`` unless both directions are asked for.

    Exact for any positive cut, without a shuffle of pairs; see ``blocks.sparse_pairs_above``. ``weighted`` has idx, term, t, df, w.
    """
    if cut_off <= 0:
        raise ValueError("the cut must be positive; without shared terms the similarity is 0")
    scored = sparse_pairs_above(normalised(weighted), cut_off)
    if both_directions:
        scored = cut(scored)
        scored = scored.unionByName(scored.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim"))
    return scored


def similar_terms(weighted: DataFrame, vocab: DataFrame, cut_off: float) -> DataFrame:
    """``(i, j, sim)`` of all pairs of terms, by their ``term_idx`` of ``vocab``, whose weights over the documents have a cosine above ``cut_off``."""
    numbers = vocab.select("term", F.col("term_idx").cast("long").alias("i"))
    sizes = F.count(F.lit(1)).over(Window.partitionBy("idx"))  # a document is frequent by how many terms it has
    turned = weighted.filter("w > 0").withColumn("df", sizes).select("term", F.col("idx").cast("long").alias("t"), "df", "w")
    return similar_pairs(turned.join(numbers, "term").select(F.col("i").alias("idx"), "t", "df", "w"), cut_off)


def probe_similarities(units: DataFrame, probes: DataFrame) -> DataFrame:
    """``(q, c, sim)`` for each probe ``q`` (a column ``idx``) and every document that shares a term with it."""
    keyed = units.select("idx", "t", "u")
    asked = keyed.join(probes.select("idx").distinct(), "idx", "left_semi").select(F.col("idx").alias("q"), "t", F.col("u").alias("uq"))
    met = asked.join(keyed.select(F.col("idx").alias("c"), "t", F.col("u").alias("uc")), "t")
    return met.groupBy("q", "c").agg(F.sum(F.col("uq") * F.col("uc")).alias("sim"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors: 0 if a norm is 0; vectors of unequal length are an error."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    safe = F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
    return F.when(F.size(a) == F.size(b), safe).otherwise(F.raise_error(F.lit("vectors of unequal length")).cast("double"))


def pair_similarity(weighted: DataFrame, ids: DataFrame, a: str, b: str) -> DataFrame:
    """``(found, sim)`` for two record ids: their cosine, or found = false where an id is not in the set.

    ``ids`` has id and idx; the first record of an id counts.
    """
    known = ids.filter(F.col("id").isin(a, b)).groupBy("id").agg(F.min("idx").alias("idx"))
    units = normalised(weighted).join(F.broadcast(known), "idx")  # two rows at most
    left = units.filter(F.col("id") == a).select("term", F.col("u").alias("x"))
    right = units.filter(F.col("id") == b).select("term", F.col("u").alias("y"))
    sim = left.join(right, "term").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("sim"))
    both = known.agg((F.count(F.lit(1)) == len({a, b})).alias("found"))
    return both.join(sim).select("found", F.when(F.col("found"), F.col("sim")).alias("sim"))
