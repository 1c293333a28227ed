"""Ranks of known duplicates among all records, and how often they are near the top."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.blocks import corrected_similarities, dense_similarities, dense_units, ranked, sparse_similarities, sparse_vectors
from weftline.operators.positions import grouped_positions
from weftline.operators.space import Space, ranked_in_space
from weftline.session import cut


def first_of_id(records: DataFrame) -> DataFrame:
    """``(id, idx)``: the first record of each id."""
    return records.groupBy("id").agg(F.min("idx").alias("idx"))


def known_duplicates(records: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """``(idx, id, duplicate_id, dup_idx)`` of records whose duplicate is named and in the set.

    ``records`` has idx, id, duplicate_id; null and '' name none. ``exclude`` may list pairs of id and
    duplicate_id that don't count.
    """
    named = records.select("idx", "id", "duplicate_id").filter("duplicate_id IS NOT NULL AND duplicate_id != ''")
    if exclude is not None:
        named = named.join(exclude, ["id", "duplicate_id"], "left_anti")
    return named.join(first_of_id(records).select(F.col("id").alias("duplicate_id"), F.col("idx").alias("dup_idx")), "duplicate_id")


def duplicate_ranks(records: DataFrame, similarities: DataFrame, known: DataFrame) -> DataFrame:
    """``(idx, id, duplicate_id, rank, sim)``: the place of the duplicate among all records of another id.

    ``similarities`` (q, c, sim) may leave out pairs of similarity 0. Order: similarity descending, then
    corpus order; the place is that of the duplicate id's first entry in this order. Records without similarity
    keep their places: they are counted, not listed, so nothing of the size of all pairs is made.
    """
    ids = records.select("idx", "id")
    asked = cut(known.select(F.col("idx").alias("q"), F.col("id").alias("q_id"), F.col("duplicate_id")))
    scored = similarities.filter("sim > 0").join(ids.select(F.col("idx").alias("c"), F.col("id").alias("c_id")), "c")
    scored = cut(scored.join(asked, "q").filter("c_id != q_id").select("q", "c", "c_id", "sim", "duplicate_id"))
    hits = _first_entries(scored.filter("c_id = duplicate_id"))
    above = F.count_if((F.col("sim") > F.col("s")) | ((F.col("sim") == F.col("s")) & (F.col("c") < F.col("d"))))
    places = scored.join(hits, "q").groupBy("q").agg((above + 1).alias("rank"), F.first("s").alias("sim"))
    # Duplicates of similarity 0 come after all records with some, in corpus order.
    missed = asked.join(hits, "q", "left_anti").join(first_of_id(records).select(F.col("id").alias("duplicate_id"), F.col("idx").alias("d")), "duplicate_id")
    some = scored.join(missed.select("q", "d"), "q").groupBy("q").agg(F.count(F.lit(1)).alias("some"), F.count_if(F.col("c") < F.col("d")).alias("some_before"))
    numbered = grouped_positions(records.select("idx").withColumn("all", F.lit(0)), ["all"], [F.col("idx")])
    earlier = numbered.select(F.col("idx").alias("d"), (F.col("position") - 1).alias("before"))
    same_before = missed.join(ids.select(F.col("id").alias("q_id"), F.col("idx").alias("o")), "q_id").groupBy("q").agg(F.count_if(F.col("o") < F.col("d")).alias("same_before"))
    zero = missed.join(earlier, "d").join(some, "q", "left").join(same_before, "q", "left")
    place = F.coalesce("some", F.lit(0)) + F.col("before") - F.coalesce("some_before", F.lit(0)) - F.coalesce("same_before", F.lit(0)) + 1
    both = places.unionByName(zero.select("q", place.alias("rank"), F.lit(0.0).alias("sim")))
    return asked.join(both, "q").select(F.col("q").alias("idx"), F.col("q_id").alias("id"), "duplicate_id", "rank", "sim")


def duplicate_ranks_of_vectors(records: DataFrame, units: DataFrame, known: DataFrame) -> DataFrame:
    """The same result as ``duplicate_ranks`` from normalised sparse vectors (idx, t, u), without any table of similarities: the
    documents are scanned where they are, and each query only counts the records above its duplicate."""
    vectors = sparse_vectors(units)
    return _ranks(records, known, vectors, vectors, sparse_similarities)


def duplicate_ranks_of_coordinates(records: DataFrame, coordinates: DataFrame, known: DataFrame) -> DataFrame:
    """The same from dense vectors (idx, coords); records without one are similar to nothing."""
    units = dense_units(coordinates)
    return _ranks(records, known, units, units, dense_similarities)


def duplicate_ranks_in_space(records: DataFrame, reduced: Space, known: DataFrame) -> DataFrame:
    """The same from a space of many dimensions, where no coordinates are made."""
    return _ranks(records, known, reduced.documents, reduced.documents, reduced, ranked_in_space)


def _ranks(records: DataFrame, known: DataFrame, documents: DataFrame, queries: DataFrame, similarities, ranked=ranked) -> DataFrame:
    """Ranks of known duplicates by ``blocks.ranked``, or what does the same. The key of an id is its first record's ordinal."""
    asked = cut(known.select(F.col("idx").alias("q"), F.col("id").alias("q_id"), "duplicate_id"))
    first = first_of_id(records)
    keyed = records.select("idx", "id").join(first.select("id", F.col("idx").cast("long").alias("key")), "id").select("idx", "key")
    keyed = cut(keyed)
    wanted = asked.join(first.select(F.col("id").alias("duplicate_id"), F.col("idx").cast("long").alias("wanted")), "duplicate_id").select(F.col("q").alias("idx"), "wanted")
    places = ranked(keyed.join(documents, "idx", "left"), wanted.join(keyed, "idx").join(queries, "idx", "left"), similarities)
    kind = records.schema["idx"].dataType
    out = places.join(asked.withColumn("idx", F.col("q").cast("long")), "idx")
    return out.select(F.col("idx").cast(kind).alias("idx"), F.col("q_id").alias("id"), "duplicate_id", "rank", F.col("s").alias("sim"))


def title_description_ranks(records: DataFrame, known: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """The same for queries that change the weights they meet, from the two tables of ``tvd.vectors``."""
    return _ranks(records, known, documents, queries, corrected_similarities)


def _first_entries(of_duplicate: DataFrame) -> DataFrame:
    """``(q, s, d)``: the first entry of the duplicate id, by similarity and corpus order."""
    entry = F.max(F.struct("sim", (-F.col("c")).alias("place")))
    return of_duplicate.groupBy("q").agg(entry.alias("e")).select("q", F.col("e.sim").alias("s"), (-F.col("e.place")).alias("d"))


def hit_rates(ranks: DataFrame) -> DataFrame:
    """``(n_duplicates, hit_10, hit_20)``: fractions of duplicates within the first 10 and 20; null without duplicates."""
    share = lambda n: F.avg((F.col("rank") <= n).cast("double"))
    return ranks.agg(F.count(F.lit(1)).alias("n_duplicates"), share(10).alias("hit_10"), share(20).alias("hit_20"))


def top_k(similarities: DataFrame, k: int) -> DataFrame:
    """The k most similar documents of each ``q``, ties in corpus order, with their ``rank``."""
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "c")
    return similarities.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def same_label_neighbours(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """``(q, same)``: how many of a document's neighbours share its label. ``labels`` has idx and label."""
    own = labels.select(F.col("idx").alias("q"), F.col("label").alias("q_label"))
    theirs = labels.select(F.col("idx").alias("c"), F.col("label").alias("c_label"))
    joined = neighbours.join(own, "q").join(theirs, "c")
    return joined.groupBy("q").agg(F.count_if(F.col("q_label") == F.col("c_label")).alias("same"))
