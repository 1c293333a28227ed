"""The llm problems' queries on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.distinct import best_terms, enrichment, frequency_scores, term_counts, with_statistics
from weftline.llm.groups import connected_groups
from weftline.llm.looks import same_look_classes, same_look_pairs
from weftline.llm.mixing import mix
from weftline.llm.neardup import NearDuplicates, near_duplicate_groups, near_duplicates
from weftline.llm.packing import pack_each
from weftline.llm.terms import terms_of
from weftline.llm.tokens import with_tokens
from weftline.llm.topn import top_n
from weftline.session import cut, load

LINKS = "duplicateslsa_lo_sy_dw_sm_sc_ac"
SIMILAR = "lsa_m2_lo_sy_dw_sm_sc_ac"


def _trimmed(name: str) -> Column:
    """The id without outer blanks; null where nothing is left."""
    return F.nullif(F.btrim(F.col(name), F.lit(" \t\r")), F.lit(""))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = load(spark, sf_dir, LINKS).select(_trimmed("feature_id").alias("a"), _trimmed("dup_id").alias("b"))
    return connected_groups(links, "a", "b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, LINKS).select("match_id", _trimmed("feature_id").alias("feature_id"), _trimmed("dup_id").alias("dup_id"), "rank", "sim")
    rows = rows.filter("feature_id != dup_id AND sim IS NOT NULL AND NOT isnan(sim)")
    order = [("sim", True), ("rank", False), ("dup_id", False), ("match_id", False)]
    return top_n(rows, ["feature_id"], order, 5, distinct=["dup_id"]).select("match_id")


def _feature_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.try_element_at("long_desc", F.lit(1))["thetext"]
    return load(spark, sf_dir, "features").select("doc_idx", "bug_id", terms_of(F.col("short_desc"), body).alias("terms"))


def _named(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ordinals in these columns of the pair table, once each."""
    pairs = load(spark, sf_dir, SIMILAR)
    return pairs.select(F.explode(F.array(*columns)).alias("doc_idx")).filter("doc_idx IS NOT NULL").distinct()


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    named = cut(_named(spark, sf_dir, "doc_j"))
    return near_duplicates(_feature_terms(spark, sf_dir).join(named, "doc_idx", "left_semi"), "doc_idx", "terms")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir)
    bugs = load(spark, sf_dir, "features").select(F.col("doc_idx").cast("long").alias("id"), "bug_id")
    members = cut(near.members.join(bugs, "id"))
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"))
    pairs = near.pairs.select("class_a", "class_b")
    pairs = pairs.unionByName(sizes.filter("size > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b")))
    left = members.select(F.col("class_id").alias("class_a"), F.col("id").alias("a"), F.col("bug_id").alias("bug_a"))
    right = members.select(F.col("class_id").alias("class_b"), F.col("id").alias("b"), F.col("bug_id").alias("bug_b"))
    both = pairs.join(left, "class_a").join(right, "class_b").filter("NOT bug_a <=> bug_b AND (class_a != class_b OR a < b)")
    return both.select(F.least("a", "b").cast("int").alias("doc_a"), F.greatest("a", "b").cast("int").alias("doc_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_near(spark, sf_dir)).withColumnRenamed("id", "doc_idx")


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Counts of the whole corpus, the wanted records' rows with statistics, and N."""
    features = _feature_terms(spark, sf_dir)
    counts = cut(term_counts(features, "doc_idx", "terms"))
    wanted = counts.join(cut(_named(spark, sf_dir, "title_i", "doc_j").select(F.col("doc_idx").cast("long").alias("id"))), "id", "left_semi")
    return counts, with_statistics(counts, wanted), load(spark, sf_dir, "features").count()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scored, n = _scored(spark, sf_dir)
    return best_terms(frequency_scores(scored, n)).select(F.col("id").cast("int").alias("doc_idx"), "term")


def p5_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, scored, _ = _scored(spark, sf_dir)
    occurrences = counts.agg(F.sum("tf")).first()[0] or 0
    out = enrichment(scored, occurrences)
    return out.select(F.col("id").cast("int").alias("doc_idx"), "term", "tf", "df", "cf", F.round("log10_p", 5).alias("log10_p"), F.round("q", 5).alias("q"), F.round("score", 5).alias("score"))


def p6_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_tokens(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    # One row per kind of pack: a handful.
    names = load(spark, sf_dir, "pack_capacities").select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity"))
    packs = pack_each(docs, "doc_id", "n_tokens", [r["capacity"] for r in names.collect()])
    return packs.join(F.broadcast(names), "capacity").select("pack_name", "bin_id", F.col("id").alias("doc_id"), "piece", "offset", "length")


def _mixed(spark: SparkSession, sf_dir: str):
    docs = with_tokens(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    return mix(docs, "doc_id", "source", "n_tokens", load(spark, sf_dir, "source_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).copies.select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copies")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).report


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(load(spark, sf_dir, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_classes(load(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p4_found, p4_groups, p5_found, p5_enrichment, p6_packs, p7_mix, p7_shares, p8_found, p8_classes)}
