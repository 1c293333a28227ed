"""Every llm query equals its SQL on small tables; the others are checked by what must hold."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from weftline.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(queries.QUERIES[name], oracle.SQL[name])


def test_packs_hold_everything_once(spark, duck):
    packs = queries.p6_packs(spark, str(DATA)).cache()
    capacity = {r.pack_name: r.capacity_tokens for r in spark.read.parquet(f"{DATA}/pack_capacities.parquet").collect()}
    n_docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    filled = packs.filter("bin_id IS NOT NULL").groupBy("pack_name", "bin_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= capacity[r.pack_name] for r in filled)
    for r in packs.groupBy("pack_name").agg(F.count_distinct("doc_id").alias("d"), F.sum("length").alias("n")).collect():
        assert r.d == n_docs
        bins = [x.n for x in filled if x.pack_name == r.pack_name]
        assert len(bins) <= -(-r.n // capacity[r.pack_name]) * 1.02 + 1


def test_mix_report_agrees_with_copies(spark, duck):
    copies = queries.p7_mix(spark, str(DATA))
    used = {r.source: r.n for r in copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
    report = {r.source: r for r in queries.p7_shares(spark, str(DATA)).collect()}
    assert all(report[s].size_used == n for s, n in used.items())
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert all(r.most_repeats <= r.max_repeats for r in report.values())
