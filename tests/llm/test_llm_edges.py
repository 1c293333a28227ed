"""Empty tables, and one key that holds a third of all rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from weftline.llm import queries
from weftline.llm.groups import connected_groups
from weftline.llm.looks import same_look_classes
from weftline.llm.neardup import near_duplicates
from weftline.llm.packing import pack
from weftline.llm.topn import top_n


@pytest.fixture(scope="module")
def empty_tables(spark, duck, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for file in DATA.glob("*.parquet"):
        spark.read.parquet(str(file)).limit(0).write.parquet(str(folder / file.name))
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert queries.QUERIES[name](spark, empty_tables).count() == 0


def test_a_third_in_one_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}", float(i % 50), "the same text" if i % 3 == 0 else f"text {i}", 7 if i % 3 == 0 else i % 90 + 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, k string, sim double, text string, size long").repartition(6)
    best = top_n(df, ["k"], [("sim", True), ("id", False)], 5, partitions=6).filter("k = 'hot'").orderBy("position")
    assert [r.id for r in best.collect()] == sorted((i for i, k, *_ in rows if k == "hot"), key=lambda i: (-(i % 50), i))[:5]
    groups = Counter(r.group_id for r in connected_groups(df.select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("a"), "k"), "a", "k").collect())
    assert groups.most_common(1)[0][1] == 2001
    packed = pack(df, "id", "size", 100)
    assert packed.count() == 6000 and packed.groupBy("bin_id").agg(F.sum("length").alias("n")).filter("n > 100").count() == 0
    classes = same_look_classes(df, "id", "text")
    assert classes.filter("look_id = 0").count() == 2000
    near = near_duplicates(df.select("id", F.split("text", " ").alias("terms")), "id", "terms")
    assert near.members.filter("class_id = 0").count() == 2000
