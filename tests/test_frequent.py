"""Joins on frequent keys: the rows of a frequent key are spread, and the result is that of a plain join."""

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from weftline.operators.frequent import frequent_share, join_counted, join_spread


@pytest.fixture
def no_automatic_broadcast(spark):
    """Nor are small partitions put together."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def tables(spark):
    """A third of all rows on one key."""
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{i % 700}")) for i in range(6000)]
    left = spark.createDataFrame(rows, "id int, k string").repartition(8)
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    return rows, left, counts


@pytest.mark.parametrize("bound", [2, 100, 65_536])
def test_join_equals_a_plain_join(spark, no_automatic_broadcast, bound):
    rows, left, counts = tables(spark)
    expected = {(i, k, min(j for j, x in rows if x == k)) for i, k in rows[:600] if k is not None}
    few = left.filter("id < 600")
    for out in (join_counted(few, counts, "k", "n", ["least"], bound), join_spread(few, counts, "k", ["least"], bound=bound)):
        assert {(r.id, r.k, r.least) for r in out.collect()} == expected
    outer = join_spread(few, counts.filter("k != 'hot' AND k != 'k1'"), "k", ["least"], "left", bound)
    assert outer.count() == 600 and outer.filter("least IS NULL AND k IN ('hot', 'k1')").count() == few.filter("k IN ('hot', 'k1')").count()


@pytest.mark.parametrize("join", [lambda a, b: join_counted(a, b, "k", "n", ["least"], 100), lambda a, b: join_spread(a, b, "k", ["least"], bound=100)])
def test_rows_of_a_hot_key_stay_spread(spark, no_automatic_broadcast, join):
    """No task gets much more than its share, though one key has a third of all rows."""
    rows, left, counts = tables(spark)

    def sizes(batches):
        import pyarrow as pa

        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n]})

    found = [r.n for r in join(left, counts).select("id").mapInArrow(sizes, "part long, n long").collect()]
    assert sum(found) == sum(k is not None for _, k in rows) and max(found) < 6000 / 4


def test_share():
    assert frequent_share(10, 100) == 11 and frequent_share(10, 0) == 1
