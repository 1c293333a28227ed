import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm.groups import connected_groups, seeds
from weftline.llm.topn import top_n


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def shapes():
    rng = random.Random(7)
    name = lambda i: f"{i:04d}"
    chain = [(name(i), name(i + 1)) for i in range(60)]
    rng.shuffle(chain)
    star = [(name(0), name(i)) for i in range(1, 300)]
    forest = [(name(rng.randrange(400)), name(rng.randrange(400))) for _ in range(250)]
    odd = [("5", None), (None, "6"), (None, None), ("7", "7"), ("8", "9"), ("9", "8"), ("8", "9"), ("8", "10")]
    zigzag = [(name(i * 2), name(i * 2 + 1)) for i in range(30)] + [(name(i * 2 + 1), name((i * 7 + 2) % 60)) for i in range(30)]
    bipartite = [(name(i), name(900 - i * 2)) for i in range(100)] + [(name(i + 1), name(900 - i * 2)) for i in range(0, 99, 3)]
    path = [(name(i), name(i + 1)) for i in range(700)]
    rising = [(name(i), name(i + 1)) for i in range(0, 600, 2)] + [(name(i + 1), name(1200 - i)) for i in range(0, 600, 2)] + [(name(1200 - i), name(i + 2)) for i in range(0, 598, 2)]
    return {"path": path, "rising": rising, "chain": chain, "star": star, "forest": forest, "odd": odd, "zigzag": zigzag, "bipartite": bipartite, "none": []}


@pytest.mark.parametrize("shape,local", [(s, None) for s in sorted(shapes())] + [(s, n) for s in ("path", "star", "odd", "forest", "none") for n in (0, 40)])
def test_groups_against_union_find(spark, shape, local):
    pairs = shapes()[shape]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in pairs], "a string, b string, record_id int, u int")
    rows = connected_groups(df, "a", "b", local_edges=local).collect()
    assert {r.record_id: r.group_id for r in rows} == union_find(pairs)
    assert len(rows) == len(union_find(pairs))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_rounds_on_arrays(pairs):
    links = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    u, v = np.array(links, np.int64).reshape(-1, 2).T
    root = union_find([*links, *((i, i) for i in range(41))])
    assert seeds(u, v, 41).tolist() == [root[i] for i in range(41)]


def test_a_hub_and_a_giant_group_stay_spread(spark):
    """A third of all edges at one vertex, most records with one parent; broadcasts are switched off but for the bounded ones."""
    pairs = [(0, i) for i in range(1, 3000)] + [(i, i + 3000) for i in range(3000)] + [(9000 + i, 9001 + i) for i in range(300)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = connected_groups(df, "a", "b", local_edges=0).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.record_id: r.group_id for r in rows} == union_find(pairs)


def test_groups_of_numbers_and_a_hub(spark):
    pairs = [(1, i) for i in range(2, 3000)] + [(5000 + i, 5001 + i) for i in range(20)]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r.record_id: r.group_id for r in connected_groups(df, "a", "b", local_edges=100).collect()} == union_find(pairs)


ORDER = [("sim", True), ("rank", False), ("item", False), ("row", False)]
SCHEMA = "g string, item string, sim double, rank int, row int, position string, __part string"


def expected_rows(rows, n, distinct):
    out = set()
    key = lambda r: (r[2] is None, -(r[2] or 0), r[3] is None, r[3] or 0, r[1] is None, r[1] or "", r[4])
    for g in {r[0] for r in rows}:
        own, seen = [], set()
        for r in sorted((r for r in rows if r[0] == g), key=key):
            if not distinct or r[1] not in seen:
                own.append(r[4])
            seen.add(r[1])
        out |= {(g, row, p) for p, row in enumerate(own[:n], 1)}
    return out


@pytest.mark.parametrize("distinct", [(), ("item",)])
def test_top_n_against_brute_force(spark, distinct):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        g = "hot" if rng.random() < 0.4 else rng.choice([f"g{rng.randrange(60)}", None])
        rows.append((g, rng.choice([f"i{rng.randrange(25)}", None]), rng.choice([None, 0.5, round(rng.random(), 1)]), rng.choice([None, 1, 2]), i, "x", "y"))
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 5, 1000):
        got = {(r.g, r.row, r.position) for r in top_n(df, ["g"], ORDER, n, distinct, partitions=6).collect()}
        assert got == expected_rows(rows, n, distinct)


def test_top_n_of_repeated_rows_and_none(spark):
    df = spark.createDataFrame([("a", "i", 1.0, 1, 7, "", "")] * 9, SCHEMA)
    assert top_n(df, ["g"], ORDER, 5).count() == 5
    assert top_n(df, ["g"], ORDER, 5, ["item"]).count() == 1
    assert top_n(df.limit(0), ["g"], ORDER, 5, ["item"]).count() == 0
    with pytest.raises(ValueError):
        top_n(df, ["g"], ORDER, 0)
    assert "position" in top_n(df, ["g"], ORDER, 2).filter(F.col("position") > 0).columns
