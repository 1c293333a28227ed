"""One session for all tests, and a comparison with DuckDB."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(rows) -> list[tuple]:
    def value(x):
        if x is None or x != x:
            return None
        if isinstance(x, bool):
            return x
        return round(float(x), 8) + 0.0 if isinstance(x, float) else (int(x) if hasattr(x, "__int__") and not isinstance(x, str) else str(x))

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.fixture
def same_as_sql(spark, duck):
    def check(query, sql):
        ours = query(spark, str(DATA))
        columns = sorted(ours.columns)
        theirs = duck.execute(sql).df()
        assert sorted(theirs.columns) == columns
        assert plain(ours.select(*columns).collect()) == plain(theirs[columns].itertuples(index=False))

    return check
