"""Core queries on empty tables; the plan of a scan."""

import pytest

from conftest import DATA
from weftline.operators.badrows import bad_lines
from weftline.plans import queries

#: Aggregates without groups have one row whatever they read, some queries one for each entry of a list; the others have none.
ONE_ROW = {"e11_hit_rates", "e12_vocabulary_size", "e13_corpus_size", "e20_averages", "g7_singular_values", "h13_count_matrix_values", "j5_similarity"}
LISTED = {"d15_published_stems": len(queries.STEM_EXAMPLES.split()), "d21_published_stems": len(queries.LATER_EXAMPLES.split()), "e10_documents_with_word": len(queries.STOP_WORDS), "g11_dimension_sweep": 5}


@pytest.fixture(scope="module")
def empty_tables(spark, duck, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for file in DATA.glob("*.parquet"):
        spark.read.parquet(str(file)).limit(0).write.parquet(str(folder / file.name))
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert queries.QUERIES[name](spark, empty_tables).count() == LISTED.get(name, 1 if name in ONE_ROW else 0)


def test_scans_read_only_what_they_need(spark, duck):
    table = spark.read.parquet(f"{DATA}/raw_records.parquet")
    plan = bad_lines(table).select("raw_id", "reason")._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "file_name" not in schema and "loaded_at" not in schema
