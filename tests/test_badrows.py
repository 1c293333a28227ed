"""Each defect, blanks and quotes, and odd inputs."""

from pyspark.sql import functions as F

from weftline.operators import badrows
from weftline.operators.badrows import bad_lines, classify, read_permissively, valid_lines

D, L = "duplicates", "lsa_m2"
CASES = [
    (D, ",", "1,2,3,0.5", None), (D, ",", " 1 ,\t2, 3 , 0.5\r", None), (D, ";", '"1";2;"3";0,5', None), (D, ",", '1,2,,', None), (D, ",", '1,2,"",""', None),
    (D, ",", '1,2,3,"0,5"', None), (D, ",", "1,2,3,-1", None), (D, ",", "1,2,3,+1E-3", None), (D, ",", "01,2,007,1", None), (L, ";", "1;2;3;4;0.5", None), (L, ",", "2147483647,2,0,4,", None),
    (D, ",", '1,2,3,"0.5', "quoting"), (D, ",", '1,2,3,"0.5" x', "quoting"), (D, ",", '1,2"2,3,0.5', "quoting"), (D, ",", '"1""', "quoting"), (D, ",", '""",2,3,4', "quoting"), (D, ",", '1"', "quoting"),
    (D, ",", "", "columns"), (D, ",", "  ", "columns"), (D, ",", None, "columns"), (D, ",", "1,2,3", "columns"), (D, ",", "1,2,3,4,", "columns"), (D, ",", "1;2;3;4", "columns"), (D, ",", '"1,2",3', "columns"), (D, ",", "1,2,3,4\n5,6,7,0.5", "columns"),
    (D, ",", "x,2,3,0.5", "value"), (D, ",", ",2,3,0.5", "value"), (D, ",", "1,2,0,0.5", "value"), (D, ",", "1,2,2147483648,0.5", "value"), (D, ",", "1,2,+3,0.5", "value"), (D, ",", "1,2,3,1.01", "value"), (D, ",", "1,2,3,.5", "value"), (D, ",", "1,2,3,5.", "value"),
    (D, ",", "1,2,3,NaN", "value"), (D, ",", "1,2,3,1e", "value"), (D, ",", "1,2,3,0.5\n", "value"), (D, ",", "1,2,3,\u00a00.5", "value"), (L, ",", "-1,2,3,4,0.5", "value"), (L, ",", "2147483648,2,3,4,0.5", "value"), (L, ",", "\u0663,2,3,4,0.5", "value"),
    (D, ",", '"a""b",2,3,0.5', "value"), (D, ",", '" 1",2,3,0.5', "value"), (D, ",", "1,2,3,1e999", "value"), (D, ",", "1,2,99999999999999999999999,0.5", "value"),
    ("other", ",", "1,2,3,4", "kind"), (None, ",", "1", "kind"), (D, "|", "1|2|3|4", "delimiter"), (D, None, "1,2,3,4", "delimiter"),
    (D, ",", "x" * 300_000, "columns"), (D, ",", "," * 100_000, "columns"), (D, ",", '"' * 100_001, "quoting"), (D, ",", "1,2,3," + "9" * 50_000, "value"),
    (D, ",", "1,2,3,-0", None), (D, ",", "1,2,3,-0.25", None), (D, ",", "1,2,3,1e-1", None),
    (L, ",", "-0,2,3,4,0.5", "value"), (D, ",", "1,2,-1,0.5", "value"), (D, ",", "1,2,-0,0.5", "value"), (D, ",", "1,2,3,0.5d", "value"), (D, ",", "1,2,3,0x1p-1", "value"), (D, ",", "1,2,3,--1", "value"), (D, ",", "1 1,2,3,0.5", "value"), (D, ",", "1,2,3,-1.5", "value"),
]
SCHEMA = "raw_id long, kind string, delim string, raw_text string, reason string, record int, expected string"


def table(spark):
    return spark.createDataFrame([(i, k, d, t, "own", 1, e) for i, (k, d, t, e) in enumerate(CASES)], SCHEMA)


def test_reasons(spark):
    rows = classify(table(spark)).collect()
    assert len(rows) == len(CASES)
    wrong = [(CASES[r.raw_id][:3], r.reason) for r in rows if r.reason != r.expected]
    assert not wrong
    for r in rows:
        assert (r.corrupt_text is None) == (r.reason is None or r.raw_text is None)
        assert (r.record[D] is None and r.record[L] is None) == (r.reason is not None)


def test_the_reader_feeds_the_second_step(spark, monkeypatch):
    """Bad counts and casts are found by the reader, and the second step sees what it retained and nothing else."""
    read = {r.raw_id: r for r in read_permissively(table(spark)).collect()}
    for i, (kind, delim, text, expected) in enumerate(CASES):
        if expected in ("kind", "delimiter") or text is None:
            assert read[i]["__retained"] is None
        elif expected == "columns" and '"' not in text and text and text.count(delim) < badrows.MOST_FIELDS:
            assert read[i][f"__{kind}"]["corrupt"] == text == read[i]["__retained"]
    for text in ("x2147483648", "1,2,2147483648,0.5", "1,2,3,1e", "1 1,2,x,0.5"):
        assert next(r for r in read_permissively(table(spark).limit(1).withColumn("raw_text", F.lit(text))).collect())[f"__{D}"]["corrupt"] == text
    retained = {i for i, r in read.items() if r["__retained"] is not None}
    assert {i for i, c in enumerate(CASES) if c[3] in ("quoting", "columns") and c[2] is not None} <= retained and len(retained) < len(CASES)
    seen = badrows._split
    monkeypatch.setattr(badrows, "_split", lambda text, delim: seen(F.when(text.isNotNull(), F.lit("1,2")), delim))
    reasons = {r.raw_id: r.reason for r in classify(table(spark)).collect()}
    assert all(reasons[i] == "columns" for i in retained if CASES[i][1] == ",")


def test_bad_and_valid_together_are_all(spark):
    t = table(spark)
    assert bad_lines(t).count() + valid_lines(t, D).count() + valid_lines(t, L).count() == len(CASES)


def test_typed_values(spark):
    rows = {r.raw_text: r for r in valid_lines(table(spark), D).collect()}
    assert rows['"1";2;"3";0,5'][-4:] == ("1", "2", 3, 0.5)
    assert rows['1,2,"",""'][-2:] == (None, None) == rows["1,2,,"][-2:]
    assert rows["01,2,007,1"][-4:] == ("01", "2", 7, 1.0)


def test_empty_table_and_repeated_rows(spark):
    assert bad_lines(table(spark).limit(0)).count() == 0
    t = table(spark).filter("raw_id = 11")
    assert bad_lines(t.union(t)).count() == 2


def test_no_shuffle(spark):
    plan = bad_lines(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert F.col("x") is not None
