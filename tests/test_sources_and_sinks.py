import struct

from pyspark.sql import functions as F

from weftline.config import ALL_SIX, TextConfig
from weftline.operators import similarity, tfidf
from weftline.sinks import writers
from weftline.sources import files, xml
from weftline.streaming.scoring import scorer, windowed_counts

BUGS = """<bugs><bug><bug_id>007</bug_id><short_desc>T1</short_desc><resolution>INVALID</resolution><long_desc><thetext>d</thetext></long_desc></bug>
<bug><bug_id>2</bug_id><short_desc>T2</short_desc><resolution>RESOLVED INVALID</resolution></bug>
<bug><bug_id>3</bug_id><short_desc>T3</short_desc><resolution>FIXED</resolution><dup_id>2</dup_id><long_desc><thetext>desc</thetext></long_desc><long_desc><thetext>c1</thetext></long_desc><long_desc><thetext>c2</thetext></long_desc></bug>
<bug><bug_id>04</bug_id><short_desc>T4</short_desc><resolution>DUPLICATE</resolution></bug></bugs>"""
ISSUES = """<issues><issue><issue_id>10</issue_id><short_desc>A</short_desc><long_desc><thetext>x</thetext></long_desc><is_duplicate><issue_id>11</issue_id></is_duplicate></issue>
<issue><issue_id>11</issue_id><short_desc>B</short_desc></issue></issues>"""
SAMPLE = "<fs><feature><ID>1</ID><title>t</title><comments><comment><cID>c</cID><cText>hello</cText></comment></comments></feature></fs>"


def test_trackers(spark, tmp_path):
    for name, text in (("b.xml", BUGS), ("i.xml", ISSUES), ("s.xml", SAMPLE)):
        (tmp_path / name).write_text(text)
    bugs = xml.read_tracker(spark, str(tmp_path / "b.xml"), "Bugzilla").orderBy("idx").collect()
    assert [(r.idx, r.id, r.description, r.comments, r.duplicate_id) for r in bugs] == [(0, "3", "desc", ["c1", "c2"], "2"), (1, "04", None, [], None)]
    issues = xml.read_tracker(spark, str(tmp_path / "i.xml"), 1).orderBy("idx").collect()
    assert [(r.id, r.title, r.duplicate_id) for r in issues] == [("10", "A", "11"), ("11", "B", None)]
    sample = xml.read_sample(spark, str(tmp_path / "s.xml")).first()
    assert (sample.id, sample.title, sample.comments) == ("1", "t", ["hello"])
    tables = xml.read_relational(spark, str(tmp_path / "b.xml"), "bug")
    assert tables["bug"].count() == 4 and xml.children(tables["long_desc"], "bug_Id_0", 2).count() == 3


def test_text_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("alpha\nbeta\n")
    (tmp_path / "c.txt").write_text("2 0:3 5:1\n\n0\n")
    (tmp_path / "p.txt").write_text("teh,the\n")
    (tmp_path / "log.txt").write_text("425 feature requests\nTop 10: 0.8 %\n")
    assert [tuple(r) for r in files.vocabulary_file(spark, str(tmp_path / "v.txt")).orderBy("term_idx").collect()] == [(0, "alpha"), (1, "beta")]
    counts = files.word_counts(spark.read.text(str(tmp_path / "c.txt"))).orderBy("n").collect()
    assert [(r.n, r.counts) for r in counts] == [(0, {}), (2, {0: 3, 5: 1})]
    assert files.word_pairs(spark, str(tmp_path / "p.txt")) == {"teh": "the"} and files.word_list(spark, str(tmp_path / "v.txt")) == ["alpha", "beta"]
    assert files.whole_texts(spark, str(tmp_path / "v.txt")).first()["value"].startswith("alpha\nbeta")
    assert files.file_bytes(spark, str(tmp_path), ".txt").count() == 4
    log = files.run_logs(spark, str(tmp_path / "log.txt")).first()
    assert (log.documents, log.hit_10, log.hit_20) == (425.0, 0.8, None)


def test_binary_matrix(spark, tmp_path):
    content = struct.pack(">iii", 3, 2, 3) + struct.pack(">i", 2) + struct.pack(">if", 0, 1.5) + struct.pack(">if", 2, -2.0) + struct.pack(">i", 1) + struct.pack(">if", 1, 4.0)
    (tmp_path / "m.bin").write_bytes(content)
    got = files.sparse_matrix(spark, str(tmp_path / "m.bin")).orderBy("col", "row").collect()
    assert [(r.row, r.col, r.value) for r in got] == [(0, 0, 1.5), (2, 0, -2.0), (1, 1, 4.0)]
    dense = spark.createDataFrame([(0, [0.0, 2.0, -1.0])], "k int, a array<double>")
    assert [tuple(r) for r in files.positive_entries(dense, "k", "a").collect()] == [(0, 1, 2.0)]


def test_written_files_are_read_again(spark, tmp_path):
    ranks = spark.createDataFrame([(0, "1", "2", 3, 0.12345)], "idx int, id string, duplicate_id string, rank int, sim double")
    writers.write_csv(writers.duplicate_rows(ranks), str(tmp_path / "d"))
    assert tuple(files.duplicates_csv(spark, str(tmp_path / "d")).first()) == ("1", "2", 3, 0.1235)
    records = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, id string")
    pairs = spark.createDataFrame([(0, 1, 0.75)], "i int, j int, sim double")
    rows = writers.pair_rows(pairs, records, both_directions=True)
    writers.write_csv(rows, str(tmp_path / "p"), ";")
    assert {tuple(r) for r in files.pairs_csv(spark, str(tmp_path / "p"), ";").collect()} == {(0, "a", 1, "b", 0.75), (1, "b", 0, "a", 0.75)}
    vocab = spark.createDataFrame([("b", 1), ("a", 0)], "term string, term_idx int")
    writers.write_terms(vocab, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a", "b"]
    (tmp_path / "c.csv").write_text("1,5;2\n")
    writers.decimal_point_file(spark, str(tmp_path / "c.csv"), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()[0] == "1.5;2"
    assert writers.file_name("LSA", ALL_SIX) == "LSA_AC_SC_SM_DW_SY_LO.csv"


def test_streaming_scores_and_windows(spark, tmp_path):
    docs = spark.createDataFrame([(0, "red apple"), (1, "green pear"), (2, "red pear")], "idx long, doc string")
    tf = tfidf.term_frequencies(tfidf.tokenise(docs))
    units = similarity.normalised(tfidf.weights(tf, 3)).cache()
    out = []
    score = scorer(units, tfidf.term_statistics(tf), 3, TextConfig(), 1, lambda df, epoch: out.extend(df.collect()))
    spark.createDataFrame([(100, "apple apple pie")], "idx long, doc string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("idx long, doc string").parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(score).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.q, r.c, r["rank"]) for r in out] == [(100, 0, 1)]
    events = spark.createDataFrame([("2020-01-01 00:10:00", "a", 1.0), ("2020-01-01 00:50:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.n, r.total) for r in windowed_counts(events).collect()] == [(2, 3.0)]
