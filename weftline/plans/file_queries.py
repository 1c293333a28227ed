"""Queries on readers and writers: the test tables are written in a format of the tools and read back from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import reports, tfidf
from weftline.operators.conversation import message_features, read_transcripts
from weftline.plans.queries import PLAIN, _methods, _report, _trimmed, query, records
from weftline.session import cut, load, scratch_path
from weftline.sinks import writers
from weftline.sources import files, srcml, xml


def _markup(spark: SparkSession, rows: DataFrame, root: str, tag: str) -> str:
    path = scratch_path(spark)
    rows.write.format("xml").option("rootTag", root).option("rowTag", tag).save(path)
    return path


def _plain(c: Column) -> Column:
    """Texts in XML: outer white space doesn't count, and an empty element is a missing one."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def _texts() -> Column:
    return F.transform(F.coalesce(F.col("long_desc"), F.array().cast("array<struct<thetext:string>>")), lambda x: F.struct(_plain(x["thetext"]).alias("thetext")))


def _seen(r: DataFrame) -> DataFrame:
    comments = F.transform(F.coalesce("comments", F.array().cast("array<string>")), lambda c: F.coalesce(_plain(c), F.lit("")))
    described = F.md5(F.coalesce(_plain(F.col("description")), F.lit("")))
    return r.select("id", _plain(F.col("title")).alias("title"), described.alias("description_md5"), F.size(comments).alias("n_comments"), F.md5(F.array_join(comments, "|")).alias("comments_md5"), "duplicate_id")


@query
def a1_bugzilla_records(spark, sf_dir):
    """All records as a Bugzilla export, read by the dispatcher."""
    f = load(spark, sf_dir, "features").select("bug_id", _plain(F.col("short_desc")).alias("short_desc"), "resolution", F.nullif("dup_id", F.lit("")).alias("dup_id"), _texts().alias("long_desc"))
    return _seen(xml.read_tracker(spark, _markup(spark, f, "bugs", "bug"), "Bugzilla"))


@query
def a2_tigris_records(spark, sf_dir):
    """All records as a Tigris export: nothing is filtered."""
    duplicate = F.when(F.coalesce("dup_id", F.lit("")) != "", F.struct(F.col("dup_id").alias("issue_id")))
    f = load(spark, sf_dir, "features").select(F.col("bug_id").alias("issue_id"), _plain(F.col("short_desc")).alias("short_desc"), _texts().alias("long_desc"), duplicate.alias("is_duplicate"))
    return _seen(xml.read_tracker(spark, _markup(spark, f, "issues", "issue"), 1))


@query
def a3_sample_records(spark, sf_dir):
    """Comments by their features, in the sample form."""
    c = load(spark, sf_dir, "feature_comments").filter("feature_id IS NOT NULL")
    comment = F.struct(F.col("c_id").cast("string").alias("cID"), F.col("c_reporter").alias("cReporter"), _plain(F.col("c_text")).alias("cText"))
    f = c.select(F.concat("feature_id", F.lit("-"), F.col("c_id").cast("string")).alias("ID"), F.concat(F.lit("t"), F.col("c_id").cast("string")).alias("title"), F.struct(F.array(comment).alias("comment")).alias("comments"))
    return _seen(xml.read_sample(spark, _markup(spark, f, "features", "feature"))).drop("description_md5")


@query
def a5_relational_rows(spark, sf_dir):
    """The tables that nesting gives: texts by the ordinal of their record, joined back to it."""
    f = load(spark, sf_dir, "features").select("doc_idx", "bug_id", F.transform("long_desc", lambda x: F.struct(F.coalesce(F.nullif(_plain(x["thetext"]), F.lit("")), F.lit("-")).alias("thetext"), F.lit("x").alias("kind"))).alias("long_desc"))
    f = f.filter(F.size("long_desc") > 1).unionByName(f.filter("NOT coalesce(size(long_desc), 0) > 1").withColumn("long_desc", F.array(*[F.struct(F.lit(t).alias("thetext"), F.lit("y").alias("kind")) for t in ("a", "b")])))
    tables = xml.read_relational(spark, _markup(spark, f, "bugs", "bug"), "bug")
    if "long_desc" not in tables:  # an empty file has no children to infer
        return spark.createDataFrame([], "doc_idx int, pos int, text_md5 string")
    joined = tables["bug"].select("bug_Id_0", F.col("doc_idx").cast("int").alias("doc_idx")).join(tables["long_desc"], "bug_Id_0")
    return joined.filter("kind = 'x'").select("doc_idx", "pos", F.md5("thetext").alias("text_md5"))


@query
def a7_call_edges(spark, sf_dir):
    """The call graph of classes made of suppliers: recursion, constructors, methods of the class, imports, static methods of imported classes, and
    calls that nothing resolves."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    number = F.col("k").cast("string")
    call = lambda name: F.concat(F.lit("<expr><call><name>"), name, F.lit("</name><argument_list>()</argument_list></call></expr>"))
    dotted = lambda a, b: F.concat(F.lit("<name>"), F.lit(a), F.lit("</name>.<name>"), F.lit(b), F.lit("</name>"))
    body = F.concat(
        call(F.lit("help")), F.when(F.col("k") % 2 == 0, call(dotted("p", "get"))).otherwise(""), F.when(F.col("k") % 3 == 0, call(F.concat(F.lit("S"), number))).otherwise(""),
        F.when(F.col("k") % 5 == 0, call(F.lit("nowhere"))).otherwise(""), F.when(F.col("k") % 7 == 0, call(F.lit("run"))).otherwise(""), F.when(F.col("k") % 11 == 0, call(F.lit("shared"))).otherwise(""),
    )
    method = lambda name, inner: F.concat(F.lit(f"<function><type><name>void</name></type> <name>{name}</name><parameter_list>()</parameter_list><block>{{"), inner, F.lit("}</block></function>"))
    field = "<decl_stmt><decl><type><name>P</name></type> <name>p</name></decl>;</decl_stmt>"
    unit = F.concat(
        F.lit("<unit><package>package <name>org.s"), (F.col("k") % 10).cast("string"), F.lit("</name>;</package><import>import <name>org.p.P</name>;</import><class>class <name>S"), number,
        F.lit("</name><block>{" + field), method("run", body), method("help", F.lit("")), F.lit("}</block></class></unit>"),
    )
    library = "<unit><package>package <name>org.p</name>;</package><class>class <name>P</name><block>{<function><type><name>void</name></type> <name>shared</name><parameter_list>()</parameter_list><block>{}</block></function>}</block></class></unit>"
    path = scratch_path(spark)
    units = s.select(unit.alias("value"), number.alias("unit")).unionByName(s.limit(1).select(F.lit(library).alias("value"), F.lit("library").alias("unit")))
    units.write.partitionBy("unit").text(path)
    return srcml.read_call_graph(spark, f"{path}/*")


@query
def a9_report_rows(spark, sf_dir):
    """A classifier report as text, with titles, headers and blank lines, read if it is of the wanted kind."""
    r = _report(spark, sf_dir).select(F.concat_ws("/", "corpus", "type").alias("type"), *[F.format_number(c, 4).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("string").alias("support"))
    lines = r.select(F.explode(F.array(F.lit("  Classification of records"), F.lit("        precision    recall  f1-score   support"), F.lit(""), F.concat_ws("   ", F.lit(""), "type", "precision", "recall", "f1", "support"))).alias("line"))
    path = scratch_path(spark)
    writers.write_lines(lines, path)
    read = spark.read.text(path)
    wanted = reports.model_gate(read, F.lit("lr model"), "LR Model").unionByName(reports.model_gate(read, F.lit("NB Model"), "LR Model"))
    return reports.parse_report(wanted)


@query
def a12_word_counts(spark, sf_dir):
    """Line items of each order as sparse counts, ``n idx:count ...``."""
    counts = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("int")).alias("v"))
    lines = counts.groupBy("l_orderkey").agg(F.collect_list(F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("v").cast("string"))).alias("e"))
    path = scratch_path(spark)
    writers.write_lines(lines.select(F.concat_ws(" ", F.size("e").cast("string"), F.array_join("e", " ")).alias("line")), path)
    read = files.word_counts(spark.read.text(path))
    return read.select("n", F.explode("counts").alias("k", "v")).groupBy("n", "k").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n_lines"))


@query
def a13_vocabulary_file(spark, sf_dir):
    """The term list as a file, a term a line, and the ordinals of its lines."""
    path = scratch_path(spark)
    writers.write_terms(tfidf.vocabulary(cut(tfidf.tokenise(records(spark, sf_dir), PLAIN))), path)
    return files.vocabulary_file(spark, path).select("term_idx", "term")


@query
def a15_positive_entries(spark, sf_dir):
    return files.positive_entries(load(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", "col", F.round(F.col("value").cast("double"), 6).alias("value"))


@query
def a17_ascii_texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.to_ascii(F.col("text"))).alias("ascii_md5"))


@query
def a18_transcripts(spark, sf_dir):
    """Conversations as delimited transcripts, and the features of their messages."""
    c = load(spark, sf_dir, "feature_comments").select(F.col("feature_id").alias("conversation"), F.col("c_id").alias("turn"), F.col("c_created").alias("at"), F.col("c_reporter").alias("author"), F.col("c_text").alias("text"))
    path = scratch_path(spark)
    c.write.options(header=True, quote='"', escape='"', quoteAll=True, nullValue="\\N", emptyValue="", timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    m = message_features(read_transcripts(spark, path), "conversation", ["at", "turn"], "text", "at")
    return m.select(F.col("turn").alias("c_id"), "wc", F.round("slen", 6).alias("slen"), F.round("ppau", 3).alias("ppau"))


@query
def b2_duplicates_file(spark, sf_dir):
    """A written list of known duplicates, read back."""
    rows = load(spark, sf_dir, "duplicateslsa_lo_sy_dw_sm_sc_ac").filter("sim IS NULL OR NOT isnan(sim)").select(_trimmed("feature_id").alias("feature_id"), _trimmed("dup_id").alias("dup_id"), "rank", "sim")
    path = scratch_path(spark)
    writers.write_csv(rows.filter("feature_id IS NOT NULL AND dup_id IS NOT NULL"), path, ";")
    return files.duplicates_csv(spark, path, ";").withColumn("rank", F.col("rank").cast("double"))


@query
def b5_pairs_file(spark, sf_dir):
    """A written list of similar pairs, read back."""
    rows = load(spark, sf_dir, "lsa_m2_lo_sy_dw_sm_sc_ac").filter("title_i IS NOT NULL AND id_i IS NOT NULL AND doc_j IS NOT NULL AND id_j IS NOT NULL AND NOT isnan(cosine_similarity)")
    path = scratch_path(spark)
    writers.write_csv(rows.select(F.col("title_i").alias("Title_i"), F.col("id_i").alias("ID_i"), F.col("doc_j").alias("Doc_j"), F.col("id_j").alias("ID_j"), F.col("cosine_similarity").alias("Cosine Similarity")), path)
    return files.pairs_csv(spark, path).withColumn("cosine_similarity", F.round(F.col("cosine_similarity").cast("double"), 4))


@query
def b19_decimal_file(spark, sf_dir):
    """Delivered lines as a file, rewritten with points, and their number by length."""
    lines = load(spark, sf_dir, "raw_records").filter("NOT contains(raw_text, '\n') AND NOT contains(raw_text, '\r')")
    source, target = scratch_path(spark), scratch_path(spark)
    writers.write_lines(lines, source, "raw_text")
    writers.decimal_point_file(spark, source, target)
    return spark.read.text(target).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query
def e20_averages(spark, sf_dir):
    methods, callers = _methods(spark, sf_dir)
    calls = callers.groupBy(F.col("caller").alias("id")).agg(F.count(F.lit(1)).alias("n_calls"))
    rows = methods.join(calls, "id", "left").na.fill(0, ["n_calls"])
    return xml.computed_averages(rows).select(F.round("called", 6).alias("called"), F.round("calls", 6).alias("calls"), F.round("pagerank", 6).alias("pagerank"))
