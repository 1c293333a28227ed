"""The core queries on the test tables: name -> function of (spark, folder of tables).

"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import LsaConfig, TextConfig
from weftline.functions import text as T
from weftline.functions.stem import porter2
from weftline.operators import dense, graph, lda, lsa, ranking, reports, similarity, summaries, tfidf, tvd
from weftline.operators.badrows import bad_lines, classify
from weftline.operators.blocks import pairs_above
from weftline.operators.conversation import message_features
from weftline.plans.pipeline import dimension_sweep, duplicate_workflow
from weftline.session import cut, load
from weftline.sinks import writers
from weftline.sources.xml import not_invalid
from weftline.streaming.scoring import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LINKS = "duplicateslsa_lo_sy_dw_sm_sc_ac"
PLAIN = TextConfig(lower=True)
#: Word lists are parameters; these small ones serve the queries.
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "it", "that", "for", "with", "should", "could", "would", "this", "when", "from", "as", "so", "not", "does"]
MORE_STOP_WORDS = ["please", "menu", "editor", "add", "use"]
# Words and their stems from the published descriptions of both stemmers.
STEM_EXAMPLES = (
    "caresses=caress ponies=poni ties=ti caress=caress cats=cat feed=feed agreed=agre plastered=plaster bled=bled motoring=motor sing=sing conflated=conflat troubled=troubl sized=size hopping=hop tanned=tan "
    "falling=fall hissing=hiss fizzed=fizz failing=fail filing=file happy=happi sky=sky relational=relat conditional=condit rational=ration digitizer=digit vietnamization=vietnam predication=predic operator=oper "
    "feudalism=feudal decisiveness=decis hopefulness=hope callousness=callous triplicate=triplic formative=form formalize=formal electrical=electr hopeful=hope goodness=good revival=reviv allowance=allow "
    "inference=infer airliner=airlin gyroscopic=gyroscop adjustable=adjust defensible=defens irritant=irrit replacement=replac adjustment=adjust dependent=depend adoption=adopt communism=commun activate=activ "
    "homologous=homolog effective=effect bowdlerize=bowdler probate=probat rate=rate cease=ceas controll=control roll=roll"
)
LATER_EXAMPLES = (
    "consign=consign consigned=consign consigning=consign consignment=consign consist=consist consisted=consist consistency=consist consistent=consist consistently=consist consisting=consist consists=consist "
    "consolation=consol consolations=consol consolatory=consolatori console=consol consoled=consol consoles=consol consolidate=consolid consolidated=consolid consolidating=consolid consoling=consol "
    "consolingly=consol consols=consol consonant=conson consort=consort consorted=consort consorting=consort conspicuous=conspicu conspicuously=conspicu conspiracy=conspiraci conspirator=conspir "
    "conspirators=conspir conspire=conspir conspired=conspir conspiring=conspir constable=constabl constables=constabl constance=constanc constancy=constanc constant=constant "
    "knack=knack knackeries=knackeri knacks=knack knag=knag knave=knave knaves=knave knavish=knavish kneaded=knead kneading=knead knee=knee kneel=kneel kneeled=kneel kneeling=kneel kneels=kneel knees=knee "
    "knell=knell knelt=knelt knew=knew knick=knick knif=knif knife=knife knight=knight knightly=knight knights=knight knit=knit knits=knit knitted=knit knitting=knit knives=knive knob=knob knobs=knob "
    "knock=knock knocked=knock knocker=knocker knockers=knocker knocking=knock knocks=knock knopp=knopp knot=knot knots=knot"
)
SPELLINGS = {"colour": "color", "behaviour": "behavior", "dialogue": "dialog", "plug-in": "plugin", "read-only": "readonly", "toolbar": "tool-bar"}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def records(spark: SparkSession, sf_dir: str, config: TextConfig = PLAIN) -> DataFrame:
    """``(idx, id, duplicate_id, doc, short, tracker, ...)``: the corpus, without invalid records of Bugzilla."""
    f = load(spark, sf_dir, "features")
    texts = F.transform(F.coalesce(F.col("long_desc"), F.array().cast("array<struct<thetext:string>>")), lambda x: x["thetext"])
    valid = not_invalid(f.withColumn("resolution", F.when(F.col("tracker") == "Bugzilla", F.col("resolution"))))
    comments = F.slice(texts, F.lit(2), F.greatest(F.size(texts), F.lit(1)))
    body = F.try_element_at(texts, F.lit(1))
    return valid.select(
        F.col("doc_idx").alias("idx"), F.col("bug_id").alias("id"), F.col("dup_id").alias("duplicate_id"), F.col("short_desc").alias("title"),
        body.alias("description"), comments.alias("comments"), T.assemble(F.col("short_desc"), body, comments, config).alias("doc"),
    )


def _tf(spark: SparkSession, sf_dir: str, config: TextConfig = PLAIN) -> DataFrame:
    return tfidf.term_frequencies(tfidf.tokenise(records(spark, sf_dir, config), config))


def _weights(spark: SparkSession, sf_dir: str, config: TextConfig = PLAIN) -> DataFrame:
    tf = cut(_tf(spark, sf_dir, config))
    return tfidf.weights(tf, records(spark, sf_dir).count(), config)


def _trimmed(name: str) -> Column:
    return F.nullif(F.btrim(F.col(name), F.lit(" \t\r")), F.lit(""))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, LINKS).select(_trimmed("feature_id").alias("src"), _trimmed("dup_id").alias("dst"))
    return rows.filter("src IS NOT NULL AND dst IS NOT NULL")


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_lines(load(spark, sf_dir, "raw_records")).select("raw_id", "reason")


def _without_int(column: Column, field: str) -> Column:
    return column.cast("double") if field in ("rank", "title_i", "doc_j") else column


@query
def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines of both kinds, typed; whole numbers as doubles, since each line has one kind's fields only."""
    good = classify(load(spark, sf_dir, "raw_records")).filter("reason IS NULL")
    fields = [("duplicates", n) for n in ("feature_id", "dup_id", "rank", "sim")] + [("lsa_m2", n) for n in ("title_i", "id_i", "doc_j", "id_j", "cosine_similarity")]
    return good.select("raw_id", "kind", *[_without_int(F.col(f"record.{k}.{f}"), f).alias(f"{k}_{f}") for k, f in fields])


# Sources, projections and filters.
@query
def a5_comment_rows(spark, sf_dir):
    f = load(spark, sf_dir, "features").select("doc_idx", F.posexplode("long_desc").alias("pos", "d"))
    return f.select("doc_idx", "pos", F.length("d.thetext").alias("n_chars"))


@query
def a6_census(spark, sf_dir):
    return reports.census(load(spark, sf_dir, "features"), ["corpus", "tracker"])


@query
def c1_documents(spark, sf_dir):
    config = TextConfig(all_comments=True, double_title=True)
    return records(spark, sf_dir, config).select("idx", F.length("doc").alias("n_chars"), F.md5("doc").alias("doc_md5"))


@query
def c2_valid_records(spark, sf_dir):
    return records(spark, sf_dir).select("idx", "id")


@query
def c3_known_duplicates(spark, sf_dir):
    return records(spark, sf_dir).filter("duplicate_id IS NOT NULL AND duplicate_id != ''").select("idx", "id", "duplicate_id")


@query
def f4_resolvable(spark, sf_dir):
    return ranking.known_duplicates(records(spark, sf_dir)).select("idx", "id", "duplicate_id", "dup_idx")


@query
def c4_without_exclusions(spark, sf_dir):
    """Known duplicates but for the pairs that the match lists name already."""
    named = links(spark, sf_dir).select(F.col("src").alias("id"), F.col("dst").alias("duplicate_id")).distinct()
    return ranking.known_duplicates(records(spark, sf_dir), named).select("idx", "id", "duplicate_id", "dup_idx")


# Text functions.
@query
def d5_clean_texts(spark, sf_dir):
    return records(spark, sf_dir).select("idx", F.md5(T.clean(F.col("doc"), PLAIN)).alias("clean_md5"))


@query
def d7_without_code(spark, sf_dir):
    """All cleaning steps, code and form text included."""
    config = TextConfig(source_code=True, all_comments=True)
    r = records(spark, sf_dir, config)
    return r.select("idx", T.removed(F.col("doc"), config).alias("removed"), F.length(T.clean(F.col("doc"), config)).alias("n_chars"))


@query
def d8_code_lines(spark, sf_dir):
    r = records(spark, sf_dir, TextConfig(all_comments=True))
    return r.select("idx", F.regexp_count("doc", F.lit(T.CLEANING[-1][1])).alias("code_lines"))


@query
def d9_removed_matches(spark, sf_dir):
    return records(spark, sf_dir).select("idx", T.removed(F.col("doc"), PLAIN).alias("removed"))


@query
def d10_tokens(spark, sf_dir):
    r = tfidf.tokenise(records(spark, sf_dir), PLAIN)
    return r.select("idx", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query
def d12_chosen_tokens(spark, sf_dir):
    """Spelling and stop words together."""
    config = TextConfig(lower=True, spelling=True, stop_words=True, corrections=SPELLINGS, stop_list=STOP_WORDS)
    return tfidf.tokenise(records(spark, sf_dir), config).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def d13_more_stop_words(spark, sf_dir):
    """The extra list acts where spelling and stop words are both on."""
    config = TextConfig(lower=True, spelling=True, stop_words=True, corrections=SPELLINGS, stop_list=STOP_WORDS, extra_stop_list=MORE_STOP_WORDS)
    return tfidf.tokenise(records(spark, sf_dir), config).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def d15_published_stems(spark, sf_dir):
    """The examples of the published description of the first stemmer."""
    words = spark.createDataFrame([(w.split("=")[0],) for w in STEM_EXAMPLES.split()], "word string")
    return words.select("word", T.stem_all(F.array("word"))[0].alias("stem"))


@query
def d21_published_stems(spark, sf_dir):
    """Examples of the published description of the later stemmer."""
    words = spark.createDataFrame([(w.split("=")[0],) for w in LATER_EXAMPLES.split()], "word string")
    return words.select("word", T.stem_all(F.array("word"), porter2)[0].alias("stem"))


@query
def d15_stems(spark, sf_dir):
    """Each term with its stem: only distinct terms are stemmed."""
    terms = _tf(spark, sf_dir).select("term").distinct()
    return terms.select("term", T.stem_all(F.array("term"))[0].alias("stem"))


@query
def d16_bigrams(spark, sf_dir):
    """Pairs of tokens, ended by stop words."""
    config = TextConfig(lower=True, bigrams=True, stop_words=True, stop_list=STOP_WORDS)
    return tfidf.tokenise(records(spark, sf_dir), config).select(F.explode("tokens").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query
def d17_title_ngrams(spark, sf_dir):
    return records(spark, sf_dir).select("idx", F.size(T.character_ngrams(F.coalesce("title", F.lit("")), 3)).alias("n_grams"))


@query
def d18_title_dice(spark, sf_dir):
    r = records(spark, sf_dir)
    grams = r.select("idx", T.character_ngrams(F.lower(F.coalesce("title", F.lit(""))), 3).alias("g"))
    known = ranking.known_duplicates(r).select("idx", "dup_idx")
    joined = known.join(grams.withColumnRenamed("g", "a"), "idx").join(grams.select(F.col("idx").alias("dup_idx"), F.col("g").alias("b")), "dup_idx")
    return joined.select("idx", "dup_idx", F.round(T.dice(F.col("a"), F.col("b")), 6).alias("dice"))


@query
def d19_ascii_words(spark, sf_dir):
    w = load(spark, sf_dir, "documents").select("doc_id", T.ascii_words(F.col("text")).alias("w"))
    kept = T.without_stop_words(F.col("w"), STOP_WORDS)
    return w.select("doc_id", F.size("w").alias("n_words"), F.size(kept).alias("n_kept"), F.md5(F.array_join("w", " ")).alias("words_md5"))


@query
def d21_english_stems(spark, sf_dir):
    """Words of the ASCII tokeniser by their English stems: how many words, and how many different ones."""
    words = load(spark, sf_dir, "documents").select(F.explode(T.ascii_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    stems = words.select("n", T.stem_all(F.array("word"), porter2)[0].alias("stem"))
    return stems.groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_words"))


@query
def d22_dictionary(spark, sf_dir):
    words = records(spark, sf_dir).select(F.explode(T.words(F.col("description"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _call_rows(spark, sf_dir):
    """Supplier calls part: a constructor where the numbers end alike."""
    p = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    caller = F.concat(F.lit("org.s.C"), F.col("l_suppkey").cast("string"), F.lit(".run(int)"))
    same = F.col("l_suppkey") % 10 == F.col("l_partkey") % 10
    part = F.col("l_partkey").cast("string")
    callee = F.concat(F.lit("org.p.P"), part, F.when(same, F.concat(F.lit(".P"), part, F.lit("()"))).otherwise(F.lit(".get()")))
    return p.select(F.concat(caller, F.lit("||"), callee).alias("line"))


@query
def d23_call_lines(spark, sf_dir):
    lines = _call_rows(spark, sf_dir).select(F.explode(T.call_lines(F.col("line"))).alias("line"))
    return graph.distinct_sorted(lines)


@query
def d24_score_lines(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("org.A"), key, F.lit(".A"), key, F.lit("()"))).otherwise(F.concat(F.lit("org.A"), key, F.lit(".run()")))
    return graph.distinct_sorted(s.select(T.score_line(F.concat(name, F.lit("||0."), key)).alias("line")))


@query
def b19_decimal_points(spark, sf_dir):
    return load(spark, sf_dir, "raw_records").select("raw_id", T.decimal_points(F.col("raw_text")).alias("line"))


@query
def b17_text_lines(spark, sf_dir):
    return reports.text_lines(load(spark, sf_dir, "documents"), "text").groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("n_chars"))


# Term statistics.
@query
def e1_vocabulary(spark, sf_dir):
    return tfidf.vocabulary(cut(tfidf.tokenise(records(spark, sf_dir), PLAIN)))


@query
def e2_repeated_terms(spark, sf_dir):
    return tfidf.pruned(tfidf.term_statistics(_tf(spark, sf_dir)), TextConfig(single_terms=True))


@query
def e3_shared_terms(spark, sf_dir):
    return tfidf.pruned(tfidf.term_statistics(_tf(spark, sf_dir)), TextConfig(single_terms=True, single_document_terms=True))


@query
def e4_term_frequencies(spark, sf_dir):
    return _tf(spark, sf_dir)


@query
def e9_weights(spark, sf_dir):
    w = _weights(spark, sf_dir)
    return w.select("idx", "term", "tf", "df", F.round("w", 6).alias("w"))


@query
def e10_documents_with_word(spark, sf_dir):
    """The documents that hold each of the stop words, from maps of word counts."""
    tf = _tf(spark, sf_dir)
    maps = cut(tf.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("word_count")))
    return reduce(DataFrame.unionByName, [tfidf.documents_with_stem(maps, w).select(F.lit(w).alias("stem"), "n_documents") for w in STOP_WORDS])


@query
def e12_vocabulary_size(spark, sf_dir):
    config = TextConfig(lower=True, single_terms=True)
    return tfidf.vocabulary_size(tfidf.vocabulary(cut(tfidf.tokenise(records(spark, sf_dir), config)), config))


@query
def e13_corpus_size(spark, sf_dir):
    tf = _tf(spark, sf_dir)
    return tf.agg(F.sum("tf").alias("total_words"), F.count_distinct("term").alias("vocabulary_size"))


@query
def e21_adjacency(spark, sf_dir):
    return graph.adjacency_rows(links(spark, sf_dir))


@query
def e16_callers(spark, sf_dir):
    g = links(spark, sf_dir).groupBy(F.col("dst").alias("method"))
    return g.agg(F.count(F.lit(1)).alias("n_callers"), F.count_distinct("src").alias("n_distinct"))


# Similarity and ranking.
@query
def f1_similar_pairs(spark, sf_dir):
    pairs = similarity.similar_pairs(_weights(spark, sf_dir), 0.5)
    return pairs.select("i", "j", F.round("sim", 6).alias("sim"))


@query
def b1_pair_rows(spark, sf_dir):
    """The pair file: both directions, with ids."""
    r = records(spark, sf_dir)
    rows = writers.pair_rows(similarity.similar_pairs(_weights(spark, sf_dir), 0.5), r, both_directions=True)
    return rows.select("Title_i", "ID_i", "Doc_j", "ID_j", F.round(F.col("Cosine Similarity").cast("double"), 4).alias("sim"))


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    units = cut(similarity.normalised(_weights(spark, sf_dir)))
    return ranking.duplicate_ranks_of_vectors(r, units, ranking.known_duplicates(r))


@query
def g1_duplicate_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir).select("idx", "id", "duplicate_id", "rank", F.round("sim", 6).alias("sim"))


@query
def b2_duplicate_rows(spark, sf_dir):
    return writers.duplicate_rows(_ranks(spark, sf_dir))


@query
def e11_hit_rates(spark, sf_dir):
    rates = ranking.hit_rates(_ranks(spark, sf_dir))
    return rates.select("n_duplicates", F.round("hit_10", 6).alias("hit_10"), F.round("hit_20", 6).alias("hit_20"))


FULL = TextConfig(lower=True, all_comments=True)


def _both_forms(spark, sf_dir):
    """Counts of documents with all comments, and of titles with descriptions."""
    return cut(_tf(spark, sf_dir, FULL)), cut(_tf(spark, sf_dir, PLAIN))


def _title_description_ranks(spark, sf_dir, config: TextConfig = TextConfig()) -> DataFrame:
    full, short = _both_forms(spark, sf_dir)
    r = records(spark, sf_dir)
    known = cut(ranking.known_duplicates(r))
    ranks = ranking.title_description_ranks(r, known, *tvd.vectors(full, short, r.count(), r, known, config))
    return ranks.select("idx", "id", "duplicate_id", "rank", F.round("sim", 6).alias("sim"))


@query
def h3_title_description(spark, sf_dir):
    """Known duplicates asked with title and description only, against full documents with comments."""
    return _title_description_ranks(spark, sf_dir)


@query
def h4_pruned_title_description(spark, sf_dir):
    """The same where terms that are once, or in one document, in the corpus that the query sees are dropped."""
    return _title_description_ranks(spark, sf_dir, TextConfig(single_terms=True, single_document_terms=True))


@query
def b3_title_description_pairs(spark, sf_dir):
    """The whole cross-reference table: every record, with title and description only, against all later records."""
    r = cut(records(spark, sf_dir).select("idx"))
    return tvd.title_description_pairs(*_both_forms(spark, sf_dir), r.count(), r)


@query
def b3_cross_reference_rows(spark, sf_dir):
    """The rows of the cross-reference file: pairs above the cut, with ids."""
    r = cut(records(spark, sf_dir).select("idx", "id"))
    pairs = tvd.title_description_pairs(*_both_forms(spark, sf_dir), r.count(), r, cut_off=0.5)
    return writers.pair_rows(pairs, r).select("Title_i", "ID_i", "Doc_j", "ID_j", F.round(F.col("Cosine Similarity").cast("double"), 4).alias("sim"))


def _two_ids(spark, sf_dir):
    first = records(spark, sf_dir).agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    return first["a"], first["b"]


@query
def j5_similarity(spark, sf_dir):
    """The cosine of two records by id: the least and the greatest id."""
    r = records(spark, sf_dir)
    out = similarity.pair_similarity(_weights(spark, sf_dir), r.select("id", "idx"), *_two_ids(spark, sf_dir))
    return out.select("found", F.round("sim", 6).alias("sim"))


@query
def b7_two_vectors(spark, sf_dir):
    first = records(spark, sf_dir).agg(F.min("idx").alias("a"), F.max("idx").alias("b")).first()
    v = writers.vector_rows(tfidf.two_vectors(_weights(spark, sf_dir), first["a"], first["b"]))
    return v.select("Term", F.round("Vector_a", 6).alias("Vector_a"), F.round("Vector_b", 6).alias("Vector_b"))


def _related(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return dense.nearest(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 16)


@query
def g4_related(spark, sf_dir):
    """Every twentieth vector against all vectors."""
    return _related(spark, sf_dir).select("q", "c", "rank", F.round("sim", 6).alias("sim"))


@query
def e19_same_label(spark, sf_dir):
    labels = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "label")
    return ranking.same_label_neighbours(_related(spark, sf_dir), labels)


@query
def h1_dense_norms(spark, sf_dir):
    """Cosine of each vector with the first one of its label."""
    e = load(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("b"))
    joined = e.join(first, "label")
    return joined.select("vec_id", F.round(similarity.cosine(F.col("embedding"), F.col("b")), 6).alias("sim"))


# Windows.
@query
def g8_message_features(spark, sf_dir):
    c = load(spark, sf_dir, "feature_comments")
    m = message_features(c, "feature_id", ["c_created", "c_id"], "c_text", "c_created")
    return m.select("c_id", "wc", F.round("slen", 6).alias("slen"), F.round("ppau", 3).alias("ppau"))


@query
def s1_event_windows(spark, sf_dir):
    w = windowed_counts(load(spark, sf_dir, "events"))
    return w.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


# Reports.
def _report(spark, sf_dir):
    f = load(spark, sf_dir, "features")
    rows = f.select("corpus", (F.coalesce("dup_id", F.lit("")) != "").cast("string").alias("truth"), (F.coalesce("resolution", F.lit("")) == "DUPLICATE").cast("string").alias("predicted"))
    return reports.classification_report(rows, "truth", "predicted", "corpus")


@query
def h26_report(spark, sf_dir):
    return _report(spark, sf_dir).select("corpus", "type", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def c10_metric_lines(spark, sf_dir):
    r = _report(spark, sf_dir).select(F.concat_ws("/", "corpus", "type").alias("type"), *[F.round(c, 4).cast("decimal(12,4)").alias(c) for c in ("precision", "recall", "f1", "support")])
    return reports.metric_lines(r)


@query
def b16_graph_lines(spark, sf_dir):
    return graph.distinct_sorted(graph.graph_lines(links(spark, sf_dir)))


# Graphs and summaries.
@query
def h23_pagerank(spark, sf_dir):
    return graph.pagerank(links(spark, sf_dir), iterations=5).select("vertex", F.round("rank", 9).alias("rank"))


@query
def h23_pagerank_settled(spark, sf_dir):
    """The fixed point; ``h23_pagerank`` has the first five rounds only, for its SQL. Each round shrinks the distance to it
    to 0.85 of the last one at most, so 150 rounds are enough for any graph: 2 * 0.85 ** 149 < 1e-9."""
    return graph.pagerank(links(spark, sf_dir), iterations=150, tolerance=1e-9).select("vertex", F.round("rank", 12).alias("rank"))


def _methods(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Records as methods, and their callers: what links to them calls them; their votes weigh them."""
    callers = cut(links(spark, sf_dir).select(F.col("dst").cast("int").alias("id"), F.col("src").cast("int").alias("caller")))
    called = callers.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n_called"))
    f = load(spark, sf_dir, "features").groupBy(F.col("bug_id").cast("int").alias("id")).agg(F.sum("votes").cast("double").alias("pagerank"), F.min("resolution").alias("returntype"))
    m = f.join(called, "id", "left").withColumn("name", F.concat(F.lit("m"), F.col("id").cast("string"))).na.fill(0, ["n_called"])
    even = F.col("id") % 2 == 0
    m = m.withColumn("verb", F.when(even, "open")).withColumn("object", F.when(even, F.when(F.col("id") % 10 == 4, "null").otherwise(F.col("name"))))
    used = F.col("id") % 7 == 0
    m = m.withColumn("use_type", F.when(used, "loop")).withColumn("example", F.when(used, F.when(F.col("id") % 3 == 0, "unknown").otherwise(F.concat("name", F.lit("()")))))
    return cut(m), callers.join(m.select("id"), "id", "left_semi")


@query
def g3_best_callers(spark, sf_dir):
    m, callers = _methods(spark, sf_dir)
    return graph.best_callers(callers, m.select("id", "pagerank"))


@query
def i7_summaries(spark, sf_dir):
    m, callers = _methods(spark, sf_dir)
    return summaries.summaries(m, m.agg(F.avg("pagerank").alias("pagerank")), callers).select("id", "n_messages", F.array_join(F.transform("plan", lambda x: x.cast("string")), "").alias("plan"), "summary")


@query
def i4_wording(spark, sf_dir):
    m, _ = _methods(spark, sf_dir)
    average = m.agg(F.avg("pagerank").alias("average"))
    joined = m.filter("pagerank IS NOT NULL").join(F.broadcast(average))
    return joined.select("id", summaries.importance_words(F.col("pagerank"), F.col("average")).alias("importance"), summaries.called_words(F.col("n_called")).alias("calls"))


# Models. Where all dimensions are kept, the reduced space is the space of weights, which has SQL; the others are checked by properties in the tests.
PRUNED = TextConfig(lower=True, single_terms=True, single_document_terms=True)


def _flow(spark, sf_dir, config: LsaConfig):
    return duplicate_workflow(records(spark, sf_dir), PRUNED, config)


@query
def h5_lsa_pairs(spark, sf_dir):
    """All pairs of records that are similar in the reduced space."""
    return _flow(spark, sf_dir, LsaConfig(k=40)).get("lsa_pairs")


@query
def h10_full_rank_pairs(spark, sf_dir):
    """The same with all dimensions, where the cosines of records are those of their weights, exactly."""
    return _flow(spark, sf_dir, LsaConfig(k=-1)).get("lsa_pairs").select("i", "j", F.round("sim", 6).alias("sim"))


@query
def g7_singular_values(spark, sf_dir):
    """All singular values in their order: how many, their squares' sum, and whether they descend."""
    values = _flow(spark, sf_dir, LsaConfig(k=-1)).get("lsa_model").values
    return spark.createDataFrame([(float(sum(v * v for v in values)), values == sorted(values, reverse=True))], "squares double, descends boolean").select(F.round("squares", 4).alias("squares"), "descends")


@query
def h8_ratio_ranks(spark, sf_dir):
    """Known duplicates ranked in the space of all singular values of at least 0.04 of the largest, the published setting."""
    return _flow(spark, sf_dir, LsaConfig()).get("lsa_ranks")


@query
def h11_lsa_ranks(spark, sf_dir):
    """Known duplicates ranked in the reduced space."""
    return _flow(spark, sf_dir, LsaConfig(k=40)).get("lsa_ranks")


@query
def h11_published_ranks(spark, sf_dir):
    """Known duplicates ranked at the published number of dimensions, 1700 and one more. Its SQL ranks by weights, which is the same as long
    as there are no more records or terms than that."""
    ranks = _flow(spark, sf_dir, LsaConfig(k=1700)).get("lsa_ranks")
    return ranks.select("idx", "id", "duplicate_id", "rank", F.round("sim", 6).alias("sim"))


@query
def g11_dimension_sweep(spark, sf_dir):
    """Hit rates at several numbers of dimensions, from one decomposition."""
    return dimension_sweep(_flow(spark, sf_dir, LsaConfig(k=100)), (20, 40, 60, 80, 100))


@query
def h12_similar_terms(spark, sf_dir):
    """All pairs of terms that are similar in the reduced space."""
    return _term_pairs(spark, sf_dir, LsaConfig(k=20))


@query
def h12_full_rank_terms(spark, sf_dir):
    """The same with all dimensions, where the cosines of terms are those of their weights, exactly."""
    flow = _flow(spark, sf_dir, LsaConfig(k=-1))
    pairs = similarity.similar_terms(flow.get("weights"), flow.get("vocabulary"), 0.5 + 1e-9)
    return pairs.select("i", "j", F.round("sim", 6).alias("sim"))


def _term_pairs(spark, sf_dir, config: LsaConfig) -> DataFrame:
    flow = _flow(spark, sf_dir, config)
    numbers = flow.get("vocabulary").select("term", F.col("term_idx").alias("idx"))
    # Many rare terms have a cosine of one half exactly; the last digits of a decomposition must not decide.
    pairs = pairs_above(flow.get("lsa_model").terms.join(numbers, "term").select("idx", "coords"), 0.5 + 1e-9)
    return pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("sim", 6).alias("sim"))


@query
def h13_count_matrix_values(spark, sf_dir):
    """The decomposition of plain counts, without weights: the sum of its squared values."""
    flow = _flow(spark, sf_dir, LsaConfig(k=-1))
    kept = flow.get("tf").join(flow.get("vocabulary").select("term"), "term", "left_semi").withColumn("w", F.col("tf").cast("double"))
    values = lsa.lsa(kept, flow.get("vocabulary"), LsaConfig(k=-1)).values
    return spark.createDataFrame([(float(sum(v * v for v in values)),)], "squares double").select(F.round("squares", 3).alias("squares"))


def _topic_rows(spark, sf_dir):
    tokenised = cut(tfidf.tokenise(records(spark, sf_dir), PRUNED))
    vocab = cut(tfidf.vocabulary(tokenised, PRUNED))
    size = vocab.agg(F.max("term_idx")).first()[0]
    return cut(lda.features(tfidf.term_frequencies(tokenised), vocab, (size or 0) + 1))


@query
def h15_topics(spark, sf_dir):
    """Topic distributions of all records, by a model that reads all of them in each of its iterations."""
    return lda.fitted_shares(_topic_rows(spark, sf_dir), 20, iterations=10, optimizer="em")


@query
def h16_topic_ranks(spark, sf_dir):
    """Known duplicates ranked by the cosine of their topics."""
    rows, r = _topic_rows(spark, sf_dir), records(spark, sf_dir)
    known = cut(ranking.known_duplicates(r))
    if rows.isEmpty():
        return known.select("idx", "id", "duplicate_id", F.lit(1).cast("long").alias("rank"), F.lit(0.0).alias("sim")).limit(0)
    return lda.topic_ranks(lda.fit(rows, 100, iterations=10), rows, r, known)


@query
def h17_topic_sweep(spark, sf_dir):
    """Hit rates of the same for 100, 110, ... 200 topics, each model with the published number of iterations."""
    rows, r = _topic_rows(spark, sf_dir), cut(records(spark, sf_dir).select("idx", "id", "duplicate_id"))
    if rows.isEmpty():
        return spark.createDataFrame([], "topics int, n_duplicates long, hit_10 double, hit_20 double")
    return lda.ranked_sweep(rows, r, cut(ranking.known_duplicates(r)))


from weftline.plans import file_queries  # noqa: E402, F401  registers its queries
