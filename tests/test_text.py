from pyspark.sql import functions as F

from weftline.config import ALL_SIX, LsaConfig, TextConfig
from weftline.functions import text as T
from weftline.functions.stem import porter, porter2


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_tokens_keep_inner_marks(spark):
    got = one(spark, "a|b foo-bar e.g. don't x_y1 3d v2.0.1", T.raw_tokens)
    assert got == ["a", "|b", "foo-bar", "e.g", "don't", "x_y1", "v2.0.1"]
    assert one(spark, "don't", lambda c: T.tokens(c)) == ["dont"]


def test_letters_of_all_alphabets(spark):
    assert one(spark, "naïve cafés", T.raw_tokens) == ["naïve", "cafés"]


def test_code_lines(spark):
    config = TextConfig(source_code=True)
    assert one(spark, "h\n a;\n b;\nkeep\n c}\nlast;", lambda c: T.clean(c, config)) == "h\n \n \nkeep\n \nlast;"


def test_addresses_paths_and_quotes_always_go(spark):
    text = "see http://x.y/z?a=1 and src/main/Foo c:\\dir\\f one/two\n> quoted\n> again\nend"
    got = one(spark, text, T.clean)
    assert "http" not in got and "src/main" not in got and "one/two" in got and "dir" not in got
    assert "quoted" not in got and "again" in got  # of two quoted lines in a row the first goes
    assert one(spark, text, T.removed) == 4


def test_traces_logs_and_form_text(spark):
    config = TextConfig(source_code=True)
    text = "x\n  at a.b.C.d(C.java:1)\njava.lang.FooException: no\nBuild ID: 7\nSteps to Reproduce: 1\nthread\nchecking in a; done\nafter"
    got = one(spark, text, lambda c: T.clean(c, config))
    for gone in ("C.java", "FooException", "Build", "Reproduce", "checking"):
        assert gone not in got
    assert "after" in got


def test_very_long_texts(spark):
    config = TextConfig(source_code=True, stemming=True, lower=True)
    text = "checking in\n" + "line one two\n" * 20_000 + "done " + "a" * 50_000 + " " + "x.y-" * 20_000
    assert one(spark, text, lambda c: F.size(T.tokens(c, config))) >= 2


def test_assembly(spark):
    df = spark.createDataFrame([("T", "D", ["C1", "C2"])], "t string, d string, c array<string>")
    build = lambda config: df.select(T.assemble(F.col("t"), F.col("d"), F.col("c"), config)).first()[0]
    assert build(TextConfig()) == "T\n D"
    assert build(TextConfig(double_title=True)) == "T\n T\n D"
    assert build(TextConfig(all_comments=True)) == "T\n D\n C1\n C2"
    empty = spark.createDataFrame([(None, None, None)], "t string, d string, c array<string>")
    assert empty.select(T.assemble(F.col("t"), F.col("d"), F.col("c"), ALL_SIX)).first()[0] == "\n \n "


def test_bigrams(spark):
    on = TextConfig(bigrams=True, stop_words=True, stop_list=["the"])
    assert one(spark, "open the file", lambda c: T.tokens(c, on)) == ["open the"]
    assert one(spark, "open the file", lambda c: T.tokens(c, TextConfig(bigrams=True))) == ["open the", "the file"]
    assert one(spark, "open", lambda c: T.tokens(c, on)) == []
    assert one(spark, None, lambda c: T.tokens(c, on)) == []
    stemmed = TextConfig(bigrams=True, stemming=True, stop_words=True, stop_list=["things"])
    assert one(spark, "opening files things", lambda c: T.tokens(c, stemmed)) == ["open file", "file things"]


def test_stop_words_look_at_the_written_token(spark):
    config = TextConfig(spelling=True, stop_words=True, corrections={"teh": "the", "Colour": "color"}, stop_list=["the"], extra_stop_list=["bug"])
    assert one(spark, "teh THE Colour colour bug", lambda c: T.tokens(c, config)) == ["the", "color", "colour"]
    assert one(spark, "bug", lambda c: T.tokens(c, TextConfig(stop_words=True, stop_list=[], extra_stop_list=["bug"]))) == ["bug"]


def test_default_stop_list(spark):
    assert one(spark, "this is a parser", lambda c: T.tokens(c, TextConfig(stop_words=True))) == ["parser"]


def test_stems():
    expected = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "vietnamization": "vietnam", "sensibiliti": "sensibl", "triplicate": "triplic", "adoption": "adopt", "rate": "rate", "controll": "control", "is": "is", "apologi": "apolog"}
    assert {w: porter(w) for w in expected} == expected


def test_english_stems(spark):
    expected = {"consistently": "consist", "consolations": "consol", "conspiracy": "conspiraci", "knackeries": "knackeri", "knightly": "knight", "generous": "generous", "hoped": "hope", "dying": "die", "by": "by", "say": "say", "exceeded": "exceed", "agreed": "agre", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "dog's": "dog", "rational": "ration", "controlled": "control"}
    assert {w: porter2(w) for w in expected} == expected
    words = F.array(*[F.lit(w) for w in expected])
    assert spark.range(1).select(T.stem_all(words, porter2)).first()[0] == list(expected.values())


def test_ngrams_and_dice(spark):
    df = spark.createDataFrame([("abcd", "")], "a string, b string")
    grams = df.select(T.character_ngrams(F.col("a"), 3), T.character_ngrams(F.col("b"), 3)).first()
    assert set(grams[0]) == {"a", "ab", "abc", "bcd", "cd", "d"} and grams[1] == []
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"))
    assert abs(df.select(T.dice(a, b)).first()[0] - 2 / 3) < 1e-12


def test_ascii_words(spark):
    assert one(spark, "Foo-Bar é2x end", T.ascii_words) == ["foo", "bar", "2x", "end"]
    assert one(spark, None, T.ascii_words) == []


def test_formatters(spark):
    assert one(spark, "p.A.run(int)||q.B.get()", T.call_lines) == ["A A", "A:run q.B:get", "A q.B"]
    assert one(spark, "p.A.run||q.B.B()", T.call_lines)[1] == "A:run q.B:<init>"
    assert one(spark, "p.A.run()||0.5", T.score_line) == "A:run': 0.5"
    assert one(spark, "p.A.A()||0.5", T.score_line) == "A': 0.5"


def test_configurations():
    assert ALL_SIX.suffix() == "_AC_SC_SM_DW_SY_LO"
    assert TextConfig.from_codes("_AC_SC_SM_DW_SY_LO") == ALL_SIX
    assert TextConfig.from_switches({"AC": "On", "SC": "Off", "LO": True}).suffix() == "_AC_LO"
    values = [10, 5, 0.5, 0.3]
    assert [LsaConfig(k=k).kept(values) for k in (None, "", 0, 1, 2, 1700, -1)] == [3, 3, 3, 2, 3, 4, 4]
    assert LsaConfig(k=2, one_more=False).kept(values) == 2 and LsaConfig().kept([]) == 0
