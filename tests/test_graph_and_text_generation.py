import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, reports, summaries
from weftline.operators.conversation import message_features
from weftline.operators.positions import grouped_positions
from weftline.sources import srcml
from weftline.sources.xml import computed_averages, read_methods

def _method(number, name, returns, callers=(), rank=None, does=None, use=None, called_by_it=()):
    """One method of a method list; facts that it lacks have no element."""
    ids = lambda tag, numbers: f"<{tag}>{''.join(f'<id>{n}</id>' for n in numbers)}</{tag}>"
    parts = [f"<id>{number}</id><name>{name}</name><class>Valve</class><returntype>{returns}</returntype>", ids("called", callers), ids("calls", called_by_it)]
    parts += [f"<use><type>{use[0]}</type><example>{use[1]}</example></use>"] if use else []
    parts += [f"<pagerank>{rank}</pagerank>"] if rank is not None else []
    parts += [f"<swum><object>{does[1]}</object><verb>{does[0]}</verb></swum>"] if does else []
    return f"<method>{''.join(parts)}</method>"


#: A water works: callers of equal rank, nobody calling, callers without words, facts that are missing.
WATER_WORKS = [
    _method(21, "openValve", "void", callers=(25, 24), rank=0.55, does=("open", "valve")),
    _method(22, "flowRate", "int", callers=(24,), rank=0.4, use=("assignment", "int f = flowRate()")),
    _method(23, "drain", "Order", rank=0.05, does=("empty", "tank")),
    _method(24, "watch", "void", callers=(25,), rank=0.3, does=("watch", "pressure"), use=("loop", "unknown")),
    _method(25, "schedule", "void", callers=(77,), rank=0.3, does=("null", "null"), called_by_it=(21, 24)),
    _method(26, "level", "double", callers=(23, 24, 21, 24)),
]
METHODS = f"<method_list><averages><called>1.5</called><calls>0.5</calls><pagerank>0.3</pagerank></averages>{''.join(WATER_WORKS)}</method_list>"


def test_pagerank(spark):
    two = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b")], "src string, dst string")
    assert {r.vertex: round(r["rank"], 9) for r in graph.pagerank(two).collect()} == {"a": 0.5, "b": 0.5}
    star = spark.createDataFrame([("a", "c"), ("b", "c"), ("d", None)], "src string, dst string")
    ranks = {r.vertex: r["rank"] for r in graph.pagerank(star, iterations=50, tolerance=1e-12).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["c"] > ranks["a"] and set(ranks) == {"a", "b", "c"}
    assert graph.pagerank(star.limit(0)).count() == 0


def test_lines(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c")], "src string, dst string")
    assert [r.line for r in graph.distinct_sorted(graph.graph_lines(e)).collect()] == ['"a","b"', '"a","c"']
    assert graph.adjacency(e).first()["dsts"] == ["b", "b", "c"]
    assert graph.rank_lines(spark.createDataFrame([("v", 0.5)], "vertex string, rank double")).first()[0] == "v||0.5"


def test_summaries(spark, tmp_path):
    (tmp_path / "m.xml").write_text(METHODS)
    methods, averages = read_methods(spark, str(tmp_path / "m.xml"))
    out = {r.id: r for r in summaries.summaries(methods, averages).collect()}
    assert out[21].plan == [1, 3, 3, 4, 5] and out[22].plan == [2, 3, 4, 5, 6] and out[26].plan == [2, 3, 3, 4]
    assert out[21].summary == (
        "This method opens the valve. Return data is used by a method that watches the pressure. "
        "OpenValve() seems far more important than average because it is called by 2 methods."
    )
    assert out[22].summary == (
        "FlowRate returns an int. That int is used by a method that watches the pressure. "
        'FlowRate() seems slightly more important than average because it is called by 1 method. The method can be used in a assignment statement; for example: "int f = flowRate()".'
    )
    assert out[23].summary == "This method empties the tank and returns an Order. Drain() seems less important than average because it is not called by any methods."
    assert out[24].summary == "This method watches the pressure. Watch() seems less important than average because it is called by 1 method."
    assert "used by" not in out[25].summary  # its caller is not in the list
    assert out[26].summary == "Level returns a double. That double is used by methods that open the valve and watch the pressure. Level is called by 4 methods."
    assert round(computed_averages(methods).first()["pagerank"], 3) == 0.32
    callers = methods.select("id", F.explode("called").alias("caller"))
    best = {r.id: (r.caller_one, r.caller_two) for r in graph.best_callers(callers, methods.select("id", "pagerank")).collect()}
    assert best == {21: (24, 25), 22: (24, 0), 24: (25, 0), 25: (0, 0), 26: (21, 24)}


@pytest.mark.parametrize(
    "broken",
    [
        METHODS.replace("<id>24</id><name>", "<id>twenty</id><name>"), METHODS.replace("<name>drain</name>", ""), METHODS.replace("<name>drain</name>", "<name>drain</name><name>empty</name>"),
        METHODS.replace("<returntype>Order</returntype>", ""), METHODS.replace("<verb>empty</verb>", ""), METHODS.replace("<pagerank>0.05</pagerank>", "<pagerank>0.05</pagerank><pagerank>0.06</pagerank>"),
    ],
)
def test_method_list_must_fit(spark, tmp_path, broken):
    (tmp_path / "m.xml").write_text(broken)
    with pytest.raises(Exception):
        read_methods(spark, str(tmp_path / "m.xml"))[0].collect()


UNIT = """<unit><package>package <name><name>app</name>.<name>core</name></name>;</package><import>import <name><name>lib</name>.<name>Util</name></name>;</import>
<class>class <name>Box</name> <block>{<decl_stmt><decl><type><name>Util</name></type> <name>u</name></decl>;</decl_stmt>
<constructor><name>Box</name><parameter_list>()</parameter_list><block>{}</block></constructor>
<function><type><name>void</name></type> <name>open</name><parameter_list>()</parameter_list> <block>{<expr_stmt><expr><call><name>close</name><argument_list>()</argument_list></call></expr>;</expr_stmt>
<expr><call><name><name>u</name>.<name>help</name></name><argument_list>(<argument><expr><name>z</name></expr></argument>)</argument_list></call></expr>
<expr><call><name>open</name><argument_list>()</argument_list></call></expr><expr><call><name>Box</name><argument_list>()</argument_list></call></expr><expr><call><name>nowhere</name><argument_list>()</argument_list></call></expr>}</block></function>
<function><type><name>void</name></type> <name>close</name><parameter_list>()</parameter_list> <block>{<expr><call><name>shared</name><argument_list>()</argument_list></call></expr>}</block></function>}</block></class></unit>"""
LIB = "<unit><package>package <name>lib</name>;</package><class>class <name>Util</name><block>{<function><type><name>void</name></type> <name>shared</name><parameter_list>()</parameter_list><block>{}</block></function>}</block></class></unit>"


def test_call_graph_from_markup(spark, tmp_path):
    (tmp_path / "a.xml").write_text(UNIT)
    (tmp_path / "b.xml").write_text(LIB)
    (tmp_path / "c.xml").write_text("<unit><class>")
    edges = {(r.src, r.dst) for r in srcml.read_call_graph(spark, str(tmp_path)).collect()}
    assert edges == {
        ("app.core.Box.open", "app.core.Box.close"), ("app.core.Box.open", "lib.Util.help"), ("app.core.Box.open", "app.core.Box.open"),
        ("app.core.Box.open", "app.core.Box.Box"), ("app.core.Box.close", "lib.Util.shared"),
    }
    assert srcml.read_facts(spark, str(tmp_path)).filter("kind = 'error'").count() == 1


def test_reports(spark):
    lines = ["  title line", "             precision recall f1 support", "apiAnswer 0.94 0.67 0.78 44.4", "", "avg / total 0.9 0.8 0.85 100", "broken 0.1 x 2 3"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = reports.parse_report(df)
    assert [tuple(r) for r in rows.collect()] == [("apiAnswer", 0.94, 0.67, 0.78, 44.4), ("avg / total", 0.9, 0.8, 0.85, 100.0)]
    assert [r.line for r in reports.metric_lines(rows.limit(1)).collect()] == ["[apiAnswer, Precision = 0.94]", "[apiAnswer, Recall = 0.67]", "[apiAnswer, f1-Score = 0.78]", "[apiAnswer, Support = 44.4]"]
    assert [r.value for r in reports.rejected_lines(df).collect()] == ["broken 0.1 x 2 3"]
    assert reports.model_gate(df, F.lit("lr model"), "LR Model").count() == 6 and reports.model_gate(df, F.lit("LR_Model"), "LR Model").count() == 0
    assert reports.text_lines(spark.createDataFrame([("a\nb",), (None,)], "t string"), "t").count() == 3


def test_message_features(spark):
    rows = [(1, 1, "2020-01-01 00:00:00", "a b c"), (1, 2, "2020-01-01 00:00:30", " a\tb "), (1, 3, None, None), (1, 4, "2020-01-01 00:01:30", "a b c d e f")]
    df = spark.createDataFrame(rows, "c int, turn int, at string, t string").withColumn("at", F.col("at").cast("timestamp"))
    got = [(r.wc, r.slen and round(r.slen, 3), r.ppau) for r in message_features(df, "c", ["turn"], "t", "at").orderBy("turn").collect()]
    assert got == [(3, None, None), (2, 0.667, 30.0), (0, 0.0, None), (6, 2.0, None)]


def test_positions_across_partitions(spark):
    rows = [("hot", i) for i in range(500)] + [(f"g{i % 50}", i) for i in range(300)] + [(None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, v int")
    for limit in (None, 3):
        got = sorted(((r.g or "", r.v, r.position) for r in grouped_positions(df, ["g"], [F.col("v").desc()], at_most=limit, partitions=7).collect()))
        expected = []
        for g in {r[0] for r in rows}:
            own = sorted((v for x, v in rows if x == g), reverse=True)
            expected += [(g or "", v, p) for p, v in enumerate(own, 1) if limit is None or p <= limit]
        assert got == sorted(expected)
    assert grouped_positions(df.limit(0), ["g"], [F.col("v")]).count() == 0


def test_settled_pagerank_is_the_fixed_point(spark, duck):
    from conftest import DATA
    from weftline.plans import queries

    got = {r.vertex: r["rank"] for r in queries.QUERIES["h23_pagerank_settled"](spark, str(DATA)).collect()}
    edges = {(r.src, r.dst) for r in queries.links(spark, str(DATA)).collect()}
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    ranks = {v: 1 / len(got) for v in got}
    for _ in range(300):
        loose = sum(x for v, x in ranks.items() if v not in out) / len(ranks)
        new = {v: 0.15 / len(ranks) + 0.85 * loose for v in ranks}
        for a, targets in out.items():
            for b in targets:
                new[b] += 0.85 * ranks[a] / len(targets)
        ranks = new
    assert got and all(abs(got[v] - x) < 1e-8 for v, x in ranks.items())


def test_message_features_across_blocks(spark, monkeypatch):
    """One conversation with most messages, cut into many blocks, against a loop."""
    from weftline.operators import conversation

    monkeypatch.setattr(conversation, "BLOCK", 4)
    rows = [(("hot" if i % 4 else f"c{i % 12}") if i % 29 else None, i, f"2020-01-01 00:{i // 60:02d}:{i % 60:02d}" if i % 7 else None, "w " * (i * 37 % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "c string, turn int, at string, t string").withColumn("at", F.col("at").cast("timestamp")).repartition(5)
    expected, seen = {}, {}
    for c, turn, at, t in rows:
        longest, last = seen.get(c, (None, None))
        now = None if at is None else turn
        expected[turn] = (len(t.split()), len(t.split()) / longest if longest else None, None if c not in seen or last is None or now is None else float(now - last))
        seen[c] = (max(longest or 0, len(t.split())), now)
    got = {r.turn: (r.wc, r.slen, r.ppau) for r in message_features(df, "c", ["turn"], "t", "at").collect()}
    assert got == expected


def test_imports_by_suffix_and_names_that_begin_with_new(spark, tmp_path):
    method = "<function><type><name>void</name></type> <name>{}</name><parameter_list>()</parameter_list><block>{{{}}}</block></function>"
    call = "<expr><call><name>{}</name><argument_list>()</argument_list></call></expr>"
    declared = "<decl_stmt><decl><type><name><name>Map</name>.<name>Entry</name></name></type> <name>e</name></decl>;</decl_stmt>"
    (tmp_path / "a.xml").write_text(
        "<unit><package>package <name>app</name>;</package><import>import <name>java.util.Map.Entry</name>;</import><import>import <name>other.NoEntry</name>;</import>"
        "<class>class <name>Box</name><block>{" + declared + method.format("run", call.format("<name>e</name>.<name>get</name>") + call.format("newInstance")) + method.format("newInstance", "") + "}</block></class></unit>"
    )
    assert {(r.src, r.dst) for r in srcml.read_call_graph(spark, str(tmp_path)).collect()} == {("app.Box.run", "java.util.Map.Entry.get"), ("app.Box.run", "app.Box.newInstance")}
