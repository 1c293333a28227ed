"""Call graphs: resolving called names, PageRank, and the text forms of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.frequent import join_counted
from weftline.session import cut, drop


def resolve_calls(classes: DataFrame, methods: DataFrame, calls: DataFrame, variables: DataFrame, imports: DataFrame) -> DataFrame:
    """``(src, dst)``: the call graph of fully qualified names, one row per resolved call.

    Inputs: classes (unit, class_id, name, long_name), methods (class_id, method_id, method_no, name), calls
    (method_id, call_no, called), variables (class_id, method_id or null, variable, type), imports
    (class_id, import_no, import). A call is resolved by the first that holds: recursion, the class's
    constructor, another method of the class, an import that ends with the class of the
    called object (its variable's type, in the method before the class, or the name itself), a
    method of an imported class. Calls that none resolves are dropped.
    """
    bare = lambda c: F.substring_index(c, "(", 1)
    base = calls.join(methods.select("method_id", "class_id", F.col("name").alias("method")), "method_id")
    base = base.join(classes.select("class_id", F.col("name").alias("cls"), "long_name"), "class_id")
    target = F.split("called", r"\.")
    base = cut(base.withColumn("object", F.element_at(target, 1)).withColumn("member", F.when(F.size(target) > 1, F.element_at(target, -1))))
    call = ["method_id", "call_no"]
    dst = lambda owner, name: F.concat(owner, F.lit("."), name).alias("dst")
    own = base.filter(bare(F.col("method")) == F.col("called")).select(*call, F.lit(1).alias("way"), F.lit(0).cast("long").alias("no"), dst(F.col("long_name"), F.col("method")))
    constructor = base.filter("cls = called").select(*call, F.lit(2).alias("way"), F.lit(0).cast("long").alias("no"), dst(F.col("long_name"), F.col("cls")))
    others = methods.select("class_id", F.col("method_no").cast("long").alias("no"), F.col("name").alias("other"), bare(F.col("name")).alias("called"))
    sibling = base.join(others, ["class_id", "called"]).select(*call, F.lit(3).alias("way"), "no", dst(F.col("long_name"), F.col("other")))
    in_method = variables.filter("method_id IS NOT NULL").groupBy("method_id", F.col("variable").alias("object")).agg(F.max("type").alias("t1"))
    in_class = variables.filter("method_id IS NULL").groupBy("class_id", F.col("variable").alias("object")).agg(F.max("type").alias("t2"))
    typed = base.join(in_method, ["method_id", "object"], "left").join(in_class, ["class_id", "object"], "left")
    typed = cut(typed.withColumn("owner", F.coalesce("t1", "t2", "object")).withColumn("wanted", F.coalesce("member", "owner")))
    # An import that ends with the owner ends with the owner's last part too: an equi-join on that part, then the whole suffix.
    last_part = lambda c: F.element_at(F.split(c, r"\."), -1)
    named = imports.select("class_id", F.col("import_no").cast("long").alias("no"), "import", last_part("import").alias("last"))
    meets = typed.withColumn("last", last_part("owner")).join(named, ["class_id", "last"]).filter((F.col("import") == F.col("owner")) | F.col("import").endswith(F.concat(F.lit("."), F.col("owner"))))
    imported = meets.select(*call, F.lit(4).alias("way"), "no", dst(F.col("import"), F.col("wanted")))
    theirs = named.join(classes.select(F.col("class_id").alias("other_id"), F.col("long_name").alias("import")), "import")
    theirs = theirs.join(methods.select(F.col("class_id").alias("other_id"), F.col("name").alias("other"), bare(F.col("name")).alias("called")), "other_id")
    static = typed.join(theirs.select("class_id", "no", "import", "other", "called"), ["class_id", "called"]).select(*call, F.lit(5).alias("way"), "no", dst(F.col("import"), F.col("other")))
    ways = own.unionByName(constructor).unionByName(sibling).unionByName(imported).unionByName(static)
    best = ways.groupBy(*call).agg(F.min(F.struct("way", "no", "dst")).alias("b"))
    src = base.select(*call, F.concat("long_name", F.lit("."), "method").alias("src"))
    return src.join(best, call).select("src", F.col("b.dst").alias("dst"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``(src, dsts)``: the callees of each caller, repeats kept, in order of name. For graphs whose callers have few callees: a
    caller's list is one row. ``adjacency_rows`` has no such bound."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("dsts"))


def adjacency_rows(edges: DataFrame) -> DataFrame:
    """``(src, dst, n)``: each callee of each caller once, with its number of calls."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def pagerank(edges: DataFrame, iterations: int = 20, alpha: float = 0.15, tolerance: float = 0.0) -> DataFrame:
    """``(vertex, rank)`` after a number of rounds, or once no rank moves by more than ``tolerance``.

    Repeated edges count once; a vertex without outgoing edges spreads its rank evenly over all.
    Ranks sum to 1. Each round's ranks are written to the checkpoint folder and those of the round before removed, so plans don't grow;
    edges of vertices with very many of them stay where they are. An empty graph gives an empty result.
    """
    once = cut(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    degree = cut(once.groupBy("src").agg(F.count(F.lit(1)).alias("degree")))
    vertices = once.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    vertices = cut(vertices.join(degree.withColumnRenamed("src", "vertex"), "vertex", "left"))
    n = vertices.count()
    if n == 0:
        return vertices.select("vertex", F.lit(0.0).alias("rank"))
    ranks, written = vertices.withColumn("rank", F.lit(1.0 / n)), None
    for _ in range(iterations):
        given = ranks.filter("degree IS NOT NULL").select(F.col("vertex").alias("src"), "degree", (F.col("rank") / F.col("degree")).alias("give"))
        got = join_counted(once, given, "src", "degree", ["give"]).groupBy(F.col("dst").alias("vertex")).agg(F.sum("give").alias("got"))
        # One row: what the vertices without outgoing edges hold.
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        moved = ranks.withColumnRenamed("rank", "was").join(got, "vertex", "left").join(F.broadcast(loose))
        rank = F.lit(alpha / n) + (1 - alpha) * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)
        moved = cut(moved.select("vertex", "degree", rank.alias("rank"), "was"))
        if written is not None:
            drop(written)
        written = moved
        ranks = moved.drop("was")
        if tolerance > 0 and moved.agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0] <= tolerance:
            break
    return ranks.select("vertex", "rank")


def graph_lines(edges: DataFrame) -> DataFrame:
    """One quoted line ``"caller","callee"`` per edge."""
    return edges.select(F.format_string('"%s","%s"', "src", "dst").alias("line"))


def rank_lines(ranks: DataFrame) -> DataFrame:
    """One line ``vertex||rank`` per vertex."""
    return ranks.select(F.concat("vertex", F.lit("||"), F.col("rank").cast("string")).alias("line"))


def distinct_sorted(lines: DataFrame, column: str = "line") -> DataFrame:
    """Distinct lines in order."""
    return lines.select(column).distinct().orderBy(column)


def best_callers(callers: DataFrame, importance: DataFrame) -> DataFrame:
    """``(id, caller_one, caller_two)``: the two most important distinct callers of each method, 0 where there are
    less. Only ranks above 0 count; equal ranks go by id. ``callers``: id, caller. ``importance``: id, pagerank."""
    joined = callers.distinct().join(importance.select(F.col("id").alias("caller"), "pagerank").filter("pagerank > 0"), "caller")
    order = Window.partitionBy("id").orderBy(F.desc("pagerank"), "caller")
    first_two = joined.withColumn("n", F.row_number().over(order)).filter("n <= 2")
    pick = lambda n: F.max(F.when(F.col("n") == n, F.col("caller")))
    two = first_two.groupBy("id").agg(pick(1).alias("caller_one"), pick(2).alias("caller_two"))
    return callers.select("id").distinct().join(two, "id", "left").na.fill(0)
