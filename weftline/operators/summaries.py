"""Natural-language summaries of methods from their facts.

Messages are rows (id, type_order, ...), ordered into a plan, joined with their neighbours where
a pattern holds, and written with templates. Verbs take a plain third person -s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import best_callers

# The order of message types in a plan.
QUICK, RETURN, OUTPUT_USED, CALLED, IMPORTANCE, USE = range(1, 7)
FAR = 1.5


def messages(methods: DataFrame, averages: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """``(id, method, type_order, part, verb, object, return_type, called, pagerank, average, use_type, example)``.

    ``methods``: id, name, returntype, called (array of ids or null), pagerank, verb, object, use_type,
    example; facts may be null. Where methods have very many callers, ``callers`` (id, caller) holds them as rows, and ``methods`` only
    their number ``n_called`` instead of the arrays. ``averages``: one row with pagerank. A method has a message for each
    fact it has: its verb and object, a return type that isn't void, its callers (always), its importance, an
    example; and one for each of its two most important callers that has verb and object.
    """
    columns = "id int, method string, type_order int, part int, verb string, object string, return_type string, called int, pagerank double, average double, use_type string, example string"
    fields = [c.split()[0] for c in columns.split(", ")]
    types = dict(c.split() for c in columns.split(", "))

    def message(df: DataFrame, order: int, part: Column | None = None, **values: Column) -> DataFrame:
        given = {"id": F.col("id"), "method": F.col("name"), "type_order": F.lit(order), "part": part if part is not None else F.lit(0), **values}
        return df.select(*[given.get(f, F.lit(None)).cast(types[f]).alias(f) for f in fields])

    quick = methods.filter("verb IS NOT NULL AND object IS NOT NULL")
    if callers is None:
        callers = methods.select("id", F.explode("called").alias("caller"))
        methods = methods.withColumn("n_called", F.greatest(F.size("called"), F.lit(0)))
    two = best_callers(callers, methods.select("id", "pagerank"))
    chosen = two.select("id", F.posexplode(F.array("caller_one", "caller_two")).alias("part", "caller")).filter("caller != 0")
    told = chosen.join(quick.select(F.col("id").alias("caller"), "verb", "object"), "caller").join(methods.select("id", "name"), "id")
    average = averages.agg(F.max("pagerank").alias("average"))
    out = message(quick, QUICK, verb=F.col("verb"), object=F.col("object"))
    out = out.unionByName(message(methods.filter("returntype IS NOT NULL AND returntype != 'void'"), RETURN, return_type=F.col("returntype")))
    out = out.unionByName(message(told, OUTPUT_USED, F.col("part"), verb=F.col("verb"), object=F.col("object")))
    out = out.unionByName(message(methods, CALLED, called=F.coalesce("n_called", F.lit(0))))
    ranked = methods.filter("pagerank IS NOT NULL").join(F.broadcast(average))  # one row
    out = out.unionByName(message(ranked, IMPORTANCE, pagerank=F.col("pagerank"), average=F.col("average")))
    return out.unionByName(message(methods.filter("use_type IS NOT NULL"), USE, use_type=F.col("use_type"), example=F.col("example")))


def importance_words(pagerank: Column, average: Column) -> Column:
    return F.when(pagerank > FAR * average, "far more").when(pagerank > average, "slightly more").otherwise("less")


def called_words(called: Column) -> Column:
    """By how many methods; a negated clause for none."""
    return F.when(called == 0, "not called by any methods").when(called == 1, "called by 1 method").otherwise(F.concat(F.lit("called by "), called.cast("string"), F.lit(" methods")))


def _third_person(verb: Column) -> Column:
    return F.when(verb.rlike("(s|x|z|ch|sh|o)$"), F.concat(verb, F.lit("es"))).when(verb.rlike("[^aeiou]y$"), F.concat(F.expr("substring(verb, 1, length(verb) - 1)"), F.lit("ies"))).otherwise(F.concat(verb, F.lit("s")))


def phrases(plan: DataFrame) -> DataFrame:
    """Adds ``phrase``, the clause of each message on its own; null where it must not be told
    (verb or object ``null``, example ``unknown``)."""
    a = F.when(F.col("return_type").rlike("^[aeiouAEIOU]"), "an ").otherwise("a ")
    t = F.col("type_order")
    hidden = (F.col("verb") == "null") | (F.col("object") == "null")
    phrase = (
        F.when(t == QUICK, F.concat(F.lit("this method "), _third_person(F.col("verb")), F.lit(" the "), "object"))
        .when(t == RETURN, F.concat("method", F.lit(" returns "), a, "return_type"))
        .when((t == OUTPUT_USED) & ~hidden, F.concat(F.lit("return data is used by a method that "), _third_person(F.col("verb")), F.lit(" the "), "object"))
        .when(t == CALLED, F.concat("method", F.lit(" is "), called_words(F.col("called"))))
        .when(t == IMPORTANCE, F.concat("method", F.when(F.col("pagerank") > F.col("average"), " is ").otherwise(" seems "), importance_words(F.col("pagerank"), F.col("average")), F.lit(" important than average")))
        .when((t == USE) & (F.col("example") != "unknown"), F.concat(F.lit("the method can be used in a "), "use_type", F.lit(' statement; for example: "'), "example", F.lit('"')))
    )
    return plan.withColumn("phrase", phrase)


def aggregated(plan: DataFrame) -> DataFrame:
    """Neighbouring messages joined into one clause: adds ``told``, null for messages told by another.

    Summary and return; a return followed by one or two uses of the output; calls and importance.
    """
    order = Window.partitionBy("id").orderBy("type_order", "part")
    look = lambda c, n: (F.lead if n > 0 else F.lag)(c, abs(n)).over(order)
    p = phrases(plan).withColumn("next_type", look("type_order", 1)).withColumn("last_type", look("type_order", -1))
    p = p.withColumn("last_return", look("return_type", -1)).withColumn("last2_return", look("return_type", -2)).withColumn("last2_type", look("type_order", -2))
    for c in ("verb", "object", "return_type", "phrase", "called", "pagerank", "average"):
        p = p.withColumn(f"next_{c}", look(c, 1))
    t, n, last = F.col("type_order"), F.col("next_type"), F.col("last_type")
    a = F.when(F.col("next_return_type").rlike("^[aeiouAEIOU]"), "an ").otherwise("a ")
    base = lambda verb, obj: F.concat(verb, F.lit(" the "), obj)
    joined = (
        F.when((t == QUICK) & (n == RETURN), F.concat("phrase", F.lit(" and returns "), a, "next_return_type"))
        .when((t == RETURN) & (last == QUICK), F.lit(None))
        .when((t == OUTPUT_USED) & (last == RETURN) & (n == OUTPUT_USED), F.concat(F.lit("that "), "last_return", F.lit(" is used by methods that "), base(F.col("verb"), F.col("object")), F.lit(" and "), base(F.col("next_verb"), F.col("next_object"))))
        .when((t == OUTPUT_USED) & (last == OUTPUT_USED) & (F.col("last2_type") == RETURN), F.lit(None))
        .when((t == OUTPUT_USED) & (last == RETURN), F.concat(F.lit("that "), "last_return", F.lit(" is used by a method that "), _third_person(F.col("verb")), F.lit(" the "), "object"))
        .when((t == CALLED) & (n == IMPORTANCE), F.concat("method", F.lit("() seems "), importance_words(F.col("next_pagerank"), F.col("next_average")), F.lit(" important than average because it is "), called_words(F.col("called"))))
        .when((t == IMPORTANCE) & (last == CALLED), F.lit(None))
        .otherwise(F.col("phrase"))
    )
    return p.select("id", "method", "type_order", "part", "phrase", joined.alias("told"))


def summaries(methods: DataFrame, averages: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """``(id, method, n_messages, plan, summary)``: one paragraph per method."""
    told = aggregated(messages(methods, averages, callers))
    sentence = F.concat(F.upper(F.substring("told", 1, 1)), F.expr("substring(told, 2)"), F.lit("."))
    parts = F.array_sort(F.collect_list(F.struct("type_order", "part", sentence.alias("s"))))
    out = told.groupBy("id", "method").agg(F.count(F.lit(1)).alias("n_messages"), parts.alias("parts"))
    return out.select("id", "method", "n_messages", F.transform("parts", lambda x: x["type_order"]).alias("plan"), F.array_join(F.array_compact(F.transform("parts", lambda x: x["s"])), " ").alias("summary"))
