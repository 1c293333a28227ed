"""Issue-tracker exports and other XML inputs, read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import TRACKERS
from weftline.operators.positions import grouped_positions

_TEXTS = "long_desc array<struct<thetext string>>"
BUGZILLA = f"bug_id string, short_desc string, resolution string, dup_id string, {_TEXTS}"
TIGRIS = f"issue_id string, short_desc string, {_TEXTS}, is_duplicate struct<issue_id string>"
SAMPLE = (
    "ID string, created string, modified string, title string, reporter string, product string, version string, environment string, status string, "
    "resolution string, URL string, labels struct<label array<string>>, priority string, targetDate string, assignee string, votes string, "
    "links struct<link array<struct<linkType string, linkedID string, linkComment string>>>, "
    "comments struct<comments array<struct<cID string, cReporter string, cCreated string, cText string>>, comment array<struct<cID string, cReporter string, cCreated string, cText string>>>"
)
# Each child is read as an array, so that a repeated one is noticed.
METHODS = (
    "id array<int>, name array<string>, class array<string>, returntype array<string>, called array<struct<id array<int>>>, calls array<struct<id array<int>>>, "
    "use array<struct<type array<string>, example array<string>>>, pagerank array<double>, swum array<struct<object array<string>, verb array<string>>>"
)


def read_rows(spark: SparkSession, path: str, row_tag: str, schema: str, mode: str = "PERMISSIVE") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", mode).option("valueTag", "_text").schema(schema).load(path)


def _numbered(df: DataFrame) -> DataFrame:
    """Adds ``idx``, the ordinal of the record in the corpus: file, then place in the file."""
    placed = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).withColumn("all", F.lit(0))
    numbered = grouped_positions(placed, ["all"], [F.col("file"), F.col("block"), F.col("place")])
    return numbered.withColumn("idx", F.col("position") - 1).drop("all", "file", "block", "place", "position")


def canonical(df: DataFrame, record_id: Column, duplicate_id: Column) -> DataFrame:
    """``(idx, id, title, description, comments, resolution, duplicate_id)``: the first text is the description."""
    texts = F.transform(F.coalesce(F.col("long_desc"), F.array().cast("array<struct<thetext:string>>")), lambda x: x["thetext"])
    resolution = F.col("resolution") if "resolution" in df.columns else F.lit(None).cast("string")
    return df.select("idx", record_id.alias("id"), F.col("short_desc").alias("title"), F.try_element_at(texts, F.lit(1)).alias("description"), F.slice(texts, F.lit(2), F.greatest(F.size(texts), F.lit(1))).alias("comments"), resolution.alias("resolution"), duplicate_id.alias("duplicate_id"))


def not_invalid(df: DataFrame) -> DataFrame:
    """Drops records whose resolution ends with INVALID; a missing resolution stays."""
    return df.filter(~F.coalesce(F.col("resolution").endswith("INVALID"), F.lit(False)))


def read_bugzilla(spark: SparkSession, path: str) -> DataFrame:
    """A Bugzilla export. Ids stay strings, invalid records are left out."""
    rows = not_invalid(read_rows(spark, path, "bug", BUGZILLA))
    return canonical(_numbered(rows), F.col("bug_id"), F.col("dup_id"))


def read_tigris(spark: SparkSession, path: str) -> DataFrame:
    """A Tigris export; nothing is filtered."""
    return canonical(_numbered(read_rows(spark, path, "issue", TIGRIS)), F.col("issue_id"), F.col("is_duplicate.issue_id"))


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """The sample form: feature records with ID, title and comment texts."""
    rows = _numbered(read_rows(spark, path, "feature", SAMPLE))
    texts = F.transform(F.coalesce(F.col("comments.comment"), F.col("comments.comments")), lambda c: c["cText"])
    return rows.select("idx", F.col("ID").alias("id"), "title", F.lit(None).cast("string").alias("description"), texts.alias("comments"), "resolution", F.lit(None).cast("string").alias("duplicate_id"))


READERS = {TRACKERS["Bugzilla"]: read_bugzilla, TRACKERS["Tigris"]: read_tigris}


def read_tracker(spark: SparkSession, path: str, kind: int | str) -> DataFrame:
    """Dispatch by tracker: 0 or ``Bugzilla``, anything else is Tigris."""
    number = TRACKERS.get(kind, 1) if isinstance(kind, str) else kind
    return READERS[0 if number == 0 else 1](spark, path)


def read_relational(spark: SparkSession, path: str, row_tag: str) -> dict[str, DataFrame]:
    """Tables inferred from nesting: the rows under their tag with an ordinal ``<tag>_Id_0``, and a table for
    each repeated child with its parent's ordinal under the same name and its own ``pos``."""
    rows = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false").load(path)
    key = f"{row_tag}_Id_0"
    rows = _numbered(rows).withColumnRenamed("idx", key)
    tables, flat = {}, []
    for field in rows.schema.fields:
        kind = field.dataType.typeName()
        if kind == "array":
            child = rows.select(key, F.posexplode(field.name).alias("pos", "value"))
            nested = child.schema["value"].dataType.typeName() == "struct"
            tables[field.name] = child.select(key, "pos", "value.*") if nested else child
        elif kind == "struct":
            tables[field.name] = rows.filter(F.col(field.name).isNotNull()).select(key, F.lit(0).alias("pos"), f"{field.name}.*")
        else:
            flat.append(field.name)
    return {row_tag: rows.select(*flat), **tables}


def children(table: DataFrame, parent_column: str, parent: int) -> DataFrame:
    """The child rows of one parent."""
    return table.filter(F.col(parent_column) == parent)


def _only(children: Column, name: str, required: bool = True) -> Column:
    """The single child of an element: a repeated one is an error, and so is a missing one that is required."""
    n = F.greatest(F.size(children), F.lit(0))
    fault = F.raise_error(F.concat(F.lit(f"a method has not one {name} but "), n.cast("string")))
    one = F.try_element_at(children, F.lit(1))
    return F.when((n == 1) if required else (n <= 1), one).otherwise(fault)


def read_methods(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Method facts and the averages row of a method list; a record that doesn't fit fails the read.

    Every method has one id, name, class and return type, and at most one each of called, calls, use, swum and pagerank;
    a use has one type and example, a swum one verb and object. Values must be of their types.
    """
    rows = read_rows(spark, path, "method", METHODS, mode="FAILFAST")
    whole = rows.select(
        *[_only(F.col(c), c).alias(c) for c in ("id", "name", "class", "returntype")], *[_only(F.col(c), c, required=False).alias(c) for c in ("called", "calls", "use", "pagerank", "swum")]
    )
    part = lambda parent, name: F.when(F.col(parent).isNotNull(), _only(F.col(parent)[name], f"{parent}.{name}"))
    methods = whole.select(
        "id", "name", "class", "returntype", F.col("called.id").alias("called"), F.col("calls.id").alias("calls"), "pagerank",
        part("swum", "verb").alias("verb"), part("swum", "object").alias("object"), part("use", "type").alias("use_type"), part("use", "example").alias("example"),
    )
    averages = read_rows(spark, path, "averages", "called double, calls double, pagerank double", mode="FAILFAST")
    return methods, averages


def computed_averages(methods: DataFrame) -> DataFrame:
    """The averages row computed from the methods, whose callers and callees are arrays or, as ``n_called`` and ``n_calls``, numbers."""
    size = lambda c: F.col(f"n_{c}") if f"n_{c}" in methods.columns else F.greatest(F.size(c), F.lit(0))
    return methods.agg(F.avg(size("called")).alias("called"), F.avg(size("calls")).alias("calls"), F.avg("pagerank").alias("pagerank"))
