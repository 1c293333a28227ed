"""Classifier reports: reading them, writing their lines, and computing their figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = (("Precision", "precision"), ("Recall", "recall"), ("f1-Score", "f1"), ("Support", "support"))
_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
ROW = rf"^\s*(\S.*?)\s+({_NUMBER})\s+({_NUMBER})\s+({_NUMBER})\s+({_NUMBER})\s*$"


def parse_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(type, precision, recall, f1, support)`` of every line that is a row of a report.

    Titles, headers and blank lines are skipped wherever they are, and a row's name may hold blanks
    (``avg / total``). Lines that are none of these are given by ``rejected_lines``.
    """
    value = lambda i: F.regexp_extract(column, ROW, i)
    rows = lines.filter(F.col(column).rlike(ROW))
    return rows.select(value(1).alias("type"), *[value(i).cast("double").alias(n) for i, n in ((2, "precision"), (3, "recall"), (4, "f1"), (5, "support"))])


def rejected_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines with text that are neither a row nor a title or header (which hold no number)."""
    return lines.filter(~F.col(column).rlike(ROW) & F.col(column).rlike(r"\S") & F.col(column).rlike(rf"(?:^|\s){_NUMBER}(?:\s|$)"))


def metric_lines(report: DataFrame) -> DataFrame:
    """``(type, metric, line)``: four lines for each row, such as ``[name, Precision = 0.94]``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).alias("v")) for name, c in METRICS]))
    line = F.concat(F.lit("["), F.col("type"), F.lit(", "), F.col("p.metric"), F.lit(" = "), F.col("p.v").cast("string"), F.lit("]"))
    return report.select("type", pairs.alias("p")).select("type", "p.metric", line.alias("line"))


def model_gate(df: DataFrame, kind: Column, wanted: str) -> DataFrame:
    """The rows only if the model kind is the wanted one, in any case (``LR Model``, ``NB Model``)."""
    return df.filter(F.lower(kind) == wanted.lower())


def text_lines(df: DataFrame, column: str) -> DataFrame:
    """``(pos, line)``: the lines of a text, one row each."""
    return df.select(F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), "\n")).alias("pos", "line"))


def classification_report(rows: DataFrame, truth: str, predicted: str, by: str | None = None) -> DataFrame:
    """``([by,] type, precision, recall, f1, support)`` of each class of ``truth``; figures over nothing are 0."""
    keys = [by] if by else []
    true = rows.groupBy(*keys, F.col(truth).alias("type")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(truth).eqNullSafe(F.col(predicted))).alias("hit"))
    named = rows.groupBy(*keys, F.col(predicted).alias("type")).agg(F.count(F.lit(1)).alias("named"))
    joined = true.join(named, [*keys, "type"], "left").na.fill(0, ["named"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = joined.withColumn("precision", share("hit", "named")).withColumn("recall", share("hit", "support"))
    total = F.col("precision") + F.col("recall")
    out = out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))
    return out.select(*keys, "type", "precision", "recall", "f1", "support")


def census(records: DataFrame, by: list[str], resolution: str = "resolution") -> DataFrame:
    """``(by..., n_records, n_duplicates)``: records and those resolved as duplicates."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col(resolution) == "DUPLICATE").alias("n_duplicates"))
