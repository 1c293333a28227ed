"""Shallow features of messages in a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.positions import grouped_positions

#: A long conversation is handled in blocks of so many messages.
BLOCK = 65_536


def read_transcripts(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``(conversation, turn, at, author, text)`` of delimited transcripts with a header; texts may hold quotes and line ends."""
    options = {"header": True, "sep": delimiter, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": True, "nullValue": "\\N", "emptyValue": ""}
    return spark.read.options(**options).schema("conversation string, turn long, at timestamp, author string, text string").csv(path)


def message_features(messages: DataFrame, conversation: str, order: list[str], text: str, time: str) -> DataFrame:
    """Adds ``wc`` (words), ``slen`` (words over the most words of any earlier message; null for the first, and
    while all earlier ones are empty) and ``ppau`` (seconds since the message before; null for the first).

    Words are separated by white space; null and blank texts have none. ``order`` must settle ties. Messages of one conversation, however
    many, are spread: they are numbered exactly, windows see a block of them, and what is carried from block to block is two figures.
    """
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    counted = messages.drop("wc", "slen", "ppau").withColumn("wc", F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long"))
    numbered = grouped_positions(counted, [conversation], [F.col(c).asc_nulls_first() for c in order])
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    numbered = numbered.withColumn("__block", F.floor((F.col("position") - 1) / BLOCK)).withColumn("__micros", seconds)
    blocks = numbered.groupBy(conversation, "__block").agg(F.max("wc").alias("most"), F.max(F.struct("position", "__micros")).alias("last"))
    before = Window.partitionBy(conversation).orderBy("__block")
    carried = blocks.select(
        F.col(conversation).alias("__c"), F.col("__block").alias("__b"), F.max("most").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("__most"), F.lag("last.__micros").over(before).alias("__last")
    ).filter("__b > 0")
    joined = numbered.join(carried, F.col(conversation).eqNullSafe(F.col("__c")) & (F.col("__block") == F.col("__b")), "left")
    inside = Window.partitionBy(conversation, "__block").orderBy("position")
    longest = F.greatest(F.max("wc").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__most"))
    last = F.when(F.col("position") % BLOCK == 1, F.col("__last")).otherwise(F.lag("__micros").over(inside))
    out = joined.withColumn("__longest", longest).withColumn("__before", last)
    out = out.withColumn("slen", F.when(F.col("__longest") > 0, F.col("wc") / F.col("__longest"))).withColumn("ppau", (F.col("__micros") - F.col("__before")) / 1e6)
    return out.select(*counted.columns, "slen", "ppau")
