"""Text, binary and delimited inputs."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.positions import grouped_positions
from weftline.session import ship


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)``: one row per file, its lines joined by line feeds."""
    read = spark.read.text(path, wholetext=True)
    return read.select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)`` from 0, in the order of the file; several files follow each other by name."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")]
    lines = spark.read.text(path).select("value", *where, F.lit(0).alias("all"))
    return grouped_positions(lines, ["all"], [F.col("file"), F.col("block"), F.col("place")]).select((F.col("position") - 1).alias("line_no"), "value")


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """``(term_idx, term)``: a term's ordinal is its line."""
    return numbered_lines(spark, path).select(F.col("line_no").alias("term_idx"), F.col("value").alias("term"))


def word_list(spark: SparkSession, path: str) -> list[str]:
    """A stop-word list: one entry a line. Such lists are small and read by the driver."""
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]


def word_pairs(spark: SparkSession, path: str) -> dict[str, str]:
    """A spelling table: wrong and right word a line, separated by a comma or tab."""
    rows = spark.read.text(path).select(F.split("value", "[,\t]").alias("p")).filter(F.size("p") == 2).collect()
    return {r["p"][0].strip(): r["p"][1].strip() for r in rows}


def word_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(n, counts)`` of lines ``n idx:count idx:count ...``."""
    parts = F.split(F.trim(column), r"\s+")
    pairs = F.transform(F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p.contains(":")), lambda p: F.struct(F.element_at(F.split(p, ":"), 1).cast("int").alias("k"), F.element_at(F.split(p, ":"), 2).cast("int").alias("v")))
    return lines.filter(F.trim(column) != "").select(F.element_at(parts, 1).cast("int").alias("n"), F.map_from_entries(pairs).alias("counts"))


def file_bytes(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """Files of a folder tree with their bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", "true").load(folder)


def sparse_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(file, row, col, value)`` of binary sparse matrices: big-endian rows, columns, non-zeros, then for each
    column its number of entries and pairs of row (int) and value (float)."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows, cols, values, at = [], [], [], 12
                _, n_cols, _ = struct.unpack(">iii", content[:12])
                for col in range(n_cols):
                    (n,) = struct.unpack_from(">i", content, at)
                    entries = np.frombuffer(content, dtype=[("r", ">i4"), ("v", ">f4")], count=n, offset=at + 4)
                    rows.append(entries["r"].astype(np.int32))
                    values.append(entries["v"].astype(np.float32))
                    cols.append(np.full(n, col, np.int32))
                    at += 4 + 8 * n
                if rows:
                    yield pd.DataFrame({"file": name, "row": np.concatenate(rows), "col": np.concatenate(cols), "value": np.concatenate(values)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row int, col int, value float")


def positive_entries(dense: DataFrame, key: str, array: str) -> DataFrame:
    """``(key, col, value)``: the entries above 0 of dense rows."""
    return dense.select(key, F.posexplode(array).alias("col", "value")).filter("value > 0")


def duplicates_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A written list of known duplicates."""
    read = spark.read.csv(path, sep=delimiter, header=True, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, schema="feature_id string, dup_id string, rank int, sim double")
    return read


def pairs_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A written list of similar pairs."""
    schema = "Title_i int, ID_i string, Doc_j int, ID_j string, cosine_similarity float"
    return spark.read.csv(path, sep=delimiter, header=True, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, schema=schema)


# Fields of a run log and their patterns.
LOG_FIELDS = {
    "documents": r"(?i)(\d+) (?:feature requests|documents)",
    "svd_seconds": r"(?i)encoding\D*([\d.]+)",
    "rank": r"(?i)rank\D*(\d+)",
    "hit_10": r"(?i)top ?(?:10|ten)\D*([\d.]+) ?%",
    "hit_20": r"(?i)top ?(?:20|twenty)\D*([\d.]+) ?%",
}


def run_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log with its figures as doubles; missing figures are null."""
    logs = whole_texts(spark, path)
    return logs.select("file", *[F.regexp_extract("value", p, 1).try_cast("double").alias(n) for n, p in LOG_FIELDS.items()])
