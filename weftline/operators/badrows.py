"""Separating delimited lines that cannot be read from those that can.

First step: every line of a known kind and delimiter is read permissively under the typed schema of its
kind, with a column that retains the raw text of a corrupt line. What the reader takes
is checked for its bounds. Second step: the retained texts of the others are reclassified against the
written grammar: quoting first, then the number of fields, then casts. The reader is more lenient than that grammar
in a few ways (quotes anywhere, signs before whole numbers, ``5.``, ``0.5d``, other alphabets' digits), so texts with
any of these are retained as well. Everything is a column expression: one narrow stage
without a shuffle and without Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two kinds of delivered lines and the type of each of their fields.
KINDS = {
    "duplicates": (("feature_id", "id"), ("dup_id", "id"), ("rank", "rank"), ("sim", "number")),
    "lsa_m2": (("title_i", "ordinal"), ("id_i", "id"), ("doc_j", "ordinal"), ("id_j", "id"), ("cosine_similarity", "number")),
}
DELIMITERS = (",", ";")
BLANKS = " \t\r"
MAX_INT = "2147483647"
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_TYPES = {"id": "string", "ordinal": "int", "rank": "int", "number": "double"}
#: The reader fails on lines of more fields than it has room for; these are retained without it.
MOST_FIELDS = 512
#: What the reader takes and the grammar may not: anything but digits, blanks, delimiters, points and minus signs, a point
#: without a digit on each side, and a negative zero, which as a whole number is no longer negative.
LENIENT = r"[^0-9 \t,;.\-]|\.(?![0-9])|(?<![0-9])\.|-0"


@dataclass(frozen=True)
class Line:
    """Names of the input columns."""

    text: str = "raw_text"
    kind: str = "kind"
    delimiter: str = "delim"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _field_pattern(delimiter: str) -> str:
    return rf'[ \t\r]*+(?:{QUOTED}[ \t\r]*+|[^"{delimiter}]*+)'


def _up_to(value: Column, largest: str, least: str) -> Column:
    """Digits only, within bounds, without risking an overflow on very long digit strings."""
    digits = F.regexp_replace(value, "^0+(?=[0-9])", "")
    bounded = (F.length(digits) < len(largest)) | ((F.length(digits) == len(largest)) & (digits <= largest))
    return value.rlike(r"\A[0-9]+\z") & bounded & (digits >= least)


def _holds(value: Column, kind: str) -> Column:
    """Whether the trimmed text of a field is a value of its type."""
    if kind == "id":
        return value.rlike(r"\A[0-9]+\z")
    if kind == "ordinal":
        return _up_to(value, MAX_INT, "0")
    if kind == "rank":
        return (value == "") | _up_to(value, MAX_INT, "1")
    number = value.rlike(r"\A[+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?\z")
    return (value == "") | (number & F.coalesce(_number(value).between(-1.0, 1.0), F.lit(False)))


def _number(value: Column) -> Column:
    return F.translate(value, ",", ".").try_cast("double")


def _typed(value: Column, kind: str) -> Column:
    if kind == "number":
        return _number(value)
    return value if kind == "id" else value.try_cast("int")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def read_permissively(lines: DataFrame, names: Line = Line()) -> DataFrame:
    """Adds a typed struct ``__<kind>`` for each kind (null where the line is not of that kind), with
    ``corrupt``, the raw text of a line that the reader gave up on; its fields as ``__<kind>__<field>``; and ``__retained``, the texts left to
    the second step: those the reader retained, and those it reads more leniently than the grammar. Lines
    of unknown kind or delimiter, and null texts, have nulls in all of them.
    """
    text, kind, delim = F.col(names.text), F.col(names.kind), F.col(names.delimiter)
    reads, corrupt, taken = [], F.lit(None).cast("string"), F.lit(False)
    for name, parts in KINDS.items():
        schema = ", ".join(f"{f} {_TYPES[t]}" for f, t in parts) + ", corrupt string"
        read = F.lit(None).cast(f"struct<{', '.join(f'{f}:{_TYPES[t]}' for f, t in parts)}, corrupt:string>")
        for d in DELIMITERS:
            options = {
                "sep": d, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "ignoreLeadingWhiteSpace": "true",
                "ignoreTrailingWhiteSpace": "true", "maxColumns": str(MOST_FIELDS),
            }
            fits = F.length(text) - F.length(F.translate(text, d, "")) < MOST_FIELDS
            read = F.when((kind == name) & (delim == d) & fits, F.from_csv(text, F.lit(schema), options)).otherwise(read)
        reads.append(read.alias(f"__{name}"))
    staged = lines.select("*", F.inline(F.array(F.struct(*reads))))
    for name in KINDS:
        read = F.col(f"__{name}")
        corrupt = F.coalesce(corrupt, read["corrupt"])
        taken = taken | (read.isNotNull() & read["corrupt"].isNull())
    known = F.coalesce(kind.isin(*KINDS) & delim.isin(*DELIMITERS), F.lit(False)) & text.isNotNull()
    lenient = (text == "") | text.rlike(LENIENT)
    retained = F.when(known & ~(taken & ~lenient), F.coalesce(corrupt, text))
    # As columns of their own: one computed value each, whatever reads them later.
    flat = F.struct(*[F.col(f"__{name}")[f].alias(f"__{name}__{f}") for name, parts in KINDS.items() for f, _ in parts], retained.alias("__retained"))
    return staged.select("*", F.inline(F.array(flat)))


def classify(lines: DataFrame, names: Line = Line()) -> DataFrame:
    """Adds ``reason`` (null for a valid line), ``corrupt_text`` and ``record`` to every line.

    ``reason`` is the first that holds of ``quoting``, ``columns`` and ``value``. A null text
    has no fields and is ``columns``; so is an empty one. A line whose kind or delimiter is
    not known (or null) is ``kind`` or ``delimiter``. ``corrupt_text`` holds the raw text of bad
    lines only. ``record`` is a struct with one typed struct per kind, null for bad lines and
    for the other kind. Rows are never dropped, equal rows stay equal rows, and further input
    columns are kept, whatever their names (input columns called like the three results are
    replaced).
    """
    text, kind, delim = F.col(names.text), F.col(names.kind), F.col(names.delimiter)
    staged = read_permissively(lines.drop("reason", "corrupt_text", "record"), names)
    retained = F.col("__retained")
    staged = _computed_once(staged, "__split", _split(retained, delim))
    staged = _computed_once(staged, "__fields", _contents(F.col("__split")))
    fields = F.col("__fields")
    width, bounded, holds, records = F.lit(None).cast("int"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), []
    for name, parts in KINDS.items():
        read = {f: F.col(f"__{name}__{f}") for f, _ in parts}
        width = F.when(kind == name, len(parts)).otherwise(width)
        bounded = F.when(kind == name, _all([_in_bounds(read[f], t) for f, t in parts])).otherwise(bounded)
        holds = F.when(kind == name, _all([_holds(F.get(fields, F.lit(i)), t) for i, (_, t) in enumerate(parts)])).otherwise(holds)
        typed = F.struct(*[F.when(retained.isNull(), read[f]).otherwise(_typed(F.get(fields, F.lit(i)), t)).alias(f) for i, (f, t) in enumerate(parts)])
        records.append(F.when(F.col("reason").isNull() & (kind == name), typed).alias(name))
    reason = (
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "kind")
        .when(~F.coalesce(delim.isin(*DELIMITERS), F.lit(False)), "delimiter")
        .when(text.isNull(), "columns")
        .when(retained.isNull(), F.when(~bounded, "value"))
        .when(fields.isNull(), "quoting")
        .when(F.size(fields) != width, "columns")
        .when(~holds, "value")
    )
    out = _computed_once(staged, "reason", reason)
    out = out.withColumn("corrupt_text", F.when(F.col("reason").isNotNull(), F.coalesce("__retained", names.text))).withColumn("record", F.struct(*records))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that the optimizer doesn't copy into each of its later uses: a filter on
    the reason would otherwise repeat the reader, with its buffers, dozens of times. Generating
    the value from an array of one element stops such inlining and keeps the stage narrow."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _in_bounds(value: Column, kind: str) -> Column:
    """Whether a value that the reader took is one of its type."""
    if kind == "id":
        return F.coalesce(value.rlike(r"\A[0-9]+\z"), F.lit(False))
    if kind == "ordinal":
        return F.coalesce(value >= 0, F.lit(False))
    return F.coalesce(value >= 1 if kind == "rank" else value.between(-1.0, 1.0), F.lit(True))


def _split(text: Column, delim: Column) -> Column:
    """The fields of a retained text as written, or null where the quoting is broken. A leading delimiter makes
    every match non-empty, so that empty fields are found too."""
    out = F.lit(None).cast("array<string>")
    for d in DELIMITERS:
        field, line = _field_pattern(d), F.concat(F.lit(d), text)
        whole = line.rlike(rf"\A(?:{d}{field})*+\z")
        out = F.when(delim == d, F.when(whole, F.regexp_extract_all(line, F.lit(f"{d}({field})"), F.lit(1)))).otherwise(out)
    return out


def _contents(split: Column) -> Column:
    """Fields without outer blanks and quotes; two quotes inside quotes are one."""

    def content(field: Column) -> Column:
        bare = _trim(field)
        inner = F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))
        return F.when(bare.startswith('"'), inner).otherwise(bare)

    return F.transform(split, content)


def bad_lines(lines: DataFrame, names: Line = Line()) -> DataFrame:
    """The lines that cannot be read, with the reason and their raw text."""
    return classify(lines, names).filter(F.col("reason").isNotNull()).drop("record")


def valid_lines(lines: DataFrame, kind: str, names: Line = Line()) -> DataFrame:
    """The valid lines of one kind with typed columns beside the input's own.

    Empty ``rank``, ``sim`` and cosine fields load as null. A typed column replaces an input
    column of the same name.
    """
    good = classify(lines, names).filter(F.col("reason").isNull() & (F.col(names.kind) == kind))
    for field, _ in KINDS[kind]:
        good = good.withColumn(field, F.col("record")[kind][field])
    return good.drop("record", "reason", "corrupt_text")
