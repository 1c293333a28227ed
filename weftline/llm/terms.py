"""The terms of a record, as TESTDATA.md defines them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of a-z and 0-9 that begins with a letter and has at least three characters; the
#: look-behind keeps a letter inside a run from beginning a term.
TERM = "(?<![a-z0-9])[a-z][a-z0-9]{2,}"


def terms_of(title: Column, body: Column) -> Column:
    """Terms in order, with repeats; null texts count as empty."""
    empty = F.lit("")
    text = F.lower(F.concat(F.coalesce(title, empty), F.lit(" "), F.coalesce(body, empty)))
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
