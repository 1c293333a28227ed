"""Source markup (srcML): classes, methods, calls, variables and imports as tables."""

from __future__ import annotations

import io
import re
import xml.sax
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.graph import resolve_calls
from weftline.session import cut, ship

FACTS = "kind string, class_id string, method_id string, no int, name string, value string"


class _Reader(xml.sax.ContentHandler):
    """Collects facts while walking the elements; only the path of open elements is kept."""

    def __init__(self, unit: str):
        super().__init__()
        self.unit, self.facts, self.path, self.text = unit, [], [], []
        self.package, self.imports, self.classes, self.methods = "", [], [], []
        self.pending: dict[str, str] = {}
        self.counter = 0

    def startElement(self, tag, attrs):
        tag = tag.split(":")[-1]
        self.path.append(tag)
        self.text.append("")
        if tag == "class":
            self.counter += 1
            self.classes.append({"id": f"{self.unit}#{self.counter}", "name": None, "depth": len(self.path)})
        elif tag in ("function", "constructor"):
            self.counter += 1
            self.methods.append({"id": f"{self.unit}#{self.counter}", "name": None, "depth": len(self.path), "calls": 0, "type": None})

    def characters(self, content):
        if self.text:
            self.text[-1] += content

    def endElement(self, tag):
        tag = tag.split(":")[-1]
        text, depth = self.text.pop(), len(self.path)
        self.path.pop()
        parent = self.path[-1] if self.path else ""
        whole = text
        if self.text and tag not in ("argument_list", "parameter_list", "block", "specifier"):
            self.text[-1] += whole  # names grow from their parts: a.b.c
        if tag == "package":
            self.package = _name(whole, "package")
        elif tag == "import":
            self.imports.append(_name(whole, "import"))
        elif tag == "name":
            self._named("".join(whole.split()), parent, depth)
        elif tag == "call" and self.methods and self.classes:
            m = self.methods[-1]
            called = "".join(re.sub(r"^\s*new\s+", "", whole).split()).removeprefix("this.")  # only the word, not the start of a name
            self._fact("call", m["id"], m["calls"], called)
            m["calls"] += 1
        elif tag in ("function", "constructor") and self.methods:
            self.methods.pop()
        elif tag == "class" and self.classes:
            self.classes.pop()
        elif tag == "decl":
            self.pending.pop("type", None)

    def _named(self, name: str, parent: str, depth: int):
        if parent == "class" and self.classes and self.classes[-1]["name"] is None:
            c = self.classes[-1]
            c["name"] = name
            long_name = ".".join(x for x in [self.package, *[o["name"] for o in self.classes]] if x)
            self._fact("class", None, 0, name, long_name)
            for i, imported in enumerate(self.imports):
                self._fact("import", None, i, imported)
        elif parent in ("function", "constructor") and self.methods and self.methods[-1]["name"] is None:
            self.methods[-1]["name"] = name
            self._fact("method", self.methods[-1]["id"], self.counter, name)
        elif parent == "type":
            self.pending["type"] = name.split("<")[0].split("[")[0]
        elif parent == "decl" and self.classes and "type" in self.pending:
            method = self.methods[-1]["id"] if self.methods else None
            self._fact("variable", method, 0, name, self.pending["type"])

    def _fact(self, kind: str, method: str | None, no: int, name: str, value: str | None = None):
        if self.classes:
            self.facts.append((kind, self.classes[-1]["id"], method, no, name, value))


def _name(text: str, keyword: str) -> str:
    return "".join(text.split()).removeprefix(keyword).rstrip(";")


def facts_of(unit: str, markup: str) -> list[tuple]:
    """The facts of one file; markup that isn't well-formed gives those before the defect and an error row."""
    reader = _Reader(unit)
    try:
        xml.sax.parse(io.BytesIO(markup.encode()), reader)
    except xml.sax.SAXException as e:
        reader.facts.append(("error", None, None, 0, unit, str(e)))
    return reader.facts


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """(kind, class_id, method_id, no, name, value) of every file: a map over whole files, no shuffle."""
    ship(spark)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("unit"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [f for unit, markup in zip(frame["unit"], frame["value"]) for f in facts_of(unit, markup)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return files.mapInPandas(run, FACTS)


def tables(facts: DataFrame) -> dict[str, DataFrame]:
    """The facts as the tables that ``resolve_calls`` takes."""
    of = lambda kind: facts.filter(F.col("kind") == kind)
    return {
        "classes": of("class").select("class_id", "name", F.col("value").alias("long_name")),
        "methods": of("method").select("class_id", "method_id", F.col("no").alias("method_no"), "name"),
        "calls": of("call").select("method_id", F.col("no").alias("call_no"), F.col("name").alias("called")),
        "variables": of("variable").select("class_id", "method_id", F.col("name").alias("variable"), F.col("value").alias("type")),
        "imports": of("import").select("class_id", F.col("no").alias("import_no"), F.col("name").alias("import")),
    }


def read_call_graph(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` of the source markup under a path."""
    return resolve_calls(**tables(cut(read_facts(spark, path))))
