"""Manifests of cases with what must and must not be found: src.corpus.

A manifest is a list of cases in block style, each with the lists `expected` and `must_be_absent` of one-line entries:

    cases:
      - id: first
        expected:
          - {rule: a-rule, function: "m.f", file: m.py, line: 3}
        must_be_absent:
          - {rule: other-rule, function: "m.g"}

Which case and which list a line belongs to is the last one named above it, a window over the lines; nothing is nested deeper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _field(entry: Column, name: str) -> Column:
    """The value of a field, with or without quotes; null if it is not there."""
    found = F.regexp_extract(entry, rf"[{{,]\s*{name}:\s*(\"[^\"]*\"|'[^']*'|[^,}}\"']+?)\s*[,}}]", 1)
    return F.when(found != "", F.regexp_replace(found, r"^[\"']|[\"']$", ""))


def entries(docs: DataFrame, manifest: str = "manifest", text: str = "value") -> DataFrame:
    """(manifest, case, list, place, rule, function, file, line) of every entry; place is the number of its line. Comments and other keys are passed over."""
    lines = docs.select(manifest, F.posexplode(F.split(text, r"\r?\n")).alias("place", "_line"))
    above = Window.partitionBy(manifest).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda pattern: F.last(F.when(F.col("_line").rlike(pattern), F.regexp_extract("_line", pattern, 1)), ignorenulls=True).over(above)
    told = lines.withColumn("case", F.regexp_replace(last(r"^\s*-\s+id:\s*(\S.*?)\s*$"), r"^[\"']|[\"']$", "")).withColumn("list", last(r"^\s+(\w+):(?:\s|$)"))
    entry = F.regexp_extract("_line", r"^\s*-\s*(\{.*\})\s*(?:#.*)?$", 1)
    told = told.withColumn("_entry", entry).where((F.col("_entry") != "") & F.col("list").isin("expected", "must_be_absent"))
    return told.select(manifest, "case", "list", "place", *[_field(F.col("_entry"), f).alias(f) for f in ("rule", "function", "file")], _field(F.col("_entry"), "line").try_cast("int").alias("line"))


def corpus(docs: DataFrame, manifest: str = "manifest", text: str = "value") -> tuple[DataFrame, DataFrame]:
    """src.corpus: (expected, must_be_absent) as operators.scoring takes them; `want` numbers an entry within its case."""
    e = entries(docs, manifest, text)
    want = F.row_number().over(Window.partitionBy(manifest, "case").orderBy("place"))
    expected = e.where("list = 'expected'").select("case", want.alias("want"), "rule", "function", "file", "line")
    return expected, e.where("list = 'must_be_absent'").select("case", "rule", "function")
