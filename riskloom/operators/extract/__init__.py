"""Functions and their structural metrics from source text: one Arrow pass over files, whose rows are exploded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...config import Config
from ...functions.scoring import function_id, scored
from ...sources.files import suppression
from .braces import extract_braces
from .python import extract_python

SCHEMA = "path string, language string, text string, function string, line long, end_line long, cc long, nd long, fo long, ns long, loc long, callees array<string>"


def extract(text: str, language: str) -> list[dict]:
    """The functions of one file; none where it doesn't parse."""
    try:
        return extract_python(text) if language == "Python" else extract_braces(text, "C" if language == "CHeader" else language)
    except (SyntaxError, ValueError, RecursionError, IndexError):
        return []


def function_rows(files: DataFrame) -> DataFrame:
    """files (path, language, text) -> SCHEMA, one row for each function. NULL texts and languages without an extractor have none."""
    fields = ["function", "line", "end_line", "cc", "nd", "fo", "ns", "loc", "callees"]
    types = [pa.string(), *[pa.int64()] * 7, pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, lang, text = (batch.column(k)[i].as_py() for k in range(3))
                found = extract(text, lang) if text and lang else []
                for f in found:
                    if f["function"] == "<anonymous>":
                        f["function"] = f"<anonymous>@{path}:{f['line']}"
                if found:
                    head = [pa.array([x] * len(found), pa.string()) for x in (path, lang, text)]
                    yield pa.RecordBatch.from_arrays(head + [pa.array([f[k] for f in found], t) for k, t in zip(fields, types)], ["path", "language", "text", *fields])

    return files.select("path", "language", "text").mapInArrow(run, SCHEMA)


def reports(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Scored function reports: (function_id, file, function, line, language, metrics, components, lrs, band, suppression_reason, callees)."""
    rows = function_rows(files).withColumnRenamed("path", "file")
    rows = rows.withColumn("suppression_reason", F.when(F.col("language").isin("TypeScript", "TypeScriptReact", "JavaScript", "JavaScriptReact", "Vue"), suppression(F.col("text"), F.col("line")))).drop("text")
    return scored(rows.withColumn("function_id", function_id(F.col("file"), F.regexp_replace("function", "^<anonymous>@.*$", "<anonymous>"))), config)
