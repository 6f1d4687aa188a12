"""Catalog CSV files: probing, reading, batch reading, misfit rows, and writing back."""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.text import jstrim, let, not_blank
from gristmill.operators.catalog_rows import data_columns
from gristmill.operators.catalog_split import quoted_line
from gristmill.operators.ordered import running_count
from gristmill.sources.ordered_files import read_ordered, write_ordered

# Delimiters in order of preference on a tie.
DELIMITERS = [",", ";", "\t", "|"]


def has_bom(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 3))
    return head.startswith("EFBBBF") | head.startswith("FFFE") | head.startswith("FEFF")


def file_encoding(content: Column) -> Column:
    """Encoding of raw bytes: byte-order marks first, then valid UTF-8, else ISO-8859-1.

    The whole content is tested, so a character cut at a sample edge cannot mislead the test.
    """
    by_mark = lambda head: (
        F.when(head.startswith("EFBBBF"), "UTF-8").when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE")
        .when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("ISO-8859-1"))
    return let(F.hex(F.substring(content, 1, 3)), by_mark)


def decoded(content: Column) -> Column:
    """Text of the bytes in their own encoding, without the byte-order mark."""
    def pick(e):
        # decode takes a constant charset, so there is one branch per known encoding
        text = F.lit(None).cast("string")
        for name in ("UTF-16LE", "UTF-16BE", "ISO-8859-1", "UTF-8"):
            text = F.when(e == name, F.decode(content, name)).otherwise(text)
        return F.regexp_replace(text, r"^\x{FEFF}", "")
    return let(file_encoding(content), pick)


def delimiter_of(text: Column) -> Column:
    """Most frequent candidate in the first five lines; ties keep the earlier candidate, none at all means comma."""
    names = F.array(*[F.lit(d) for d in DELIMITERS])
    def count(head):
        return F.array(*[F.length(head) - F.length(F.replace(head, F.lit(d), F.lit(""))) for d in DELIMITERS])
    def best(counts):
        top = F.array_max(counts)
        return F.when(top > 0, F.element_at(names, F.array_position(counts, top).cast("int"))).otherwise(",")
    head = F.array_join(F.slice(F.split(text, r"\r?\n", 6), 1, 5), "\n")
    return let(let(head, count), best)


def with_text(files: DataFrame) -> DataFrame:
    """(file_id, content, text): the decoded text is generated once per file, whatever reads it later."""
    return files.select("file_id", "content", F.explode(F.array(decoded(F.col("content")))).alias("text"))


def csv_probe(files: DataFrame) -> DataFrame:
    """``files(file_id, content binary)`` -> (file_id, encoding, has_bom, delimiter, byte_size)."""
    c = F.col("content")
    return with_text(files).select(
        "file_id", file_encoding(c).alias("encoding"), has_bom(c).alias("has_bom"), delimiter_of(F.col("text")).alias("delimiter"), F.octet_length(c).cast("bigint").alias("byte_size"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw files of a folder as (file_id, content); the id is the file's path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content")


def csv_scan(spark: SparkSession, paths, headers: list[str], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Catalog rows of files that share delimiter, encoding and header.

    Quoted fields may hold line breaks and doubled quotes; blank rows are dropped and not counted, ``row_no`` is the place
    among the others plus 1 for the header. Spark gives no line numbers, but it reads a multi-line file in one piece and
    in order, so the running row id of its partition orders the rows; they are counted chunk by chunk.
    """
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    df = spark.read.schema(schema).csv(paths, header=True, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.select("*", F.col("_metadata.file_path").alias("file_id"), F.monotonically_increasing_id().alias("_id"))
    some = F.lit(False)
    for h in headers:
        some = some | not_blank(h)
    counted = running_count(df.filter(some), ["file_id"], "_id", "_place")
    return counted.select("file_id", (F.col("_place") + 1).alias("row_no"), *headers)


def csv_groups(spark: SparkSession, path: str) -> DataFrame:
    """(delimiter, encoding, header, paths): the files under ``path`` that one scan can read together.

    Files are probed where they lie; a group is as many paths as a reader is given anyway.
    """
    files = with_text(binary_files(spark, path))
    first = F.regexp_extract("text", r'^\s*((?:[^"\r\n]|"(?:[^"]|"")*+")*)', 1)
    probed = files.select("file_id", delimiter_of(F.col("text")).alias("delimiter"), file_encoding(F.col("content")).alias("encoding"), first.alias("header"))
    return probed.groupBy("delimiter", "encoding", "header").agg(F.sort_array(F.collect_list("file_id")).alias("paths"))


def header_names(header: str, delimiter: str) -> list[str]:
    """Trimmed names of a header line; a repeated name gets a number."""
    names, seen = [], {}
    for name in next(csv.reader([header], delimiter=delimiter), []):
        name = name.strip()
        seen[name.lower()] = seen.get(name.lower(), 0) + 1
        names.append(name if seen[name.lower()] == 1 else f"{name} ({seen[name.lower()]})")
    return names


def csv_recode(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, row_no, all columns by name) of the files under ``path``, whatever delimiters, encodings and headers they have.

    The files are probed first; files that agree in all three are read by one scan of Spark's own reader, and the scans
    are united by name. Written by ``write_lines``, the rows are comma-separated UTF-8 without byte-order marks.
    """
    out = None
    for group in csv_groups(spark, path).collect():
        rows = csv_scan(spark, group["paths"], header_names(group["header"], group["delimiter"]), group["delimiter"], group["encoding"])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return spark.createDataFrame([], "file_id string, row_no bigint") if out is None else out


def csv_batch_scan(files: DataFrame, columns: list[str], batch_rows: int = 10_000) -> DataFrame:
    """Rows of many files, each with its own delimiter, encoding and header, in one job.

    ``files(file_id, content)`` -> (file_id, row_no, one column per known name, ``extra`` map of the others). A catalog file
    is one upload of bounded size; it is parsed where its bytes are and its rows leave in batches, so neither paths nor
    contents pass through the driver.
    """
    x = with_text(files).select("file_id", "text", delimiter_of(F.col("text")).alias("sep"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fid, text, sep in zip(pdf["file_id"], pdf["text"], pdf["sep"]):
                reader = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
                header = [h.strip() for h in next(reader, [])]
                rows = ((i, r) for i, r in enumerate(r for r in reader if any(v.strip() for v in r)))
                while part := list(itertools.islice(rows, batch_rows)):
                    cells = [dict(zip(header, r)) for _, r in part]
                    yield pd.DataFrame({"file_id": fid, "row_no": [i + 2 for i, _ in part], "cells": cells})

    cells = x.mapInPandas(run, "file_id string, row_no bigint, cells map<string,string>")
    known = F.array(*[F.lit(c) for c in columns])
    return cells.select("file_id", "row_no", *[F.coalesce(F.try_element_at("cells", F.lit(c)), F.lit("")).alias(c) for c in columns],
                        F.map_filter("cells", lambda k, v: ~F.array_contains(known, k)).alias("extra"))


def misfits(text: Column, sep: Column) -> Column:
    """Rows whose field count differs from the header's. Quoted fields are blanked first, so separators in them do not count."""
    flat = F.regexp_replace(text, '"(?:[^"]|"")*+"', "q")
    lines = F.filter(F.split(flat, r"\r?\n", -1), lambda x: jstrim(x) != "")
    width = lambda x: F.length(x) - F.length(F.replace(x, sep, F.lit("")))
    odd = lambda counts: F.size(F.filter(counts, lambda n: n != F.get(counts, F.lit(0)))).cast("bigint")
    return let(F.transform(lines, width), odd)


def csv_misfit_rows(files: DataFrame) -> DataFrame:
    """``files(file_id, content)`` -> (file_id, misfit_rows)."""
    x = with_text(files).select("file_id", "text", F.explode(F.array(delimiter_of(F.col("text")))).alias("sep"))
    return x.select("file_id", misfits(F.col("text"), F.col("sep")).alias("misfit_rows"))


def write_corrected_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, comma, UTF-8, original row order inside each file folder."""
    names = data_columns(df)
    ordered = df.repartitionByRange("file_id", "row_no").sortWithinPartitions("file_id", "row_no")
    ordered.select("file_id", *names).write.mode("overwrite").partitionBy("file_id").csv(
        path, header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_lines(table: DataFrame, path: str, file: Column, order: list[str], columns: list[str]) -> None:
    """A table as ordered CSV files: comma, UTF-8, every field quoted, a header in each part."""
    head = ",".join('"' + c.replace('"', '""') + '"' for c in columns)
    write_ordered(table, path, file, order, quoted_line([f"`{c}`" for c in columns]), header=head + "\n", extension="csv")


def read_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(file, part, position, the columns as text) of ``write_lines``; lines are parsed by the CSV reader's own rules."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    parsed = F.from_csv("piece", schema.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", "), {"escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""})
    rows = read_ordered(spark, path).withColumn("_cells", parsed)
    return rows.select("file", "part", "position", *[F.coalesce(F.col(f"_cells.c{i}"), F.lit("")).alias(c) for i, c in enumerate(columns)])


def write_change_log(changes: DataFrame, path: str) -> None:
    """The change log of each catalog file, by row and column."""
    write_lines(change_log_table(changes), path, F.col("file_id"), ["Row", "Column", "Before", "After", "Reason"], ["Row", "Column", "Before", "After", "Reason"])


def change_log_table(changes: DataFrame) -> DataFrame:
    """Export form of the change log."""
    return changes.select("file_id", F.col("row_no").alias("Row"), F.col("column_name").alias("Column"), F.col("before").alias("Before"), F.col("after").alias("After"), F.col("reason").alias("Reason"))


def delimiter_log(probe: DataFrame) -> DataFrame:
    """Change-log rows for files that were not comma-separated; the sink always writes commas."""
    return probe.filter(F.col("delimiter") != ",").select(
        "file_id", F.lit("(file)").alias("column_name"), F.concat("delimiter", F.lit("-separated")).alias("before"),
        F.lit("comma-separated").alias("after"), F.lit("Converted delimiter to comma").alias("reason"))
