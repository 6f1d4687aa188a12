"""Splitting an oversize catalog into parts without cutting a product."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import catalog_fields as K
from gristmill.functions.text import is_blank
from gristmill.operators.catalog_rows import data_columns


def quoted_line(names: list[str]) -> Column:
    """The CSV line of a row with every field quoted."""
    q = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(n).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for n in names]
    return F.concat_ws(",", *q)


def row_bytes(names: list[str]) -> Column:
    """UTF-8 size of the row's CSV line plus the line break."""
    return F.octet_length(quoted_line(names)) + 1


def header_bytes(names: list[str]) -> int:
    return len(",".join('"' + n.replace('"', '""') + '"' for n in names).encode())


def product_groups(df: DataFrame) -> DataFrame:
    """One row per product (rows without a handle are their own product): first row and bytes."""
    names = data_columns(df)
    key = F.when(is_blank("Handle"), F.concat(F.lit("\u0001"), F.col("row_no").cast("string"))).otherwise(F.col("Handle"))
    return df.groupBy("file_id", key.alias("product")).agg(F.min("row_no").alias("first_row"), F.sum(row_bytes(names)).alias("bytes"))


def pack_groups(groups: DataFrame, head: int, target: int) -> DataFrame:
    """Greedy part number per product.

    Input rows are only (file, first row, bytes). Each partition holds whole files sorted by position and is
    *streamed* batch by batch with two numbers of state, so memory does not grow with the file.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, part, used = None, 0, 0
        for pdf in batches:
            parts = []
            for fid, size in zip(pdf["file_id"], pdf["bytes"]):
                if fid != current:
                    current, part, used = fid, 1, head
                elif used + size > target:
                    part, used = part + 1, head
                used += size
                parts.append(part)
            yield pdf.assign(part=parts)

    ordered = groups.repartition("file_id").sortWithinPartitions("file_id", "first_row")
    return ordered.mapInPandas(scan, "file_id string, product string, first_row bigint, bytes bigint, part int")


def split_by_bytes(df: DataFrame, target: int = K.SPLIT_TARGET_BYTES) -> DataFrame:
    """The catalog with a ``part`` column (null when the file needs no split)."""
    groups = pack_groups(product_groups(df), header_bytes(data_columns(df)), target)
    parts = groups.groupBy("file_id").agg(F.max("part").alias("_parts"))
    key = F.when(is_blank("Handle"), F.concat(F.lit("\u0001"), F.col("row_no").cast("string"))).otherwise(F.col("Handle"))
    j = df.withColumn("product", key).join(groups.select("file_id", "product", "part"), ["file_id", "product"]).join(parts, "file_id")
    return j.withColumn("part", F.when(F.col("_parts") > 1, F.col("part"))).drop("product", "_parts")


def oversize_log(df: DataFrame, limit: int = K.SIZE_LIMIT_BYTES, target: int = K.SPLIT_TARGET_BYTES) -> DataFrame:
    """Change-log rows of the size repair: split into n parts, could not split, or nothing for files under the limit."""
    head = header_bytes(data_columns(df))
    packed = pack_groups(product_groups(df), head, target)
    g = packed.groupBy("file_id").agg((F.sum("bytes") + head).alias("size"), F.max("part").alias("parts")).filter(F.col("size") >= limit)
    many = F.col("parts") > 1
    return g.select(
        "file_id", F.lit("(file)").alias("column_name"), F.concat(F.col("size").cast("string"), F.lit(" bytes")).alias("before"),
        F.when(many, F.concat(F.col("parts").cast("string"), F.lit(" parts"))).otherwise("(could not split safely)").alias("after"),
        F.when(many, F.lit("Split into parts, products kept whole")).otherwise(F.lit("A single product is too large for one part")).alias("reason"))
