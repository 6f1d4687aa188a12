"""Comparison of a store export with an update file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import catalog_fields as K
from gristmill.functions.text import jstrim
from gristmill.operators.catalog_rows import cell, data_columns


def common_columns(update_headers: list[str], store_headers: list[str]) -> list[str]:
    """Columns on both sides, in update order, each once."""
    return [h for h in dict.fromkeys(update_headers) if h in set(store_headers)]


def handle_key(c="Handle"):
    return F.lower(jstrim(F.coalesce(F.col(c), F.lit(""))))


def first_per_handle(df: DataFrame, columns: list[str]) -> DataFrame:
    """First row per normalised handle. ``min_by`` combines map-side, so a hot handle moves one row per task."""
    keep = F.struct(*[jstrim(F.coalesce(F.col(c), F.lit(""))).alias(f"c{i}") for i, c in enumerate(columns)],
                    F.coalesce(F.nullif(cell(df, "Title"), F.lit("")), F.nullif(cell(df, "Variant SKU"), F.lit("")), handle_key()).alias("title"))
    return df.filter(handle_key() != "").groupBy(handle_key().alias("handle")).agg(F.min_by(keep, F.col("row_no")).alias("r"))


def paired(store: DataFrame, update: DataFrame) -> tuple[DataFrame, list[str]]:
    cols = common_columns(data_columns(update), data_columns(store))
    s = first_per_handle(store, cols).select("handle", F.col("r").alias("s"))
    u = first_per_handle(update, cols).select("handle", F.col("r").alias("u"))
    return u.join(s, "handle", "left"), cols


def catalog_compare(store: DataFrame, update: DataFrame) -> DataFrame:
    """Tidy diff: NEW rows for handles the store lacks, one CHANGE row per differing field."""
    pairs, cols = paired(store, update)
    def change(i, name):
        b, a = F.col(f"s.c{i}"), F.col(f"u.c{i}")
        return F.when(F.col("s").isNotNull() & (b != a), F.struct(
            F.lit("CHANGE").alias("change"), F.lit(name).alias("field"), b.alias("before"), a.alias("after"),
            ((b != "") & (a == "")).alias("is_blank_overwrite")))
    new = F.when(F.col("s").isNull(), F.struct(
        F.lit("NEW").alias("change"), F.lit("").alias("field"), F.lit("").alias("before"), F.lit("").alias("after"),
        F.lit(False).alias("is_blank_overwrite")))
    rows = F.array_compact(F.array(new, *[change(i, n) for i, n in enumerate(cols)]))
    return pairs.select("handle", F.col("u.title").alias("title"), F.inline(rows))


def compare_new_products(store: DataFrame, update: DataFrame) -> DataFrame:
    u = first_per_handle(update, [])
    known = store.filter(handle_key() != "").select(handle_key().alias("handle")).distinct()
    return u.join(known, "handle", "left_anti").select("handle", F.col("r.title").alias("title"))


def compare_unchanged(store: DataFrame, update: DataFrame) -> DataFrame:
    pairs, cols = paired(store, update)
    same = F.lit(True)
    for i in range(len(cols)):
        same = same & (F.col(f"s.c{i}") == F.col(f"u.c{i}"))
    return pairs.filter(F.col("s").isNotNull() & same).select("handle", F.col("u.title").alias("title"))


def field_change_counts(diff: DataFrame) -> DataFrame:
    """Changed products per field with category and label; fields without a category are ``other``."""
    cat = F.create_map(*[x for f, (c, _) in K.FIELD_CATEGORIES.items() for x in (F.lit(f), F.lit(c))])
    lab = F.create_map(*[x for f, (_, n) in K.FIELD_CATEGORIES.items() for x in (F.lit(f), F.lit(n))])
    g = diff.filter(F.col("change") == "CHANGE").groupBy("field").agg(F.count(F.lit(1)).alias("products"))
    return g.select("field", "products", F.coalesce(cat[F.col("field")], F.lit("other")).alias("category"),
                    F.coalesce(lab[F.col("field")], F.col("field")).alias("label"))


def blank_overwrite_report(diff: DataFrame) -> DataFrame:
    """Cells that the import would clear, changed and new products, and the verdict."""
    per = diff.groupBy("handle").agg(
        F.count_if("is_blank_overwrite").alias("cleared"), F.bool_or(F.col("change") == "CHANGE").alias("changed"))
    g = per.agg(F.coalesce(F.sum("cleared"), F.lit(0)).alias("cleared_fields"), F.count_if("changed").alias("changed_products"),
                F.count_if(~F.col("changed")).alias("new_products"))
    verdict = F.when(F.col("cleared_fields") > 0, "critical").when(F.col("changed_products") > 0, "warning").otherwise("pass")
    return g.withColumn("verdict", verdict)


def compare_diff_table(diff: DataFrame) -> DataFrame:
    """Export form of the diff."""
    return diff.select(F.col("handle").alias("Handle"), F.col("title").alias("Title"), F.col("change").alias("Change"),
                       F.col("field").alias("Field"), F.col("before").alias("Before"), F.col("after").alias("After"))
