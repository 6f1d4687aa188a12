"""Header mapping: suggestions, need, conflicts, reuse, and import-mode detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import catalog_fields as K
from gristmill.functions.text import is_blank, jstrim, not_blank
from gristmill.operators.catalog_rows import cell


def alias_table(spark, aliases: dict[str, str] | None = None) -> DataFrame:
    pairs = sorted((aliases or K.ALIAS_TO_COLUMN).items())
    return spark.createDataFrame(pairs, "alias string, target string")


def suggest_mapping(headers: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(file_id, header, target) for headers found in the alias dictionary. The dictionary is a literal map."""
    pairs = aliases or K.ALIAS_TO_COLUMN
    table = F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv])
    key = F.lower(jstrim(F.coalesce("header", F.lit(""))))
    return headers.withColumn("target", table[key]).filter(F.col("target").isNotNull()).select("file_id", "header", "target")


def needs_mapping(headers: DataFrame, mode: str = "existing_products") -> DataFrame:
    """A required column is missing, or three or more headers are unknown."""
    low = F.lower(jstrim(F.coalesce("header", F.lit(""))))
    known = [n.lower() for n in K.KNOWN_COLUMNS]
    required = K.REQUIRED_NEW if mode == "new_products" else ["Handle"]
    have = F.lit(True)
    aggs = []
    for i, r in enumerate(required):
        aggs.append(F.bool_or(low == r.lower()).alias(f"r{i}"))
        have = have & F.col(f"r{i}")
    g = headers.groupBy("file_id").agg(
        F.count_if((low != "") & ~low.isin(known) & ~F.col("header").rlike(K.EXEMPT_HEADER_RE)).alias("unknown_headers"), *aggs)
    return g.select("file_id", "unknown_headers", (~have).alias("missing_required"), (~have | (F.col("unknown_headers") >= 3)).alias("needs_mapping"))


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename mapped columns, drop those mapped to the empty text, keep the rest."""
    drop = [h for h, t in mapping.items() if t == "" and h in df.columns]
    return df.drop(*drop).withColumnsRenamed({h: t for h, t in mapping.items() if t})


def mapping_conflicts(mapping: DataFrame) -> DataFrame:
    """Targets that two or more source headers claim."""
    return (
        mapping.filter(F.col("target") != "").groupBy("file_id", "target")
        .agg(F.count(F.lit(1)).alias("sources")).filter("sources > 1"))


def header_fingerprint(headers: DataFrame) -> DataFrame:
    """Sorted lower-case headers joined by ``|``: the key under which a mapping is saved and found again."""
    low = F.lower(jstrim(F.coalesce("header", F.lit(""))))
    return headers.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list(low)), "|").alias("fingerprint"))


def saved_mapping(headers: DataFrame, saved: DataFrame) -> DataFrame:
    """Mappings saved under the same fingerprint: ``saved(fingerprint, header, target)``."""
    return header_fingerprint(headers).join(saved, "fingerprint").select("file_id", "header", "target")


def detect_import_mode(df: DataFrame, headers: DataFrame) -> DataFrame:
    """Per file: mode, confidence and the number of export-signal columns."""
    low = F.lower("header")
    h = headers.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_headers"),
        F.count_distinct(F.when(low.isin(K.EXPORT_SIGNALS), low)).alias("signals"))
    r = df.groupBy("file_id").agg(
        F.bool_or(not_blank(cell(df, "Handle"))).alias("has_handles"), F.bool_or(is_blank(cell(df, "Handle"))).alias("missing_handles"),
        F.bool_or(not_blank(cell(df, "Variant Price"))).alias("has_prices"))
    j = h.join(r, "file_id", "left")
    few = F.col("n_headers") < 10
    new = few & (F.col("missing_handles") | (F.col("has_handles") & F.col("has_prices")))
    mode = F.when(F.col("signals") >= 2, "existing_products").when(new, "new_products")
    conf = F.when(F.col("signals") >= 4, "high").when((F.col("signals") >= 2) | new, "medium").otherwise("low")
    return j.select("file_id", mode.alias("mode"), conf.alias("confidence"), "signals")


def sample_preview(df: DataFrame, rows: int = 3, columns: int = 5, chars: int = 40) -> DataFrame:
    """First rows and columns of each file, cells cut."""
    from pyspark.sql import Window as W

    from gristmill.operators.catalog_rows import data_columns
    cols = data_columns(df)[:columns]
    w = W.partitionBy("file_id").orderBy("row_no")
    top = df.select("file_id", "row_no", *cols).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= rows)
    return top.select("file_id", "row_no", *[F.substring(F.coalesce(c, F.lit("")), 1, chars).alias(c) for c in cols])
