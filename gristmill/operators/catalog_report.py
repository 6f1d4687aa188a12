"""Summaries over findings: verdicts, passed checks, repair plan, impact, row context, result JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import catalog_fields as K
from gristmill.functions.text import is_blank, not_blank
from gristmill.operators.catalog_rows import data_columns
from gristmill.sources.ordered_files import write_ordered


def issues(found: DataFrame) -> DataFrame:
    """One row per issue: hits of the same code and scope belong together."""
    return found.groupBy("file_id", "code", "scope", "severity", "auto_fix").agg(F.count(F.lit(1)).alias("hits"))


def _verdict(critical, warning):
    return (
        F.when(F.col(critical) > 0, F.lit("NOT_READY"))
        .when(F.col(warning) > 0, F.lit("READY_WITH_WARNINGS"))
        .otherwise(F.lit("READY_FOR_REVIEW"))
    )


def severity_summary(found: DataFrame, file_ids: DataFrame | None = None) -> DataFrame:
    """Issue counts per severity and the verdict, per file. ``file_ids`` adds files without findings."""
    g = issues(found).groupBy("file_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])
    if file_ids is not None:
        g = file_ids.select("file_id").distinct().join(g, "file_id", "left").fillna(0, ["critical", "warning", "info"])
    return g.withColumn("status", _verdict("critical", "warning"))


def passed_checks(found: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Rules that found nothing, by name."""
    names = [(code, name) for code, (_, _, name) in K.RULES.items() if name]
    rules = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).alias("check_name")) for c, n in names])
    every = file_ids.select("file_id").distinct().select("file_id", F.inline(rules))
    return every.join(found.select("file_id", "code").distinct(), ["file_id", "code"], "left_anti")


def batch_summary(summary: DataFrame) -> DataFrame:
    """One row per file plus the batch total (``file_id`` null), from ``severity_summary``."""
    g = summary.rollup("file_id").agg(
        F.sum("critical").alias("critical"), F.sum("warning").alias("warning"), F.sum("info").alias("info"),
        F.count(F.lit(1)).alias("files"))
    return g.withColumn("status", _verdict("critical", "warning"))


def repair_plan(found: DataFrame) -> DataFrame:
    """Issues per file by fix class."""
    return issues(found).groupBy("file_id").agg(
        F.count_if(F.col("auto_fix") == "auto").alias("safe"),
        F.count_if(F.col("auto_fix") == "review").alias("review"),
        F.count_if(F.col("auto_fix") == "never").alias("never"),
        F.count(F.lit(1)).alias("total"))


def repair_outcome(found: DataFrame, applied: DataFrame) -> DataFrame:
    """Per issue: fixed automatically, fixed after approval, or still open.

    ``applied(file_id, code)`` lists what ran; ``REMOVE_COLUMN:name`` closes the blank finding of that column.
    """
    plan = issues(found)
    done = applied.select("file_id", F.col("code").alias("applied_code")).distinct()
    key = F.when(F.col("code") == "DESTRUCTIVE_BLANK_INCLUDED_COLUMN", F.concat(F.lit("REMOVE_COLUMN:"), F.col("scope"))).otherwise(F.col("code"))
    j = plan.withColumn("applied_code", key).join(done.withColumn("_ran", F.lit(True)), ["file_id", "applied_code"], "left")
    state = (
        F.when(F.col("_ran").isNull(), F.lit("open"))
        .when(F.col("auto_fix") == "auto", F.lit("fixed"))
        .otherwise(F.lit("approved"))
    )
    return j.select("file_id", "code", "scope", "auto_fix", state.alias("outcome"), "hits")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("file_id", "reason").agg(F.count(F.lit(1)).alias("changes"))


def catalog_impact(df: DataFrame) -> DataFrame:
    """Per file: products, products with several prices or quantities, blank sensitive cells."""
    price = F.when(not_blank("Variant Price"), F.col("Variant Price"))
    qty = F.when(not_blank("Variant Inventory Qty"), F.col("Variant Inventory Qty"))
    blanks = sum((is_blank(n).cast("int") for n in K.SENSITIVE if n in df.columns), F.lit(0))
    # one pass: blank counts ride along the per-handle aggregate, blank handles form their own group
    g = df.groupBy("file_id", F.when(not_blank("Handle"), F.col("Handle")).alias("h")).agg(
        F.min(price).alias("p0"), F.max(price).alias("p1"), F.min(qty).alias("q0"), F.max(qty).alias("q1"),
        F.sum(blanks).alias("blanks"))
    keyed = F.col("h").isNotNull()
    return g.groupBy("file_id").agg(
        F.count_if(keyed).alias("matching_handles"),
        F.count_if(keyed & (F.col("p0") != F.col("p1"))).alias("changed_prices"),
        F.count_if(keyed & (F.col("q0") != F.col("q1"))).alias("changed_inventory"),
        F.sum("blanks").alias("blank_included_values"))


def write_issues_table(found: DataFrame, texts: int = 20) -> DataFrame:
    """Issue list for export: severity, code, and the first row numbers joined by a space.

    Rows are ranked before they are collected, so an issue with millions of hits collects only a few.
    """
    w = W.partitionBy("file_id", "code", "scope").orderBy("row_no")
    top = found.select("file_id", "code", "scope", "severity", "row_no").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= texts)
    return top.groupBy("file_id", "severity", "code", "scope").agg(
        F.array_join(F.array_sort(F.collect_list("row_no")).cast("array<string>"), " ").alias("first_rows"))


def issue_row_context(found: DataFrame, df: DataFrame, context: int = 2, cap: int = 10, spans: int = 3, span_rows: int = 15) -> DataFrame:
    """Rows around the first affected rows of each issue; touching spans merge."""
    key = ["file_id", "code", "scope"]
    w = W.partitionBy(*key).orderBy("row_no")
    hits = found.filter(F.col("row_no").isNotNull()).select(*key, "row_no").distinct()
    hits = hits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    # a hit joins the running span when it lies at most one row past the span's end (previous hit + context)
    new = F.coalesce(F.col("row_no") - (F.lag("row_no").over(w) + context) > 1, F.lit(True))
    isl = hits.withColumn("span", F.sum(new.cast("int")).over(w)).filter(F.col("span") <= spans)
    agg = isl.groupBy(*key, "span").agg(
        F.greatest(F.lit(2), F.min("row_no") - context).alias("a"), (F.max("row_no") + context).alias("b"),
        F.collect_set("row_no").alias("targets"))
    # each span covers at most cap * (2 * context + 1) rows, so it can be spelled out and equi-joined
    rows = agg.select(*key, "span", "targets", F.explode(F.sequence("a", F.least("b", F.col("a") + span_rows - 1))).alias("row_no"))
    rows = rows.select(*key, "span", "row_no", F.array_contains("targets", F.col("row_no")).alias("is_target"))
    return rows.join(df.select("file_id", "row_no", "Handle", "Title"), ["file_id", "row_no"])


def result_json(found: DataFrame, df: DataFrame, mode: str) -> DataFrame:
    """One JSON document per file: status, summary counts, issues, passed checks, impact."""
    ids = df.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows_scanned"))
    summary = severity_summary(found, ids)
    ok = passed_checks(found, ids).groupBy("file_id").agg(F.array_sort(F.collect_list("check_name")).alias("passed_checks"))
    listed = write_issues_table(found, 10).groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("code", "scope", "severity", "first_rows"))).alias("issues"))
    out = ids.join(summary, "file_id").join(ok, "file_id", "left").join(listed, "file_id", "left").join(catalog_impact(df), "file_id", "left")
    doc = F.struct(
        "status", F.lit(mode).alias("mode"),
        F.struct("critical", F.col("warning").alias("warnings"), "info", F.coalesce(F.size("passed_checks"), F.lit(0)).alias("passed"),
                 "rows_scanned", F.lit(len(data_columns(df))).alias("columns_detected")).alias("summary"),
        "issues", "passed_checks",
        F.struct("matching_handles", "changed_prices", "changed_inventory", "blank_included_values").alias("potential_impact"))
    return out.select("file_id", F.to_json(doc).alias("result"))


def write_results(results: DataFrame, path: str) -> None:
    """The JSON documents of ``result_json``, one file each."""
    write_ordered(results, path, F.col("file_id"), ["file_id"], F.col("result"), extension="json")
