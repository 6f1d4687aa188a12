"""Catalog repairs as column expressions with a change log.

``repair`` carries two helper columns through the plan: ``_log`` (array of change entries of this row) and
``_gone`` (row dropped). Every step only rewrites columns, so a chain of row-local repairs is one projection
over one scan, and both outputs (corrected rows, change log) come from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import catalog_fields as K
from gristmill.functions import prices as P
from gristmill.functions.text import is_blank, jstrim, let, not_blank, or_text, slug
from gristmill.operators import catalog_rows as R
from gristmill.operators.catalog_rules import Rule, html_open_tags
from gristmill.operators.ordered import running_count
from gristmill.session import cut_lineage

ENTRY = "array<struct<column_name:string,before:string,after:string,reason:string,code:string>>"
AUTO = ["SMART_QUOTES_DETECTED", "CELL_WHITESPACE", "PRICE_CURRENCY_SYMBOL", "BOOLEAN_FORMAT", "HANDLE_FORMAT_INVALID", "DUPLICATE_IMAGE_ROWS"]


def start(df: DataFrame) -> DataFrame:
    return df.withColumn("_log", F.array().cast(ENTRY)).withColumn("_gone", F.lit(False))


def _entry(column: str, before, after, reason: str, code: str) -> Column:
    return F.struct(
        F.lit(column).alias("column_name"), before.alias("before"), after.alias("after"),
        F.lit(reason).alias("reason"), F.lit(code).alias("code"))


def _apply(df: DataFrame, fixes: dict[str, tuple[Column, Column]], reason: str, code: str, before=None, after=None) -> DataFrame:
    """``fixes``: column -> (condition, new value). Logs every cell the condition selects."""
    fixes = {n: (cond & ~F.col("_gone"), new) for n, (cond, new) in fixes.items() if n in df.columns}
    if not fixes:
        return df
    b = before or (lambda n: F.col(n))
    a = after or (lambda n, new: new)
    entries = F.array_compact(F.array(*[F.when(cond, _entry(n, b(n), a(n, new), reason, code)) for n, (cond, new) in fixes.items()]))
    new_cols = {n: F.when(cond, new).otherwise(F.col(n)) for n, (cond, new) in fixes.items()}
    return df.withColumns({"_log": F.concat("_log", entries.cast(ENTRY)), **new_cols})


def straight_quotes(c) -> Column:
    c = F.regexp_replace(c, r"[\x{2018}-\x{201B}]", "'")
    c = F.regexp_replace(c, r"[\x{201C}-\x{201F}\x{AB}\x{2039}\x{BB}\x{203A}]", '"')
    c = F.regexp_replace(c, r"[\x{2013}\x{2014}]", "-")
    return F.regexp_replace(c, r"\x{2026}", "...")


def fix_smart_quotes(df: DataFrame) -> DataFrame:
    return _apply(
        df, {n: (F.col(n).rlike(K.SMART_CHARS_RE), straight_quotes(F.col(n))) for n in R.data_columns(df)},
        "Replaced smart quotes", "SMART_QUOTES_DETECTED",
        before=lambda n: F.substring(n, 1, 80), after=lambda n, new: F.substring(new, 1, 80))


def fix_whitespace(df: DataFrame) -> DataFrame:
    return _apply(
        df, {n: (not_blank(n) & (F.col(n) != jstrim(n)), jstrim(n)) for n in K.WHITESPACE_COLUMNS if n in df.columns},
        "Trimmed whitespace", "CELL_WHITESPACE")


def fix_currency(df: DataFrame) -> DataFrame:
    return _apply(
        df, {n: (P.price_has_currency(n), P.strip_currency(n)) for n in K.CURRENCY_COLUMNS if n in df.columns},
        "Stripped currency symbol", "PRICE_CURRENCY_SYMBOL")


def fix_booleans(df: DataFrame) -> DataFrame:
    fix = {}
    for n in K.BOOLEAN_COLUMNS:
        if n in df.columns:
            norm = P.bool_norm(n)
            fix[n] = (norm.isNotNull() & (norm != jstrim(n)), norm)
    return _apply(df, fix, "Normalized boolean value", "BOOLEAN_FORMAT")


def fix_handles(df: DataFrame) -> DataFrame:
    h = F.col("Handle")
    new = slug(h)
    return _apply(df, {"Handle": (not_blank(h) & ~h.rlike(K.HANDLE_RE) & (new != "") & (new != h), new)}, "Normalized handle format", "HANDLE_FORMAT_INVALID")


def _drop_rows(df: DataFrame, gone: DataFrame, column: str, before: Column, reason: str, code: str) -> DataFrame:
    marked = df.join(gone.select("file_id", "row_no", F.lit(True).alias("_hit")), ["file_id", "row_no"], "left")
    hit = F.coalesce("_hit", F.lit(False)) & ~F.col("_gone")
    entry = F.when(hit, F.array(_entry(column, before, F.lit("(row removed)"), reason, code))).otherwise(F.array()).cast(ENTRY)
    return marked.withColumns({"_log": F.concat("_log", entry), "_gone": F.col("_gone") | hit}).drop("_hit")


def fix_dup_images(df: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """Duplicates are found on the rows as read, before any other repair."""
    if "Image Src" not in df.columns:
        return df
    gone = R.dup_image_rows(original if original is not None else df)
    return _drop_rows(df, gone, "Image Src", F.coalesce("Image Src", F.lit("")), "Removed duplicate image row", "DUPLICATE_IMAGE_ROWS")


def fix_missing_handles(df: DataFrame) -> DataFrame:
    if "Title" not in df.columns:
        return df
    if "Handle" not in df.columns:
        df = df.withColumn("Handle", F.lit(""))
    return _apply(
        df, {"Handle": (is_blank("Handle") & not_blank("Title"), slug("Title"))}, "Generated from Title", "HANDLE_MISSING_NEW",
        before=lambda n: or_text(F.col(n), "(empty)"))


def fix_https(df: DataFrame) -> DataFrame:
    http = F.col("Image Src").rlike("(?i)^http://") if "Image Src" in df.columns else F.lit(False)
    return _apply(df, {"Image Src": (http, F.regexp_replace("Image Src", "(?i)^http://", "https://"))} if "Image Src" in df.columns else {}, "Upgraded to HTTPS", "IMAGE_URL_NOT_HTTPS")


# Opening tag -> closing tags that are taken as a slip for it.
_SLIPS = [("p", "div"), ("p", "span"), ("b", "i"), ("i", "b"), ("strong", "em"), ("em", "strong")]
# a closing tag of these names that no tag follows which opens the name again
_STRAY = r"(?i)</(div|span|p|b|i|strong|em)>(?![^<]*<\1>)"


def mend_html(body) -> Column:
    """Slips of closing tags put right, stray closing tags taken out, and tags left open closed at the end."""
    t = F.col(body) if isinstance(body, str) else body
    for opened, closed in _SLIPS:
        t = F.regexp_replace(t, rf"(?i)<{opened}>([\s\S]*?)</{closed}>", f"<{opened}>$1</{opened}>")
    t = F.regexp_replace(t, _STRAY, "")
    return let(t, lambda x: F.concat(x, F.array_join(F.transform(F.reverse(html_open_tags(x)), lambda n: F.concat(F.lit("</"), n, F.lit(">"))), "")))


def fix_html(df: DataFrame) -> DataFrame:
    if "Body (HTML)" not in df.columns:
        return df
    df = df.withColumn("_mended", mend_html("Body (HTML)"))
    cond = not_blank("Body (HTML)") & (F.col("_mended") != F.col("Body (HTML)"))
    return _apply(df, {"Body (HTML)": (cond, F.col("_mended"))}, "Repaired unclosed HTML tags", "HTML_UNCLOSED_TAG").drop("_mended")


def fix_decimal_comma(df: DataFrame) -> DataFrame:
    fix = {}
    for n in K.PRICE_COLUMNS:
        if n in df.columns:
            fix[n] = (not_blank(n) & P.price_is_comma_decimal(n) & P.price_value(n).isNotNull(), P.number_text(P.price_value(n)))
    return _apply(df, fix, "Converted comma decimal to dot", "PRICE_DECIMAL_COMMA")


def _handle_counts(df: DataFrame) -> DataFrame:
    sell = R.is_sellable(df)
    return (
        df.filter(~F.col("_gone") & not_blank("Handle")).groupBy("file_id", "Handle")
        .agg(F.count_if(sell).alias("_sell"), F.count_if(R.is_image_row(df)).alias("_img"), F.min(F.when(sell, F.col("row_no"))).alias("_parent")))


def fix_image_rows(df: DataFrame) -> DataFrame:
    """Clear stray cells on image rows of handles that have a variant."""
    sold = _handle_counts(df).filter("_sell > 0 and _img > 0").select("file_id", "Handle", F.lit(True).alias("_sold"))
    j = df.join(sold, ["file_id", "Handle"], "left")
    hit = F.coalesce("_sold", F.lit(False)) & R.is_image_row(df)
    j = j.withColumn("_hit", hit)
    out = _apply(
        j, {n: (F.col("_hit") & not_blank(n), F.lit("")) for n in K.IMAGE_ROW_CLEAR if n in df.columns},
        "Cleared stray data from image row", "IMAGE_ROW_VARIANT_DATA",
        before=lambda n: F.substring(n, 1, 60), after=lambda n, new: F.lit("(cleared)"))
    return out.drop("_sold", "_hit")


def fix_single_variant(df: DataFrame) -> DataFrame:
    parents = _handle_counts(df).filter("_sell = 1 and _img > 0").select("file_id", F.col("_parent").alias("row_no"), F.lit(True).alias("_only"))
    j = df.join(parents, ["file_id", "row_no"], "left")
    hit = F.coalesce("_only", F.lit(False)) & is_blank(R.cell(df, "Option1 Name")) & is_blank(R.cell(df, "Option1 Value"))
    j = j.withColumn("_hit", hit)
    out = _apply(
        j, {"Option1 Name": (F.col("_hit"), F.lit("Title")), "Option1 Value": (F.col("_hit"), F.lit("Default Title"))},
        "Set default option for single-variant product", "SINGLE_VARIANT_MULTIPLE_IMAGES", before=lambda n: F.lit("(blank)"))
    return out.drop("_only", "_hit")


def fix_missing_qty(df: DataFrame) -> DataFrame:
    if "Variant Inventory Qty" not in df.columns:
        return df
    cond = ~R.is_bare_image_row(df) & not_blank(R.cell(df, "Variant Inventory Tracker")) & is_blank("Variant Inventory Qty")
    return _apply(df, {"Variant Inventory Qty": (cond, F.lit("0"))}, "Set missing quantity to 0", "INVENTORY_QTY_MISSING_WITH_TRACKER", before=lambda n: F.lit("(blank)"))


def unique_sku_suffix(df: DataFrame) -> DataFrame:
    """(file_id, row_no, sku, new_sku): later uses of a SKU get ``-2``, ``-3``, ... skipping taken names.

    The j-th use of a SKU takes suffix j unless some row was *read* with such a suffixed name. Rank is a chunked
    running count, so a SKU on a third of all rows is fine. Only families where a read name equals
    ``<repeated sku>-<digits>`` can collide; those are replayed in row order, one family at a time.
    """
    rows = df.filter(not_blank("Variant SKU")).select("file_id", "row_no", jstrim("Variant SKU").alias("sku"))
    ranked = running_count(rows, ["file_id", "sku"], "row_no", "use")
    names = rows.groupBy("file_id", "sku").agg(F.count(F.lit(1)).alias("n"))
    root = F.regexp_replace("sku", r"(-\d+)+$", "")
    repeated = names.filter("n > 1").select("file_id", F.col("sku").alias("base"))
    clash = (
        names.filter(F.col("sku").rlike(r"-\d+$"))
        .select("file_id", F.regexp_replace("sku", r"-\d+$", "").alias("base"), root.alias("root"))
        .join(repeated, ["file_id", "base"], "left_semi")
        .select("file_id", "root").distinct()
    )
    ranked = ranked.withColumn("root", root)
    plain = ranked.join(clash, ["file_id", "root"], "left_anti").select(
        "file_id", "row_no", "sku",
        F.when(F.col("use") == 1, F.col("sku")).otherwise(F.concat("sku", F.lit("-"), F.col("use").cast("string"))).alias("new_sku"))

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, taken, following = None, set(), {}
        for pdf in batches:
            out = []
            for file, root, sku in zip(pdf["file_id"], pdf["root"], pdf["sku"]):
                if (file, root) != family:
                    family, taken, following = (file, root), set(), {}
                name, n = sku, following.get(sku, 2)
                if sku in taken:
                    while f"{sku}-{n}" in taken:
                        n += 1
                    name = f"{sku}-{n}"
                    following[sku] = n + 1
                taken.add(name)
                out.append(name)
            yield pdf[["file_id", "row_no", "sku"]].assign(new_sku=out)

    # the families stand together in sorted partitions and are streamed; a call for each would cost more than its rows
    family = ranked.join(clash, ["file_id", "root"], "left_semi").select("file_id", "root", "row_no", "sku")
    clashing = family.repartition("file_id", "root").sortWithinPartitions("file_id", "root", "row_no").mapInPandas(
        replay, "file_id string, row_no bigint, sku string, new_sku string")
    return plain.unionByName(clashing)


def fix_duplicate_skus(df: DataFrame) -> DataFrame:
    if "Variant SKU" not in df.columns:
        return df
    new = unique_sku_suffix(df.filter(~F.col("_gone"))).filter("new_sku <> sku").select("file_id", "row_no", "new_sku")
    j = df.join(new, ["file_id", "row_no"], "left")
    out = _apply(
        j, {"Variant SKU": (F.col("new_sku").isNotNull(), F.col("new_sku"))}, "Suffixed to make unique", "SKU_DUPLICATE_IN_FILE",
        before=lambda n: jstrim(n))
    return out.drop("new_sku")


def fix_identical_rows(df: DataFrame) -> DataFrame:
    live = df.filter(~F.col("_gone"))
    gone = R.dup_identical_rows(live)
    return _drop_rows(df, gone, "(row)", or_text(R.cell(df, "Handle"), "(no handle)"), "Removed identical duplicate row", "DUPLICATE_IDENTICAL_ROWS")


# order matters: approved repairs run in this sequence after the automatic ones
REVIEWED = {
    "HANDLE_MISSING_NEW": fix_missing_handles, "IMAGE_URL_NOT_HTTPS": fix_https, "HTML_UNCLOSED_TAG": fix_html,
    "PRICE_DECIMAL_COMMA": fix_decimal_comma, "IMAGE_ROW_VARIANT_DATA": fix_image_rows,
    "SINGLE_VARIANT_MULTIPLE_IMAGES": fix_single_variant, "INVENTORY_QTY_MISSING_WITH_TRACKER": fix_missing_qty,
    "SKU_DUPLICATE_IN_FILE": fix_duplicate_skus, "DUPLICATE_IDENTICAL_ROWS": fix_identical_rows,
}
KEYED = {"IMAGE_ROW_VARIANT_DATA", "SINGLE_VARIANT_MULTIPLE_IMAGES", "SKU_DUPLICATE_IN_FILE", "DUPLICATE_IDENTICAL_ROWS"}
AUTOMATIC = {
    "SMART_QUOTES_DETECTED": fix_smart_quotes, "CELL_WHITESPACE": fix_whitespace, "PRICE_CURRENCY_SYMBOL": fix_currency,
    "BOOLEAN_FORMAT": fix_booleans, "HANDLE_FORMAT_INVALID": fix_handles,
}


def rewrite(df: DataFrame, code: str, reason: str, cells: dict[str, tuple[Column, Column]]) -> DataFrame:
    """The repair of a rule that rewrites cells: column -> (condition, new value), each selected cell logged."""
    return _apply(df, cells, reason, code)


def repair(df: DataFrame, approved: list[str] = (), automatic: bool = True, extra_rules: list[Rule] = ()) -> DataFrame:
    """All rows after repair, with ``_log`` and ``_gone``. Use ``corrected`` and ``changes`` on the result.

    The repairs of ``extra_rules`` run after the built-in ones of their class.
    """
    # dealt out before the work on the cells, not after it, since a catalog may come from few tasks; the first join needs this deal
    df = df.repartition("file_id", "row_no") if automatic else df
    out = start(df)
    if automatic:
        for fix in AUTOMATIC.values():
            out = fix(out)
        out = fix_dup_images(out, df)
        for rule in extra_rules:
            out = rule.repair(out) if rule.repair and rule.auto_fix == "auto" else out
    keyed = 0
    for code, fix in REVIEWED.items():
        if code in approved:
            if code in KEYED:
                # a keyed repair reads its input twice; without a cut the plan would double at every step
                out = cut_lineage(out) if keyed else out
                keyed += 1
            out = fix(out)
    for rule in extra_rules:
        out = rule.repair(out) if rule.repair and rule.auto_fix != "auto" and rule.code in approved else out
    return out


def corrected(repaired: DataFrame) -> DataFrame:
    return repaired.filter(~F.col("_gone")).drop("_log", "_gone")


def changes(repaired: DataFrame) -> DataFrame:
    """Change log: one row per changed cell or removed row, with the original row number."""
    return repaired.select("file_id", "row_no", F.inline("_log"))


def blank_columns_to_drop(found: DataFrame) -> DataFrame:
    """Columns without any value, per file: (file_id, column_name), with their log texts."""
    return found.filter(F.col("code") == "DESTRUCTIVE_BLANK_ALL_ROWS").select(
        "file_id", "column_name", F.lit("(present)").alias("before"), F.lit("(removed)").alias("after"),
        F.lit("Entirely blank column").alias("reason"))


def remove_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop approved columns; runs last so that other repairs still see them."""
    return df.drop(*columns)


def blank_out(df: DataFrame, per_file: DataFrame) -> DataFrame:
    """Batch form of column removal: (file_id, column_name) pairs become null in their own file only.

    Writing files with different headers happens in the sink; inside one DataFrame a removed column is null.
    """
    marks = per_file.groupBy("file_id").agg(F.collect_set("column_name").alias("_drop"))
    j = df.join(marks, "file_id", "left")
    cols = {n: F.when(F.array_contains(F.coalesce("_drop", F.array().cast("array<string>")), n), None).otherwise(F.col(n)) for n in R.data_columns(df)}
    return j.withColumns(cols).drop("_drop")
