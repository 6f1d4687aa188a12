"""Row kinds of a product catalog and the row-order findings built on them.

A catalog is a DataFrame with ``file_id``, ``row_no`` (position + 2, unique per file) and string columns.
Everything keyed by handle is an aggregate joined back on the *row number*, not a window over the handle:
a handle that holds a third of all rows then costs a map-side combine instead of one huge sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import is_blank, jstrim, not_blank, or_text
from gristmill.operators.ordered import previous_value

META = ("file_id", "row_no", "extra")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META and not c.startswith("_")]


def cell(df: DataFrame, name: str) -> Column:
    """The column, or a null text when the file does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def is_sellable(df: DataFrame) -> Column:
    return not_blank(cell(df, "Variant SKU")) | not_blank(cell(df, "Variant Price")) | not_blank(cell(df, "Option1 Value"))


def is_image_row(df: DataFrame) -> Column:
    """Keyed row with an image, no title and nothing to sell. Needs no other row."""
    return (
        not_blank(cell(df, "Handle")) & ~is_sellable(df)
        & not_blank(cell(df, "Image Src")) & is_blank(cell(df, "Title"))
    )


def is_bare_image_row(df: DataFrame) -> Column:
    """Same test without asking for a handle."""
    return ~is_sellable(df) & not_blank(cell(df, "Image Src")) & is_blank(cell(df, "Title"))


def is_lone_image(df: DataFrame) -> Column:
    """Keyed row with an image and neither SKU, price nor title."""
    return (
        not_blank(cell(df, "Handle")) & not_blank(cell(df, "Image Src")) & is_blank(cell(df, "Variant SKU"))
        & is_blank(cell(df, "Variant Price")) & is_blank(cell(df, "Title"))
    )


def classify_rows(df: DataFrame) -> DataFrame:
    """Add ``is_image``, ``is_primary`` and ``is_variant``."""
    keyed, sellable, titled = not_blank(cell(df, "Handle")), is_sellable(df), not_blank(cell(df, "Title"))
    marked = df.withColumn("is_image", is_image_row(df))
    lead = keyed & (sellable | (titled & ~F.col("is_image")))
    primaries = (
        marked.filter(lead).groupBy("file_id", "Handle").agg(F.min("row_no").alias("row_no"))
        .select("file_id", "row_no", F.lit(True).alias("_primary"))
    )
    out = marked.join(primaries, ["file_id", "row_no"], "left")
    out = out.withColumn("is_primary", F.coalesce("_primary", F.lit(False))).drop("_primary")
    variant = keyed & ~F.col("is_image") & (sellable | ~titled | ~F.col("is_primary"))
    return out.withColumn("is_variant", variant)


def image_parents(df: DataFrame) -> DataFrame:
    """Per handle that has image rows: the parent row and the number of variant and image rows."""
    keyed = df.filter(not_blank("Handle"))
    sell, img = is_sellable(df), is_image_row(df)
    return (
        keyed.groupBy("file_id", F.col("Handle").alias("handle"))
        .agg(
            F.coalesce(F.min(F.when(sell, F.col("row_no"))), F.min("row_no")).alias("parent_row"),
            F.count_if(sell).alias("variant_rows"),
            F.count_if(img).alias("image_rows"),
        )
        .filter(F.col("image_rows") > 0)
    )


def dup_image_rows(df: DataFrame) -> DataFrame:
    """Image-only rows that repeat the image of an earlier image-only row of the same handle."""
    rows = df.filter(is_lone_image(df)).select("file_id", "row_no", F.col("Handle").alias("handle"), jstrim("Image Src").alias("url"))
    first = rows.groupBy("file_id", "handle", "url").agg(
        F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("_n")
    ).filter("_n > 1").drop("_n")
    return rows.join(first, ["file_id", "handle", "url"]).filter("row_no > first_row")


def row_signature(df: DataFrame) -> Column:
    """256-bit digest of all trimmed cells; the shuffle then moves 32 bytes per row, not the row."""
    cells = [F.coalesce(jstrim(c), F.lit("")) for c in data_columns(df)]
    return F.sha2(F.concat_ws("\u0001", *cells), 256)


def any_cell(df: DataFrame) -> Column:
    found = F.lit(False)
    for c in data_columns(df):
        found = found | not_blank(c)
    return found


def dup_identical_rows(df: DataFrame) -> DataFrame:
    """Rows whose trimmed cells all equal those of an earlier row, with that row's number."""
    sigs = df.filter(any_cell(df)).select(
        "file_id", "row_no", or_text(cell(df, "Handle"), "(no handle)").alias("handle"),
        or_text(cell(df, "Title"), "(no title)").alias("title"), row_signature(df).alias("_sig"),
    )
    first = sigs.groupBy("file_id", "_sig").agg(
        F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("_n")
    ).filter("_n > 1").drop("_n")
    return sigs.join(first, ["file_id", "_sig"]).filter("row_no > first_row").drop("_sig")


def scattered_handles(df: DataFrame) -> DataFrame:
    """Rows where a handle comes back after another handle."""
    rows = df.filter(not_blank("Handle")).select("file_id", "row_no", F.col("Handle").alias("handle"))
    prev = previous_value(rows, ["file_id"], "row_no", "handle", "prev_handle")
    moved = prev.filter(F.col("prev_handle") != F.col("handle"))
    first = rows.groupBy("file_id", "handle").agg(F.min("row_no").alias("first_row"))
    return moved.join(first, ["file_id", "handle"]).filter("row_no > first_row")


def drop_identical(df: DataFrame) -> DataFrame:
    """Keep the first of each set of identical rows; wholly blank rows are left alone."""
    gone = dup_identical_rows(df).select("file_id", "row_no")
    return df.join(gone, ["file_id", "row_no"], "left_anti")
