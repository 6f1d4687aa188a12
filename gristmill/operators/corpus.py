"""Document cleaning, cross-document boilerplate removal, statistics and merged outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import lines as L
from gristmill.functions.text import count_words, estimate_tokens
from gristmill.sources.ordered_files import write_ordered


def clean_document(
    df: DataFrame, text: str = "text", rejoin: bool = True, page_numbers: bool = True, headers: bool = True,
    unwrap: bool = True, lists: bool = True, headings: bool = True,
) -> DataFrame:
    """Add ``clean_text``, ``lines_removed`` and ``chars_removed``. Narrow: no shuffle at all."""
    t = F.regexp_replace(F.replace(F.replace(L.strip_control(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"\n{3,}", "\n\n")
    if rejoin:
        t = L.rejoin_hyphens(t)
    out = df.withColumn("_lines", F.split(t, "\n", -1))
    kept = F.col("_lines")
    if page_numbers:
        kept = F.filter(kept, lambda x: ~L.is_page_number(x))
    out = out.withColumn("_kept", kept)
    if headers:
        out = out.withColumn("_kept2", L.drop_repeated(F.col("_kept")))
    else:
        out = out.withColumn("_kept2", F.col("_kept"))
    joined = L.reflow(F.col("_kept2"), lists, headings) if unwrap else F.array_join("_kept2", "\n")
    out = out.withColumn("clean_text", L.tidy_ends(joined))
    return out.withColumns({
        "lines_removed": (F.size("_lines") - F.size("_kept2")).cast("bigint"),
        "chars_removed": F.greatest(F.lit(0), F.length(text) - F.length("clean_text")).cast("bigint"),
    }).drop("_lines", "_kept", "_kept2")


def doc_lines(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, line)."""
    return df.select(doc, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def drop_repeated_lines(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Text without header-like lines that a document repeats three times or more."""
    lines = df.select(doc, F.split(F.col(text), "\n", -1).alias("_l")).withColumn("_k", L.drop_repeated(F.col("_l")))
    return lines.select(doc, F.array_join("_k", "\n").alias(text), (F.size("_l") - F.size("_k")).cast("bigint").alias("lines_removed"))


def cross_doc_lines(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Header-like line shapes shared by two or more documents: every copy but the first overall.

    Returns (doc, line_no, line) of the lines to remove. Only short line keys are shuffled, never documents; a shape
    held by a third of all documents is one partial aggregate per task, and its join side is a single row.
    """
    short = (
        df.select(doc, F.posexplode(F.transform(F.split(F.col(text), "\n", -1), lambda x: F.struct(x.alias("line"), L.ltrim(x).alias("t")))).alias("line_no", "_x"))
        .select(doc, "line_no", "_x.line", "_x.t")
        .filter((F.length("t") > 0) & (F.length("t") <= 100) & F.col("t").rlike("[a-zA-Z]"))
        .select(F.col(doc), "line_no", "line", "t", L.fuzzy_shape("t").alias("shape"))
    )
    first = F.min(F.struct(F.col(doc).alias("doc"), F.col("line_no").alias("line_no"), F.col("t").alias("t"))).alias("first")
    shared = (
        short.groupBy("shape").agg(F.min(doc).alias("_a"), F.max(doc).alias("_b"), first)
        .filter("_a <> _b").filter(L.is_running_header(F.col("first.t"))).select("shape", "first")
    )
    j = short.join(shared, "shape")
    return j.filter((F.col(doc) != F.col("first.doc")) | (F.col("line_no") != F.col("first.line_no"))).select(doc, "line_no", "line")


def strip_cross_doc(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the lines found by ``cross_doc_lines``; rows join on the document key only."""
    gone = cross_doc_lines(df, doc, text).groupBy(doc).agg(F.collect_set("line_no").alias("_gone"))
    j = df.join(gone, doc, "left")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), i))
    return j.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_gone")


def corpus_stats(df: DataFrame, before: str = "text", after: str = "clean_text") -> DataFrame:
    """Totals before and after cleaning, with the share of tokens saved."""
    # generated rows hold both texts and their words, so neither the cleaning nor the counting is repeated for every figure
    df = df.select(F.inline(F.array(F.struct(F.col(before), F.col(after), F.col("lines_removed")))))
    df = df.select("*", F.inline(F.array(F.struct(count_words(before).alias("_before"), count_words(after).alias("_after")))))
    g = df.agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length(before)).alias("chars_before"), F.sum(F.length(after)).alias("chars_after"),
        F.sum("_before").alias("words_before"), F.sum("_after").alias("words_after"),
        F.sum(estimate_tokens(before, F.col("_before"))).alias("tokens_before"), F.sum(estimate_tokens(after, F.col("_after"))).alias("tokens_after"),
        F.sum("lines_removed").alias("lines_removed"))
    saved = F.when(F.col("tokens_before") > 0, F.floor(100 * (1 - F.col("tokens_after") / F.col("tokens_before")) + 0.5)).otherwise(0)
    return g.withColumn("saved_percent", F.greatest(F.lit(0), saved).cast("bigint"))


def markdown_block(name: Column, text: Column) -> Column:
    """One document as Markdown: heading lines ``##``, list items ``-``, paragraphs joined."""
    marked = F.transform(F.transform(F.split(text, "\n", -1), L.ltrim), lambda t: F.struct(
        t.alias("t"), F.when(t == "", "b").when(L.heading_shape(t), "h").when(L.is_list_line(t), "l").otherwise("p").alias("k")))
    def glue(m):
        def one(x, i):
            para_goes_on = F.coalesce(F.get(m, i + 1)["k"] == "p", F.lit(False))
            return (
                F.when(x["k"] == "b", "").when(x["k"] == "h", F.concat(F.lit("## "), x["t"], F.lit("\n\n")))
                .when(x["k"] == "l", F.concat(F.lit("- "), L.strip_marker(x["t"]), F.lit("\n")))
                .when(para_goes_on, F.concat(x["t"], F.lit(" "))).otherwise(F.concat(x["t"], F.lit("\n\n"))))
        return F.array_join(F.transform(m, one), "")
    body = F.get(F.transform(F.array(marked), glue), F.lit(0))
    return L.ltrim(F.regexp_replace(F.concat(F.lit("# "), name, F.lit("\n\n"), body), r"\n{3,}", "\n\n"))


def html_block(name: Column, text: Column) -> Column:
    """One document as an HTML section."""
    def one(b):
        parts = F.split(b, "\n", -1)
        all_list = F.forall(parts, lambda x: (L.ltrim(x) == "") | L.is_list_line(x)) & F.exists(parts, L.is_list_line)
        items = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("  <li>"), L.escape_html(L.strip_marker(x)), F.lit("</li>"))), "\n")
        return (
            F.when(~F.contains(b, F.lit("\n")) & L.is_heading_line(b), F.concat(F.lit("<h2>"), L.escape_html(b), F.lit("</h2>")))
            .when(all_list, F.concat(F.lit("<ul>\n"), items, F.lit("\n</ul>")))
            .otherwise(F.concat(F.lit("<p>"), F.replace(L.escape_html(b), F.lit("\n"), F.lit(" ")), F.lit("</p>"))))
    blocks = F.filter(F.transform(F.split(text, r"\n{2,}", -1), L.ltrim), lambda b: b != "")
    head = F.array(F.concat(F.lit('<section data-document="'), L.escape_html(name), F.lit('">')), F.concat(F.lit("<h1>"), L.escape_html(name), F.lit("</h1>")))
    return F.array_join(F.concat(head, F.transform(blocks, one), F.array(F.lit("</section>"))), "\n")


def plain_block(name: Column, text: Column) -> Column:
    bar = F.lit("=" * 59)
    return F.concat(bar, F.lit("\nDOCUMENT: "), name, F.lit("\n"), bar, F.lit("\n\n"), text)


def merged(df: DataFrame, block, doc: str = "doc_id", name: str = "name", text: str = "text") -> DataFrame:
    """(doc, block). The merged file is these blocks in document order; writing it sorts by range, so the text
    of the whole corpus never meets in one task."""
    return df.select(doc, block(F.col(name), F.col(text)).alias("block"))


#: What stands between two documents of a merged file.
BETWEEN = {"md": "\n\n---\n\n", "html": "\n\n", "txt": "\n\n\n"}


def write_merged(df: DataFrame, path: str, block, extension: str, doc: str = "doc_id", name: str = "name", text: str = "text") -> None:
    """All documents as one merged file in document order, in numbered parts where it outgrows a task."""
    write_ordered(merged(df, block, doc, name, text), path, F.lit("merged"), [doc], F.col("block"), separator=BETWEEN[extension], extension=extension)
