"""Feed and search payloads, JSON repair and structured-data pruning."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gristmill.functions.text import col_of
from gristmill.session import byte_batches

# Element names that carry each item field.
DESC_NAMES, DATE_NAMES = ("description", "summary", "content"), ("pubDate", "date", "published", "updated")

#: Items that a task holds at a time.
ITEMS = 1000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _item(node) -> dict[str, str]:
    out = {"title": "", "link": "", "description": "", "pub_text": ""}
    for c in node:
        if not isinstance(c.tag, str):
            continue
        name, text = _local(c.tag), "".join(c.itertext()).strip()
        if name == "title":
            out["title"] = out["title"] or text
        elif name == "link":
            href = c.get("href", "")
            if href and c.get("rel", "") in ("", "alternate"):
                out["link"] = href
            elif not out["link"]:
                out["link"] = text
        elif name in DESC_NAMES:
            out["description"] = out["description"] or text
        elif name in DATE_NAMES:
            out["pub_text"] = out["pub_text"] or text
    return out


def feed_scan(payloads: DataFrame) -> DataFrame:
    """``payloads(feed, body)`` -> (feed, pos, title, link, description, pub_date). RSS 2.0, RSS 1.0 and Atom.

    One payload is one document, parsed inside its Arrow batch; malformed XML gives no items. All items of a payload are
    returned; ``per_feed_cap`` keeps the first ones where that is wanted.
    """
    def items(pdf: pd.DataFrame) -> Iterator[tuple]:
        for feed, body in zip(pdf["feed"], pdf["body"]):
            try:
                root = ET.fromstring(body)
            except (ET.ParseError, TypeError, ValueError):
                continue
            found = (_item(n) for n in root.iter() if isinstance(n.tag, str) and _local(n.tag) in ("item", "entry"))
            good = (i for i in found if i["title"] and re.match(r"https?://", i["link"], re.I))
            for pos, i in enumerate(good):
                yield feed, pos, i["title"], i["link"], i["description"], i["pub_text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = items(batch)
            while part := list(islice(rows, ITEMS)):
                yield pd.DataFrame(part, columns=["feed", "pos", "title", "link", "description", "pub_text"])

    byte_batches(payloads.sparkSession)
    out = payloads.select("feed", "body").mapInPandas(run, "feed string, pos int, title string, link string, description string, pub_text string")
    zoned = F.regexp_replace("pub_text", r"\s*(GMT|UTC|UT|Z)$", " +0000")
    when = F.coalesce(
        F.try_to_timestamp("pub_text"), F.try_to_timestamp(F.regexp_replace(zoned, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
    return out.withColumn("pub_date", when).drop("pub_text")


def search_json_scan(payloads: DataFrame) -> DataFrame:
    """``payloads(query, body)`` with ``articles[]`` -> (query, title, link, author, pub_date); rows need title and address."""
    schema = "struct<articles:array<struct<title:string,url:string,seendate:string,domain:string>>>"
    j = payloads.select("query", F.from_json("body", schema).alias("j")).select("query", F.inline("j.articles"))
    ok = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    return j.filter(ok).select("query", "title", F.col("url").alias("link"), F.coalesce("domain", F.lit("search")).alias("author"),
                               F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("pub_date"))


def feed_registry(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """Outlet dimension (id, name, access, url); access is open, metered or paywalled. The list is a table argument."""
    return spark.createDataFrame(rows, "feed string, name string, access string, url string")


# ---- JSON -----------------------------------------------------------------------------------------------------------
def json_core(text) -> Column:
    """Text between the first ``{`` and the last ``}``, code fences removed."""
    t = F.regexp_replace(col_of(text), r"(?i)```(?:json)?", "")
    return F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))


def json_repair_parse(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Add ``parsed`` (null when hopeless) and ``repaired``.

    Raw control characters inside strings are accepted by the reader's own option. Trailing commas are removed only
    from texts that do not parse as they are.
    """
    valid = lambda c: F.get_json_object(c, "$").isNotNull()
    core = df.withColumn("_core", json_core(text))
    ok = F.coalesce(valid(F.col("_core")), F.lit(False))
    core = core.withColumn("_ok", ok).withColumn("_fix", F.when(F.col("_ok"), F.col("_core")).otherwise(F.regexp_replace("_core", r",\s*([}\]])", "$1")))
    read = F.from_json("_fix", schema, {"allowUnquotedControlChars": "true"})
    good = F.coalesce(valid(F.col("_fix")), F.lit(False))
    return core.withColumns({"parsed": F.when(good, read), "repaired": good & ~F.col("_ok")}).drop("_core", "_ok", "_fix")


def _prune(v):
    """Without breadcrumb nodes and properties; nulls and emptied containers go too."""
    empty = lambda x: x is None or x == [] or x == {}
    if isinstance(v, list):
        return [p for p in map(_prune, v) if not empty(p)]
    if isinstance(v, dict):
        if v.get("@type") == "BreadcrumbList":
            return None
        pairs = {k: _prune(x) for k, x in v.items() if k != "breadcrumb"}
        return {k: x for k, x in pairs.items() if not empty(x)}
    return v


@F.pandas_udf(StringType())
def strip_breadcrumb_nodes(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON-LD text without any ``BreadcrumbList`` node or ``breadcrumb`` property, at any depth."""
    def one(t):
        try:
            return json.dumps(_prune(json.loads(t)), ensure_ascii=False)
        except (TypeError, ValueError):
            return t
    for part in s:
        yield part.map(one)


# ---- documents ------------------------------------------------------------------------------------------------------
def doc_kind(name) -> Column:
    """html, md, txt or csv by file name; null when the kind is not supported."""
    ext = F.lower(F.regexp_extract(col_of(name), r"\.([A-Za-z]+)$", 1))
    return (
        F.when(ext.isin("html", "htm", "xhtml"), "html").when(ext.isin("md", "markdown"), "md").when(ext.isin("txt", "text"), "txt").when(ext == "csv", "csv"))


def doc_scan(spark: SparkSession, path: str) -> DataFrame:
    """Corpus files of a folder: (name, kind, text); unsupported kinds are left out."""
    df = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
    return df.withColumn("kind", doc_kind("name")).filter("kind is not null").select("name", "kind", "text")
