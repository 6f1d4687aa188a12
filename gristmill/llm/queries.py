"""The registered queries of this subpackage, one for each operator, and the SQL that some are compared with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut
from gristmill.llm import alignment, embed_dedup, html_extract, licenses, mixing, ngram_join, oracles, pieces, pii, quality, resampling, tiling, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def five_two_one() -> Column:
    """Weights 5, 2, 1, repeating, of the sources by rank."""
    return F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (F.col("rank") - 1) % 3 + 1)


@query("op1_source_mix", oracles.SOURCE_MIX)
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes from each: 150 % of all words, no source more than twice."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"), five_two_one())
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with the weights learned from a sample of the pages that mark their content."""
    pages = read(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query("op6_license_scan", oracles.license_scan(licenses.TEMPLATES))
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and paragraphs of all documents that are licence notices."""
    return licenses.scan(read(spark, sf_dir, "documents"))


@query("op7_embedding_near_dedup", oracles.EMBEDDINGS)
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector: equal label, cosine of at least 0.98."""
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@query("op8_ngram_join", oracles.NGRAM_JOIN)
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word n-grams, Jaccard similarity of at least 0.8."""
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; the rows of the held-out fold are never learned from."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: Entries (host, path, verdict) of the registered query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op3_url_filter", oracles.URL_FILTER)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by the longest entry that fits."""
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 60 % of the words of a benchmark item in tiles of five words or more."""
    return tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The spans of each text and their digest; the counts and ``base_sha256`` are those of the base spans."""
    found = cut(pii.candidates(docs.select("doc_id", "text")).drop("text"))
    out = pii.decide(found, pii.fit(found))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = pii.as_text(F.col("base"))
    return out.select("doc_id", count("email"), count("ip"), count("card"), count("phone"), F.sha2(base, 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"), base.alias("base_text"))


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return pii_digest(read(spark, sf_dir, "documents"))


#: An archive made from the pages: a response of each, revisits of some a day later and an hour before, second responses.
ARCHIVE_SQL = {
    "record_id": "page_id * 4 + k",
    "url": "CASE k WHEN 1 THEN concat(url, '#again') WHEN 2 THEN replace(url, '://', '://WWW.') WHEN 3 THEN concat(url, '?utm_medium=m') ELSE url END",
    "seconds": "1700000000 + (page_id * 7919 % 100000) * 60 + CASE k WHEN 1 THEN 86400 WHEN 2 THEN -3600 WHEN 3 THEN 43200 ELSE 0 END",
    "kind": "CASE WHEN k IN (1, 2) THEN 'revisit' ELSE 'response' END",
    "etag": "CASE WHEN k = 0 THEN concat('\"', md5(html), '\"') WHEN k = 3 THEN concat('\"', md5(url), '\"') WHEN page_id % 7 = 3 THEN '\"gone\"' WHEN page_id % 11 = 5 THEN NULL "
            "ELSE concat(CASE WHEN page_id % 2 = 0 THEN 'W/' ELSE '' END, '\"', CASE WHEN page_id % 4 = 1 AND k = 1 THEN md5(url) ELSE md5(html) END, '\"') END",
    "modified": "CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 13 = 2 AND k IN (1, 2) THEN 'other' ELSE concat('day ', CAST(page_id % 28 AS VARCHAR(9))) END",
    "length": "CASE WHEN k IN (1, 2) THEN '0' ELSE CAST(length(html) AS VARCHAR(19)) END",
    "expires": "CASE WHEN k IN (1, 2) THEN 'later' END",
    "control": "CASE WHEN k NOT IN (1, 2) THEN 'max-age=60' END",
}
ARCHIVE_WHERE = "k IN (0, 1) OR (k = 2 AND page_id % 3 = 0) OR (k = 3 AND page_id % 4 = 1)"


def archive(pages: DataFrame) -> DataFrame:
    """Records of a web archive with the fields that ``warc.resolve`` reads."""
    rows = pages.select("page_id", "url", "html", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).filter(ARCHIVE_WHERE)
    rows = rows.select("html", "k", *[F.expr(e).alias(n) for n, e in ARCHIVE_SQL.items()])
    names = {"ETag": "etag", "Last-Modified": "modified", "Content-Length": "length", "Expires": "expires", "Cache-Control": "control"}
    headers = F.map_filter(F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(c))]), lambda k, v: v.isNotNull())
    return rows.select("record_id", "url", F.timestamp_seconds("seconds").alias("ts"), "kind", headers.alias("headers"), F.when(F.col("kind") == "response", F.col("html")).alias("payload"))


@query("op10_warc_revisits", oracles.warc(ARCHIVE_SQL, ARCHIVE_WHERE, warc.PERMITTED))
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of an archive made from all pages, with its state, merged headers and a digest of the payload."""
    records = archive(read(spark, sf_dir, "pages"))
    out = warc.with_payload(warc.resolve(records), records)
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "canonical", "state", "refers_to", headers.alias("headers"), F.length("payload").cast("long").alias("payload_chars"), F.md5("payload").alias("payload_md5"))


@query("op11_importance_resampling")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents against the benchmark's distribution, and the ranks of the 5 % that are drawn."""
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two vocabularies in every document, with corpus-wide counts of id pairs."""
    out = alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


@query("op13_sentencepiece")
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text they decode to, as digests; ``agrees`` compares both with the library."""
    out = pieces.tokenize(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
