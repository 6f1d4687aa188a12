"""Resolving not-modified revisits of a web archive: as-of join by canonical URL to the latest earlier full response.

Records are (record_id, url, ts, kind, status, headers, payload): ``kind`` is ``response`` or ``revisit``, headers a map
with any case of names. Only full responses count: those of status 200, or without a status where it is null or the
column is missing. A revisit belongs to the latest full response of its canonical URL with an earlier time (of several
at that time, the one with the largest record_id). It is *resolved* if the validators agree: an ETag that both have must be
equal (weak comparison), else a Last-Modified that both have must be; a revisit without any common validator is
*unverified*, one with a differing validator is *stale*, one without earlier response is an *orphan*. Only resolved
revisits get the payload and merged headers: those of the response, replaced by the revisit's where a 304 answer may
replace them; headers about the payload stay.

A URL may hold a third of all records. The order of a URL is cut into chunks of time; each chunk's last response is one
small row, the one before a chunk comes from a window over these rows, and only inside a chunk are records sorted.
Payloads do not take part: they are joined to the resolved revisits at the end by record_id, which is one row a
response on one side.

Defined results: records without url, time or record_id are orphans (revisits) or never referred to (responses); a null
header map is empty; repeated records are rows of their own, repeated responses are referred to once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.llm.common import cut

#: Headers of a 304 answer that update the stored response.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "via", "warning"]
CHUNK_SECONDS = 6 * 3600


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host lower-cased without ``www.`` and default port, no fragment, query parameters sorted without
    the usual tracking ones, no trailing slash."""
    parts = lambda k: F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#\s]*)([^?#\s]*)(?:\?([^#\s]*))?", k)
    host = F.regexp_replace(F.lower(parts(1)), r"^(?:[^@]*@)?(?:www\.)?|:(?:80|443)$", "")
    path = F.regexp_replace(parts(2), "/+$", "")
    args = F.array_sort(F.filter(F.split(parts(3), "&"), lambda a: (a != "") & ~a.rlike("^(?:utm_[a-z]+|fbclid|gclid|ref)=")))
    query = F.array_join(args, "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def lowered(headers: Column) -> Column:
    """The header map with lower-case names; of names that differ only in case the first by name counts."""
    pairs = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    named = F.transform(pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    once = F.filter(named, lambda e, i: ~F.exists(F.slice(named, F.lit(1), i), lambda d: d["key"] == e["key"]))
    return F.map_from_entries(once)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.trim(F.element_at(headers, "etag")), "^W/", "")


def _full(records: DataFrame) -> Column:
    """Is the record a response with the whole payload?"""
    status = F.expr("try_cast(status AS int)") if "status" in records.columns else F.lit(None).cast("int")
    return (F.col("kind") == "response") & (F.coalesce(status, F.lit(200)) == 200)


def resolve(records: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """One row for each revisit: (record_id, canonical, ts, state, refers_to, headers); see the module's text."""
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("timestamp").alias("ts"), "kind", _full(records).alias("_full"), lowered(F.col("headers")).alias("h"))
    keyed = F.col("canonical").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    r = cut(r.withColumn("_chunk", F.when(keyed, F.floor(F.unix_seconds("ts") / chunk_seconds))))
    response = F.when(F.col("_full") & keyed, F.struct("ts", "record_id", "h"))
    lost = r.filter((F.col("kind") == "revisit") & F.col("_chunk").isNull())
    r = r.filter("_chunk IS NOT NULL").withColumn("_response", response)
    lasts = r.filter("_response IS NOT NULL").groupBy("canonical", "_chunk").agg(F.max_by("_response", F.struct("ts", "record_id")).alias("_last"))
    # the response before each chunk: one row for each chunk of a URL that has any record
    ends = r.select("canonical", "_chunk").distinct().join(lasts, ["canonical", "_chunk"], "left")
    before = F.last("_last", ignorenulls=True).over(W.partitionBy("canonical").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    carried = ends.select("canonical", "_chunk", before.alias("_carried"))
    # inside a chunk a revisit sees the responses of strictly earlier time
    earlier = W.partitionBy("canonical", "_chunk").orderBy(F.unix_micros("ts")).rangeBetween(W.unboundedPreceding, -1)
    place = F.when(F.col("_response").isNotNull(), F.struct("ts", "record_id"))
    seen = r.withColumn("_seen", F.max_by("_response", place).over(earlier)).filter("kind = 'revisit'")
    found = seen.join(carried, ["canonical", "_chunk"], "left").withColumn("_best", F.coalesce("_seen", "_carried"))
    found = found.select("record_id", "canonical", "ts", "h", F.col("_best.record_id").alias("refers_to"), F.col("_best.h").alias("stored"))
    found = found.unionByName(lost.select("record_id", "canonical", "ts", "h", F.lit(None).cast(records.schema["record_id"].dataType).alias("refers_to"), F.lit(None).cast("map<string,string>").alias("stored")))
    tag, date = [_tag(F.col(c)) for c in ("h", "stored")], [F.trim(F.element_at(F.col(c), "last-modified")) for c in ("h", "stored")]
    state = (
        F.when(F.col("refers_to").isNull(), "orphan").when(tag[0].isNotNull() & tag[1].isNotNull(), F.when(tag[0] == tag[1], "resolved").otherwise("stale"))
        .when(date[0].isNotNull() & date[1].isNotNull(), F.when(date[0] == date[1], "resolved").otherwise("stale")).otherwise("unverified"))
    permitted = F.map_filter("h", lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    kept = F.map_filter("stored", lambda k, v: ~F.map_contains_key(permitted, k))
    out = found.withColumn("state", state)
    return out.select("record_id", "canonical", "ts", "state", "refers_to", F.when(F.col("state") == "resolved", F.map_concat(kept, permitted)).alias("headers"))


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """The resolved revisits with the payload of the response they refer to; the others with null."""
    full = records.filter(_full(records) & F.col("record_id").isNotNull()).select(F.col("record_id").alias("_id"), "payload").dropDuplicates(["_id"])
    wanted = F.when(F.col("state") == "resolved", F.col("refers_to"))
    return resolved.withColumn("_wanted", wanted).join(full, F.col("_wanted") == F.col("_id"), "left").drop("_wanted", "_id")
