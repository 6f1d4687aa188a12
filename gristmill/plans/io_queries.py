"""Registered queries of sources, sinks, layout and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import catalog_fields as K
from gristmill.operators import catalog_repair as CR
from gristmill.operators import catalog_rules as CK
from gristmill.operators import catalog_rows as R
from gristmill.operators import catalog_split as SP
from gristmill.operators import layout as LY
from gristmill.plans import catalog_queries as CQ
from gristmill.plans import sqltext as Q
from gristmill.plans.feed_queries import COV
from gristmill.plans.registry import query, register
from gristmill.session import scratch_path
from gristmill.sources import csv_files as CS
from gristmill.sources import feed_payloads as FP
from gristmill.sources import tables as T
from gristmill.sources.ordered_files import committed, file_of, read_ordered, write_ordered
from gristmill.streaming import streams as ST

# ---- files of the catalog ------------------------------------------------------------------------------------------
_SEP = "CASE file_no % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN char(9) ELSE '|' END"


def payloads(s, sf):
    """One CSV payload per catalog file (100 rows each), in four delimiters and four encodings; every fifth has a misfit row."""
    df = CQ.catalog(s, sf).withColumn("file_no", F.regexp_extract("file_id", r"(\d+)$", 1).cast("int"))
    names = R.data_columns(df.drop("file_no"))
    df = df.withColumn("sep", F.expr(_SEP))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.call_function("array_join", F.array(*[quoted(F.col(n)) for n in names]), F.col("sep"))
    head = F.call_function("array_join", F.array(*[F.lit(n) for n in names]), F.col("sep"))
    g = df.groupBy("file_id", "file_no", "sep").agg(F.min(head).alias("h"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    text = F.concat("h", F.lit("\n"), "b", F.when(F.col("file_no") % 5 == 0, F.concat(F.lit("\nonly"), "sep", F.lit("two"))).otherwise(""))
    kind = F.col("file_no") % 7
    latin = F.regexp_replace(text, r"[^\x{00}-\x{7F}]", "é")
    content = (
        F.when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(kind == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(kind == 3, F.encode(latin, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")))
    return g.select("file_id", F.explode(F.array(content)).alias("content"))


_cells_text = "concat_ws(' ', " + ", ".join(CQ.SHORT.values()) + ")"
_head_text = ",".join(CQ.SHORT)
PROBE = f"WITH f AS (SELECT DISTINCT CAST(floor(p_partkey / 100) AS INT) AS n, 'file-' || CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS VARCHAR) AS file_id FROM part)"
_latin_odd = f"EXISTS (SELECT 1 FROM c WHERE c.file_id = f.file_id AND regexp_matches({_cells_text}, '[^\\x{{00}}-\\x{{7F}}]'))"
_encoding = f"CASE n % 7 WHEN 1 THEN 'UTF-8' WHEN 2 THEN 'UTF-16LE' WHEN 3 THEN CASE WHEN {_latin_odd} THEN 'ISO-8859-1' ELSE 'UTF-8' END ELSE 'UTF-8' END"
_sep_sql = "CASE n % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END"
_file_numbers = "f AS (SELECT DISTINCT CAST(substring(file_id, 6) AS INT) AS n, file_id FROM c)"
_quoted = lambda c: f"'\"' || replace(coalesce({c}, ''), '\"', '\"\"') || '\"'"
_payload = (f"t AS (SELECT c.file_id, n, replace('{_head_text}', ',', SEP) || string_agg(chr(10) || " + f" || {'SEP'} || ".join(_quoted(c) for c in CQ.SHORT.values()) + ", '' ORDER BY row_no) || CASE WHEN n % 5 = 0 THEN chr(10) || 'only' || SEP || 'two' ELSE '' END AS text FROM c JOIN f USING (file_id) GROUP BY c.file_id, n)").replace("SEP", f"({_sep_sql})")
_size = (f"CASE n % 7 WHEN 1 THEN strlen(text) + 3 WHEN 2 THEN 2 * length(text) + 2 WHEN 3 THEN length(text) ELSE strlen(text) END")
query("csv_probe", f"{CQ.C}, {_file_numbers}, {_payload} SELECT file_id, {_encoding} AS encoding, n % 7 IN (1, 2) AS has_bom, {_sep_sql} AS delimiter, CAST({_size} AS BIGINT) AS byte_size FROM t AS f")(lambda s, sf: CS.csv_probe(payloads(s, sf)))
query("csv_misfit_rows", f"{PROBE} SELECT file_id, CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS misfit_rows FROM f")(lambda s, sf: CS.csv_misfit_rows(payloads(s, sf)))
_latin = lambda x: f"CASE WHEN CAST(substring(file_id, 6) AS INT) % 7 = 3 THEN regexp_replace({x}, '[^\\x{{00}}-\\x{{7F}}]', 'é', 'g') ELSE {x} END"
_line = "concat_ws(',', " + ", ".join("'\"' || replace(coalesce(" + c + ", ''), '\"', '\"\"') || '\"'" for c in CQ.SHORT.values()) + ")"
_odd_line = ",".join(['"only"', '"two"'] + ['""'] * (len(CQ.SHORT) - 2))


@query("csv_recode", f"{CQ.C}, l AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY row_no) - 1 AS position, {_line} AS line FROM c) SELECT file_id, position, {_latin('line')} AS line FROM l "
       f"UNION ALL SELECT file_id, count(*) AS position, '{_odd_line}' AS line FROM l WHERE CAST(substring(file_id, 6) AS INT) % 5 = 0 GROUP BY 1")
def csv_recode(s, sf):
    """All payloads as files of their own, read in groups of one layout and written as comma-separated UTF-8."""
    raw, path = scratch_path(s, "payloads"), scratch_path(s, "recoded")
    write_ordered(payloads(s, sf), raw, F.col("file_id"), ["file_id"], F.col("content"), end="", extension="csv")
    rows = CS.csv_recode(s, committed(raw) + "/*")
    CS.write_lines(rows.withColumn("file_id", file_of(F.col("file_id"))), path, F.col("file_id"), ["row_no"], list(CQ.SHORT))
    return read_ordered(s, path).select(F.col("file").alias("file_id"), "position", F.col("piece").alias("line"))


def files_table(s, sf):
    p = payloads(s, sf)
    probe = CS.csv_probe(p).join(CS.csv_misfit_rows(p), "file_id")
    return probe.withColumn("byte_size", F.when(F.col("file_id").endswith("8"), F.lit(K.SIZE_LIMIT_BYTES)).when(F.col("file_id").endswith("9"), F.lit(K.SIZE_WARN_BYTES)).otherwise(F.col("byte_size")))


_kind = {
    "DELIMITER_NOT_COMMA": ("n % 4 <> 0", "CASE n % 4 WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END"),
    "FILE_SIZE_APPROACHING_LIMIT": ("n % 10 = 9", f"'{K.SIZE_WARN_BYTES}'"), "FILE_SIZE_OVER_LIMIT": ("n % 10 = 8", f"'{K.SIZE_LIMIT_BYTES}'"),
    "ENCODING_BOM_PRESENT": ("n % 7 IN (1, 2)", "CASE n % 7 WHEN 1 THEN 'UTF-8' ELSE 'UTF-16LE' END"),
    "ENCODING_NOT_UTF8": (f"({_encoding}) <> 'UTF-8'", _encoding),
    "FIELD_COUNT_MISMATCH": ("n % 5 = 0", "'1'"),
}
for _code in ("DELIMITER_NOT_COMMA", "FILE_SIZE_APPROACHING_LIMIT", "FILE_SIZE_OVER_LIMIT", "ENCODING_BOM_PRESENT", "ENCODING_NOT_UTF8", "FIELD_COUNT_MISMATCH"):
    _sql = f"{CQ.C}, {_file_numbers} SELECT file_id, {_kind[_code][1]} AS value FROM f WHERE {_kind[_code][0]}" if _code == "ENCODING_NOT_UTF8" else f"{PROBE} SELECT file_id, {_kind[_code][1]} AS value FROM f WHERE {_kind[_code][0]}" if _code in _kind else None
    register(_code, lambda s, sf, c=_code: CK.file_rules(files_table(s, sf), [c]).select("file_id", "value"), _sql)


def written_csv(s, sf) -> str:
    """The catalog written by the corrected-CSV sink, one folder per file."""
    path = scratch_path(s, "catalog-csv")
    CS.write_corrected_csv(CQ.catalog(s, sf), path)
    return path


_cells = "SELECT file_id, coalesce(h, '') AS handle, coalesce(t, '') AS title, coalesce(body, '') AS body, coalesce(price, '') AS price FROM c"


@query("write_corrected_csv", f"{CQ.C} {_cells}")
def write_corrected_csv(s, sf):
    back = s.read.csv(written_csv(s, sf), header=True, multiLine=True, escape='"', nullValue="\u0000", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cut = lambda n: F.coalesce(n, F.lit(""))
    return back.select("file_id", cut("Handle").alias("handle"), cut("Title").alias("title"), cut("Body (HTML)").alias("body"), cut("Variant Price").alias("price"))


@query("csv_scan", f"{CQ.C} SELECT count(*) AS n, count(DISTINCT h) AS handles, sum(length(coalesce(body, ''))) AS chars FROM c")
def csv_scan(s, sf):
    names = list(T.CATALOG)
    df = CS.csv_scan(s, [written_csv(s, sf) + "/*"], names)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("Handle", F.lit(""))).alias("handles"), F.sum(F.length(F.coalesce("Body (HTML)", F.lit("")))).alias("chars"))


_filled_h, _filled_price = "coalesce(h, '')", "coalesce(price, '')"
query("csv_batch_scan", f"{CQ.C}, l AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_no) + 1 AS place FROM c) SELECT file_id, place AS row_no, {_latin(_filled_h)} AS handle, {_latin(_filled_price)} AS price, legacy FROM l "
      "UNION ALL SELECT file_id, max(place) + 1 AS row_no, 'only' AS handle, '' AS price, NULL AS legacy FROM l WHERE CAST(substring(file_id, 6) AS INT) % 5 = 0 GROUP BY 1")(
    lambda s, sf: CS.csv_batch_scan(payloads(s, sf), ["Handle", "Title", "Variant Price", "Status"]).select(
        "file_id", "row_no", F.col("Handle").alias("handle"), F.col("Variant Price").alias("price"), F.col("extra")["Legacy Code"].alias("legacy")))


_https = "regexp_matches(img, '(?i)^http://')"
_log_columns = ["Row", "Column", "Before", "After", "Reason"]


@query("write_change_log", f"{CQ.C} SELECT file_id, row_no AS \"Row\", 'Image Src' AS \"Column\", img AS \"Before\", regexp_replace(img, '(?i)^http://', 'https://') AS \"After\", 'Upgraded to HTTPS' AS \"Reason\" FROM c WHERE {_https}")
def write_change_log(s, sf):
    path = scratch_path(s, "log")
    CS.write_change_log(CR.changes(CR.fix_https(CR.start(CQ.catalog(s, sf)))), path)
    back = CS.read_lines(s, path, _log_columns)
    return back.select(F.col("file").alias("file_id"), F.col("Row").cast("bigint").alias("Row"), *_log_columns[1:])


query("split_by_bytes")(lambda s, sf: SP.split_by_bytes(CQ.catalog(s, sf).withColumn("file_id", F.lit("all")), 20_000).groupBy("file_id", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("row_no").alias("first_row")))
query("fix_delimiter", f"{PROBE} SELECT file_id, '(file)' AS column_name, CASE n % 4 WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END || '-separated' AS before, 'comma-separated' AS after, 'Converted delimiter to comma' AS reason FROM f WHERE n % 4 <> 0")(
    lambda s, sf: CS.delimiter_log(CS.csv_probe(payloads(s, sf))))


@query("fix_oversize")
def fix_oversize(s, sf):
    return SP.oversize_log(CQ.catalog(s, sf), limit=8_000, target=7_000)


# ---- feeds and documents ------------------------------------------------------------------------------------------
def feed_payloads(s, sf):
    """Story rows as feed documents of 25 items (RSS for even blocks, Atom for odd ones); every ninth block is broken."""
    st = T.stories(s, sf).withColumn("block", F.floor(F.col("story_id") / 25))
    x = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    clean = lambda c: F.regexp_replace(c, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]", "")
    rss = F.concat(F.lit("<item><title>"), clean(x("title")), F.lit("</title><link>"), x("url"), F.lit("</link><description>"), clean(x("summary")), F.lit("</description><pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>"), clean(x("title")), F.lit('</title><link rel="self" href="ftp://no"/><link rel="alternate" href="'), F.replace(x("url"), F.lit('"'), F.lit("")), F.lit('"/><summary>'), clean(x("summary")), F.lit("</summary><updated>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated></entry>"))
    even = F.col("block") % 2 == 0
    g = st.withColumn("e", F.when(even, rss).otherwise(atom)).groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("story_id", "e"))), lambda v: v["e"]), "").alias("b"))
    body = F.when(F.col("block") % 9 == 8, F.lit("<rss><item>broken")).when(even, F.concat(F.lit("<rss version='2.0'><channel>"), "b", F.lit("</channel></rss>"))).otherwise(
        F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>"), "b", F.lit("</feed>")))
    return g.select(F.concat(F.lit("feed-"), F.col("block").cast("string")).alias("feed"), body.alias("body"))


query("feed_scan", f"WITH st AS ({T.SQL_STORIES}), b AS (SELECT story_id, CAST(floor(story_id / 25) AS BIGINT) AS block, row_number() OVER (PARTITION BY floor(story_id / 25) ORDER BY story_id) AS n, trim(title) AS title, url, published_at FROM st) "
      "SELECT 'feed-' || CAST(block AS VARCHAR) AS feed, CAST(n - 1 AS INT) AS pos, title, url AS link, published_at AS pub_date FROM b WHERE block % 9 <> 8")(
    lambda s, sf: FP.feed_scan(feed_payloads(s, sf)).select("feed", "pos", "title", "link", "pub_date"))


def search_payloads(s, sf):
    st = T.stories(s, sf).withColumn("block", F.floor(F.col("story_id") / 20))
    art = F.struct("title", F.when(F.col("story_id") % 7 == 0, "").otherwise(F.col("url")).alias("url"), F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.col("source").alias("domain"))
    return st.groupBy("block").agg(F.collect_list(art).alias("articles")).select(F.col("block").cast("string").alias("query"), F.to_json(F.struct("articles")).alias("body"))


query("search_json_scan", f"WITH st AS ({T.SQL_STORIES}) SELECT CAST(CAST(floor(story_id / 20) AS BIGINT) AS VARCHAR) AS query, title, url AS link, source AS author, published_at AS pub_date FROM st WHERE story_id % 7 <> 0")(
    lambda s, sf: FP.search_json_scan(search_payloads(s, sf)))
query("feed_registry", f"WITH st AS ({T.SQL_STORIES}) SELECT source AS feed, count(*) AS items FROM st WHERE source IN ('src1', 'src2', 'src3') GROUP BY 1")(
    lambda s, sf: T.stories(s, sf).join(FP.feed_registry(s, [("src1", "One", "open", ""), ("src2", "Two", "metered", ""), ("src3", "Three", "paywalled", "")]), F.col("source") == F.col("feed")).groupBy("feed").agg(F.count(F.lit(1)).alias("items")))
_names = "CASE doc_id % 6 WHEN 0 THEN 'a.HTML' WHEN 1 THEN 'b.md' WHEN 2 THEN 'c.txt' WHEN 3 THEN 'd.csv' WHEN 4 THEN 'e.exe' ELSE 'f.markdown' END"
query("doc_scan", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'html' WHEN 1 THEN 'md' WHEN 2 THEN 'txt' WHEN 3 THEN 'csv' ELSE 'md' END AS kind FROM documents WHERE doc_id % 6 <> 4")(
    lambda s, sf: T.table(s, sf, "documents").selectExpr("doc_id", f"{_names} AS name").select("doc_id", FP.doc_kind("name").alias("kind")).filter("kind is not null"))
_json = "concat('Sure:\\n```json\\n{\"id\": ', doc_id, ', \"text\": \"', regexp_replace(text, '[\"\\\\\\\\]', ''), CASE WHEN doc_id % 3 = 0 THEN '\\n tail' ELSE '' END, '\"', CASE WHEN doc_id % 4 = 0 THEN ',' ELSE '' END, CASE WHEN doc_id % 10 = 9 THEN '' ELSE '}' END, '\\n```')"
query("json_repair_parse", "SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN -1 ELSE doc_id END AS id FROM documents")(
    lambda s, sf: FP.json_repair_parse(T.table(s, sf, "documents").selectExpr("doc_id", f"{_json} AS j"), "j", "id bigint, text string").select("doc_id", F.coalesce("parsed.id", F.lit(-1)).alias("id")))
query("strip_breadcrumb_nodes", "SELECT page_id, '{\"@graph\": [{\"@type\": \"WebPage\", \"url\": \"p' || CAST(page_id AS VARCHAR) || '\"}]}' AS ld FROM pages")(
    lambda s, sf: T.table(s, sf, "pages").select("page_id", F.concat(F.lit('{"@graph": [{"@type": "BreadcrumbList", "a": 1}, {"@type": "WebPage", "url": "p'), F.col("page_id").cast("string"), F.lit('", "breadcrumb": {"@id": "x"}, "deep": [{"@type": "BreadcrumbList"}]}]}')).alias("ld"))
    .select("page_id", FP.strip_breadcrumb_nodes("ld").alias("ld")))


# ---- layout ---------------------------------------------------------------------------------------------------------
def words(s, sf):
    """Words of documents on a grid: one line of text per text line, 12 units apart; every fourth line is spaced like a table."""
    d = T.table(s, sf, "documents")
    ln = d.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    w = ln.select("page_id", "line", F.posexplode(F.filter(F.split("t", " +", -1), lambda x: x != "")).alias("pos", "text"))
    wide = F.col("line") % 4 >= 2
    x0 = F.when(wide, F.col("pos") * 90.0 + (F.col("pos") % 2) * -40.0).otherwise(F.col("pos") * 42.0)
    y0 = F.col("line") * 12.0 + (F.col("pos") % 3) * 1.0
    return w.select("page_id", "text", x0.alias("x0"), (x0 + 30.0).alias("x1"), y0.alias("y0"), (y0 + 10.0).alias("y1"))


query("layout_lines", "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS t FROM documents), w AS (SELECT doc_id, line, len(list_filter(regexp_split_to_array(t, ' +'), lambda x: x <> '')) AS n FROM l), "
      "k AS (SELECT doc_id AS page_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS line_no, n AS words FROM w WHERE n > 0) SELECT * FROM k")(
    lambda s, sf: LY.layout_lines(words(s, sf), 3.0).groupBy("page_id", "line_no").agg(F.count(F.lit(1)).alias("words")))
query("layout_cells")(lambda s, sf: LY.layout_cells(LY.layout_lines(words(s, sf), 3.0, by_line=True)))
query("layout_tables")(lambda s, sf: LY.layout_tables(LY.layout_lines(words(s, sf), 3.0, by_line=True)))
query("layout_blocks")(lambda s, sf: LY.layout_blocks(LY.layout_lines(words(s, sf), 3.0, by_line=True)))

# ---- streams -----------------------------------------------------------------------------------------------------------
def stream_of(s, sf, name: str):
    """A table of the folder as a stream."""
    schema = T.table(s, sf, name).schema
    # the pattern stands for this one name: it may be a file, which a stream takes by pattern only, or a folder of parts
    return s.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


query("stream_item_dedupe", "SELECT DISTINCT user_id AS link_key, strftime(ts, '%Y-%m-%d') AS day FROM events")(
    lambda s, sf: ST.drain(ST.item_dedupe(stream_of(s, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat_ws("/", "user_id", F.to_date("ts")).alias("link_key"), F.col("ts").alias("pub_ts"))), "dedupe")
    .select(F.col("user_id").alias("link_key"), "day"))
query("stream_unusable_ttl", "WITH e AS (SELECT user_id AS story_key, epoch_us(ts) // 1000 AS t FROM events), g AS (SELECT *, CASE WHEN t < lag(t) OVER w + 86400000 THEN 0 ELSE 1 END AS first FROM e WINDOW w AS (PARTITION BY story_key ORDER BY t)), "
      "i AS (SELECT *, sum(first) OVER (PARTITION BY story_key ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT story_key, min(t) AS hidden_from, max(t) + 86400000 AS hidden_until, CAST(count(*) AS INTEGER) AS marks FROM i GROUP BY story_key, no")(
    lambda s, sf: ST.drain_updates(ST.unusable_ttl(stream_of(s, sf, "events").select(F.col("user_id").alias("story_key"), F.col("ts").alias("t")), "1 hour"), "ttl", ["story_key", "hidden_from"]).filter("marks > 0"))


def with_end(stream, when: str, key: str, first):
    """The stream and one more row, far ahead of all others, that moves the watermark past them."""
    return stream.unionByName(stream.filter(first).withColumns({when: F.col(when) + F.expr("INTERVAL 90 DAYS"), key: F.lit(-1).cast("bigint")}))


def hits_with_end(s, sf):
    return with_end(stream_of(s, sf, "events"), "ts", "user_id", F.col("event_id") == 0).select(F.col("user_id").alias("key"), "ts")


query("stream_rate_audit", "WITH RECURSIVE e AS (SELECT user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), "
      "d AS (SELECT key, ts, n, 1 AS used, ts AS last, true AS accepted FROM e WHERE n = 1 UNION ALL SELECT key, ts, n, CASE WHEN accepted THEN had + 1 ELSE had END, CASE WHEN accepted THEN ts ELSE last END, accepted FROM "
      "(SELECT e.key, e.ts, e.n, d.last, CASE WHEN e.ts - d.last >= INTERVAL '1 day' THEN 0 ELSE d.used END AS had, (e.ts - d.last >= INTERVAL '1 day' OR d.used < 3) AS accepted FROM d JOIN e ON e.key = d.key AND e.n = d.n + 1)) "
      "SELECT key, ts, accepted FROM d")(
    lambda s, sf: ST.drain(ST.rate_audit(hits_with_end(s, sf), "1 hour", limit=3, gap_seconds=86400, slot_seconds=3600), "rate"))
query("usage_last_minute", "SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM events")(
    lambda s, sf: ST.usage_last_minute(T.table(s, sf, "events").select("event_id", F.col("user_id").alias("key"), "ts", F.floor("value").alias("tokens")), span_seconds=86400).select("event_id", "used"))
query("stream_usage_windows", "SELECT user_id AS key, to_timestamp((CAST(floor(epoch(ts) / 10) AS BIGINT) - k) * 10)::TIMESTAMP AS from_ts, to_timestamp((CAST(floor(epoch(ts) / 10) AS BIGINT) - k) * 10 + 60)::TIMESTAMP AS to_ts, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM events, range(6) r(k) GROUP BY ALL")(
    lambda s, sf: ST.drain_updates(ST.usage_windows(stream_of(s, sf, "events").select(F.col("user_id").alias("key"), "ts", F.floor("value").alias("tokens")), "60 seconds"), "usage", ["key", "from_ts", "to_ts"]))


def story_stream(s, sf):
    start = F.unix_seconds(F.to_timestamp(F.lit(T.AS_OF)))
    return stream_of(s, sf, "documents").select(
        F.col("doc_id").alias("story_id"), T.first_sentence("text").alias("title"), "source", (start - F.col("doc_id") % 2400 * 60).cast("timestamp").alias("published_at"))


_first_sentence = "regexp_extract(trim(regexp_replace(text, '[ \\n\\r\\t]+', ' ', 'g')), '^[^.!?]*[.!?]*', 0)"


@query("stream_coverage", f"WITH st AS (SELECT doc_id AS story_id, {_first_sentence} AS title, coalesce(source, '') AS source FROM documents), {COV} SELECT story_id, coverage FROM cov")
def stream_coverage(s, sf):
    q, out = ST.coverage_job(story_stream(s, sf), "coverage")
    q.awaitTermination()
    return ST.read_coverage(s, out)


def stories_with_end(s, sf):
    return with_end(story_stream(s, sf), "published_at", "story_id", F.col("story_id") == 0)


query("stream_carry_expiry", f"WITH st AS (SELECT doc_id AS id, {_first_sentence} AS title, doc_id % 2400 AS ago FROM documents), tk AS (SELECT DISTINCT id, ago, unnest({Q.tokens(Q.clean_title('title'))}) AS w FROM st), sz AS (SELECT id, count(*) AS n FROM tk GROUP BY 1), "
      "p AS (SELECT a.id AS section_id, b.id AS story_id, count(*) AS shared FROM tk a JOIN tk b ON a.w = b.w AND b.ago BETWEEN a.ago - 60 AND a.ago + 60 GROUP BY 1, 2), "
      "m AS (SELECT section_id, story_id, shared FROM p JOIN sz ON sz.id = p.story_id WHERE shared >= least(3, greatest(2, CAST(ceil(n * 0.5) AS BIGINT)))) "
      "SELECT st.id AS section_id, story_id, shared FROM st LEFT JOIN m ON m.section_id = st.id")(
    lambda s, sf: ST.drain(ST.carry_expiry(
        stories_with_end(s, sf).select(F.col("story_id").alias("section_id"), "title", (F.col("published_at") - F.expr("INTERVAL 1 HOUR")).alias("at")),
        stories_with_end(s, sf).select("story_id", "title", "published_at"), hours=2), "carry").filter("section_id >= 0"))
