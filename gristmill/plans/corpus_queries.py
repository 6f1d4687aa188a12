"""Registered queries of the corpus family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import lines as L
from gristmill.functions import text as TX
from gristmill.operators import corpus as CO
from gristmill.plans import sqltext as Q
from gristmill.plans.registry import query
from gristmill.session import scratch_path
from gristmill.sources import html_pages as H
from gristmill.sources import tables as T
from gristmill.sources.ordered_files import read_ordered

NL = "chr(10)"
# a document view with page numbers, running headers, hyphen breaks, lists and odd characters planted by id
DIRTY = (
    "CASE WHEN doc_id % 3 = 0 THEN 'Report Page ' || CAST(doc_id AS STRING) || chr(10) ELSE '' END || text || "
    "CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Report Page 2' || chr(10) || '- first item' || chr(10) || 'b) second item' || chr(10) || 'REPORT  page 3' || chr(10) || chr(10) || chr(10) || chr(10) || 'broken hyphen-' || chr(10) || 'ation line' "
    "WHEN doc_id % 3 = 1 THEN chr(10) || 'Seite 4 von 9' || chr(10) || '- 12 -' || chr(10) || 'tab' || chr(9) || 'and' || chr(160) || '  space' || chr(10) || '[ 7 ]' ELSE chr(13) || chr(10) || 'Confidential' || chr(10) || '3 / 8' END"
)
DOCS = f"docs AS (SELECT doc_id, 'doc-' || CAST(doc_id AS VARCHAR) AS name, {DIRTY} AS text FROM documents)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with planted layout noise (generated once per row, see ``tables``)."""
    d = T.table(spark, sf, "documents").withColumn("noise", F.expr(DIRTY.replace("chr(160)", "char(160)").replace("chr(", "char(")))
    return d.select(F.inline(F.array(F.struct("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("noise").alias("text")))))


def lines_sql(src: str = "docs", text: str = "text") -> str:
    return f"lines AS (SELECT doc_id, unnest(string_split({text}, {NL})) AS line, generate_subscripts(string_split({text}, {NL}), 1) - 1 AS line_no FROM {src})"


_ws = L.LINE_WS
lt = lambda x: f"regexp_replace({x}, '^[\\n{_ws}]+|[\\n{_ws}]+$', '', 'g')"
LIST = L.LIST_RE
is_list = lambda x: f"regexp_matches({x}, '{LIST}')"
is_page = lambda x: f"regexp_matches({lt(x)}, '{L.PAGE_NUMBER_RE}')"
is_head = lambda x: (f"(length({lt(x)}) BETWEEN 1 AND 65 AND NOT regexp_matches({lt(x)}, '[.,;:!?]$') AND NOT {is_list(lt(x))} AND regexp_matches({lt(x)}, '[A-Za-z]') "
                     f"AND len(regexp_extract_all({lt(x)}, '[^\\n{_ws}]')) <= 50)")
shape = lambda x: f"lower(regexp_replace(regexp_replace({lt(x)}, '\\d+', '#', 'g'), '[\\n{_ws}]+', ' ', 'g'))"
_letters, _uppers = (lambda x: f"len(regexp_extract_all({lt(x)}, '[A-Za-z]'))"), (lambda x: f"len(regexp_extract_all({lt(x)}, '[A-Z]'))")
is_run = lambda x: (f"(length({lt(x)}) BETWEEN 1 AND 80 AND NOT regexp_matches({lt(x)}, '[.!?]\\s*$') AND len(regexp_extract_all({lt(x)}, ',')) <= 3 AND "
                    f"(regexp_matches({lt(x)}, '\\d') OR ({_letters(x)} > 0 AND {_uppers(x)} / greatest({_letters(x)}, 1) > 0.6) OR regexp_matches({lt(x)}, '^[^0-9A-Za-z]')))")
cand = lambda x: f"(length({lt(x)}) BETWEEN 1 AND 80 AND regexp_matches({lt(x)}, '[a-zA-Z]'))"
CTRL = "[\\x{01}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}\\x{AD}\\x{200B}-\\x{200D}\\x{FEFF}]"
ctrl = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '{CTRL}', '', 'g'), '[\\x{{A0}}\\t]', ' ', 'g'), ' {{2,}}', ' ', 'g')"

query("strip_control", f"WITH {DOCS} SELECT doc_id, {ctrl('text')} AS text FROM docs")(
    lambda s, sf: docs(s, sf).select("doc_id", L.strip_control("text").alias("text")))


def line_query(name: str, spark_expr, sql_expr: str):
    query(name, f"WITH {DOCS}, {lines_sql()} SELECT doc_id, line_no, {sql_expr} AS value FROM lines")(
        lambda s, sf: CO.doc_lines(docs(s, sf)).select("doc_id", "line_no", spark_expr(F.col("line")).alias("value")))


line_query("is_page_number", L.is_page_number, is_page("line"))
line_query("is_list_line", L.is_list_line, is_list("line"))
line_query("is_heading_line", L.is_heading_line, is_head("line"))
line_query("fuzzy_shape", L.fuzzy_shape, shape("line"))
line_query("is_running_header", L.is_running_header, is_run("line"))
query("rejoin_hyphens", f"WITH {DOCS} SELECT doc_id, regexp_replace(text, '([a-z])-\\s*\\n\\s*([a-z])', '\\1\\2', 'g') AS text FROM docs")(
    lambda s, sf: docs(s, sf).select("doc_id", L.rejoin_hyphens("text").alias("text")))
_rep = f"rep AS (SELECT *, count(*) OVER (PARTITION BY doc_id, {cand('line')}, {shape('line')}) AS n FROM lines), kept AS (SELECT * FROM rep WHERE NOT ({cand('line')} AND n >= 3 AND {is_run('line')}))"
query("drop_repeated_lines", f"WITH {DOCS}, {lines_sql()}, {_rep} SELECT d.doc_id, coalesce(string_agg(k.line, {NL} ORDER BY k.line_no), '') AS text, (SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id) - count(k.line_no) AS lines_removed "
      "FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id")(
    lambda s, sf: CO.drop_repeated_lines(docs(s, sf)))
_prep = f"regexp_replace(regexp_replace(replace(replace({ctrl('text')}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '([a-z])-\\s*\\n\\s*([a-z])', '\\1\\2', 'g')"
_reflow = (
    "kinds AS (SELECT doc_id, line_no, tr, CASE WHEN tr = '' THEN 'b' WHEN " + is_list("tr") + " OR " + is_head("tr") + " THEN 'o' ELSE 'p' END AS k FROM (SELECT *, " + lt("line") + " AS tr FROM kept)), "
    "glued AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY line_no) AS pk FROM kinds), "
    f"joined AS (SELECT doc_id, string_agg(CASE WHEN pk IS NULL THEN '' WHEN k = 'p' AND pk = 'p' THEN ' ' ELSE {NL} END || tr, '' ORDER BY line_no) AS t FROM glued GROUP BY doc_id)"
)
_tidy = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\n{{3,}}', {NL} || {NL}, 'g'), '[{_ws}]+\\n', {NL}, 'g'), '[{_ws}]+$', ''), '^\\n+|\\n+$', '', 'g')"
CLEAN = (
    f"{DOCS}, prep AS (SELECT doc_id, text AS raw, {_prep} AS text FROM docs), {lines_sql('prep')}, nopage AS (SELECT * FROM lines WHERE NOT {is_page('line')}), "
    f"{_rep.replace('FROM lines)', 'FROM nopage)')}, {_reflow}, "
    f"cleaned AS (SELECT prep.doc_id, raw, coalesce({_tidy}, '') AS clean_text, (SELECT count(*) FROM lines WHERE lines.doc_id = prep.doc_id) - (SELECT count(*) FROM kept WHERE kept.doc_id = prep.doc_id) AS lines_removed FROM prep LEFT JOIN joined USING (doc_id))"
)
query("clean_document", f"WITH {CLEAN} SELECT doc_id, clean_text, lines_removed, greatest(0, length(raw) - length(clean_text)) AS chars_removed FROM cleaned")(
    lambda s, sf: CO.clean_document(docs(s, sf)).select("doc_id", "clean_text", "lines_removed", "chars_removed"))
query("reflow", f"WITH {DOCS}, {lines_sql()}, kept AS (SELECT * FROM lines), {_reflow} SELECT doc_id, t AS text FROM joined")(
    lambda s, sf: docs(s, sf).select("doc_id", L.reflow(F.split("text", "\n", -1)).alias("text")))
_short = f"short AS (SELECT doc_id, line_no, line, {lt('line')} AS t, {shape('line')} AS shape FROM lines WHERE length({lt('line')}) BETWEEN 1 AND 100 AND regexp_matches({lt('line')}, '[a-zA-Z]'))"
CROSS = f"{DOCS}, {lines_sql()}, {_short}, firsts AS (SELECT shape, min(doc_id) AS a, max(doc_id) AS b FROM short GROUP BY 1), " \
        "r AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY doc_id, line_no) AS n, first_value(t) OVER (PARTITION BY shape ORDER BY doc_id, line_no) AS ft FROM short), " \
        f"gone AS (SELECT r.doc_id, r.line_no, r.line FROM r JOIN firsts USING (shape) WHERE a <> b AND n > 1 AND {is_run('ft')})"
query("cross_doc_lines", f"WITH {CROSS} SELECT * FROM gone")(lambda s, sf: CO.cross_doc_lines(docs(s, sf)))
query("strip_cross_doc", f"WITH {CROSS} SELECT doc_id, coalesce(string_agg(line, {NL} ORDER BY line_no), '') AS text FROM docs LEFT JOIN (SELECT * FROM lines ANTI JOIN gone USING (doc_id, line_no)) USING (doc_id) GROUP BY doc_id")(
    lambda s, sf: CO.strip_cross_doc(docs(s, sf)).select("doc_id", "text"))
_est = lambda x: f"CASE WHEN {x} = '' THEN 0 ELSE greatest(1, CAST(floor((length({x}) / 4 + {Q.words(x)} / 0.75) / 2 + 0.5) AS BIGINT)) END"
query("estimate_tokens", f"SELECT doc_id, {_est('text')} AS tokens, CAST(ceil(length(text) / 3.2) AS BIGINT) AS tokens_by_chars FROM documents")(
    lambda s, sf: T.table(s, sf, "documents").select("doc_id", TX.estimate_tokens("text").alias("tokens"), TX.estimate_tokens_chars("text").alias("tokens_by_chars")))
query("count_words", f"SELECT doc_id, {Q.words('text')} AS words FROM documents")(
    lambda s, sf: T.table(s, sf, "documents").select("doc_id", TX.count_words("text").alias("words")))
query("corpus_stats", f"WITH {CLEAN} SELECT count(*) AS docs, sum(length(raw))::BIGINT AS chars_before, sum(length(clean_text))::BIGINT AS chars_after, sum({Q.words('raw')})::BIGINT AS words_before, sum({Q.words('clean_text')})::BIGINT AS words_after, "
      f"sum({_est('raw')})::BIGINT AS tokens_before, sum({_est('clean_text')})::BIGINT AS tokens_after, sum(lines_removed)::BIGINT AS lines_removed, "
      f"greatest(0, CAST(floor(100 * (1 - sum({_est('clean_text')}) / sum({_est('raw')})) + 0.5) AS BIGINT)) AS saved_percent FROM cleaned")(
    lambda s, sf: CO.corpus_stats(CO.clean_document(docs(s, sf))))
_bar = "repeat('=', 59)"


def merged_file(block, extension: str):
    """The merged file as it was written: its blocks by position."""
    def run(s: SparkSession, sf: str) -> DataFrame:
        path = scratch_path(s, f"merged-{extension}")
        CO.write_merged(docs(s, sf), path, block, extension)
        return read_ordered(s, path).select("file", "position", F.col("piece").alias("block"))
    return run


def merged_sql(block: str, source: str) -> str:
    return f"SELECT 'merged' AS file, row_number() OVER (ORDER BY doc_id) - 1 AS position, {block} AS block FROM {source}"


query("merge_plain", f"WITH {DOCS} " + merged_sql(f"{_bar} || {NL} || 'DOCUMENT: ' || name || {NL} || {_bar} || {NL} || {NL} || text", "docs"))(merged_file(CO.plain_block, "txt"))
query("merge_chats", f"WITH chats AS (SELECT conv_id AS doc_id, 'chat-' || CAST(conv_id AS VARCHAR) AS name, string_agg(role || ': ' || text, {NL} ORDER BY turn) AS text FROM conversations GROUP BY conv_id) "
      f"SELECT doc_id, {_bar} || {NL} || 'DOCUMENT: ' || name || {NL} || {_bar} || {NL} || {NL} || text AS block FROM chats")(
    lambda s, sf: CO.merged(T.chats(s, sf), CO.plain_block))
_mk = (f"mk AS (SELECT doc_id, line_no, {lt('line')} AS t, CASE WHEN {lt('line')} = '' THEN 'b' WHEN {is_head('line')} THEN 'h' WHEN {is_list(lt('line'))} THEN 'l' ELSE 'p' END AS k FROM lines), "
       "mk2 AS (SELECT *, lead(k) OVER (PARTITION BY doc_id ORDER BY line_no) AS nk FROM mk), "
       f"body AS (SELECT doc_id, string_agg(CASE k WHEN 'b' THEN '' WHEN 'h' THEN '## ' || t || {NL} || {NL} WHEN 'l' THEN '- ' || regexp_replace(t, '{LIST}', '') || {NL} ELSE t || CASE WHEN nk = 'p' THEN ' ' ELSE {NL} || {NL} END END, '' ORDER BY line_no) AS b FROM mk2 GROUP BY 1)")
_md = f"'# ' || name || {NL} || {NL} || b"
query("merge_markdown", f"WITH {DOCS}, {lines_sql()}, {_mk} " + merged_sql(lt(f"regexp_replace({_md}, '\\n{{3,}}', {NL} || {NL}, 'g')"), "docs JOIN body USING (doc_id)"))(merged_file(CO.markdown_block, "md"))


def _escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_item = "'  <li>' || " + _escaped(f"regexp_replace(x, '{LIST}', '')") + " || '</li>'"
_all_list = f"(len(list_filter(string_split(b, {NL}), lambda x: NOT ({lt('x')} = '' OR {is_list('x')}))) = 0 AND len(list_filter(string_split(b, {NL}), lambda x: {is_list('x')})) > 0)"
_html = (
    f"raw AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{{2,}}')) AS r, generate_subscripts(regexp_split_to_array(text, '\\n{{2,}}'), 1) AS i FROM docs), blk AS (SELECT doc_id, i, {lt('r')} AS b FROM raw), "
    f"tags AS (SELECT doc_id, i, CASE WHEN NOT contains(b, {NL}) AND {is_head('b')} THEN '<h2>' || {_escaped('b')} || '</h2>' WHEN {_all_list} THEN '<ul>' || {NL} || array_to_string(list_transform(string_split(b, {NL}), lambda x: {_item}), {NL}) || {NL} || '</ul>' "
    f"ELSE '<p>' || replace({_escaped('b')}, {NL}, ' ') || '</p>' END AS t FROM blk WHERE b <> ''), inner_ AS (SELECT doc_id, string_agg(t, {NL} ORDER BY i) AS t FROM tags GROUP BY 1)")
query("merge_html", f"WITH {DOCS}, {_html} " + merged_sql(f"'<section data-document=\"' || {_escaped('name')} || '\">' || {NL} || '<h1>' || {_escaped('name')} || '</h1>' || {NL} || CASE WHEN t IS NULL THEN '' ELSE t || {NL} END || '</section>'", "docs LEFT JOIN inner_ USING (doc_id)"))(merged_file(CO.html_block, "html"))
query("html_article_text")(lambda s, sf: H.html_article_text(T.table(s, sf, "pages")))
query("html_body_text")(lambda s, sf: H.html_body_text(T.table(s, sf, "pages")))
