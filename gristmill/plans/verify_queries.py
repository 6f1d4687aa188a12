"""Registered queries of the verification family."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import claims as C
from gristmill.functions import text as TX
from gristmill.operators import digests as D
from gristmill.operators import feeds as FE
from gristmill.operators import places as PL
from gristmill.operators import verify as V
from gristmill.plans import sqltext as Q
from gristmill.plans.registry import query
from gristmill.sources import digest_tables as DT
from gristmill.sources import tables as T

TAIL = ("' Sales rose 12.5% to $' || CAST(doc_id % 40 AS STRING) || ' million in ' || CAST(2000 + doc_id % 30 AS STRING) || '. Then Maria Lopez of Nordbank Group said “we will not sell the plant this year at all” "
        "while experts say it is not only steel but coal. Overall, prices, wages, and margins fell — showing strain. Many argue about corn, wheat, and rice. The Fraud and bribery case has 7 people, 10 firms and 1,250 files.'")
CORPUS = "lower(text || ' sales grew 12.5 percent, ' || CAST(doc_id % 20 AS STRING) || ' million, nordbank 2010 and 2015')"
CL = f"WITH cl AS (SELECT doc_id, text || {TAIL} AS draft, {CORPUS} AS corpus FROM documents)"


def drafts(s, sf):
    return T.table(s, sf, "documents").selectExpr("doc_id", f"text || {TAIL} AS draft", f"{CORPUS} AS corpus")


esc = lambda p: p.replace("'", "''")
NUM = esc(C.NUMBER_TOKEN_RE)
_key = lambda t: f"regexp_replace(replace(regexp_replace(lower({t}), '{C.NUMBER_UNIT_RE}', '', 'g'), ',', ''), '\\.$', '')"
_toks = lambda x: f"regexp_extract_all({x}, '{NUM}')"
_keys = lambda x: f"list_transform({_toks(x)}, lambda t: {_key('t')})"


def scalar(name, spark_expr, sql_expr=None):
    query(name, f"{CL} SELECT doc_id, {sql_expr} AS value FROM cl" if sql_expr else None)(lambda s, sf: drafts(s, sf).select("doc_id", spark_expr().alias("value")))


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


scalar("num_tokens", lambda: F.array_join(C.num_tokens("draft"), "|"), f"array_to_string({_toks('draft')}, '|')")
scalar("num_key", lambda: F.array_join(F.transform(C.num_tokens("draft"), C.num_key), "|"), f"array_to_string({_keys('draft')}, '|')")
scalar("num_set", lambda: C.num_set("draft"), f"array_to_string(list_sort(list_filter({_keys('draft')}, lambda k: k <> '')), '|')")
_sym = "regexp_matches(t, '[%$€£]')"
_badn = f"list_transform(list_filter({_toks('draft')}, lambda t: NOT ({_key('t')} = '' OR (regexp_matches({_key('t')}, '^\\d$') AND NOT {_sym}) OR ({_key('t')} = '10' AND NOT {_sym})) AND NOT list_contains({_keys('corpus')}, {_key('t')})), lambda t: trim(t))"
scalar("unsupported_numbers", lambda: F.array_join(C.unsupported_numbers("draft", "corpus"), "|"), f"array_to_string({distinct_in_order(_badn)}, '|')")
_skip = ", ".join(f"'{w}'" for w in C.NOT_NAMES)
_runs = f"list_transform(regexp_extract_all(draft, '{esc(C.NAME_RE)}', 1), lambda n: regexp_replace(n, '^(?:The|This|That|These|Those|Our|Their|Its)\\s+', ''))"
_nwords = "list_filter(regexp_split_to_array(regexp_replace(n, '[’'']s\\b', '', 'g'), '[\\s-]+'), lambda t: length(t) > 2 AND t NOT IN (" + _skip + "))"
_badnames = f"list_filter({_runs}, lambda n: n <> '' AND n NOT IN ({_skip}) AND len({_nwords}) > 0 AND len(list_filter({_nwords}, lambda t: contains(corpus, lower(t)))) = 0)"
scalar("unsupported_names", lambda: F.array_join(C.unsupported_names("draft", "corpus"), "|"), f"array_to_string({distinct_in_order(_badnames)}, '|')")
_plain = f"regexp_replace(draft, '{C.QUOTED_12_RE}', ' ', 'g')"


def _rule_sql(rid: str, pattern: str) -> str:
    found = f"list_slice(regexp_extract_all({_plain}, '{esc(pattern)}'), 1, 3)"
    found = f"CASE WHEN len({found}) >= 2 THEN {found} ELSE [] END" if rid == "rule3" else found
    return f"list_transform({found}, lambda s: '{rid}:' || {Q.shorten('s', 70)})"


_wlist = "[" + ", ".join(f"'{esc(w)}'" for w in C.PHRASE_WORDS) + "]"
_phr = "list_concat(" + ", ".join([f"list_concat({_rule_sql(r, p)}, [])" for r, p in C.PHRASE_RULES[:1]]) + ", [])"
for _r, _p in C.PHRASE_RULES[1:]:
    _phr = f"list_concat({_phr}, {_rule_sql(_r, _p)})"
_phr = f"list_concat({_phr}, list_transform(list_filter({_wlist}, lambda w: contains(lower({_plain}), w)), lambda w: 'word:' || w))"
scalar("stock_phrases", lambda: F.array_join(F.transform(C.stock_phrases("draft"), lambda p: F.concat_ws(":", p["id"], p["snippet"])), "|"), f"array_to_string({_phr}, '|')")
_risk = f"list_transform(regexp_extract_all(regexp_replace(draft, '[\"“][^\"”]{{8,}}[\"”]', ' ', 'g'), '{C.RISK_RE}'), lambda w: lower(w))"
scalar("risk_words", lambda: F.array_join(C.risk_words("draft"), "|"), f"array_to_string({distinct_in_order(_risk)}, '|')")
_sents = lambda x: f"regexp_extract_all({x}, '{esc(TX.SENTENCE_RE)}')"
query("sentences", f"{CL}, s AS (SELECT doc_id, unnest({_sents('draft')}) AS sentence, generate_subscripts({_sents('draft')}, 1) - 1 AS pos FROM cl) SELECT * FROM s")(
    lambda s, sf: drafts(s, sf).select("doc_id", F.posexplode(TX.sentences("draft")).alias("pos", "sentence")))
query("sentences_safe")(lambda s, sf: drafts(s, sf).select("doc_id", F.posexplode(TX.sentences_safe("draft")).alias("pos", "sentence")))
scalar("cut_unsupported_sentences", lambda: C.cut_sentences("draft", C.unsupported_numbers("draft", "corpus")),
       Q.trim(f"array_to_string(list_filter({_sents('draft')}, lambda s: len(list_filter({_badn}, lambda b: contains(s, b))) = 0), '')"))
scalar("plain_dashes", lambda: TX.plain_dashes("draft"), "regexp_replace(regexp_replace(regexp_replace(regexp_replace(draft, ',\\s?—\\s?', ', ', 'g'), '\\s?—\\s?', ', ', 'g'), ',\\s–\\s', ', ', 'g'), '\\s–\\s', ', ', 'g')")
_nq = lambda x: Q.collapse(f"translate(lower(coalesce({x}, '')), '‘’“”', '''''\"\"')")
scalar("norm_quote", lambda: TX.norm_quote("draft"), _nq("draft"))
scalar("wording_issues", lambda: F.array_join(C.wording_issues("draft", "corpus"), "|"))
scalar("pull_quote", lambda: C.pull_quote(F.split("draft", "\n", -1)))
scalar("clean_frame", lambda: C.clean_frame("draft", 90))
scalar("split_paragraph", lambda: F.size(V.split_paragraph(F.col("draft"))))
query("split_long_sentence")(lambda s, sf: V.easy_text(drafts(s, sf), "doc_id", "draft"))

# ---- facts --------------------------------------------------------------------------------------------------------
_flat = "trim(regexp_replace(text, '[ \\n\\r\\t]+', ' '{G}))"
_CLAIM = "CASE doc_id % 6 WHEN 0 THEN 'Maria Lopez said the plant stays open' WHEN 1 THEN 'lower case claim about the plant' WHEN 2 THEN 'Too short claim' WHEN 3 THEN 'The “open mark claim is long enough' ELSE 'The plant stays open for years' END"
_QUOTE = ("CASE doc_id % 5 WHEN 0 THEN substring({F}, 11, 80) WHEN 1 THEN 'this exact passage does not occur anywhere at all' WHEN 2 THEN substring({F}, 1, 20) "
          "WHEN 3 THEN substring({F}, 5, 40) || ' … ' || substring({F}, 60, 50) ELSE replace(substring({F}, 20, 70), ' ', '  ') END")
_sqlflat = _flat.replace("{G}", ", 'g'")
FACTS = f"facts AS (SELECT doc_id AS fact_id, doc_id AS story_id, source AS outlet, {_CLAIM} AS claim, {_QUOTE.replace('{F}', _sqlflat)} AS quote, text FROM documents)"


def facts(s, sf):
    d = T.table(s, sf, "documents").withColumn("_f", F.trim(F.regexp_replace("text", "[ \\n\\r\\t]+", " ")))
    return d.selectExpr("doc_id AS fact_id", "doc_id AS story_id", "source AS outlet", f"{_CLAIM} AS claim", f"{_QUOTE.replace('{F}', '_f')} AS quote")


def articles(s, sf):
    return T.table(s, sf, "documents").select(F.col("doc_id").alias("story_id"), "text")


_pw = lambda x: f"trim(regexp_replace({_nq(x)}, '[^\\p{{L}}\\p{{N}}…]+', ' ', 'g'))"
_parts = "list_filter(list_transform(string_split(q, '…'), lambda s: trim(s)), lambda s: length(s) >= 20)"
query("quote_verify", f"WITH {FACTS}, n AS (SELECT *, {_pw('quote')} AS q, {_pw('text')} AS a FROM facts), r AS (SELECT fact_id, CASE WHEN length(q) < 25 THEN 'short quote' WHEN {Q.words('claim')} < 4 THEN 'short claim' WHEN regexp_matches(claim, '^\\p{{Ll}}') THEN 'fragment' "
      f"WHEN len(regexp_extract_all(claim, '“')) <> len(regexp_extract_all(claim, '”')) THEN 'unbalanced marks' WHEN claim LIKE 'Maria Lopez said%' AND NOT (contains(q, 'maria') AND contains(q, 'lopez')) THEN 'speaker' "
      f"WHEN NOT CASE WHEN contains(q, '…') THEN len({_parts}) > 0 AND len(list_filter({_parts}, lambda s: NOT contains(a, s))) = 0 ELSE contains(a, q) END THEN 'not in article' ELSE '' END AS reason FROM n) SELECT fact_id, reason = '' AS verified, reason FROM r")(
    lambda s, sf: V.quote_verify(facts(s, sf), articles(s, sf)))
query("quote_lookup", f"SELECT item_id AS quote_id, doc_id AS story_id FROM (SELECT item_id, {_pw('text')} AS q FROM benchmark) JOIN (SELECT doc_id, {_pw('text')} AS a FROM documents) ON contains(a, q)")(
    lambda s, sf: V.quote_lookup(T.table(s, sf, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), articles(s, sf)))
_stem = lambda x: f"list_distinct(list_transform({Q.tokens(x)}, lambda w: substring(w, 1, 5)))"
_ks = lambda x: f"list_filter({_keys(x)}, lambda k: k <> '')"
_ov = lambda a, b: f"CASE WHEN len({_stem(a)}) = 0 THEN 1.0 ELSE len(list_intersect({_stem(a)}, {_stem(b)})) / len({_stem(a)}) END"
CS = f"WITH {FACTS}, cs AS (SELECT fact_id, claim || ' 12 ' || substring(quote, 1, 20) AS claim, quote || CASE WHEN fact_id % 3 = 0 THEN ' 12' ELSE '' END AS quote FROM facts)"
query("claim_suspicious", f"{CS} SELECT fact_id, len(list_filter({_ks('claim')}, lambda k: NOT list_contains({_ks('quote')}, k))) > 0 OR ({_ov('claim', 'quote')}) < 0.6 AS suspicious, round({_ov('claim', 'quote')}, 6) AS overlap FROM cs")(
    lambda s, sf: facts(s, sf).selectExpr("fact_id", "claim || ' 12 ' || substring(quote, 1, 20) AS claim", "quote || CASE WHEN fact_id % 3 = 0 THEN ' 12' ELSE '' END AS quote")
    .select("fact_id", C.claim_suspicious("claim", "quote").alias("suspicious"), F.round(C.claim_overlap("claim", "quote"), 6).alias("overlap")))


def comparisons(s, sf):
    """Two outlets compared per fact: one cites the article itself, one cites a foreign passage."""
    f = facts(s, sf)
    a = f.select("fact_id", F.lit("AP").alias("outlet"), F.col("story_id").alias("other_story_id"), F.when(F.col("fact_id") % 4 == 3, "possible").otherwise("confirmed").alias("status"), F.col("quote").alias("other_quote"))
    b = f.select("fact_id", F.lit("Wire").alias("outlet"), F.col("story_id").alias("other_story_id"), F.when(F.col("fact_id") % 2 == 0, "conflict").otherwise("confirmed").alias("status"), F.lit("the 99 passage").alias("other_quote"))
    return a.unionByName(b)


def corroboration_facts(s, sf):
    return facts(s, sf).withColumn("claim", F.when(F.col("fact_id") % 3 == 0, F.substring("quote", 1, 40)).otherwise(F.col("claim")))


_cf = "cf AS (SELECT fact_id, CASE WHEN fact_id % 3 = 0 THEN substring(quote, 1, 40) ELSE claim END AS claim, quote, text FROM facts)"
_cmp = "cmp AS (SELECT fact_id, 'AP' AS outlet, CASE WHEN fact_id % 4 = 3 THEN 'possible' ELSE 'confirmed' END AS st0, quote AS oq FROM facts UNION ALL SELECT fact_id, 'Wire', CASE WHEN fact_id % 2 = 0 THEN 'conflict' ELSE 'confirmed' END, 'the 99 passage' FROM facts)"
_chk = (f"chk AS (SELECT cmp.fact_id, outlet, CASE WHEN st0 = 'confirmed' AND length({_pw('oq')}) > 0 AND contains({_pw('text')}, {_pw('oq')}) AND len(list_filter({_ks('claim')}, lambda k: NOT list_contains({_ks('oq')}, k))) = 0 AND ({_ov('claim', 'oq')}) >= 0.6 THEN 'confirmed' "
        f"WHEN st0 = 'conflict' AND contains({_pw('text')}, {_pw('oq')}) AND len(list_filter({_ks('claim')}, lambda k: NOT list_contains({_ks('oq')}, k))) > 0 THEN 'conflict' WHEN st0 IN ('conflict', 'possible') THEN 'possible' ELSE 'single' END AS status FROM cmp JOIN cf USING (fact_id))")
query("corroborate_check", f"WITH {FACTS}, {_cf}, {_cmp}, {_chk} SELECT * FROM chk")(lambda s, sf: V.corroborate_check(corroboration_facts(s, sf), comparisons(s, sf), articles(s, sf)))
query("corroborate_merge", f"WITH {FACTS}, {_cf}, {_cmp}, {_chk} SELECT fact_id, arg_max(status, CASE status WHEN 'conflict' THEN 3 WHEN 'confirmed' THEN 2 WHEN 'possible' THEN 1 ELSE 0 END) AS status, coalesce(string_agg(DISTINCT CASE WHEN status = 'confirmed' THEN outlet END, ',' ORDER BY CASE WHEN status = 'confirmed' THEN outlet END), '') AS confirmed_by FROM chk GROUP BY 1")(
    lambda s, sf: V.corroborate_merge(corroboration_facts(s, sf), V.corroborate_check(corroboration_facts(s, sf), comparisons(s, sf), articles(s, sf))).withColumn("confirmed_by", F.array_join("confirmed_by", ",")))
query("outlet_event_merge")(lambda s, sf: V.outlet_event_merge(FE.event_groups(T.stories(s, sf)), facts(s, sf)))
_FS = "SELECT user_id AS script_id, event_id AS ord, CASE event_id % 11 WHEN 0 THEN 'conflict' WHEN 1 THEN 'possible' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'confirmed' ELSE 'single' END AS status, event_id % 5 = 0 AS extra FROM events"


def script_facts(s, sf):
    return T.table(s, sf, "events").selectExpr(*_FS[len("SELECT "):-len(" FROM events")].replace(", CASE", "\u0000CASE").replace(", event_id", "\u0000event_id").split("\u0000"))


query("conflict_rollup", f"WITH f AS ({_FS}), g AS (SELECT script_id, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) AS total, count(*) FILTER (WHERE extra) AS extra, count(*) FILTER (WHERE status = 'conflict') AS conflicts, count(*) FILTER (WHERE status = 'possible') AS possible FROM f GROUP BY 1) "
      "SELECT *, CASE WHEN conflicts > 0 THEN 'conflict' WHEN confirmed > 0 AND confirmed * 2 >= total - extra THEN 'corroborated' WHEN confirmed > 0 THEN 'partial' ELSE 'none' END AS status FROM g")(lambda s, sf: V.conflict_rollup(script_facts(s, sf)))
query("fact_budget_trim", f"WITH f AS ({_FS}), r AS (SELECT script_id, ord, status, row_number() OVER (PARTITION BY script_id ORDER BY CASE status WHEN 'conflict' THEN 0 WHEN 'confirmed' THEN 1 ELSE 2 END, ord) AS rank FROM f) SELECT * FROM r WHERE rank <= 8")(
    lambda s, sf: V.fact_budget_trim(script_facts(s, sf), 8).select("script_id", "ord", "status", "rank"))
_SC = ["event_id AS script_id", "event_id % 7 AS facts_verified", "CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS bad_numbers", "CASE WHEN event_id % 13 = 0 THEN 2 ELSE 0 END AS bad_terms", "event_id % 17 = 0 AS too_long",
       "event_id % 19 <> 0 AS audit_ran", "CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS major_flags", "CASE WHEN event_id % 11 = 0 THEN 'conflict' ELSE 'none' END AS corroboration", "CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS possible"]
query("script_gate", f"WITH s AS (SELECT {', '.join(_SC)} FROM events) SELECT script_id, CASE WHEN facts_verified >= 3 AND bad_numbers = 0 AND bad_terms = 0 AND NOT too_long AND audit_ran AND major_flags = 0 AND corroboration <> 'conflict' AND possible = 0 THEN 'checked' ELSE 'review' END AS gate FROM s")(
    lambda s, sf: V.script_gate(T.table(s, sf, "events").selectExpr(*_SC)))
_raw = "least(20 + 4 * (doc_id % 12) + CASE WHEN doc_id % 3 > 1 THEN 8 ELSE 0 END, 0.55 * w / 2.5, CASE WHEN doc_id % 6 = 0 THEN 60 ELSE 90 END)"
query("plan_length", f"WITH d AS (SELECT doc_id, {Q.words('text')} AS w FROM documents), c AS (SELECT doc_id, c, abs(c - {_raw}) AS d FROM d, (VALUES (30), (45), (60), (90)) AS v(c)) SELECT doc_id, c AS seconds FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, c) = 1")(
    lambda s, sf: V.plan_length(T.table(s, sf, "documents").select("doc_id", (F.col("doc_id") % 12).alias("facts"), TX.count_words("text").alias("words"), (F.col("doc_id") % 3).alias("outlets"), (F.col("doc_id") % 6 == 0).alias("breaking")), 8, [30, 45, 60, 90]).select("doc_id", "seconds"))
query("word_bounds", "SELECT event_id, CAST(floor((15 + event_id % 90) * 2.5 * 0.85 + 0.5) AS BIGINT) AS word_min, CAST(floor((15 + event_id % 90) * 2.5 * 1.1 + 0.5) AS BIGINT) AS word_max FROM events")(
    lambda s, sf: T.table(s, sf, "events").select("event_id", V.word_bounds((15 + F.col("event_id") % 90).cast("double")).alias("b")).select("event_id", "b.*"))

# ---- charts ---------------------------------------------------------------------------------------------------------
_PTS = "array(named_struct('label', 'first year', 'raw', '12.5%', 'value', 12.5D), named_struct('label', 'next year', 'raw', '13.1%', 'value', CASE WHEN doc_id % 5 = 1 THEN 99D ELSE 13.1D END), named_struct('label', 'worth', 'raw', CASE WHEN doc_id % 3 = 0 THEN '$3 million' ELSE '14%' END, 'value', CASE WHEN doc_id % 3 = 0 THEN 3D ELSE 14D END))"


def charts(s, sf):
    d = T.table(s, sf, "documents")
    return d.selectExpr("doc_id AS chart_id", "doc_id AS section_id", "'A1' AS tag", "CASE doc_id % 4 WHEN 0 THEN 'line' WHEN 1 THEN 'stat' ELSE 'bar' END AS type", "concat('Output of plant ', doc_id) AS title", "'%' AS unit",
                        "CASE WHEN doc_id % 7 = 0 THEN 'never written 12.5% and 13.1%' ELSE 'Output  reached 12.5% in one year and 13.1% in the next, or 14%, worth $3 million' END AS quote", f"{_PTS} AS points")


def chart_sources(s, sf):
    return T.table(s, sf, "documents").select(F.col("doc_id").alias("section_id"), F.lit("A1").alias("tag"), F.concat(F.lit("Output reached 12.5% in one year and 13.1% in the next, or 14%, worth $3 million. "), "text").alias("text"))


query("chart_verify", "SELECT doc_id AS chart_id, CASE doc_id % 4 WHEN 0 THEN 'line' WHEN 1 THEN 'stat' ELSE 'bar' END AS type, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 3 END AS n_points FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 4 = 1 OR doc_id % 3 <> 0)")(
    lambda s, sf: V.chart_verify(charts(s, sf), chart_sources(s, sf)).select("chart_id", "type", F.size("points").alias("n_points")))
query("chart_key", "SELECT doc_id AS chart_id, 'output of plant ' || CAST(doc_id AS VARCHAR) || '|' || CASE WHEN doc_id % 3 = 0 THEN '$3 million,12.5%,13.1%' ELSE '12.5%,13.1%,14%' END AS value FROM documents")(
    lambda s, sf: charts(s, sf).select("chart_id", C.chart_key("title", F.transform("points", lambda p: p["raw"])).alias("value")))
query("lead_figure")(lambda s, sf: V.lead_figure(charts(s, sf).select(
    F.col("chart_id").alias("digest_id"), F.concat(F.lit("Talks went on. Debt hit $2.5 billion "), F.col("title"), F.lit(". End.")).alias("summary"),
    F.when(F.col("chart_id") % 3 == 0, F.array().cast("array<struct<type:string,title:string,points:array<struct<label:string,raw:string,value:double>>>>"))
    .otherwise(F.array(F.struct("type", "title", "points"))).alias("charts"))))

# ---- posts ------------------------------------------------------------------------------------------------------------
_NET = "CASE turn % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'instagram' WHEN 2 THEN 'linkedin' WHEN 3 THEN 'telegram' ELSE 'web' END"
_POST = "text || CASE WHEN turn % 2 = 0 THEN ' {link} https://example.com/a/b' ELSE '' END"
query("post_length_ok", f"WITH p AS (SELECT conv_id, turn, {_NET} AS net, {_POST} AS t FROM conversations), l AS (SELECT *, CASE net WHEN 'x' THEN 280 WHEN 'instagram' THEN 2200 WHEN 'linkedin' THEN 3000 WHEN 'telegram' THEN 4096 ELSE 63206 END AS lim FROM p) "
      "SELECT conv_id, turn, CASE WHEN lim = 280 THEN length(regexp_replace(replace(t, '{link}', repeat('x', 23)), '(?i)https?://\\S+', repeat('x', 23), 'g')) ELSE length(t) END <= lim AS ok FROM l")(
    lambda s, sf: T.table(s, sf, "conversations").selectExpr("conv_id", "turn", f"{_NET} AS net", f"{_POST} AS t").select("conv_id", "turn", C.post_length_ok(F.col("t"), F.col("net")).alias("ok")))
query("post_issues")(lambda s, sf: drafts(s, sf).select("doc_id", F.array_join(C.post_issues(F.concat("draft", F.lit(" “a quote that is nowhere at all” 77 #Tag")), "corpus"), " | ").alias("issues")))
_ht = "list_transform(list_filter(regexp_split_to_array(title, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(substring(w, 1, 1)) || substring(w, 2))"
query("hashtags", f"WITH st AS ({T.SQL_STORIES}), t AS (SELECT story_id, '#' || array_to_string(list_slice({_ht}, 1, 3), '') AS tag FROM st) SELECT story_id, CASE WHEN length(tag) BETWEEN 4 AND 26 THEN tag ELSE '' END AS tags FROM t")(
    lambda s, sf: T.stories(s, sf).select("story_id", F.array_join(C.hashtags(F.array(F.array_join(F.slice(F.filter(F.split("title", "[^A-Za-z0-9]+", -1), lambda w: w != ""), 1, 3), " ")), 5), " ").alias("tags")))

# ---- readability and search texts ---------------------------------------------------------------------------------------
_para = "p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents)"
query("readability_stats", f"WITH {_para}, s AS (SELECT doc_id, {Q.words('p')} AS w, list_filter({_sents('p')}, lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> '') AS s FROM p), "
      f"g AS (SELECT doc_id, CAST(sum(len(s)) AS BIGINT) AS sentences, CAST(sum(len(list_filter(s, lambda x: {Q.words('x')} > 20 AND NOT regexp_matches(x, '[\"“”]')))) AS BIGINT) AS long_sentences, max(w) AS max_paragraph_words FROM s GROUP BY 1) "
      "SELECT *, CASE WHEN sentences > 0 THEN CAST(floor(long_sentences * 100 / sentences + 0.5) AS BIGINT) ELSE 0 END AS long_percent FROM g")(
    lambda s, sf: V.readability_stats(T.table(s, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("paras")).filter(F.size("paras") > 0), "doc_id", "paras"))
_PHR = ["attion", "the", "elle de", "thanedble"]
_cnt = lambda p: f"CAST((length(lower(text)) - length(replace(lower(text), '{p}', ''))) / {len(p)} AS BIGINT)"
query("keyphrase_best", "WITH c AS (" + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS phrase, {i} AS i, {_cnt(p)} AS n FROM documents" for i, p in enumerate(_PHR)) + ") SELECT doc_id, phrase, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1")(
    lambda s, sf: V.keyphrase_best(T.table(s, sf, "documents"), "doc_id", "text", _PHR))


def digest_texts(s, sf):
    se, dr, fr = DT.sections(s, sf), DT.drafts(s, sf), DT.frames(s, sf)
    j = se.join(dr, ["digest_id", "section_id"], "left").groupBy("digest_id").agg(F.array_sort(F.collect_list(F.struct("section_id", "title", F.coalesce(F.array_join("paragraphs", " "), F.lit("")).alias("body")))).alias("s"))
    return fr.join(j, "digest_id").select("digest_id", "headline", "summary", "opening", "watch", F.transform("s", lambda x: F.struct(x["title"].alias("heading"), x["body"].alias("body"))).alias("sections"))


query("seo_fallback")(lambda s, sf: V.seo_fallback(digest_texts(s, sf).withColumn("headings", F.transform("sections", lambda x: x["heading"]))))


@query("seo_checks")
def seo_checks(s, sf):
    d = digest_texts(s, sf).withColumn("headings", F.transform("sections", lambda x: x["heading"]))
    f = V.seo_fallback(d).withColumn("secondary", F.filter(F.split("secondary", r"\|", -1), lambda x: x != ""))
    body = F.concat_ws(" ", F.array_join(F.transform("sections", lambda x: x["body"]), " "), "summary")
    j = f.join(d.select("digest_id", "headline", F.concat_ws(" ", "summary", "opening").alias("intro"), body.alias("body")), "digest_id")
    return V.seo_checks(j)


@query("watch_bad_count")
def watch_bad_count(s, sf):
    corp = D.source_corpus(DT.section_stories(s, sf), T.stories(s, sf), articles(s, sf), top=None).groupBy("digest_id").agg(F.array_join(F.collect_list("corpus"), " ").alias("corpus"))
    return V.watch_bad_count(DT.frames(s, sf), corp, "digest_id")


query("flagged_sentences")(lambda s, sf: V.flagged_sentences(drafts(s, sf).select("doc_id", F.split("draft", "\n", -1).alias("paragraphs"), F.lit("").alias("reading")), ["doc_id"]))

# ---- places ------------------------------------------------------------------------------------------------------------
_PLACE = "text || CASE WHEN doc_id % 3 = 0 THEN ' Talks in Paris and Berlin, Berlin; the French side. BBC News, Iran''s envoy in the U.S. Congress.' WHEN doc_id % 3 = 1 THEN ' China China China China China and the ECB, the EU and Texas oil.' ELSE ' Nothing here.' END"
_gz = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS place, CAST(least(4, len(regexp_extract_all(low, '(?:^|[^a-z])(?:{p})(?:[^a-z]|$)'))) AS DOUBLE) AS score FROM t" for n, p in PL.GAZETTEER)
query("gazetteer_match", f"WITH t AS (SELECT doc_id, ' ' || regexp_replace(regexp_replace(lower({_PLACE}), '[’'']s\\b', '', 'g'), '{PL.OUTLET_NAMES_RE}', ' ', 'g') || ' ' AS low FROM documents), g AS ({_gz}) SELECT doc_id, place, sum(score) AS score FROM g WHERE score > 0 GROUP BY 1, 2")(
    lambda s, sf: PL.gazetteer_match(T.table(s, sf, "documents").selectExpr("doc_id", f"{_PLACE.replace(chr(39) * 2 + 's', chr(92) + chr(39) + 's')} AS text"), ["doc_id"], "text"))
query("place_ranking")(lambda s, sf: PL.place_ranking(digest_texts(s, sf).withColumn("headline", F.concat("headline", F.lit(" Paris talks, U.S. Congress and Texas")))))

# ---- scanned text ---------------------------------------------------------------------------------------------------------
# slips planted in the lines and the dictionary that mends them
OCR_WORDS = {"arnount": "amount", "Tota1": "Total", "0rder": "Order", "invoíce": "invoice", "nurnber": "number", "Ränla": "Ränta"}
_OCR = "text || ' $ 12 and S 4 arnount Tota1 0rder invoíce nurnbers nurnber Ränla S500 x'"
_fix = f"regexp_replace({_OCR}, '[$S]\\s{{0,2}}(\\d{{1,2}})\\b', '§\\1', 'g')"
for _b, _g in OCR_WORDS.items():
    _fix = f"regexp_replace({_fix}, '\\b{_b}\\b', '{_g}', 'g')"
query("ocr_line_fix", f"SELECT doc_id, {_fix} AS line FROM documents")(
    lambda s, sf: T.table(s, sf, "documents").selectExpr("doc_id", f"{_OCR} AS l").select("doc_id", C.ocr_line_fix("l", OCR_WORDS).alias("line")))
