"""Registered queries of the feed family: items, stories, coverage, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import prices as P
from gristmill.functions import text as TX
from gristmill.functions import urls as U
from gristmill.operators import feeds as FE
from gristmill.plans import sqltext as Q
from gristmill.plans.registry import query
from gristmill.sources import tables as T

AS_OF = T.AS_OF
AT = f"TIMESTAMP '{AS_OF}'"
PROFILE = [
    ("Alpha", 0.5, ["attion", "thanedble", "elle"]),
    ("Beta", 0.3, ["leou", "tion", "thon", "the"]),
    ("Gamma", 0.2, ["eriner", "die der", "absent word"]),
]
TERMS = ["attion", "elle", "éou", "the that", "absent"]
ST = f"st AS (SELECT *, summary AS description FROM ({T.SQL_STORIES}))"
S = f"WITH {ST}"


def stories(spark, sf):
    return T.stories(spark, sf)


def items(spark, sf):
    """Feed items: stories under their item names."""
    return stories(spark, sf).select(
        "story_id", "title", F.col("url").alias("link"), F.col("source").alias("author"), F.col("summary").alias("description"),
        F.when(F.col("story_id") % 5 != 0, F.col("published_at")).alias("pub_date"), "redirect", "readable", F.col("source").alias("feed"), "lane")


# ---- scalars ------------------------------------------------------------------------------------------------------
def scalar(name, spark_expr, sql_expr, src="st"):
    query(name, f"{S} SELECT story_id, {sql_expr} AS value FROM st" if sql_expr else None)(
        lambda s, sf: stories(s, sf).select("story_id", spark_expr().alias("value")))


_toks = lambda x: f"array_to_string({Q.tokens(x)}, ' ')"
scalar("tokenize", lambda: F.array_join(TX.raw_tokens("title"), " "), _toks("title"))
scalar("sig_tokens", lambda: F.array_join(F.array_sort(TX.sig_tokens("title")), " "),
       f"array_to_string(list_sort(list_distinct(list_filter({Q.tokens('title')}, lambda w: length(w) >= 4))), ' ')")
scalar("clean_title", lambda: TX.clean_title("title"), Q.clean_title("title"))
scalar("title_key", lambda: TX.title_key("title"), Q.title_key("title"))
scalar("clean_url", lambda: U.clean_url("url"), Q.clean_url("url"))
scalar("host_of", lambda: U.host_of("url"), Q.host("url"))
scalar("root_host", lambda: U.root_host(U.host_of("url")), Q.root_host(Q.host("url")))
scalar("shorten", lambda: TX.shorten("summary", 60), Q.shorten("summary", 60))
scalar("thin_url_filter", lambda: U.is_thin_url("url"), f"regexp_matches(url, '{U.THIN_URL_RE}')")
scalar("soft_story_filter", lambda: FE.soft_story(F.concat("title", F.when(F.col("story_id") % 9 == 0, F.lit(" Film Festival")).otherwise(""))),
       f"regexp_matches(title || CASE WHEN story_id % 9 = 0 THEN ' Film Festival' ELSE '' END, '{FE.SOFT_RE}')")
_mf = Q.collapse("coalesce(summary, '')")
_cut = f"substring({_mf}, 1, 150)"
_at = lambda sep: f"CASE WHEN contains({_cut}, '{sep}') THEN length({_cut}) - instr(reverse({_cut}), '{sep[::-1]}') - {len(sep) - 1} ELSE -1 END"
_word = f"CASE WHEN {_at(' ')} > 90 THEN substring({_cut}, 1, {_at(' ')}) ELSE {_cut} END"
scalar("meta_fit", lambda: TX.meta_fit("summary"), f"CASE WHEN length({_mf}) <= 150 THEN {_mf} WHEN greatest({_at('. ')}, {_at('; ')}) > 90 THEN substring({_cut}, 1, greatest({_at('. ')}, {_at('; ')}) + 1) "
       f"ELSE regexp_replace({_word}, '[,;:\\s]+$', '') || '…' END")
_h = f"(epoch_us({AT}) - epoch_us(published_at)) / 3.6e9"
scalar("age_hours", lambda: F.round(FE.age_hours("published_at", AS_OF), 6), f"round({_h}, 6)")


def age_label(when, as_of):
    h = FE.age_hours(when, as_of)
    return F.when(h.isNull(), "").when(h < 1, "under 1 h old").when(h < 48, F.concat(F.floor(h + 0.5).cast("string"), F.lit(" h old"))).otherwise(
        F.concat(F.floor(h / 24 + 0.5).cast("string"), F.lit(" days old")))


def daypart(when):
    hour = F.hour(when)
    return F.when(hour < 11, "Morning").when(hour < 17, "Afternoon").otherwise("Evening")


def day_label(when):
    return F.date_format(when, "EEE, d MMMM")


scalar("age_label", lambda: age_label("published_at", AS_OF),
       f"CASE WHEN {_h} < 1 THEN 'under 1 h old' WHEN {_h} < 48 THEN CAST(CAST(floor({_h} + 0.5) AS BIGINT) AS VARCHAR) || ' h old' ELSE CAST(CAST(floor({_h} / 24 + 0.5) AS BIGINT) AS VARCHAR) || ' days old' END")
scalar("daypart", lambda: daypart("published_at"), "CASE WHEN hour(published_at) < 11 THEN 'Morning' WHEN hour(published_at) < 17 THEN 'Afternoon' ELSE 'Evening' END")
scalar("day_label", lambda: day_label("published_at"), "strftime(published_at, '%a, %-d %B')")
scalar("same_day", lambda: F.to_date("published_at") == F.to_date(F.lit("2024-01-08")), "CAST(published_at AS DATE) = DATE '2024-01-08'")
query("iso_duration_seconds", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 5) * 3600 + (event_id % 60) * 60 WHEN event_id % 3 = 1 THEN event_id % 90 ELSE 0 END AS seconds FROM events")(
    lambda s, sf: T.table(s, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 3 = 0 THEN concat('PT', event_id % 5, 'H', event_id % 60, 'M') WHEN event_id % 3 = 1 THEN concat('PT', event_id % 90, 'S') ELSE 'none' END AS d")
    .select("event_id", P.iso_duration_seconds("d").alias("seconds")))
query("duration_average", "SELECT CAST(floor(avg(CASE WHEN d > 0 THEN d END) + 0.5) AS BIGINT) AS average_seconds FROM (SELECT CASE WHEN event_id % 3 = 0 THEN (event_id % 5) * 3600 + (event_id % 60) * 60 WHEN event_id % 3 = 1 THEN event_id % 90 ELSE 0 END AS d FROM events)")(
    lambda s, sf: FE.duration_average(T.table(s, sf, "events").selectExpr("CASE WHEN event_id % 3 = 0 THEN (event_id % 5) * 3600 + (event_id % 60) * 60 WHEN event_id % 3 = 1 THEN event_id % 90 ELSE 0 END AS d"), "d"))

# ---- projections and filters -----------------------------------------------------------------------------------------
query("feed_item_normalize", f"{S} SELECT story_id, {Q.collapse('title')} AS title, url AS link, source AS author, substring({Q.collapse('description')}, 1, 300) AS description, "
      f"CASE WHEN story_id % 5 <> 0 THEN published_at ELSE {AT} END AS pub_date FROM st")(
    lambda s, sf: FE.feed_item_normalize(
        items(s, sf).withColumn("title", F.concat(F.lit("<b> "), F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("</b>\n"))).withColumn("description", F.replace(F.col("description"), F.lit("&"), F.lit("&#38;"))), AS_OF)
    .select("story_id", "title", "link", "author", "description", "pub_date"))
query("unwrap_redirect_url", f"{S} SELECT story_id, CASE WHEN story_id % 4 = 3 THEN 'https://agg.example.com/click?id=' || CAST(story_id AS VARCHAR) ELSE url END AS link, "
      "CASE WHEN story_id % 2 = 0 THEN CASE WHEN story_id % 4 = 3 THEN 'agg.example.com' ELSE regexp_extract(url, '://([^/?#:]+)', 1) END ELSE source END AS source, story_id % 4 = 3 AS redirect FROM st")(
    lambda s, sf: FE.unwrap_redirect_url(stories(s, sf).select(
        "story_id", F.when(F.col("story_id") % 4 == 3, F.concat(F.lit("https://agg.example.com/click?id="), F.col("story_id").cast("string")))
        .otherwise(F.concat(F.lit("https://agg.example.com/click?x=1&url="), F.url_encode("url"))).alias("link"),
        F.when(F.col("story_id") % 2 == 0, "").otherwise(F.col("source")).alias("source"), "redirect")))
_tail = "list_extract(string_split(title, ' - '), -1)"
query("story_project", f"{S} SELECT story_id, title, substring({Q.collapse('description')}, 1, 400) AS summary, url AS link, CASE WHEN story_id % 3 = 0 THEN coalesce(nullif({_tail}, ''), 'News') ELSE source END AS source, "
      f"'publisher' AS source_type, CASE WHEN readable IN ('open', 'metered') AND regexp_matches(url, '{U.THIN_URL_RE}') THEN 'thin' ELSE readable END AS readable, redirect FROM st")(
    lambda s, sf: FE.story_project(items(s, sf).withColumn("author", F.when(F.col("story_id") % 3 == 0, "").otherwise(F.col("author"))))
    .select("story_id", "title", "summary", "link", "source", "source_type", "readable", "redirect"))
query("story_compact", f"{S} SELECT story_id, title, source, url, substring(summary, 1, 300) AS summary, published_at, readable FROM st")(lambda s, sf: FE.story_compact(stories(s, sf)))
_term = lambda t: f"CASE WHEN regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){t.lower()}([^\\p{{L}}\\p{{N}}]|$)') THEN 1 ELSE 0 END"
HITS = f"low AS (SELECT *, lower(title || ' ' || description) AS low FROM st), hit AS (SELECT *, {' + '.join(_term(t) for t in TERMS)} AS hits FROM low)"


def hits(s, sf):
    df = stories(s, sf).withColumn("description", F.col("summary"))
    return FE.term_filter(df, TERMS)


query("term_filter", f"{S}, {HITS} SELECT story_id, hits FROM hit WHERE hits > 0")(lambda s, sf: hits(s, sf).select("story_id", "hits"))
_tl = Q.collapse("regexp_replace(p, '[^\\p{L}\\p{N}\\s\\-]', ' ', 'g')")
query("term_list_parse", f"{S}, q AS (SELECT story_id, regexp_replace(title, ' ', ' or ', 'g') AS q FROM st), l AS (SELECT story_id, list_filter(list_transform(string_split(regexp_replace(q, '(?i)\\s+or\\s+', chr(1), 'g'), chr(1)), lambda p: {_tl}), lambda p: length(p) >= 3) AS l FROM q), "
      "u AS (SELECT story_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM l), f AS (SELECT story_id, t, min(i) AS i FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY i) AS n FROM f) "
      "SELECT l.story_id, coalesce(string_agg(r.t, '|' ORDER BY r.i), '') AS terms FROM l LEFT JOIN r ON r.story_id = l.story_id AND n <= 6 GROUP BY l.story_id")(
    lambda s, sf: stories(s, sf).select("story_id", F.array_join(FE.term_list(F.replace("title", F.lit(" "), F.lit(" or "))), "|").alias("terms")))
query("recency_filter", f"{S} SELECT story_id FROM st WHERE published_at >= {AT} - INTERVAL 5 DAY")(lambda s, sf: FE.recency_filter(stories(s, sf), AS_OF).select("story_id"))
query("breaking_filter", f"{S} SELECT story_id, lane FROM st WHERE lane <> 'breaking' OR {_h} <= 40")(lambda s, sf: FE.breaking_filter(stories(s, sf), AS_OF).select("story_id", "lane"))
query("paywall_filter", f"SELECT page_id, regexp_matches({Q.host('url')}, '(^|\\.)(wsj\\.com|ft\\.com|bloomberg\\.com|economist\\.com|barrons\\.com)$') OR (length(html) < 1500 AND regexp_matches(html, '{U.PAYWALL_TEXT_RE}')) AS paywalled FROM pages_x".replace(
      "FROM pages_x", "FROM (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'https://www.ft.com/a' ELSE url END AS url, CASE WHEN page_id % 5 = 0 THEN html || 'Already a subscriber?' ELSE html END AS html FROM pages)"))(
    lambda s, sf: T.table(s, sf, "pages").select("page_id", F.when(F.col("page_id") % 6 == 0, "https://www.ft.com/a").otherwise(F.col("url")).alias("url"),
                                                   F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("Already a subscriber?"))).otherwise(F.col("html")).alias("html"))
    .select("page_id", U.is_paywalled("url", "html").alias("paywalled")))
MARKS = f"marks AS (SELECT coalesce(nullif({Q.clean_url('url')}, ''), title) AS story_key, {AT} - to_hours(CAST(story_id % 48 AS BIGINT)) AS t FROM st WHERE story_id % 10 = 3)"


def marks(s, sf):
    st = stories(s, sf).filter("story_id % 10 = 3")
    return st.select(FE.unusable_key().alias("story_key"), (F.unix_seconds(FE.ts(AS_OF)) - F.col("story_id") % 48 * 3600).cast("timestamp").alias("t"))


_LIVE = f"live AS (SELECT DISTINCT story_key FROM marks WHERE t > {AT} - INTERVAL 24 HOUR), ok AS (SELECT * FROM st WHERE coalesce(nullif({Q.clean_url('url')}, ''), title) NOT IN (SELECT story_key FROM live))"
query("unusable_antijoin", f"{S}, {MARKS}, {_LIVE} SELECT story_id FROM ok")(lambda s, sf: FE.unusable_antijoin(stories(s, sf), marks(s, sf), AS_OF).select("story_id"))
query("readable_filter", f"{S}, {MARKS}, {_LIVE} SELECT story_id FROM ok WHERE readable NOT IN ('paywalled', 'thin') AND NOT redirect")(
    lambda s, sf: FE.readable_filter(stories(s, sf), marks(s, sf), AS_OF).select("story_id"))
_r = lambda part, n: f"row_number() OVER (PARTITION BY {part} ORDER BY story_id) AS {n}"
query("first_wins_dedupe", f"{S}, k AS (SELECT story_id, {Q.title_key('title')} AS tk, {Q.clean_url('url')} AS u FROM st), a AS (SELECT *, {_r('tk', 'n1')} FROM k), b AS (SELECT *, {_r('u', 'n2')} FROM a WHERE n1 = 1) SELECT story_id FROM b WHERE n2 = 1")(
    lambda s, sf: FE.first_wins_dedupe(stories(s, sf), "story_id").select("story_id"))
query("per_feed_cap", f"{S}, r AS (SELECT story_id, source, {_r('source', 'n')} FROM st) SELECT story_id, source FROM r WHERE n <= 40")(
    lambda s, sf: FE.per_feed_cap(stories(s, sf), 40, "source").select("story_id", "source"))
query("feed_sort", f"{S}, {HITS} SELECT story_id, hits, published_at FROM hit WHERE hits > 0 ORDER BY hits DESC, published_at DESC, story_id LIMIT 60")(
    lambda s, sf: FE.feed_sort(hits(s, sf)).select("story_id", "hits", "published_at"))
query("lane_union", f"{S} SELECT story_id, lane FROM st")(
    lambda s, sf: FE.lane_union(*[stories(s, sf).filter(F.col("lane") == n).drop("lane") for n in ("publisher", "search", "breaking")]).select("story_id", "lane"))

# ---- matching, coverage, score -----------------------------------------------------------------------------------------
_has = lambda t: f"regexp_matches(txt, '(^|[^a-z0-9]){t.lower()}([^a-z0-9]|$)')"
_pts = " + ".join(f"CASE WHEN {_has(t)} THEN {w} * 10 ELSE 0 END" for _, w, sig in PROFILE for t in sig)
_mt = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(_has(t) for t in sig)} THEN '{n}' END" for n, _, sig in PROFILE) + "], lambda x: x IS NOT NULL)"
MATCH = f"tx AS (SELECT *, lower(title || ' ' || summary) AS txt FROM st), mt AS (SELECT *, {_pts} AS topic_score, {_mt} AS matched FROM tx)"
query("topic_match", f"{S}, {MATCH} SELECT story_id, round(topic_score, 6) AS topic_score, array_to_string(matched, ',') AS matched FROM mt")(
    lambda s, sf: FE.topic_match(stories(s, sf), PROFILE).select("story_id", F.round("topic_score", 6).alias("topic_score"), F.array_join("matched", ",").alias("matched")))
TOK = f"tk AS (SELECT DISTINCT story_id, source, unnest({Q.tokens(Q.clean_title('title'))}) AS w FROM st), sz AS (SELECT story_id, count(*) AS n FROM tk GROUP BY 1), " \
      "pr AS (SELECT a.story_id AS x, b.story_id AS y, count(*) AS c FROM tk a JOIN tk b ON a.w = b.w AND a.story_id <> b.story_id GROUP BY 1, 2)"
COV = f"{TOK}, near AS (SELECT x, y FROM pr JOIN sz a ON a.story_id = x JOIN sz b ON b.story_id = y WHERE a.n >= 3 AND b.n >= 3 AND c >= 3 AND c / least(a.n, b.n) >= 0.55), " \
      "outs AS (SELECT st.story_id, lower(st.source) AS o FROM st UNION SELECT x, lower(st.source) FROM near JOIN st ON st.story_id = y), cov AS (SELECT story_id, count(DISTINCT o) AS coverage FROM outs GROUP BY 1)"
query("coverage", f"{S}, {COV} SELECT story_id, coverage FROM cov")(lambda s, sf: FE.coverage(stories(s, sf)).select("story_id", "coverage"))
SCORE = f"{MATCH}, {COV}, sc AS (SELECT mt.*, cov.coverage, round(topic_score + CASE WHEN {_h} < 6 THEN 4 WHEN {_h} < 24 THEN 2 ELSE 0 END + CASE WHEN readable = 'open' THEN 3 ELSE 0 END + least(coverage, 6) * 1.2, 6) AS score FROM mt JOIN cov USING (story_id))"


def scored(s, sf):
    return FE.story_score(FE.coverage(FE.topic_match(stories(s, sf), PROFILE)), AS_OF)


query("story_score", f"{S}, {SCORE} SELECT story_id, score FROM sc")(lambda s, sf: scored(s, sf).select("story_id", "score"))
query("top_stories", f"{S}, {SCORE} SELECT * FROM (SELECT story_id, lane, score, coverage FROM sc WHERE lane <> 'breaking' ORDER BY score DESC, story_id LIMIT 48) UNION ALL "
      "SELECT * FROM (SELECT story_id, lane, score, coverage FROM sc WHERE lane = 'breaking' AND coverage >= 3 ORDER BY coverage DESC, score DESC, story_id LIMIT 12)")(
    lambda s, sf: FE.top_stories(scored(s, sf)).select("story_id", "lane", "score", "coverage"))
query("feed_view_sort", f"{S} SELECT story_id, source, published_at FROM st ORDER BY published_at DESC, story_id")(
    lambda s, sf: FE.feed_view_sort(stories(s, sf), "new").select("story_id", "source", "published_at"))
_read = "readable NOT IN ('paywalled', 'thin') AND NOT redirect"
query("feed_overview", f"{S}, {MATCH}, t AS (SELECT count(*) AS n, count(DISTINCT source) AS o, count(*) FILTER (WHERE {_read}) AS r, count(*) FILTER (WHERE {_h} <= 24) AS f, count(*) FILTER (WHERE len(matched) = 0) AS u FROM mt), "
      "tp AS (SELECT name, count(*) FILTER (WHERE list_contains(matched, name)) AS c FROM mt, (VALUES ('Alpha'), ('Beta'), ('Gamma')) AS v(name) GROUP BY name), "
      "ou AS (SELECT source, count(*) AS c FROM st GROUP BY 1 ORDER BY c DESC, source LIMIT 10), ou2 AS (SELECT *, row_number() OVER (ORDER BY c DESC, source) AS rn FROM ou) "
      "SELECT 'total' AS section, 'stories' AS name, n, 1.0 AS share, false AS advice FROM t UNION ALL SELECT 'total', 'outlets', o, round(o / n, 6), false FROM t UNION ALL SELECT 'total', 'readable', r, round(r / n, 6), r / n < 0.5 FROM t "
      "UNION ALL SELECT 'total', 'fresh', f, round(f / n, 6), false FROM t UNION ALL SELECT 'topic', '(none)', u, round(u / n, 6), u / n > 0.5 FROM t UNION ALL SELECT 'topic', name, c, round(c / n, 6), c <= 1 FROM tp, t "
      "UNION ALL SELECT 'outlet', source, c, round(c / n, 6), rn = 1 AND c / n > 0.4 FROM ou2, t")(
    lambda s, sf: FE.feed_overview(FE.topic_match(stories(s, sf), PROFILE), PROFILE, AS_OF))
query("vocabulary_topics", f"{S}, w AS (SELECT unnest({Q.tokens('title')}) AS term, 2 AS w FROM st UNION ALL SELECT unnest({Q.tokens('substring(summary, 1, 200)')}), 1 FROM st), "
      "t AS (SELECT term, sum(w)::BIGINT AS weight FROM w GROUP BY 1 ORDER BY weight DESC, term LIMIT 24), r AS (SELECT *, row_number() OVER (ORDER BY weight DESC, term) AS rk FROM t), "
      "g AS (SELECT substring(term, 1, 3) AS stem, sum(weight)::BIGINT AS weight, min(rk) AS f, list(term ORDER BY rk) AS l FROM r GROUP BY 1 ORDER BY weight DESC, f LIMIT 3) "
      "SELECT upper(substring(l[1], 1, 1)) || substring(l[1], 2) AS name, weight, array_to_string(list_transform(l[2:4], lambda x: upper(substring(x, 1, 1)) || substring(x, 2)), ',') AS subtopics, array_to_string(l[1:6], ',') AS signals FROM g")(
    lambda s, sf: FE.vocabulary_topics(stories(s, sf)))
_pulse = f"p AS (SELECT *, {Q.title_key('title', 50)} AS k FROM st QUALIFY row_number() OVER (PARTITION BY {Q.title_key('title', 50)} ORDER BY story_id) = 1), pt AS (SELECT source, lower({Q.clean_title('title')} || ' ' || summary) AS txt FROM p WHERE k <> '')"
query("pulse_heat", f"{S}, {_pulse} " + " UNION ALL ".join(f"SELECT '{n}' AS topic, count(*) AS headlines, count(DISTINCT lower(source)) AS outlets FROM pt WHERE {' OR '.join(_has(t) for t in sig)}" for n, _, sig in PROFILE))(
    lambda s, sf: FE.pulse_heat(FE.pulse_headlines(stories(s, sf)), PROFILE))
query("build_topic_queries", f"{S}, src AS (SELECT story_id % 3 AS topic_no, CAST(floor(story_id / 3) AS BIGINT) AS pos, list_extract({Q.tokens('title')}, 1) AS s0 FROM st), sg AS (SELECT topic_no, pos, trim(s0) AS s FROM src WHERE length(trim(s0)) >= 3), "
      "u AS (SELECT lower(s) AS k, min((pos, topic_no, s)) AS f FROM sg GROUP BY 1), r AS (SELECT f[1] AS pos, f[2] AS topic_no, f[3] AS s, row_number() OVER (ORDER BY f[1], f[2]) AS rn FROM u) "
      "SELECT CAST(floor((rn - 1) / 2) AS INT) AS query_no, string_agg(s, ' OR ' ORDER BY rn) AS q FROM r WHERE rn <= 8 GROUP BY 1")(
    lambda s, sf: _topic_queries(s, sf))


def _topic_queries(s, sf):
    """Signals per topic: the first token of every third title. Kept as rows, not as one array per topic."""
    st = stories(s, sf)
    sig = st.select((F.col("story_id") % 3).alias("topic_no"), F.floor(F.col("story_id") / 3).alias("pos"), F.get(TX.raw_tokens("title"), F.lit(0)).alias("s"))
    return FE.queries_from_signals(sig.filter("s is not null"))


_CODES = "CASE event_id % 9 WHEN 0 THEN 'http_403' WHEN 1 THEN 'http_404' WHEN 2 THEN 'http_500' WHEN 3 THEN 'paywalled' WHEN 4 THEN 'too_short' WHEN 5 THEN '' WHEN 6 THEN 'not_html' WHEN 7 THEN 'timeout' ELSE 'redirect_link' END"
query("fetch_error_reason", f"SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'the publisher blocks automated readers (403)' WHEN 1 THEN 'the page no longer exists (404)' WHEN 2 THEN 'the publisher answered 500' WHEN 3 THEN 'the article is behind a paywall' "
      "WHEN 4 THEN 'the page has no readable article text (live page, video, or text drawn by script)' WHEN 5 THEN '' WHEN 6 THEN 'the link is not a web page' WHEN 7 THEN 'the page could not be fetched (timeout)' ELSE 'it is an aggregator link that could not be resolved to the publisher' END AS reason FROM events")(
    lambda s, sf: T.table(s, sf, "events").selectExpr("event_id", f"{_CODES} AS code").select("event_id", FE.fetch_error_reason("code").alias("reason")))


@query("feed_stats", f"{S}, {HITS}, reg AS (SELECT DISTINCT source AS feed, 'open' AS access FROM st UNION ALL SELECT 'missing', 'metered'), m AS (SELECT source, count(*) AS c FROM hit WHERE hits > 0 GROUP BY 1), n AS (SELECT source, count(*) AS c FROM st GROUP BY 1) "
       "SELECT feed, access, n.c IS NOT NULL AS ok, CASE WHEN n.c IS NULL THEN 0 ELSE 200 END AS code, coalesce(n.c, 0) AS items, coalesce(m.c, 0) AS matched, '' AS error FROM reg LEFT JOIN n ON n.source = feed LEFT JOIN m ON m.source = feed")
def feed_stats(s, sf):
    st = stories(s, sf)
    feeds = st.select(F.col("source").alias("feed")).distinct()
    registry = feeds.withColumn("access", F.lit("open")).unionByName(s.createDataFrame([("missing", "metered")], "feed string, access string"))
    fetched = feeds.select("feed", F.lit(True).alias("ok"), F.lit(200).alias("code"), F.lit("").alias("error"))
    return FE.feed_stats(registry, fetched, st.withColumn("feed", F.col("source")), hits(s, sf).withColumn("feed", F.col("source"))).fillna(0, ["code"])


# ---- related -----------------------------------------------------------------------------------------------------------
_rel = "(c >= 3 OR (c >= 2 AND c / least(a.n, b.n) >= 0.5))"
REL = f"{TOK}, rl AS (SELECT x, y, c FROM pr JOIN sz a ON a.story_id = x JOIN sz b ON b.story_id = y WHERE {_rel}), rk AS (SELECT x AS story_id, y AS other_id, c AS shared, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS rank FROM rl)"
query("related_stories", f"{S}, {REL} SELECT * FROM rk WHERE rank <= 8")(lambda s, sf: FE.related_stories(stories(s, sf), 8))
_hostid = Q.root_host(Q.host("url"))
SEC = (f"hs AS (SELECT story_id, {_hostid} AS h, lower(source) AS o, readable, regexp_matches(url, '{U.THIN_URL_RE}') AS thin FROM st), "
       f"tk AS (SELECT DISTINCT story_id, unnest(list_filter({Q.tokens(Q.clean_title('title'))}, lambda w: length(w) >= 4)) AS w FROM st), sz AS (SELECT story_id, count(*) AS n FROM tk GROUP BY 1), "
       "pr AS (SELECT a.story_id AS x, b.story_id AS y, count(*) AS c FROM tk a JOIN tk b ON a.w = b.w AND a.story_id <> b.story_id GROUP BY 1, 2), "
       f"cd AS (SELECT x, y, c, q.o FROM pr JOIN sz a ON a.story_id = x JOIN sz b ON b.story_id = y JOIN hs p ON p.story_id = x JOIN hs q ON q.story_id = y WHERE a.n >= 3 AND {_rel} AND q.readable = 'open' AND NOT q.thin AND p.h <> q.h AND p.o <> q.o)")
query("second_outlet", f"{S}, {SEC}, rk AS (SELECT x AS story_id, y AS other_id, c AS shared, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS rank FROM cd) SELECT * FROM rk WHERE rank <= 3")(
    lambda s, sf: FE.second_outlet(stories(s, sf)))
query("corroborate_candidates", f"{S}, {SEC}, one AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY x, o ORDER BY c DESC, y) = 1), rk AS (SELECT x AS story_id, y AS other_id, c AS shared, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS rank FROM one) SELECT * FROM rk WHERE rank <= 3")(
    lambda s, sf: FE.second_outlet(stories(s, sf), per_outlet=1))
_art = "story_id % 3 <> 1"
query("resolve_source", f"{S}, {REL}, sec AS (WITH {SEC} SELECT x AS story_id, y AS sid, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS rank FROM cd), "
      "al AS (SELECT rk.story_id, arg_min(other_id, rank) AS sid FROM rk JOIN st o ON o.story_id = other_id WHERE rank <= 8 AND o.readable = 'open' AND NOT o.redirect GROUP BY 1), "
      "ev AS (SELECT story_id, story_id AS sid, 0 AS p, 'direct' AS via FROM st WHERE readable NOT IN ('paywalled', 'thin') UNION ALL SELECT story_id, sid, 1, 'alternative' FROM al UNION ALL SELECT story_id, sid, rank + 1, 'alternative' FROM sec WHERE rank <= 3) "
      "SELECT story_id, arg_min(via, p) AS via, arg_min(sid, p) AS source_story_id FROM ev WHERE sid % 3 <> 1 GROUP BY story_id")(
    lambda s, sf: FE.resolve_source(stories(s, sf), stories(s, sf).filter(_art).select("story_id")))
query("event_groups", f"{S.replace('WITH ', 'WITH RECURSIVE ', 1)}, u AS (SELECT * FROM (SELECT story_id, coalesce(nullif(source, ''), CAST(story_id AS VARCHAR)) AS outlet, list_distinct({Q.tokens(Q.clean_title('title'))}) AS t FROM st) WHERE len(t) >= 2), "
      "e AS (SELECT story_id, len(t) AS n, unnest(t) AS w FROM u), p AS (SELECT a.story_id AS a, b.story_id AS b FROM e a JOIN e b ON a.w = b.w AND a.story_id <> b.story_id GROUP BY a.story_id, b.story_id, a.n, b.n HAVING 5 * count(*) >= 2 * greatest(3, least(a.n, b.n))), "
      "reach(x, y) AS (SELECT story_id, story_id FROM u UNION SELECT x, b FROM reach JOIN p ON a = y), g AS (SELECT x AS story_id, min(y) AS group_id FROM reach GROUP BY x), "
      "z AS (SELECT group_id, count(*) AS stories, count(DISTINCT outlet) AS outlets FROM g JOIN u USING (story_id) GROUP BY 1) SELECT story_id, group_id, stories, outlets FROM g JOIN z USING (group_id) WHERE stories >= 2 AND outlets >= 2")(
    lambda s, sf: FE.event_groups(stories(s, sf)))
query("site_sample", f"WITH p AS (SELECT page_id, {Q.host('url')} AS site, substring({Q.collapse('regexp_extract(html, chr(60) || ' + chr(39) + '(?is)title[^>]*>(.*?)</title>' + chr(39) + ', 1)')}, 1, 120) AS title FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM p) SELECT site, page_id, title FROM r WHERE n <= 15"
      .replace("regexp_extract(html, chr(60) || '(?is)title[^>]*>(.*?)</title>', 1)", "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))(
    lambda s, sf: FE.site_sample(T.table(s, sf, "pages")).select("site", "page_id", "title"))
