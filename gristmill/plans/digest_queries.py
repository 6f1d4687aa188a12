"""Registered queries of the digest family."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import text as TX
from gristmill.operators import digests as D
from gristmill.operators import feeds as FE
from gristmill.plans import sqltext as Q
from gristmill.plans.feed_queries import _h  # age of a story in hours, as SQL text
from gristmill.plans.registry import query
from gristmill.sources import digest_tables as DT
from gristmill.sources import tables as T

AS_OF, CUR = T.AS_OF, 7
B = f"WITH {DT.SQL}"
_key_u, _key_t = Q.clean_url("url"), Q.title_key("title")
KEYS = f"keys AS (SELECT story_id, 0 AS pos, 'u:' || {_key_u} AS key FROM st WHERE {_key_u} <> '' UNION ALL SELECT story_id, 1, 't:' || {_key_t} FROM st WHERE length({_key_t}) > 12)"
USAGE = f"{KEYS}, um AS (SELECT key, arg_max((level, digest_id, section_id), (level, created, -digest_id, -section_id)) AS u FROM (SELECT k.key, m.digest_id, m.section_id, d.created, CASE WHEN w.status = 'done' THEN 2 ELSE 1 END AS level " \
        "FROM section_stories m JOIN keys k USING (story_id) JOIN digests d USING (digest_id) LEFT JOIN drafts w ON w.digest_id = m.digest_id AND w.section_id = m.section_id) GROUP BY key), " \
        "su AS (SELECT story_id, arg_min(u, pos) AS u FROM keys JOIN um USING (key) GROUP BY story_id)"


def tables(s, sf):
    return dict(st=T.stories(s, sf), m=DT.section_stories(s, sf), se=DT.sections(s, sf), dr=DT.drafts(s, sf), fr=DT.frames(s, sf), di=DT.digests(s, sf))


def usage(x):
    return D.usage_map(x["m"], x["st"], x["dr"], x["di"])


def on(fn):
    return lambda s, sf: fn(tables(s, sf))


query("story_usage", f"{B}, {USAGE} SELECT story_id, u[1] AS level, u[2] AS used_in, u[3] AS used_section FROM su")(on(lambda x: D.story_usage(x["st"], usage(x))))
FRESH = f"{USAGE}, fresh AS (SELECT st.* FROM st LEFT JOIN su USING (story_id) WHERE readable NOT IN ('paywalled', 'thin') AND NOT redirect AND NOT coalesce(u[1] = 2 AND u[2] <> {CUR}, false) AND story_id NOT IN (SELECT story_id FROM section_stories WHERE digest_id = {CUR}))"
query("fresh_stories", f"{B}, {FRESH} SELECT story_id FROM fresh")(on(lambda x: D.fresh_stories(x["st"], usage(x), x["m"], CUR).select("story_id")))
query("claim_map", f"{B}, {KEYS} SELECT key, r[1] AS claimed_by, r[2] AS written FROM (SELECT k.key, arg_min((m.digest_id, coalesce(w.status = 'done', false)), (CASE WHEN w.status = 'done' THEN 0 ELSE 1 END, m.digest_id, m.section_id)) AS r FROM section_stories m "
      f"JOIN keys k USING (story_id) JOIN sections s ON s.digest_id = m.digest_id AND s.section_id = m.section_id AND s.included JOIN digests d ON d.digest_id = m.digest_id AND NOT d.pool AND d.digest_id <> {CUR} LEFT JOIN drafts w ON w.digest_id = m.digest_id AND w.section_id = m.section_id GROUP BY key)")(
    on(lambda x: D.claim_map(x["m"], x["st"], x["se"], x["dr"], x["di"], CUR)))
_rt = lambda x: f"list_distinct({Q.tokens(x)})"
query("related_fresh", f"{B}, {FRESH}, bag AS (SELECT s.digest_id, s.section_id, {_rt('s.title || chr(32) || s.thread || chr(32) || h')} AS t FROM sections s JOIN (SELECT digest_id, section_id, string_agg({Q.clean_title('title')}, ' ') AS h FROM section_stories JOIN st USING (story_id) GROUP BY 1, 2) USING (digest_id, section_id)), "
      f"bt AS (SELECT digest_id, section_id, unnest(t) AS w FROM bag), ft AS (SELECT story_id, unnest({_rt(Q.clean_title('title'))}) AS w FROM fresh), fn AS (SELECT story_id, count(*) AS n FROM ft GROUP BY 1), "
      "p AS (SELECT digest_id, section_id, story_id, count(*) AS c FROM bt JOIN ft USING (w) GROUP BY 1, 2, 3) SELECT digest_id, section_id, story_id FROM p JOIN fn USING (story_id) WHERE c >= 3 OR (c >= 2 AND c / n >= 0.5)")(
    on(lambda x: D.related_fresh(D.fresh_stories(x["st"], usage(x), x["m"], CUR), x["se"], x["m"], x["st"])))
query("carry_candidates")(on(lambda x: D.carry_candidates(
    x["m"], x["st"], x["se"], x["dr"], x["di"], D.fresh_stories(x["st"], usage(x), x["m"], CUR), CUR, AS_OF)))
OVER = f"{KEYS}, dk AS (SELECT DISTINCT digest_id, key FROM section_stories JOIN keys USING (story_id)), dn AS (SELECT digest_id, count(*) AS n FROM dk GROUP BY 1), ds AS (SELECT x.digest_id AS a, y.digest_id AS b, count(*) AS shared FROM dk x JOIN dk y ON x.key = y.key AND x.digest_id <> y.digest_id GROUP BY 1, 2)"
query("digest_overlap", f"{B}, {OVER} SELECT a, b, shared, round(shared / least(p.n, q.n), 6) AS overlap FROM ds JOIN dn p ON p.digest_id = a JOIN dn q ON q.digest_id = b WHERE a < b AND shared / least(p.n, q.n) >= 0.35")(
    on(lambda x: D.digest_overlap(x["m"], x["st"])))
_words = "(len(regexp_extract_all(text, '[^" + Q.WS + "]+')) + CASE WHEN signal THEN 5 ELSE 0 END)"
_outl = "(SELECT count(DISTINCT st.source) FROM section_stories z JOIN st USING (story_id) WHERE z.digest_id = w.digest_id AND z.section_id = w.section_id)"
QUAL = (
    f"qs AS (SELECT s.digest_id, s.section_id, s.off_theme, w.status = 'done' AS done, length(w.text) < 1100 AS thin, w.n_numbers, w.n_phrases, w.n_audit, w.stale, w.signal, {_words} AS words, {_outl} AS outlets "
    "FROM sections s LEFT JOIN (SELECT * FROM drafts WHERE status = 'done') w ON w.digest_id = s.digest_id AND w.section_id = s.section_id WHERE s.included), "
    "qg AS (SELECT digest_id, count(*) AS planned, count(*) FILTER (WHERE done) AS n, count(*) FILTER (WHERE thin) AS thin, coalesce(sum(n_numbers), 0) AS nums, coalesce(sum(n_phrases), 0) AS tells, coalesce(sum(n_audit), 0) AS aud, sum(CASE WHEN done THEN words END) AS words, "
    "count(*) FILTER (WHERE done AND signal) AS sig, count(*) FILTER (WHERE done AND outlets < 2) AS single, count(*) FILTER (WHERE done AND stale) AS stale, count(*) FILTER (WHERE done AND off_theme) AS off FROM qs GROUP BY 1), "
    "qq AS (SELECT d.digest_id, CASE WHEN coalesce(n, 0) = 0 THEN NULL ELSE 100 - (least(40, 12 * (planned - n)) + CASE WHEN n < CASE WHEN kind = 'commentary' THEN 2 ELSE 3 END THEN 15 ELSE 0 END + least(20, 10 * thin) + CASE WHEN single / n > 0.5 THEN 15 ELSE 0 END "
    "+ least(24, 8 * nums) + least(12, 4 * tells) + CASE WHEN words / n < 120 THEN 15 ELSE 0 END + CASE WHEN kind <> 'commentary' AND sig / n < 0.6 THEN 12 ELSE 0 END + CASE WHEN g.stale > 0 THEN 10 ELSE 0 END + least(10, 5 * off) + CASE WHEN aud > 3 THEN 5 ELSE 0 END "
    "+ CASE WHEN f.digest_id IS NULL OR f.summary = '' THEN 10 WHEN len(f.watch) < 3 THEN 6 ELSE 0 END + CASE WHEN d.digest_id % 3 = 2 THEN 0 ELSE 8 END + CASE WHEN reviewed THEN 0 ELSE 5 END + 0) END AS before_age, CASE WHEN NOT exported AND age_hours > 36 THEN 5 ELSE 0 END AS age_loss "
    "FROM digests d LEFT JOIN qg g USING (digest_id) LEFT JOIN frames f USING (digest_id) WHERE NOT pool), "
    "qr AS (SELECT *, before_age - age_loss AS raw FROM qq), "
    "ql AS (SELECT digest_id, CAST(coalesce(greatest(0, raw), 0) AS BIGINT) AS score, CASE WHEN raw IS NULL THEN 'none' WHEN raw >= 80 THEN 'ready' WHEN raw >= 60 THEN 'fix' ELSE 'weak' END AS grade, before_age, age_loss FROM qr)"
)


def quality(x, detail=False):
    return D.digest_quality(x["di"], x["se"], x["dr"], x["fr"], AS_OF, detail=detail)


query("digest_quality", f"{B}, {QUAL} SELECT digest_id, score, grade FROM ql")(on(quality))
query("digest_quality_relative", f"{B}, {QUAL}, {OVER}, hit AS (SELECT a AS digest_id, max(CASE WHEN od.exported THEN 30 ELSE 15 END) AS loss FROM ds JOIN dn ON dn.digest_id = a JOIN ql me ON me.digest_id = a JOIN digests md ON md.digest_id = a JOIN ql o ON o.digest_id = b AND o.grade <> 'none' JOIN digests od ON od.digest_id = b "
      "WHERE shared / n >= 0.5 AND (o.score > me.before_age OR (o.score = me.before_age AND od.created > md.created) OR od.exported) GROUP BY 1), "
      "fin AS (SELECT ql.digest_id, grade = 'none' AS nn, CAST(coalesce(greatest(0, before_age - age_loss - coalesce(loss, 0)), 0) AS BIGINT) AS score, loss IS NOT NULL AS repeats FROM ql LEFT JOIN hit USING (digest_id)) "
      "SELECT digest_id, score, CASE WHEN nn THEN 'none' WHEN score >= 80 THEN 'ready' WHEN score >= 60 THEN 'fix' ELSE 'weak' END AS grade, repeats FROM fin")(
    on(lambda x: D.digest_quality_relative(x["di"], quality(x, True), x["m"], x["st"])))
query("weak_digest_filter", f"{B}, {QUAL} SELECT digest_id, score, grade FROM ql JOIN digests USING (digest_id) WHERE grade IN ('weak', 'none') AND NOT exported AND digest_id <> {CUR}")(
    on(lambda x: D.weak_digest_filter(x["di"], quality(x), CUR)))
_RB = B.replace("WITH ", "WITH RECURSIVE ", 1)
query("digest_dup_groups", f"{_RB}, {QUAL}, {OVER}, q AS (SELECT ql.digest_id, score, created, exported FROM ql JOIN digests USING (digest_id) WHERE grade <> 'none' AND NOT pool), "
      "lk AS (SELECT a, b FROM ds JOIN dn p ON p.digest_id = a JOIN dn r ON r.digest_id = b WHERE a IN (SELECT digest_id FROM q) AND b IN (SELECT digest_id FROM q) AND shared / least(p.n, r.n) >= 0.35), "
      "reach(x, y) AS (SELECT digest_id, digest_id FROM q UNION SELECT x, b FROM reach JOIN lk ON a = y), gr AS (SELECT x AS digest_id, min(y) AS group_id FROM reach GROUP BY x), j AS (SELECT * FROM q JOIN gr USING (digest_id)), "
      "best AS (SELECT group_id, arg_max(digest_id, (exported, score, created, -digest_id)) AS keep_id, count(*) AS n FROM j GROUP BY 1) "
      "SELECT digest_id, group_id, digest_id = keep_id AS keep, digest_id <> keep_id AND NOT exported AS \"drop\" FROM j JOIN best USING (group_id) WHERE n > 1")(
    on(lambda x: D.digest_dup_groups(x["m"], x["st"], x["di"], quality(x))))
STATS = "ss AS (SELECT digest_id, count(*) AS sections, count(*) FILTER (WHERE included) AS planned, count(*) FILTER (WHERE included AND w.status = 'done') AS written FROM sections s LEFT JOIN (SELECT digest_id, section_id, status FROM drafts) w USING (digest_id, section_id) GROUP BY 1), sn AS (SELECT digest_id, count(DISTINCT story_id) AS stories FROM section_stories GROUP BY 1), stats AS (SELECT ss.*, stories, sections - planned AS \"left\" FROM ss JOIN sn USING (digest_id))"
query("digest_stats", f"{B}, {STATS} SELECT * FROM stats")(on(lambda x: D.digest_stats(x["m"], x["se"], x["dr"])))
query("commentary_window", f"{B}, {STATS}, since AS (SELECT greatest(coalesce((SELECT max(created) FROM digests WHERE kind = 'commentary' AND NOT pool), TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY), TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY) AS t), "
      "c AS (SELECT digest_id, created FROM digests JOIN stats USING (digest_id) WHERE kind <> 'commentary' AND NOT pool AND written > 0 AND created > (SELECT t FROM since) ORDER BY created DESC, digest_id LIMIT 6) SELECT * FROM c WHERE (SELECT count(*) FROM c) >= 2")(
    on(lambda x: D.commentary_window(x["di"], D.digest_stats(x["m"], x["se"], x["dr"]), AS_OF)))
_lens = "list_extract(['happened', 'hidden', 'benefits', 'second', 'contrarian', 'parallel'], CAST((row_number() OVER (PARTITION BY digest_id ORDER BY section_id) - 1) % 6 + 1 AS INT))"
query("default_outline", f"{B} SELECT digest_id, section_id, title AS heading, {_lens} AS lens, true AS included FROM sections")(on(lambda x: D.default_outline(x["se"], DT.LENSES)))
query("stale_sections", f"{B} SELECT s.digest_id, s.section_id FROM sections s LEFT JOIN (SELECT digest_id, section_id, status, stale FROM drafts) w ON w.digest_id = s.digest_id AND w.section_id = s.section_id AND w.status = 'done' AND NOT w.stale WHERE s.included AND w.digest_id IS NULL")(
    on(lambda x: D.stale_sections(x["se"], x["dr"])))
query("left_out", f"{B} SELECT story_id FROM st WHERE story_id % 2 = 0 AND story_id NOT IN (SELECT story_id FROM section_stories WHERE digest_id = {CUR})")(
    on(lambda x: D.left_out(x["st"].filter("story_id % 2 = 0").select("story_id"), x["m"], CUR)))
query("section_count_rule", f"{B} SELECT digest_id, CASE WHEN n <= 3 THEN 1 WHEN n <= 6 THEN 2 WHEN n <= 9 THEN 3 WHEN n <= 14 THEN 4 WHEN n <= 20 THEN 5 ELSE 6 END AS sections FROM (SELECT digest_id, count(DISTINCT story_id) AS n FROM section_stories GROUP BY 1)")(
    on(lambda x: x["m"].groupBy("digest_id").agg(F.count_distinct("story_id").alias("n")).select("digest_id", D.section_count(F.col("n")).alias("sections"))))
query("section_rank", f"{B}, g AS (SELECT digest_id, section_id, count(DISTINCT source) * 10 + count(*) - CASE WHEN bool_and(regexp_matches(title, '{FE.SOFT_RE}')) THEN 40 ELSE 0 END AS rank_score FROM section_stories JOIN st USING (story_id) GROUP BY 1, 2), "
      "r AS (SELECT *, row_number() OVER (PARTITION BY digest_id ORDER BY rank_score DESC, section_id) AS rank FROM g) SELECT * FROM r WHERE rank <= 4")(on(lambda x: D.section_rank(x["m"], x["st"])))
query("section_clusters")(lambda s, sf: D.section_clusters(T.stories(s, sf).withColumn("scan_id", F.floor(F.col("story_id") / 24))))
query("fold_thin_themes")(on(lambda x: D.fold_thin_themes(x["se"], x["m"])))
_first = "fs AS (SELECT digest_id, section_id, arg_min(story_id, ord * 100000000 + story_id) AS first_story FROM section_stories GROUP BY 1, 2)"
query("pool_merge", f"{B}, {_first}, pool AS (SELECT fs.* FROM fs WHERE digest_id % 11 = 10), lo AS (SELECT * FROM fs WHERE digest_id % 11 < 5), one AS (SELECT * FROM lo QUALIFY row_number() OVER (PARTITION BY first_story ORDER BY digest_id, section_id) = 1) "
      "SELECT * FROM pool UNION ALL SELECT * FROM one WHERE first_story NOT IN (SELECT first_story FROM pool)")(
    on(lambda x: D.pool_merge(D.first_story(x["m"]).filter("digest_id % 11 = 10"), D.first_story(x["m"]).filter("digest_id % 11 < 5"))))
query("split_by_theme", f"{B}, m AS (SELECT digest_id FROM sections GROUP BY 1 HAVING count(DISTINCT theme) > 1), r AS (SELECT digest_id, section_id, theme, dense_rank() OVER (PARTITION BY digest_id ORDER BY theme) AS part FROM sections JOIN m USING (digest_id)) "
      "SELECT digest_id, section_id, theme, part, CASE WHEN part = 1 THEN CAST(digest_id AS VARCHAR) ELSE digest_id || '-' || part END AS new_digest FROM r")(on(lambda x: D.split_by_theme(x["se"])))
query("review_status", f"{B}, r AS (SELECT s.digest_id, w.status = 'done' AS ok, w.stale, w.n_numbers, w.n_phrases, length(w.text) < 1100 AS thin FROM sections s LEFT JOIN (SELECT * FROM drafts WHERE status = 'done') w ON w.digest_id = s.digest_id AND w.section_id = s.section_id WHERE s.included) "
      "SELECT digest_id, count(*) AS total, count(*) FILTER (WHERE ok) AS done, count(*) FILTER (WHERE ok AND stale) AS stale, CAST(coalesce(sum(n_numbers), 0) AS BIGINT) AS numbers, CAST(coalesce(sum(n_phrases), 0) AS BIGINT) AS phrases, count(*) FILTER (WHERE ok IS NULL) AS missing, count(*) FILTER (WHERE ok AND thin) AS thin, "
      "bool_or(f.digest_id IS NOT NULL AND f.summary <> '') AS frame FROM r LEFT JOIN frames f USING (digest_id) GROUP BY digest_id")(on(lambda x: D.review_status(x["se"], x["dr"], x["fr"])))


def articles(s, sf):
    return T.table(s, sf, "documents").select(F.col("doc_id").alias("story_id"), "text")


CORP = f"ok AS (SELECT digest_id, section_id, ord, story_id, source, {Q.clean_title('title')} AS h, row_number() OVER (PARTITION BY digest_id, section_id ORDER BY ord, story_id) AS n FROM section_stories JOIN st USING (story_id) WHERE readable NOT IN ('paywalled', 'thin')), " \
       "corp AS (SELECT digest_id, section_id, count(*) AS sources, CAST(sum(length(d.text)) AS BIGINT) AS chars, lower(string_agg(h || ' ' || h || ' ' || ok.source || ' ' || d.text, ' ' || chr(10) || ' ' ORDER BY n)) AS corpus FROM ok JOIN documents d ON d.doc_id = story_id WHERE n <= 6 GROUP BY 1, 2)"
query("source_corpus", f"{B}, {CORP} SELECT * FROM corp")(lambda s, sf: D.source_corpus(DT.section_stories(s, sf), T.stories(s, sf), articles(s, sf)))
query("thin_section", f"{B}, {CORP} SELECT digest_id, section_id, chars, chars < 1100 AS thin FROM corp")(
    lambda s, sf: D.thin_section(D.source_corpus(DT.section_stories(s, sf), T.stories(s, sf), articles(s, sf))))
_read = "regexp_replace(w.text, '\\s+', ' ', 'g')"
query("draft_word_total", f"{B}, p AS (SELECT w.digest_id, {_words} + {Q.words(_read)} AS n FROM drafts w WHERE w.included UNION ALL SELECT digest_id, {Q.words('summary')} + {Q.words('opening')} + {Q.words('array_to_string(watch, chr(32))')} FROM frames) SELECT digest_id, CAST(sum(n) AS BIGINT) AS words FROM p GROUP BY 1")(
    on(lambda x: D.draft_word_total(x["se"], x["dr"], x["fr"])))
query("source_count", f"{B} SELECT w.digest_id, count(DISTINCT st.url) AS sources FROM drafts w JOIN section_stories z ON z.digest_id = w.digest_id AND z.section_id = w.section_id JOIN st USING (story_id) WHERE w.included GROUP BY 1")(
    on(lambda x: D.source_count(x["se"], x["dr"])))
_open = f"array_to_string(list_slice(regexp_split_to_array(regexp_replace(lower({_read}), '[^a-z\\s]', '', 'g'), '\\s+'), 1, 3), ' ')"
query("repeated_openers", f"{B}, o AS (SELECT w.digest_id % 5 AS digest_id, {_open} AS opener FROM drafts w WHERE w.included), g AS (SELECT digest_id, opener, count(*) AS n FROM o GROUP BY 1, 2), t AS (SELECT digest_id, CAST(sum(n) AS BIGINT) AS total FROM g GROUP BY 1) "
      "SELECT g.digest_id, opener, n, total FROM g JOIN t USING (digest_id) WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY g.digest_id ORDER BY n DESC, opener DESC) = 1")(
    on(lambda x: _openers(x)))


def _openers(x):
    """Digests pooled five ways, so that openers repeat."""
    key = F.struct(F.col("digest_id"), F.col("section_id"))
    uniq = F.col("digest_id") * 10 + F.col("section_id")
    se = x["se"].withColumn("section_id", uniq).withColumn("digest_id", F.col("digest_id") % 5)
    dr = x["dr"].withColumn("section_id", uniq).withColumn("digest_id", F.col("digest_id") % 5)
    return D.repeated_openers(se, dr)


query("digest_markdown")(on(lambda x: D.digest_markdown(x["di"], x["se"], x["dr"], x["fr"])))
query("daily_material")(on(lambda x: D.daily_material(x["di"], x["se"], x["dr"], x["fr"])))
_links = "lk AS (SELECT CAST(floor(story_id / 12) AS BIGINT) + 1 AS digest_id, story_id AS pos, title, url FROM st)"
query("related_links", f"{B}, {_links}, tx AS (SELECT f.digest_id, list_distinct({Q.tokens('f.headline || chr(32) || f.summary')}) AS bag FROM frames f), h AS (SELECT lk.digest_id, pos, len(list_filter({Q.tokens('title')}, lambda w: list_contains(bag, w))) AS hits FROM lk JOIN tx USING (digest_id) WHERE regexp_matches(url, '(?i)^https?://\\S+$')), "
      "m AS (SELECT *, max(hits) OVER (PARTITION BY digest_id) AS mx FROM h), r AS (SELECT digest_id, pos, hits, row_number() OVER (PARTITION BY digest_id ORDER BY hits DESC, pos) AS rank FROM m WHERE hits > 0 OR mx = 0) SELECT * FROM r WHERE rank <= 3")(
    on(lambda x: D.related_links(
        x["st"].select((F.floor(F.col("story_id") / 12) + 1).alias("digest_id"), F.col("story_id").alias("pos"), "title", "url"),
        x["fr"].select("digest_id", F.concat_ws(" ", "headline", "summary").alias("text")))))
