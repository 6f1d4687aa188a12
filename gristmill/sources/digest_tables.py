"""Digest tables derived from the stories view: digests, sections, section_stories, drafts, frames.

Membership depends on the story id only, with planted overlaps, missing drafts, stale signatures and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import clean_title
from gristmill.plans import sqltext as Q
from gristmill.sources import tables as T

# Section lenses in their default order.
LENSES = ["happened", "hidden", "benefits", "second", "contrarian", "parallel"]

_HOME, _SEC = "CAST(floor(story_id / 12) AS BIGINT)", "CAST(floor(story_id % 12 / 3) AS BIGINT)"
MEMBERS = [
    f"SELECT {_HOME} AS digest_id, {_SEC} AS section_id, story_id, story_id % 3 AS ord FROM st",
    f"SELECT {_HOME} + 1 AS digest_id, {_SEC} AS section_id, story_id, 10 + story_id % 3 AS ord FROM st WHERE story_id % 4 = 0",
    f"SELECT {_HOME} + 1 AS digest_id, {_SEC} AS section_id, story_id, 10 + story_id % 3 AS ord FROM st WHERE story_id % 4 <> 0 AND {_HOME} % 5 = 0 AND {_SEC} < 2",
]
DIGEST = {
    "age_hours": "digest_id * 7 % 150",
    "kind": "CASE WHEN digest_id % 9 = 8 THEN 'commentary' ELSE 'daily' END",
    "pool": "digest_id % 11 = 10",
    "exported": "digest_id % 5 = 0",
    "note": "CASE digest_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'From where I sit: ' ELSE 'My own view.' END",
    "reviewed": "digest_id % 2 = 0",
}
SECTION = {
    "theme": "CASE WHEN digest_id % 4 = 0 THEN section_id % 2 + 1 ELSE 1 END",
    "lens": "CASE section_id WHEN 0 THEN 'happened' WHEN 1 THEN 'hidden' WHEN 2 THEN 'benefits' ELSE 'second' END",
    "included": "NOT (section_id = 3 AND digest_id % 2 = 1)",
    "off_theme": "(digest_id + section_id) % 10 = 0",
}
DRAFT = {
    "status": "CASE WHEN (digest_id * 4 + section_id) % 6 = 5 THEN 'failed' ELSE 'done' END",
    "n_numbers": "CASE WHEN digest_id % 7 = 0 THEN section_id ELSE 0 END",
    "n_phrases": "CASE WHEN digest_id % 8 = 1 THEN 1 ELSE 0 END",
    "n_audit": "(digest_id + section_id) % 3",
    "stale": "(digest_id + section_id) % 7 = 3",
    "signal": "digest_id % 3 = 0 OR section_id = 1",
}


def story_base(spark: SparkSession, sf: str) -> DataFrame:
    return T.stories(spark, sf)


def section_stories(spark: SparkSession, sf: str, st: DataFrame | None = None) -> DataFrame:
    st = story_base(spark, sf) if st is None else st
    # one scan: the memberships of a story are the entries of a small array
    home, sec = F.expr(_HOME), F.expr(_SEC)
    at = lambda d, o: F.struct(d.alias("digest_id"), sec.alias("section_id"), o.alias("ord"))
    third = F.col("story_id") % 3
    extra = (F.col("story_id") % 4 == 0) | ((home % 5 == 0) & (sec < 2))
    return st.select("story_id", F.inline(F.array_compact(F.array(at(home, third), F.when(extra, at(home + 1, third + 10))))))


def digests(spark: SparkSession, sf: str) -> DataFrame:
    d = section_stories(spark, sf).select("digest_id").distinct()
    out = d.selectExpr("digest_id", *[f"{e} AS {n}" for n, e in DIGEST.items()])
    created = (F.unix_seconds(F.to_timestamp(F.lit(T.AS_OF))) - F.col("age_hours") * 3600).cast("timestamp")
    return out.withColumn("created", created)


def sections(spark: SparkSession, sf: str) -> DataFrame:
    st = story_base(spark, sf)
    m = section_stories(spark, sf).join(st.select("story_id", "title"), "story_id")
    g = m.groupBy("digest_id", "section_id").agg(
        F.min_by(clean_title("title"), F.struct("ord", "story_id")).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "story_id"))), lambda x: x["story_id"].cast("string")), ",").alias("ids"))
    return g.selectExpr("digest_id", "section_id", "title", "concat('thread ', digest_id) AS thread", "ids", *[f"{e} AS {n}" for n, e in SECTION.items()])


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Draft per section: the text of the section's first story as paragraphs."""
    s = sections(spark, sf)
    m = section_stories(spark, sf)
    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("story_id"), "text")
    lead = m.groupBy("digest_id", "section_id").agg(F.min("story_id").alias("story_id")).join(docs, "story_id")
    st = story_base(spark, sf).select("story_id", F.struct("source", "title", "url").alias("src"))
    srcs = m.join(st, "story_id").groupBy("digest_id", "section_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "story_id", "src"))), lambda x: x["src"]).alias("sources"))
    d = s.join(lead, ["digest_id", "section_id"]).join(srcs, ["digest_id", "section_id"]).filter("digest_id % 13 <> 12 OR section_id > 0")
    x = d.selectExpr("*", *[f"{e} AS _{n}" for n, e in DRAFT.items()])
    paras = F.concat(F.split("text", "\n", -1), F.when(F.col("_signal"), F.array(F.lit("Watch for the signal here."))).otherwise(F.array().cast("array<string>")))
    fill = lambda n, w: F.slice(F.array(*[F.lit(f"{w}{i}") for i in range(4)]), F.lit(1), F.col(n).cast("int"))
    return x.select(
        "digest_id", "section_id", F.col("_status").alias("status"), paras.alias("paragraphs"),
        F.regexp_replace("text", r"\s+", " ").alias("reading"),
        F.when(F.col("_stale"), "old").otherwise(F.concat_ws("|", "ids", "lens", "title")).alias("signature"),
        (F.length("text") < 1100).alias("thin"), "sources", fill("_n_numbers", "1").alias("bad_numbers"),
        fill("_n_phrases", "p").alias("phrases"), fill("_n_audit", "a").alias("audit"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Summary, opening and watch list per digest, from its first story."""
    m = section_stories(spark, sf).groupBy("digest_id").agg(F.min("story_id").alias("story_id"))
    st = story_base(spark, sf).select("story_id", "title", "summary")
    watch = F.slice(F.array(F.col("summary"), F.col("title"), F.lit("Rates at 12.5% next week"), F.lit("The vote")), F.lit(1), (F.col("digest_id") % 5).cast("int"))
    return m.join(st, "story_id").filter("digest_id % 10 <> 9").select(
        "digest_id", F.col("title").alias("headline"), "summary", F.col("title").alias("opening"), watch.alias("watch"))


# the same tables as SQL text
SQL = (
    f"st AS ({T.SQL_STORIES}), section_stories AS ({' UNION ALL '.join(MEMBERS)}), "
    "digests AS (SELECT digest_id, " + ", ".join(f"{e} AS {n}" for n, e in DIGEST.items()) + f", TIMESTAMP '{T.AS_OF}' - to_hours(CAST(digest_id * 7 % 150 AS BIGINT)) AS created FROM (SELECT DISTINCT digest_id FROM section_stories)), "
    f"sections AS (SELECT digest_id, section_id, arg_min({Q.clean_title('st.title')}, ord * 100000000 + story_id) AS title, string_agg(CAST(story_id AS VARCHAR), ',' ORDER BY ord, story_id) AS ids, "
    "'thread ' || CAST(digest_id AS VARCHAR) AS thread, " + ", ".join(f"{e} AS {n}" for n, e in SECTION.items()) + " FROM section_stories JOIN st USING (story_id) GROUP BY digest_id, section_id), "
    "drafts AS (SELECT s.*, d.text, " + ", ".join(f"{e.replace('digest_id', 's.digest_id').replace('section_id', 's.section_id')} AS {n}" for n, e in DRAFT.items()) +
    " FROM sections s JOIN (SELECT digest_id, section_id, min(story_id) AS first_id FROM section_stories GROUP BY 1, 2) f USING (digest_id, section_id) JOIN documents d ON d.doc_id = f.first_id WHERE s.digest_id % 13 <> 12 OR s.section_id > 0), "
    "frames AS (SELECT digest_id, title AS headline, summary, title AS opening, list_slice([summary, title, 'Rates at 12.5% next week', 'The vote'], 1, digest_id % 5) AS watch FROM (SELECT digest_id, min(story_id) AS story_id FROM section_stories GROUP BY 1) JOIN st USING (story_id) WHERE digest_id % 10 <> 9)"
)
