"""Earlier digests: story reuse, overlap, quality grades, section planning and regrouping.

Tables: ``digests(digest_id, created, kind, pool, exported, note, reviewed)``, ``sections(digest_id, section_id, title,
thread, theme, lens, included, off_theme, ids)``, ``section_stories(digest_id, section_id, story_id, ord)``,
``drafts(digest_id, section_id, status, paragraphs, reading, signature, thin, sources, bad_numbers, phrases, audit)``,
``frames(digest_id, headline, summary, opening, watch)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import text as TX
from gristmill.functions import urls as U
from gristmill.functions.claims import ascii_bounds
from gristmill.operators import feeds as FE
from gristmill.operators import related as RL
from gristmill.session import cut_lineage

SECTION = ["digest_id", "section_id"]


def story_keys(title="title", url="url") -> Column:
    """Identity keys of a story: address and, when long enough, headline."""
    u, t = U.clean_url(url), TX.title_key(title)
    return F.array_compact(F.array(F.when(u != "", F.concat(F.lit("u:"), u)), F.when(F.length(t) > 12, F.concat(F.lit("t:"), t))))


def written(drafts: DataFrame) -> DataFrame:
    """Sections with a finished draft."""
    return drafts.filter((F.col("status") == "done") & (F.size("paragraphs") > 0)).select(*SECTION)


def keyed_members(members: DataFrame, stories: DataFrame) -> DataFrame:
    """(digest_id, section_id, story_id, pos, key)."""
    keys = stories.select("story_id", F.posexplode(story_keys()).alias("pos", "key"))
    return members.select(*SECTION, "story_id").join(keys, "story_id")


# ---- reuse --------------------------------------------------------------------------------------------------------------
def usage_map(members: DataFrame, stories: DataFrame, drafts: DataFrame, digests: DataFrame) -> DataFrame:
    """Best use per key: written beats grouped, then the newest digest."""
    done = written(drafts).withColumn("_w", F.lit(True))
    j = keyed_members(members, stories).join(done, SECTION, "left").join(digests.select("digest_id", "created"), "digest_id")
    level = F.when(F.col("_w"), 2).otherwise(1)
    rank = F.struct(level.alias("level"), "created", (-F.col("digest_id")).alias("_d"), (-F.col("section_id")).alias("_s"))
    return j.groupBy("key").agg(F.max_by(F.struct(level.alias("level"), F.col("digest_id").alias("used_in"), F.col("section_id").alias("used_section")), rank).alias("u")).select("key", "u.*")


def story_usage(stories: DataFrame, usage: DataFrame) -> DataFrame:
    """Per story the use found by its first matching key: (story_id, level, used_in, used_section)."""
    keys = stories.select("story_id", F.posexplode(story_keys()).alias("pos", "key"))
    return keys.join(usage, "key").groupBy("story_id").agg(F.min_by(F.struct("level", "used_in", "used_section"), "pos").alias("u")).select("story_id", "u.*")


def fresh_stories(stories: DataFrame, usage: DataFrame, members: DataFrame, current: int, marks: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Readable, not written in another digest, not already in the current one."""
    taken = story_usage(stories, usage).filter((F.col("level") == 2) & (F.col("used_in") != current)).select("story_id")
    here = members.filter(F.col("digest_id") == current).select("story_id").distinct()
    return FE.readable_filter(stories, marks, as_of).join(taken, "story_id", "left_anti").join(here, "story_id", "left_anti")


def claim_map(members: DataFrame, stories: DataFrame, sections: DataFrame, drafts: DataFrame, digests: DataFrame, exclude: int) -> DataFrame:
    """Keys held by sections that other digests will use; written beats planned."""
    live = digests.filter(~F.col("pool") & (F.col("digest_id") != exclude)).select("digest_id")
    act = sections.filter("included").select(*SECTION).join(live, "digest_id", "left_semi")
    done = written(drafts).withColumn("written", F.lit(True))
    j = keyed_members(members.join(act, SECTION, "left_semi"), stories).join(done, SECTION, "left").withColumn("written", F.coalesce("written", F.lit(False)))
    order = F.struct((~F.col("written")).alias("_w"), "digest_id", "section_id")
    return j.groupBy("key").agg(F.min_by(F.struct(F.col("digest_id").alias("claimed_by"), "written"), order).alias("c")).select("key", "c.*")


def related_fresh(fresh: DataFrame, sections: DataFrame, members: DataFrame, stories: DataFrame, counts: bool = False) -> DataFrame:
    """(digest_id, section_id, story_id): fresh stories sharing tokens with a section's title, thread and headlines.

    With ``counts`` only how many they are: (digest_id, section_id, related). A story's own title decides how much it must share.
    """
    heads = members.join(stories.select("story_id", TX.clean_title("title").alias("h")), "story_id").groupBy(*SECTION).agg(F.array_join(F.collect_list("h"), " ").alias("h"))
    bag = TX.token_set(F.concat_ws(" ", "title", "thread", "h"))
    right = sections.select(*SECTION, "title", "thread").join(heads, SECTION).select(F.col("digest_id").alias("id"), *[F.col(c).cast("long").alias(n) for c, n in zip(SECTION, "pq")], bag.alias("tokens"))
    left = FE.story_sets(fresh.select("story_id", "title")).filter(F.size("tokens") >= 2).select(F.col("story_id").alias("id"), "tokens")
    found = RL.all_matches(RL.coded(left, RL.RELATED), RL.coded(right, lambda n: F.lit(2**30), "p", "q"), counts)
    named = [F.col(n).cast(sections.schema[c].dataType).alias(c) for c, n in zip(SECTION, "pq")]
    return found.select(*named, F.col("n").alias("related")) if counts else found.select(*named, F.col("left_id").alias("story_id"))


def carry_candidates(members, stories, sections, drafts, digests, fresh: DataFrame, current: int, as_of: str, free: int = 16, owned: int = 14) -> DataFrame:
    """Sections of earlier digests worth reusing: free ones first, then those another digest owns.

    "Already offered by a newer candidate" depends on which newer candidates were kept, so it is settled in rounds:
    a candidate is kept once even all undecided newer ones could not reach half of its stories, and dropped once the
    kept ones do. The newest undecided candidate is always decidable, so the rounds end.
    """
    here = members.filter(F.col("digest_id") == current).select("story_id").distinct().withColumn("_cur", F.lit(True))
    known = members.filter(F.col("digest_id") != current).join(here, "story_id", "left")
    size = known.groupBy(*SECTION).agg(F.count_distinct("story_id").alias("stories"), F.count_if("_cur").alias("_in"), F.count(F.lit(1)).alias("_all")).filter("_in < _all")
    claims = claim_map(members, stories, sections, drafts, digests, current)
    km = keyed_members(known, stories)
    held = km.join(claims, "key").filter(F.col("claimed_by") != F.col("digest_id")).select(*SECTION, "story_id").distinct().groupBy(*SECTION).agg(F.count(F.lit(1)).alias("_held"))
    rel = related_fresh(fresh, sections, members, stories, counts=True)
    base = (
        sections.select(*SECTION, "title", "included").join(size.select(*SECTION, "stories"), SECTION).join(digests.select("digest_id", "created", "pool"), "digest_id")
        .join(held, SECTION, "left").join(rel, SECTION, "left").fillna(0, ["_held", "related"]))
    age = FE.age_hours("created", as_of)
    already = (~F.col("pool") & F.col("included")) | (F.col("_held") / F.col("stories") >= 0.5)
    base = cut_lineage(base.withColumn("already", already).filter((age <= 72) | (F.col("already") & (F.col("related") > 0))))
    # newest first; inside a digest by section
    order = F.struct((-F.unix_seconds("created")).alias("c"), "digest_id", "section_id")
    todo = cut_lineage(km.join(base.filter("NOT already").select(*SECTION, "stories", order.alias("o")), SECTION).select(*SECTION, "story_id", "key", "stories", "o"))
    kept = None
    while True:
        pool = todo.select("key", "o", F.lit(False).alias("sure"))
        if kept is not None:
            pool = pool.unionByName(kept.select("key", "o", F.lit(True).alias("sure")))
        lead = pool.groupBy("key").agg(F.min("o").alias("any_o"), F.min(F.when(F.col("sure"), F.col("o"))).alias("sure_o"))
        hit = todo.join(lead, "key").groupBy(*SECTION, "stories", "o", "story_id").agg(
            F.bool_or(F.col("any_o") < F.col("o")).alias("maybe"), F.bool_or(F.coalesce(F.col("sure_o") < F.col("o"), F.lit(False))).alias("surely"))
        vote = hit.groupBy(*SECTION, "stories").agg(F.count_if("maybe").alias("maybe"), F.count_if("surely").alias("surely"))
        vote = cut_lineage(vote.select(*SECTION, (F.col("maybe") / F.col("stories") < 0.5).alias("keep"), (F.col("surely") / F.col("stories") >= 0.5).alias("drop")))
        new = todo.join(vote.filter("keep"), SECTION, "left_semi")
        kept = cut_lineage(new if kept is None else kept.unionByName(new))
        todo = cut_lineage(todo.join(vote.filter("keep OR drop"), SECTION, "left_anti"))
        if not todo.limit(1).count():
            break
    ok = base.filter("already").unionByName(base.join(kept.select(*SECTION).distinct(), SECTION, "left_semi").filter("NOT already"))
    by = [F.desc("related"), F.desc("created"), "digest_id", "section_id"]
    first = ok.filter("NOT already").orderBy(*by).limit(free)
    then = ok.filter("already").orderBy(*by).limit(owned)
    return first.unionByName(then).select(*SECTION, "title", "already", "related", "stories")


# ---- overlap and duplicates -----------------------------------------------------------------------------------------------
def digest_keys(members: DataFrame, stories: DataFrame) -> DataFrame:
    return keyed_members(members, stories).select("digest_id", "key").distinct()


def digest_overlap(members: DataFrame, stories: DataFrame, percent: int = 35) -> DataFrame:
    """(a, b, shared, overlap) for digests sharing at least ``percent`` of the smaller key set."""
    keys = digest_keys(members, stories)
    sets = keys.groupBy(F.col("digest_id").alias("key")).agg(F.collect_set("key").alias("tokens"))
    pairs = RL.similar_pairs(sets, RL.share_rule(percent, 1))
    n = sets.select("key", F.size("tokens").alias("n"))
    j = pairs.join(n.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    return j.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", F.round(F.col("shared") / F.least("na", "nb"), 6).alias("overlap"))


def digest_dup_groups(members, stories, digests: DataFrame, quality: DataFrame) -> DataFrame:
    """Groups of overlapping digests with the one to keep: (digest_id, group_id, keep, drop)."""
    # grades feed every later step, so they are computed once
    q = cut_lineage(quality.filter("grade <> 'none'").join(digests.filter("NOT pool").select("digest_id", "created", "exported"), "digest_id"))
    pairs = digest_overlap(members.join(q.select("digest_id"), "digest_id", "left_semi"), stories)
    comp = RL.components(q.select(F.col("digest_id").alias("node")), pairs).withColumnsRenamed({"node": "digest_id", "label": "group_id"})
    j = q.join(comp, "digest_id")
    best = F.struct("exported", "score", "created", (-F.col("digest_id")).alias("_d"))
    g = j.groupBy("group_id").agg(F.max_by("digest_id", best).alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = j.join(g, "group_id")
    keep = F.col("digest_id") == F.col("keep_id")
    return out.select("digest_id", "group_id", keep.alias("keep"), (~keep & ~F.col("exported")).alias("drop"))


# ---- quality --------------------------------------------------------------------------------------------------------------
# Wording that tells a reader what would change the reading.
SIGNAL_RE = (
    r"(?i)\b(would change|change (?:our|my) (?:mind|read|view)|(?:revise|reverse|drop|abandon) (?:this|our) (?:read|view|reading)"
    r"|(?:this|the|our)(?: \w+)? (?:read|reading|view|thesis|pattern|case)(?: \w+){0,2} (?:fails?|breaks?|weakens?|narrows?|collapses?)"
    r"|(?:read|reading|view|thesis) (?:would be|is) (?:wrong|weakened|invalidated|contradicted)|we would be wrong|prove(?:s)? us wrong"
    r"|would (?:contradict|falsify|invalidate|weaken)|invalidat\w+|if (?:\w+ ){0,8}(?:fails?|slips?|rises?|falls?|holds?|breaks?)|watch for|the signal|tripwire)\b"
)


def note_text(c="note") -> Column:
    return TX.jstrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\s*From where I sit:?\s*$", ""))


def digest_quality(digests, sections, drafts, frames, as_of: str, detail: bool = False) -> DataFrame:
    """Publish-readiness score 0..100 and grade per digest, from section-level counts."""
    inc = sections.filter("included").select(*SECTION, "off_theme", F.concat_ws("|", "ids", "lens", "title").alias("_sig"))
    d = drafts.filter((F.col("status") == "done") & (F.size("paragraphs") > 0))
    text = F.array_join("paragraphs", " ")
    outlets = F.size(F.array_distinct(F.filter(F.transform("sources", lambda s: s["source"]), lambda s: F.coalesce(s, F.lit("")) != "")))
    per = d.select(*SECTION, "thin", F.size("bad_numbers").alias("nums"), F.size("phrases").alias("tells"), F.size("audit").alias("aud"), "signature",
                   TX.count_words(text).alias("words"), text.rlike(ascii_bounds(SIGNAL_RE)).alias("sig"), (outlets < 2).alias("single"), F.lit(True).alias("done"))
    j = inc.join(per, SECTION, "left")
    done = F.col("done").isNotNull()
    g = j.groupBy("digest_id").agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(done).alias("n"), F.count_if("thin").alias("thin"), F.coalesce(F.sum("nums"), F.lit(0)).alias("nums"),
        F.coalesce(F.sum("tells"), F.lit(0)).alias("tells"), F.coalesce(F.sum("aud"), F.lit(0)).alias("aud"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.count_if("sig").alias("sig"), F.count_if("single").alias("single"), F.count_if(done & (F.col("signature") != F.col("_sig"))).alias("stale"),
        F.count_if(done & F.col("off_theme")).alias("off"))
    fr = frames.select("digest_id", (F.coalesce("summary", F.lit("")) != "").alias("has_frame"), F.size("watch").alias("watch"))
    q = digests.filter("NOT pool").join(g, "digest_id", "left").join(fr, "digest_id", "left")
    c, com = F.col, F.col("kind") == "commentary"
    pen = lambda cond, n: F.when(cond, n if isinstance(n, Column) else F.lit(n)).otherwise(0)
    cap = lambda top, x: F.least(F.lit(top), x)
    missing = c("planned") - c("n")
    frame = F.coalesce("has_frame", F.lit(False))
    loss = (
        pen(missing > 0, cap(40, missing * 12)) + pen(c("n") < F.when(com, 2).otherwise(3), 15) + cap(20, c("thin") * 10) + pen(F.try_divide(c("single"), c("n")) > 0.5, 15)
        + cap(24, c("nums") * 8) + cap(12, c("tells") * 4) + pen(F.try_divide(c("words"), c("n")) < 120, 15) + pen(~com & (F.try_divide(c("sig"), c("n")) < 0.6), 12)
        + pen(c("stale") > 0, 10) + cap(10, c("off") * 5) + pen(c("aud") > 3, 5) + pen(~frame, 10) + pen(frame & (c("watch") < 3), 6)
        + pen(note_text() == "", 8) + pen(~c("reviewed"), 5))
    age = pen(~c("exported") & (FE.age_hours("created", as_of) > 36), 5)
    none = F.coalesce(c("n"), F.lit(0)) == 0
    scored = q.select("digest_id", F.when(~none, 100 - loss).cast("bigint").alias("before_age"), age.cast("bigint").alias("age_loss"))
    score = F.coalesce(F.greatest(F.lit(0), F.col("before_age") - F.col("age_loss")), F.lit(0)).cast("bigint")
    scored = scored.withColumn("score", score).withColumn("grade", _grade(F.col("score"), F.col("before_age").isNull()))
    return scored.select("digest_id", "score", "grade", *(["before_age", "age_loss"] if detail else []))


def _grade(score: Column, none: Column) -> Column:
    return F.when(none, "none").when(score >= 80, "ready").when(score >= 60, "fix").otherwise("weak")


def digest_quality_relative(digests, quality: DataFrame, members, stories) -> DataFrame:
    """Second pass: lose 15 (30 when the other is exported) when half of my keys sit in a stronger digest.

    The other's finished score is held against mine before the age penalty and before it is cut at 0; ``quality`` is the
    detailed form of ``digest_quality``. "Half of my keys" looks at one side only, so candidates come from the directed
    form of the overlap join.
    """
    keys = digest_keys(members, stories)
    sets = keys.groupBy(F.col("digest_id").alias("key")).agg(F.collect_set("key").alias("tokens"))
    pairs = RL.sharing_pairs(sets, sets, RL.share_rule(50, 1)).filter("a <> b")
    d = digests.select("digest_id", "created", "exported", "pool").join(quality, "digest_id")
    me = d.select(F.col("digest_id").alias("a"), F.coalesce("before_age", F.lit(0)).alias("s0"), F.col("created").alias("c0"))
    ot = d.filter("NOT pool AND grade <> 'none'").select(F.col("digest_id").alias("b"), F.col("score").alias("s1"), F.col("created").alias("c1"), F.col("exported").alias("e1"))
    j = pairs.join(me, "a").join(ot, "b")
    worse = (F.col("s1") > F.col("s0")) | ((F.col("s1") == F.col("s0")) & (F.col("c1") > F.col("c0"))) | F.col("e1")
    hit = j.filter(worse).groupBy(F.col("a").alias("digest_id")).agg(F.max(F.when(F.col("e1"), 30).otherwise(15)).alias("loss"))
    out = quality.join(hit, "digest_id", "left")
    left = F.col("before_age") - F.coalesce("loss", F.lit(0)) - F.col("age_loss")
    final = F.coalesce(F.greatest(F.lit(0), left), F.lit(0)).cast("bigint")
    return out.select("digest_id", final.alias("score"), _grade(final, F.col("grade") == "none").alias("grade"), F.col("loss").isNotNull().alias("repeats"))


def weak_digest_filter(digests, quality: DataFrame, current: int) -> DataFrame:
    q = quality.filter(F.col("grade").isin("weak", "none") & (F.col("digest_id") != current))
    return q.join(digests.filter("NOT exported AND NOT pool").select("digest_id"), "digest_id", "left_semi")


def digest_stats(members, sections, drafts) -> DataFrame:
    """Sections, planned, written, distinct stories and left-out sections per digest."""
    done = drafts.filter("status = 'done'").select(*SECTION).withColumn("_w", F.lit(True))
    s = sections.select(*SECTION, "included").join(done, SECTION, "left").groupBy("digest_id").agg(
        F.count(F.lit(1)).alias("sections"), F.count_if("included").alias("planned"), F.count_if(F.col("included") & F.col("_w").isNotNull()).alias("written"))
    n = members.groupBy("digest_id").agg(F.count_distinct("story_id").alias("stories"))
    return s.join(n, "digest_id").withColumn("left", F.col("sections") - F.col("planned"))


def commentary_window(digests, stats: DataFrame, as_of: str, days: int = 5, top: int = 6, least: int = 2) -> DataFrame:
    """The latest written daily digests since the last commentary (at most ``days`` back); none when fewer than two."""
    last = digests.filter((F.col("kind") == "commentary") & ~F.col("pool")).agg(F.max("created").alias("_last"))
    floor = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL '{days}' DAY")
    since = last.select(F.greatest(F.coalesce("_last", floor), floor).alias("since"))
    d = digests.filter((F.col("kind") != "commentary") & ~F.col("pool")).join(stats.filter("written > 0").select("digest_id"), "digest_id", "left_semi")
    # the lower bound is one row
    d = d.crossJoin(F.broadcast(since)).filter(F.col("created") > F.col("since"))
    best = d.orderBy(F.desc("created"), "digest_id").limit(top).select("digest_id", "created")
    n = best.agg(F.count(F.lit(1)).alias("n"))
    return best.crossJoin(F.broadcast(n)).filter(F.col("n") >= least).select("digest_id", "created")


# ---- planning ----------------------------------------------------------------------------------------------------------------
def default_outline(sections: DataFrame, lenses: list[str]) -> DataFrame:
    """One plan row per section: heading = title, lens by position."""
    w = W.partitionBy("digest_id").orderBy("section_id")
    pos = F.row_number().over(w) - 1
    return sections.select(*SECTION, F.col("title").alias("heading"), F.element_at(F.array(*[F.lit(x) for x in lenses]), (pos % len(lenses) + 1).cast("int")).alias("lens"), F.lit(True).alias("included"))


def sync_outline(outline: DataFrame, sections: DataFrame, lenses: list[str]) -> DataFrame:
    """Drop rows of removed sections and add default rows for new ones."""
    kept = outline.join(sections.select(*SECTION), SECTION, "left_semi")
    new = default_outline(sections, lenses).join(outline.select(*SECTION), SECTION, "left_anti")
    return kept.unionByName(new)


def stale_sections(sections, drafts) -> DataFrame:
    """Included sections to write: no finished draft or a changed signature."""
    sig = sections.filter("included").select(*SECTION, F.concat_ws("|", "ids", "lens", "title").alias("signature"))
    return sig.join(drafts.filter("status = 'done'").select(*SECTION, "signature"), [*SECTION, "signature"], "left_anti").select(*SECTION)


def left_out(selected: DataFrame, members: DataFrame, digest: int) -> DataFrame:
    """Selected stories that no section of the digest holds."""
    return selected.join(members.filter(F.col("digest_id") == digest).select("story_id"), "story_id", "left_anti")


def section_count(n: Column) -> Column:
    """Sections to plan for a number of stories."""
    return F.when(n <= 3, 1).when(n <= 6, 2).when(n <= 9, 3).when(n <= 14, 4).when(n <= 20, 5).otherwise(6)


def section_rank(members, stories, top: int = 4) -> DataFrame:
    """Sections ranked by outlets x 10 + stories, minus 40 when every story is soft; best ``top`` per digest."""
    j = members.join(stories.select("story_id", "source", "title"), "story_id")
    outlet = F.coalesce(F.nullif("source", F.lit("")), F.col("story_id").cast("string"))
    g = j.groupBy(*SECTION).agg(F.count_distinct(outlet).alias("o"), F.count(F.lit(1)).alias("n"), F.bool_and(FE.soft_story("title")).alias("soft"))
    g = g.select(*SECTION, (F.col("o") * 10 + F.col("n") - F.when(F.col("soft"), 40).otherwise(0)).cast("bigint").alias("rank_score"))
    w = W.partitionBy("digest_id").orderBy(F.desc("rank_score"), "section_id")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def section_clusters(df: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Group the stories of each scan into sections: (scan, story_id, cluster, name).

    Words of a title weigh 2, other words of the first 300 characters of the summary 1. Two groups are as similar as
    their common weight over the size of the smaller vocabulary (2 at least), less a hundredth for each story in them.
    The most similar pair joins until ``section_count`` groups are left. A scan is a top list, so the stories of one scan
    stand in one row; a join compares only the group that grew again. Scans run in parallel.
    """
    title, rest = TX.raw_tokens(F.col("title")), TX.raw_tokens(F.substring(F.coalesce("summary", F.lit("")), 1, 300))
    story = F.struct("story_id", F.array_distinct(title).alias("title"), F.array_except(rest, title).alias("rest"))
    rows = df.select(scan, story.alias("g")).groupBy(scan).agg(F.collect_list("g").alias("g"))
    rows = rows.select(scan, section_count(F.size("g")).alias("goal"), F.array_sort("g", lambda x, y: F.when(x["story_id"] < y["story_id"], -1).otherwise(1)).alias("g"))
    kinds = {c: dict(df.dtypes)[c] for c in (scan, "story_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            story_id = batch.schema.field("g").type.value_type.field("story_id").type
            types = [batch.schema.field(0).type, pa.int32(), pa.list_(story_id), pa.list_(pa.string())]
            for at in range(0, batch.num_rows, 50):
                out = []
                for key, goal, stories in zip(*(c.to_pylist() for c in batch.slice(at, 50).columns)):
                    groups = _joined([x["story_id"] for x in stories], [dict.fromkeys(x["title"], 2) | dict.fromkeys(x["rest"], 1) for x in stories], goal)
                    out += [(key, no, ids, words) for no, (ids, words) in enumerate(groups)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[scan, "cluster", "ids", "words"])

    schema = f"{scan} {kinds[scan]}, cluster int, ids array<{kinds['story_id']}>, words array<string>"
    found = rows.mapInArrow(run, schema)
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    name = F.array_join(F.transform("words", capital), " · ")
    return found.select(scan, F.explode("ids").alias("story_id"), "cluster", F.coalesce(F.nullif(name, F.lit("")), F.lit("Section")).alias("name"))


def _joined(ids: list, bags: list[dict[str, int]], goal: int) -> list[tuple[list, list[str]]]:
    """The groups of one scan, largest first: (ids, three heaviest words)."""
    groups = [[i] for i in ids]

    def alike(x: int, y: int) -> float:
        a, b = bags[x], bags[y]
        if len(b) < len(a):
            a, b = b, a
        return sum(min(n, b[w]) for w, n in a.items() if w in b) / max(2, len(a)) - (len(groups[x]) + len(groups[y])) * 0.01

    left = list(range(len(ids)))
    sim = np.full((len(ids), len(ids)), -np.inf)
    for x in left:
        for y in range(x + 1, len(ids)):
            sim[x, y] = alike(x, y)
    while len(left) > goal:
        # the first of equally similar pairs, by its first group and then its second
        x, y = divmod(int(np.argmax(sim)), len(ids))
        groups[x] = groups[x] + groups[y]
        bags[x] = {w: bags[x].get(w, 0) + bags[y].get(w, 0) for w in bags[x] | bags[y]}
        left.remove(y)
        sim[y, :], sim[:, y] = -np.inf, -np.inf
        for z in left:
            if z != x:
                sim[min(x, z), max(x, z)] = alike(min(x, z), max(x, z))
    heaviest = lambda m: [w for w, _ in sorted(m.items(), key=lambda e: (-e[1], e[0]))[:3]]
    return [(groups[x], heaviest(bags[x])) for x in sorted(left, key=lambda x: (-len(groups[x]), x))]


def fold_thin_themes(sections: DataFrame, members: DataFrame) -> DataFrame:
    """Themes with fewer than two sections or five stories fold into the largest: (digest_id, section_id, theme).

    One row a digest holds its themes with their sizes. The thin theme with the fewest stories moves into the theme with
    the most, as often as there are themes at most, so no thin theme is left unless it is the only one; a digest of up
    to three sections has one theme. The themes left are numbered from 1.
    """
    counts = members.groupBy(*SECTION).agg(F.count(F.lit(1)).alias("n"))
    base = sections.select(*SECTION, F.col("theme").cast("int").alias("theme")).join(counts, SECTION)
    sizes = base.groupBy("digest_id", "theme").agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("n")).groupBy("digest_id").agg(
        F.sum("s").alias("all"), F.array_sort(F.collect_list(F.struct("theme", "s", "n"))).alias("themes"))

    def fold(state: Column, _: Column) -> Column:
        live, moves = state["live"], state["moves"]
        thin = F.array_min(F.transform(F.filter(live, lambda t: (t["s"] < 2) | (t["n"] < 5)), lambda t: F.struct(t["n"], t["theme"].alias("theme"))))["theme"]
        big = F.array_min(F.transform(F.filter(live, lambda t: t["theme"] != thin), lambda t: F.struct(-t["n"], t["theme"].alias("theme"))))["theme"]
        gone = F.get(F.filter(live, lambda t: t["theme"] == thin), F.lit(0))
        grown = F.transform(F.filter(live, lambda t: t["theme"] != thin), lambda t: F.when(t["theme"] == big, F.struct(
            t["theme"].alias("theme"), (t["s"] + gone["s"]).alias("s"), (t["n"] + gone["n"]).alias("n"))).otherwise(t))
        step = F.struct(grown.alias("live"), F.concat(moves, F.array(F.struct(thin.alias("out"), big.alias("into")))).alias("moves"))
        return F.when(thin.isNull() | big.isNull(), state).otherwise(step)

    none = F.array().cast("array<struct<out:int,into:int>>")
    small = F.col("all") <= 3
    first = F.struct(F.when(small, F.slice("themes", 1, 1)).otherwise(F.col("themes")).alias("live"), none.alias("moves"))
    folded = sizes.select("digest_id", small.alias("small"), F.aggregate(F.sequence(F.lit(1), F.size("themes")), first, fold).alias("f"))
    left = F.transform("f.live", lambda t: t["theme"])
    end = F.aggregate("f.moves", F.col("theme"), lambda t, m: F.when(t == m["out"], m["into"]).otherwise(t))
    return base.join(folded, "digest_id").select(*SECTION, F.when(F.col("small"), F.lit(1)).otherwise(F.array_position(left, end)).cast("int").alias("theme"))


def first_story(members: DataFrame) -> DataFrame:
    return members.groupBy(*SECTION).agg(F.min_by("story_id", F.struct("ord", "story_id")).alias("first_story"))


def pool_merge(pool: DataFrame, leftovers: DataFrame) -> DataFrame:
    """Leftover sections join the pool unless a section with the same first story is there already.

    Both sides: ``(digest_id, section_id, first_story)``.
    """
    firsts = leftovers.groupBy("first_story").agg(F.min(F.struct(*SECTION)).alias("s")).select("s.*", "first_story")
    return pool.unionByName(firsts.join(pool.select("first_story"), "first_story", "left_anti").select(*SECTION, "first_story"))


def split_by_theme(sections: DataFrame) -> DataFrame:
    """A digest with two themes or more becomes one digest per theme: (digest_id, section_id, theme, new_digest, part)."""
    n = sections.groupBy("digest_id").agg(F.min("theme").alias("_a"), F.max("theme").alias("_b"))
    w = W.partitionBy("digest_id").orderBy("theme")
    j = sections.join(n.filter("_a <> _b"), "digest_id").withColumn("part", F.dense_rank().over(w))
    name = F.when(F.col("part") == 1, F.col("digest_id").cast("string")).otherwise(F.concat_ws("-", F.col("digest_id").cast("string"), F.col("part").cast("string")))
    return j.select(*SECTION, F.col("theme").cast("bigint").alias("theme"), "part", name.alias("new_digest"))


def review_status(sections, drafts, frames) -> DataFrame:
    inc = sections.filter("included").select(*SECTION, "title", F.concat_ws("|", "ids", "lens", "title").alias("_sig"))
    d = drafts.filter("status = 'done'").select(*SECTION, "thin", "signature", F.size("bad_numbers").alias("b"), F.size("phrases").alias("p"), F.lit(True).alias("ok"))
    j = inc.join(d, SECTION, "left")
    g = j.groupBy("digest_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("done"), F.count_if(F.col("ok") & (F.col("signature") != F.col("_sig"))).alias("stale"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("numbers"), F.coalesce(F.sum("p"), F.lit(0)).alias("phrases"), F.count_if(F.col("ok").isNull()).alias("missing"),
        F.count_if(F.col("ok") & F.col("thin")).alias("thin"))
    fr = frames.select("digest_id", (F.coalesce("summary", F.lit("")) != "").alias("frame"))
    return g.join(fr, "digest_id", "left").withColumn("frame", F.coalesce("frame", F.lit(False)))


# ---- text of digests ---------------------------------------------------------------------------------------------------------
def source_corpus(members, stories, articles: DataFrame, top: int | None = 6) -> DataFrame:
    """Per section the lower-cased text of its first ``top`` readable sources, or of all without ``top``: (digest_id, section_id, sources, chars, corpus)."""
    w = W.partitionBy(*SECTION).orderBy("ord", "story_id")
    ok = stories.filter(~F.col("readable").isin("paywalled", "thin")).select("story_id", "source", TX.clean_title("title").alias("h"))
    j = members.join(ok, "story_id").withColumn("_n", F.row_number().over(w)).filter(F.lit(True) if top is None else F.col("_n") <= top).join(articles.select("story_id", "text"), "story_id")
    part = F.concat_ws(" ", "h", "h", "source", "text")
    g = j.groupBy(*SECTION).agg(
        F.count(F.lit(1)).alias("sources"), F.sum(F.length("text")).alias("chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", part.alias("p")))), lambda x: x["p"]), " \n ").alias("c"))
    return g.select(*SECTION, "sources", "chars", F.lower("c").alias("corpus"))


def thin_section(corpus: DataFrame, limit: int = 1100) -> DataFrame:
    return corpus.select(*SECTION, "chars", (F.col("chars") < limit).alias("thin"))


def draft_word_total(sections, drafts, frames) -> DataFrame:
    """Words over paragraphs and readings of included sections plus the frame."""
    inc = sections.filter("included").select(*SECTION)
    body = drafts.join(inc, SECTION, "left_semi").select("digest_id", (TX.count_words(F.array_join("paragraphs", " ")) + TX.count_words("reading")).alias("w"))
    fr = frames.select("digest_id", (TX.count_words("summary") + TX.count_words("opening") + TX.count_words(F.array_join("watch", " "))).alias("w"))
    return body.unionByName(fr).groupBy("digest_id").agg(F.sum("w").alias("words"))


def source_count(sections, drafts) -> DataFrame:
    inc = sections.filter("included").select(*SECTION)
    s = drafts.join(inc, SECTION, "left_semi").select("digest_id", F.explode("sources").alias("s"))
    return s.groupBy("digest_id").agg(F.count_distinct(F.coalesce(F.nullif(F.col("s.url"), F.lit("")), F.col("s.source"))).alias("sources"))


def repeated_openers(sections, drafts, least: int = 3) -> DataFrame:
    """Most used first three words of the readings of a digest, when used at least three times."""
    inc = sections.filter("included").select(*SECTION)
    flat = F.regexp_replace(F.lower("reading"), r"[^a-z\s]", "")
    key = F.array_join(F.slice(F.split(flat, r"\s+", -1), 1, 3), " ")
    d = drafts.join(inc, SECTION, "left_semi").filter(F.coalesce("reading", F.lit("")) != "").select("digest_id", key.alias("opener"))
    g = d.groupBy("digest_id", "opener").agg(F.count(F.lit(1)).alias("n"))
    best = g.groupBy("digest_id").agg(F.max_by(F.struct("opener", "n"), F.struct("n", F.col("opener"))).alias("b"), F.sum("n").alias("total"))
    return best.filter(F.col("b.n") >= least).select("digest_id", "b.opener", "b.n", "total")


def digest_markdown(digests, sections, drafts, frames) -> DataFrame:
    """One Markdown text per digest: headline, summary, opening, sections with readings and links, watch list."""
    inc = sections.filter("included").select(*SECTION, "title")
    links = F.filter("sources", lambda s: F.coalesce(s["url"], F.lit("")) != "")
    link_line = F.array_join(F.transform(links, lambda s: F.concat(F.lit("["), s["source"], F.lit("]("), s["url"], F.lit(")"))), ", ")
    read = F.when(F.col("reading") != "", F.concat(F.lit("> Our read: "), F.regexp_replace("reading", r"\n{2,}", "\n>\n> "), F.lit("\n\n"))).otherwise("")
    block = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.array_join("paragraphs", "\n\n"), F.lit("\n\n"), read,
                     F.when(F.size(links) > 0, F.concat(F.lit("Sources: "), link_line, F.lit("\n\n"))).otherwise(""))
    body = drafts.filter(F.size("paragraphs") > 0).join(inc, SECTION).select("digest_id", "section_id", block.alias("b"))
    g = body.groupBy("digest_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", "b"))), lambda x: x["b"]), "").alias("body"))
    para = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(c, F.lit("\n\n"))).otherwise("")
    watch = F.when(F.size("watch") > 0, F.concat(F.lit("## What to watch\n\n"), F.array_join(F.transform("watch", lambda w: F.concat(F.lit("- "), w, F.lit("\n"))), ""))).otherwise("")
    j = frames.join(g, "digest_id", "left")
    return j.select("digest_id", F.concat(F.lit("# "), "headline", F.lit("\n\n"), para(F.col("summary")), para(F.col("opening")), F.coalesce("body", F.lit("")), watch).alias("markdown"))


def daily_material(digests, sections, drafts, frames) -> DataFrame:
    """Text block per earlier digest: date, headline, shortened summary, sections and watch list."""
    inc = sections.filter("included").select(*SECTION, "title")
    line = F.concat(F.lit("- Section: "), F.col("title"), F.lit("\n  Reported: "), TX.shorten(F.array_join("paragraphs", " "), 260), F.lit("\n  Our read: "), TX.shorten("reading", 760))
    s = drafts.filter("status = 'done'").join(inc, SECTION).select("digest_id", "section_id", line.alias("l"))
    g = s.groupBy("digest_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", "l"))), lambda x: x["l"]), "\n").alias("body"))
    watch = F.array_join(F.transform("watch", lambda w: F.concat(F.lit("\n  Watch: "), TX.shorten(w, 200))), "")
    j = digests.select("digest_id", "created").join(frames, "digest_id").join(g, "digest_id", "left")
    return j.select("digest_id", F.concat(
        F.lit("DAILY ("), F.date_format("created", "EEE d MMMM"), F.lit("): "), "headline", F.lit("\nSummary: "), TX.shorten("summary", 500),
        F.when(F.col("body").isNotNull(), F.concat(F.lit("\n"), "body")).otherwise(""), watch).alias("material"))


def related_links(links: DataFrame, digests_text: DataFrame, top: int = 3) -> DataFrame:
    """Saved links per digest ranked by title tokens found in the digest's headline, summary and headings.

    ``links(digest_id, pos, title, url)``, ``digests_text(digest_id, text)``. Without any hit the first links are used.
    """
    bag = digests_text.select("digest_id", TX.token_set("text").alias("bag"))
    ok = links.filter(F.col("url").rlike(r"(?i)^https?://\S+$") | F.col("url").rlike(r"^/[^\s/]\S*$"))
    n = F.size(F.filter(TX.raw_tokens("title"), lambda w: F.array_contains("bag", w)))
    j = ok.join(bag, "digest_id").withColumn("hits", n)
    best = j.groupBy("digest_id").agg(F.max("hits").alias("_m"))
    j = j.join(best, "digest_id").filter((F.col("hits") > 0) | (F.col("_m") == 0))
    w = W.partitionBy("digest_id").orderBy(F.desc("hits"), "pos")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("digest_id", "pos", "hits", "rank")
