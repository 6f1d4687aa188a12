"""Feed items to ranked stories: normalise, filter, de-duplicate, match, cover, score, summarise."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gristmill.functions import urls as U
from gristmill.functions.claims import ascii_bounds
from gristmill.functions.text import (
    STOPWORDS, clean_title, collapse, col_of, has_word, has_word_unicode, jstrim, let, raw_tokens, strip_tags, title_key, token_set,
)
from gristmill.operators import related as RL
from gristmill.session import cut_lineage

REDIRECT_RE = r"(?i)news\.google\.com|bing\.com/news"


def ts(as_of: str) -> Column:
    return F.to_timestamp(F.lit(as_of))


# ---- items ------------------------------------------------------------------------------------------------------
@F.pandas_udf(StringType())
def _unescape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


def unescape_entities(c) -> Column:
    """HTML entities to characters (Arrow batches; the entity table has no SQL form)."""
    return _unescape(col_of(c))


def feed_item_normalize(df: DataFrame, as_of: str, limit: int = 300) -> DataFrame:
    """Tags out, entities decoded, space collapsed, description cut, missing date = ``as_of``."""
    clean = lambda n: collapse(strip_tags(unescape_entities(F.coalesce(n, F.lit("")))))
    return df.withColumns({
        "title": clean("title"), "author": clean("author"), "description": F.substring(clean("description"), 1, limit),
        "pub_date": F.coalesce("pub_date", ts(as_of)), "redirect": F.coalesce("redirect", F.lit(False))})


def unwrap_redirect_url(df: DataFrame, link: str = "link", source: str = "source") -> DataFrame:
    """Aggregator link -> publisher address from its ``url`` parameter; source falls back to the host."""
    inner = U.wrapped_target(link)
    out = df.withColumns({"_inner": inner})
    host = F.coalesce(U.url_part(F.coalesce("_inner", link), "HOST"), F.lit(""))
    return out.withColumns({
        "redirect": F.col("_inner").isNull(),
        source: F.when(F.coalesce(source, F.lit("")) == "", host).otherwise(F.col(source)),
        link: F.coalesce("_inner", link)}).drop("_inner")


def story_project(df: DataFrame) -> DataFrame:
    """Item -> story: short summary, source fallback, thin access for video addresses, source type."""
    tail = F.element_at(F.split("title", " - ", -1), -1)
    return df.withColumns({
        "summary": F.substring(collapse(strip_tags("description")), 1, 400),
        "source": F.coalesce(F.nullif("author", F.lit("")), F.nullif(tail, F.lit("")), F.lit("News")),
        "source_type": F.when(F.coalesce("readable", F.lit("")) != "", "publisher").otherwise("aggregator"),
        "redirect": F.coalesce("redirect", F.lit(False)) | F.coalesce("link", F.lit("")).rlike(REDIRECT_RE),
        "readable": F.when(F.col("readable").isin("open", "metered") & U.is_thin_url("link"), "thin")
        .otherwise(F.coalesce(F.nullif("readable", F.lit("")), F.lit("unknown")))})


def story_compact(df: DataFrame) -> DataFrame:
    return df.select("story_id", "title", "source", "url", F.substring(F.coalesce("summary", F.lit("")), 1, 300).alias("summary"), "published_at", "readable")


# ---- filters ----------------------------------------------------------------------------------------------------
def term_list(q: Column, limit: int = 6) -> Column:
    """Search text ``a OR b`` -> cleaned distinct terms of three characters or more."""
    clean = lambda p: collapse(F.regexp_replace(p, r"[^\p{L}\p{N}\s\-]", " "))
    terms = F.filter(F.transform(F.split(q, r"(?i)\s+OR\s+", -1), clean), lambda p: F.length(p) >= 3)
    return F.slice(F.array_distinct(terms), 1, limit)


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur as whole words."""
    return let(F.lower(text), lambda low: sum((F.coalesce(has_word_unicode(low, F.lit(t.lower())), F.lit(False)).cast("int") for t in terms), F.lit(0)))


def term_filter(df: DataFrame, terms: list[str], text: Column | None = None) -> DataFrame:
    t = F.concat_ws(" ", "title", "description") if text is None else text
    # a generated column: the filter would otherwise search the text, and build it, a second time
    return df.withColumn("hits", F.explode(F.array(term_hits(t, terms)))).filter("hits > 0")


def recency_filter(df: DataFrame, as_of: str, when: str = "published_at", days: int = 5) -> DataFrame:
    return df.filter(F.col(when).isNull() | (F.col(when) >= ts(as_of) - F.expr(f"INTERVAL '{days}' DAY")))


def age_hours(when, as_of: str) -> Column:
    return (F.unix_micros(ts(as_of)) - F.unix_micros(col_of(when))) / F.lit(3.6e9)


def breaking_filter(df: DataFrame, as_of: str, hours: float = 40) -> DataFrame:
    """Breaking-lane stories at most ``hours`` old; other lanes and unknown ages are kept."""
    h = age_hours("published_at", as_of)
    return df.filter((F.col("lane") != "breaking") | h.isNull() | (h <= hours))


def unusable_key(df_url="url", df_title="title") -> Column:
    return F.coalesce(F.nullif(U.clean_url(df_url), F.lit("")), F.col(df_title))


def unusable_antijoin(df: DataFrame, marks: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Hide stories marked unusable less than ``hours`` before ``as_of``: ``marks(story_key, t)``."""
    live = marks.filter(F.col("t") > ts(as_of) - F.expr(f"INTERVAL '{hours}' HOUR")).select("story_key").distinct()
    return df.withColumn("story_key", unusable_key()).join(live, "story_key", "left_anti").drop("story_key")


def readable_filter(df: DataFrame, marks: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    out = df.filter(~F.col("readable").isin("paywalled", "thin") & ~F.col("redirect"))
    return out if marks is None else unusable_antijoin(out, marks, as_of)


# Headline words of culture, sport and celebrity stories.
SOFT_RE = (
    r"(?i)\b(festival|documentary|marathon|award|awards|wins best|van gogh|art market|concert|celebrity|prince|princess|royal"
    r"|oscars?|grammy|football|soccer|olympic|tennis|recipe|fashion)\b"
)


def soft_story(title) -> Column:
    return F.coalesce(col_of(title), F.lit("")).rlike(ascii_bounds(SOFT_RE))


# ---- order-dependent de-duplication -------------------------------------------------------------------------------
def first_wins_dedupe(df: DataFrame, order: str, title: str = "title", url: str = "url") -> DataFrame:
    """Walk items in ``order`` (unique) and drop those whose title key or clean address was kept before.

    A dropped item does not block later ones, so one pass per key would not be exact. Each round keeps the items that
    are first in both of their groups and drops everything that collides with them; rounds repeat until no item is left.
    The first item left is always kept, so every round shrinks them. An empty title key, as an empty address, is no key.
    Groups are reduced by ``min`` with map-side combine, so a headline on a third of all items is one row per task.
    """
    keys = cut_lineage(df.select(F.col(order).alias("o"), F.nullif(title_key(title), F.lit("")).alias("t"), F.nullif(U.clean_url(url), F.lit("")).alias("u")))
    left, kept = keys, None
    while True:
        t_first = left.filter("t is not null").groupBy("t").agg(F.min("o").alias("o"))
        u_first = left.filter("u is not null").groupBy("u").agg(F.min("o").alias("o"))
        no_url, no_title = left.filter("u is null").select("o"), left.filter("t is null").select("o")
        win = left.join(t_first.select("o").unionByName(no_title), "o", "left_semi").join(u_first.select("o").unionByName(no_url), "o", "left_semi")
        win = cut_lineage(win)
        kept = win if kept is None else kept.unionByName(win)
        rest = left.join(win.select("o"), "o", "left_anti").join(win.filter("t is not null").select("t"), "t", "left_anti")
        rest = rest.join(win.filter("u is not null").select("u"), "u", "left_anti")
        left = cut_lineage(rest)
        if not left.limit(1).count():
            return df.join(kept.select(F.col("o").alias(order)), order, "left_semi")


def per_feed_cap(df: DataFrame, n: int = 40, feed: str = "feed", order: str = "story_id") -> DataFrame:
    """First ``n`` items per feed. Ranks are cut before the shuffle, so a giant feed sends ``n`` rows per task."""
    w = W.partitionBy(feed).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def feed_sort(df: DataFrame, n: int = 60) -> DataFrame:
    return df.orderBy(F.desc("hits"), F.desc("published_at"), "story_id").limit(n)


def lane_union(publisher: DataFrame, search: DataFrame, breaking: DataFrame) -> DataFrame:
    parts = [p.withColumn("lane", F.lit(n)) for p, n in ((publisher, "publisher"), (search, "search"), (breaking, "breaking"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


# ---- topics -------------------------------------------------------------------------------------------------------
Profile = list[tuple[str, float, list[str]]]


def signal_hits(text_lower: Column, profile: Profile) -> Column:
    """Array of (topic, weight) of the signals found in the text.

    A profile is a hand-written list, so it is small by nature; each signal becomes a literal pattern that is
    compiled once, instead of a join that would repeat the text per signal.
    """
    return F.array_compact(F.array(*[
        F.when(has_word(text_lower, F.lit(s.lower())), F.struct(F.lit(name).alias("topic"), F.lit(float(weight)).alias("weight")))
        for name, weight, signals in profile for s in signals if s]))


def topic_match(df: DataFrame, profile: Profile) -> DataFrame:
    """Add ``topic_score`` (10 x weight per matched signal) and ``matched`` (topic names)."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    out = df.withColumn("_text", text).withColumn("_hit", signal_hits(F.col("_text"), profile))
    return out.withColumns({
        "topic_score": F.aggregate("_hit", F.lit(0.0), lambda a, s: a + s["weight"] * 10),
        "matched": F.array_distinct(F.transform("_hit", lambda s: s["topic"]))}).drop("_text", "_hit")


def story_sets(df: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Stories with their title token set and its key."""
    t = token_set(clean_title("title")) if tokens is None else tokens
    return df.withColumn("tokens", t).withColumn("key", RL.set_key(F.col("tokens")))


def distinct_sets(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("key").agg(F.any_value("tokens").alias("tokens"))


def coverage(df: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Add ``coverage``: distinct outlets, own one included, that carry the same story.

    Works on distinct title sets, so a wire story copied by a third of all rows is one node, not a clique; sets meet in
    blocks, and only counts leave a task. With ``changed(title)``, the stories that came or went, only the stories whose
    coverage they can change are returned.
    """
    keyed = story_sets(df).withColumn("_outlet", F.lower(F.coalesce("source", F.lit(""))))
    big = keyed.filter(F.size("tokens") >= 3).select("key", "tokens", "_outlet")
    sets = big.groupBy("key").agg(F.any_value("tokens").alias("tokens"), F.collect_set(F.xxhash64("_outlet")).alias("outlets"))
    sets = cut_lineage(sets.withColumn("id", F.monotonically_increasing_id()))
    every = RL.coded(sets, RL.COVERAGE, "outlets", "key")
    left = every
    if changed is not None:
        moved = cut_lineage(distinct_sets(story_sets(changed.select("title"))).withColumn("id", F.monotonically_increasing_id()))
        met = RL.met_by(RL.coded(moved.filter(F.size("tokens") >= 3), RL.COVERAGE), every.select("id", "t", "codes"))
        # stories without a token have the empty key, which every story without one shares
        touched = cut_lineage(moved.select("key").unionByName(every.join(met, "id").select("key")).unionByName(df.sparkSession.createDataFrame([("",)], "key string")).distinct())
        keyed, left = keyed.join(touched, "key", "left_semi"), every.join(touched, "key", "left_semi")
    counted = RL.outlet_counts(left.select("id", "t", "codes"), every.select("id", "t", "codes", "outlets"))
    counted = cut_lineage(every.select("id", "key").join(counted, "id").select("key", F.col("n").alias("_cov")))
    j = keyed.join(counted, "key", "left")
    return j.withColumn("coverage", F.coalesce("_cov", F.lit(1)).cast("int")).drop("key", "tokens", "_outlet", "_cov")


def story_score(df: DataFrame, as_of: str) -> DataFrame:
    """Topic score + freshness + open access + coverage boost. Needs ``topic_score`` and ``coverage``."""
    h = age_hours("published_at", as_of)
    fresh = F.when(h < 6, 4).when(h < 24, 2).otherwise(0)
    open_ = F.when(F.col("readable") == "open", 3).otherwise(0)
    return df.withColumn("score", F.round(F.col("topic_score") + fresh + open_ + F.least(F.col("coverage"), F.lit(6)) * 1.2, 6))


def top_stories(df: DataFrame, top: int = 48, lift: int = 12) -> DataFrame:
    """Best stories by score plus widely covered breaking-lane stories."""
    best = df.filter(F.col("lane") != "breaking").orderBy(F.desc("score"), "story_id").limit(top)
    wide = df.filter((F.col("lane") == "breaking") & (F.col("coverage") >= 3)).orderBy(F.desc("coverage"), F.desc("score"), "story_id").limit(lift)
    return best.unionByName(wide).orderBy(F.desc("score"), "story_id")


def feed_view_sort(df: DataFrame, view: str = "match") -> DataFrame:
    """``match``, ``covered``, ``new`` or ``outlet`` order."""
    keys = {
        "match": [F.desc("score")], "covered": [F.desc("coverage"), F.desc("score")],
        "new": [F.desc_nulls_last("published_at")], "outlet": [F.asc("source"), F.desc("score")]}[view]
    return df.orderBy(*keys, "story_id")


# ---- summaries ------------------------------------------------------------------------------------------------------
def feed_stats(registry: DataFrame, fetched: DataFrame, items: DataFrame, matched: DataFrame) -> DataFrame:
    """Per feed of the registry: fetch state, item count, matched count."""
    n = items.groupBy("feed").agg(F.count(F.lit(1)).alias("items"))
    m = matched.groupBy("feed").agg(F.count(F.lit(1)).alias("matched"))
    j = registry.select("feed", "access").join(fetched, "feed", "left").join(n, "feed", "left").join(m, "feed", "left")
    return j.select("feed", "access", F.coalesce("ok", F.lit(False)).alias("ok"), "code", F.coalesce("items", F.lit(0)).alias("items"),
                    F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("error", F.lit("")).alias("error"))


def feed_overview(df: DataFrame, profile: Profile, as_of: str, outlets: int = 10) -> DataFrame:
    """Tidy overview (section, name, n, share, advice) of a feed that has ``matched``."""
    readable = ~F.col("readable").isin("paywalled", "thin") & ~F.col("redirect")
    h = age_hours("published_at", as_of)
    name = F.coalesce(F.nullif(jstrim("source"), F.lit("")), F.lit("News"))
    base = df.select(name.alias("outlet"), readable.alias("readable"), (h <= 24).alias("fresh"), "matched")
    tot = base.agg(
        F.count(F.lit(1)).alias("stories"), F.count_distinct("outlet").alias("outlets"), F.count_if("readable").alias("readable"),
        F.count_if("fresh").alias("fresh"), F.count_if(F.size("matched") == 0).alias("unmatched"),
        *[F.count_if(F.array_contains("matched", t)).alias(f"t{i}") for i, (t, _, _) in enumerate(profile)])
    share = lambda x: F.round(F.try_divide(F.col(x), F.col("stories")), 6)
    def row(section, label, n, advice, sh=None):
        return F.struct(F.lit(section).alias("section"), F.lit(label).alias("name"), F.col(n).alias("n"),
                        (sh if sh is not None else share(n)).alias("share"), F.coalesce(advice, F.lit(False)).alias("advice"))
    rows = [
        row("total", "stories", "stories", F.lit(False)), row("total", "outlets", "outlets", F.lit(False)),
        row("total", "readable", "readable", share("readable") < 0.5), row("total", "fresh", "fresh", F.lit(False)),
        row("topic", "(none)", "unmatched", share("unmatched") > 0.5)]
    rows += [row("topic", t, f"t{i}", F.col(f"t{i}") <= 1) for i, (t, _, _) in enumerate(profile)]
    totals = tot.select(F.inline(F.array(*rows)))
    per = base.groupBy("outlet").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "outlet").limit(outlets)
    ranked = per.withColumn("_r", F.row_number().over(W.orderBy(F.desc("n"), "outlet"))).crossJoin(F.broadcast(tot.select("stories")))  # one row of totals
    sh = F.round(F.col("n") / F.col("stories"), 6)
    top = ranked.select(F.lit("outlet").alias("section"), F.col("outlet").alias("name"), "n", sh.alias("share"), ((F.col("_r") == 1) & (sh > 0.4)).alias("advice"))
    return totals.unionByName(top)


def vocabulary_topics(df: DataFrame, title: str = "title", description: str = "summary") -> DataFrame:
    """Top 24 weighted terms, merged by their first three letters; the three heaviest groups become topics."""
    words = lambda c, w: F.transform(raw_tokens(c), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    terms = df.select(F.inline(F.concat(words(F.col(title), 2), words(F.substring(description, 1, 200), 1))))
    top = terms.groupBy("term").agg(F.sum("w").alias("weight")).orderBy(F.desc("weight"), "term").limit(24)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("weight"), "term")))
    g = ranked.groupBy(F.substring("term", 1, 3).alias("stem")).agg(
        F.sum("weight").alias("weight"), F.min("rank").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    best = g.orderBy(F.desc("weight"), "first").limit(3)
    return best.select(
        F.initcap(F.get("terms", F.lit(0))).alias("name"), "weight", F.array_join(F.transform(F.slice("terms", 2, 3), F.initcap), ",").alias("subtopics"),
        F.array_join(F.slice("terms", 1, 6), ",").alias("signals"))


def duration_average(df: DataFrame, seconds: str) -> DataFrame:
    return df.agg(F.floor(F.avg(F.when(F.col(seconds) > 0, F.col(seconds))) + 0.5).cast("bigint").alias("average_seconds"))


def pulse_headlines(df: DataFrame, order: str = "story_id") -> DataFrame:
    """Distinct recent headlines by a 50-character key, first one wins: (title, text, source)."""
    key = title_key("title", 50)
    keep = F.struct(F.col("title").alias("title"), F.col("summary").alias("summary"), F.col("source").alias("source"))
    g = df.filter(key != "").groupBy(key.alias("key")).agg(F.min_by(keep, F.col(order)).alias("r"))
    return g.select(clean_title("r.title").alias("title"), F.lower(F.concat(clean_title("r.title"), F.lit(" "), strip_tags("r.summary"))).alias("text"), F.col("r.source").alias("source"))


def pulse_heat(headlines: DataFrame, profile: Profile) -> DataFrame:
    """Per topic: headlines that hold one of its signals, and their distinct outlets."""
    usable = [(n, w, [x.strip() for x in sig if len(x.strip()) >= 3]) for n, w, sig in profile]
    hit = F.array_distinct(F.transform(signal_hits(F.col("text"), usable), lambda s: s["topic"]))
    g = headlines.select(F.explode(hit).alias("topic"), F.lower("source").alias("source"))
    return g.groupBy("topic").agg(F.count(F.lit(1)).alias("headlines"), F.count_distinct("source").alias("outlets"))


def build_topic_queries(topics: DataFrame, limit: int = 4) -> DataFrame:
    """Signals taken in turn from each topic, repeats dropped, paired into ``a OR b`` searches.

    ``topics(topic_no, signals)``.
    """
    return queries_from_signals(topics.select("topic_no", F.posexplode("signals").alias("pos", "s")), limit)


# Fetch error code -> what a reader is told.
FETCH_REASONS = {
    "http_404": "the page no longer exists (404)", "http_410": "the page no longer exists (410)",
    "paywalled": "the article is behind a paywall",
    "too_short": "the page has no readable article text (live page, video, or text drawn by script)",
    "rate_limited": "the reader hit its rate limit, try again in a few minutes",
    "decode_failed": "it is an aggregator link that could not be resolved to the publisher",
    "redirect_link": "it is an aggregator link that could not be resolved to the publisher",
    "not_html": "the link is not a web page",
}


def fetch_error_reason(code) -> Column:
    c = F.coalesce(col_of(code), F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in FETCH_REASONS.items() for x in kv])
    status = F.substring(c, 6, 100)
    return (
        F.when(c == "", "").when(c.rlike("^http_(401|403|406)"), F.concat(F.lit("the publisher blocks automated readers ("), status, F.lit(")")))
        .when(table[c].isNotNull(), table[c]).when(c.startswith("http_"), F.concat(F.lit("the publisher answered "), status))
        .otherwise(F.concat(F.lit("the page could not be fetched ("), c, F.lit(")"))))


# ---- related stories ------------------------------------------------------------------------------------------------
def related_stories(df: DataFrame, top: int = 8) -> DataFrame:
    """Per story the ``top`` others sharing most title tokens: (story_id, other_id, shared, rank).

    A title set needs only its ``top + 1`` first stories, and one list per title set serves all its copies.
    """
    keyed = cut_lineage(story_sets(df.select("story_id", "title")).filter(F.size("tokens") >= 2).select("story_id", "key", "tokens"))
    sets = cut_lineage(distinct_sets(keyed).withColumn("id", F.monotonically_increasing_id()))
    w = W.partitionBy("key").orderBy("story_id")
    members = keyed.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top + 1).select(F.col("story_id").alias("id"), "tokens")
    best = RL.best_matches(RL.coded(sets, RL.RELATED), RL.coded(members, RL.RELATED), top + 1)
    lists = best.groupBy(F.col("left_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("s"), "other_id"))).alias("_l"))
    j = keyed.select("key", "story_id").join(sets.select("key", "id").join(lists, "id"), "key")
    mine = F.slice(F.filter("_l", lambda x: x["other_id"] != F.col("story_id")), 1, top)
    return j.select("story_id", F.posexplode(mine).alias("_p", "_x")).select(
        "story_id", F.col("_x.other_id").alias("other_id"), (-F.col("_x.s")).alias("shared"), (F.col("_p") + 1).alias("rank"))


def second_outlet(df: DataFrame, top: int = 3, per_outlet: int | None = None) -> DataFrame:
    """Open stories of another host and outlet about the same event: (story_id, other_id, shared, rank).

    Copies collapse twice: anchors to distinct (title set, host, outlet), candidates to their first ``top`` stories per
    (title set, host, outlet). Both reductions are exact because the exclusion looks at host and outlet only.
    ``per_outlet=1`` keeps one candidate per outlet (used when asking for corroboration).
    """
    from gristmill.functions.text import sig_tokens
    base = story_sets(df.select("story_id", "title", "url", "source", "readable"), sig_tokens(clean_title("title"))).filter(F.size("tokens") >= 2)
    base = base.withColumns({"host": U.root_host(U.host_of("url")), "outlet": F.lower(F.coalesce("source", F.lit("")))})
    base = cut_lineage(base.filter("host IS NOT NULL"))
    place = ["key", "host", "outlet"]
    anchors = base.filter(F.size("tokens") >= 3)
    open_ = base.filter((F.col("readable") == "open") & ~U.is_thin_url("url") & (F.col("url") != ""))
    w = W.partitionBy(*place).orderBy("story_id")
    cand = open_.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top).select(F.col("story_id").alias("id"), "tokens", "host", "outlet")
    groups = cut_lineage(anchors.groupBy(*place).agg(F.any_value("tokens").alias("tokens")).withColumn("id", F.monotonically_increasing_id()))
    sides = [RL.coded(x, RL.RELATED, "host", "outlet") for x in (groups, cand)]
    best = RL.best_matches(*sides, top, apart=True, each=per_outlet)
    rank = F.row_number().over(W.partitionBy("left_id").orderBy(F.desc("shared"), "other_id"))
    best = groups.select(*place, F.col("id").alias("left_id")).join(best.withColumn("rank", rank), "left_id")
    return anchors.select("story_id", *place).join(best, place).select("story_id", "other_id", "shared", "rank")


def resolve_source(df: DataFrame, articles: DataFrame) -> DataFrame:
    """Story -> article to read: its own, else the best open related story, else second-outlet candidates in order.

    ``articles(story_id)`` lists stories whose text could be read. Result: (story_id, via, source_story_id).
    """
    df = cut_lineage(df.select("story_id", "title", "url", "source", "readable", "redirect"))
    have = articles.select(F.col("story_id").alias("source_story_id")).distinct()
    own = df.filter(~F.col("readable").isin("paywalled", "thin")).select("story_id", F.col("story_id").alias("source_story_id"), F.lit(0).alias("priority"), F.lit("direct").alias("via"))
    rel = related_stories(df, 8).join(
        df.filter((F.col("readable") == "open") & ~F.col("redirect")).select(F.col("story_id").alias("other_id")), "other_id", "left_semi")
    first = rel.groupBy("story_id").agg(F.min_by("other_id", "rank").alias("source_story_id")).select("story_id", "source_story_id", F.lit(1).alias("priority"), F.lit("alternative").alias("via"))
    alt = second_outlet(df).select("story_id", F.col("other_id").alias("source_story_id"), (F.col("rank") + 1).alias("priority"), F.lit("alternative").alias("via"))
    every = own.unionByName(first).unionByName(alt).join(have, "source_story_id", "left_semi")
    return every.groupBy("story_id").agg(F.min_by(F.struct("via", "source_story_id"), "priority").alias("r")).select("story_id", "r.*")


def event_groups(df: DataFrame) -> DataFrame:
    """Stories of the same event reported by two outlets or more: (story_id, group_id, stories, outlets)."""
    keyed = cut_lineage(story_sets(df.select("story_id", "title", "source")).filter(F.size("tokens") >= 2))
    sets = cut_lineage(distinct_sets(keyed).withColumn("id", F.monotonically_increasing_id()))
    labels = RL.components(sets.select(F.col("id").alias("node")), RL.match_forest(RL.coded(sets, RL.event_rule)))
    j = keyed.join(sets.select("key", F.col("id").alias("node")).join(labels, "node").select("key", "label"), "key")
    outlet = F.coalesce(F.nullif("source", F.lit("")), F.col("story_id").cast("string"))
    g = j.groupBy("label").agg(F.min("story_id").alias("group_id"), F.count(F.lit(1)).alias("stories"), F.count_distinct(outlet).alias("outlets"))
    g = g.filter("stories >= 2 and outlets >= 2")
    return j.join(g, "label").select("story_id", "group_id", "stories", "outlets")


def queries_from_signals(signals: DataFrame, limit: int = 4) -> DataFrame:
    """``build_topic_queries`` for signals held as rows ``(topic_no, pos, s)``."""
    stop = sorted(set(STOPWORDS))
    s = signals.withColumn("s", jstrim("s"))
    s = s.filter((F.length("s") >= 3) & (F.contains("s", F.lit(" ")) | ~F.lower("s").isin(stop)))
    uniq = s.groupBy(F.lower("s").alias("k")).agg(F.min(F.struct("pos", "topic_no", "s")).alias("f")).select("f.*")
    first = uniq.orderBy("pos", "topic_no").limit(limit * 2)
    ranked = first.withColumn("rn", F.row_number().over(W.orderBy("pos", "topic_no")))
    return ranked.groupBy(F.floor((F.col("rn") - 1) / 2).cast("int").alias("query_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "s"))), lambda x: x["s"]), " OR ").alias("q"))


def site_sample(pages: DataFrame, n: int = 15) -> DataFrame:
    """Per site: the first ``n`` pages with title (120 characters) and meta description (400)."""
    title = F.substring(collapse(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, 120)
    meta = F.substring(collapse(F.regexp_extract("html", r"(?is)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']*)", 1)), 1, 400)
    df = pages.withColumn("site", U.host_of("url"))
    w = W.partitionBy("site").orderBy("page_id")
    top = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    return top.select("site", "page_id", title.alias("title"), meta.alias("description"))
