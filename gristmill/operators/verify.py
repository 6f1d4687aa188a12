"""Facts, quotes, charts and scripts checked against their source texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gristmill.functions import claims as C
from gristmill.functions.text import count_words, jstrim, norm_quote, sentences, shorten
from gristmill.session import cut_lineage


def plain_words(c) -> Column:
    """Comparison form of quotes and articles: lower case, white space and punctuation to single spaces."""
    return F.trim(F.regexp_replace(norm_quote(c), r"[^\p{L}\p{N}…]+", " "))


def quote_verify(facts: DataFrame, articles: DataFrame) -> DataFrame:
    """(fact_id, verified, reason). ``facts(fact_id, story_id, claim, quote)`` meets its own article by story id."""
    j = facts.join(articles.select("story_id", F.col("text").alias("article")), "story_id", "left")
    q, art = plain_words("quote"), plain_words(F.coalesce("article", F.lit("")))
    j = j.withColumn("_q", q).withColumn("_a", art)
    parts = F.filter(F.transform(F.split("_q", "…", -1), lambda x: F.trim(x)), lambda s: F.length(s) >= 20)
    found = F.when(F.contains("_q", F.lit("…")), (F.size(parts) > 0) & F.forall(parts, lambda s: F.contains("_a", s))).otherwise(F.contains("_a", F.col("_q")))
    speaker = F.regexp_extract("claim", r"^((?:[A-Z][\w'’-]*\s+){1,4})(?:said|says)(?!\w)", 1)
    names = F.filter(F.split(plain_words(speaker), " ", -1), lambda w: F.length(w) > 2)
    balanced = (F.regexp_count("claim", F.lit('"')) % 2 == 0) & (F.regexp_count("claim", F.lit("“")) == F.regexp_count("claim", F.lit("”")))
    reason = (
        F.when(F.length("_q") < 25, "short quote").when(count_words("claim") < 4, "short claim").when(F.col("claim").rlike(r"^\p{Ll}"), "fragment")
        .when(~balanced, "unbalanced marks").when(~F.forall(names, lambda w: F.contains("_q", w)), "speaker").when(~found, "not in article").otherwise(""))
    return j.select("fact_id", (reason == "").alias("verified"), reason.alias("reason"))


#: Rows up to which the keys of quotes and the pairs to look at go to every task; the articles are shuffled beyond that.
FEW = 50_000


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` written once, and broadcast in joins while they are few by count."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def quote_lookup(quotes: DataFrame, articles: DataFrame, k: int = 5) -> DataFrame:
    """(quote_id, story_id) once for every article that holds the quote, when the article is not known.

    If a quote is inside an article, its inner words stand there as whole words. A quote of ``k + 2`` words or more is
    looked up by the run of its words 2 to k + 1, one of three words or more by its longest inner word. The first or only
    word of a shorter quote may be the end or any part of a word, so those quotes are first met with the distinct words of
    all articles, by three letters, and looked up by the words found. The containment test then decides.
    Quotes without words are in no article; repeated quotes and articles give one row.
    """
    q = quotes.select("quote_id", plain_words("quote").alias("q")).withColumn("_w", F.split("q", " ", -1)).filter("q <> ''")
    size = F.size("_w")
    inner = F.array_max(F.transform(F.slice("_w", F.lit(2), size - 2), lambda w: F.struct(F.length(w).alias("len"), w.alias("word"))))["word"]
    key = F.when(size >= k + 2, F.struct(F.lit(k).alias("n"), F.array_join(F.slice("_w", 2, k), " ").alias("run"))).otherwise(F.struct(F.lit(1).alias("n"), inner.alias("run")))
    long = q.filter(size > 2).select("quote_id", "q", key.alias("key")).select("quote_id", "q", "key.n", F.xxhash64("key.run").alias("run"))

    # the plain words are read three times
    a = cut_lineage(articles.select("story_id", plain_words("text").alias("a"))).withColumn("_w", F.split("a", " ", -1))
    head = F.col("_w")[0]
    short = q.filter(size <= 2).select(
        "quote_id", "q", head.alias("head"), (size == 2).alias("at_end"), F.when(size == 2, F.right(head, F.lit(3))).otherwise(F.left(head, F.lit(3))).alias("letters"))
    words = a.select(F.explode(F.array_distinct("_w")).alias("word")).distinct()
    few = F.sequence(F.lit(1), F.lit(3))
    ends = F.transform(few, lambda n: F.right("word", n))
    inside = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), lambda i: F.transform(few, lambda n: F.substring("word", i, n))))
    places = F.concat(*[F.transform(F.array_distinct(x), lambda t: F.struct(F.lit(at_end).alias("at_end"), t.alias("letters"))) for at_end, x in ((True, ends), (False, inside))])
    holds = F.when(F.col("at_end"), F.endswith("word", "head")).otherwise(F.contains("word", "head"))
    met = words.select("word", F.inline(places)).join(short, ["at_end", "letters"]).filter(holds)
    keys = _few(long.unionByName(met.select("quote_id", "q", F.lit(1).alias("n"), F.xxhash64("word").alias("run"))))

    # hashes are made distinct before they become structs: sets of structs are compared pair by pair
    of = lambda n, runs: F.transform(F.array_distinct(runs), lambda r: F.struct(F.lit(n).alias("n"), r.alias("run")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - k + 1, F.lit(1)))
    many = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("_w", i, k), " ")))
    hits = a.select("story_id", F.inline(F.concat(of(1, F.transform("_w", lambda w: F.xxhash64(w))), of(k, many))))
    pairs = _few(hits.join(keys, ["n", "run"]).select("quote_id", "q", "story_id").distinct())
    return pairs.join(a.select("story_id", "a"), "story_id").filter(F.contains("a", F.col("q"))).select("quote_id", "story_id").distinct()


def chart_verify(charts: DataFrame, sources: DataFrame, keep: int = 8) -> DataFrame:
    """Charts whose quote stands in the tagged source and whose points stand in the quote.

    ``charts(chart_id, section_id, tag, type, title, unit, quote, points)``, ``sources(section_id, tag, text)``.
    """
    j = charts.join(sources.select("section_id", "tag", "text"), ["section_id", "tag"])
    j = j.filter((F.length(norm_quote("quote")) >= 12) & F.contains(norm_quote("text"), norm_quote("quote")))
    quoted = F.transform(C.num_tokens("quote"), C.num_key)
    j = j.withColumn("_q", quoted)
    scaled = lambda r: r.rlike(r"(?i)million|billion|bn|k|m|%|percent")
    def good(p):
        k = C.num_key(p["raw"])
        num = F.regexp_extract(k, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
        same = (F.abs(num - F.abs(p["value"])) <= 1e-9) | (num == p["value"])
        return p["value"].isNotNull() & (k != "") & (F.coalesce(p["label"], F.lit("")) != "") & F.array_contains(F.col("_q"), k) & (F.coalesce(same, F.lit(False)) | scaled(p["raw"]))
    kind = F.when(F.col("type").isin("line", "stat"), F.col("type")).otherwise("bar")
    j = j.withColumn("_n", F.size("points")).withColumn("points", F.filter("points", good)).withColumn("type", kind)
    one_unit = F.size(F.array_distinct(F.transform("points", lambda p: C.unit_sign(p["raw"])))) <= 1
    n = F.size("points")
    ok = F.when(F.col("type") == "stat", n >= 1).otherwise(one_unit & (n >= 2) & (n >= F.col("_n") - 1))
    limit = F.when(F.col("type") == "stat", 1).otherwise(keep)
    return j.filter(ok).select(
        "chart_id", "section_id", "tag", "type", shorten("title", 80).alias("title"), shorten("unit", 30).alias("unit"), shorten("quote", 240).alias("quote"),
        F.transform(F.slice("points", F.lit(1), limit), lambda p: F.struct(shorten(p["label"], 28).alias("label"), jstrim(p["raw"]).alias("raw"), p["value"].alias("value"))).alias("points"))


# ---- corroboration ----------------------------------------------------------------------------------------------------
STATUS_RANK = {"conflict": 3, "confirmed": 2, "possible": 1, "single": 0}


def corroborate_check(facts: DataFrame, comparisons: DataFrame, articles: DataFrame, overlap: float = 0.6) -> DataFrame:
    """Re-check what a comparison claims: (fact_id, outlet, status).

    ``comparisons(fact_id, outlet, other_story_id, status, other_quote)``. A confirmation stands when the other quote is
    in the other article and carries the claim's numbers and enough of its words; a conflict needs differing numbers.
    """
    j = comparisons.join(facts.select("fact_id", "claim"), "fact_id").join(articles.select(F.col("story_id").alias("other_story_id"), "text"), "other_story_id", "left")
    inside = (F.length(plain_words("other_quote")) > 0) & F.contains(plain_words(F.coalesce("text", F.lit(""))), plain_words("other_quote"))
    differ = F.size(C.numbers_missing("claim", "other_quote")) > 0
    words = C.claim_overlap("claim", "other_quote") >= overlap
    status = (
        F.when((F.col("status") == "confirmed") & inside & ~differ & words, "confirmed")
        .when((F.col("status") == "conflict") & inside & differ, "conflict")
        .when(F.col("status") == "conflict", "possible").when(F.col("status") == "possible", "possible").otherwise("single"))
    return j.select("fact_id", "outlet", status.alias("status"))


def corroborate_merge(facts: DataFrame, checked: DataFrame) -> DataFrame:
    """Highest status per fact over all outlets and the outlets that confirm it."""
    rank = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])
    g = checked.groupBy("fact_id").agg(
        F.max_by("status", rank[F.col("status")]).alias("status"), F.array_sort(F.collect_set(F.when(F.col("status") == "confirmed", F.col("outlet")))).alias("confirmed_by"))
    j = facts.select("fact_id").join(g, "fact_id", "left")
    return j.select("fact_id", F.coalesce("status", F.lit("single")).alias("status"), F.coalesce("confirmed_by", F.array().cast("array<string>")).alias("confirmed_by"))


def outlet_event_merge(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of one event from several outlets as one list: (group_id, claim_key, outlets, facts, first_fact).

    ``groups(story_id, group_id)``, ``facts(fact_id, story_id, outlet, claim)``. Claims with equal words are one fact.
    """
    j = facts.join(groups.select("story_id", "group_id"), "story_id").withColumn("claim_key", plain_words("claim"))
    return j.groupBy("group_id", "claim_key").agg(F.count_distinct("outlet").alias("outlets"), F.count(F.lit(1)).alias("facts"), F.min("fact_id").alias("first_fact"))


def conflict_rollup(facts: DataFrame) -> DataFrame:
    """Per script: confirmed, conflicting, possible and extra facts and the overall status."""
    g = facts.groupBy("script_id").agg(
        F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count(F.lit(1)).alias("total"), F.count_if("extra").alias("extra"),
        F.count_if(F.col("status") == "conflict").alias("conflicts"), F.count_if(F.col("status") == "possible").alias("possible"))
    status = (
        F.when(F.col("conflicts") > 0, "conflict").when((F.col("confirmed") > 0) & (F.col("confirmed") * 2 >= F.col("total") - F.col("extra")), "corroborated")
        .when(F.col("confirmed") > 0, "partial").otherwise("none"))
    return g.withColumn("status", status)


def script_gate(scripts: DataFrame) -> DataFrame:
    """``checked`` only when every check passed, else ``review``."""
    ok = (
        (F.col("facts_verified") >= 3) & (F.col("bad_numbers") == 0) & (F.col("bad_terms") == 0) & ~F.col("too_long") & F.col("audit_ran")
        & (F.col("major_flags") == 0) & (F.col("corroboration") != "conflict") & (F.col("possible") == 0))
    return scripts.select("script_id", F.when(ok, "checked").otherwise("review").alias("gate"))


def fact_budget_trim(facts: DataFrame, budget: Column | int) -> DataFrame:
    """Conflicts, then confirmed facts, then the rest in their order, up to the budget of the script."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    order = F.when(F.col("status") == "conflict", 0).when(F.col("status") == "confirmed", 1).otherwise(2)
    w = W.partitionBy("script_id").orderBy(order, "ord")
    return facts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= budget)


def plan_length(df: DataFrame, bonus: int, choices: list[int]) -> DataFrame:
    """Target seconds from facts and text, to the nearest allowed length (the shorter one on a tie)."""
    raw = F.least(20 + 4 * F.col("facts") + F.when(F.col("outlets") > 1, F.lit(bonus)).otherwise(0), 0.55 * F.col("words") / 2.5, F.when(F.col("breaking"), 60).otherwise(90))
    near = F.array_min(F.array(*[F.struct(F.abs(F.lit(c) - raw).alias("d"), F.lit(c).alias("c")) for c in sorted(choices)]))
    return df.withColumn("seconds", near["c"])


def word_bounds(seconds: Column) -> Column:
    """Word range of a script at 2.5 words per second."""
    w = seconds * 2.5
    return F.struct(F.floor(w * 0.85 + 0.5).cast("bigint").alias("word_min"), F.floor(w * 1.1 + 0.5).cast("bigint").alias("word_max"))


# ---- sentences ----------------------------------------------------------------------------------------------------------
def flagged_sentences(drafts: DataFrame, key: list[str], top: int = 12) -> DataFrame:
    """Sentences with stock phrases outside quotations: (key..., part, para, sentence_no, sentence, hits), ``top`` per draft."""
    p = drafts.select(*key, F.posexplode("paragraphs").alias("para", "t"), F.lit("p").alias("part"))
    r = drafts.filter(F.coalesce("reading", F.lit("")) != "").select(*key, F.lit(0).alias("para"), F.col("reading").alias("t"), F.lit("r").alias("part"))
    s = p.select(*key, "part", "para", F.posexplode(sentences("t")).alias("no", "s")).unionByName(r.select(*key, "part", "para", F.posexplode(sentences("t")).alias("no", "s")))
    marks = F.regexp_count("s", F.lit("[\"\u201c\u201d]"))
    before = W.partitionBy(*key, "part", "para").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_q", marks).withColumn("_in", F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2 == 1)
    s = s.filter((F.col("part") == "r") | (~F.col("_in") & (F.col("_q") == 0))).withColumn("hits", F.size(C.stock_phrases("s"))).filter("hits > 0")
    w = W.partitionBy(*key).orderBy("part", "para", "no")
    return s.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top).select(*key, "part", "para", F.col("no").alias("sentence_no"), jstrim("s").alias("sentence"), "hits")


# Places where a long sentence may be cut, and how the second half begins.
JOINS = [
    (r";\s+(?=[a-z])", ""), (r",\s+but\s+", "But "), (r",\s+(?:whereas|while)\s+(?=(?!\w+ing\b)\w)", "Meanwhile, "),
    (r"(?i),\s+and\s+(?=(?:the|it|he|she|they|we|there|this|that|these|those|its|his|her|their)\s)", ""), (r",\s+so\s+(?=\w)", "So "),
    (r",\s+which\s+(?=(?:means|suggests|shows|is|was)\s)", "That "),
]


def best_cut(sentence: Column) -> Column:
    """(left, right) of a sentence of more than 20 words without quotes, cut at the join nearest its middle that leaves
    six words on both sides; null where there is none. Among equally near ones the earlier rule counts, then the place."""
    from gristmill.functions.text import let

    def places(body: Column) -> Column:
        length = lambda texts: F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t))

        def of_rule(rank: int, pattern: str, lead: str) -> Column:
            joins, gaps = F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), F.split(body, pattern, -1)
            place = lambda m, at: F.struct(F.abs(at - F.length(body) / 2).alias("off"), F.lit(rank).alias("rank"), at.alias("at"), F.length(m).alias("n"), F.lit(lead).alias("lead"))
            return F.transform(joins, lambda m, i: let(length(F.slice(gaps, F.lit(1), i + 1)) + length(F.slice(joins, F.lit(1), i)), lambda at: place(m, at)))

        found = [of_rule(rank, *rule) for rank, rule in enumerate(JOINS)]
        left, right = lambda x: F.substr(body, F.lit(1), x["at"]), lambda x: F.substr(body, x["at"] + x["n"] + 1)
        fits = F.filter(F.concat(*found), lambda x: (count_words(left(x)) >= 6) & (count_words(right(x)) >= 6))
        def halves(x: Column) -> Column:
            second = F.concat(x["lead"], right(x))
            tail = F.substr(sentence, F.length(body) + 1)
            return F.struct(F.concat(F.regexp_replace(left(x), r"[,;:\s]+$", ""), F.lit(". ")).alias("left"),
                            F.concat(F.upper(F.substring(second, 1, 1)), F.substr(second, F.lit(2)), tail).alias("right"))
        return let(F.array_min(fits), lambda x: F.when(x.isNotNull(), halves(x)))

    body = F.regexp_replace(sentence, r"\s+\z", "")
    long_plain = (count_words(sentence) > 20) & ~sentence.rlike("[\"“”]")
    return F.when(long_plain, let(body, places))


def easy_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with long sentences split until none has a place to cut. Sentences are rows, all of them are cut at
    once, and the halves of a round are the sentences of the next; the path of halves keeps their order."""
    from gristmill.functions.text import collapse, sentences_safe
    live = df.select(key, F.posexplode(sentences_safe(text)).alias("no", "s")).select(key, F.array("no").alias("path"), "s")
    done = None
    while True:
        live = cut_lineage(live.withColumn("c", best_cut(F.col("s"))))
        whole = live.filter("c IS NULL").drop("c")
        done = whole if done is None else done.unionByName(whole)
        live = live.filter("c IS NOT NULL").select(key, "path", F.posexplode(F.array("c.left", "c.right")).alias("half", "s"))
        if live.isEmpty():
            break
        live = live.select(key, F.concat("path", F.array("half")).alias("path"), "s")
    ordered = F.array_sort(F.collect_list(F.struct("path", "s")))
    return done.groupBy(key).agg(collapse(F.array_join(F.transform(ordered, lambda x: x["s"]), "")).alias(text))


def split_paragraph(text: Column, words: int = 110, least: int = 4) -> Column:
    """Two halves when a paragraph has more than 110 words and four sentences; cut where half of the words are reached."""
    from gristmill.functions.text import let, sentences_safe

    def cut_at(sized):
        """Number of sentences in the first half: the running word count is a fold over the sentence sizes."""
        total = F.aggregate(sized, F.lit(0), lambda a, x: (a + x["w"]).cast("int"))
        def find(half):
            start = F.struct(F.lit(0).alias("acc"), F.lit(0).alias("i"), F.lit(0).alias("cut"))
            def step(a, x):
                acc, i = (a["acc"] + x["w"]).cast("int"), (a["i"] + 1).cast("int")
                return F.struct(acc.alias("acc"), i.alias("i"), F.when((a["cut"] == 0) & (acc >= half), i).otherwise(a["cut"]).cast("int").alias("cut"))
            return F.aggregate(sized, start, step, lambda a: F.least(F.greatest(a["cut"], F.lit(1)), F.size(sized) - 1))
        return let(total / 2, find)

    def halves(sized):
        ss = F.transform(sized, lambda x: x["s"])
        part = lambda a, n: jstrim(F.array_join(F.slice(ss, a, n), ""))
        return let(cut_at(sized), lambda c: F.array(part(F.lit(1), c), part(c + 1, F.size(sized))))

    sized = F.transform(sentences_safe(text), lambda s: F.struct(s.alias("s"), count_words(s).alias("w")))
    long_text = count_words(text) > words
    return F.when(long_text, let(sized, lambda z: F.when(F.size(z) >= least, halves(z)).otherwise(F.array(text)))).otherwise(F.array(text))


def readability_stats(df: DataFrame, key: str, paragraphs: str, long: int = 20) -> DataFrame:
    """Per text: sentences, long unquoted sentences, their share, longest paragraph in words."""
    p = df.select(key, F.explode(paragraphs).alias("p"))
    s = F.filter(sentences("p"), lambda x: jstrim(x) != "")
    per = p.select(key, F.size(s).alias("n"), F.size(F.filter(s, lambda x: (count_words(x) > long) & ~x.rlike("[\"“”]"))).alias("l"), count_words("p").alias("w"))
    g = per.groupBy(key).agg(F.sum("n").alias("sentences"), F.sum("l").alias("long_sentences"), F.max("w").alias("max_paragraph_words"))
    return g.withColumn("long_percent", F.when(F.col("sentences") > 0, F.floor(F.col("long_sentences") * 100 / F.col("sentences") + 0.5)).otherwise(0).cast("bigint"))


def keyphrase_best(texts: DataFrame, key: str, text: str, phrases: list[str]) -> DataFrame:
    """Candidate phrase with most occurrences per text (the first candidate on a tie)."""
    low = F.lower(text)
    n = lambda p: ((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("bigint")
    best = F.array_max(F.array(*[F.struct(n(p).alias("n"), F.lit(-i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(phrases)]))
    return texts.select(key, best["p"].alias("phrase"), best["n"].alias("n"))


def watch_bad_count(frames: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Watch items holding numbers that no source of the digest contains: ``corpus(key, corpus)``; 0 without any source."""
    j = frames.select(key, "watch").join(corpus, key, "left")
    bad = F.size(F.filter("watch", lambda w: F.size(C.unsupported_numbers(w, F.col("corpus"))) > 0))
    return j.select(key, F.when(F.col("corpus").isNull(), 0).otherwise(bad).cast("bigint").alias("bad_items"))


def lead_figure(df: DataFrame) -> DataFrame:
    """(key columns, raw, label): first stat chart, else largest bar point, else first money or percent number of the summary.

    ``df(digest_id, summary, charts array<struct<type,title,points>>)``.
    """
    stat = F.get(F.filter("charts", lambda c: c["type"] == "stat"), F.lit(0))
    bar = F.get(F.filter("charts", lambda c: c["type"] == "bar"), F.lit(0))
    top = F.array_max(F.transform(bar["points"], lambda p: F.struct(p["value"].alias("v"), p["raw"].alias("raw"), p["label"].alias("label"))))
    num = F.regexp_extract("summary", r"(?i)([$€£]\s?\d[\d,.]*(?:\s?(?:billion|million|trillion))?|\d[\d,.]*\s?(?:%|percent|billion|million|trillion))", 1)
    sent = F.get(F.filter(F.split("summary", r"[.!?]\s+", -1), lambda s: F.contains(s, num)), F.lit(0))
    raw = F.when(stat.isNotNull(), F.get(stat["points"], F.lit(0))["raw"]).when(bar.isNotNull(), top["raw"]).when(num != "", jstrim(num))
    label = F.when(stat.isNotNull(), stat["title"]).when(bar.isNotNull(), F.concat(top["label"], F.lit(": "), bar["title"])).when(num != "", F.coalesce(sent, F.lit("")))
    return df.select("digest_id", raw.alias("raw"), label.alias("label"))


def seo_fallback(df: DataFrame) -> DataFrame:
    """Search texts from ``df(digest_id, headline, summary, headings array)``: title, meta, slug, excerpt, focus, secondary."""
    from gristmill.functions.text import raw_tokens, slug_max
    head = F.coalesce(F.nullif("headline", F.lit("")), F.lit("Daily bulletin"))
    base = F.coalesce(F.nullif("summary", F.lit("")), head)
    focus = F.array_join(F.slice(raw_tokens(F.substring_index(head, ":", 1)), 1, 3), " ")
    heading = lambda h: shorten(F.array_join(F.slice(F.filter(raw_tokens(h), lambda w: F.length(w) > 3), 1, 3), " "), 40)
    second = F.slice(F.filter(F.transform("headings", heading), lambda t: (t != "") & (t != focus)), 1, 4)
    words = raw_tokens(F.substring_index(head, ":", 1))
    planned = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), F.lit(3)), " ")
    return df.select("digest_id", shorten(head, 60).alias("title"), shorten(base, 155).alias("meta"), slug_max(head, 60).alias("slug"), shorten(base, 200).alias("excerpt"),
                     focus.alias("focus"), F.array_join(second, "|").alias("secondary"), planned.alias("planned_phrase"))


def seo_checks(df: DataFrame) -> DataFrame:
    """Tidy (digest_id, check_name, ok) from ``df(digest_id, focus, title, meta, slug, headline, intro, body, secondary array)``."""
    from gristmill.functions.text import slug_max
    kw = F.lower(jstrim("focus"))
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), kw)
    parts = F.transform(F.split(kw, r"\s+", -1), lambda w: slug_max(w, 30))
    body = F.lower("body")
    n = (F.length(body) - F.length(F.replace(body, kw, F.lit("")))) / F.length(kw)
    words = F.greatest(F.lit(1), count_words("body"))
    hits = F.size(F.filter("secondary", lambda s: F.contains(body, F.lower(s))))
    row = lambda name, ok: F.struct(F.lit(name).alias("check_name"), ok.alias("ok"))
    rows = F.array(
        row("title", has("title")), row("meta", has("meta")), row("slug", F.forall(parts, lambda w: F.contains("slug", w))), row("headline", has("headline")),
        row("intro", has("intro")), row("density", (n >= 1) & (n <= F.greatest(F.lit(4), F.floor(words / 120 + 0.5)))),
        row("secondary", hits >= F.ceil(F.size("secondary") / 2)))
    return df.filter(kw != "").select("digest_id", F.inline(rows))
