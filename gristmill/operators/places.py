"""Places named in texts: weighted gazetteer matches and the ranking shown with an article."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.claims import ascii_bounds
from gristmill.functions.text import let

# Place and its name pattern.
GAZETTEER = [
    ("Israel", r"israel|israeli|knesset|jerusalem|tel aviv|netanyahu"), ("Gaza", r"gaza|hamas"), ("Iran", r"iran|iranian|tehran"),
    ("Iraq", r"iraq|iraqi|baghdad"), ("Syria", r"syria|syrian|damascus"), ("Lebanon", r"lebanon|lebanese|hezbollah|beirut"),
    ("Yemen", r"yemen|houthi"), ("Saudi Arabia", r"saudi"), ("Qatar", r"qatar|doha"), ("UAE", r"emirates|\buae\b|dubai|abu dhabi"),
    ("Turkey", r"turkey|turkish|ankara|erdogan"), ("Egypt", r"egypt|egyptian|cairo"), ("Sudan", r"sudan|khartoum"),
    ("Libya", r"libya|libyan|tripoli"), ("Tunisia", r"tunisia|tunisian|tunis"), ("Algeria", r"algeria|algerian"),
    ("Morocco", r"morocco|moroccan|rabat"), ("Nigeria", r"nigeria|nigerian|lagos|abuja"), ("Ethiopia", r"ethiopia|addis"),
    ("Kenya", r"kenya|nairobi"), ("Congo", r"congo|kinshasa"), ("South Africa", r"south africa|pretoria|johannesburg"),
    ("Russia", r"russia|russian|moscow|kremlin|putin"), ("Ukraine", r"ukraine|ukrainian|kyiv|kiev|zelensky"), ("Belarus", r"belarus"),
    ("Poland", r"poland|polish|warsaw"), ("Germany", r"germany|german|berlin"), ("France", r"france|french|paris|macron"),
    ("United Kingdom", r"britain|british|\buk\b|united kingdom|england|london|scotland"), ("Spain", r"spain|spanish|madrid"),
    ("Italy", r"italy|italian|rome|meloni"), ("Netherlands", r"netherlands|dutch|amsterdam"), ("Sweden", r"sweden|swedish|stockholm"),
    ("Norway", r"norway|norwegian|oslo"), ("Finland", r"finland|finnish|helsinki"), ("Greece", r"greece|greek|athens"),
    ("Hungary", r"hungary|hungarian|budapest|orban"), ("Serbia", r"serbia|serbian|belgrade"), ("Brussels", r"european union|\beu\b|brussels"),
    ("Alaska", r"alaska|anchorage|juneau"),
    ("United States", r"united states|\bu\.s\.|american|washington|congress|white house|pentagon|trump|biden"),
    ("Canada", r"canada|canadian|ottawa"), ("Mexico", r"mexico|mexican"), ("Cuba", r"cuba|cuban|havana"),
    ("Venezuela", r"venezuela|venezuelan|caracas|maduro"), ("Colombia", r"colombia|colombian|bogota"), ("Brazil", r"brazil|brazilian|brasilia|lula"),
    ("Argentina", r"argentina|argentine|buenos aires|milei"), ("China", r"china|chinese|beijing|xi jinping"), ("Taiwan", r"taiwan|taiwanese|taipei"),
    ("Japan", r"japan|japanese|tokyo"), ("South Korea", r"south korea|seoul"), ("North Korea", r"north korea|pyongyang"),
    ("India", r"india|indian|delhi|modi"), ("Pakistan", r"pakistan|pakistani|islamabad"), ("Afghanistan", r"afghanistan|taliban|kabul"),
    ("Bangladesh", r"bangladesh|dhaka"), ("Myanmar", r"myanmar|burma"), ("Vietnam", r"vietnam|hanoi"), ("Thailand", r"thailand|bangkok"),
    ("Indonesia", r"indonesia|jakarta"), ("Philippines", r"philippines|manila"), ("Australia", r"australia|australian|canberra|sydney"),
    ("Washington", r"federal reserve|\bfed\b|white house|treasury|congress|senate|pentagon"),
    ("New York", r"new york|wall street|nasdaq|nyse|s&p|dollar|treasuries"),
    ("Frankfurt", r"frankfurt|\becb\b|european central bank|lagarde|bundesbank"),
    ("London", r"city of london|bank of england|\bboe\b|sterling|gilts|ftse"), ("Geneva", r"geneva|davos|swiss|switzerland|\bwto\b|\bimf\b"),
    ("Vienna", r"opec|vienna"), ("Strait of Hormuz", r"hormuz|persian gulf"), ("Red Sea", r"red sea|suez|bab el-mandeb|shipping lanes"),
    ("Black Sea", r"black sea|odesa|odessa|crimea"), ("Panama Canal", r"panama"), ("Singapore", r"singapore"), ("Hong Kong", r"hong kong"),
    ("South China Sea", r"south china sea|spratly|scarborough"), ("Silicon Valley", r"silicon valley|nvidia|openai|california|semiconductor"),
    ("Texas", r"texas|permian"), ("Kazakhstan", r"kazakhstan|astana"), ("Arctic", r"arctic|greenland"),
]
# Outlet names that hold a place name, and hubs that stand for their country.
OUTLET_NAMES_RE = "france 24|al jazeera|bbc news|dw news|sky news"
HUBS = ["Washington", "New York", "Silicon Valley", "Texas"]


HITS = "array<struct<place:string,ord:int,score:double>>"


def masked(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ascii_bounds(r"[’']s\b"), "")
    return F.concat(F.lit(" "), F.regexp_replace(t, OUTLET_NAMES_RE, " "), F.lit(" "))


def first_words(pattern: str) -> list[str]:
    """The letter run each alternative of a name pattern begins with."""
    return sorted({re.match("[a-z]+", alt.replace(r"\b", "")).group(0) for alt in pattern.split("|")})


def place_hits(text: Column, weight: float, gazetteer=None) -> Column:
    """Array of (place, ord, score): at most four matches per place and text, times the weight of the text.

    A text is split into letter runs once; a place's pattern runs only when one of its first words is among them.
    """
    table = gazetteer or GAZETTEER
    leads = F.array(*[F.lit(w) for w in sorted({w for _, p in table for w in first_words(p)})])

    def scan(low, present):
        rows = []
        for i, (name, pattern) in enumerate(table):
            seen = F.arrays_overlap(present, F.array(*[F.lit(w) for w in first_words(pattern)]))
            n = F.regexp_count(low, F.lit(f"(?:^|[^a-z])(?:{ascii_bounds(pattern)})(?:[^a-z]|$)"))
            score = F.when(seen, F.least(n, F.lit(4)) * weight).otherwise(0).cast("double")
            rows.append(F.struct(F.lit(name).alias("place"), F.lit(i).alias("ord"), score.alias("score")))
        return F.filter(F.array(*rows), lambda r: r["score"] > 0)

    def run(low):
        return let(F.array_intersect(leads, F.split(low, "[^a-z]+", -1)), lambda present: F.when(F.size(present) > 0, scan(low, present)).otherwise(F.array().cast(HITS)))

    return let(masked(text), run)


def gazetteer_match(df: DataFrame, key: list[str], text: str, weight: float = 1.0) -> DataFrame:
    """(key..., place, score)."""
    hits = df.select(*key, F.inline(place_hits(F.col(text), weight)))
    return hits.groupBy(*key, "place").agg(F.sum("score").alias("score"))


def place_ranking(df: DataFrame, top: int = 6) -> DataFrame:
    """Places of an article: (digest_id, rank, place).

    ``df(digest_id, headline, summary, sections array<struct<heading, body>>)``. Three places named in headline, headings or
    summary come first, then one per section, then the rest; a country gives way to its own hub. Texts become rows, so each
    is scanned once; the lists that are ranked per article hold at most the gazetteer.
    """
    part = lambda no, w, strong, sec, t: F.struct(F.lit(no).alias("no"), F.lit(w).alias("w"), F.lit(strong).alias("strong"), sec.cast("int").alias("sec"), t.alias("t"))
    whole = F.array(
        part(0, 6, True, F.lit(-1), F.col("headline")), part(1, 4, True, F.lit(-1), F.array_join(F.transform("sections", lambda s: s["heading"]), " . ")),
        part(2, 2, True, F.lit(-1), F.col("summary")), part(3, 1, False, F.lit(-1), F.array_join(F.transform("sections", lambda s: s["body"]), " ")))
    per = F.flatten(F.transform("sections", lambda s, i: F.array(part(0, 3, False, i, s["heading"]), part(1, 1, False, i, s["body"]))))
    texts = df.select("digest_id", F.inline(F.concat(whole, per)))
    hits = texts.select("digest_id", "no", "w", "strong", "sec", F.inline(place_hits(F.col("t"), 1.0)))
    g = hits.groupBy("digest_id", "sec", "place").agg(
        F.sum(F.col("score") * F.col("w")).alias("score"), F.min(F.col("no") * 1000 + F.col("ord")).alias("o"), F.bool_or("strong").alias("strong"))
    rank = F.struct((-F.col("score")).alias("s"), "o", "place", "strong")
    lists = g.groupBy("digest_id", "sec").agg(F.array_sort(F.collect_list(rank)).alias("l"))
    x = lists.groupBy("digest_id").agg(
        F.max_by("l", F.when(F.col("sec") == -1, 1)).alias("auto"), F.array_sort(F.collect_list(F.when(F.col("sec") >= 0, F.struct("sec", "l")))).alias("per"))
    names = lambda l: F.transform(l, lambda h: h["place"])
    x = x.select("digest_id", names(F.col("auto")).alias("auto"), F.slice(names(F.filter("auto", lambda h: h["strong"])), 1, 3).alias("first"),
                 F.transform("per", lambda p: names(p["l"])).alias("per"))
    def add(acc, found):
        return F.when(F.size(acc) < top, F.concat(acc, F.slice(F.array_except(found, acc), 1, 1))).otherwise(acc)
    x = x.withColumn("mid", F.aggregate("per", F.col("first"), add))
    x = x.withColumn("all", F.slice(F.concat("mid", F.array_except("auto", "mid")), 1, top))
    hub = F.arrays_overlap("all", F.array(*[F.lit(h) for h in HUBS]))
    final = F.when(hub, F.array_remove("all", "United States")).otherwise(F.col("all"))
    return x.select("digest_id", F.posexplode(final).alias("rank", "place"))
