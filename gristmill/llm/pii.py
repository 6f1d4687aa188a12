"""Personal data by weak supervision, with DataFrame functions only.

*Base* spans are emails, IP addresses, cards and phones that pass their checks; they always stay. Every match of a base
pattern, passing or not, and of some looser patterns (spelled-out emails, phones without country code, social security
numbers) is a *candidate*. Five labelers vote on each candidate: the check of its pattern (regex; looser patterns have none), a gazetteer of
endings, calling codes and issuer digits, words before it that announce personal data or something else (two context
labelers), and its surroundings. Expectation-maximisation over the counts of vote patterns estimates how reliable the
labelers are. The resulting probabilities train the final span classifier, a naive Bayes model over features of the
span, which decides on the looser candidates; those that overlap no base span are added.

The model is fitted on all candidates. What is gathered for it is one row for each combination of votes and features,
of which there are at most a few thousand whatever the input. Each text is worked on inside its own row, in time linear
in its length (positions come from running sums in chunks), and nothing is shuffled but the counts.

Defined results: a null text is empty and has no spans; without candidates no model is fitted and nothing is added;
repeated rows give repeated results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "ssn"]
ROUNDS = 25
CHUNK = 128

# ---- patterns -------------------------------------------------------------------------------------------------
# A match may start where the last one ended or where no character of its first run precedes; both forms find the same
# matches as the plain patterns, but never try a run of characters again from its middle. The last field says whether a
# match that passes is a base span.
_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]++"
PATTERNS = [
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}(?:\.{_LABEL})++", True),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", True),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True),
    ("email", rf"(?<!{_LOCAL}){_LOCAL}++(?: ?[(\[]at[)\]] ?| at ){_LABEL}(?:(?: ?[(\[]dot[)\]] ?| dot ){_LABEL})++", False),
    ("phone", r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", False),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False),
]
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# words just before a candidate that announce it, or that announce something else
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)\b(?:ip|host|server|login|from|client|peer)\b\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|cell|dial|whatsapp)\b\W*(?:\w+\W+){0,2}$",
    "ssn": r"(?i)\b(?:ssn|social security)\b\W*(?:\w+\W+){0,2}$",
}
OTHER_CUE = r"(?i)\b(?:order|invoice|version|ver|no|isbn|issn|ref|ticket|part|page|figure|chapter|section|total|price|build|release|serial)\b\W*$"
# endings of hosts, calling codes and first digits of card issuers
GAZETTEER = {
    "email": r"(?i)[.)\] ](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at)$",
    "ip": r"^(?!0)[0-9]",
    "card": r"^(?:4|5[1-5]|34|37|6011|65|35)",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]*[0-9]|[(]?[2-9][0-9]{2})",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}


# ---- array helpers --------------------------------------------------------------------------------------------
def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for the row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running total before each element, for an associative ``step`` that starts at 0; linear in time."""
    zero = F.lit(0).cast("long")

    def totals(start: Column, xs: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, first, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / CHUNK)).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    return let(chunks, lambda cs: F.flatten(F.zip_with(cs, totals(zero, F.transform(cs, lambda xs: F.aggregate(xs, zero, step))), lambda xs, start: totals(start, xs))))


# ---- candidates -----------------------------------------------------------------------------------------------
def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Do the digits pass the Luhn check?"""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int") * (i % 2 + 1), lambda x: x - F.when(x > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _edge(char: Column) -> Column:
    return F.when(char == "", "none").when(char.rlike(r"^\s"), "space").when(char.rlike(r"^\p{L}"), "letter").when(char.rlike("^[0-9]"), "digit").otherwise("mark")


def _of_pattern(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Candidates of one pattern in a text, in order."""
    order = KINDS.index(kind)

    def found(m: Column, gaps: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: (F.length(g) + F.length(x)).cast("long"))
        at = scan(sizes, lambda a, x: a + x)
        rows = F.zip_with(at, F.transform(m, lambda x, i: F.struct(x.alias("m"), F.get(gaps, i).alias("g"), F.substring(F.get(gaps, i + 1), 1, 1).alias("next"))), lambda a, x: F.struct(
            (a + F.length(x["g"])).alias("s"), x["m"].alias("m"), F.substring(x["g"], -48, 48).alias("before"), x["next"].alias("next")))
        return F.transform(rows, candidate)

    def candidate(x: Column) -> Column:
        ok, cue, other = passes(kind, x["m"]), x["before"].rlike(CUES[kind]), x["before"].rlike(OTHER_CUE)
        left, right = _edge(F.substring(x["before"], -1, 1)), _edge(x["next"])
        yes_no = lambda c, yes, no: F.when(c, yes).otherwise(no)
        # votes: 0 abstains, 1 personal, 2 not personal
        votes = F.array(yes_no(ok, 1, 2) if base else F.lit(0), yes_no(x["m"].rlike(GAZETTEER[kind]), 1, 2), yes_no(cue, 1, 0), yes_no(other, 2, 0), yes_no(left.isin("letter", "digit") | right.isin("letter", "digit"), 2, 0))
        features = F.array(
            F.lit(f"kind={kind}{'' if base else ' loose'}"), F.concat(F.lit("length="), F.least(F.floor(F.length(x["m"]) / 4), F.lit(9)).cast("string")),
            F.concat(F.lit("left="), left), F.concat(F.lit("right="), right), F.concat(F.lit("cue="), cue.cast("string")), F.concat(F.lit("other="), other.cast("string")),
            F.concat(F.lit("check="), ok.cast("string") if base else F.lit("none")))
        return F.struct(
            x["s"].cast("long").alias("s"), F.lit(order).alias("ord"), (x["s"] + F.length(x["m"])).cast("long").alias("e"), F.lit(kind).alias("kind"),
            (ok & F.lit(base)).alias("base"), F.lit(not base).alias("loose"), votes.alias("votes"), features.alias("features"))

    none = F.array().cast("array<struct<s:bigint,ord:int,e:bigint,kind:string,base:boolean,loose:boolean,votes:array<int>,features:array<string>>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: found(m, gaps))))


def candidates(docs: DataFrame, out: str = "_candidates") -> DataFrame:
    """``docs`` with the candidates of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(out, F.concat(*[_of_pattern(text, *p) for p in PATTERNS]))


# ---- model ----------------------------------------------------------------------------------------------------
def _label(groups: Column) -> Column:
    """Expectation-maximisation: groups (votes, features, n) with the probability ``q`` of being personal data.

    The votes of a labeler are independent of the others given the truth; it starts from the majority.
    """
    labelers = 5

    def start(g: Column) -> Column:
        lead = F.aggregate(g["votes"], F.lit(0), lambda a, v: a + F.when(v == 1, 1).when(v == 2, -1).otherwise(0))
        q = F.when(lead > 0, 0.9).when(lead < 0, 0.1).otherwise(0.5)
        return F.struct(g["votes"].alias("votes"), g["features"].alias("features"), g["n"].alias("n"), q.alias("q"))

    def mass(gs: Column, weigh: Callable[[Column], Column]) -> Column:
        return F.aggregate(gs, F.lit(0.0), lambda a, g: a + weigh(g))

    def reliabilities(gs: Column) -> Column:
        """Log ratio of each vote of each labeler, and of the classes at the end."""
        both = F.struct(mass(gs, lambda g: g["n"] * g["q"]).alias("yes"), mass(gs, lambda g: g["n"] * (1 - g["q"])).alias("no"))

        def ratio(k: Column, t: Column) -> Column:
            here = lambda g: F.get(g["votes"], F.floor(k / 3).cast("int")) == k % 3
            yes = mass(gs, lambda g: F.when(here(g), g["n"] * g["q"]).otherwise(0.0))
            no = mass(gs, lambda g: F.when(here(g), g["n"] * (1 - g["q"])).otherwise(0.0))
            return F.log((yes + 1) / (t["yes"] + 3)) - F.log((no + 1) / (t["no"] + 3))

        return let(both, lambda t: F.concat(F.transform(F.sequence(F.lit(0), F.lit(labelers * 3 - 1)), lambda k: ratio(k, t)), F.array(F.log((t["yes"] + 1) / (t["no"] + 1)))))

    def again(gs: Column, _: Column) -> Column:
        def q(g: Column, r: Column) -> Column:
            votes = F.transform(g["votes"], lambda v, i: F.get(r, (i * 3 + v).cast("int")))
            logit = F.aggregate(votes, F.get(r, F.lit(labelers * 3)), lambda a, x: a + x)
            return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))

        return let(reliabilities(gs), lambda r: F.transform(gs, lambda g: F.struct(g["votes"].alias("votes"), g["features"].alias("features"), g["n"].alias("n"), q(g, r).alias("q"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.transform(groups, start), again)


def fit(found: DataFrame, column: str = "_candidates") -> dict[str, float]:
    """Weights of the span classifier by feature, from a table with candidates; ``""`` is the prior."""
    one = found.select(F.explode(column).alias("c")).groupBy(F.col("c.votes").alias("votes"), F.col("c.features").alias("features")).agg(F.count(F.lit(1)).alias("n"))
    # one row for each combination of votes and features: a bounded number
    all_groups = one.agg(F.array_sort(F.collect_list(F.struct("votes", "features", "n"))).alias("groups"))
    labelled = all_groups.select(F.explode(_label(F.col("groups"))).alias("g")).select("g.*")
    totals = [F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")]
    by_feature = labelled.withColumn("feature", F.explode("features")).groupBy("feature").agg(*totals)
    rows = by_feature.unionByName(labelled.agg(*totals).withColumn("feature", F.lit(""))).filter("yes IS NOT NULL").collect()
    prior = next(((r["yes"] + 1) / (r["no"] + 1) for r in rows if r["feature"] == ""), None)
    if prior is None:
        return {}
    return {r["feature"]: math.log((r["yes"] + 1) / (r["no"] + 1)) - (math.log(prior) if r["feature"] else 0.0) for r in rows}


def decide(found: DataFrame, weights: dict[str, float], column: str = "_candidates") -> DataFrame:
    """Replaces the candidates by ``base`` and ``spans``: arrays of (s, ord, e, kind), ordered by start and kind."""
    narrow = lambda c: F.struct(c["s"].alias("s"), c["ord"].alias("ord"), c["e"].alias("e"), c["kind"].alias("kind"))
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.create_map(F.lit(""), F.lit(-1.0))
    score = lambda c: F.aggregate(c["features"], F.lit(float(weights.get("", -1.0))), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    out = found.withColumn("base", F.array_sort(F.transform(F.filter(column, lambda c: c["base"]), narrow)))
    more = F.transform(F.filter(column, lambda c: c["loose"] & (score(c) >= 0)), narrow)
    out = out.withColumn("_more", F.filter(more, lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))))
    return out.withColumn("spans", F.array_sort(F.concat("base", "_more"))).drop("_more", column)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by the kind of its first span, such as ``[EMAIL]``."""
    ends = F.zip_with(spans, scan(F.transform(spans, lambda x: x["e"]), lambda a, x: F.greatest(a, x)), lambda x, past: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), past.alias("past")))
    new = lambda x: (x["s"] >= x["past"]) | (x["past"] == 0)
    parts = F.transform(F.filter(ends, new), lambda x: F.concat(
        F.substr(text, (x["past"] + 1).cast("int"), (x["s"] - x["past"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    last = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x["e"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(parts, ""), F.substr(text, (last + 1).cast("int"))))
