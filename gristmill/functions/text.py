"""Text column functions: blanks, trimming, slugs, tokens, titles, shortening.

All of them stay inside the JVM (no Python UDF), so they fuse into whole-stage code generation.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space that a browser's trim() removes, as one regex class body.
SPACE_CLASS = (
    r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)

# Words that never count as title tokens.
STOPWORDS = (
    "a an the and or but if then than so of to in on for with without at by from into over under again "
    "further once here there when where why how all any both each few more most other some such no nor "
    "not only own same too very can will just don should now i you he she it we they them their our your "
    "his her its as is are was were be been being have has had do does did doing "
    "video videos today new subscribe channel watch like share follow http https www com youtube instagram "
    "twitter facebook link links join check out full part live "
    "who what which whom whose about after before also would could their this that these those been being "
    "says said say year years time one two get got make made back amid news report reports according"
).split()

SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
NONSPACE_RE = rf"[^{SPACE_CLASS}]"
SPACES_RE = rf"[{SPACE_CLASS}]+"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it many times inside one expression.

    Inside array functions the optimizer does not share common parts: a list built from a whole text would be
    rebuilt for every element that looks at it.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def jstrim(c) -> Column:
    """Trim every kind of Unicode space, not only U+0020. A native trim over a character set, no regex."""
    return F.btrim(col_of(c), F.lit(SPACE_CHARS))


def collapse(c) -> Column:
    """Runs of any white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col_of(c), SPACES_RE, " "))


def is_blank(c) -> Column:
    """Null, empty, or only white space."""
    return F.coalesce(~col_of(c).rlike(NONSPACE_RE), F.lit(True))


def not_blank(c) -> Column:
    return ~is_blank(c)


def or_text(c, fallback: str) -> Column:
    """Null or empty text becomes the fallback."""
    c = col_of(c)
    return F.when(c.isNull() | (c == ""), F.lit(fallback)).otherwise(c)


@functools.lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter plus combining marks."""
    src, dst = [], []
    for cp in range(0xC0, 0x2200):
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(x) <= 0x36F)
        if len(base) == 1 and base != ch and (base.isascii() or base in "æøđł"):
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(c) -> Column:
    src, dst = _accent_table()
    return F.regexp_replace(F.translate(col_of(c), src, dst), r"[\x{300}-\x{36F}]", "")


def slug(c) -> Column:
    """URL handle: accents off, five special letters spelled out, the rest to single hyphens."""
    out = strip_accents(F.coalesce(col_of(c), F.lit("")))
    out = F.replace(F.replace(out, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))
    out = F.translate(out, "øđł", "odl")
    out = F.regexp_replace(F.lower(out), "[^a-z0-9]+", "-")
    return F.regexp_replace(out, r"^-|-\z", "")


def slug_max(c, limit: int) -> Column:
    """Slug for web addresses: lower-cased first, cut at the last hyphen before the limit."""
    out = F.regexp_replace(strip_accents(F.lower(F.coalesce(col_of(c), F.lit("")))), "[^a-z0-9]+", "-")
    out = F.regexp_replace(out, r"^-+|-+\z", "")
    cut = F.substring(out, 1, limit)
    short = F.regexp_replace(cut, r"-[^-]*\z", "")
    out = F.when(F.length(out) > limit, F.when(short == "", cut).otherwise(short)).otherwise(out)
    return F.when(out == "", F.lit("section")).otherwise(out)


def raw_tokens(c) -> Column:
    """All tokens longer than two characters that are not stop words, in text order, repeats kept."""
    stop = F.array(*[F.lit(w) for w in sorted(set(STOPWORDS))])
    words = F.split(F.lower(F.coalesce(col_of(c), F.lit(""))), "[^a-z0-9-]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def token_set(c) -> Column:
    """Distinct tokens in order of first appearance."""
    stop = F.array(*[F.lit(w) for w in sorted(set(STOPWORDS))])
    words = F.split(F.lower(F.coalesce(col_of(c), F.lit(""))), "[^a-z0-9-]+")
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), stop)


def sig_tokens(c) -> Column:
    """Distinct tokens of four letters or more."""
    return F.filter(token_set(c), lambda w: F.length(w) >= 4)


CLEAN_TITLE_RE = rf"[{SPACE_CLASS}][-–|][{SPACE_CLASS}][^-–|]{{2,40}}\z"


def clean_title(c) -> Column:
    """Drop a trailing `` - Outlet`` of 2 to 40 characters."""
    return F.regexp_replace(F.coalesce(col_of(c), F.lit("")), CLEAN_TITLE_RE, "")


def title_key(c, limit: int = 60) -> Column:
    """Comparison key of a headline: cleaned, lower case, letters and digits only, cut."""
    flat = F.trim(F.regexp_replace(F.lower(clean_title(c)), "[^a-z0-9]+", " "))
    return F.substring(flat, 1, limit)


def shorten(c, limit: int) -> Column:
    """Collapse space and cut with an ellipsis when longer than ``limit``."""
    t = collapse(F.coalesce(col_of(c), F.lit("")))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def strip_tags(c) -> Column:
    return F.regexp_replace(F.coalesce(col_of(c), F.lit("")), "<[^>]+>", " ")


def count_words(c) -> Column:
    """White-space separated words; 0 for blank text. (Splitting is faster here than counting pattern matches.)"""
    t = jstrim(F.coalesce(col_of(c), F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACES_RE, -1)))


def estimate_tokens(c, words: Column | None = None) -> Column:
    """Mean of chars/4 and words/0.75, rounded, at least 1; 0 for empty text. ``words`` is the word count where it is known."""
    t = F.coalesce(col_of(c), F.lit(""))
    est = F.floor((F.length(t) / 4 + (count_words(t) if words is None else words) / 0.75) / 2 + 0.5)
    return F.when(t == "", F.lit(0)).otherwise(F.greatest(F.lit(1), est)).cast("bigint")


def estimate_tokens_chars(c, chars_per_token: float = 3.2) -> Column:
    """The character-only estimate used for request budgets."""
    return F.ceil(F.length(F.coalesce(col_of(c), F.lit(""))) / F.lit(chars_per_token)).cast("bigint")


def has_word(text_lower: Column, term: Column) -> Column:
    """Whole-word containment with ASCII letter/digit bounds; both sides already lower case.

    ``locate`` is tried first so that the regex runs only on rows that contain the term at all.
    """
    quoted = F.concat(F.lit(r"(?:^|[^a-z0-9])\Q"), term, F.lit(r"\E(?:[^a-z0-9]|\z)"))
    return F.contains(text_lower, term) & F.regexp_like(text_lower, quoted)


def has_word_unicode(text_lower: Column, term: Column) -> Column:
    """Whole-word containment with Unicode letter/number bounds."""
    quoted = F.concat(F.lit(r"(?:^|[^\p{L}\p{N}])\Q"), term, F.lit(r"\E(?:[^\p{L}\p{N}]|\z)"))
    return F.contains(text_lower, term) & F.regexp_like(text_lower, quoted)


SENTENCE_RE = r"[^.!?]+[.!?]+[\"”’')\]]*[\s]*|[^.!?]+\z"


def sentences(c) -> Column:
    """Split into sentences, trailing space kept, so that joining them gives the text back."""
    t = F.coalesce(col_of(c), F.lit(""))
    return let(t, lambda x: let(F.regexp_extract_all(x, F.lit(f"({SENTENCE_RE})"), F.lit(1)), lambda found: F.when(F.size(found) == 0, F.array(x)).otherwise(found)))


# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|St|No|Gen|Sen|Rep|Sgt|Col|Lt|Inc|Ltd|Co|Corp|vs|etc|e\\.g|i\\.e"


def sentences_safe(c) -> Column:
    """Sentence split that leaves decimals, initials and usual abbreviations whole."""
    mark = "\u0001"
    t = F.coalesce(col_of(c), F.lit(""))
    t = F.regexp_replace(t, r"(\d)\.(\d)", f"$1{mark}$2")
    t = F.regexp_replace(t, r"\b(U)\.(S|K|N)\.", f"$1{mark}$2{mark}")
    t = F.regexp_replace(t, rf"\b({ABBREVIATIONS})\.", f"$1{mark}")
    t = F.regexp_replace(t, r"\b([A-Z])\.\s(?=[A-Z])", f"$1{mark} ")
    return F.transform(sentences(t), lambda s: F.replace(s, F.lit(mark), F.lit(".")))


def plain_dashes(c) -> Column:
    """Em dashes and spaced en dashes become commas."""
    t = F.regexp_replace(col_of(c), r",\s?—\s?", ", ")
    t = F.regexp_replace(t, r"\s?—\s?", ", ")
    t = F.regexp_replace(t, r",\s–\s", ", ")
    return F.regexp_replace(t, r"\s–\s", ", ")


def norm_quote(c) -> Column:
    """Quote normal form: lower case, straight quotation marks, single spaces."""
    t = F.translate(F.lower(F.coalesce(col_of(c), F.lit(""))), "‘’“”", "''\"\"")
    return collapse(t)


def meta_fit(c, limit: int = 150, floor: int = 90) -> Column:
    """At most ``limit`` characters, cut after a sentence, else after a word with an ellipsis."""
    t = collapse(F.coalesce(col_of(c), F.lit("")))
    cut = F.substring(t, 1, limit)
    # position (0-based) of the last ". " / "; " / " " inside the cut text
    def last(sep):
        return F.when(F.contains(cut, F.lit(sep)), F.length(cut) - F.locate(sep[::-1], F.reverse(cut)) - len(sep) + 1).otherwise(-1)
    k = F.greatest(last(". "), last("; "))
    w = last(" ")
    by_word = F.when(w > floor, F.substring(cut, F.lit(1), w)).otherwise(cut)
    by_word = F.concat(F.regexp_replace(by_word, r"[,;:\s]+\z", ""), F.lit("…"))
    return (
        F.when(F.length(t) <= limit, t)
        .when(k > floor, F.substring(cut, F.lit(1), k + 1))
        .otherwise(by_word)
    )
