"""Line tests and whole-text cleaning as column expressions.

A document is cleaned inside its own row: lines are an array, so no line is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import SPACE_CHARS, col_of, let

LINE_WS = r" \t\x{0B}\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Standalone page numbers in English, Swedish and German, fractions, dashes, brackets.
PAGE_NUMBER_RE = (
    r"(?i)^(\d{1,4}|page\s+\d+(\s+of\s+\d+)?|sida\s+\d+(\s+av\s+\d+)?|seite\s+\d+(\s+von\s+\d+)?"
    r"|\d+\s*/\s*\d+|[-–—]\s*\d+\s*[-–—]|\[\s*\d+\s*\])$"
)
# List markers.
LIST_RE = r"(?i)^\s*(?:[-*•·–—]\s+|\d+[.)]\s+|[a-z][.)]\s+)"


def ltrim(c) -> Column:
    """Trim any white space of a single line."""
    return F.btrim(col_of(c), F.lit(SPACE_CHARS))


def strip_control(c) -> Column:
    """Control, soft-hyphen and zero-width characters out; no-break space and tab to space; runs collapsed."""
    t = F.regexp_replace(col_of(c), r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}\x{AD}\x{200B}-\x{200D}\x{FEFF}]", "")
    return F.regexp_replace(F.regexp_replace(t, r"[\x{A0}\t]", " "), " {2,}", " ")


def is_page_number(line) -> Column:
    return ltrim(line).rlike(PAGE_NUMBER_RE)


def is_list_line(line) -> Column:
    return col_of(line).rlike(LIST_RE)


def heading_shape(t: Column) -> Column:
    """Heading test of a trimmed line; the cheap length test comes first."""
    return (
        F.length(t).between(1, 65) & ~t.rlike(r"[.,;:!?]$") & ~is_list_line(t)
        & t.rlike("[A-Za-z]") & (F.regexp_count(t, F.lit(rf"[^\n{LINE_WS}]")) <= 50))


def is_heading_line(line) -> Column:
    """Short, has letters, no closing punctuation, not a list item."""
    return let(ltrim(line), heading_shape)


def fuzzy_shape(line) -> Column:
    """Line identity without its digits, case and spacing."""
    t = F.regexp_replace(ltrim(line), r"\d+", "#")
    return F.lower(F.regexp_replace(t, rf"[\n{LINE_WS}]+", " "))


def running_shape(t: Column) -> Column:
    letters, uppers = F.regexp_count(t, F.lit("[A-Za-z]")), F.regexp_count(t, F.lit("[A-Z]"))
    return (
        F.length(t).between(1, 80) & ~t.rlike(r"[.!?]\s*$") & (F.regexp_count(t, F.lit(",")) <= 3)
        & (t.rlike(r"\d") | ((letters > 0) & (uppers / F.greatest(letters, F.lit(1)) > 0.6)) | t.rlike(r"^[\W_]")))


def is_running_header(line) -> Column:
    """Looks like a page header: short, no sentence end, and digits, capitals or a leading symbol."""
    return let(ltrim(line), running_shape)


def rejoin_hyphens(c) -> Column:
    return F.regexp_replace(col_of(c), r"([a-z])-\s*\n\s*([a-z])", "$1$2")


def repeat_candidate(line) -> Column:
    return let(ltrim(line), lambda t: F.length(t).between(1, 80) & t.rlike("[a-zA-Z]"))


def repeated_shapes(lines: Column, times: int = 3) -> Column:
    """Shapes seen at least ``times`` in an array of lines: sort, then compare with the entry two further on."""
    shapes = F.array_sort(F.transform(F.filter(lines, repeat_candidate), fuzzy_shape))
    def hits(s):
        idx = F.sequence(F.lit(1), F.size(s) - (times - 1))
        same = F.transform(idx, lambda i: F.when(F.get(s, i - 1) == F.get(s, i + (times - 2)), F.get(s, i - 1)))
        return F.array_distinct(F.array_compact(same))
    # transform over a one-element array binds the sorted shapes once
    found = F.flatten(F.transform(F.array(shapes), lambda s: F.when(F.size(s) >= times, hits(s)).otherwise(F.array().cast("array<string>"))))
    return found


def drop_repeated(lines: Column) -> Column:
    """Remove header-like lines whose shape occurs three times or more in the same document."""
    def keep(found):
        return F.filter(lines, lambda x: ~(repeat_candidate(x) & F.array_contains(found, fuzzy_shape(x)) & is_running_header(x)))
    return F.flatten(F.transform(F.array(repeated_shapes(lines)), lambda found: F.when(F.size(found) > 0, keep(found)).otherwise(lines)))


def line_kind(line: Column, lists: bool = True, headings: bool = True) -> Column:
    """b(lank), o(wn line), p(art of a paragraph); the line is already trimmed."""
    own = F.lit(False)
    if lists:
        own = own | is_list_line(line)
    if headings:
        own = own | heading_shape(line)
    return F.when(line == "", "b").when(own, "o").otherwise("p")


def reflow(lines: Column, lists: bool = True, headings: bool = True) -> Column:
    """Wrapped lines become one paragraph line; lists and headings stay on their own. Returns the text."""
    marked = F.transform(F.transform(lines, ltrim), lambda t: F.struct(t.alias("t"), line_kind(t, lists, headings).alias("k")))
    def glue(m):
        def one(x, i):
            lead = F.when(i == 0, "").when((x["k"] == "p") & (F.get(m, i - 1)["k"] == "p"), " ").otherwise("\n")
            return F.concat(lead, x["t"])
        return F.array_join(F.transform(m, one), "")
    return F.get(F.transform(F.array(marked), glue), F.lit(0))


def tidy_ends(c) -> Column:
    """Blank-line runs to one, line ends trimmed, leading and trailing breaks removed."""
    t = F.regexp_replace(col_of(c), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, rf"[{LINE_WS}]+(?=\n|\z)", "")
    return F.regexp_replace(t, r"^\n+|\n+\z", "")


def strip_marker(line: Column) -> Column:
    return F.regexp_replace(line, LIST_RE, "")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
