"""SQL text fragments for the comparison queries (written for an engine with RE2 regular expressions)."""

from __future__ import annotations

from gristmill.functions.text import SPACE_CLASS, STOPWORDS
from gristmill.functions.urls import TRACKING_PARAMS

WS = SPACE_CLASS
STOP_LIST = ", ".join(f"'{w}'" for w in sorted(set(STOPWORDS)))


def blank(x: str) -> str:
    return f"(NOT coalesce(regexp_matches({x}, '[^{WS}]'), false))"


def filled(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '[^{WS}]'), false)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def slug(x: str) -> str:
    s = f"strip_accents(coalesce({x}, ''))"
    s = f"translate(replace(replace({s}, 'ß', 'ss'), 'æ', 'ae'), 'øđł', 'odl')"
    return f"trim(regexp_replace(lower({s}), '[^a-z0-9]+', '-', 'g'), '-')"


def tokens(x: str) -> str:
    """All tokens, repeats kept."""
    return (
        f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9-]+', ' ', 'g'), ' '), "
        f"lambda w: length(w) > 2 AND w NOT IN ({STOP_LIST}))"
    )


def clean_title(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[{WS}][-–|][{WS}][^-–|]{{2,40}}$', '')"


def title_key(x: str, n: int = 60) -> str:
    return f"substring(trim(regexp_replace(lower({clean_title(x)}), '[^a-z0-9]+', ' ', 'g')), 1, {n})"


def clean_url(x: str) -> str:
    drop = ", ".join(f"'{p}'" for p in TRACKING_PARAMS)
    base = f"split_part({x}, '#', 1)"
    path = f"split_part({base}, '?', 1)"
    kept = (
        f"list_filter(string_split(substring({base}, length({path}) + 2), '&'), "
        f"lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ({drop}))"
    )
    return (
        f"CASE WHEN regexp_matches({x}, '(?i)^[a-z][a-z0-9+.-]*:') THEN {path} || CASE WHEN len({kept}) > 0 THEN '?' || "
        f"array_to_string({kept}, '&') ELSE '' END || substring({x}, length({base}) + 1) ELSE {x} END"
    )


def host(x: str) -> str:
    """Host of an http(s) address in lower case without www."""
    h = f"regexp_extract({x}, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"
    return f"regexp_replace(lower(coalesce({h}, '')), '^www\\.', '')"


def root_host(x: str) -> str:
    return f"array_to_string(list_slice(string_split({x}, '.'), -2, -1), '.')"


def words(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '[^{WS}]+'))"


def shorten(x: str, n: int) -> str:
    c = collapse(f"coalesce({x}, '')")
    return f"CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n - 1}) || '…' ELSE {c} END"


def strip_currency(x: str) -> str:
    from gristmill.functions.prices import CURRENCY_CLASS
    first = f"regexp_replace({x}, '{CURRENCY_CLASS}', '')"
    return f"regexp_replace({first}, '[{WS}]+', '', 'g')"


def price_text(x: str) -> str:
    s = strip_currency(trim(f"coalesce({x}, '')"))
    return (
        f"CASE WHEN regexp_matches({s}, '^\\d{{1,3}}(\\.\\d{{3}})+,\\d{{1,2}}$') THEN replace(replace({s}, '.', ''), ',', '.') "
        f"WHEN regexp_matches({s}, '^\\d+,\\d{{1,2}}$') THEN replace({s}, ',', '.') "
        f"WHEN regexp_matches({s}, '^\\d+,\\d{{3}}$') THEN replace({s}, ',', '') ELSE {s} END"
    )


def number(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST({t} AS DOUBLE) END"


def price_value(x: str) -> str:
    t = price_text(x)
    return f"CASE WHEN {blank(x)} THEN NULL WHEN ({t}) = '' THEN 0.0 ELSE {number(f'({t})')} END"


def comma_decimal(x: str) -> str:
    s = strip_currency(trim(f"coalesce({x}, '')"))
    return f"regexp_matches({s}, '^(\\d{{1,3}}(\\.\\d{{3}})+,\\d{{1,2}}|\\d+,\\d{{1,2}})$')"
