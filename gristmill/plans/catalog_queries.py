"""Registered queries of the catalog family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import catalog_fields as K
from gristmill.functions.prices import price_parse
from gristmill.functions.text import slug
from gristmill.functions.urls import IMAGE_EXT_RE, PRIVATE_HOST_RE
from gristmill.operators import catalog_compare as CC
from gristmill.operators import catalog_mapping as CM
from gristmill.operators import catalog_repair as CR
from gristmill.operators import catalog_report as RP
from gristmill.operators import catalog_rows as R
from gristmill.operators import catalog_rules as CK
from gristmill.plans import sqltext as Q
from gristmill.plans.registry import ORACLES, query, register
from gristmill.session import scratch_path
from gristmill.sources import csv_files as CS
from gristmill.sources import tables as T
from gristmill.sources.ordered_files import read_ordered

SHORT = {
    "Handle": "h", "Title": "t", "Body (HTML)": "body", "Vendor": "vendor", "Product Category": "cat", "Type": "typ", "Tags": "tags",
    "Published": "pub", "Option1 Name": "o1n", "Option1 Value": "o1v", "Option2 Name": "o2n", "Option2 Value": "o2v",
    "Variant SKU": "sku", "Variant Inventory Tracker": "tracker", "Variant Inventory Qty": "qty", "Variant Price": "price",
    "Variant Compare At Price": "cmp", "Image Src": "img", "Status": "status", "Cost per item": "cost", "Legacy Code": "legacy",
}
_names = ", ".join(f'"{n}" AS {s}' for n, s in SHORT.items())
BASE = f"raw AS ({T.SQL_CATALOG}), base AS (SELECT file_id, row_no, {_names} FROM raw)"
_sell = f"({Q.filled('sku')} OR {Q.filled('price')} OR {Q.filled('o1v')})"
C = (
    f"WITH {BASE}, c AS (SELECT *, {Q.filled('h')} AS keyed, {_sell} AS sell, "
    f"({Q.filled('h')} AND NOT {_sell} AND {Q.filled('img')} AND {Q.blank('t')}) AS image, "
    f"CASE WHEN h IS NULL OR h = '' THEN '(no handle)' ELSE h END AS owner FROM base)"
)
LEADS = "leads AS (SELECT file_id, h, min(row_no) AS lead FROM c WHERE keyed AND (sell OR (" + Q.filled("t") + " AND NOT image)) GROUP BY 1, 2)"
KIND = (
    f"{C}, {LEADS}, k AS (SELECT c.*, c.keyed AND coalesce(c.row_no = leads.lead, false) AS is_primary FROM c LEFT JOIN leads USING (file_id, h)), "
    f"kinds AS (SELECT *, keyed AND NOT image AND (sell OR {Q.blank('t')} OR NOT is_primary) AS is_variant FROM k)"
)


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return T.catalog(spark, sf)


def import_safety(spark: SparkSession, sf: str) -> DataFrame:
    """Which catalog files are unsafe to import, by severity of their issues."""
    df = catalog(spark, sf)
    codes = ["PRICE_CURRENCY_SYMBOL", "TITLE_MISSING", "HANDLE_DUPLICATE_IN_FILE", "SKU_DUPLICATE_IN_FILE", "DUPLICATE_IDENTICAL_ROWS", "ROW_ORDER_WARNING"]
    return RP.severity_summary(CK.findings(df, codes=codes), df)


# ---- one query per rule -----------------------------------------------------------------------------------------
FIND = ["file_id", "row_no", "handle", "column_name", "value"]


def rule_query(code: str, mode: str = "existing_products"):
    # findings on a whole column or header have no row
    cols = ["file_id", "column_name", "value"] if code.startswith(("DESTRUCTIVE", "HEADER")) else FIND
    return lambda spark, sf: CK.findings(catalog(spark, sf), mode=mode, codes=[code]).select(*cols)


def rows_sql(*parts: tuple[str, str, str]) -> str:
    """(condition, column, value) per part."""
    sel = [f"SELECT file_id, row_no, owner AS handle, {col} AS column_name, {val} AS value FROM c WHERE {cond}" for cond, col, val in parts]
    return f"{C} " + " UNION ALL ".join(sel)


def _first(names: list[str], cond, value) -> tuple[str, str, str]:
    arms_c = " ".join(f"WHEN {cond(SHORT[n])} THEN '{n}'" for n in names)
    arms_v = " ".join(f"WHEN {cond(SHORT[n])} THEN {value(SHORT[n])}" for n in names)
    return f"CASE {arms_c} END IS NOT NULL", f"CASE {arms_c} END", f"CASE {arms_v} END"


_smart = lambda x: f"regexp_matches({x}, '{K.SMART_CHARS_RE}')"
_padded = lambda x: f"({Q.filled(x)} AND {x} <> {Q.trim(x)})"
_known_trim = [n for n in K.WHITESPACE_COLUMNS if n in SHORT]
_norm_bool = lambda x: f"lower({Q.trim(x)}) IN ('true','yes','y','1','on','false','no','n','0','off')"
_half = lambda n, v: f"({Q.blank(n)} <> {Q.blank(v)})"
_pair = lambda n, v: f"(CASE WHEN {n} IS NULL OR {n} = '' THEN '(blank)' ELSE {n} END || ' / ' || CASE WHEN {v} IS NULL OR {v} = '' THEN '(blank)' ELSE {v} END)"
_dirty = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {Q.filled(SHORT[n])} THEN '{n}' END" for n in K.IMAGE_ROW_EXTRA if n in SHORT) + "], lambda x: x IS NOT NULL), ', ')"
_num = Q.number(Q.trim("qty"))
_whole = f"coalesce(({_num}) = floor({_num}), false)"
_scheme = f"regexp_matches({Q.trim('img')}, '^[a-zA-Z][a-zA-Z0-9+.-]*:')"
_imghost = f"regexp_extract({Q.trim('img')}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)"
_imgpath = f"regexp_extract({Q.trim('img')}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1)"
_tag_name = "lower(regexp_extract(t[1], '^</?([a-zA-Z][a-zA-Z0-9]*)', 1))"
_open_tags = (
    "list_reduce(list_transform(regexp_extract_all(body, '</?[a-zA-Z][a-zA-Z0-9]*\\b[^>]*>'), lambda x: [x]), lambda s, t: "
    f"CASE WHEN t[1] LIKE '</%' THEN CASE WHEN len(s) > 0 AND s[-1] = {_tag_name} THEN s[1:len(s) - 1] ELSE s END "
    f"WHEN t[1] LIKE '%/>' THEN s ELSE s || [{_tag_name}] END, []::VARCHAR[])")

ROW_SQL = {
    "SMART_QUOTES_DETECTED": rows_sql(_first(list(SHORT), _smart, lambda x: f"substring({x}, 1, 60)")),
    "CELL_WHITESPACE": rows_sql(_first(_known_trim, _padded, lambda x: x)),
    "HANDLE_MISSING_NEW": rows_sql((f"{Q.blank('h')} AND {Q.filled('t')}", "'Handle'", "t")),
    "HANDLE_MISSING_UPDATE": rows_sql((Q.blank("h"), "'Handle'", "CASE WHEN t IS NULL OR t = '' THEN '(no title)' ELSE t END")),
    "HANDLE_FORMAT_INVALID": rows_sql((f"keyed AND NOT regexp_matches(h, '^[a-z0-9]+(-[a-z0-9]+)*$')", "'Handle'", "h")),
    "SKU_WHITESPACE": rows_sql((_padded("sku"), "'Variant SKU'", "sku")),
    "VARIANT_ORPHANED": rows_sql((f"({Q.filled('o1n')} OR {Q.filled('o1v')}) AND NOT keyed", "'Handle'", "o1v")),
    "VARIANT_PARTIAL_COLLAPSE": rows_sql((
        f"{_half('o1n', 'o1v')} OR {_half('o2n', 'o2v')}",
        f"CASE WHEN {_half('o1n', 'o1v')} THEN 'Option1' ELSE 'Option2' END",
        f"CASE WHEN {_half('o1n', 'o1v')} THEN {_pair('o1n', 'o1v')} ELSE {_pair('o2n', 'o2v')} END")),
    "IMAGE_ROW_VARIANT_DATA": rows_sql((f"image AND {_dirty} <> ''", _dirty, "img")),
    "INVENTORY_QTY_MISSING_WITH_TRACKER": rows_sql((f"NOT image AND {Q.filled('tracker')} AND {Q.blank('qty')}", "'Variant Inventory Qty'", "tracker")),
    "INVENTORY_TRACKER_MISSING": rows_sql((f"NOT image AND {Q.filled('qty')} AND {Q.blank('tracker')}", "'Variant Inventory Tracker'", "qty")),
    "BOOLEAN_FORMAT": rows_sql((f"NOT image AND {Q.filled('pub')} AND NOT {_norm_bool('pub')}", "'Published'", "pub")),
    "PRODUCT_CATEGORY_FORMAT": rows_sql((
        f"NOT image AND {Q.filled('cat')} AND NOT regexp_matches({Q.trim('cat')}, '(?i)^gid://shopify/|[>»›]|^[a-z]{{2}}(-[a-z0-9]+)+$')",
        "'Product Category'", "substring(cat, 1, 80)")),
    "PRICE_CURRENCY_SYMBOL": rows_sql(*[(f"NOT image AND regexp_matches({s}, '[$€£¥]')", f"'{n}'", s) for n, s in (("Variant Price", "price"), ("Variant Compare At Price", "cmp"))]),
    "PRICE_DECIMAL_COMMA": rows_sql(*[(f"NOT image AND {Q.filled(s)} AND {Q.comma_decimal(s)}", f"'{n}'", s) for n, s in (("Variant Price", "price"), ("Variant Compare At Price", "cmp"))]),
    "PRICE_NON_NUMERIC": rows_sql(*[(f"NOT image AND {Q.filled(s)} AND ({Q.price_value(s)}) IS NULL", f"'{n}'", s) for n, s in (("Variant Price", "price"), ("Variant Compare At Price", "cmp"))]),
    "PRICE_NEGATIVE": rows_sql(*[(f"NOT image AND {Q.filled(s)} AND ({Q.price_value(s)}) < 0", f"'{n}'", s) for n, s in (("Variant Price", "price"), ("Variant Compare At Price", "cmp"))]),
    "INVENTORY_NON_INTEGER": rows_sql((f"NOT image AND {Q.filled('qty')} AND NOT {_whole}", "'Variant Inventory Qty'", "qty")),
    "INVENTORY_NEGATIVE": rows_sql((f"NOT image AND {Q.filled('qty')} AND {_whole} AND ({_num}) < 0", "'Variant Inventory Qty'", "qty")),
    "HTML_DANGEROUS_ATTRIBUTE": rows_sql((
        "regexp_matches(body, '(?i)<(script|iframe|object|embed)\\b')", "'Body (HTML)'", "regexp_extract(body, '(?i)<(script|iframe|object|embed)\\b', 1)")),
    "IMAGE_URL_NOT_HTTPS": rows_sql((f"regexp_matches({Q.trim('img')}, '(?i)^http://')", "'Image Src'", Q.trim("img"))),
    "IMAGE_URL_MALFORMED": rows_sql((f"{Q.filled('img')} AND NOT {_scheme}", "'Image Src'", Q.trim("img"))),
    "IMAGE_URL_PRIVATE_CDN": rows_sql((f"{Q.filled('img')} AND {_scheme} AND regexp_matches({_imghost}, '{PRIVATE_HOST_RE}')", "'Image Src'", Q.trim("img"))),
    "IMAGE_URL_NO_EXTENSION": rows_sql((f"{Q.filled('img')} AND {_scheme} AND NOT regexp_matches({_imgpath}, '{IMAGE_EXT_RE}')", "'Image Src'", Q.trim("img"))),
    "STATUS_INVALID_VALUE": rows_sql((f"NOT image AND {Q.filled('status')} AND lower({Q.trim('status')}) NOT IN ('active', 'draft', 'archived')", "'Status'", "status")),
    "HTML_UNCLOSED_TAG": rows_sql((f"{Q.filled('body')} AND len({_open_tags}) > 0", "'Body (HTML)'", f"{_open_tags}[-1]")),
}
for _code, _sql in ROW_SQL.items():
    register(_code, rule_query(_code, "new_products" if _code == "HANDLE_MISSING_NEW" else "existing_products"), _sql)

_firsts = (
    f"{C}, firsts AS (SELECT file_id, h, arg_min(coalesce(t, ''), row_no) AS t1, arg_min(coalesce(price, ''), row_no) AS p1, arg_min(coalesce(cmp, ''), row_no) AS c1, "
    "min(row_no) AS row_no FROM c WHERE keyed GROUP BY 1, 2)"
)
_opt = lambda s: f"sum(CASE WHEN NOT image AND {Q.filled(s)} THEN 1 ELSE 0 END)"
_optcol = lambda n, s: f"CASE WHEN {s} > 0 AND {s} <> live THEN '{n} (' || {s} || '/' || live || ')' END"
_partial = "array_to_string(list_filter([" + ", ".join(_optcol(n, SHORT[n]) for n in ("Option1 Name", "Option1 Value", "Option2 Name", "Option2 Value")) + "], lambda x: x IS NOT NULL), ', ')"
GROUP_SQL = {
    "TITLE_MISSING": f"{_firsts} SELECT file_id, row_no, h AS handle, 'Title' AS column_name, h AS value FROM firsts WHERE {Q.blank('t1')}",
    "HANDLE_DUPLICATE_IN_FILE": f"{C} SELECT file_id, min(row_no) AS row_no, h AS handle, 'Handle' AS column_name, h AS value FROM c WHERE keyed "
                                "GROUP BY file_id, h HAVING count(*) > 1 AND count(DISTINCT CASE WHEN t <> '' THEN t END) > 1",
    "VARIANT_OPTION_NAME_INCONSISTENT": f"{C} SELECT file_id, min(row_no) AS row_no, h AS handle, 'Option1 Name' AS column_name, h AS value FROM c WHERE keyed "
                                        f"GROUP BY file_id, h HAVING count(DISTINCT CASE WHEN {Q.filled('o1n')} THEN o1n END) > 1",
    "VARIANT_COLUMN_INCONSISTENCY": f"{C}, g AS (SELECT file_id, h, min(row_no) AS row_no, sum(CASE WHEN NOT image THEN 1 ELSE 0 END)::BIGINT AS live, "
                                    + ", ".join(f"({_opt(s)})::BIGINT AS {s}" for s in ("o1n", "o1v", "o2n", "o2v"))
                                    + f" FROM c WHERE keyed GROUP BY 1, 2) SELECT file_id, row_no, h AS handle, 'Option1 Name' AS column_name, {_partial} AS value FROM g WHERE live >= 2 AND {_partial} <> ''",
    "SINGLE_VARIANT_MULTIPLE_IMAGES": f"{C}, g AS (SELECT file_id, h, sum(CASE WHEN sell THEN 1 ELSE 0 END) AS nsell, sum(CASE WHEN image THEN 1 ELSE 0 END)::BIGINT AS nimg, "
                                      "min(CASE WHEN sell THEN row_no END) AS parent FROM c WHERE keyed GROUP BY 1, 2) "
                                      "SELECT g.file_id, g.parent AS row_no, g.h AS handle, 'Option1 Name' AS column_name, CAST(nimg AS VARCHAR) AS value FROM g JOIN c ON c.file_id = g.file_id AND c.row_no = g.parent "
                                      f"WHERE nsell = 1 AND nimg > 0 AND {Q.blank('c.o1n')} AND {Q.blank('c.o1v')}",
    "COMPARE_AT_PRICE_LOWER_THAN_PRICE": f"{_firsts} SELECT file_id, row_no, h AS handle, 'Variant Compare At Price' AS column_name, c1 AS value FROM firsts "
                                         f"WHERE ({Q.price_value('p1')}) IS NOT NULL AND ({Q.price_value('c1')}) > 0 AND ({Q.price_value('c1')}) <= ({Q.price_value('p1')})",
    "VARIANT_DUPLICATE_OPTION_COMBINATION": f"{C} SELECT file_id, min(row_no) AS row_no, h AS handle, 'Option1 Name' AS column_name, "
                                            "regexp_replace(coalesce(o1v, '') || ' / ' || coalesce(o2v, '') || ' / ', '( / )+$', '') AS value FROM c "
                                            f"WHERE keyed AND ({Q.filled('o1v')} OR {Q.filled('o2v')}) GROUP BY file_id, h, coalesce(o1v, ''), coalesce(o2v, ''), 5 HAVING count(*) > 1",
    "SKU_DUPLICATE_IN_FILE": f"{C} SELECT file_id, min(row_no) AS row_no, min(owner) AS handle, 'Variant SKU' AS column_name, {Q.trim('sku')} AS value FROM c "
                             f"WHERE {Q.filled('sku')} GROUP BY file_id, {Q.trim('sku')} HAVING count(DISTINCT owner) > 1",
}
_all_trim = ", ".join(f"coalesce({Q.trim(s)}, '')" for s in SHORT.values())
IDENT = f"{C}, s AS (SELECT file_id, row_no, owner, CASE WHEN t IS NULL OR t = '' THEN '(no title)' ELSE t END AS title, concat_ws('\u0001', {_all_trim}) AS sig FROM c), " \
        "d AS (SELECT *, min(row_no) OVER (PARTITION BY file_id, sig) AS first_row FROM s WHERE replace(sig, '\u0001', '') <> '')"
DUPIMG = f"{C}, i AS (SELECT file_id, row_no, h AS handle, {Q.trim('img')} AS url FROM c WHERE keyed AND {Q.filled('img')} AND {Q.blank('sku')} AND {Q.blank('price')} AND {Q.blank('t')}), " \
         "d AS (SELECT *, min(row_no) OVER (PARTITION BY file_id, handle, url) AS first_row FROM i)"
SCATTER = f"{C}, o AS (SELECT file_id, row_no, h AS handle, lag(h) OVER (PARTITION BY file_id ORDER BY row_no) AS prev_handle, min(row_no) OVER (PARTITION BY file_id, h) AS first_row FROM c WHERE keyed), " \
          "d AS (SELECT * FROM o WHERE prev_handle <> handle AND row_no > first_row)"
GROUP_SQL["DUPLICATE_IDENTICAL_ROWS"] = f"{IDENT} SELECT file_id, row_no, owner AS handle, '(row)' AS column_name, title AS value FROM d WHERE row_no > first_row"
GROUP_SQL["DUPLICATE_IMAGE_ROWS"] = f"{DUPIMG} SELECT file_id, row_no, handle, 'Image Src' AS column_name, url AS value FROM d WHERE row_no > first_row"
GROUP_SQL["ROW_ORDER_WARNING"] = f"{SCATTER} SELECT file_id, row_no, handle, 'Handle' AS column_name, prev_handle AS value FROM d"
_sens = [n for n in K.SENSITIVE if n in SHORT]
_cond = lambda n: "is_primary" if n in K.PRODUCT_LEVEL else "(is_variant OR is_primary)"
BLANKS = KIND + ", b AS (" + " UNION ALL ".join(
    f"SELECT file_id, '{n}' AS column_name, count(*) AS considered, count(*) FILTER (WHERE {Q.blank(SHORT[n])}) AS blanks FROM kinds WHERE NOT image AND {_cond(n)} GROUP BY 1" for n in _sens) + ")"
GROUP_SQL["DESTRUCTIVE_BLANK_ALL_ROWS"] = f"{BLANKS} SELECT file_id, column_name, CAST(blanks AS VARCHAR) AS value FROM b WHERE blanks > 0 AND blanks = considered"
GROUP_SQL["DESTRUCTIVE_BLANK_INCLUDED_COLUMN"] = f"{BLANKS} SELECT file_id, column_name, CAST(blanks AS VARCHAR) AS value FROM b WHERE blanks > 0 AND blanks < considered"
GROUP_SQL["HEADER_UNKNOWN_COLUMN"] = f"{C} SELECT DISTINCT file_id, 'Legacy Code' AS column_name, '' AS value FROM c"
for _code, _sql in GROUP_SQL.items():
    register(_code, rule_query(_code), _sql)


@query("HEADER_REQUIRED_MISSING", f"{C} SELECT DISTINCT file_id, column_name FROM c, (VALUES ('Handle'), ('Title')) AS v(column_name)")
def header_required(spark, sf):
    bare = catalog(spark, sf).drop("Handle", "Title")
    return CK.header_rules(CK.header_table(bare), "new_products", ["HEADER_REQUIRED_MISSING"]).select("file_id", "column_name")


@query("HEADER_DUPLICATE", f"{C} SELECT file_id, 'status' AS column_name, CAST(count(DISTINCT file_id) + 1 AS VARCHAR) AS value FROM c GROUP BY file_id")
def header_duplicate(spark, sf):
    heads = CK.header_table(catalog(spark, sf))
    twice = heads.unionByName(heads.filter("header = 'Status'").select("file_id", (F.col("pos") + 100).alias("pos"), F.lit("STATUS").alias("header")))
    return CK.header_rules(twice, "existing_products", ["HEADER_DUPLICATE"]).select("file_id", "column_name", "value")


# ---- row kinds --------------------------------------------------------------------------------------------------
query("classify_rows", f"{KIND} SELECT file_id, row_no, image AS is_image, is_primary, is_variant FROM kinds")(
    lambda spark, sf: R.classify_rows(catalog(spark, sf)).select("file_id", "row_no", "is_image", "is_primary", "is_variant"))
query("image_parents", f"{C} SELECT file_id, h AS handle, coalesce(min(CASE WHEN sell THEN row_no END), min(row_no)) AS parent_row, "
      "count(*) FILTER (WHERE sell) AS variant_rows, count(*) FILTER (WHERE image) AS image_rows FROM c WHERE keyed GROUP BY 1, 2 HAVING count(*) FILTER (WHERE image) > 0")(
    lambda spark, sf: R.image_parents(catalog(spark, sf)))
query("dup_image_rows", f"{DUPIMG} SELECT file_id, handle, url, row_no, first_row FROM d WHERE row_no > first_row")(
    lambda spark, sf: R.dup_image_rows(catalog(spark, sf)))
query("dup_identical_rows", f"{IDENT} SELECT file_id, row_no, owner AS handle, title, first_row FROM d WHERE row_no > first_row")(
    lambda spark, sf: R.dup_identical_rows(catalog(spark, sf)))
query("scattered_handles", f"{SCATTER} SELECT file_id, handle, row_no, prev_handle, first_row FROM d")(
    lambda spark, sf: R.scattered_handles(catalog(spark, sf)))
query("drop_identical", f"{IDENT} SELECT c.file_id, c.row_no FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.file_id = c.file_id AND d.row_no = c.row_no AND d.row_no > d.first_row)")(
    lambda spark, sf: R.drop_identical(catalog(spark, sf)).select("file_id", "row_no"))

# ---- reports ----------------------------------------------------------------------------------------------------
REPORT_CODES = ["PRICE_CURRENCY_SYMBOL", "PRICE_NON_NUMERIC", "TITLE_MISSING", "HANDLE_DUPLICATE_IN_FILE", "SKU_DUPLICATE_IN_FILE", "ROW_ORDER_WARNING", "STATUS_INVALID_VALUE"]


def report_findings(spark, sf):
    return CK.findings(catalog(spark, sf), codes=REPORT_CODES)


def _found_sql() -> str:
    """The finding table of REPORT_CODES as CTE text."""
    parts = []
    for code in REPORT_CODES:
        sql = ROW_SQL.get(code) or GROUP_SQL[code]
        sev, fix, _ = K.RULES[code]
        scope = "value" if code in ("HANDLE_DUPLICATE_IN_FILE", "SKU_DUPLICATE_IN_FILE") else "''"
        parts.append(f"SELECT *, '{code}' AS code, {scope} AS scope, '{sev}' AS severity, '{fix}' AS auto_fix FROM ({sql})")
    return "found AS (" + " UNION ALL ".join(parts) + "), iss AS (SELECT file_id, code, scope, severity, auto_fix, count(*) AS hits FROM found GROUP BY ALL)"


FOUND = "WITH " + _found_sql()
_verdict = "CASE WHEN critical > 0 THEN 'NOT_READY' WHEN warning > 0 THEN 'READY_WITH_WARNINGS' ELSE 'READY_FOR_REVIEW' END"
SUMMARY = FOUND + ", sev AS (SELECT file_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM iss GROUP BY 1)"
query("severity_summary", f"{SUMMARY} SELECT *, {_verdict} AS status FROM sev")(
    lambda spark, sf: RP.severity_summary(report_findings(spark, sf), catalog(spark, sf)))
query("batch_summary", f"{SUMMARY}, g AS (SELECT file_id, sum(critical)::BIGINT AS critical, sum(warning)::BIGINT AS warning, sum(info)::BIGINT AS info, count(*) AS files FROM sev GROUP BY ROLLUP(file_id)) SELECT coalesce(file_id, '(all)') AS file_id, critical, warning, info, files, {_verdict} AS status FROM g")(
    lambda spark, sf: RP.batch_summary(RP.severity_summary(report_findings(spark, sf), catalog(spark, sf))).withColumn("file_id", F.coalesce("file_id", F.lit("(all)"))))
_named = [(c, K.RULES[c][2]) for c in K.RULES if K.RULES[c][2]]
query("passed_checks", FOUND + ", n(code, check_name) AS (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in _named) + "), "
      f"ids AS (SELECT DISTINCT file_id FROM found) SELECT ids.file_id, n.code, n.check_name FROM ids, n WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.file_id = ids.file_id AND f.code = n.code)")(
    lambda spark, sf: RP.passed_checks(report_findings(spark, sf), catalog(spark, sf)))
query("repair_plan", f"{FOUND} SELECT file_id, count(*) FILTER (WHERE auto_fix = 'auto') AS safe, count(*) FILTER (WHERE auto_fix = 'review') AS review, count(*) FILTER (WHERE auto_fix = 'never') AS never, count(*) AS total FROM iss GROUP BY 1")(
    lambda spark, sf: RP.repair_plan(report_findings(spark, sf)))


@query("repair_outcome", f"{FOUND} SELECT file_id, code, scope, auto_fix, CASE WHEN code = 'PRICE_CURRENCY_SYMBOL' THEN 'fixed' WHEN code = 'SKU_DUPLICATE_IN_FILE' THEN 'approved' ELSE 'open' END AS outcome, hits FROM iss")
def repair_outcome(spark, sf):
    df = catalog(spark, sf)
    log = CR.changes(CR.fix_duplicate_skus(CR.fix_currency(CR.start(df))))
    return RP.repair_outcome(report_findings(spark, sf), log.select("file_id", "code"))


_issue_columns = ["severity", "code", "scope", "first_rows"]


@query("write_issues", FOUND + ", r AS (SELECT *, row_number() OVER (PARTITION BY file_id, code, scope ORDER BY row_no) AS n FROM found) "
       "SELECT file_id, severity, code, coalesce(scope, '') AS scope, string_agg(CAST(row_no AS VARCHAR), ' ' ORDER BY row_no) AS first_rows FROM r WHERE n <= 20 GROUP BY ALL")
def write_issues(spark, sf):
    path = scratch_path(spark, "issues")
    CS.write_lines(RP.write_issues_table(report_findings(spark, sf)), path, F.col("file_id"), ["severity", "code", "scope"], _issue_columns)
    return CS.read_lines(spark, path, _issue_columns).select(F.col("file").alias("file_id"), *_issue_columns)


query("issue_row_context", FOUND + ", hits AS (SELECT DISTINCT file_id, code, scope, row_no FROM found WHERE row_no IS NOT NULL QUALIFY dense_rank() OVER (PARTITION BY file_id, code, scope ORDER BY row_no) <= 10), "
      "f AS (SELECT *, CASE WHEN row_no - (lag(row_no) OVER w + 2) > 1 OR lag(row_no) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM hits WINDOW w AS (PARTITION BY file_id, code, scope ORDER BY row_no)), "
      "s AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id, code, scope ORDER BY row_no) AS span FROM f), "
      "a AS (SELECT file_id, code, scope, span, greatest(2, min(row_no) - 2) AS lo, max(row_no) + 2 AS hi FROM s WHERE span <= 3 GROUP BY ALL), "
      + BASE + " SELECT b.file_id, a.code, a.scope, CAST(a.span AS BIGINT) AS span, b.row_no, EXISTS (SELECT 1 FROM hits WHERE hits.file_id = a.file_id AND hits.code = a.code AND hits.scope = a.scope AND hits.row_no = b.row_no) AS is_target "
      "FROM a JOIN base b ON a.file_id = b.file_id AND b.row_no BETWEEN a.lo AND least(a.hi, a.lo + 14)")(
    lambda spark, sf: RP.issue_row_context(report_findings(spark, sf), catalog(spark, sf)).drop("Handle", "Title"))
_blank_sum = " + ".join(f"CASE WHEN {Q.blank(SHORT[n])} THEN 1 ELSE 0 END" for n in _sens)
query("catalog_impact", f"{C}, g AS (SELECT file_id, h, count(DISTINCT CASE WHEN {Q.filled('price')} THEN price END) AS p, count(DISTINCT CASE WHEN {Q.filled('qty')} THEN qty END) AS q FROM c WHERE keyed GROUP BY 1, 2), "
      f"b AS (SELECT file_id, CAST(sum({_blank_sum}) AS BIGINT) AS blank_included_values FROM c GROUP BY 1) "
      "SELECT file_id, count(*) AS matching_handles, count(*) FILTER (WHERE p > 1) AS changed_prices, count(*) FILTER (WHERE q > 1) AS changed_inventory, blank_included_values FROM g JOIN b USING (file_id) GROUP BY file_id, blank_included_values")(
    lambda spark, sf: RP.catalog_impact(catalog(spark, sf)))
_impact = ["matching_handles", "changed_prices", "changed_inventory", "blank_included_values"]


@query("write_result_json", FOUND + f", ids AS (SELECT file_id, count(*) AS rows_scanned FROM ({T.SQL_CATALOG}) GROUP BY 1), sv AS (SELECT file_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM iss GROUP BY 1), "
       "sev AS (SELECT ids.file_id, rows_scanned, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info FROM ids LEFT JOIN sv USING (file_id)), "
       "n(code, check_name) AS (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in _named) + "), "
       "ok AS (SELECT file_id, count(*) AS passed, string_agg(check_name, '; ' ORDER BY check_name) AS checks FROM ids, n WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.file_id = ids.file_id AND f.code = n.code) GROUP BY 1), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY file_id, code, scope ORDER BY row_no) AS n FROM found), li AS (SELECT file_id, code, scope, severity, string_agg(CAST(row_no AS VARCHAR), ' ' ORDER BY row_no) AS first_rows FROM r WHERE n <= 10 GROUP BY ALL), "
       "listed AS (SELECT file_id, string_agg(concat_ws(':', code, scope, severity, first_rows), '; ' ORDER BY code, scope) AS issues FROM li GROUP BY 1), "
       f"impact AS ({ORACLES['catalog_impact']}) SELECT file_id, {_verdict} AS status, 'existing_products' AS mode, critical, warning AS warnings, info, coalesce(passed, 0) AS passed, rows_scanned, {len(T.CATALOG)} AS columns_detected, "
       "coalesce(issues, '') AS issues, coalesce(checks, '') AS checks, " + ", ".join(_impact) + " FROM sev LEFT JOIN ok USING (file_id) LEFT JOIN listed USING (file_id) LEFT JOIN impact USING (file_id)")
def write_result_json(spark, sf):
    """One JSON document a file, written and read back."""
    path = scratch_path(spark, "results")
    RP.write_results(RP.result_json(report_findings(spark, sf), catalog(spark, sf), "existing_products"), path)
    counts = "critical bigint, warnings bigint, info bigint, passed bigint, rows_scanned bigint, columns_detected bigint"
    schema = (f"status string, mode string, summary struct<{counts.replace(' ', ': ').replace(',:', ',')}>, issues array<struct<code: string, scope: string, severity: string, first_rows: string>>, "
              f"passed_checks array<string>, potential_impact struct<{', '.join(c + ': bigint' for c in _impact)}>")
    back = read_ordered(spark, path).select(F.col("file").alias("file_id"), F.from_json("piece", schema).alias("r")).select("file_id", "r.*")
    issues = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["scope"], i["severity"], i["first_rows"])), "; ")
    return back.select("file_id", "status", "mode", "summary.*", F.coalesce(issues, F.lit("")).alias("issues"), F.coalesce(F.array_join("passed_checks", "; "), F.lit("")).alias("checks"), "potential_impact.*")



# ---- mapping ----------------------------------------------------------------------------------------------------
FOREIGN = {"Handle": "URL Handle", "Title": "product name", "Vendor": "Brand", "Variant Price": "Retail Price", "Cost per item": "Cost", "Type": "Product type"}


def foreign(spark, sf):
    return catalog(spark, sf).withColumnsRenamed(FOREIGN)


_foreign_heads = ", ".join(f"({i}, '{FOREIGN.get(n, n)}')" for i, n in enumerate(T.CATALOG))
HEADS = f"WITH {BASE}, ids AS (SELECT DISTINCT file_id FROM base), hd(pos, header) AS (VALUES {_foreign_heads}), heads AS (SELECT * FROM ids, hd)"
_alias_rows = ", ".join(f"('{a}', '{c}')" for a, c in sorted(K.ALIAS_TO_COLUMN.items()))
_known_low = ", ".join(f"'{n.lower()}'" for n in K.KNOWN_COLUMNS)
SUGGEST = f"{HEADS}, al(alias, target) AS (VALUES {_alias_rows}), sug AS (SELECT file_id, header, target FROM heads JOIN al ON lower(trim(header)) = alias)"
query("suggest_mapping", f"{SUGGEST} SELECT * FROM sug")(lambda spark, sf: CM.suggest_mapping(CK.header_table(foreign(spark, sf))))
query("mapping_conflicts", f"{SUGGEST} SELECT file_id, target, count(*) AS sources FROM sug GROUP BY 1, 2 HAVING count(*) > 1")(
    lambda spark, sf: CM.mapping_conflicts(CM.suggest_mapping(CK.header_table(foreign(spark, sf)))))
query("needs_mapping", f"{HEADS}, g AS (SELECT file_id, count(*) FILTER (WHERE lower(header) NOT IN ({_known_low}) AND NOT regexp_matches(header, '{K.EXEMPT_HEADER_RE}')) AS unknown_headers, NOT bool_or(lower(header) = 'handle') AS missing_required FROM heads GROUP BY 1) "
      "SELECT *, missing_required OR unknown_headers >= 3 AS needs_mapping FROM g")(
    lambda spark, sf: CM.needs_mapping(CK.header_table(foreign(spark, sf))))
query("apply_mapping", f'WITH {BASE} SELECT file_id, row_no, h AS handle, t AS title, vendor FROM base')(
    lambda spark, sf: CM.apply_mapping(foreign(spark, sf), {**{v: k for k, v in FOREIGN.items()}, "Legacy Code": ""})
    .select("file_id", "row_no", F.col("Handle").alias("handle"), F.col("Title").alias("title"), F.col("Vendor").alias("vendor")))
query("header_fingerprint", f"{HEADS} SELECT file_id, string_agg(lower(header), '|' ORDER BY lower(header)) AS fingerprint FROM heads GROUP BY 1")(
    lambda spark, sf: CM.header_fingerprint(CK.header_table(foreign(spark, sf))))
query("detect_import_mode", f"{HEADS}, n AS (SELECT file_id, count(DISTINCT lower(header)) FILTER (WHERE lower(header) IN ('status', 'published', 'image position', 'variant inventory tracker', 'variant fulfillment service', 'seo title', 'cost per item')) AS signals FROM heads GROUP BY 1) "
      "SELECT file_id, 'existing_products' AS mode, CASE WHEN signals >= 4 THEN 'high' ELSE 'medium' END AS confidence, signals FROM n WHERE signals >= 2")(
    lambda spark, sf: CM.detect_import_mode(foreign(spark, sf), CK.header_table(foreign(spark, sf))))
query("sample_preview", f"{C}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_no) AS n FROM c) SELECT file_id, row_no, "
      "substring(coalesce(h, ''), 1, 40) AS handle, substring(coalesce(t, ''), 1, 40) AS title, substring(coalesce(body, ''), 1, 40) AS body FROM r WHERE n <= 3")(
    lambda spark, sf: CM.sample_preview(catalog(spark, sf)).select("file_id", "row_no", F.col("Handle").alias("handle"), F.col("Title").alias("title"), F.col("Body (HTML)").alias("body")))

# ---- comparison -------------------------------------------------------------------------------------------------
_common = [n for n in T.UPDATE if n in T.CATALOG]
_hk = f"lower(coalesce({Q.trim(chr(34) + 'Handle' + chr(34))}, ''))"


def _side(name: str, src: str) -> str:
    cols = ", ".join(f'coalesce({Q.trim(chr(34) + n + chr(34))}, \'\') AS c{i}' for i, n in enumerate(_common))
    return (f"{name} AS (SELECT {_hk} AS handle, coalesce(nullif(\"Title\", ''), nullif(\"Variant SKU\", ''), {_hk}) AS title, {cols} FROM ({src}) "
            f"WHERE {_hk} <> '' QUALIFY row_number() OVER (PARTITION BY {_hk} ORDER BY row_no) = 1)")


PAIR = f"WITH {_side('s', T.SQL_CATALOG)}, {_side('u', T.SQL_UPDATE)}"
DIFF = PAIR + ", d AS (SELECT u.handle, u.title, 'NEW' AS change, '' AS field, '' AS before, '' AS after, false AS is_blank_overwrite FROM u LEFT JOIN s USING (handle) WHERE s.handle IS NULL " + " ".join(
    f"UNION ALL SELECT u.handle, u.title, 'CHANGE', '{n}', s.c{i}, u.c{i}, s.c{i} <> '' AND u.c{i} = '' FROM u JOIN s USING (handle) WHERE s.c{i} <> u.c{i}" for i, n in enumerate(_common)) + ")"


def diff(spark, sf):
    return CC.catalog_compare(T.catalog(spark, sf), T.catalog_update(spark, sf))


query("catalog_compare", f"{DIFF} SELECT * FROM d")(diff)
query("compare_new_products", f"{PAIR} SELECT u.handle, u.title FROM u LEFT JOIN s USING (handle) WHERE s.handle IS NULL")(
    lambda spark, sf: CC.compare_new_products(T.catalog(spark, sf), T.catalog_update(spark, sf)))
query("compare_unchanged", f"{PAIR} SELECT u.handle, u.title FROM u JOIN s USING (handle) WHERE " + " AND ".join(f"s.c{i} = u.c{i}" for i in range(len(_common))))(
    lambda spark, sf: CC.compare_unchanged(T.catalog(spark, sf), T.catalog_update(spark, sf)))
_cat_rows = ", ".join(f"('{f}', '{c}', '{n}')" for f, (c, n) in K.FIELD_CATEGORIES.items())
query("field_change_counts", f"{DIFF}, k(field, category, label) AS (VALUES {_cat_rows}) SELECT field, count(*) AS products, coalesce(category, 'other') AS category, coalesce(label, field) AS label FROM d LEFT JOIN k USING (field) WHERE change = 'CHANGE' GROUP BY field, category, label")(
    lambda spark, sf: CC.field_change_counts(diff(spark, sf)))
query("blank_overwrite_report", f"{DIFF} SELECT count(*) FILTER (WHERE is_blank_overwrite) AS cleared_fields, count(DISTINCT handle) FILTER (WHERE change = 'CHANGE') AS changed_products, count(*) FILTER (WHERE change = 'NEW') AS new_products, "
      "CASE WHEN count(*) FILTER (WHERE is_blank_overwrite) > 0 THEN 'critical' WHEN count(*) FILTER (WHERE change = 'CHANGE') > 0 THEN 'warning' ELSE 'pass' END AS verdict FROM d")(
    lambda spark, sf: CC.blank_overwrite_report(diff(spark, sf)))
_diff_columns = ["Handle", "Title", "Change", "Field", "Before", "After"]


@query("write_compare_diff", f'{DIFF} SELECT handle AS "Handle", title AS "Title", change AS "Change", field AS "Field", before AS "Before", after AS "After" FROM d')
def write_compare_diff(spark, sf):
    path = scratch_path(spark, "diff")
    CS.write_lines(CC.compare_diff_table(diff(spark, sf)), path, F.lit("compare"), ["Change", "Handle", "Field"], _diff_columns)
    return CS.read_lines(spark, path, _diff_columns).select(*_diff_columns)


_heads_u = ", ".join(f"({i}, '{n}')" for i, n in enumerate(T.UPDATE))
_heads_s = ", ".join(f"('{n}')" for n in T.CATALOG)
query("common_columns", f"SELECT u.header FROM (VALUES {_heads_u}) AS u(pos, header) JOIN (VALUES {_heads_s}) AS s(header) USING (header) WHERE EXISTS (SELECT 1 FROM part)")(
    lambda spark, sf: T.catalog_update(spark, sf).select(F.explode(F.array(*[F.lit(n) for n in CC.common_columns(
        R.data_columns(T.catalog_update(spark, sf)), R.data_columns(T.catalog(spark, sf)))])).alias("header")).distinct())

# ---- repairs ----------------------------------------------------------------------------------------------------
LOG = ["file_id", "row_no", "column_name", "before", "after", "reason"]


def log_of(step):
    return lambda spark, sf: CR.changes(step(CR.start(catalog(spark, sf)))).select(*LOG)


def fix_sql(reason: str, *cells: tuple[str, str, str, str]) -> str:
    """(column, condition, before, after) per cell."""
    return f"{C} " + " UNION ALL ".join(
        f"SELECT file_id, row_no, '{n}' AS column_name, {b} AS before, {a} AS after, '{reason}' AS reason FROM c WHERE {cond}" for n, cond, b, a in cells)


def _straight(x: str) -> str:
    s = f"regexp_replace({x}, '[\\x{{2018}}-\\x{{201B}}]', '''', 'g')"
    s = f"regexp_replace({s}, '[\\x{{201C}}-\\x{{201F}}\\x{{AB}}\\x{{2039}}\\x{{BB}}\\x{{203A}}]', '\"', 'g')"
    return f"replace(regexp_replace({s}, '[–—]', '-', 'g'), '…', '...')"


query("fix_smart_quotes", fix_sql("Replaced smart quotes", *[(n, _smart(s), f"substring({s}, 1, 80)", f"substring({_straight(s)}, 1, 80)") for n, s in SHORT.items()]))(log_of(CR.fix_smart_quotes))
query("fix_whitespace", fix_sql("Trimmed whitespace", *[(n, _padded(SHORT[n]), SHORT[n], Q.trim(SHORT[n])) for n in _known_trim]))(log_of(CR.fix_whitespace))
query("fix_currency", fix_sql("Stripped currency symbol", *[(n, f"regexp_matches({SHORT[n]}, '[$€£¥]')", SHORT[n], Q.strip_currency(SHORT[n])) for n in K.CURRENCY_COLUMNS]))(log_of(CR.fix_currency))
_nb = f"CASE WHEN lower({Q.trim('pub')}) IN ('true','yes','y','1','on') THEN 'TRUE' WHEN lower({Q.trim('pub')}) IN ('false','no','n','0','off') THEN 'FALSE' END"
query("fix_booleans", fix_sql("Normalized boolean value", ("Published", f"({_nb}) IS NOT NULL AND ({_nb}) <> {Q.trim('pub')}", "pub", _nb)))(log_of(CR.fix_booleans))
query("fix_handles", fix_sql("Normalized handle format", ("Handle", f"keyed AND NOT regexp_matches(h, '^[a-z0-9]+(-[a-z0-9]+)*$') AND {Q.slug('h')} <> '' AND {Q.slug('h')} <> h", "h", Q.slug("h"))))(log_of(CR.fix_handles))
query("fix_dup_images", f"{DUPIMG} SELECT file_id, row_no, 'Image Src' AS column_name, c.img AS before, '(row removed)' AS after, 'Removed duplicate image row' AS reason FROM d JOIN c USING (file_id, row_no) WHERE row_no > first_row")(log_of(CR.fix_dup_images))
query("fix_missing_handles", fix_sql("Generated from Title", ("Handle", f"NOT keyed AND {Q.filled('t')}", "CASE WHEN h IS NULL OR h = '' THEN '(empty)' ELSE h END", Q.slug("t"))))(log_of(CR.fix_missing_handles))
query("fix_https", fix_sql("Upgraded to HTTPS", ("Image Src", "regexp_matches(img, '(?i)^http://')", "img", "regexp_replace(img, '(?i)^http://', 'https://')")))(log_of(CR.fix_https))
query("fix_html")(log_of(CR.fix_html))
_numtext = lambda x: f"regexp_replace(regexp_replace(format('{{:.10f}}', {Q.price_value(x)}), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
query("fix_decimal_comma", fix_sql("Converted comma decimal to dot", *[(n, f"{Q.filled(SHORT[n])} AND {Q.comma_decimal(SHORT[n])} AND ({Q.price_value(SHORT[n])}) IS NOT NULL", SHORT[n], _numtext(SHORT[n])) for n in K.PRICE_COLUMNS]))(log_of(CR.fix_decimal_comma))
_sold = "(SELECT file_id, h FROM c WHERE keyed GROUP BY 1, 2 HAVING bool_or(sell))"
query("fix_image_rows", f"{C} " + " UNION ALL ".join(
    f"SELECT file_id, row_no, '{n}' AS column_name, substring({SHORT[n]}, 1, 60) AS before, '(cleared)' AS after, 'Cleared stray data from image row' AS reason FROM c JOIN {_sold} USING (file_id, h) WHERE image AND {Q.filled(SHORT[n])}"
    for n in K.IMAGE_ROW_CLEAR if n in SHORT))(log_of(CR.fix_image_rows))
_single = f"{C}, g AS (SELECT file_id, h, min(CASE WHEN sell THEN row_no END) AS row_no FROM c WHERE keyed GROUP BY 1, 2 HAVING count(*) FILTER (WHERE sell) = 1 AND count(*) FILTER (WHERE image) > 0), " \
          f"p AS (SELECT c.file_id, c.row_no FROM c JOIN g ON c.file_id = g.file_id AND c.row_no = g.row_no WHERE {Q.blank('c.o1n')} AND {Q.blank('c.o1v')})"
query("fix_single_variant", f"{_single} SELECT file_id, row_no, v.column_name, '(blank)' AS before, v.after, 'Set default option for single-variant product' AS reason FROM p, (VALUES ('Option1 Name', 'Title'), ('Option1 Value', 'Default Title')) AS v(column_name, after)")(log_of(CR.fix_single_variant))
query("fix_missing_qty", fix_sql("Set missing quantity to 0", ("Variant Inventory Qty", f"NOT (NOT sell AND {Q.filled('img')} AND {Q.blank('t')}) AND {Q.filled('tracker')} AND {Q.blank('qty')}", "'(blank)'", "'0'")))(log_of(CR.fix_missing_qty))
query("fix_duplicate_skus")(log_of(CR.fix_duplicate_skus))
query("unique_sku_suffix")(lambda spark, sf: CR.unique_sku_suffix(catalog(spark, sf)))
query("fix_identical_rows", f"{IDENT} SELECT file_id, row_no, '(row)' AS column_name, owner AS before, '(row removed)' AS after, 'Removed identical duplicate row' AS reason FROM d WHERE row_no > first_row")(log_of(CR.fix_identical_rows))


@query("fix_blank_columns", f"{BLANKS} SELECT file_id, column_name, '(present)' AS before, '(removed)' AS after, 'Entirely blank column' AS reason FROM b WHERE blanks > 0 AND blanks = considered")
def fix_blank_columns(spark, sf):
    return CR.blank_columns_to_drop(CK.findings(catalog(spark, sf), codes=["DESTRUCTIVE_BLANK_ALL_ROWS"]))


query("fix_remove_column", f"{C} SELECT file_id, row_no, h AS handle, t AS title FROM c")(
    lambda spark, sf: CR.remove_columns(catalog(spark, sf), ["Vendor", "Tags"]).select("file_id", "row_no", F.col("Handle").alias("handle"), F.col("Title").alias("title")))
_fx_price = f"({Q.strip_currency('price')})"


@query("change_log")
def change_log(spark, sf):
    return CR.changes(CR.repair(catalog(spark, sf), approved=list(CR.REVIEWED))).select(*LOG)


@query("change_counts", f"{C}, log AS (SELECT file_id, 'Upgraded to HTTPS' AS reason FROM c WHERE regexp_matches(img, '(?i)^http://') UNION ALL " + " UNION ALL ".join(
    f"SELECT file_id, 'Stripped currency symbol' FROM c WHERE regexp_matches({SHORT[n]}, '[$€£¥]')" for n in K.CURRENCY_COLUMNS) + ") SELECT file_id, reason, count(*) AS changes FROM log GROUP BY 1, 2")
def change_counts(spark, sf):
    return RP.change_counts(CR.changes(CR.fix_https(CR.fix_currency(CR.start(catalog(spark, sf))))))


# ---- scalars ----------------------------------------------------------------------------------------------------
query("slug", f"SELECT doc_id, {Q.slug('text')} AS slug FROM documents")(
    lambda spark, sf: T.table(spark, sf, "documents").select("doc_id", slug("text").alias("slug")))
query("price_parse", f"{C} SELECT file_id, row_no, {Q.price_value('price')} AS value, ({Q.price_value('price')}) IS NOT NULL AS parseable, {Q.comma_decimal('price')} AS comma_decimal, "
      f"regexp_matches(price, '[$€£¥]') AS has_currency, {Q.price_text('price')} AS normalized FROM c")(
    lambda spark, sf: catalog(spark, sf).select("file_id", "row_no", price_parse("Variant Price").alias("p")).select("file_id", "row_no", "p.*"))
query("bool_norm", f"{C} SELECT file_id, row_no, coalesce({_nb}, '') AS value FROM c")(
    lambda spark, sf: catalog(spark, sf).select("file_id", "row_no", F.coalesce(CR.P.bool_norm("Published"), F.lit("")).alias("value")))
query("category_ok", f"{C} SELECT file_id, row_no, NOT (coalesce({Q.filled('cat')} AND NOT regexp_matches({Q.trim('cat')}, '(?i)^gid://shopify/|[>»›]|^[a-z]{{2}}(-[a-z0-9]+)+$'), false)) AS ok FROM c")(
    lambda spark, sf: catalog(spark, sf).select("file_id", "row_no", CR.P.category_ok("Product Category").alias("ok")))
query("is_blank", f"{C} SELECT file_id, row_no, {Q.blank('t')} AS blank_title, {Q.blank('o1n')} AS blank_option FROM c")(
    lambda spark, sf: catalog(spark, sf).select("file_id", "row_no", R.is_blank("Title").alias("blank_title"), R.is_blank("Option1 Name").alias("blank_option")))
