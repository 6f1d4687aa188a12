"""The catalog rule set: every rule yields ``findings``, one row per hit.

Rules are grouped by the data movement they need:

* row-local rules are evaluated together in one projection over one scan (no shuffle);
* handle, option, SKU, image and signature rules have a key each; asked for alone, a family is one aggregate;
* together (``joint_rules``) all of them read whole rows twice, whatever their number: one aggregate over one exploded table
  of keys, joined with the rows' own keys. Row order adds a read of the handles;
* blank-column rules are an aggregate per handle, then per file.

``scope`` names the issue inside a code: hits with the same ``(file_id, code, scope)`` are one issue.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import catalog_fields as K
from gristmill.functions import prices as P
from gristmill.functions import urls as U
from gristmill.functions.text import is_blank, jstrim, not_blank, or_text
from gristmill.operators import catalog_rows as R
from gristmill.operators.ordered import value_changes

SCHEMA = "file_id string, code string, severity string, auto_fix string, scope string, row_no bigint, handle string, column_name string, value string, detail string"
OUT = ["file_id", "code", "severity", "auto_fix", "scope", "row_no", "handle", "column_name", "value", "detail"]


@dataclass
class Context:
    df: DataFrame
    mode: str = "existing_products"

    def has(self, name: str) -> bool:
        return name in self.df.columns

    def cell(self, name: str) -> Column:
        return R.cell(self.df, name)


def _hit(code: str, cond: Column, column, value, detail=None, scope=None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(
        cond,
        F.struct(
            F.lit(code).alias("code"), lit("" if scope is None else scope).alias("scope"),
            lit(column).cast("string").alias("column_name"), lit(value).cast("string").alias("value"),
            lit(detail).cast("string").alias("detail"),
        ),
    )


def html_open_tag(html) -> Column:
    """Last tag left open when the text ends, null when none. Void tags count as open."""
    return F.try_element_at(html_open_tags(html), F.lit(-1))


def html_open_tags(html) -> Column:
    """Names of the tags left open when the text ends, the outermost first."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(</?[a-zA-Z][a-zA-Z0-9]*\b[^>]*>)"), F.lit(1))
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    top = lambda s: F.try_element_at(s, F.lit(-1))
    return F.aggregate(
        tags,
        F.array().cast("array<string>"),
        lambda s, t: F.when(
            t.startswith("</"),
            F.when((F.size(s) > 0) & (top(s) == name(t)), F.slice(s, 1, F.size(s) - 1)).otherwise(s),
        ).when(t.endswith("/>"), s).otherwise(F.concat(s, F.array(name(t)))),
    )


def _row_hits(x: Context, codes: list[str]) -> list[tuple[str, Column]]:
    """The wanted row-local rules as (code, struct-or-null)."""
    c, cols = x.cell, R.data_columns(x.df)
    img = R.is_image_row(x.df)
    hits: list[tuple[str, Column]] = []

    def add(code, cond, column, value, **kw):
        if code in codes:
            hits.append((code, _hit(code, cond, column, value, **kw)))

    def need(*names):
        return any(n in codes for n in names)

    # the first cell, in file order, that holds a typographic character / outer space
    if need("SMART_QUOTES_DETECTED"):
        smart = F.coalesce(*[F.when(F.col(n).rlike(K.SMART_CHARS_RE), F.struct(F.lit(n).alias("n"), F.substring(n, 1, 60).alias("v"))) for n in cols])
        add("SMART_QUOTES_DETECTED", smart.isNotNull(), smart["n"], smart["v"])
    wcols = [n for n in K.WHITESPACE_COLUMNS if x.has(n)]
    if wcols and need("CELL_WHITESPACE"):
        padded = lambda n: not_blank(n) & (F.col(n) != jstrim(n))
        ws = F.coalesce(*[F.when(padded(n), F.struct(F.lit(n).alias("n"), F.col(n).alias("v"))) for n in wcols])
        add("CELL_WHITESPACE", ws.isNotNull(), ws["n"], ws["v"])

    h, title = c("Handle"), c("Title")
    if x.mode == "new_products":
        add("HANDLE_MISSING_NEW", is_blank(h) & not_blank(title), "Handle", title)
    else:
        add("HANDLE_MISSING_UPDATE", is_blank(h), "Handle", or_text(title, "(no title)"))
    add("HANDLE_FORMAT_INVALID", not_blank(h) & ~h.rlike(K.HANDLE_RE), "Handle", h)
    sku = c("Variant SKU")
    add("SKU_WHITESPACE", not_blank(sku) & (jstrim(sku) != sku), "Variant SKU", sku)

    o1 = not_blank(c("Option1 Name")) | not_blank(c("Option1 Value"))
    add("VARIANT_ORPHANED", o1 & is_blank(h), "Handle", c("Option1 Value"))
    pairs = [i for i in (1, 2, 3) if x.has(f"Option{i} Name") and x.has(f"Option{i} Value")]
    if pairs and need("VARIANT_PARTIAL_COLLAPSE"):
        half = F.coalesce(*[
            F.when(is_blank(f"Option{i} Name") != is_blank(f"Option{i} Value"),
                   F.struct(F.lit(f"Option{i}").alias("n"),
                            F.concat(or_text(F.col(f"Option{i} Name"), "(blank)"), F.lit(" / "),
                                     or_text(F.col(f"Option{i} Value"), "(blank)")).alias("v")))
            for i in pairs])
        add("VARIANT_PARTIAL_COLLAPSE", half.isNotNull(), half["n"], half["v"])

    if need("IMAGE_ROW_VARIANT_DATA"):
        dirty = F.array_join(F.array(*[F.when(not_blank(n), F.lit(n)) for n in K.IMAGE_ROW_EXTRA if x.has(n)]), ", ")
        add("IMAGE_ROW_VARIANT_DATA", img & (dirty != ""), dirty, c("Image Src"))

    tracker, qty = c("Variant Inventory Tracker"), c("Variant Inventory Qty")
    if x.has("Variant Inventory Tracker") and x.has("Variant Inventory Qty") and need("INVENTORY_QTY_MISSING_WITH_TRACKER", "INVENTORY_TRACKER_MISSING"):
        add("INVENTORY_QTY_MISSING_WITH_TRACKER", ~img & not_blank(tracker) & is_blank(qty), "Variant Inventory Qty", tracker)
        add("INVENTORY_TRACKER_MISSING", ~img & not_blank(qty) & is_blank(tracker), "Variant Inventory Tracker", qty)
    for n in K.BOOLEAN_COLUMNS:
        if x.has(n) and need("BOOLEAN_FORMAT"):
            add("BOOLEAN_FORMAT", ~img & not_blank(n) & P.bool_norm(n).isNull(), n, F.col(n))
    if x.has("Product Category") and need("PRODUCT_CATEGORY_FORMAT"):
        add("PRODUCT_CATEGORY_FORMAT", ~img & ~P.category_ok("Product Category"), "Product Category", F.substring("Product Category", 1, 80))
    for n in K.PRICE_COLUMNS:
        if x.has(n) and need("PRICE_CURRENCY_SYMBOL", "PRICE_DECIMAL_COMMA", "PRICE_NON_NUMERIC", "PRICE_NEGATIVE"):
            live = ~img & not_blank(n)
            add("PRICE_CURRENCY_SYMBOL", live & P.price_has_currency(n), n, F.col(n))
            add("PRICE_DECIMAL_COMMA", live & P.price_is_comma_decimal(n), n, F.col(n), detail=P.price_text(n))
            add("PRICE_NON_NUMERIC", live & P.price_value(n).isNull(), n, F.col(n))
            add("PRICE_NEGATIVE", live & (P.price_value(n) < 0), n, F.col(n))
    if x.has("Variant Inventory Qty") and need("INVENTORY_NON_INTEGER", "INVENTORY_NEGATIVE"):
        num = P.number_or_null(jstrim(qty))
        whole = num.isNotNull() & (num == F.floor(num))
        add("INVENTORY_NON_INTEGER", ~img & not_blank(qty) & ~whole, "Variant Inventory Qty", qty)
        add("INVENTORY_NEGATIVE", ~img & not_blank(qty) & whole & (num < 0), "Variant Inventory Qty", qty)
    if x.has("Body (HTML)") and need("HTML_UNCLOSED_TAG", "HTML_DANGEROUS_ATTRIBUTE"):
        body = c("Body (HTML)")
        tag = html_open_tag(body)
        add("HTML_UNCLOSED_TAG", not_blank(body) & tag.isNotNull(), "Body (HTML)", tag)
        unsafe = F.regexp_extract(body, r"(?i)<(script|iframe|object|embed)\b", 1)
        add("HTML_DANGEROUS_ATTRIBUTE", not_blank(body) & (unsafe != ""), "Body (HTML)", unsafe)
    if x.has("Image Src") and need("IMAGE_URL_NOT_HTTPS", "IMAGE_URL_MALFORMED", "IMAGE_URL_PRIVATE_CDN", "IMAGE_URL_NO_EXTENSION"):
        src = jstrim("Image Src")
        ok = U.url_parses(src)
        some = not_blank("Image Src")
        add("IMAGE_URL_NOT_HTTPS", some & src.rlike(r"(?i)^http://"), "Image Src", src)
        add("IMAGE_URL_MALFORMED", some & ~ok, "Image Src", src)
        add("IMAGE_URL_PRIVATE_CDN", some & ok & F.coalesce(U.url_part(src, "HOST").rlike(U.PRIVATE_HOST_RE), F.lit(False)), "Image Src", src)
        add("IMAGE_URL_NO_EXTENSION", some & ok & ~F.coalesce(U.url_part(src, "PATH"), F.lit("")).rlike(U.IMAGE_EXT_RE), "Image Src", src)
    if x.has("Status") and need("STATUS_INVALID_VALUE"):
        status = c("Status")
        add("STATUS_INVALID_VALUE", ~img & not_blank(status) & ~F.lower(jstrim(status)).isin(K.STATUS_VALUES), "Status", status)
    return hits


ROW_CODES = [
    "SMART_QUOTES_DETECTED", "CELL_WHITESPACE", "HANDLE_MISSING_NEW", "HANDLE_MISSING_UPDATE",
    "HANDLE_FORMAT_INVALID", "SKU_WHITESPACE", "VARIANT_ORPHANED", "VARIANT_PARTIAL_COLLAPSE",
    "IMAGE_ROW_VARIANT_DATA", "INVENTORY_QTY_MISSING_WITH_TRACKER", "INVENTORY_TRACKER_MISSING",
    "BOOLEAN_FORMAT", "PRODUCT_CATEGORY_FORMAT", "PRICE_CURRENCY_SYMBOL", "PRICE_DECIMAL_COMMA",
    "PRICE_NON_NUMERIC", "PRICE_NEGATIVE", "INVENTORY_NON_INTEGER", "INVENTORY_NEGATIVE",
    "HTML_UNCLOSED_TAG", "HTML_DANGEROUS_ATTRIBUTE", "IMAGE_URL_NOT_HTTPS", "IMAGE_URL_MALFORMED",
    "IMAGE_URL_PRIVATE_CDN", "IMAGE_URL_NO_EXTENSION", "STATUS_INVALID_VALUE",
]


def row_rules(x: Context, codes: list[str]) -> DataFrame:
    hits = [h for _, h in _row_hits(x, codes)]
    if not hits:
        return None
    rows = x.df.select(
        "file_id", "row_no", or_text(x.cell("Handle"), "(no handle)").alias("handle"),
        F.inline(F.filter(F.array(*hits), lambda s: s.isNotNull())),
    )
    return rows


HIT_ARRAY = "array<struct<row_no bigint, code string, scope string, column_name string, value string, detail string>>"
HANDLE_CODES = [
    "TITLE_MISSING", "HANDLE_DUPLICATE_IN_FILE", "VARIANT_OPTION_NAME_INCONSISTENT",
    "VARIANT_COLUMN_INCONSISTENCY", "SINGLE_VARIANT_MULTIPLE_IMAGES", "COMPARE_AT_PRICE_LOWER_THAN_PRICE",
]


def _handle_facts(x: Context) -> Column:
    """What the handle rules need of a row."""
    c = x.cell
    sell = R.is_sellable(x.df)
    live = ~R.is_image_row(x.df)
    return F.struct(
        c("Title").alias("title"), c("Variant Price").alias("price"), c("Variant Compare At Price").alias("compare"),
        F.when(not_blank(c("Option1 Name")), c("Option1 Name")).alias("named"), live.alias("live"), sell.alias("sell"),
        is_blank(c("Option1 Name")).alias("bare_name"), is_blank(c("Option1 Value")).alias("bare_value"),
        *[(live & not_blank(n)).alias(f"f{i}") for i, n in enumerate(n for n in K.OPTION_COLUMNS if x.has(n))])


def _handle_aggregates(x: Context) -> list[Column]:
    """Aggregates over ``h``, the facts of ``_handle_facts``. "More than one distinct value" is min <> max."""
    h = lambda n: F.col(f"h.{n}")
    keyed = F.when(F.col("h").isNotNull(), F.col("row_no"))
    title = F.when(h("title") != "", h("title"))
    return [
        F.min_by(F.struct(h("title").alias("title"), h("price").alias("price"), h("compare").alias("compare")), keyed).alias("first"),
        F.min(title).alias("t_min"), F.max(title).alias("t_max"), F.min(h("named")).alias("o_min"), F.max(h("named")).alias("o_max"),
        F.count_if(h("live")).alias("live"), F.count_if(h("sell")).alias("sell"), F.count_if(~h("live")).alias("img"),
        F.min_by(F.struct(F.col("row_no"), h("bare_name").alias("n"), h("bare_value").alias("v")), F.when(h("sell"), F.col("row_no"))).alias("parent"),
    ] + [F.count_if(h(f"f{i}")).alias(f"f{i}") for i, _ in enumerate(n for n in K.OPTION_COLUMNS if x.has(n))]


def _handle_hits(x: Context, codes: list[str], h: Column) -> Column:
    """The hits of a handle ``h`` from its aggregates, ``first_row`` and ``rows``."""
    opts = [n for n in K.OPTION_COLUMNS if x.has(n)]
    partial = F.array_join(
        F.array(*[
            F.when((F.col(f"f{i}") > 0) & (F.col(f"f{i}") != F.col("live")),
                   F.concat(F.lit(f"{n} ("), F.col(f"f{i}").cast("string"), F.lit("/"), F.col("live").cast("string"), F.lit(")")))
            for i, n in enumerate(opts)]), ", ") if opts else F.lit("")
    price, compare = P.price_value(F.col("first.price")), P.price_value(F.col("first.compare"))

    def hit(code, cond, column, value, at="first_row", scope="", detail=None):
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return code, F.when(cond, F.struct(
            F.col(at).alias("row_no"), F.lit(code).alias("code"), lit(scope).alias("scope"), F.lit(column).alias("column_name"),
            lit(value).cast("string").alias("value"), lit(detail).cast("string").alias("detail")))

    rules = [
        hit("TITLE_MISSING", is_blank(F.col("first.title")), "Title", h),
        hit("HANDLE_DUPLICATE_IN_FILE", (F.col("rows") > 1) & (F.col("t_min") != F.col("t_max")), "Handle", h, scope=h),
        hit("VARIANT_OPTION_NAME_INCONSISTENT", F.col("o_min") != F.col("o_max"), "Option1 Name", h, scope=h),
        hit("VARIANT_COLUMN_INCONSISTENCY", (F.col("live") >= 2) & (partial != ""), "Option1 Name", partial),
        hit("SINGLE_VARIANT_MULTIPLE_IMAGES",
            (F.col("img") > 0) & (F.col("sell") == 1) & F.col("parent.n") & F.col("parent.v"),
            "Option1 Name", F.col("img"), at="parent.row_no"),
    ]
    if x.has("Variant Price") and x.has("Variant Compare At Price"):
        rules.append(hit("COMPARE_AT_PRICE_LOWER_THAN_PRICE", price.isNotNull() & (compare > 0) & (compare <= price),
                         "Variant Compare At Price", F.col("first.compare"), detail=F.col("first.price")))
    wanted = [s for code, s in rules if code in codes]
    return F.array_compact(F.array(*wanted)) if wanted else F.from_json(F.lit("[]"), HIT_ARRAY)


def handle_rules(x: Context, codes: list[str]) -> DataFrame:
    """One aggregate per handle feeds six rules."""
    rows = x.df.filter(not_blank(x.cell("Handle"))).select("file_id", "row_no", F.col("Handle").alias("handle"), _handle_facts(x).alias("h"))
    g = rows.groupBy("file_id", "handle").agg(F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("rows"), *_handle_aggregates(x))
    return g.select("file_id", "handle", F.inline(_handle_hits(x, codes, F.col("handle"))))


def _rows(df: DataFrame, code: str, scope, row_no, handle, column, value, detail=None) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        "file_id", lit(row_no).cast("bigint").alias("row_no"), lit(handle).alias("handle"), F.lit(code).alias("code"),
        lit(scope).alias("scope"), lit(column).alias("column_name"), lit(value).cast("string").alias("value"),
        lit(detail).cast("string").alias("detail"),
    )


def option_combinations(x: Context) -> DataFrame:
    c = x.cell
    o = [F.coalesce(c(f"Option{i} Value"), F.lit("")).alias(f"o{i}") for i in (1, 2, 3)]
    some = not_blank(c("Option1 Value")) | not_blank(c("Option2 Value")) | not_blank(c("Option3 Value"))
    g = (
        x.df.filter(not_blank(c("Handle")) & some)
        .groupBy("file_id", F.col("Handle").alias("handle"), *o)
        .agg(F.min("row_no").alias("row_no"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    combo = F.array_join(F.array("o1", "o2", "o3"), " / ")
    combo = F.regexp_replace(combo, r"( / )+$", "")
    return _rows(g, "VARIANT_DUPLICATE_OPTION_COMBINATION", "", F.col("row_no"), F.col("handle"), "Option1 Name", combo, F.col("n"))


def shared_skus(x: Context) -> DataFrame:
    owner = or_text(x.cell("Handle"), "(no handle)")
    g = (
        x.df.filter(not_blank(x.cell("Variant SKU")))
        .groupBy("file_id", jstrim("Variant SKU").alias("sku"))
        .agg(F.min(owner).alias("a"), F.max(owner).alias("b"), F.min("row_no").alias("row_no"), F.count(F.lit(1)).alias("n"))
        .filter("a <> b")
    )
    return _rows(g, "SKU_DUPLICATE_IN_FILE", F.col("sku"), F.col("row_no"), F.col("a"), "Variant SKU", F.col("sku"), F.col("n"))


def identical_rows(x: Context) -> DataFrame:
    d = R.dup_identical_rows(x.df)
    return _rows(d, "DUPLICATE_IDENTICAL_ROWS", "", F.col("row_no"), F.col("handle"), "(row)", F.col("title"), F.col("first_row"))


def repeated_images(x: Context) -> DataFrame:
    d = R.dup_image_rows(x.df)
    return _rows(d, "DUPLICATE_IMAGE_ROWS", "", F.col("row_no"), F.col("handle"), "Image Src", F.col("url"), F.col("first_row"))


def row_order(x: Context) -> DataFrame:
    d = R.scattered_handles(x.df)
    return _rows(d, "ROW_ORDER_WARNING", "", F.col("row_no"), F.col("handle"), "Handle", F.col("prev_handle"))


def blank_columns(df: DataFrame) -> DataFrame:
    """Per file and sensitive column: cells that count and how many of them are blank.

    A product-level cell counts in the leading row of its handle, any other in all rows of a handle but image rows.
    """
    cols = [n for n in K.SENSITIVE if n in df.columns]
    img, sell = R.is_image_row(df), R.is_sellable(df)
    lead = sell | (not_blank(R.cell(df, "Title")) & ~img)
    blank = F.struct(*[is_blank(n).alias(f"b{i}") for i, n in enumerate(cols)])
    handle = R.cell(df, "Handle")
    rows = df.filter(not_blank(handle)).select("file_id", "row_no", handle.alias("handle"), img.alias("img"), lead.alias("lead"), blank.alias("blank"))
    g = rows.groupBy("file_id", "handle").agg(
        F.count_if(~F.col("img")).alias("rows"), F.min_by("blank", F.when(F.col("lead"), F.col("row_no"))).alias("top"),
        *[F.count_if(~F.col("img") & F.col(f"blank.b{i}")).alias(f"n{i}") for i, _ in enumerate(cols)])
    has_top = F.col("top").isNotNull()
    f = g.groupBy("file_id").agg(
        F.sum("rows").alias("rows"), F.count_if(has_top).alias("tops"),
        *[(F.count_if(F.col(f"top.b{i}")) if n in K.PRODUCT_LEVEL else F.sum(f"n{i}")).alias(f"n{i}") for i, n in enumerate(cols)])
    return f.select("file_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.col("tops" if n in K.PRODUCT_LEVEL else "rows").alias("considered"), F.col(f"n{i}").alias("blank"))
        for i, n in enumerate(cols)])))


KEYED_CODES = {
    "option": "VARIANT_DUPLICATE_OPTION_COMBINATION", "sku": "SKU_DUPLICATE_IN_FILE", "signature": "DUPLICATE_IDENTICAL_ROWS",
    "image": "DUPLICATE_IMAGE_ROWS", "handle": "ROW_ORDER_WARNING",
}


def _keys(x: Context, codes: list[str]) -> list[tuple[str, Column, list[Column], Column]]:
    """Keys of a row for the wanted rules but those of handles: (kind, condition, key, text that a finding quotes)."""
    c = x.cell
    o = [F.coalesce(c(f"Option{i} Value"), F.lit("")) for i in (1, 2, 3)]
    some = not_blank(c("Option1 Value")) | not_blank(c("Option2 Value")) | not_blank(c("Option3 Value"))
    sku, url = jstrim(c("Variant SKU")), jstrim(c("Image Src"))
    keys = [
        ("option", not_blank(c("Handle")) & some, [c("Handle"), *o], F.regexp_replace(F.array_join(F.array(*o), " / "), r"( / )+$", "")),
        ("sku", not_blank(c("Variant SKU")), [sku], sku),
        ("signature", R.any_cell(x.df), [R.row_signature(x.df)], or_text(c("Title"), "(no title)")),
        ("image", R.is_lone_image(x.df), [c("Handle"), url], url),
    ]
    return [k for k in keys if KEYED_CODES[k[0]] in codes]


def _groups(x: Context, codes: list[str], keys: list) -> DataFrame:
    """One row per (file, kind, key) that has something to report, from one aggregate over all kinds.

    ``h`` is null for all kinds but handles, so the handle aggregates pass over the other keys.
    """
    handles = any(c in codes for c in (*HANDLE_CODES, "ROW_ORDER_WARNING"))
    facts = _handle_facts(x)
    owner = or_text(x.cell("Handle"), "(no handle)")
    entry = lambda kind, cond, key, who, h: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.array(*key).alias("key"), who.alias("owner"), h.alias("h")))
    none = F.when(F.lit(False), facts)
    entries = [entry(kind, cond, key, owner if kind == "sku" else F.lit(None).cast("string"), none) for kind, cond, key, _ in keys]
    if handles:
        entries.append(entry("handle", not_blank(x.cell("Handle")), [x.cell("Handle")], F.lit(None).cast("string"), facts))
    rows = x.df.select("file_id", "row_no", F.inline(F.array_compact(F.array(*entries))))
    g = rows.groupBy("file_id", "kind", "key").agg(
        F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("rows"), F.min("owner").alias("first_owner"), F.max("owner").alias("last_owner"),
        *(_handle_aggregates(x) if handles else []))
    hits = _handle_hits(x, codes, F.col("key")[0]) if handles else F.from_json(F.lit("[]"), HIT_ARRAY)
    hits = F.when(F.col("kind") == "handle", hits)
    g = g.select("file_id", "kind", "key", "first_row", "rows", "first_owner", "last_owner", hits.alias("hits"))
    shared = F.when(F.col("kind") == "sku", F.col("first_owner") != F.col("last_owner")).otherwise(F.col("rows") > 1)
    return g.filter(shared | (F.size("hits") > 0))


def joint_rules(x: Context, codes: list[str]) -> DataFrame:
    """Row rules and all keyed rules together, in two reads of whole rows.

    The rows' own hits and keys are exploded once and joined with the groups that have something to report, which are one row a
    key: adaptive execution broadcasts them if they are few and splits hot keys if not. A hit of the whole group is reported at its
    first row. Rows enter for their handle only where the handle changes, since its first row is always among those.
    """
    keys = _keys(x, codes)
    null = F.lit(None).cast("string")
    parts = [
        F.when(cond, F.struct(null.alias("code"), F.lit("").alias("scope"), null.alias("column_name"), text.alias("value"), null.alias("detail"),
                              F.lit(kind).alias("kind"), F.array(*key).alias("key")))
        for kind, cond, key, text in keys]
    # a hit of the row itself has a key that spreads it over the tasks and meets no group
    own = F.array(F.col("row_no").cast("string"))
    parts += [F.when(s.isNotNull(), F.struct(s["code"].alias("code"), s["scope"].alias("scope"), s["column_name"].alias("column_name"), s["value"].alias("value"),
                                             s["detail"].alias("detail"), F.lit("").alias("kind"), own.alias("key"))) for _, s in _row_hits(x, codes)]
    found = []
    if parts:
        found.append(x.df.select("file_id", "row_no", or_text(x.cell("Handle"), "(no handle)").alias("handle"), F.inline(F.array_compact(F.array(*parts)))))
    if any(c in codes for c in (*HANDLE_CODES, "ROW_ORDER_WARNING")) and x.has("Handle"):
        named = x.df.filter(not_blank("Handle")).select("file_id", "row_no", F.col("Handle").alias("handle"))
        runs = value_changes(named, ["file_id"], "row_no", "handle", "value")
        found.append(runs.select("file_id", "row_no", "handle", null.alias("code"), F.lit("").alias("scope"), null.alias("column_name"), "value", null.alias("detail"),
                                 F.lit("handle").alias("kind"), F.array("handle").alias("key")))
    j = _union(found).join(_groups(x, codes, keys), ["file_id", "kind", "key"], "left")
    kind, first, later = F.col("kind"), F.col("row_no") == F.col("first_row"), F.col("row_no") > F.col("first_row")

    def hit(code, column, detail, handle="handle", scope=""):
        return F.array(F.struct(
            F.col("row_no"), F.col(handle).alias("handle"), F.lit(code).alias("code"), (F.col(scope) if scope else F.lit("")).alias("scope"), F.lit(column).alias("column_name"),
            F.col("value"), detail.cast("string").alias("detail")))

    same = F.array(F.struct("row_no", "handle", "code", "scope", "column_name", "value", "detail"))
    of_handle = F.transform("hits", lambda s: F.struct(
        s["row_no"].alias("row_no"), F.col("handle"), s["code"].alias("code"), s["scope"].alias("scope"), s["column_name"].alias("column_name"), s["value"].alias("value"),
        s["detail"].alias("detail")))
    out = (
        F.when(kind == "", same)
        .when((kind == "option") & first, hit(KEYED_CODES["option"], "Option1 Name", F.col("rows")))
        .when((kind == "sku") & first, hit(KEYED_CODES["sku"], "Variant SKU", F.col("rows"), "first_owner", "value"))
        .when((kind == "signature") & later, hit(KEYED_CODES["signature"], "(row)", F.col("first_row")))
        .when((kind == "image") & later, hit(KEYED_CODES["image"], "Image Src", F.col("first_row")))
        .when((kind == "handle") & first, of_handle))
    if "ROW_ORDER_WARNING" in codes:
        out = out.when((kind == "handle") & later, hit(KEYED_CODES["handle"], "Handle", F.lit(None)))
    return j.select("file_id", F.inline(out))


def destructive_blanks(x: Context, codes: list[str]) -> DataFrame:
    if x.mode != "existing_products":
        return None
    g = blank_columns(x.df).filter("considered > 0 and blank > 0")
    code = F.when(F.col("blank") == F.col("considered"), "DESTRUCTIVE_BLANK_ALL_ROWS").otherwise("DESTRUCTIVE_BLANK_INCLUDED_COLUMN")
    out = g.withColumn("code", code).filter(F.col("code").isin(codes))
    return out.select(
        "file_id", F.lit(None).cast("bigint").alias("row_no"), F.lit("").alias("handle"), "code",
        F.col("column_name").alias("scope"), "column_name", F.col("blank").cast("string").alias("value"),
        F.col("considered").cast("string").alias("detail"),
    )


def header_table(df: DataFrame) -> DataFrame:
    """(file_id, pos, header) of a catalog DataFrame. Built from column names; no cell is read."""
    names = F.array(*[F.lit(n) for n in R.data_columns(df)])
    return df.select("file_id").distinct().select("file_id", F.posexplode(names).alias("pos", "header"))


def header_rules(headers: DataFrame, mode: str, codes: list[str]) -> DataFrame:
    """Rules on header names only. ``headers`` has one row per file and column."""
    low = F.lower("header")
    parts = []
    if "HEADER_UNKNOWN_COLUMN" in codes:
        known = [n.lower() for n in K.KNOWN_COLUMNS]
        h = headers.filter((F.col("header") != "") & ~low.isin(known) & ~F.col("header").rlike(K.EXEMPT_HEADER_RE))
        parts.append(_rows(h, "HEADER_UNKNOWN_COLUMN", F.col("header"), None, "", F.col("header"), ""))
    if "HEADER_DUPLICATE" in codes:
        d = headers.groupBy("file_id", low.alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        parts.append(_rows(d, "HEADER_DUPLICATE", F.col("name"), None, "", F.col("name"), F.col("n")))
    if "HEADER_REQUIRED_MISSING" in codes and mode == "new_products":
        have = headers.groupBy("file_id").agg(
            F.bool_or(low == "handle").alias("handle"), F.bool_or(low == "title").alias("title"))
        # a missing Handle is excused when a Title can make one
        need = have.select("file_id", F.explode(F.array_compact(F.array(
            F.when(~F.col("handle") & ~F.col("title"), F.lit("Handle")), F.when(~F.col("title"), F.lit("Title"))))).alias("name"))
        parts.append(_rows(need, "HEADER_REQUIRED_MISSING", F.col("name"), None, "", F.col("name"), ""))
    return _union(parts)


def file_rules(files: DataFrame, codes: list[str]) -> DataFrame:
    """Rules on the file itself: ``files(file_id, delimiter, encoding, has_bom, byte_size, misfit_rows)``."""
    def hit(code, cond, value):
        return code, F.when(cond, F.struct(F.lit(code).alias("code"), value.cast("string").alias("value")))
    size = F.col("byte_size")
    rules = [
        hit("DELIMITER_NOT_COMMA", F.col("delimiter") != ",", F.col("delimiter")),
        hit("FILE_SIZE_APPROACHING_LIMIT", (size >= K.SIZE_WARN_BYTES) & (size < K.SIZE_LIMIT_BYTES), size),
        hit("FILE_SIZE_OVER_LIMIT", size >= K.SIZE_LIMIT_BYTES, size),
        hit("ENCODING_BOM_PRESENT", F.col("has_bom"), F.col("encoding")),
        hit("ENCODING_NOT_UTF8", F.col("encoding") != "UTF-8", F.col("encoding")),
        hit("FIELD_COUNT_MISMATCH", F.col("misfit_rows") > 0, F.col("misfit_rows")),
    ]
    structs = [s for code, s in rules if code in codes]
    if not structs:
        return None
    out = files.select("file_id", F.inline(F.filter(F.array(*structs), lambda s: s.isNotNull())))
    return out.select(
        "file_id", F.lit(None).cast("bigint").alias("row_no"), F.lit("").alias("handle"), "code", F.lit("").alias("scope"),
        F.lit("(file)").alias("column_name"), "value", F.lit(None).cast("string").alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame | None:
    parts = [p for p in parts if p is not None]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


@dataclass
class Rule:
    """Extension point: a user rule is a code, its class, a detector returning finding rows, and its repair.

    ``repair`` takes the table of ``catalog_repair.start`` and returns it changed and logged, usually by
    ``catalog_repair.rewrite``. It runs with the automatic repairs if ``auto_fix`` is "auto", else when its code is approved.
    """

    code: str
    severity: str
    auto_fix: str
    detect: Callable[[Context], DataFrame]
    passed: str | None = None
    repair: Callable[[DataFrame], DataFrame] | None = None


def findings(
    df: DataFrame,
    mode: str = "existing_products",
    codes: list[str] | None = None,
    files: DataFrame | None = None,
    headers: DataFrame | None = None,
    extra_rules: list[Rule] = (),
) -> DataFrame:
    """Run the chosen rules (default: all) and return the long ``findings`` table."""
    codes = list(K.RULES) if codes is None else codes
    x = Context(df, mode)
    want = lambda group: [c for c in group if c in codes]
    parts = []
    single = {
        "VARIANT_DUPLICATE_OPTION_COMBINATION": option_combinations, "SKU_DUPLICATE_IN_FILE": shared_skus,
        "DUPLICATE_IDENTICAL_ROWS": identical_rows, "DUPLICATE_IMAGE_ROWS": repeated_images, "ROW_ORDER_WARNING": row_order,
    }
    keyed = want(single)
    if len(keyed) + bool(want(HANDLE_CODES)) + bool(want(ROW_CODES)) > 1 and (keyed or want(HANDLE_CODES)):
        parts.append(joint_rules(x, codes))
    else:
        # one family alone needs no join with the rows
        if want(ROW_CODES):
            parts.append(row_rules(x, codes))
        if want(HANDLE_CODES):
            parts.append(handle_rules(x, codes))
        parts += [single[code](x) for code in keyed]
    if want(["DESTRUCTIVE_BLANK_ALL_ROWS", "DESTRUCTIVE_BLANK_INCLUDED_COLUMN"]):
        blanks = destructive_blanks(x, codes)
        if blanks is not None and files is not None:
            # misaligned files would report blanks that are only shifted cells
            misfit = files.filter(F.col("misfit_rows") > 0).select("file_id")
            blanks = blanks.join(misfit, "file_id", "left_anti")
        parts.append(blanks)
    if want(["HEADER_UNKNOWN_COLUMN", "HEADER_DUPLICATE", "HEADER_REQUIRED_MISSING"]):
        parts.append(header_rules(headers if headers is not None else header_table(df), mode, codes))
    if files is not None:
        parts.append(file_rules(files, codes))
    classes = dict(K.RULES)
    for r in extra_rules:
        classes[r.code] = (r.severity, r.auto_fix, r.passed)
        parts.append(r.detect(x))
    out = _union([p.select("file_id", "row_no", "handle", "code", "scope", "column_name", "value", "detail") for p in parts if p is not None])
    if out is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    table = F.create_map(*[v for code, (sev, fix, _) in classes.items() if code in codes or code not in K.RULES for v in (F.lit(code), F.struct(F.lit(sev).alias("s"), F.lit(fix).alias("f")))])
    out = out.withColumn("_k", table[F.col("code")])
    share = F.col("value").try_cast("double") / F.col("detail").try_cast("double")
    removable = (F.col("code") == "DESTRUCTIVE_BLANK_INCLUDED_COLUMN") & (share >= K.BLANK_REMOVAL_RATIO)
    out = out.withColumn("severity", F.col("_k.s")).withColumn("auto_fix", F.when(removable, F.lit("review")).otherwise(F.col("_k.f")))
    return out.select(*OUT)
