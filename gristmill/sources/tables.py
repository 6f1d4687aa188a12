"""Views that present the test tables as catalogs, stories, lines and so on.

Each view is a list of SQL expressions valid in both Spark SQL and ANSI engines, so the comparison query of a
registered operator can read exactly the same view. The views read whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_IMG = "(p_partkey % 11 = 5 OR p_partkey % 23 = 7)"
_BLOCK = "CAST(CAST(floor(p_partkey / 24) AS BIGINT) AS STRING)"
_FILE = "CAST(floor(p_partkey / 100) AS BIGINT)"
_NOUN = "split_part(p_name, ' ', 2)"
_NAME = f"{_NOUN} || ' ' || {_BLOCK}"
_BASE = "CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING)"


def _k(*cases: tuple[str, str], default: str = "''", image: str | None = "''") -> str:
    arms = [f"WHEN {_IMG} THEN {image}"] if image is not None else []
    arms += [f"WHEN p_partkey % {cond} THEN {value}" for cond, value in cases]
    return f"CASE {' '.join(arms)} ELSE {default} END"


# column -> expression over `part`; planted defects depend on the part key only
CATALOG = {
    "Handle": _k(("29 = 0", "''"), ("31 = 0", f"upper({_NOUN}) || ' ' || {_BLOCK}"), ("43 = 1", f"' ' || {_NOUN} || '-' || {_BLOCK}"),
                 default=f"{_NOUN} || '-' || {_BLOCK}", image=None),
    "Title": _k(("17 = 0", "NULL"), ("13 = 0", f"'  ' || {_NAME} || ' '"), ("19 = 0", f"{_NOUN} || '’s “best” ' || {_BLOCK}"),
                ("37 = 0", "p_name || ' ' || p_type"), default=_NAME),
    "Body (HTML)": _k(("14 = 1", "'<p>' || p_name || '<b>'"), ("14 = 2", "'<div><p>' || p_name || '</p></div>'"),
                      ("14 = 3", "'<SCRIPT src=\"x\"></SCRIPT><p>' || p_type || '</p>'"), ("14 = 4", "'<p>one<br>two</p>'"),
                      ("14 = 5", "'<p>' || p_type || '</div>'"), ("14 = 6", "'<p>' || p_name || ' – ' || p_type || '…</p>'"),
                      default="'<p>' || p_name || '</p>'"),
    "Vendor": _k(("47 = 0", "''"), default="p_brand", image="CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END"),
    "Product Category": _k(("9 = 0", "'Widgets'"), ("9 = 1", "'gid://shopify/TaxonomyCategory/aa-1'"), ("9 = 2", "'Home > ' || p_type"), ("9 = 3", "'ap-2-1'")),
    "Type": _k(("53 = 0", "p_type || ' '"), default="p_type"),
    "Tags": _k(("21 = 0", f"CASE WHEN {_FILE} % 2 = 1 THEN '' ELSE 'new, ' || p_type || ' ' END")),
    "Published": _k(("8 = 0", "'yes'"), ("8 = 1", "'maybe'"), ("8 = 2", "'FALSE'"), ("8 = 3", "' true'"), default="'TRUE'"),
    "Option1 Name": _k(("15 = 0", "''"), ("27 = 0", "'Colour'"), ("7 = 3", "' '"), default="'Size'"),
    "Option1 Value": _k(("16 = 0", "''"), ("7 = 3", "''"), default="CAST(p_size AS STRING)"),
    "Option2 Name": _k(("25 = 0", "'Finish'")),
    "Option2 Value": _k(("25 = 0", "p_type"), ("26 = 0", "p_type")),
    "Variant SKU": _k(("20 = 3", "''"), ("41 = 0", "' ' || p_brand || '-' || CAST(p_size AS STRING)"),
                      ("59 = 4", "p_brand"), ("61 = 4", "p_brand || '-2'"), default="p_brand || '-' || CAST(p_size AS STRING)"),
    "Variant Inventory Tracker": _k(("10 = 0", "''"), default="'internal'"),
    "Variant Inventory Qty": _k(("10 = 1", "''"), ("10 = 2", "'3.5'"), ("33 = 0", "'-4'"), ("34 = 0", "'many'"), ("35 = 0", "' 12 '"),
                                default="CAST(p_partkey % 100 AS STRING)"),
    "Variant Price": _k(("12 = 0", f"'$' || {_BASE} || '.50'"), ("12 = 1", f"{_BASE} || ',99'"), ("12 = 2", "'1.234,50'"), ("12 = 3", "'1,234.56'"),
                        ("12 = 4", "'call us'"), ("12 = 5", "'-5.00'"), ("12 = 6", "''"), ("12 = 7", f"'€ ' || {_BASE}"), ("12 = 8", "'1,234'"),
                        default=f"{_BASE} || '.10'"),
    "Variant Compare At Price": _k(("6 = 0", "''"), ("6 = 1", f"CAST(CAST(floor(p_retailprice) AS BIGINT) - 100 AS STRING) || '.00'"), ("6 = 2", "'0'"),
                                   default=f"CAST(CAST(floor(p_retailprice) AS BIGINT) + 100 AS STRING)"),
    "Image Src": _k(("18 = 0", "'http://img.example.com/a ' || CAST(p_partkey AS STRING) || '.jpg'"), ("18 = 1", "'https://localhost/x.png'"),
                    ("18 = 2", "'not a url'"), ("18 = 3", "'https://img.example.com/view'"), ("18 = 4", "'https://10.2.3.4/a.webp'"), ("18 = 5", "''"),
                    default="'https://img.example.com/' || CAST(p_partkey AS STRING) || '.jpg'",
                    image=f"CASE WHEN p_partkey % 3 = 0 THEN 'http://img.example.com/' || CAST(p_partkey AS STRING) || '.png' ELSE 'https://img.example.com/' || {_NOUN} || '.jpg' END"),
    "Status": _k(("24 = 0", "'Live'"), ("24 = 1", "' active '"), ("24 = 2", "'Draft'"), ("45 = 0", "''"), default="'active'"),
    "Cost per item": _k(("22 = 0", "'£12 '"), default="''"),
    "Legacy Code": "CAST(p_partkey % 7 AS STRING)",
}
FILE_ID = f"'file-' || CAST({_FILE} AS STRING)"
COPY_OFFSET = 1_000_000_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    # zone-less times are read in the session's zone, so that they can carry watermarks and be compared
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in plain}) if plain else df


def _as_rows(part: DataFrame, fields: dict[str, str], row_no: str) -> DataFrame:
    """One generated row per part. The generator keeps the planted-defect expressions in one place: without it
    the optimizer copies them into every filter that reads a column."""
    cells = [F.expr(FILE_ID).alias("file_id"), F.expr(f"CAST({row_no} AS BIGINT)").alias("row_no")]
    cells += [F.expr(e).alias(n) for n, e in fields.items()]
    return part.select(F.inline(F.array(F.struct(*cells))))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog with planted defects; every fiftieth row is repeated at the end of its file. Reads the parts once."""
    places = F.expr(f"CASE WHEN p_partkey % 50 = 10 THEN array(p_partkey + 2, p_partkey + {COPY_OFFSET}) ELSE array(p_partkey + 2) END")
    return _as_rows(table(spark, sf, "part").withColumn("_place", F.explode(places)), CATALOG, "_place")


UPDATE = {
    **{n: e for n, e in CATALOG.items() if n != "Legacy Code"},
    "Handle": f"CASE WHEN p_partkey % 5 = 0 THEN ' ' || upper({_NOUN}) || '-' || {_BLOCK} || ' ' "
              f"WHEN p_partkey % 13 = 0 THEN 'new-' || CAST(p_partkey AS STRING) ELSE {_NOUN} || '-' || {_BLOCK} END",
    "Variant Price": f"CASE WHEN p_partkey % 7 = 0 THEN '12.00' ELSE ({CATALOG['Variant Price']}) END",
    "Vendor": f"CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE ({CATALOG['Vendor']}) END",
    "SEO Title": "p_name",
}


def catalog_update(spark: SparkSession, sf: str) -> DataFrame:
    return _as_rows(table(spark, sf, "part"), UPDATE, "p_partkey + 2")


def _ansi(fields: dict[str, str], row_no: str) -> str:
    return ", ".join([f"{FILE_ID} AS file_id", f"CAST({row_no} AS BIGINT) AS row_no"] + [f'{e} AS "{n}"' for n, e in fields.items()])


SQL_CATALOG = (
    f"SELECT {_ansi(CATALOG, 'p_partkey + 2')} FROM part UNION ALL "
    f"SELECT {_ansi(CATALOG, f'p_partkey + {COPY_OFFSET}')} FROM part WHERE p_partkey % 50 = 10"
)
SQL_UPDATE = f"SELECT {_ansi(UPDATE, 'p_partkey + 2')} FROM part"

# ---- stories ------------------------------------------------------------------------------------------------
AS_OF = "2024-01-10 00:00:00"
# column -> expression over documents joined with pages; {F} is the whole text with single spaces, {T} its first sentence
STORY = {
    "story_id": "doc_id",
    "title": "CASE WHEN doc_id % 4 = 1 THEN {T} || ' - Outlet ' || source ELSE {T} END",
    "summary": "trim(substring({F}, length({T}) + 1))",
    "source": "source",
    "readable": "CASE doc_id % 7 WHEN 0 THEN 'paywalled' WHEN 1 THEN 'metered' WHEN 2 THEN 'thin' ELSE 'open' END",
    "redirect": "doc_id % 13 = 0",
    "lane": "CASE WHEN doc_id % 6 = 0 THEN 'breaking' WHEN doc_id % 3 = 1 THEN 'search' ELSE 'publisher' END",
    "url": "coalesce(url, 'https://' || source || '.example.org/' || CASE WHEN doc_id % 17 = 0 THEN 'video/' ELSE 'story/' END || CAST(doc_id AS STRING) "
           "|| CASE WHEN doc_id % 5 = 0 THEN '?utm_source=x&id=' || CAST(doc_id AS STRING) || '&ocid=1#top' ELSE '' END)",
}


_FIRST = "regexp_extract({F}, '^[^.!?]*[.!?]*', 0)"


def _of_story(expression: str, flat: str, first: str) -> str:
    return expression.replace("{T}", first).replace("{F}", flat)


def first_sentence(text: str) -> Column:
    """The first sentence of the text with single spaces. It is cut first, so that space is collapsed in it alone."""
    return F.trim(F.regexp_replace(F.expr(_of_story(_FIRST, text, "")), "[ \\n\\r\\t]+", " "))


def stories(spark: SparkSession, sf: str) -> DataFrame:
    """News stories from documents; the address comes from pages where the ids meet."""
    d, p = table(spark, sf, "documents"), table(spark, sf, "pages").select("page_id", "url")
    flat = F.trim(F.regexp_replace("text", "[ \\n\\r\\t]+", " "))
    j = d.withColumn("_flat", flat).withColumn("_first", first_sentence("text")).join(p, d.doc_id == p.page_id, "left")
    minutes = F.col("doc_id") * 7919 % 10000
    published = (F.unix_seconds(F.to_timestamp(F.lit(AS_OF))) - minutes * 60).cast("timestamp")
    return j.withColumn("_pub", published).selectExpr(*[f"{_of_story(e, '_flat', '_first')} AS {n}" for n, e in STORY.items()], "_pub AS published_at")


_SQL_FLAT = "trim(regexp_replace(text, '[ \\n\\r\\t]+', ' ', 'g'))"
SQL_STORIES = "SELECT " + ", ".join(f"{_of_story(e, _SQL_FLAT, _of_story(_FIRST, _SQL_FLAT, ''))} AS {n}" for n, e in STORY.items()) + (
    f", TIMESTAMP '{AS_OF}' - to_minutes(CAST(doc_id * 7919 % 10000 AS BIGINT)) AS published_at FROM documents LEFT JOIN pages ON doc_id = page_id")


def chats(spark: SparkSession, sf: str) -> DataFrame:
    """One document per conversation. Turns of one conversation are few, so they fit one row."""
    c = table(spark, sf, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("text")).select(
        "doc_id", F.concat(F.lit("chat-"), F.col("doc_id").cast("string")).alias("name"), "text")
