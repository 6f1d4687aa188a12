import random

from pyspark.sql import functions as F

from gristmill.operators import catalog_compare as CC
from gristmill.operators import catalog_repair as CR
from gristmill.operators import catalog_report as RP
from gristmill.operators import catalog_rows as R
from gristmill.operators import catalog_rules as CK
from gristmill.operators import catalog_split as SP
from gristmill.operators.ordered import previous_value, running_count, value_changes
from gristmill.sources import csv_files as CS

COLS = ["Handle", "Title", "Body (HTML)", "Vendor", "Published", "Option1 Name", "Option1 Value", "Variant SKU", "Variant Price",
        "Variant Compare At Price", "Variant Inventory Tracker", "Variant Inventory Qty", "Image Src", "Status"]
ROWS = [
    ("lamp", "Lamp", "<p>ok</p>", "Ann", "TRUE", "Size", "S", "L-1", "10", "12", "t", "4", "https://c.com/a.jpg", "active"),       # 2 clean
    ("lamp", "Lamp", "", "Ann", "", "Size", "M", "L-2", "11", "", "t", "4", "", "active"),                                          # 3 variant
    ("lamp", "", "", "", "", "", "", "", "", "", "", "", "https://c.com/b.jpg", ""),                                                # 4 image row
    ("lamp", "", "", "", "", "", "", "", "", "", "", "", "https://c.com/b.jpg", ""),                                                # 5 repeats image row 4
    ("Chair X", " Chair ", "<p><b>x</p>", "Bob", "maybe", "Size", "S", "C-1", "19,99", "5", "", "3.5", "http://c.com/c.jpg", "Live"),  # 6
    ("", "No handle", "<br>", "Bob", "yes", "", "", "L-1", "$5", "", "t", "", "not a url", "draft"),                                # 7
    ("desk", "", "<script>1</script>", "Bob", "no", "Size", "", "D-1", "call", "", "t", "-2", "https://localhost/a.png", ""),      # 8
    ("lamp", "Other lamp", "", "Ann", "", "Size", "S", "L-1", "10", "", "t", "1", "", "active"),                                    # 9 comes back
    ("lamp", "Other lamp", "", "Ann", "", "Size", "S", "L-1", "10", "", "t", "1", "", "active"),                                    # 10 identical to 9
    ("rug", "“Rug”", "", "Eve", "", "", "", "R-1", "7", "", "", "", "https://c.com/r", "active"),                                   # 11
    ("rug", "", "", "Eve", "", "", "", "", "", "", "", "", "https://c.com/r2.png", ""),                                             # 12 image row with vendor
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([("f", i + 2, *r) for i, r in enumerate(rows)], "file_id string, row_no bigint, " + ", ".join(f"`{c}` string" for c in COLS))


def hits(spark, **kw):
    out = {}
    for r in CK.findings(frame(spark), **kw).collect():
        out.setdefault(r.code, set()).add(r.row_no)
    return out


def test_findings_of_the_fixture(spark):
    h = hits(spark)
    assert h["DUPLICATE_IMAGE_ROWS"] == {5}
    assert h["HANDLE_FORMAT_INVALID"] == {6} and h["CELL_WHITESPACE"] == {6} and h["PRICE_DECIMAL_COMMA"] == {6}
    assert h["BOOLEAN_FORMAT"] == {6}  # yes and no are accepted spellings
    assert h["HTML_UNCLOSED_TAG"] == {6, 7}  # a void tag counts as open
    assert h["COMPARE_AT_PRICE_LOWER_THAN_PRICE"] == {6}
    assert h["INVENTORY_NON_INTEGER"] == {6} and h["INVENTORY_TRACKER_MISSING"] == {6} and h["INVENTORY_NEGATIVE"] == {8}
    assert h["HANDLE_MISSING_UPDATE"] == {7} and h["IMAGE_URL_MALFORMED"] == {7} and h["INVENTORY_QTY_MISSING_WITH_TRACKER"] == {7}
    assert h["TITLE_MISSING"] == {8} and h["PRICE_NON_NUMERIC"] == {8} and h["VARIANT_PARTIAL_COLLAPSE"] == {8}
    assert h["IMAGE_URL_PRIVATE_CDN"] == {8} and h["HTML_DANGEROUS_ATTRIBUTE"] == {8}
    assert h["HANDLE_DUPLICATE_IN_FILE"] == {2} and h["SKU_DUPLICATE_IN_FILE"] == {2} and h["ROW_ORDER_WARNING"] == {9}
    assert h["DUPLICATE_IDENTICAL_ROWS"] == {5, 10} and h["VARIANT_DUPLICATE_OPTION_COMBINATION"] == {2}
    assert h["SMART_QUOTES_DETECTED"] == {11} and h["IMAGE_URL_NO_EXTENSION"] == {11}
    assert h["IMAGE_ROW_VARIANT_DATA"] == {12} and h["SINGLE_VARIANT_MULTIPLE_IMAGES"] == {11}
    assert h["STATUS_INVALID_VALUE"] == {6} and h["PRICE_CURRENCY_SYMBOL"] == {7} and h["IMAGE_URL_NOT_HTTPS"] == {6}
    assert "HANDLE_MISSING_NEW" not in h and hits(spark, mode="new_products")["HANDLE_MISSING_NEW"] == {7}


def test_classes_and_verdict(spark):
    k = {r.row_no: (r.is_image, r.is_primary, r.is_variant) for r in R.classify_rows(frame(spark)).collect()}
    assert k[2] == (False, True, True) and k[3] == (False, False, True) and k[4] == (True, False, False) and k[7] == (False, False, False)
    s = RP.severity_summary(CK.findings(frame(spark)), frame(spark)).first()
    assert s.status == "NOT_READY" and s.critical > 0


def test_repair_then_check_leaves_no_automatic_finding(spark):
    fixed = CR.corrected(CR.repair(frame(spark), approved=list(CR.REVIEWED)))
    left = {r.code for r in CK.findings(fixed).select("code").distinct().collect()}
    assert not left & {"SMART_QUOTES_DETECTED", "CELL_WHITESPACE", "PRICE_CURRENCY_SYMBOL", "HANDLE_FORMAT_INVALID", "DUPLICATE_IMAGE_ROWS",
                       "IMAGE_URL_NOT_HTTPS", "PRICE_DECIMAL_COMMA", "DUPLICATE_IDENTICAL_ROWS", "INVENTORY_QTY_MISSING_WITH_TRACKER"}
    again = CR.changes(CR.repair(fixed)).count()
    assert again == 0
    rows = {r.row_no: r for r in fixed.collect()}
    assert set(rows) == {2, 3, 4, 6, 7, 8, 9, 10, 11, 12}  # 10 got its own SKU before identical rows are dropped
    assert rows[6]["Variant Price"] == "19.99" and rows[6]["Handle"] == "chair-x" and rows[7]["Handle"] == "no-handle"
    assert rows[12]["Vendor"] == "" and rows[11]["Option1 Value"] == "Default Title"
    assert [rows[i]["Variant SKU"] for i in (2, 7, 9, 10)] == ["L-1", "L-1-2", "L-1-3", "L-1-4"]


def greedy_names(skus):
    taken, out = set(), []
    for s in skus:
        n, name = 2, s
        while name in taken:
            name, n = f"{s}-{n}", n + 1
        taken.add(name)
        out.append(name)
    return out


def test_unique_sku_against_row_by_row(spark):
    rnd = random.Random(3)
    skus = [rnd.choice(["A", "A-2", "A-2-2", "A-3", "B", "B-7", "C"]) for _ in range(60)]
    df = spark.createDataFrame([("f", i + 2, s) for i, s in enumerate(skus)], "file_id string, row_no bigint, `Variant SKU` string")
    got = [r.new_sku for r in CR.unique_sku_suffix(df).orderBy("row_no").collect()]
    assert got == greedy_names(skus)


def test_chunked_order_helpers(spark):
    df = spark.createDataFrame([("f", i, f"v{i % 7}") for i in range(0, 500, 3)], "p string, o bigint, v string")
    a = previous_value(df, ["p"], "o", "v", "prev", chunk=10).orderBy("o").collect()
    assert [r.prev for r in a] == [None] + [r.v for r in a[:-1]]
    b = running_count(df, ["p"], "o", "n", chunk=10).orderBy("o").collect()
    assert [r.n for r in b] == list(range(1, len(b) + 1))


def test_split_keeps_products_whole(spark):
    rnd = random.Random(5)
    rows = [("f", i + 2, rnd.choice(["a", "b", "c", "d", ""]), "x" * rnd.randint(1, 80)) for i in range(120)]
    df = spark.createDataFrame(rows, "file_id string, row_no bigint, Handle string, Title string")
    parts = SP.split_by_bytes(df, 900).collect()
    assert len(parts) == len(rows)
    by = {}
    for r in parts:
        if r.Handle:
            by.setdefault(r.Handle, set()).add(r.part)
    assert all(len(p) == 1 for p in by.values()) and max(r.part for r in parts) > 1
    assert {r.part for r in SP.split_by_bytes(df, 10**6).collect()} == {None}


def test_compare(spark):
    store = spark.createDataFrame([("f", 2, "A ", "t", "1", "v"), ("f", 3, "a", "later", "9", "v"), ("f", 4, "gone", "t", "1", "v")], "file_id string, row_no bigint, Handle string, Title string, `Variant Price` string, Vendor string")
    upd = spark.createDataFrame([("u", 2, "a", "t ", "2", " "), ("u", 3, "new", "n", "1", "v")], "file_id string, row_no bigint, Handle string, Title string, `Variant Price` string, Vendor string")
    got = {(r.handle, r.change, r.field, r.is_blank_overwrite) for r in CC.catalog_compare(store, upd).collect()}
    assert got == {("a", "CHANGE", "Handle", False), ("a", "CHANGE", "Variant Price", False), ("a", "CHANGE", "Vendor", True), ("new", "NEW", "", False)}
    assert [r.handle for r in CC.compare_new_products(store, upd).collect()] == ["new"]


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfHandle,Title\na,\"x, \"\"y\"\"\nz\"\n\nb,c\n")
    (tmp_path / "b.csv").write_bytes("Handle;Title;Odd\né;t;1\nq;w\n".encode("latin-1"))
    files = CS.binary_files(spark, str(tmp_path))
    p = {r.file_id[-5:]: (r.encoding, r.has_bom, r.delimiter) for r in CS.csv_probe(files).collect()}
    assert p == {"a.csv": ("UTF-8", True, ","), "b.csv": ("ISO-8859-1", False, ";")}
    assert {r.file_id[-5:]: r.misfit_rows for r in CS.csv_misfit_rows(files).collect()} == {"a.csv": 0, "b.csv": 1}
    rows = CS.csv_batch_scan(files, ["Handle", "Title"]).orderBy("file_id", "row_no").collect()
    assert [(r.row_no, r.Handle, r.Title) for r in rows] == [(2, "a", 'x, "y"\nz'), (3, "b", "c"), (2, "é", "t"), (3, "q", "w")]
    assert rows[2].extra == {"Odd": "1"}
    one = CS.csv_scan(spark, [str(tmp_path / "a.csv")], ["Handle", "Title"]).orderBy("row_no").collect()
    assert [(r.row_no, r.Handle) for r in one] == [(2, "a"), (3, "b")]
    (tmp_path / "blank.csv").write_bytes(b"Handle,Title\na,1\n,\nb,2\nc,3\n")
    kept = CS.csv_scan(spark, [str(tmp_path / "blank.csv")], ["Handle", "Title"]).orderBy("row_no").collect()
    assert [(r.row_no, r.Handle) for r in kept] == [(2, "a"), (3, "b"), (4, "c")]


def test_a_rule_of_the_user_is_found_repaired_and_logged(spark):
    rows = [("f", 2, "lamp", "Ann Ltd."), ("f", 3, "desk", "Bob"), ("g", 2, "rug", "Eve Ltd.")]
    df = spark.createDataFrame(rows, "file_id string, row_no bigint, Handle string, Vendor string")
    company = F.col("Vendor").endswith(" Ltd.")

    def detect(x):
        return x.df.filter(company).select(
            "file_id", "row_no", F.col("Handle").alias("handle"), F.lit("VENDOR_COMPANY").alias("code"), F.lit("").alias("scope"), F.lit("Vendor").alias("column_name"),
            F.col("Vendor").alias("value"), F.lit(None).cast("string").alias("detail"))

    def mend(state):
        return CR.rewrite(state, "VENDOR_COMPANY", "Removed company form", {"Vendor": (company, F.regexp_replace("Vendor", " Ltd\\.$", ""))})

    for kind, approved in (("auto", ()), ("review", ("VENDOR_COMPANY",))):
        rule = CK.Rule("VENDOR_COMPANY", "warning", kind, detect, "Vendors are names", mend)
        found = CK.findings(df, codes=[], extra_rules=[rule])
        assert {(r.file_id, r.row_no, r.severity, r.auto_fix) for r in found.collect()} == {("f", 2, "warning", kind), ("g", 2, "warning", kind)}
        mended = CR.repair(df, list(approved), automatic=kind == "auto", extra_rules=[rule])
        log = {(r.file_id, r.row_no, r.column_name, r.before, r.after, r.reason) for r in CR.changes(mended).filter("code = 'VENDOR_COMPANY'").collect()}
        assert log == {("f", 2, "Vendor", "Ann Ltd.", "Ann", "Removed company form"), ("g", 2, "Vendor", "Eve Ltd.", "Eve", "Removed company form")}
        assert sorted(r.Vendor for r in CR.corrected(mended).collect()) == ["Ann", "Bob", "Eve"]
    rule = CK.Rule("VENDOR_COMPANY", "warning", "review", detect, repair=mend)
    assert CR.changes(CR.repair(df, (), automatic=False, extra_rules=[rule])).count() == 0


def random_rows(rnd, n):
    pick = lambda *v: rnd.choice(v)
    out = []
    for _ in range(n):
        row = (pick("a", "b", "c", "", " ", None, "A b"), pick("", "", "T", "U", None, " T "), pick("", "<p>x</p>", "<b>"), pick("", "Ann"), pick("TRUE", "maybe", ""), pick("Size", "", "Colour"),
               pick("S", "M", "", None), pick("1", "2", " 2", "", "", None), pick("5", "$5", "", "x", ""), pick("", "4", "9"), pick("", "t"), pick("", "3", "-1"), pick("", "https://x.com/a.png", "https://x.com/b.png "), pick("active", "Live", ""))
        out.append(row)
        if rnd.random() < 0.2:
            out.append(rnd.choice(out))
        if rnd.random() < 0.1:
            out.append(("",) * len(COLS))
    return out


def test_joint_rules_equal_the_rules_one_by_one(spark):
    rnd = random.Random(11)
    df = frame(spark, ROWS + random_rows(rnd, 120)).unionByName(frame(spark, random_rows(rnd, 60)).withColumn("file_id", F.lit("g")))
    groups = [CK.ROW_CODES, CK.HANDLE_CODES, *[[c] for c in CK.KEYED_CODES.values()]]
    df.cache()
    joint = sorted(repr(tuple(r)) for r in CK.findings(df, codes=sum(groups, [])).collect())
    single = sorted(repr(tuple(r)) for g in groups for r in CK.findings(df, codes=list(g)).collect())
    assert joint == single and len(joint) > 300
    assert set(CK.KEYED_CODES.values()) | set(CK.HANDLE_CODES) <= {eval(r)[1] for r in joint}
    df.unpersist()


def test_joint_rules_read_whole_rows_twice(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "t"))
    plan = lambda codes: CK.findings(spark.read.parquet(str(tmp_path / "t")), codes=codes)._jdf.queryExecution().executedPlan().toString()
    few = plan(["PRICE_NEGATIVE", "SKU_DUPLICATE_IN_FILE"])
    every = plan(CK.ROW_CODES + CK.HANDLE_CODES + list(CK.KEYED_CODES.values()))
    assert few.count("FileScan") == 2 and every.count("FileScan") == 3  # the third reads the handles for row order


def test_joint_rules_on_an_empty_table_and_a_narrow_one(spark):
    assert CK.findings(frame(spark).limit(0)).count() == 0
    narrow = frame(spark).select("file_id", "row_no", "Handle", "Title")
    assert {r.code for r in CK.findings(narrow, codes=["TITLE_MISSING", "ROW_ORDER_WARNING", "DUPLICATE_IDENTICAL_ROWS", "SKU_DUPLICATE_IN_FILE"]).collect()} == {
        "TITLE_MISSING", "ROW_ORDER_WARNING", "DUPLICATE_IDENTICAL_ROWS"}


def test_value_changes_over_chunks(spark):
    rnd = random.Random(2)
    rows = [(p, o, rnd.choice("xyz")) for p in "pq" for o in sorted(rnd.sample(range(400), 90))]
    want = [(p, o, v, before) for (p, o, v), (q, _, w) in zip(rows, [(None, None, None), *rows]) for before in [w if p == q else None] if v != before]
    df = spark.createDataFrame(rows, "p string, o bigint, v string")
    for chunk in (1, 2, 10, 1000):
        got = [tuple(r) for r in value_changes(df, ["p"], "o", "v", "before", chunk=chunk).select("p", "o", "v", "before").orderBy("p", "o").collect()]
        assert got == want, chunk
