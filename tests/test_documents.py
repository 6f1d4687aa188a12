import random

from pyspark.sql import functions as F

from gristmill.functions import lines as L
from gristmill.operators import corpus as CO
from gristmill.operators import layout as LY
from gristmill.operators import verify as V
from gristmill.sources import feed_payloads as FP
from gristmill.sources import html_pages as H


def test_clean_document(spark):
    raw = "My Report 1\nline one con-\ntinues here\nsecond part\n\n\n\nPage 3 of 9\nMY REPORT  2\n- item a\n- item b\n12\nmy report 3\nEnd of it.​\n\n"
    r = CO.clean_document(spark.createDataFrame([(1, raw)], "doc_id int, text string")).first()
    assert r.clean_text == "line one continues here\nsecond part\n\n- item a\n- item b\nEnd of it."
    # short lines without a closing mark are headings, so they are not joined
    assert r.lines_removed == 5


def test_cross_document_lines(spark):
    docs = [(1, "ACME Weekly 1\nbody text one."), (2, "ACME weekly 2\nbody text two."), (3, "ACME Weekly 9\nACME Weekly 10")]
    got = CO.cross_doc_lines(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert {(r.doc_id, r.line_no) for r in got} == {(2, 0), (3, 0), (3, 1)}


def test_merges(spark):
    df = spark.createDataFrame([(1, "d", "A heading\npara one\npara two.\n\n- x\n- y & z")], "doc_id int, name string, text string")
    md = CO.merged(df, CO.markdown_block).first().block
    assert md == "# d\n\n## A heading\n\npara one para two.\n\n- x\n- y & z".replace("## A heading\n\npara one para two.", "## A heading\n\n## para one\n\npara two.")
    html = CO.merged(df, CO.html_block).first().block
    assert "<li>y &amp; z</li>" in html and html.startswith('<section data-document="d">\n<h1>d</h1>')


def test_page_parsing():
    body = "This sentence is long enough to count as a paragraph of the article. "
    page = f"<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><p>{body}</p></nav><article><p>{body * 3}<p>{body * 3}</article><article><p>{body}</p></article></body></html>"
    title, text, seen = H.parse_page(page)
    assert title == "T" and text == "\n".join([(body * 3).strip()] * 2) and "var a" not in seen
    assert H.parse_page("<p>short</p>")[1] is None
    ld = '<script type="application/ld+json">{"@graph":[{"articleBody":"' + "word " * 200 + '"}]}</script>'
    assert H.parse_page(f"<body>{ld}<article><p>{body * 5}</p></article></body>")[1].startswith("word word")
    assert len(H.parse_page("<p>" + "x" * 7000 + "</p>")[1]) == 6000


def test_long_articles_are_whole(spark):
    pages = spark.createDataFrame([(1, "<article><p>" + "x" * 7000 + "</p></article>")], "page_id long, html string")
    row = H.html_article_text(pages).first()
    assert len(row.article_text) == row.article_length == 7000
    assert H.read_pages(pages, text_max=6000).first().article_length == 6000


def test_feed_formats(spark):
    rss = "<rss><channel><item><title>A</title><link>https://a.com</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><title></title><link>https://b.com</link></item></channel></rss>"
    rdf = "<rdf:RDF xmlns:rdf='r' xmlns='http://purl.org/rss/1.0/' xmlns:dc='d'><item><title>B</title><link>https://b.com</link><dc:date>2024-01-02T03:04:05Z</dc:date></item></rdf:RDF>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>C</title><link rel='self' href='https://no'/><link href='https://c.com'/><summary>s</summary></entry></feed>"
    df = spark.createDataFrame([("r", rss), ("d", rdf), ("a", atom), ("x", "<rss><item>")], "feed string, body string")
    got = {r.feed: (r.title, r.link, str(r.pub_date)) for r in FP.feed_scan(df).collect()}
    assert got == {"r": ("A", "https://a.com", "2024-01-02 03:04:05"), "d": ("B", "https://b.com", "2024-01-02 03:04:05"), "a": ("C", "https://c.com", "None")}


def test_all_items_of_a_feed_are_read(spark):
    item = lambda i: f"<item><title>T{i}</title><link>https://a.com/{i}</link></item>"
    body = "<rss><channel>" + "".join(map(item, range(2500))) + "</channel></rss>"
    got = FP.feed_scan(spark.createDataFrame([("r", body)], "feed string, body string")).select("pos", "title").collect()
    assert sorted(map(tuple, got)) == [(i, f"T{i}") for i in range(2500)]


def test_json_and_breadcrumbs(spark):
    df = spark.createDataFrame([(1, 'x ```json\n{"a": 1, "b": "two\nlines",}\n```'), (2, "none"), (3, '{"a": 3}')], "i int, t string")
    got = {r.i: (r.parsed.a if r.parsed else None, r.repaired) for r in FP.json_repair_parse(df, "t", "a int, b string").collect()}
    assert got == {1: (1, True), 2: (None, False), 3: (3, False)}
    ld = '{"@graph": [{"@type": "BreadcrumbList"}, {"@type": "WebPage", "breadcrumb": {"a": 1}, "x": {"y": [{"@type": "BreadcrumbList"}]}}]}'
    out = spark.createDataFrame([(ld,)], "t string").select(FP.strip_breadcrumb_nodes("t")).first()[0]
    assert out == '{"@graph": [{"@type": "WebPage"}]}'


def test_quote_lookup_against_containment(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(60))) for i in range(20)]
    quotes = [(k, docs[k % 20][1][3 + k: 3 + k + 10 + 4 * k]) for k in range(12)]
    got = V.quote_lookup(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(docs, "story_id int, text string"))
    norm = lambda t: " ".join(t.split())
    want = {(k, i) for k, q in quotes for i, t in docs if norm(q) in norm(t) and len(norm(q).split()) >= 3}
    assert {(r.quote_id, r.story_id) for r in got.collect()} == want


def test_quote_lookup_finds_short_quotes_and_parts_of_words(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join("".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, 12)))) for i in range(40)] + [(90, None), (91, ""), (92, "x" * 5000 + " end")]
    quotes = [(k, (docs[k % 40][1])[k % 5: k % 5 + rnd.randint(1, 25)]) for k in range(80)] + [(200, None), (201, " , "), (202, "xxx end"), (203, "x"), (203, "x")]
    got = V.quote_lookup(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(docs, "story_id int, text string")).collect()
    norm = lambda t: " ".join((t or "").replace(",", " ").split())
    want = {(k, i) for k, q in quotes for i, t in docs if norm(q) and norm(q) in norm(t)}
    assert len(got) == len(want) and {(r.quote_id, r.story_id) for r in got} == want
    assert {len(norm(q).split()) for _, q in quotes} >= {0, 1, 2, 3, 4}


def test_layout(spark):
    def line(page, no, xs, texts):
        return [(page, t, float(x), float(x + 20), no * 12.0, no * 12.0 + 10) for x, t in zip(xs, texts)]
    w = (line(1, 0, [0, 25, 50], ["A", "short", "heading"]) + line(1, 1, [0, 22, 90, 160, 230], ["r1", "x", "b", "c", "d"])
         + line(1, 2, [0, 22, 90, 160, 230], ["r2", "y", "e", "f", "g"]) + line(1, 3, [0, 25], ["-", "item"]) + line(1, 4, [0, 25, 50, 75], ["this", "is", "plain", "text."]))
    df = spark.createDataFrame(w, "page_id int, text string, x0 double, x1 double, y0 double, y1 double")
    lines = LY.layout_lines(df, 3.0)
    assert lines.select("line_no").distinct().count() == 5
    cells = {(r.row_no, r.col_no): r.text for r in LY.layout_tables(lines).collect()}
    assert cells == {(0, 0): "r1 x", (0, 1): "b", (0, 2): "c", (0, 3): "d", (1, 0): "r2 y", (1, 1): "e", (1, 2): "f", (1, 3): "g"}
    kinds = [r.type for r in LY.layout_blocks(lines).orderBy("block_no").collect()]
    assert kinds == ["h", "table", "ul", "p"]
    a = {(r.text, r.line_no) for r in LY.layout_lines_by_gap(df, 3.0).collect()}
    assert a == {(r.text, r.line_no) for r in lines.collect()}


def test_layout_against_plain_loops(spark):
    import random

    rng = random.Random(7)
    words = []
    for page in range(12):
        y = 0.0
        for _ in range(rng.randrange(1, 14)):
            y += rng.choice([1.0, 2.5, 3.0, 12.0])  # lines that overlap, touch or stand apart
            x = 0.0
            for _ in range(rng.randrange(1, 30)):
                x += rng.choice([2.0, 3.0, 3.0, 30.0, 90.0])
                words.append((page, rng.choice(["Ab", "c.", "d e", " ", "42", None]), x, x + 8.0, y + rng.choice([0.0, 1.0, 2.0]), y + 10.0))
                x += 8.0
    words += words[:60]
    words += [(99, f"w{i}", float(i % 7), float(i), i * 0.4, i * 0.4) for i in range(3000)]  # no gap anywhere: the mean decides
    df = spark.createDataFrame(words, "page_id int, text string, x0 double, x1 double, y0 double, y1 double").repartition(5)
    order = lambda w: (w[0], (w[4] + w[5]) / 2, w[2], w[1] is not None, w[1] or "")
    page, lines = None, {}
    for w in sorted(words, key=order):
        c = (w[4] + w[5]) / 2
        if w[0] != page:
            page, no, mean, n = w[0], 0, c, 1
        elif abs(c - mean) <= 3.0:
            n += 1
            mean = (mean * (n - 1) + c) / n
        else:
            no, mean, n = no + 1, c, 1
        lines.setdefault((page, no), []).append(w)
    for v in lines.values():
        v.sort(key=lambda w: (w[2], w[1] is not None, w[1] or ""))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # lines and pages go on over many batches
    try:
        got = LY.layout_lines(df, 3.0).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.page_id, r.line_no, r.word_no, r.text or "", r.x0) for r in got) == sorted((*k, i, w[1] or "", w[2]) for k, v in lines.items() for i, w in enumerate(v))

    found = spark.createDataFrame(got).localCheckpoint()
    kept = lambda t: " ".join(" ".join(x for x in t if x is not None).split())
    cells, rows = {}, set()
    for k in lines:
        v = sorted((r for r in got if (r.page_id, r.line_no) == k), key=lambda r: r.word_no)
        gaps = [b.x0 - a.x1 for a, b in zip(v, v[1:])]
        up = sorted(g for g in gaps if g > 0)
        limit = min(50.0, max(8.0, up[0] * 2.5)) if up else 15.0
        cells[k] = [[v[0]]]
        for g, r in zip(gaps, v[1:]):
            cells[k].append([r]) if g > limit else cells[k][-1].append(r)
        if len(v) >= 4 and len(up) >= 3 and sum(g > min(50.0, max(8.0, up[0] * 2.5, up[0] + 6)) for g in up) >= 3:
            rows.add(k)
    assert {(r.page_id, r.line_no, r.cell_no, r.text, r.x0, r.x1) for r in LY.layout_cells(found).collect()} == {
        (*k, i, kept([r.text for r in c]), c[0].x0, c[-1].x1) for k, v in cells.items() for i, c in enumerate(v)}
    want = set()
    for p, a in rows:
        if (p, a - 1) in rows:
            continue
        z = a
        while (p, z + 1) in rows:
            z += 1
        edges = sorted(c[0].x0 for i in range(a, z + 1) for c in cells[p, i])
        runs = [[edges[0]]]
        for x, y in zip(edges, edges[1:]):
            runs.append([y]) if y - x > 25.0 else runs[-1].append(y)
        cols = [sum(r) / len(r) for r in runs]
        if z == a or len(cols) < 3:
            continue
        for i in range(a, z + 1):
            texts = {}
            for c in cells[p, i]:
                texts.setdefault(min(range(len(cols)), key=lambda j: (abs(c[0].x0 - cols[j]), j)), []).append(kept([r.text for r in c]))
            want |= {(p, a, z, i - a, j, " ".join(t)) for j, t in texts.items()}
    assert want and {tuple(r) for r in LY.layout_tables(found).collect()} == want
    blocks = LY.layout_blocks(found).collect()
    assert all(r.words == len(r.text.split()) for r in blocks)
    assert sum(r.type == "table" for r in blocks) == len({w[:3] for w in want})


def test_layout_looks_at_words_once(spark):
    """Tables and blocks read their lines once: no step of theirs is joined with, or fetched again for, another."""
    import contextlib
    import io

    df = spark.createDataFrame([(1, "a", 0.0, 1.0, 0.0, 1.0)], "page_id int, text string, x0 double, x1 double, y0 double, y1 double")
    for op in (LY.layout_tables, LY.layout_blocks):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            op(LY.layout_lines(df, 3.0)).explain()
        assert "Join" not in plan.getvalue() and plan.getvalue().count("MapInArrow") == 1


def test_split_sentences_and_paragraphs(spark):
    s = "The plant in the north made a good profit in the first half of the year, but the plant in the south lost a lot of money again."
    got = spark.createDataFrame([(1, s)], "i int, t string").transform(lambda d: V.easy_text(d, "i", "t")).first().t
    assert got == "The plant in the north made a good profit in the first half of the year. But the plant in the south lost a lot of money again."
    p = " ".join(["One two three four five six seven eight nine ten."] * 12)
    two = spark.createDataFrame([(p,)], "t string").select(V.split_paragraph(F.col("t"))).first()[0]
    assert [len(x.split()) for x in two] == [60, 60]


def test_lines_of_one_row_give_the_same_cells_and_shuffle_words_once(spark, capsys):
    rnd = random.Random(8)
    n = lambda top: None if rnd.random() < 0.02 else rnd.choice([float(rnd.randint(0, top)), rnd.random() * top, float("nan") if rnd.random() < 0.02 else 7.5])
    rows = []
    for _ in range(3000):
        x, y = n(400), rnd.choice([float(rnd.randint(0, 60)), rnd.random() * 60])
        rows.append((rnd.choice([None, 1, 2, 3, 4]), None if rnd.random() < 0.02 else rnd.choice(["a", "Bé", "", "long word", "1."]), x, None if x is None else x + 5, y, y + 4))
    df = spark.createDataFrame(rows, "page_id bigint, text string, x0 double, x1 double, y0 double, y1 double").repartition(5)
    for words in (df, df.withColumn("page_id", F.col("page_id").cast("string"))):
        by_word, by_line = LY.layout_lines(words, 3.0), LY.layout_lines(words, 3.0, by_line=True)
        for op in (LY.layout_cells, LY.layout_tables, LY.layout_blocks):
            want = op(by_word).collect()
            assert sorted(map(str, op(by_line).collect())) == sorted(map(str, want)) and want
    flat = df.filter("page_id IS NOT NULL").withColumn("page_id", F.col("page_id").cast("string"))
    capsys.readouterr()
    LY.layout_cells(LY.layout_lines(flat, 3.0, by_line=True)).explain()
    assert capsys.readouterr().out.count("hashpartitioning") == 1
