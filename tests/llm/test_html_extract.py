import random
import time
from itertools import accumulate

from pyspark.sql import functions as F

from gristmill.llm import html_extract as H

W = H.weights_of({})
BODY = "<p>One two three four five six seven.</p><p>Eight &amp; nine&nbsp;ten \n eleven <b>twel<i>ve</i></b> thirteen &eacute;.</p>"
TEXT = "One two three four five six seven.\nEight & nine ten eleven twelve thirteen é."


def page(inner):
    return f"<!DOCTYPE html><html><head><title>T t t t</title><style>p{{}}</style><script>var a='</p><article>';</script></head><body>{inner}</body></html>"


def test_templates():
    nav = "<nav><ul><li><a href=/>Home of all</a></li></ul></nav><header><h2>Site name here</h2></header>"
    foot = "<footer>All rights reserved by the owner of this very long footer text and many more words</footer>"
    aside = '<aside><p>Side words side words side words</p></aside><div class="sidebar right">More side words here</div><div id="cookie-notice"><p>We use cookies ok</p></div>'
    comments = '<section class="comments"><h3>3 comments</h3><article class="comment"><p>Great text I liked this one</p></article></section>'
    form = "<form><label>Mail</label><input name=a><button>Send it now</button></form>"
    for around in ("<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>", "<div>{}</div>", "<article><header></header>{}" + comments + "</article>", "<div role=main>{}</div>"):
        assert H.main_text(page(nav + aside + around.format(BODY) + comments + form + foot), W) == TEXT
    assert H.main_text(page(f"<article><h1>Head line</h1>{BODY}</article>"), W) == "Head line\n" + TEXT
    assert H.main_text(page(f'<div class="page has-sidebar"><article>{BODY}</article></div>'), W) == TEXT
    assert H.main_text(page(f"<article><p>a<br>b<p class=ad>buy buy<p>c <!-- x --> d</article>"), W) == "a\nb\nc d"
    links = "<ul>" + "".join(f"<li><a href='/{i}'>Go there {i}</a></li>" for i in range(30)) + "</ul>"
    assert H.main_text(page(links + f"<div>{BODY}</div>" + links), W) == TEXT


def test_names_of_topics_stay_in_the_article():
    for part, text in (('<h2 id="related-work">Related work of others</h2>', "Related work of others"), ('<h2 id="search-results">Search results here</h2>', "Search results here"),
                       ('<p id="copyright-law">The law says so</p>', "The law says so"), ('<section id="popular-culture"><p>Songs name it</p></section>', "Songs name it"),
                       ('<div class="share-of-market"><p>A third of it</p></div>', "A third of it"), ('<p class="alert">Mind the gap</p>', "Mind the gap"),
                       ("<p><label>Note that</label> it holds</p>", "Note that it holds"), ("<object><p>Instead of a film</p></object>", "Instead of a film")):
        assert H.main_text(page(f"<article><h1>Head line</h1>{BODY}{part}</article>"), W) == f"Head line\n{TEXT}\n{text}"
    for part in ('<div class="share-buttons">Send this to all</div>', '<section id="comments"><p>I liked this one</p></section>', '<div class="widget related-posts">More of this kind</div>',
                 '<ul class="social">Here and there</ul>', '<div class="newsletter-signup"><p>Get our mail each day</p></div>', '<p class="ad">Buy this now</p>',
                 '<form><label>Mail</label><fieldset>Your name here</fieldset></form>', '<div role="navigation">Next page of all</div>'):
        assert H.main_text(page(f"<article><h1>Head line</h1>{BODY}{part}</article>"), W) == f"Head line\n{TEXT}"


def test_lists_between_paragraphs_of_one_section():
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(6))
    want = TEXT + "\n" + "\n".join(f"Link {i}" for i in range(6)) + "\nLast of all the words here."
    inner = f"{BODY}<ul>{links}</ul><p>Last of all the words here.</p>"
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Go there {i}</a></li>" for i in range(30)) + "</ul>"
    assert H.main_text(page(f"<div>{inner}</div>"), W) == want
    assert H.main_text(page(f"{menu}<div class=x>{inner}</div>{menu}<div><p>Small words</p></div>"), W) == want


def test_many_marked_elements_take_linear_time():
    start = time.perf_counter()
    H.main_text(page("<div class=sidebar><article>a</article></div>" * 20_000), W)
    assert time.perf_counter() - start < 8


def test_forms_around_the_page_and_hidden_menus():
    controls = "<input name=v value=x><label>Find words here</label><button>Go there now</button><select><option>One of many</option></select>"
    for wrapper in ("form id=aspnetForm", "object", "fieldset class=search"):
        tag = wrapper.split()[0]
        for inner in (f"<article>{BODY}</article>", f"<main>{BODY}</main>"):
            assert H.main_text(page(f"<{wrapper}>{controls}{inner}{controls}</{tag}>"), W) == TEXT
        assert H.main_text(page(f"<{wrapper}><h1>Head line</h1><div>{BODY}</div>{controls}</{tag}>"), W) == "Head line\n" + TEXT
    assert H.main_text(page(f"<form action=/>{controls}<div>{BODY}</div></form>"), W) == TEXT
    menu = '<nav class="visually-hidden">Menu words menu words menu words</nav>'
    foot = '<footer class="hidden-print">Footer words footer words footer words</footer>'
    form = "<form class=hidden-print><p>Write to us with some words</p></form>"
    assert H.main_text(page(f"<div>{menu}{BODY}{form}{foot}</div>"), W) == TEXT


def test_odd_input():
    assert [H.main_text(x, W) for x in (None, "", "<p></p>", "<", "<!-- never closed", "<script>x")] == ["", "", "", "<", "", ""]
    assert H.main_text("plain &lt;text&gt; &#233; &#x1F600;", W) == "plain <text> é \U0001f600"
    assert H.main_text('<p title="unclosed>word word<p>next', W).endswith("next")
    assert len(H.main_text("<p>" + "word " * 300_000, W)) == 5 * 300_000 - 1
    assert H.main_text("<div " * 20_000 + '<p a="' * 20_000, W) == ""


def test_region_equals_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        s = [rng.randint(-4, 4) for _ in range(rng.randint(0, 14))]
        sums = [0, *accumulate(s)]
        top = max((sums[j] - sums[i] for i in range(len(sums)) for j in range(i, len(sums))), default=0)
        lo, hi = H.best_region(s)
        assert sum(s[lo:hi]) == top and (lo < hi) == (top > 0)


def test_tables(spark):
    rows = [(i, f"u{i}", page(f"<nav><a>menu {i}</a></nav><article>{BODY}</article>")) for i in range(60)] + [(None, None, None), (1, "u1", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("token", F.lit(1))
    weights = H.fit(pages)
    assert weights["a"] < weights["p"] < 0 < weights["word"]
    got = H.extract(pages, weights).collect()
    assert len(got) == 62 and sum(r.text == TEXT for r in got) == 60 and sum(r.text == "" for r in got) == 2
    assert H.extract(pages.limit(0), H.fit(pages.limit(0))).count() == 0


def test_whole_pages_give_their_documents(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = [r.text for r in H.extract(pages, H.fit(pages)).collect()]
    assert len(got) == 250 and all("<" not in t and t for t in got)
