from pyspark.sql import functions as F

from gristmill.functions import claims as C
from gristmill.functions import prices as P
from gristmill.functions import text as TX
from gristmill.functions import urls as U


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr.alias("v")).collect()]


def test_blank_and_trim(spark):
    assert values(spark, [None, "", "  ﻿", "x"], TX.is_blank("t")) == [True, True, True, False]
    assert values(spark, ["  a b　"], TX.jstrim("t")) == ["a b"]


def test_slug(spark):
    got = values(spark, ["Crème Brûlée!", "Straße æther øl", "Ærø", "--", "Łódź łódź"], TX.slug("t"))
    assert got == ["creme-brulee", "strasse-aether-ol", "ro", "", "odz-lodz"]  # only the lower-case special letters are spelled out


def test_prices(spark):
    texts = ["19.99", "$19.99", "19,99", "1.234,50", "1,234", "1,234.56", "1,234,567", "€ 5", "call", "1e3", "", "$", "0x10", "-5"]
    assert values(spark, texts, P.price_value("t")) == [19.99, 19.99, 19.99, 1234.5, 1234.0, None, None, 5.0, None, 1000.0, None, 0.0, None, -5.0]
    assert values(spark, ["$$5", "5 $"], P.strip_currency("t")) == ["$5", "5"]


def test_titles_and_urls(spark):
    assert values(spark, ["Big news - The Outlet", "A-b - c"], TX.clean_title("t")) == ["Big news", "A-b - c"]
    got = values(spark, ["https://a.com/x?utm_source=1&b=2&ocid=3#f", "https://a.com/?utm_term=1", "no url?utm_term=1"], U.clean_url("t"))
    assert got == ["https://a.com/x?b=2#f", "https://a.com/", "no url?utm_term=1"]
    assert values(spark, ["https://WWW.News.co.uk/a", "nothing"], U.host_of("t")) == ["news.co.uk", ""]
    assert values(spark, ["https://agg/c?x=1&url=https%3A%2F%2Fp.com%2Fa"], U.wrapped_target("t")) == ["https://p.com/a"]


def test_sentences_and_meta(spark):
    t = "Mr. Lee paid 2.5% in the U.S. today. He left! Why"
    assert values(spark, [t], TX.sentences_safe("t")) == [["Mr. Lee paid 2.5% in the U.S. today. ", "He left! ", "Why"]]
    long = "First sentence that is rather long and goes on and on until it passes ninety characters, yes. " + "Tail " * 30
    assert values(spark, [long, "short"], TX.meta_fit("t")) == [long[: long.index(". ") + 1], "short"]


def test_numbers_names_phrases(spark):
    corpus = "sales grew 12.5 percent to 3 billion at nordbank"
    df = spark.createDataFrame([("Sales grew 12.5% to $3 billion, or 44 units and 7 more. Later Nordbank Group met Ana Brandt.", corpus)], "t string, c string")
    r = df.select(C.unsupported_numbers("t", "c").alias("n"), C.unsupported_names("t", "c").alias("m"), C.num_set("t").alias("s")).first()
    # a lone digit in the corpus is no number token, so "$3" has no support
    assert r.n == ["$3", "44"] and r.m == ["Ana Brandt"] and r.s == "12.5|3|44"
    got = values(spark, ["It is not only steel but coal. Overall, fine."], F.transform(C.stock_phrases("t"), lambda p: p["id"]))
    assert got == [["notbut", "closer"]]
    assert values(spark, ["The fraud was “a clear case of bribery” and Fraud"], C.risk_words("t")) == [["fraud"]]


def test_frames_posts_tags(spark):
    assert values(spark, ["One two three. Four five six. </think> leaked"], C.clean_frame("t", 3)) == ["One two three."]
    assert values(spark, ["rate hike news"], C.hashtags(F.array("t"), 3)) == [["#RateHikeNews"]]
    assert values(spark, ["a" * 260 + " {link}", "a" * 270 + "{link}"], C.post_length_ok(F.col("t"), F.lit("x"))) == [False, False]
    assert values(spark, ["a" * 250 + " {link}"], C.post_length_ok(F.col("t"), F.lit("x"))) == [True]
    assert values(spark, ["See $ 12 and Tota1 Ränla, Tota1s"], C.ocr_line_fix("t", {"Tota1": "Total", "Ränla": "Ränta"})) == ["See §12 and Total Ränta, Tota1s"]
