"""The regression on urls that its table does not hold, against plain scoring, on a very long url and awkward tables."""

import time

from pyspark.sql import functions as F

from tidewater.llm import urls

UNWANTED = (
    "https://buy-viagra-now.shop/ http://xxx-cams.tv/live https://online-casino-777.com/ https://mega-slots.win/ https://cheap-meds-online.net/ http://freepornvideos.example/ https://sexdating.info/x "
    "https://best-payday-loan.co/ https://crypto-giveaway.top/ http://ad-server.example/banner https://spamdomain.biz/ https://hot-escorts.ru/ https://betting-tips.com/ https://lotterywinner.xyz/"
).split()
ORDINARY = (
    "https://en.wikipedia.org/wiki/River https://docs.python.org/3/library/ https://www.bbc.co.uk/news/uk https://arxiv.org/abs/2101 https://github.com/apache/spark https://www.nytimes.com/2021/05/a.html "
    "https://stackoverflow.com/questions/1 https://nasa.gov/ https://www.mit.edu/research https://lemonde.fr/ https://heise.de/news/ https://my-travel-blog.net/ https://gutenberg.org/ebooks/11 https://imdb.com/title "
    "https://openstreetmap.org/ https://plos.org/articles/x https://www.zeit.de/ https://elpais.com/ https://weatherunderground.com/ https://craigslist.org/"
).split()


def plain(url):
    bias, weights = urls.fitted()
    return bias + sum(weights[g] for g in urls.grams(*urls.split_url(url)))


def test_most_unseen_urls_are_told_apart():
    table = {urls.split_url(u)[0] for u, _ in urls.LABELLED}
    assert not table & {urls.split_url(u)[0] for u in UNWANTED + ORDINARY}
    right = sum(plain(u) > 0 for u in UNWANTED) + sum(plain(u) <= 0 for u in ORDINARY)
    assert right >= 0.8 * len(UNWANTED + ORDINARY)


def test_no_host_of_the_given_pages_is_in_the_table(spark):
    host, _ = urls.host_and_path(F.col("url"))
    hosts = {r["host"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select(host.alias("host")).distinct().collect()}
    names = {part for h in hosts for part in h.split(".")[:-2]} - {"www", "blog", "m"}
    assert not names & {part for u, _ in urls.LABELLED for part in urls.split_url(u)[0].split(".")[:-1]}


def test_scores_equal_plain_scoring_also_of_a_long_url(spark):
    rows = [(i, u) for i, u in enumerate([*UNWANTED, *ORDINARY, None, "no scheme", "http://", "http://é漢.org/ü?x", "x://a"])] + [(99, "http://" + "ab" * 50_000 + ".com/" + "é" * 50_000)] + [(1, UNWANTED[1])]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("_rule", F.lit("clash"))
    began = time.time()
    out = urls.judge(frame, rules=(("block", "nowhere.example", "/"),)).select("url", "score", "verdict").collect()
    assert time.time() - began < 60 and len(out) == len(rows)
    assert all(r["score"] == plain(r["url"]) and r["verdict"] == ("block" if r["score"] > 0 else "allow") for r in out)
    assert urls.judge(frame.limit(0)).count() == 0
