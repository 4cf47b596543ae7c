"""The vote of each host and what is extracted by it, against a plain count; pages built to be slow; awkward tables."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewater.llm import html

WORDS = "one two three four five six seven eight nine ten "
PAGES = "page_id long, url string, html string"


def page(article, around="div", extra=""):
    return f"<html><body><div class='top menu'><a href='/'>home</a></div><{around} class='text-{len(article)}'><h1>T</h1><p>{article}</p></{around}>{extra}</body></html>"


def made():
    rows = []
    for k in range(40):
        host, tag = (("a.example", "section"), ("b.example", "div"), ("c.example", "td"))[k % 3]
        rows.append((k, f"http://{host}/{k}", page(WORDS * (2 + k % 5), tag)))
    # Here another container holds more text than the host's usual one.
    rows.append((100, "http://a.example/odd", page(WORDS, "section", f"<div class='other'><p>{WORDS * 9}</p></div>")))
    rows += [(101, None, page(WORDS)), (102, "http://d.example/", None), (103, "http://a.example/none", "<body><nav>m</nav></body>"), (104, "http://A.example/x", page("upper"))]
    return rows


def test_vote_and_extraction_equal_a_plain_count(spark):
    rows, counted = made(), {}
    for _, url, text in rows:
        host = (url or "").split("://")[-1].split("/")[0].lower()
        if host and text:
            for path, n in html.votes(text):
                counted.setdefault(host, Counter())[path] += n
    winners = {h: min(c, key=lambda p: (-c[p], p)) for h, c in counted.items()}
    frame = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash")).withColumn("winner", F.lit("clash"))
    hosts = spark.createDataFrame([((u or "").split("://")[-1].split("/")[0].lower(), t) for _, u, t in rows], "host string, html string")
    assert {r["host"]: r["path"] for r in html.host_paths(html.ballots(hosts)).collect()} == winners
    out = {r["page_id"]: r for r in html.extract(frame).collect()}
    for key, url, text in rows:
        host = (url or "").split("://")[-1].split("/")[0].lower()
        assert out[key]["text"] == html.main_text(text, winners.get(host)) and out[key]["n_chars"] == len(out[key]["text"]), key
    assert out[100]["text"] == f"T\n{WORDS.strip()}"  # by the host's path, not by the page's own best container
    assert html.main_text(rows[40][2], None) != out[100]["text"]
    assert out[102]["text"] == out[103]["text"] == "" and out[101]["text"] == f"T\n{WORDS.strip()}"


def test_tie_of_a_vote_takes_the_first_path(spark):
    two = [("h", "<body><div class='a'><p>same text</p></div></body>"), ("h", "<body><div class='b'><p>same text</p></div></body>")]
    paths = sorted(p for _, t in two for p, n in html.votes(t) if n == 1000)
    (row,) = html.host_paths(html.ballots(spark.createDataFrame(two, "host string, html string"))).collect()
    summed = Counter()
    for _, t in two:
        for p, n in html.votes(t):
            summed[p] += n
    assert len(paths) == 2 and row["path"] == min(summed, key=lambda p: (-summed[p], p))


@pytest.mark.parametrize("text", ['<a href="x ' + "<b " * 300_000, "<div>" * 50_000 + "text" + "</span>" * 50_000 + "</div>" * 50_000, '<b "' * 200_000, "<" * 500_000, "<svg>" * 100_000, "<a href=x>" * 100_000])
def test_slow_pages_are_read_in_seconds(text):
    began = time.time()
    html.main_text(text, None)
    html.votes(text)
    assert time.time() - began < 15


def test_unclosed_tags_and_quotes_keep_the_text():
    assert html.main_text("<body><p>before <b class='x>bold</b> after</p>", None) == "before bold after"
    assert html.main_text("<body><svg><p>drawn</p><p>a < b and c <3</p>", None) == "drawn\na < b and c <3"


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "http://h.example/", page(WORDS))] * 2
    frame = spark.createDataFrame(rows, PAGES)
    assert [r["text"] for r in html.extract(frame).collect()] == [f"T\n{WORDS.strip()}"] * 2
    assert html.extract(frame.limit(0)).count() == 0
