"""What is removed inside the article's container: form controls, layout words, and what a host's pages vote to be furniture;
and the given pages against an extractor of another make."""

from html.parser import HTMLParser

import pytest

from tidewater.llm import html

WORDS = "one two three four five six seven eight nine ten "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>Hello <button>Share</button> world</p>", "Hello world"),
        ("<p>Words of the article stand here</p><select><option>A<option>B</select><label>Mail</label>", "Words of the article stand here"),
        ("<article><p>Start of it all</p><div class='side-effects'><p>Dizziness and so on</p></div><section class='alert-levels'><p>Red, amber</p></section></article>", "Start of it all\nDizziness and so on\nRed, amber"),
        ("<article><p>Start of it all</p><div class='alert alert-box'>Buy now</div><div id='discussion'>me too</div><ol class='kommentare'><li>ich auch</ol><div class='werbung'>Kauf!</div></article>", "Start of it all"),
        ("<article><p>Text of some length is here <label>open control</article><p>after</p>", "Text of some length is here"),
    ],
)
def test_controls_and_layout_words(page, text):
    assert html.main_text(page, None) == text


class Plain(HTMLParser):
    """The text of the article element, cut at its headings, paragraphs and line breaks."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("h1", "p", "br", "ul", "li", "div"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("h1", "p", "ul", "li", "div"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_given_pages_equal_another_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(rows) >= 50
    for r in rows:
        parser = Plain()
        parser.feed(r["html"] or "")
        parser.close()
        assert out[r["page_id"]] == "\n".join(" ".join(b.split()) for b in parser.blocks if b.split()), r["page_id"]


def site(host, k, article, extra="", comments=""):
    return (f"https://{host}/{k}", f"<body><div class='inhalt'><h1>T{k}</h1><p>{article}</p>{extra}<p>{article[::-1]}</p><div class='zzz'>{comments}</div></div></body>")


def made():
    """A host whose pages repeat a box that no word gives away, one with lists of links, and one with copies of one page."""
    rows = []
    for k in range(8):
        own = f"{WORDS * 3}{k} {k * k} " * 2
        rows.append(site("a.example", k, own, "<div class='kasten'><p>Lesen Sie unser Heft</p></div>", f"own {k}"))
        rows.append(site("b.example", k, own, f"<div class='q'><a href='/{k}'>more of {k}</a> <a href='/x{k}'>other {k}</a></div>", f"own {k}"))
        rows.append(site("c.example", 1, WORDS * 4, "<div class='kasten'><p>Lesen Sie unser Heft</p></div>", "said once"))
    rows.append(site("d.example", 1, WORDS * 4, "<div class='kasten'><p>Lesen Sie unser Heft</p></div>"))
    return rows


def test_a_host_votes_its_furniture_away(spark):
    rows = made()
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html.extract(frame).collect()}
    for k, (url, page) in enumerate(rows):
        host = url.split("/")[2]
        assert ("Heft" in out[k]) == (host in ("c.example", "d.example")), url  # copies of one page say nothing
        assert "more of" not in out[k] and ("own" in out[k] or "said" in out[k]) == (host != "d.example")
        assert out[k].startswith("T")


def test_furniture_equals_a_plain_count(spark):
    rows = [(u.split("/")[2], p) for u, p in made()]
    seen = {}
    for host, page in rows:
        parsed = html.Page(page)
        for path, text, linked in parsed.reports():
            seen.setdefault((host, path), []).append((text, parsed.whole, linked))
    wanted = {}
    for (host, path), found in seen.items():
        recurs = sum(any(t == text and w != whole for t, w, _ in found) for text, whole, _ in found)
        if len(found) >= html.LEAST_PAGES and max(recurs, sum(x[2] for x in found)) >= html.SHARE * len(found):
            wanted.setdefault(host, []).append(path)
    out = {r["host"]: r["furniture"] for r in html.host_furniture(html.ballots(spark.createDataFrame(rows, "host string, html string"))).collect()}
    assert out == {h: sorted(p) for h, p in wanted.items()} and set(out) == {"a.example", "b.example"}
