"""Ordinary raw pages whose article must not come out empty."""

import pytest

from tidewater.llm import html

TEXT = "one two three four five six seven eight nine ten"
LONG = f"<h1>Title</h1><p>{TEXT}</p><p>{TEXT}</p>"
WANTED = f"Title\n{TEXT}\n{TEXT}"


@pytest.mark.parametrize("page", [
    f"<!doctype html><html><head><title>t</title></head>{LONG}",
    f"<!doctype html><title>t</title>{LONG}",
    f"<head><title>t</title>{LONG}",
    f"<body class='no-sidebar'>{LONG}</body>",
    f"<body class='right-sidebar header-fixed'><div class='sidebar'>side</div>{LONG}</body>",
    f"<body><main class='search-results'>{LONG}</main></body>",
    f"<body><article class='post has-comments'>{LONG}<div class='comments'><article class='comment'>reader</article></div></article></body>",
    f"<body><div class='page with-sidebar'><div class='sidebar'>side</div>{LONG}</div></body>",
    f"<body><a name=top>{LONG}</body>",
    f"<body><a href='#x'>{LONG}</body>",
])
def test_article_is_found(page):
    text = html.main_text(page, None)
    assert text == WANTED


def test_long_comments_are_not_the_article():
    page = f"<body><div><h1>Title</h1><p>{TEXT}</p></div><div class='comments'>{f'<p>{TEXT}</p>' * 9}</div></body>"
    assert html.main_text(page, None) == f"Title\n{TEXT}"


def test_closed_anchor_around_blocks_is_a_link():
    page = html.Page(f"<div><a href='/x'><p>{TEXT}</p><p>{TEXT}</p></a></div>")
    assert [linked for _, _, linked in page.blocks] == [len(TEXT)] * 2
