"""Wrappers and names that look like furniture, reader posts, and broken pages in linear time."""

from __future__ import annotations

import time

import pytest

from dendrolith.llm import html

PROSE = "One long paragraph of text with words in it, and more of them."
BODY = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE} Two.</p>"
TEXT = f"Title {PROSE} {PROSE} Two."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div class='widget-content'>{BODY}</div><div>Copyright by us</div></body>", TEXT),
        (f"<body><div class='modal'><article>{BODY}</article></div><p>Copyright</p></body>", TEXT),
        (f"<body><form action=x><nav><a href=1>One</a></nav><article>{BODY}</article><input></form><p>Copyright</p></body>", TEXT),
        (f"<body><form action=x><div>{BODY}</div></form></body>", TEXT),
        (f"<article>{BODY}<p class='popular'>It was popular.</p></article>", f"{TEXT} It was popular."),
        (f"<article>{BODY}<section id='notice'><p>{PROSE} Three.</p></section></article>", f"{TEXT} {PROSE} Three."),
        (f"<article>{BODY}<p class='ad'>Buy it now.</p><div class='newsletter'>Subscribe</div></article>", TEXT),
        (f"<article>{BODY}</article><ul class='discussion'><li>{PROSE * 9}</li><li>{PROSE * 9}</li></ul>", TEXT),
        (f"<article>{BODY}<ul class='discussion'><li>{PROSE * 9}</li></ul></article>", TEXT),
        (f"<div class='sidebar'><p>{PROSE * 5}</p></div><article>{BODY}</article>", TEXT),
        (f"<div class='sidebar'><article><p>{PROSE * 5}</p></article></div><article>{BODY}</article>", TEXT),
        (f"<form>Search <input></form><article>{BODY}</article>", TEXT),
        (f"<!-- never closed <article>{BODY}</article>", "never closed " + TEXT),
        (f"<article>{BODY}</article><script>var a = '<p>no</p>'", TEXT),
        (f"<article><p title='a > b < c'>{PROSE}</p><p>1 < 2 and a<b</p></article>", f"{PROSE} 1 < 2 and a<b"),
        (f"<STYLE>p{{}}</STYLE ><article><Script src=x></script>{BODY}</article>", TEXT),
    ],
)
def test_wrappers(page, want):
    got = html.main_text(page)
    assert got == want or want.startswith("never closed") and got.endswith(TEXT)


@pytest.mark.parametrize("piece", ["<a ", "<a href='", '<a href="', "<!--", "<script", "<!", "<", "</", "<p <", "<style>", "<script>", "<a b='c>", "&", "<![CDATA["])
def test_a_megabyte_of_a_broken_opener(piece):
    page = f"<article>{BODY}</article>" + piece * (1_000_000 // len(piece))
    began = time.time()
    assert html.main_text(page).startswith(TEXT)
    assert time.time() - began < 15
