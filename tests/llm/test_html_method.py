"""The method of extraction against a plain version, and pages that are hard to read."""

from __future__ import annotations

import math
import random
import time

import pytest

from dendrolith.llm import html

PROSE = "One long paragraph of text with words in it, and more of them."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>{PROSE}</p><p class='popular-uprising'>The uprising was popular.</p></article>", f"{PROSE} The uprising was popular."),
        (f"<div><p>{PROSE}</p><p><a href=x>A link that is a paragraph</a></p></div>", f"{PROSE} A link that is a paragraph"),
        (f"<body><aside>Related <a href=x>y</a><article><p>{PROSE}</p><p>Two.</p></article>", f"{PROSE} Two."),
        (f"<body><form><input>Search<p>{PROSE}</p><p>Two.</p>", f"{PROSE} Two."),
        (f"<article><p>{PROSE}</p><div class='comments-area'><p>{PROSE * 9}</p></div></article>", PROSE),
        (f"<body><div><a href=1>One</a> <a href=2>Two</a></div><p>{PROSE}</p></body>", PROSE),
        (f"<article><header><h1>Title</h1></header><p>{PROSE}</p><footer>x</footer></article>", f"Title {PROSE}"),
        (f"<div class='header'><p>{PROSE}</p></div>", PROSE),
        (f"<b><article><p>{PROSE}</b></p><p>Two.</p></article></b><div class=ad>Buy</div>", f"{PROSE} Two."),
        ("<aside>all of it", ""),
    ],
)
def test_hard_pages(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("page", ["<article><p>" + "<span>" * 200_000 + "text" + "</b></i>" * 200_000, "<div>" * 200_000 + "text" + "</section>" * 200_000, "<aside>" * 200_000 + "<p>text" + "</form>" * 200_000, "<b><div>" * 100_000 + "text" + "</b></p>" * 100_000, "<p>text " * 200_000])
def test_time_grows_with_the_length(page):
    began = time.time()
    assert html.main_text(page).startswith("text")
    assert time.time() - began < 20


def plain(blocks: list[tuple[int, str, int]], n_regions: int) -> list[str]:
    """blocks: (region, text, tags met). Regions are siblings; the page holds them all. Every sum is written out."""
    ratio = [len(t) / max(1, tags) for _, t, tags in blocks]
    level = []
    for i in range(len(ratio)):
        near = [(math.exp(-0.5 * ((i - j) / html.SIGMA) ** 2), ratio[j]) for j in range(len(ratio)) if abs(i - j) <= math.ceil(3 * html.SIGMA)]
        level.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    content = [x >= html.THRESHOLD * sum(level) / len(level) for x in level]
    total = sum(len(t) for (_, t, _), c in zip(blocks, content, strict=True) if c)
    for k in range(n_regions):
        if sum(len(t) for (r, t, _), c in zip(blocks, content, strict=True) if c and r == k) >= html.HELD * total:
            return [t for r, t, _ in blocks if r == k]
    return [t for _, t, _ in blocks]


def test_against_a_plain_version():
    rng = random.Random(6)
    several = 0
    for _ in range(300):
        n_regions = rng.randint(1, 4)
        page, blocks = "<body>", []
        big = rng.randrange(n_regions)
        for k in range(n_regions):
            page += "<section>"
            for _ in range(rng.randint(1, 12)):
                words = " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(20, 60) if k == big else rng.randint(1, 8)))
                marks = rng.randint(0, 4)
                page += "<p>" + "<i>" * marks + words + "</i>" * marks + "</p>"
                blocks.append((k, words, 1 + 2 * marks))
            page += "</section>"
        want = plain(blocks, n_regions)
        several += len(want) < len(blocks)
        assert html.main_text(page + "</body>") == " ".join(want)
    assert several > 50
