"""Short cells inside the main element of a page without article or main."""

from __future__ import annotations

from dendrolith.llm import html


def test_cells_between_long_paragraphs_stay():
    long = " ".join(f"word{k}" for k in range(200))
    cells = "".join(f"<tr><td>{k}</td><td>v{k}</td></tr>" for k in range(40))
    text = html.main_text(f"<html><body><div><p>{long}</p><table>{cells}</table><p>{long}</p></div></body></html>").split()
    assert all(f"v{k}" in text for k in range(40))
