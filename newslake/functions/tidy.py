"""Text of feeds and pages, tidied in Python workers."""

from __future__ import annotations

import html

_TABS = str.maketrans("\t", " ")


def tidied(text: str | None, entities_first: bool = False) -> str:
    """Entities resolved, runs of white space as one space, trimmed. Crawl titles resolve `entities_first`, so what they spell out is squeezed too."""
    words = (html.unescape(text or "") if entities_first else text or "").split()
    joined = " ".join(words)
    return joined if entities_first else html.unescape(joined).strip().translate(_TABS)
