"""One poll of paged logs: all pages of it, and the stretches that it couldn't read."""

from __future__ import annotations

import json
from collections.abc import Callable

from tidewire import config as C


def _summary(line: str) -> dict | None:
    try:
        said = json.loads(line)
    except ValueError:
        return None
    return said if isinstance(said, dict) and said.get("type") == "summary" else None


def read_pages(read: Callable[[str | None], str], start: str, end: str, most: int = C.POLL_PAGES) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Lines of all pages, and gaps (start, end, reason) of a poll from `start` to `end`.

    `read` gives the text of a page by its cursor, of the first by None. A page's summary record names the next one. Excluded stretches
    are gaps, those without a time of their own over the whole poll; so is a poll that still has more after `most` pages.
    """
    lines: list[str] = []
    gaps: list[tuple[str, str, str]] = []
    cursor: str | None = None
    for _ in range(most):
        page = [x for x in read(cursor).split("\n") if x.strip()]
        lines += page
        cursor = None
        for said in filter(None, map(_summary, page)):
            spans = said.get("excludedIntervals")
            for x in spans if isinstance(spans, list) else []:
                ends = [x.get(k) if isinstance(x, dict) else None for k in ("start", "end")]
                gaps.append((ends[0] if isinstance(ends[0], str) else start, ends[1] if isinstance(ends[1], str) else end, "excluded"))
            paging = said.get("pagination")
            more = isinstance(paging, dict) and paging.get("hasMore") is True and isinstance(paging.get("next"), str)
            cursor = paging["next"] if more else None
        if cursor is None:
            return lines, gaps
    return lines, [*gaps, (start, end, "truncated")]
