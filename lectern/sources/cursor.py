"""Pages of a service that hands on a cursor: followed to the end, kept by request, asked again where a call fails."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping, MutableMapping
from typing import Any

#: Parameters that are nobody's business and say nothing of what is asked for.
PRIVATE = frozenset({"api_key", "mailto"})


def canonical_request(endpoint: str, params: Mapping[str, Any]) -> str:
    """A request as JSON with sorted keys, private and absent parameters left out; other values than scalars are an error."""
    kept = {k: v for k, v in params.items() if k not in PRIVATE and v is not None}
    for k, v in kept.items():
        if not isinstance(v, (str, int, float, bool)):
            raise TypeError(f"parameter {k} is no scalar")
    return json.dumps({"endpoint": endpoint, "params": kept}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def request_key(endpoint: str, params: Mapping[str, Any]) -> str:
    return hashlib.sha256(canonical_request(endpoint, params).encode()).hexdigest()


def follow_pages(
    fetch: Callable[[str, Mapping[str, Any]], Mapping[str, Any]], endpoint: str, params: Mapping[str, Any], start: str = "*",
    stored: MutableMapping[str, Mapping[str, Any]] | None = None, tries: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep,
) -> Iterator[tuple[str, Mapping[str, Any]]]:
    """(cursor, page) from ``start`` on until a page has no next cursor.

    A page in ``stored`` isn't fetched again, and a fetched one is put there, the first one winning.  A failing call is
    made up to ``tries`` times, with waits that double.  A cursor met twice, or a page that is none, is an error.
    """
    cursor, met = start, set()
    while cursor is not None:
        if cursor in met:
            raise ValueError(f"the cursors form a cycle at {cursor}")
        met.add(cursor)
        asked = {**params, "cursor": cursor}
        key = request_key(endpoint, asked)
        page = None if stored is None else stored.get(key)
        for left in range(tries - 1, -1, -1):
            if page is not None:
                break
            try:
                page = fetch(endpoint, asked)
            except OSError:
                if not left:
                    raise
                sleep(wait * 2 ** (tries - 1 - left))
        if not isinstance(page, Mapping) or not isinstance(page.get("meta"), Mapping) or not isinstance(page.get("results"), list):
            raise ValueError(f"what {endpoint} gave at {cursor} is no page")
        if stored is not None:
            page = stored.setdefault(key, page)
        yield cursor, page
        cursor = page["meta"].get("next_cursor")
