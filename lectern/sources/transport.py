"""Live transport: requests with retries, and the paging protocols of the catalogs.

Everything here is plain Python on the driver or in a data source's reader; what a page means is left
to sources.payloads. Transports are passed in, so nothing here is tied to a network.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

RETRIED = frozenset({429, 500, 502, 503, 504})


class SourceError(Exception):
    """A source can't serve a request for a reason the user can mend, such as a missing key."""


@dataclass
class Response:
    status: int
    body: bytes
    headers: dict[str, str]
    url: str = ""


def retry_delay(attempt: int, retry_after: str | None = None, base: float = 0.5, jitter: float = 0.1) -> float:
    """Seconds before the next try: what the server asks in whole seconds, else doubling."""
    return float(retry_after) if retry_after and retry_after.isdigit() else base * 2**attempt + jitter


def with_retries(send: Callable[[], Response], tries: int = 4, sleep: Callable[[float], None] = time.sleep) -> Response:
    """The response, after up to `tries` more attempts at transient failures; a last error status is returned as it is."""
    for attempt in range(tries + 1):
        last = attempt == tries
        try:
            r = send()
        except OSError:
            if last:
                raise
            sleep(retry_delay(attempt))
            continue
        if last or r.status not in RETRIED:
            return r
        sleep(retry_delay(attempt, r.headers.get("Retry-After")))
    raise AssertionError


def http_get(user_agent: str, timeout: float = 30.0) -> Callable[[str, dict], Response]:
    """A transport over HTTP; follows redirects."""

    def once(url: str, params: dict) -> Response:
        full = url + ("?" + urllib.parse.urlencode(params) if params else "")
        try:
            with urllib.request.urlopen(urllib.request.Request(full, headers={"User-Agent": user_agent}), timeout=timeout) as r:
                return Response(r.status, r.read(), dict(r.headers), r.url)
        except urllib.error.HTTPError as e:
            return Response(e.code, e.read(), dict(e.headers), full)

    return lambda url, params=None: with_retries(lambda: once(url, params or {}))


def page_size(limit: int, most: int) -> int:
    """The limit pushed into the size of a page."""
    return min(most, max(1, limit))


def cursor_pages(fetch: Callable[[str, int], tuple[list, str | None] | None], limit: int, most: int) -> Iterator:
    """Items by cursor, from "*": stops at the limit, on an empty page, and when the cursor is missing or stays the same."""
    cursor, left = "*", limit
    while left > 0:
        page = fetch(cursor, page_size(limit, most))
        if not page or not page[0]:
            return
        yield from page[0][:left]
        left -= len(page[0])
        if not page[1] or page[1] == cursor:
            return
        cursor = page[1]


def offset_pages(fetch: Callable[[int, int], list], limit: int, most: int) -> Iterator:
    """Items by offset: stops at the limit and on a short page."""
    size, seen = page_size(limit, most), 0
    while seen < limit:
        items = fetch(seen, size)
        yield from items[: limit - seen]
        seen += len(items)
        if len(items) < size:
            return


def counted_pages(fetch: Callable[[int], tuple[list, int]]) -> Iterator:
    """Items by a running count: stops on an empty page or at the total the server names."""
    seen = 0
    while True:
        items, total = fetch(seen)
        if not items:
            return
        yield from items
        seen += len(items)
        if total and seen >= total:
            return


def require_key(key: str | None) -> str:
    if not key:
        raise SourceError("The catalog needs an API key: set OPENALEX_API_KEY.")
    return key
