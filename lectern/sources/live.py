"""A Python data source over live catalogs: spark.read.format("lectern_pages") gives the pages' items as JSON rows."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import HTTPS, Settings
from .transport import Response, SourceError, counted_pages, cursor_pages, http_get, offset_pages, require_key

EPMC = HTTPS + "www.ebi.ac.uk/europepmc/webservices/rest"
OPENALEX = HTTPS + "api.openalex.org"
DETAILS = HTTPS + "api.biorxiv.org"

Get = Callable[[str, dict], Response]


def _json(r: Response) -> dict | None:
    return json.loads(r.body) if r.status == 200 else None


def epmc_page(get: Get, query: str, **more) -> tuple[list[dict], str | None]:
    """Records and next cursor of one page of a search."""
    d = _json(get(f"{EPMC}/search", {"format": "json", "query": query, "resultType": "lite"} | more)) or {}
    records = (d.get("resultList") or {}).get("result") or []
    return records, d.get("nextCursorMark")


def epmc_items(get: Get, query: str, limit: int = 25) -> Iterator[dict]:
    """Records of a preprint search."""
    full = query if "SRC:PPR" in query.upper() else f"({query}) AND SRC:PPR"
    return cursor_pages(lambda cursor, size: epmc_page(get, full, pageSize=size, cursorMark=cursor), limit, 100)


def openalex_items(get: Get, params: dict, limit: int, settings: Settings) -> Iterator[dict]:
    base = {"api_key": require_key(settings.openalex_api_key)} | ({"mailto": settings.contact_email} if settings.contact_email else {})

    def page(cursor, size):
        r = get(f"{OPENALEX}/works", base | params | {"per-page": size, "cursor": cursor})
        if r.status == 409:
            raise SourceError("The catalog refused the request: set a valid OPENALEX_API_KEY.")
        d = _json(r)
        return d and (d.get("results") or [], (d.get("meta") or {}).get("next_cursor"))

    return cursor_pages(page, limit, 200)


def feed_pages(get: Get, base: str, query: str, limit: int) -> Iterator:
    """Feed entries of an arXiv search, each as a node."""
    from ..parse.tree import parse_xml

    def page(start, size):
        r = get(base, {"search_query": query, "start": start, "max_results": size, "sortBy": "relevance"})
        root = parse_xml(r.body) if r.status == 200 else None
        return [n for n in root.nodes() if n.tag == "entry"] if root is not None else []

    return offset_pages(page, limit, 100)


def detail_items(get: Get, server: str, since: str, until: str) -> Iterator[dict]:
    """All versions a server got in a window of days."""

    def page(cursor):
        d = _json(get(f"{DETAILS}/details/{server}/{since}/{until}/{cursor}", {})) or {}
        return d.get("collection", []), int((d.get("messages") or [{}])[0].get("total", 0))

    return counted_pages(page)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, get: Get | None = None):
        self.options, self.get = options, get
        if options.get("catalog") == "openalex":
            require_key(options.get("api_key"))

    def partitions(self):
        o = self.options
        if o.get("catalog") == "details":  # a day can be read beside another
            first, last = dt.date.fromisoformat(o["since"]), dt.date.fromisoformat(o["until"])
            return [InputPartition((first + dt.timedelta(days=k)).isoformat()) for k in range((last - first).days + 1)]
        return [InputPartition(None)]  # a cursor can only be followed in turn

    def read(self, partition):
        o = self.options
        s = Settings(contact_email=o.get("contact_email"), openalex_api_key=o.get("api_key"))
        get, limit, query = self.get or http_get(s.user_agent), int(o.get("limit", 25)), o.get("query", "*")
        if o.get("catalog") == "openalex":
            items = openalex_items(get, {"search": query}, limit, s)
        elif o.get("catalog") == "details":
            items = detail_items(get, o.get("server", "biorxiv"), partition.value, partition.value)
        elif o.get("catalog") == "arxiv":
            items = ({c.tag: c.text().strip() for c in entry.nodes()} for entry in feed_pages(get, s.arxiv_api_base, query, limit))
        else:
            items = epmc_items(get, query, limit)
        for item in items:
            yield (json.dumps(item),)


class PagesDataSource(DataSource):
    """One JSON item a row; options: catalog (europepmc, openalex, arxiv, details), query, limit, api_key, server, since, until."""

    @classmethod
    def name(cls):
        return "lectern_pages"

    def schema(self):
        return "item string"

    def reader(self, schema):
        return _Reader(dict(self.options))
