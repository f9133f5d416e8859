"""Field-scoped search and discovery over catalog tables, as predicates that Catalyst can push down.

Catalogs rank remotely and don't say how; here a hit's score is how often the terms occur in the field,
and ties go by the key, so that results are the same every time.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import in_window

FIELDS = ("fulltext", "title", "abstract", "author")


def terms_of(query: str) -> list[str]:
    return query.lower().split()


def matches(column: Column | str, query: str, phrase: bool = False) -> Column:
    """All terms occur in the text, or the phrase as it is; case doesn't count."""
    c = F.lower(F.col(column) if isinstance(column, str) else column)
    if phrase:
        return c.contains(query.lower())
    return reduce(and_, [c.contains(t) for t in terms_of(query)], F.lit(True))


def occurrences(column: Column | str, query: str) -> Column:
    """How often the terms occur, all together."""
    c = F.lower(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))
    parts = [((F.length(c) - F.length(F.replace(c, F.lit(t), F.lit("")))) / len(t)).cast("long") for t in terms_of(query)]
    return reduce(lambda a, b: a + b, parts, F.lit(0).cast("long"))


def field_query(query: str, field: str = "fulltext", source: str = "europepmc") -> str:
    """The query string a live catalog is sent for a field-scoped search."""
    words = query.split()
    if source == "openalex":
        key = "raw_author_name.search" if field == "author" else f"{field}.search" if field in ("title", "abstract") else None
        return f"{key}:{query}" if key else query
    if source == "arxiv":
        if field == "author":
            return 'au:"' + query + '"'
        tag = "ti" if field == "title" else "abs" if field == "abstract" else "all"
        return f"{tag}:{query}" if len(words) < 2 else "(" + " AND ".join(f"{tag}:{w}" for w in words) + ")"
    tag = (field or "").lower()
    if tag not in ("title", "abstract"):
        return query if tag != "author" else 'AUTH:"' + query + '"'
    parts = [f'{tag.upper()}:"{w}"' for w in words]
    return f'{tag.upper()}:"{query}"' if len(parts) < 2 else "(" + " AND ".join(parts) + ")"


def search(catalog: DataFrame, query: str, columns: dict[str, str], key: str, field: str = "fulltext", limit: int = 25) -> DataFrame:
    """The best `limit` rows of a catalog for a query in a field, with their score; `columns` names each field's column."""
    c = columns.get(field, columns["fulltext"])
    hits = catalog.where(matches(c, query, phrase=field == "author")).withColumn("score", occurrences(c, query).cast("double"))
    return hits.orderBy(F.desc("score"), key).limit(limit)


def discover(catalog: DataFrame, query: str | None = None, category: str | None = None, since: dt.date | None = None, until: dt.date | None = None, *, text: str = "text", category_col: str = "category", date_col: str = "date", key: str = "doi", limit: int = 100) -> DataFrame:
    """Rows by topic, category and an inclusive date window, by date and key."""
    rows = catalog.where(in_window(date_col, since, until))
    if query:
        rows = rows.where(matches(text, query))
    if category:
        rows = rows.where(matches(category_col, category))
    return rows.orderBy(date_col, key).limit(limit)
