"""Licence strings to SPDX ids and redistribution flags; anything unknown isn't redistributable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, empty_to_null, strip

#: Suffixes of CC-BY from the longest to none, with the words that spell them out.
_SUFFIXES = {"-NC-ND": "-noncommercial-noderiv", "-NC-SA": "-noncommercial-sharealike", "-NC": "-noncommercial", "-ND": "-noderiv", "-SA": "-sharealike", "": ""}


def _first(pairs: list[tuple[Column, str]]) -> Column:
    return reduce(lambda acc, p: F.when(p[0], F.lit(p[1])).otherwise(acc), reversed(pairs), F.lit(None).cast("string"))


def raw_text(href: Column | str, text: Column | str) -> Column:
    """The parser's link and text as one string."""
    return F.concat_ws(" ", empty_to_null(href), empty_to_null(text))


def parse_license(c: Column | str) -> Column:
    """struct(raw, spdx_id, redistributable, requires_attribution) of a licence string."""
    s = F.coalesce(_c(c), F.lit(""))
    low = F.lower(s)
    letters = F.regexp_replace(low, "[^a-z]", "")
    zero = low.contains("publicdomain/zero") | low.contains("cc-zero") | low.rlike(r"\bcc0\b")
    number = r"/(\d[.]\d)/|(?<!\d)(\d[.]\d)(?!\d)"
    version = F.coalesce(empty_to_null(F.regexp_extract(low, number, 1)), empty_to_null(F.regexp_extract(low, number, 2)))
    link = F.regexp_extract(low, "creativecommons[.]org/licenses/([a-z-]+)", 1)
    dashed = F.translate(low, " ", "-")
    by_link = _first([(link == "by" + x.lower(), "CC-BY" + x) for x in _SUFFIXES])
    by_code = _first([(letters.contains("ccby" + x.lower().replace("-", "")), "CC-BY" + x) for x in _SUFFIXES])
    spelled = _first([(dashed.contains("attribution" + w), "CC-BY" + x) for x, w in _SUFFIXES.items()])
    base = F.coalesce(by_link, by_code, F.when(letters.contains("creativecommons"), spelled))
    spdx = F.when(zero, "CC0-1.0").when(base.isNotNull(), F.concat_ws("-", base, version))
    return F.struct(strip(s).alias("raw"), spdx.alias("spdx_id"), spdx.isNotNull().alias("redistributable"), (~zero).alias("requires_attribution"))


def licence_link(html: Column | str) -> Column:
    """The first Creative Commons link of a page, or null."""
    found = F.regexp_extract(_c(html), "creativecommons[.]org/(?:publicdomain|licenses)/[-./0-9a-z]+", 0)
    return F.when(found != "", F.concat(F.lit("https://"), found))
