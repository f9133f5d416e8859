"""Text cleaning and section classification as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered substring rules: the first that the section's type and title contain decides.
KIND_RULES = {
    "intro": ("intro", "background"),
    "methods": ("method", "material", "procedure"),
    "results": ("result", "finding"),
    "discussion": ("discussion", "conclusion"),
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(_c(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def norm(c: Column | str) -> Column:
    """Collapsed text without blanks before closing or after opening punctuation; null becomes empty."""
    s = collapse(F.coalesce(_c(c), F.lit("")))
    s = F.regexp_replace(s, r"(?U)\s+([\]),.:;!?])", "$1")
    return F.regexp_replace(s, r"(?U)([\[(])\s+", "$1")


def kind_of(sec_type: Column | str, title: Column | str, inherited: Column | str | None = None) -> Column:
    """The canonical kind of a section, from the type and title together, else what it inherits."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(_c(sec_type), F.lit("")), F.coalesce(_c(title), F.lit(""))))
    rest = F.coalesce(_c(inherited), F.lit("other")) if inherited is not None else F.lit("other")
    rules = [(needle, kind) for kind, needles in KIND_RULES.items() for needle in needles]
    return reduce(lambda acc, rule: F.when(hay.contains(rule[0]), rule[1]).otherwise(acc), reversed(rules), rest)


def full_name(given: Column | str, surname: Column | str) -> Column:
    return norm(F.concat_ws(" ", empty_to_null(given), empty_to_null(surname)))


def without_section_number(c: Column | str) -> Column:
    """A heading without a prefix such as "3.1 " or "A.2 " (a lone capital counts as one)."""
    return F.regexp_replace(_c(c), r"(?U)^\s*(?:[A-Z]|\d+)(?:[.]\d+)*\s+", "")


def author_list(c: Column | str) -> Column:
    """Names separated by semicolons, trimmed, blank ones left out."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), ";"), strip)
    return F.filter(parts, lambda x: x != "")


def is_blank(c: Column | str) -> Column:
    return ~F.coalesce(_c(c), F.lit("")).rlike(r"(?U)[^\s]")
