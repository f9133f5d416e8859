"""Month folders, posting dates and date windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

MONTHS = [dt.date(2000, m, 1).strftime("%B") for m in range(1, 13)]


def month_folder(c: Column | str) -> Column:
    return F.date_format(_c(c), "MMMM_yyyy")


def parse_month_folder(c: Column | str) -> Column:
    """The first of the month that "June_2025" names, null for other names."""
    name = F.regexp_extract(_c(c), r"^([A-Z][a-z]+)_(\d{4})$", 1)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    text = F.concat_ws("-", F.regexp_extract(_c(c), r"_(\d{4})$", 1), F.lpad(number.cast("string"), 2, "0"), F.lit("01"))
    return F.when(number > 0, F.try_to_date(text, "yyyy-MM-dd"))


def doi_posting_date(c: Column | str) -> Column:
    """The date a DOI carries after its prefix, null if there is none or it isn't a date."""
    part = r"10[.]\d+/(\d{4}[.]\d{2}[.]\d{2})[.]"
    return F.try_to_date(F.nullif(F.regexp_extract(_c(c), part, 1), F.lit("")), "yyyy.MM.dd")


def in_window(c: Column | str, since: dt.date | None, until: dt.date | None) -> Column:
    """Inclusive at both ends; either may be open."""
    out = F.lit(True)
    if since is not None:
        out = out & (_c(c) >= F.lit(since))
    if until is not None:
        out = out & (_c(c) <= F.lit(until))
    return out


def folder_since(folder: Column | str, since: dt.date | None) -> Column:
    """Whether a month folder is of the month of `since` or later; names that aren't months stay."""
    if since is None:
        return F.lit(True)
    month = parse_month_folder(folder)
    return month.isNull() | (month >= F.lit(since.replace(day=1)))


def parse_month(folder: str) -> dt.date | None:
    """The first day of the month that a folder is named after, such as June_2025; None for other names."""
    try:
        return dt.datetime.strptime(folder, "%B_%Y").date()
    except ValueError:
        return None


def parse_since(s: str | None) -> dt.date | None:
    """A date from YYYY-MM, taken as the first of the month, or YYYY-MM-DD."""
    if not s:
        return None
    return dt.date.fromisoformat(s if s.count("-") == 2 else f"{s}-01")
