"""The parsers as Arrow-batched column functions; the record comes back as one struct.

To the optimizer they aren't deterministic: else it copies a parser into each filter on what was parsed,
and every copy parses all payloads again, in a Python worker of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PARSED
from ..session import release
from .articles import PARSERS, archive_article, parse_jats


def parsed(payload: Column | str, form: str, keep_tables: bool = False) -> Column:
    """The article record of a payload column (string or binary) of form jats, latexml or journal_page."""
    if form not in PARSERS:
        raise ValueError(f"unknown form {form!r}")
    parse = (lambda x: parse_jats(x, keep_tables)) if form == "jats" else PARSERS[form]

    @F.pandas_udf(PARSED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield _records(s, parse)

    return run.asNondeterministic()(payload)


def _records(payloads: pd.Series, parse) -> pd.DataFrame:
    found = pd.DataFrame([parse(x) for x in payloads], columns=PARSED.fieldNames())
    release()
    return found


def parsed_archive(payload: Column | str) -> Column:
    """The record of the JATS article in a column of zipped archives, an empty one where there is none; unpacked and parsed in one worker."""

    @F.pandas_udf(PARSED)
    def run(s: pd.Series) -> pd.DataFrame:
        return _records(s, lambda x: parse_jats(archive_article(x)))

    return run.asNondeterministic()(payload)
