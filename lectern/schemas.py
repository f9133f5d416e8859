"""Schemas of the document model and the value domains of its string enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

SERVERS = ("biorxiv", "medrxiv", "arxiv")
KINDS = tuple("abstract intro methods results discussion other".split())
SOURCES = tuple("openalex europepmc biorxiv_s3 biorxiv_api biorxiv_html arxiv_html arxiv_api".split())
STATUSES = ("ok", "degraded", "not_found")


_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "date": T.DateType()}


def record(**fields: str | T.DataType) -> T.StructType:
    """A struct of nullable fields, given by type or simple type name."""
    return T.StructType([T.StructField(k, _SIMPLE[v] if isinstance(v, str) else v) for k, v in fields.items()])


STRINGS = T.ArrayType(T.StringType())
LICENSE = record(raw="string", spdx_id="string", redistributable="boolean", requires_attribution="boolean")
SECTION = record(id="string", kind="string", title="string", text="string", order="int")
PREPRINT = record(
    doi="string", version="int", server="string", title="string", authors=STRINGS, date="date", category="string", abstract="string",
    license=LICENSE, published_doi="string", provenance=T.MapType(T.StringType(), T.StringType()),
)
FULLTEXT = T.StructType([*PREPRINT.fields, *record(sections=T.ArrayType(SECTION), retrieved_from="string", raw_ref="string").fields])
PARSED = record(
    title="string", doi="string", authors=STRINGS, abstract="string", license_raw=record(href="string", text="string"),
    sections=T.ArrayType(record(order="int", kind="string", title="string", text="string")),
)
CHUNK = record(
    doi="string", version="int", chunk_id="string", section_kind="string", text="string", token_count="int", char_start="int", char_end="int", license=LICENSE, source="string",
)
SEARCH_HIT = record(title="string", doi="string", openalex_id="string", score="double", source="string", snippet="string", oa_url="string", has_fulltext="boolean")
MANIFEST = record(target_id="string", doi="string", version="int", status="string", n_chunks="bigint", license="string", source="string")
