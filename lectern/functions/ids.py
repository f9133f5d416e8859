"""Identifiers: DOIs, versions, arXiv ids, OpenAlex ids; all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, empty_to_null, strip

_TAIL = r"(?:[.](?:full|article)\S*)?/?$"
_ARXIV = r"(?i)(\d{4}[.]\d{4,5}|[a-z-]+(?:[.][a-z]{2})?/\d{7})(v\d+)?"
#: Archives of old-style ids; without one of them such an id needs an arXiv context.
ARCHIVES = (
    "supr-con stat solv-int quant-ph q-fin q-bio q-alg plasm-ph physics patt-sol nucl-th nucl-ex nlin mtrl-th math-ph math "
    "hep-th hep-ph hep-lat hep-ex gr-qc funct-an eess econ dg-ga cs cond-mat comp-gas cmp-lg chem-ph chao-dyn bayes-an "
    "atom-ph astro-ph ao-sci alg-geom adap-org acc-phys"
).split()


def _bare(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def _no_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def normalize_doi(c: Column | str) -> Column:
    """A bare DOI from a DOI, a resolver URL (which keeps a version suffix) or a content URL; else the input."""
    s = _bare(_c(c))
    resolved = _no_slash(strip(F.split(s, "doi[.]org/", 2)[1]))
    page = F.regexp_extract(s, r"/content/(10[.]\d+/[^#?\s]+?)(?:v\d+)?" + _TAIL, 1)
    doi = F.regexp_extract(s, r"10[.]\d+/\S+", 0)
    return (
        F.when(s.contains("doi.org/"), resolved)
        .when(page != "", _no_slash(page))
        .when(doi != "", F.regexp_replace(_no_slash(doi), r"v\d+$", ""))
        .otherwise(s)
    )


def doi_version(c: Column | str) -> Column:
    """The N of a trailing vN, also before a .full or .article tail."""
    return empty_to_null(F.regexp_extract(_bare(_c(c)), r"v(\d+)" + _TAIL, 1)).try_cast("int")


def split_arxiv(c: Column | str) -> Column:
    """struct(id, version) of an arXiv id, URL or DOI; null fields for anything else."""
    whole = _bare(_c(c))
    inner = F.regexp_extract(whole, r"(?i)10[.]48550/arxiv[.](.+)", 1)
    s = F.when(inner != "", inner).otherwise(whole)
    core = F.regexp_extract(s, _ARXIV, 1)
    archive = F.lower(F.substring_index(F.substring_index(core, "/", 1), ".", 1))
    low = F.lower(s)
    known = core.rlike(r"^\d{4}[.]\d{4,5}$") | low.contains("arxiv") | low.contains("ar5iv") | low.contains("10.48550") | (core.contains("/") & archive.isin(ARCHIVES))
    ok = (core != "") & known
    version = F.substring(F.regexp_extract(s, _ARXIV, 2), 2, 12).try_cast("int")
    return F.struct(F.when(ok, core).alias("id"), F.when(ok, version).alias("version"))


def normalize_arxiv(c: Column | str) -> Column:
    return split_arxiv(c)["id"]


def arxiv_doi(c: Column | str) -> Column:
    return F.concat(F.lit("10.48550/arXiv."), _c(c))


def identify(c: Column | str) -> Column:
    """struct(kind, id, version): arXiv first, then a DOI of the preprint servers, else unknown."""
    arxiv, doi = split_arxiv(c), normalize_doi(c)
    is_arxiv = arxiv["id"].isNotNull()
    return F.struct(
        F.when(is_arxiv, "arxiv").when(doi.rlike(r"^10[.]\d+/"), "openrxiv").otherwise("unknown").alias("kind"),
        F.when(is_arxiv, arxiv["id"]).otherwise(doi).alias("id"),
        F.when(is_arxiv, arxiv["version"]).otherwise(doi_version(c)).alias("version"),
    )


def entry_id(c: Column | str) -> Column:
    """struct(id, version) of an arXiv feed entry's id; only the last path segment counts."""
    tail = F.element_at(F.split(_c(c), "/"), -1)
    base = F.regexp_extract(tail, r"^(.*)v(\d+)$", 1)
    versioned = tail.rlike(r"^.*v\d+$")
    return F.struct(F.when(versioned, base).otherwise(tail).alias("id"), F.when(versioned, F.regexp_extract(tail, r"v(\d+)$", 1).try_cast("int")).alias("version"))


def short_id(c: Column | str) -> Column:
    """The last path segment; empty becomes null."""
    return F.element_at(F.split(empty_to_null(c), "/"), -1)


def clean_doi(c: Column | str) -> Column:
    return F.regexp_replace(empty_to_null(c), r"https?://doi[.]org/", "")


def cache_key(*parts: Column | str) -> Column:
    """The SHA-256 of the parts joined by bars, null as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]), 256)


def cache_shard(key: Column | str) -> Column:
    """One of 256 shards of the cache, its partition column."""
    return F.substring(_c(key), 1, 2)


def chunk_id(doi: Column | str, version: Column | str, part: Column | str, idx: Column | str) -> Column:
    return F.concat_ws(":", F.coalesce(_c(doi), F.lit("")), F.coalesce(_c(version).cast("string"), F.lit("na")), _c(part).cast("string"), _c(idx).cast("string"))
