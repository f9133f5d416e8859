"""From recorded payloads of each source to rows of the document model; pure Column work but for trees and archives."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import doi_posting_date, folder_since, in_window, month_folder, parse_month
from ..functions.ids import arxiv_doi, clean_doi, entry_id, short_id
from ..functions.licenses import licence_link, parse_license
from ..functions.text import author_list, collapse, empty_to_null
from ..operators.assemble import build_fulltext, has_content, provenance, rebuilt_abstract
from ..parse.tree import parse_xml
from ..parse.udfs import parsed, parsed_archive
from ..schemas import PREPRINT, SEARCH_HIT, STRINGS, record
from ..session import file_system

#: So many requested DOIs are broadcast at most to pick their documents; beyond that they are joined by hash.
BROADCAST_REQUESTS = 100_000

_EPMC = "resultList struct<result: array<struct<id: string, source: string, doi: string, title: string, inEPMC: string, hasTextMinedTerms: string>>>, nextCursorMark string"
_WORK = (
    "id string, doi string, title string, display_name string, relevance_score double, has_fulltext boolean, best_oa_url string, "
    "best_oa_location struct<pdf_url: string, landing_page_url: string>, abstract_inverted_index map<string, array<int>>, publication_date string"
)
_DETAIL = "doi string, title string, authors string, date string, version string, category string, abstract string, license string, published string"


def _rows(df: DataFrame, names: T.StructType, **given: Column) -> DataFrame:
    """Rows of a schema from the given columns; the others are null."""
    none = F.lit(None)
    return df.select(*[given.get(f.name, none).cast(f.dataType).alias(f.name) for f in names])


# catalogs


def epmc_hits(pages: DataFrame, column: str = "json") -> DataFrame:
    """Search hits of result pages."""
    r = F.col("r")
    rows = pages.select(F.explode(F.from_json(column, _EPMC)["resultList"]["result"]).alias("r"))
    full = (F.coalesce(r["inEPMC"], F.lit("")) == "Y") | (F.coalesce(r["hasTextMinedTerms"], F.lit("")) == "Y")
    return _rows(rows, SEARCH_HIT, title=r["title"], doi=r["doi"], source=F.lit("europepmc"), has_fulltext=full)


def epmc_ids(pages: DataFrame, column: str = "json") -> DataFrame:
    """(doi, ppr_id): the first preprint record of each DOI, by its place in the pages."""
    rows = pages.select(F.posexplode(F.from_json(column, _EPMC)["resultList"]["result"]).alias("p", "r"))
    rows = rows.where("r.source = 'PPR' and r.id is not null and r.id != ''")
    return rows.groupBy(F.col("r.doi").alias("doi")).agg(F.min_by("r.id", "p").alias("ppr_id"))


def detect_server(xml: Column | str) -> Column:
    """medrxiv if the first 4000 bytes say so, in any case, else biorxiv."""
    head = F.lower(F.decode(F.substring(F.col(xml).cast("binary") if isinstance(xml, str) else xml.cast("binary"), 1, 4000), "ISO-8859-1"))
    return F.when(head.contains("medrxiv"), "medrxiv").otherwise("biorxiv")


def openalex_hits(pages: DataFrame, column: str = "json") -> DataFrame:
    w = F.col("w")
    rows = pages.select(F.explode(F.from_json(column, f"results array<struct<{_WORK}>>")["results"]).alias("w"))
    best = w["best_oa_location"]
    url = F.coalesce(empty_to_null(best["pdf_url"]), empty_to_null(best["landing_page_url"]), w["best_oa_url"])
    return _rows(
        rows, SEARCH_HIT, title=F.coalesce(empty_to_null(w["title"]), w["display_name"]), doi=clean_doi(w["doi"]), openalex_id=short_id(w["id"]), score=w["relevance_score"],
        source=F.lit("openalex"), snippet=rebuilt_abstract(w["abstract_inverted_index"]), oa_url=url, has_fulltext=F.coalesce(w["has_fulltext"], F.lit(False)),
    )


def openalex_metadata(works: DataFrame, column: str = "json") -> DataFrame:
    """Bibliographic rows of single works; the catalog doesn't name the server, which is taken as biorxiv."""
    w = F.col("w")
    rows = works.select(F.from_json(column, _WORK).alias("w"))
    return _rows(
        rows, PREPRINT, doi=clean_doi(w["doi"]), server=F.lit("biorxiv"), title=F.coalesce(empty_to_null(w["title"]), w["display_name"]),
        authors=F.array(), abstract=rebuilt_abstract(w["abstract_inverted_index"]), provenance=provenance(source="openalex", openalex_id=short_id(w["id"])),
    )


_ENTRIES = T.ArrayType(record(raw_id="string", title="string", summary="string", published="string", authors=STRINGS, category="string", doi="string"))


@F.pandas_udf(_ENTRIES)
def _feed_entries(feeds: pd.Series) -> pd.Series:
    def own(n, tag):
        found = n.find(tag)
        return found.text().strip() or None if found is not None else None

    def entries(xml):
        root = parse_xml(xml)
        out = []
        for e in [n for n in root.nodes() if n.tag == "entry"] if root is not None else []:
            names = [own(a, "name") for a in e.nodes() if a.tag == "author"]
            category = e.find("primary_category")
            out.append(
                {"raw_id": own(e, "id"), "title": own(e, "title"), "summary": own(e, "summary"), "published": own(e, "published"), "authors": [n for n in names if n],
                 "category": category.get("term") if category is not None else None, "doi": own(e, "doi")}
            )
        return out

    return feeds.map(entries)


def arxiv_metadata(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """Bibliographic rows of a feed's entries, in their order as `place`."""
    rows = feeds.select(F.posexplode(_feed_entries(column)).alias("place", "e")).withColumn("i", entry_id(F.coalesce("e.raw_id", F.lit(""))))
    e, aid = F.col("e"), F.col("i.id")
    found = {
        "doi": arxiv_doi(aid), "version": F.col("i.version"), "server": F.lit("arxiv"), "title": collapse(e["title"]), "authors": e["authors"],
        "date": F.try_to_date(F.substring(e["published"], 1, 10), "yyyy-MM-dd"), "category": e["category"], "abstract": collapse(e["summary"]),
        "published_doi": e["doi"], "provenance": provenance(source="arxiv_api", arxiv_id=aid),
    }
    none = F.lit(None)
    return rows.select(*[found.get(f.name, none).cast(f.dataType).alias(f.name) for f in PREPRINT], "place")


def arxiv_hits(feeds: DataFrame, column: str = "xml") -> DataFrame:
    p = arxiv_metadata(feeds, column)
    url = F.concat(F.lit("https://arxiv.org/abs/"), F.col("provenance")["arxiv_id"])
    return _rows(p, SEARCH_HIT, title=F.col("title"), doi=F.col("doi"), source=F.lit("arxiv_api"), snippet=F.substring("abstract", 1, 300), oa_url=url, has_fulltext=F.lit(True))


def detail_versions(pages: DataFrame, column: str = "json", server: str = "server") -> DataFrame:
    """Bibliographic rows of all versions, `place` being their order as served."""
    return _details(_served(pages, column, server).select(server, F.posexplode("c").alias("place", "e")), server)


def _served(pages: DataFrame, column: str, server: str) -> DataFrame:
    return pages.select(server, F.from_json(column, f"collection array<struct<{_DETAIL}>>")["collection"].alias("c"))


def _details(rows: DataFrame, server: str) -> DataFrame:
    e = F.col("e")
    published = F.when(~F.coalesce(e["published"], F.lit("")).isin("", "NA", "na"), e["published"])
    found = {
        "doi": F.coalesce(e["doi"], F.lit("")), "version": F.when(e["version"].rlike(r"^\d+$"), e["version"].try_cast("int")), "server": F.col(server),
        "title": empty_to_null(e["title"]), "authors": author_list(e["authors"]), "date": F.try_to_date(empty_to_null(e["date"]), "yyyy-MM-dd"),
        "category": empty_to_null(e["category"]), "abstract": empty_to_null(e["abstract"]), "license": parse_license(e["license"]), "published_doi": published,
        "provenance": F.create_map(F.lit("source"), F.lit("biorxiv_api"), F.lit("server"), F.col(server)),
    }
    return rows.select(*[found[f.name].cast(f.dataType).alias(f.name) for f in PREPRINT], "place")


def latest_details(versions: DataFrame) -> DataFrame:
    """The version of each DOI served last; biorxiv's if both servers have it."""
    return _served_last(versions).drop("place")


def _served_last(rows: DataFrame, server: str = "server") -> DataFrame:
    w = Window.partitionBy("doi").orderBy(F.col(server) != "biorxiv", F.desc("place"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: In pages of up to so many entries, those with a later one of their DOI are left out before anything is moved.
CUT_ENTRIES = 200


def latest_of_pages(pages: DataFrame, column: str = "json", server: str = "server") -> DataFrame:
    """latest_details(detail_versions(pages)), but what is derived from an entry is derived for the last ones only."""
    doi = lambda e: F.coalesce(e["doi"], F.lit(""))
    entries = F.transform("c", lambda e, i: F.struct(i.alias("place"), e.alias("e")))
    again = lambda x: F.exists(F.slice("c", x["place"] + 2, F.size("c")), lambda e: doi(e) == doi(x["e"]))
    last = F.filter(entries, lambda x: (F.size("c") > CUT_ENTRIES) | ~again(x))
    rows = _served(pages, column, server).select(server, F.explode(last).alias("x")).select(server, "x.*").withColumn("doi", doi(F.col("e")))
    return _details(_served_last(rows, server).drop("doi"), server).drop("place")


def details_window(versions: DataFrame, server: str, since: dt.date, until: dt.date) -> DataFrame:
    """Versions a server got in a window of days, both ends included."""
    return versions.where((F.col("server") == server) & in_window("date", since, until))


# full texts


def epmc_fulltext(payloads: DataFrame) -> DataFrame:
    """Document rows of (doi, version, ppr_id, url, xml); those without text are left out."""
    rows = payloads.withColumn("parsed", parsed("xml", "jats")).where(has_content(F.col("parsed.sections"), F.col("parsed.abstract")))
    return build_fulltext(rows, source="europepmc", doi=F.col("doi"), version=F.col("version"), server=detect_server("xml"), raw_ref=F.col("url"), provenance=provenance(source="europepmc", europepmc_id=F.col("ppr_id"))).drop("xml", "url", "ppr_id")


def archive_keys(files: DataFrame, since: dt.date | None = None, key: str = "key", include_back_content: bool = False) -> DataFrame:
    """Listed archives: current months from `since` on (folders that aren't months stay), undated batches on request."""
    k = F.col(key)
    folder = F.when(F.size(F.split(k, "/")) > 2, F.split(k, "/")[1])
    current = k.startswith("Current_Content/") & folder_since(F.coalesce(folder, F.lit("")), since)
    return files.where(k.endswith(".meca") & (current | (k.startswith("Back_Content/") if include_back_content else F.lit(False))))


def archive_fulltext(files: DataFrame, bucket: str, server: str) -> DataFrame:
    """Document rows of archives (key, content); such without article, or with neither DOI nor sections, are left out."""
    rows = files.withColumn("parsed", parsed_archive("content")).drop("content").where("(parsed.doi is not null and parsed.doi != '') or size(parsed.sections) > 0")
    meta = {"server": F.lit(server), "raw_ref": F.concat(F.lit(f"s3://{bucket}/"), "key"), "provenance": provenance(source="biorxiv_s3", s3_key=F.col("key"))}
    return build_fulltext(rows, source="biorxiv_s3", **meta)


def archive_lookup(files: DataFrame, requests: DataFrame, bucket: str, server: str, max_scan: int | None = None) -> DataFrame:
    """Document rows of requested (doi, version): only archives of the DOIs' posting months are opened.

    `files` lists archives, with their bytes or without; such without are pruned before they are opened.
    DOIs without a date look in all months, those with one in theirs alone. `max_scan` limits the archives
    opened for a single request."""
    asked = requests.select(F.col("doi").alias("_doi"), F.col("version").alias("_v"), month_folder(doi_posting_date("doi")).alias("_m")).dropDuplicates(["_doi"])
    months = [r["_m"] for r in asked.select("_m").distinct().collect()]  # one row a month
    listed, parts = archive_keys(files), []
    dated = [m for m in months if m is not None]
    for wanted, rows in ((asked.where("_m is not null"), listed.where(F.split("key", "/")[1].isin(dated)) if dated else None), (asked.where("_m is null"), listed if None in months else None)):
        if rows is not None:
            rows = rows.orderBy("key").limit(max_scan) if max_scan is not None else rows
            wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_REQUESTS else wanted
            found = archive_fulltext(opened(rows), bucket, server)
            parts.append(found.join(wanted, (F.col("doi") == F.col("_doi")) & (F.col("_m").isNull() | F.col("_m").eqNullSafe(F.split("key", "/")[1]))).drop("_m"))
    if not parts:
        return archive_fulltext(opened(listed.limit(0)), bucket, server).drop("key")
    found = reduce(DataFrame.unionByName, parts)
    first = Window.partitionBy("doi").orderBy("key")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("version", F.coalesce("_v", "version")).drop("_n", "_doi", "_v", "key")


def arxiv_fulltext(native: DataFrame, mirror: DataFrame, pages: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """Document rows of LaTeXML pages (arxiv_id, version, url, html): the native page if it has text, else the mirror's.

    `pages` (arxiv_id, html) are abstract pages, for the licence; `meta` are bibliographic rows."""
    both = native.withColumn("backend", F.lit("native")).unionByName(mirror.withColumn("backend", F.lit("ar5iv")), allowMissingColumns=True)
    rows = both.withColumn("parsed", parsed("html", "latexml")).drop("html").where(has_content(F.col("parsed.sections"), F.col("parsed.abstract")))
    w = Window.partitionBy("arxiv_id").orderBy(F.col("backend") != "native")
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    link = pages.select("arxiv_id", licence_link("html").alias("_l")) if pages is not None else rows.select("arxiv_id", F.lit(None).cast("string").alias("_l"))
    rows = rows.join(link.dropDuplicates(["arxiv_id"]), "arxiv_id", "left")
    if meta is None:
        meta = rows.sparkSession.createDataFrame([], PREPRINT)
    side = meta.select(F.col("doi").alias("_doi"), *[F.col(c).alias(f"_{c}") for c in ("version", "authors", "date", "category", "published_doi")]).dropDuplicates(["_doi"])
    rows = rows.withColumn("_d", arxiv_doi("arxiv_id")).join(side, F.col("_d") == F.col("_doi"), "left")
    authors = F.when(F.size("parsed.authors") > 0, F.col("parsed.authors")).otherwise(F.coalesce("_authors", F.array().cast("array<string>")))
    out = build_fulltext(
        rows, source="arxiv_html", doi=F.col("_d"), server=F.lit("arxiv"), version=F.coalesce(F.col("version"), F.col("_version")), authors=authors, license=parse_license("_l"), date=F.col("_date"),
        category=F.col("_category"), published_doi=F.col("_published_doi"), raw_ref=F.col("url"), provenance=provenance(source="arxiv_html", arxiv_id=F.col("arxiv_id"), url=F.col("url"), backend=F.col("backend")),
    )
    return out.select(*[c for c in out.columns if not c.startswith("_") and c not in ("url", "backend")])


def journal_fulltext(pages: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Document rows of journal pages (doi, server, version, url, html); the served version is read from the URL."""
    rows = pages.withColumn("parsed", parsed("html", "journal_page")).drop("html").where(has_content(F.col("parsed.sections"), F.col("parsed.abstract")))
    served = F.coalesce(F.col("version"), F.regexp_extract("url", r"/content/\S*?v(\d+)", 1).try_cast("int"))
    own = F.coalesce(empty_to_null("parsed.doi"), F.col("doi"))
    if meta is None:
        meta = rows.sparkSession.createDataFrame([], PREPRINT)
    side = meta.select(F.col("doi").alias("_doi"), *[F.col(c).alias(f"_{c}") for c in ("license", "date", "category", "published_doi")]).dropDuplicates(["_doi"])
    rows = rows.withColumns({"_own": own, "_served": served}).join(side, F.col("_own") == F.col("_doi"), "left")
    out = build_fulltext(
        rows, source="biorxiv_html", doi=F.col("_own"), server=F.coalesce("server", F.lit("biorxiv")), version=F.col("_served"), license=F.coalesce(F.col("_license"), parse_license(F.lit(""))), date=F.col("_date"),
        category=F.col("_category"), published_doi=F.col("_published_doi"), raw_ref=F.col("url"), provenance=provenance(source="biorxiv_html", url=F.col("url"), version=F.col("_served")),
    )
    return out.select(*[c for c in out.columns if not c.startswith("_") and c != "url"])


_KEY = r"((?:Current|Back)_Content/.*)$"


def list_archives(spark: SparkSession, root: str, since: dt.date | None = None, include_back_content: bool = True) -> DataFrame:
    """(key, path, length) of the archives below a folder; month folders before `since` aren't even listed, and no archive is opened."""
    folders = []
    for top in ("Current_Content", "Back_Content") if include_back_content else ("Current_Content",):
        fs, p = file_system(spark, f"{root.rstrip('/')}/{top}")
        for f in fs.listStatus(p) if fs.exists(p) else []:  # one entry a month or batch
            date = parse_month(f.getPath().getName()) if top == "Current_Content" else None
            if since is None or date is None or date >= since.replace(day=1):
                folders.append(f.getPath().toString())
    if not folders:
        return spark.createDataFrame([], "key string, path string, length bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.meca").option("recursiveFileLookup", "true").load(folders)
    return files.select(F.regexp_extract("path", _KEY, 1).alias("key"), "path", "length")


def opened(files: DataFrame) -> DataFrame:
    """The listed archives with their bytes; only these are read. Rows that have `content` are as they are.

    The paths go through the driver, as those of any scan do."""
    if "content" in files.columns:
        return files
    spark = files.sparkSession
    paths = [r.path for r in files.select("path").distinct().collect()]
    if not paths:
        return files.withColumn("content", F.lit(None).cast("binary")).drop("path", "length")
    escaped = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]
    content = spark.read.format("binaryFile").load(escaped).select("path", "content")
    return files.join(content, "path").drop("path", "length")


def fetched(cache, files: DataFrame, bucket: str) -> DataFrame:
    """The listed archives with their bytes, through the cache: only what it hasn't is opened."""

    def fetch(missing: DataFrame) -> DataFrame:
        return opened(missing.select("_key", "path", "length"))

    return cache.get_or_fetch(files, [F.lit("biorxiv_s3"), F.lit(bucket), "key"], fetch).drop("path", "length")


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """(key, content) of all archives below a folder; the key is the path below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.meca").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_extract("path", _KEY, 1).alias("key"), "content")
