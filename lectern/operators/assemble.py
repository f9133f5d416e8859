"""From a parsed record and metadata to the document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.licenses import parse_license, raw_text
from ..schemas import FULLTEXT

_EMPTY_MAP = "map<string,string>"


def provenance(**parts: Column | str | None) -> Column:
    """A string map of the given parts; null values are left out."""
    pairs = [F.struct(F.lit(k).alias("key"), (F.lit(v) if isinstance(v, str) else v).cast("string").alias("value")) for k, v in parts.items() if v is not None]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())).cast(_EMPTY_MAP)


def numbered_sections(abstract: Column, sections: Column) -> Column:
    """The abstract, if there is one, as the first section, then the body; ids and order run from 1."""
    one = F.struct(F.lit("abstract").alias("kind"), F.lit("Abstract").alias("title"), abstract.alias("text"))
    body = F.transform(F.coalesce(sections, F.array().cast("array<struct<order:int,kind:string,title:string,text:string>>")), lambda s: F.struct(s["kind"].alias("kind"), s["title"].alias("title"), s["text"].alias("text")))
    both = F.concat(F.filter(F.array(one), lambda s: F.coalesce(s["text"], F.lit("")) != ""), body)
    return F.transform(
        both,
        lambda s, i: F.struct((i + 1).cast("string").alias("id"), s["kind"].alias("kind"), s["title"].alias("title"), s["text"].alias("text"), (i + 1).cast("int").alias("order")),
    )


def build_fulltext(df: DataFrame, parsed: str = "parsed", source: str | Column | None = None, **meta: Column) -> DataFrame:
    """Document rows from rows with a parsed record; `meta` gives doi, server, version, raw_ref and so on."""
    p = F.col(parsed)
    given = {
        "doi": F.coalesce(p["doi"], F.lit("")),
        "version": F.lit(None),
        "server": F.lit("biorxiv"),
        "title": p["title"],
        "authors": F.coalesce(p["authors"], F.array().cast("array<string>")),
        "date": F.lit(None),
        "category": F.lit(None),
        "abstract": p["abstract"],
        "license": parse_license(raw_text(p["license_raw"]["href"], p["license_raw"]["text"])),
        "published_doi": F.lit(None),
        "provenance": F.create_map().cast(_EMPTY_MAP),
        "sections": numbered_sections(p["abstract"], p["sections"]),
        "retrieved_from": F.lit(source) if isinstance(source, str) else source if source is not None else F.lit(None),
        "raw_ref": F.lit(None),
    } | meta
    keep = [c for c in df.columns if c not in given and c != parsed]
    return df.select(*keep, *[given[f.name].cast(f.dataType).alias(f.name) for f in FULLTEXT])


def has_content(sections: Column | str, abstract: Column | str) -> Column:
    """Whether a parsed record has a section or an abstract."""
    s = F.col(sections) if isinstance(sections, str) else sections
    a = F.col(abstract) if isinstance(abstract, str) else abstract
    return (F.coalesce(F.size(s), F.lit(0)) > 0) | (F.coalesce(a, F.lit("")) != "")


def rebuilt_abstract(index: Column | str) -> Column:
    """Text from an inverted index of word -> positions, by position then word; null if it is empty."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    some = F.exists(F.map_values(index), lambda v: F.size(v) > 0)  # not by the entries, which would be made twice
    return F.when(some, F.array_join(F.transform(F.sort_array(entries), lambda x: x["w"]), " "))


def markdown(df: DataFrame) -> DataFrame:
    """(doi, markdown): title, bold metadata, then each section under its title or kind."""
    licence = F.coalesce(F.col("license.spdx_id"), F.nullif(F.col("license.raw"), F.lit("")), F.lit("unknown"))
    flag = F.when(F.col("license.redistributable"), "True").otherwise("False")
    lines = F.concat_ws(
        "  \n",
        F.concat(F.lit("**DOI:** "), "doi"),
        F.concat(F.lit("**Server:** "), "server"),
        F.concat(F.lit("**Version:** "), F.col("version").cast("string")),
        F.when(F.size("authors") > 0, F.concat(F.lit("**Authors:** "), F.array_join("authors", ", "))),
        F.when(F.col("license").isNotNull(), F.concat(F.lit("**License:** "), licence, F.lit(" (redistributable="), flag, F.lit(")"))),
        F.concat(F.lit("**Retrieved from:** "), "retrieved_from"),
    )
    name = lambda s: F.coalesce(F.nullif(s["title"], F.lit("")), F.initcap(s["kind"]))
    body = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("## "), name(s), F.lit("\n\n"), F.coalesce(s["text"], F.lit("")), F.lit("\n"))), "\n")
    whole = F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), "doi"), F.lit("\n\n"), lines, F.lit("\n\n"), body)
    return df.select("doi", F.concat(F.regexp_replace(whole, r"(?U)\s+$", ""), F.lit("\n")).alias("markdown"))
