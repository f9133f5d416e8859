"""Choosing among sources and versions, enriching, and resolving identifiers; set-oriented, by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import clean_doi, short_id
from ..functions.text import strip
from ..session import written

#: So many rows of a lookup table are broadcast at most; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def lookup(table: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcasting if it has few enough rows."""
    return F.broadcast(table) if table.limit(broadcast_rows + 1).count() <= broadcast_rows else table


def latest(versions: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is last in order, with all its columns."""
    others = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def enrich(docs: DataFrame, meta: DataFrame, key: str, columns: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Fill the columns that are null from a metadata row of the same key; a document without one stays as it is."""
    side = meta.select(key, *[F.col(c).alias(f"_m_{c}") for c in columns]).dropDuplicates([key])
    joined = docs.join(lookup(side, broadcast_rows), key, "left")
    filled = {c: F.coalesce(c, f"_m_{c}") for c in columns}
    return joined.withColumns(filled).drop(*[f"_m_{c}" for c in columns])


def first_source(candidates: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """For each key its row from the first source that has one, with `retrieved` and the sources `tried`."""
    names = [n for n, _ in candidates]
    rows = None
    for k, (name, df) in enumerate(candidates):
        part = df.withColumns({"_k": F.lit(k), "retrieved": F.lit(name)})
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_k")
    tried = F.slice(F.array(*map(F.lit, names)), F.lit(1), F.col("_k") + 1)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("tried", tried).drop("_n", "_k")


def staged_route(requests: DataFrame, sources: list[tuple[str, callable]], key: str = "doi") -> DataFrame:
    """Ask each source in turn for the keys still open, so that later ones only parse what earlier ones lack.

    A source is a function of the open requests that returns rows with the key; what it returns is
    written to the shared folder, so that it is asked once. Keys that none has come back with null fields."""
    open_, found, names = requests, None, []
    for name, fetch in sources:
        names.append(name)
        got = written(fetch(open_).withColumns({"retrieved": F.lit(name), "tried": F.array(*map(F.lit, names))}), "source")
        found = got if found is None else found.unionByName(got, allowMissingColumns=True)
        open_ = open_.join(got.select(key), key, "left_anti")
    missing = open_.select(key).withColumn("tried", F.array(*map(F.lit, names)))
    return found.unionByName(missing, allowMissingColumns=True)


def version_eligible(wanted: Column, newest: Column) -> Column:
    """Whether a source that only has the latest version can serve the wanted one."""
    return wanted.isNull() | newest.isNull() | (wanted == newest)


def resolve(inputs: DataFrame, ppr: DataFrame, details: DataFrame, works: DataFrame, column: str = "input") -> DataFrame:
    """(input, doi, openalex_id, ppr_id, server, published_doi) by lookups of (doi, ppr_id), (doi, server, published_doi), (openalex_id, doi)."""
    s = strip(column)
    is_doi = s.startswith("10.") | s.contains("doi.org/")
    short = short_id(s)
    is_work = ~is_doi & F.upper(short).startswith("W")
    rows = inputs.select(
        F.col(column).alias("input"),
        F.when(is_doi, F.when(s.contains("doi.org/"), short).otherwise(s)).alias("_d"),
        F.when(is_work, short).alias("openalex_id"),
    )
    rows = rows.join(lookup(works.select("openalex_id", clean_doi("doi").alias("_w")).dropDuplicates(["openalex_id"])), "openalex_id", "left")
    rows = rows.join(lookup(ppr.select(F.col("doi").alias("_d"), "ppr_id").dropDuplicates(["_d"])), "_d", "left")
    rows = rows.join(lookup(details.select(F.col("doi").alias("_d"), "server", "published_doi").dropDuplicates(["_d"])), "_d", "left")
    return rows.select("input", F.coalesce("_d", "_w").alias("doi"), "openalex_id", "ppr_id", "server", "published_doi")
