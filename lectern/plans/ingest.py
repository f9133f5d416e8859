"""Resumable ingestion: targets that aren't in the manifest are parsed, gated and chunked; chunks are
written first, the manifest last, so a run that dies is simply run again.

A target that comes more than once is done once, and its repetitions count as skipped. A chunk is
written once: chunks whose id is in the corpus, or comes twice, are left out. The manifest counts a
document's chunks in the corpus as it is after the write, also those of a run that died.

The corpus is read only where it can hold a new chunk's id: for documents whose DOI the manifest lists
already, or for all if a run left its mark, that is, died between its two writes. So a stream of
micro-batches costs what its batches hold, besides the ids and DOIs of the manifest.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..operators.chunk import chunk_fulltext
from ..operators.gate import gate
from ..schemas import CHUNK, MANIFEST
from ..session import file_system, written


@dataclass
class Report:
    """What a run did; errors stays 0, as a failure ends the run."""

    processed: int
    skipped: int
    degraded: int
    not_found: int
    n_chunks: int
    bytes_downloaded: int = 0
    errors: int = 0

    as_dict = asdict


def manifest_path(corpus: str) -> str:
    """The manifest beside a corpus, named after it."""
    parent, _, name = corpus.rstrip("/").rpartition("/")
    stem = name.rpartition(".")[0] or name
    return f"{parent}/{stem}_manifest" if parent else f"{stem}_manifest"


def read_table(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """A table of a corpus, empty if it isn't there yet; corrupt JSON lines are left out."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    if fmt == "json":
        with_bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
        lines = spark.read.text(path).where("trim(value) != ''")
        rows = lines.select(F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
        return rows.select("r.*").where("_corrupt is null").drop("_corrupt")
    return spark.read.schema(schema).parquet(path)


def pending(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Targets that the manifest doesn't list."""
    return targets.join(manifest.select("target_id").distinct(), "target_id", "left_anti")


def new_chunks(chunks: DataFrame, corpus: DataFrame) -> DataFrame:
    """Chunks, each id once, that the corpus doesn't have."""
    return chunks.dropDuplicates(["chunk_id"]).join(corpus.select("chunk_id"), "chunk_id", "left_anti")


def collisions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n) of ids that more than one chunk claims."""
    return chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def report_of(manifest_rows: DataFrame, skipped: int, bytes_downloaded: int = 0) -> Report:
    r = manifest_rows.agg(
        F.count_if(F.col("status") != "not_found").alias("processed"),
        F.count_if(F.col("status") == "degraded").alias("degraded"),
        F.count_if(F.col("status") == "not_found").alias("not_found"),
        F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"),
    ).first()
    return Report(r.processed, skipped, r.degraded, r.not_found, r.n_chunks, bytes_downloaded)


def ingest(spark: SparkSession, targets: DataFrame, load, corpus: str, mode: str = "analysis", settings: Settings | None = None, fmt: str = "parquet", on_reminder=None, downloaded=None) -> Report:
    """Ingest targets (target_id and what `load` needs). `load` turns them into document rows that keep target_id; `downloaded` gives the bytes it fetched."""
    s = settings or Settings()
    manifest = manifest_path(corpus)
    done = read_table(spark, manifest, MANIFEST, fmt)
    todo = pending(targets.dropDuplicates(["target_id"]), done)
    skipped = targets.count() - todo.count()
    docs = written(gate(load(todo), mode, on_reminder), "documents")  # outlives executors
    chunks = chunk_fulltext(docs, s.chunk_tokens, s.chunk_overlap, s.tokenizer, s.cross_section)
    fs, mark = file_system(spark, f"{manifest}_open")
    again = docs.select("doi").distinct()
    if not fs.exists(mark) and fs.exists(file_system(spark, manifest)[1]):  # no run died: only documents of a DOI that was ingested before can have chunks in the corpus
        again = again.join(done.select(F.col("doi").alias("_doi")).distinct(), F.col("doi").eqNullSafe(F.col("_doi")), "left_semi")
    fs.create(mark, True).close()
    have = _had(again, read_table(spark, corpus, CHUNK, fmt))
    new_chunks(chunks, have).select(*CHUNK.fieldNames()).write.mode("append").format(fmt).save(corpus)
    # all distinct ids of this run's documents are in the corpus now
    counts = chunks.select("target_id", "chunk_id").distinct().groupBy("target_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    status = F.when(F.col("retrieved_from").isNull(), "not_found").when(F.col("degraded"), "degraded").otherwise("ok")
    facts = docs.select("target_id", "doi", "version", "degraded", "retrieved_from", F.col("license.spdx_id").alias("license")).dropDuplicates(["target_id"])
    rows = todo.select("target_id").join(facts, "target_id", "left").join(counts, "target_id", "left")
    rows = rows.select("target_id", "doi", "version", status.alias("status"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), "license", F.col("retrieved_from").alias("source"))
    rows = written(rows, "manifest")  # before the write, after which these targets are no longer pending
    report = report_of(rows, skipped, downloaded() if downloaded else 0)
    rows.write.mode("append").format(fmt).save(manifest)
    fs.delete(mark, False)
    return report


def _had(again: DataFrame, corpus: DataFrame) -> DataFrame:
    """Chunk ids of the corpus that documents of the DOIs `again` may share; the corpus isn't read if there are none."""
    if again.isEmpty():
        return corpus.sparkSession.createDataFrame([], "chunk_id string")
    return corpus.select("chunk_id")


def to_parquet(spark: SparkSession, json_corpus: str, out: str) -> bool:
    """Rewrite a JSON corpus as Parquet; False, and nothing written, if it is empty."""
    rows = read_table(spark, json_corpus, CHUNK, "json")
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(out)
    return True
