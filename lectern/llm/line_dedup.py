"""Line deduplication over a corpus: keep the first occurrence of every line.

Line hashes are range-partitioned with a secondary sort by document and position, so one streaming
pass over each partition sees the occurrences of a line in order and keeps the first. The range key
is the whole (hash, document, position), so a line with very many copies spreads over several
partitions; where a partition begins with the line its predecessor ended with, its first row is
corrected from the partitions' edge rows, two to a partition. No text is shuffled or returned: a
document comes back as the run lengths of its keep bitmap.

Defined cases
- Ids are of any type that has an order. Documents are ordered by id, nulls first, then by a hash of their text. Rows that repeat both id
  and text are one document and give one row.
- A line that is blank (white space only) is always kept and is never a first occurrence of anything.
- A null text has no lines: n_lines 0 and an empty bitmap. An empty text is one blank line.
- keep_runs lists run lengths in turn, kept lines first: "3,1,2" keeps three, drops one, keeps two;
  a document whose first line is dropped begins with "0".
- Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, row_hash, staged, tidy

_FLAGS = "doc {kind}, th bigint, pos int, keep boolean, part int, edge string, h1 bigint, h2 bigint"


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    last: tuple[int, int] | None = None
    began, ids = False, pa.int64()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        doc, th, pos, c1, c2 = (batch.column(k) for k in range(5))
        ids = doc.type
        live = c1.is_valid().to_numpy(zero_copy_only=False)
        h1 = c1.fill_null(0).to_numpy()
        h2 = c2.fill_null(0).to_numpy()
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | ~live[:-1]
        if last is not None and live[0] and last == (int(h1[0]), int(h2[0])):
            new[0] = False
        keep = new | ~live
        edge = np.full(n, None, dtype=object)
        if not began and live.any():
            edge[int(np.argmax(live))] = "head"  # nulls sort first, so this is the first hash of the partition
            began = True
        if live[-1]:
            last = (int(h1[-1]), int(h2[-1]))
        yield pa.RecordBatch.from_arrays(
            [doc, th, pos, pa.array(keep), pa.array(np.full(n, part, np.int32)), pa.array(edge, pa.string()), c1, c2],
            ["doc", "th", "pos", "keep", "part", "edge", "h1", "h2"],
        )
    if last is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], ids), pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([None], pa.bool_()),
             pa.array([part], pa.int32()), pa.array(["tail"]), pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())],
            ["doc", "th", "pos", "keep", "part", "edge", "h1", "h2"],
        )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep bitmaps of the documents: (doc_id, n_lines, n_kept, keep_runs); the cases are defined above."""
    need(docs, id_col, text_col)
    base = docs.select(F.col(id_col).alias("doc"), row_hash(text_col).alias("th"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    line = F.col("line")
    live = line.rlike(r"[^\s]")
    lines = base.select("doc", "th", F.posexplode_outer("lines").alias("pos", "line")).select(
        "doc", "th", "pos", F.when(live, F.xxhash64(line)).alias("h1"), F.when(live, F.xxhash64(F.lit(11), line)).alias("h2")
    )
    key = ["h1", "h2", "doc", "th", "pos"]
    ordered = lines.repartitionByRange(*key).sortWithinPartitions(*key)
    flags = staged(ordered.select("doc", "th", "pos", "h1", "h2").mapInArrow(tidy(_first_occurrences), _FLAGS.format(kind=dict(base.dtypes)["doc"])), "lines")
    edges = flags.where("edge is not null").select("part", "edge", "h1", "h2").collect()  # two rows a partition
    heads = {r.part: (r.h1, r.h2) for r in edges if r.edge == "head"}
    tails = {r.part: (r.h1, r.h2) for r in edges if r.edge == "tail"}
    wrong, before = [], None
    for part in sorted(tails):
        if before is not None and heads.get(part) == before:
            wrong.append(part)
        before = tails[part]
    keep = F.col("keep")
    if wrong:
        keep = keep & ~((F.coalesce(F.col("edge"), F.lit("")) == "head") & F.col("part").isin(wrong))
    # a repeated row gives the same line twice; it is kept if either was
    per_line = flags.where("edge is null or edge = 'head'").repartition("doc", "th").groupBy("doc", "th", "pos").agg(F.max(keep).alias("keep"))
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "keep"))
    grouped = per_line.groupBy("doc", "th").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["keep"]).alias("bits"))
    return grouped.select(
        F.col("doc").alias("doc_id"),
        F.size("bits").cast("long").alias("n_lines"),
        F.size(F.filter("bits", lambda b: b)).cast("long").alias("n_kept"),
        _runs(F.col("bits")).alias("keep_runs"),
    )


def _runs(bits: F.Column) -> F.Column:
    n = F.size(bits)
    inner = F.when(n > 1, F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: bits[i] != bits[i - 1])).otherwise(F.array().cast(T.ArrayType(T.IntegerType())))
    lengths = F.zip_with(F.concat(inner, F.array(n)), F.concat(F.array(F.lit(0)), inner), lambda a, b: (a - b).cast("string"))
    return F.when(n == 0, F.lit("")).otherwise(F.concat(F.when(bits[0], F.lit("")).otherwise(F.lit("0,")), F.array_join(lengths, ",")))


def decode_runs(runs: str) -> list[bool]:
    """The keep bitmap that keep_runs stands for."""
    out: list[bool] = []
    for k, n in enumerate(runs.split(",") if runs else []):
        out += [k % 2 == 0] * int(n)
    return out


LINE_DEDUP_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, text, pos, CASE WHEN regexp_matches(line, '[^\s]') THEN
        row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS FIRST, pos) = 1 ELSE true END AS keep FROM l),
g AS (SELECT *, CASE WHEN lag(keep) OVER w IS DISTINCT FROM keep THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, text ORDER BY pos) AS grp FROM g),
r AS (SELECT doc_id, text, grp, min(pos) AS p0, bool_and(keep) AS keep, count(*) AS len FROM s GROUP BY 1, 2, 3),
j AS (SELECT doc_id, text, sum(len) AS n, sum(CASE WHEN keep THEN len ELSE 0 END) AS kept,
        CASE WHEN arg_min(keep, p0) THEN '' ELSE '0,' END || string_agg(CAST(len AS VARCHAR), ',' ORDER BY p0) AS runs FROM r GROUP BY 1, 2)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(kept, 0) AS BIGINT) AS n_kept, coalesce(runs, '') AS keep_runs
FROM d LEFT JOIN j ON d.doc_id IS NOT DISTINCT FROM j.doc_id AND d.text IS NOT DISTINCT FROM j.text
"""
