"""Exact deduplication by progressive refinement: length, then a prefix hash, then a full hash.

The first pass counts documents by length; the second counts (length, prefix hash) among lengths that
occur twice; only documents whose (length, prefix hash) occurs twice have their content hashed in
full. All other rows pass through without being shuffled. The set of surviving keys is broadcast
while it is small (BROADCAST_KEYS, counted first); beyond that the surviving keys are joined by hash.

Defined cases
- Texts are equal when their characters are. Empty texts equal each other; a null text equals nothing.
- Of each group the row with the smallest id stays (a null id sorts last; ties by any one row).
- exact_duplicates lists (doc_id, duplicate_of) for each row whose id differs from the kept id; rows
  that repeat the kept id too are dropped by exact_dedup but aren't pairs.
- exact_dedup returns all columns of its input, also such as share a name with ours. An empty table
  gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, staged

#: So many surviving (length, prefix hash) keys, 16 bytes each, are broadcast at most.
BROADCAST_KEYS = 2_000_000


def _survivors(docs: DataFrame, text_col: str, prefix: int, broadcast_keys: int) -> DataFrame:
    """Keys (zl, zp) that occur more than once; broadcast-hinted while they are few."""
    text = F.col(text_col)
    narrow = docs.where(text.isNotNull()).select(F.length(text).alias("zl"), F.xxhash64(F.substring(text, 1, prefix)).alias("zp"))
    lengths = narrow.groupBy("zl").count().where("count > 1").select("zl")
    keys = staged(narrow.groupBy("zl", "zp").count().where("count > 1").join(lengths, "zl", "left_semi").select("zl", "zp"), "keys")
    return F.broadcast(keys) if keys.count() <= broadcast_keys else keys


def _marked(docs: DataFrame, text_col: str, prefix: int, broadcast_keys: int, cols: list[F.Column]) -> DataFrame:
    text = F.col(text_col)
    keys = _survivors(docs, text_col, prefix, broadcast_keys).withColumn("zs", F.lit(True))
    keyed = docs.select(*cols, F.length(text).alias("zl"), F.xxhash64(F.substring(text, 1, prefix)).alias("zp"), text.alias("zt"))
    return keyed.join(keys, ["zl", "zp"], "left").withColumn("zs", F.coalesce("zs", F.lit(False)) & F.col("zt").isNotNull())


def _full(text: str = "zt") -> F.Column:
    return F.sha2(F.col(text), 256)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, duplicate_of) for every row that exact_dedup drops under another id than the kept one."""
    need(docs, id_col, text_col)
    rows = _marked(docs, text_col, prefix, broadcast_keys, [F.col(id_col).alias("zi")]).where("zs").select("zi", "zl", _full().alias("zh"))
    kept = rows.groupBy("zl", "zh").agg(F.min("zi").alias("zk"), F.count(F.lit(1)).alias("zn")).where("zn > 1").drop("zn")
    pairs = rows.join(kept, ["zl", "zh"]).where(~F.col("zi").eqNullSafe(F.col("zk")))
    return pairs.select(F.col("zi").alias("doc_id"), F.col("zk").alias("duplicate_of"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The documents without exact copies, all columns; the cases are defined above."""
    need(docs, id_col, text_col)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("zr")
    rows = _marked(docs, text_col, prefix, broadcast_keys, [whole, F.col(id_col).alias("zi")])
    alone = rows.where("not zs").select("zr")
    best = rows.where("zs").groupBy("zl", _full().alias("zh")).agg(F.min_by("zr", F.struct(F.col("zi").isNull(), F.col("zi"))).alias("zr")).select("zr")
    return alone.unionByName(best).select("zr.*")


EXACT_SQL = """
SELECT doc_id, keep AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep FROM documents WHERE text IS NOT NULL)
WHERE doc_id IS DISTINCT FROM keep
"""
