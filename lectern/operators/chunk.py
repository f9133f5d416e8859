"""Overlapping token windows over sections, or over whole documents across sections.

Windows begin every max(1, size - overlap) tokens and stop with the first that reaches the end, so a
text of n tokens has 1 + ceil(max(0, n - size) / step). Each window slices its own tokens from its
text's; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import chunk_id
from ..functions.text import is_blank
from .tokenizers import pieces


def window_count(n: Column, size: int, overlap: int) -> Column:
    step = max(1, size - overlap)
    return F.when(n > 0, 1 + F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")).otherwise(0)


def windows(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 64, tokenizer: str = "ws") -> DataFrame:
    """The rows, one for each window: idx, chunk_text, token_count, char_start, char_end."""
    step = max(1, size - overlap)
    keep = df.columns
    with_pieces = df.withColumn("_p", pieces(text, tokenizer)).withColumn("_n", F.size("_p"))
    count = window_count(F.col("_n"), size, overlap)
    numbers = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
    # the lengths of the strides between window starts give every start by a sum over few numbers
    strides = F.transform(numbers, lambda i: F.length(F.array_join(F.slice("_p", i * step + 1, F.lit(step)), "")))
    rows = with_pieces.withColumn("_s", strides)
    made = F.transform(
        numbers,
        lambda i: F.struct(
            i.alias("idx"),
            F.array_join(F.slice("_p", i * step + 1, F.lit(size)), "").alias("chunk_text"),
            F.least(F.lit(size), F.col("_n") - i * step).cast("int").alias("token_count"),
            F.aggregate(F.slice("_s", F.lit(1), i), F.lit(0), lambda a, x: a + x).cast("int").alias("char_start"),
        ),
    )
    # windows are cut before they are exploded, so that no row carries the tokens of its whole text
    # (a filter on the tokens would be pushed below them and cut the text twice)
    out = rows.select(*keep, F.explode(F.when(F.col("_n") > 0, made)).alias("_w")).select(*keep, "_w.*")
    return out.withColumn("char_end", (F.col("char_start") + F.length("chunk_text")).cast("int"))


def _license() -> Column:
    none = F.struct(F.lit("").alias("raw"), F.lit(None).cast("string").alias("spdx_id"), F.lit(False).alias("redistributable"), F.lit(True).alias("requires_attribution"))
    return F.coalesce(F.col("license"), none)


def _chunks(rows: DataFrame, part: Column, kind: Column) -> DataFrame:
    return rows.select(
        *[c for c in rows.columns if c == "target_id"],
        "doi",
        "version",
        chunk_id("doi", "version", part, "idx").alias("chunk_id"),
        kind.alias("section_kind"),
        F.col("chunk_text").alias("text"),
        "token_count",
        "char_start",
        "char_end",
        _license().alias("license"),
        F.col("retrieved_from").alias("source"),
    )


def chunk_fulltext(docs: DataFrame, size: int = 512, overlap: int = 64, tokenizer: str = "ws", cross_section: bool = False) -> DataFrame:
    """Chunk rows of document rows; blank sections give none. Across sections, a chunk has the kind its start lies in."""
    base = [c for c in ("target_id", "doi", "version", "license", "retrieved_from") if c in docs.columns]
    if not cross_section:
        rows = docs.select(*base, F.explode("sections").alias("s")).where(~is_blank(F.col("s.text"))).select(*base, F.col("s.order").alias("order"), F.col("s.kind").alias("kind"), F.col("s.text").alias("t"))
        return _chunks(windows(rows, "t", size, overlap, tokenizer), F.col("order"), F.col("kind"))
    live = F.filter("sections", lambda s: ~is_blank(s["text"]))
    rows = docs.select(*base, live.alias("live"), F.col("sections")[0]["kind"].alias("first")).where(F.size("live") > 0)
    # (start, end, kind) of each section in the text joined by blank lines
    none = F.array().cast("array<struct<a:int,b:int,kind:string>>")
    begin = lambda acc: F.when(F.size(acc) == 0, F.lit(0)).otherwise(F.element_at(acc, -1)["b"] + 2)
    spans = F.aggregate("live", none, lambda acc, s: F.concat(acc, F.array(F.struct(begin(acc).cast("int").alias("a"), (begin(acc) + F.length(s["text"])).cast("int").alias("b"), s["kind"].alias("kind")))))
    rows = rows.withColumn("spans", spans).withColumn("t", F.array_join(F.transform("live", lambda s: s["text"]), "\n\n"))
    found = windows(rows.drop("live"), "t", size, overlap, tokenizer)
    at = F.filter("spans", lambda s: (s["a"] <= F.col("char_start")) & (F.col("char_start") < s["b"]))
    return _chunks(found, F.lit("x"), F.coalesce(F.get(at, F.lit(0))["kind"], F.col("first")))
