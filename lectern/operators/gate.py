"""The compliance gate: the only way text goes into a corpus that is to be shared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("analysis", "redistribution")
REMINDER = "Text and data mining terms apply: keep this corpus to your own analysis, and link back to the hosted texts. Use redistribution mode for a corpus to share."


def gate(docs: DataFrame, mode: str = "analysis", on_reminder: Callable[[str], None] | None = None) -> DataFrame:
    """Document rows with a `degraded` flag.

    In analysis mode all pass, and the reminder is given once. In redistribution mode a document whose
    licence isn't redistributable becomes a stub: no abstract, no sections, and a link back."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "analysis":
        if on_reminder:
            on_reminder(REMINDER)
        return docs.withColumn("degraded", F.lit(False))
    down = ~F.coalesce(F.col("license.redistributable"), F.lit(False))
    old = F.coalesce(F.col("provenance"), F.create_map().cast("map<string,string>"))
    link = F.coalesce(F.nullif(F.try_element_at(old, F.lit("oa_url")), F.lit("")), F.col("raw_ref"))
    added = F.map_from_entries(F.filter(F.array(F.struct(F.lit("degraded").alias("key"), F.lit("true").alias("value")), F.struct(F.lit("oa_url").alias("key"), link.alias("value"))), lambda e: e["value"].isNotNull()))
    stub = F.map_concat(F.map_filter(old, lambda k, v: ~k.isin("degraded", "oa_url")), added)
    none = F.array().cast(docs.schema["sections"].dataType)
    return docs.withColumns(
        {
            "degraded": down,
            "abstract": F.when(~down, F.col("abstract")),
            "sections": F.when(down, none).otherwise(F.col("sections")),
            "provenance": F.when(down, stub).otherwise(F.col("provenance")),
        }
    )
