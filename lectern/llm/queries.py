"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from .bagminhash import near_duplicates
from .bpe import encode_decode
from .embedding import EMBEDDING_SQL, QUERY_THRESHOLD, near_classes
from .exact_dedup import EXACT_SQL, exact_duplicates
from .kneser_ney import quality
from .line_dedup import LINE_DEDUP_SQL, line_dedup
from .masked_lm import pseudo_likelihood
from .mixing import WHOLE, mix_sources
from .toxicity import toxicity
from .url_filter import url_filter, url_sql


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def queries():
    return {
        "op1_line_dedup": lambda s, d: line_dedup(_read(s, d, "documents")),
        "op2_toxicity": lambda s, d: toxicity(_read(s, d, "documents"), _read(s, d, "labels")),
        "op3_mix_sources": lambda s, d: mix_sources(_read(s, d, "documents"), WHOLE),
        "op4_exact_dedup": lambda s, d: exact_duplicates(_read(s, d, "documents")),
        "op5_bagminhash": lambda s, d: near_duplicates(_read(s, d, "documents")),
        "op6_embedding_classes": lambda s, d: near_classes(_read(s, d, "embeddings"), threshold=QUERY_THRESHOLD),
        "op7_masked_lm": lambda s, d: pseudo_likelihood(_read(s, d, "documents")),
        "op8_url_filter": lambda s, d: url_filter(_read(s, d, "pages")),
        "op9_kneser_ney": lambda s, d: quality(_read(s, d, "documents"), _read(s, d, "labels")),
        "op10_bpe": lambda s, d: encode_decode(_read(s, d, "documents")),
    }


def oracle_sql():
    return {"op1_line_dedup": LINE_DEDUP_SQL, "op4_exact_dedup": EXACT_SQL, "op6_embedding_classes": EMBEDDING_SQL, "op8_url_filter": url_sql()}
