"""Tokenizers by name: "ws" and "regex:<pattern>" are native expressions, "tiktoken:<encoding or rank file>" a pandas UDF.

A tokenizer gives the pieces of a text, in order and without gaps, so their concatenation is the text.
"ws" pieces are words with the white space before them, and, for the last, after it. Its counts aren't
comparable with those of byte-pair encodings.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=8)
def _encoding(name: str):
    import tiktoken

    if not os.path.exists(name):
        return tiktoken.get_encoding(name or "cl100k_base")
    with open(name, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(name), pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bpe_pieces(name: str):
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        enc = _encoding(name)

        def pieces(text):
            out, held = [], b""
            for t in enc.encode_ordinary(text or ""):
                held += enc.decode_single_token_bytes(t)
                try:  # a character may be split between tokens: its piece is that of the last of them
                    out.append(held.decode())
                    held = b""
                except UnicodeDecodeError:
                    out.append("")
            return out

        return s.map(pieces)

    return run


def pieces(text: Column | str, spec: str = "ws") -> Column:
    """array<string> of a text's pieces by the named tokenizer."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.coalesce(c, F.lit(""))
    kind, _, rest = spec.partition(":")
    if kind == "ws":
        return F.regexp_extract_all(c, F.lit(r"(?U)\s*[^\s]+(?:\s+$)?"), F.lit(0))
    if kind == "regex" and rest:
        return F.regexp_extract_all(c, F.lit(f"(?s)(?:{rest})|(?:(?!{rest}).)+"), F.lit(0))
    if kind == "tiktoken":
        return _bpe_pieces(rest)(c)
    raise ValueError(f"unknown tokenizer {spec!r}: ws, regex:<pattern> or tiktoken:<encoding or rank file>")
