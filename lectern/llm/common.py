"""Shared pieces of the training-data operators: staged tables, Arrow access to text, numpy word kernels.

The kernels work on the UTF-8 buffer of an Arrow string column, so no Python string is made per row.
A word is a maximal run of ASCII letters and digits and of any non-ASCII characters, case-folded for
ASCII and the Latin-1 letters. Words are known by a 64-bit hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import file_system, release, scratch_dir

#: Text is worked on in pieces of about so many bytes; a longer document is one piece.
PIECE = 1 << 20

U64 = np.uint64
_K1, _K2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts its lineage and outlives executors.

    The folder is deleted when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(schema).parquet(path)
    out._staged_at = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    path = getattr(df, "_staged_at", None)
    if path:
        fs, p = file_system(df.sparkSession, path)
        fs.delete(p, True)


def row_hash(text: str) -> F.Column:
    """A hash of a text column that tells rows of one id apart; null has its own value."""
    return F.xxhash64(F.col(text), F.lit(7))


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


# memory of the Python workers

def tidy(run: Callable) -> Callable:
    """The function of an Arrow map, releasing memory now and then and at its end."""

    def tidied(batches):
        for k, out in enumerate(run(batches)):
            yield out
            if k % 4 == 3:
                release()
        release()

    return tidied


# numpy kernels


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _K1
    x ^= x >> U64(27)
    x *= _K2
    x ^= x >> U64(31)
    return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_R = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pow: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n + 1:
        size = max(n + 1, PIECE + (PIECE >> 2))
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _pow[k] = np.cumprod(p, dtype=U64)
    return _pow[0], _pow[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (rows + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)
    o = o[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def pieces(offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about `limit` bytes, at least one row each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def folded(data: np.ndarray) -> np.ndarray:
    b = _FOLD[data]
    if len(b) > 1 and (b >= 128).any():
        m = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
        b[m] += 0x20
    return b


def spans(flag: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, cut where a row ends."""
    n = len(flag)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = flag[:-1]
    inner = offs[1:-1]
    prev[inner[inner < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    inner = inner[inner > 0] - 1
    after[inner] = False
    return np.flatnonzero(flag & ~prev), np.flatnonzero(flag & ~after) + 1


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial sum over the buffer."""
    p, inv = _powers(len(b))
    c = np.zeros(len(b) + 1, U64)
    np.cumsum(_R[b] * p[: len(b)], out=c[1:])
    h = (c[end] - c[start]) * inv[start]
    return mix(h + (end - start).astype(U64) * _K2)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word and the word offsets of the rows."""
    b = folded(data)
    start, end = spans(_WORD[b], offs)
    return span_hashes(b, start, end), start, end, np.searchsorted(start, offs)


def word_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(words(b, np.array([0, len(b)]))[0][0])


def owners(offsets: np.ndarray) -> np.ndarray:
    """The row number of every item, from the item offsets of the rows."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and their offsets by row; a row of 1 to n-1 words has one, of them all."""
    counts = np.diff(offsets)
    width = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
    row = owners(out)
    first = offsets[:-1][row] + (np.arange(out[-1]) - out[:-1][row])
    last = offsets[1:][row]
    g = np.zeros(len(first), U64)
    for k in range(n):
        at = first + k
        ok = at < last
        g = mix(g + np.where(ok, h[np.minimum(at, max(len(h) - 1, 0))], U64(1)) if len(h) else g)
    return g, out


def bags(g: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, item) with counts, sorted by row and item."""
    row = owners(offsets)
    if not len(g):
        return row, g, np.zeros(0, np.int64)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.empty(len(g), bool)
    new[0] = True
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], g[at], np.diff(np.append(at, len(g)))
