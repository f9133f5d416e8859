"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are cut into blocks of about `block_docs`, by a seeded hash, so a block is a
random part of its source. From the blocks there are and the target weights come exact block quotas:
the largest mix that repeats no block. The quotas are split over the output shards by a binary tree:
at each node the left half gets a multivariate-hypergeometric draw of the node's blocks, so every
shard gets an exact number of blocks and, in law, the sources it would get from one global shuffle.
A leaf's blocks are consecutive ranks of a seeded permutation of each source's blocks, disjoint from
all other leaves'. Within a shard the documents are ordered by a seeded hash.

A worker derives the tree from (quotas, shards, seed) alone, so only one number a source is sent out,
and documents aren't shuffled before they go to their shard. Only counts by source reach the driver.

Defined cases
- weights: by source; a source without one gets 0 and isn't drawn; a negative, non-finite or all-zero
  set is an error. Without weights, they are (documents of the source) ** alpha. WHOLE as weights takes
  every source whole: the weights are its blocks, so nothing is lost whatever the sizes.
- A null source is a source of its own, named None in weights. A null id or text is an ordinary row.
- Rows that repeat id and text fall in one block and stay together, in any order.
- A source that has rows has one block at least. Columns of other names are kept by mixed(), whatever
  they are called. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, need, row_hash

ALPHA, BLOCK_DOCS, SHARD_BLOCKS, SEED = 0.7, 4, 64, 20_231
#: Shards at most, as each worker holds a number for each source and shard; those of larger corpora hold more blocks.
MOST_SHARDS = 1 << 16
#: The draws take fewer than 10^9 blocks; blocks of larger corpora hold more documents.
MOST_BLOCKS = 900_000_000
#: Weights that take every document.
WHOLE = "whole"


def quotas(blocks: Mapping, weights: Mapping) -> dict:
    """The most blocks by source, in the proportions of the weights, that repeat none: floor(T w), T the least blocks / weight."""
    w = {s: float(weights.get(s, 0.0)) for s in blocks}
    if any(not math.isfinite(x) or x < 0 for x in w.values()) or blocks and not any(w.values()):
        raise ValueError("weights must be finite, not negative, and not all zero")
    t = min((blocks[s] / w[s] for s in blocks if w[s] > 0), default=0.0)
    return {s: min(blocks[s], max(1, math.floor(t * w[s] + 1e-9))) if w[s] > 0 else 0 for s in blocks}


def splitting_tree(quota: list[int], shards: int, seed: int) -> np.ndarray:
    """Offsets [source, shard] into each source's permuted blocks; shard k gets offsets [k, k + 1)."""
    counts = np.zeros((len(quota), shards), np.int64)
    total = int(sum(quota))
    cuts = [total * k // shards for k in range(shards + 1)]
    todo = [(0, shards, np.asarray(quota, np.int64))]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            counts[:, lo] = q
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(q, cuts[mid] - cuts[lo], method="marginals") if q.sum() else q
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return np.concatenate([np.zeros((len(quota), 1), np.int64), np.cumsum(counts, axis=1)], axis=1)


def permuted(block: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """A seeded permutation of range(n), entry by entry: an affine map whose factor is coprime to n."""
    out = np.zeros(len(block), np.int64)
    for size in np.unique(n):
        size = int(size)
        a = int(mix(np.array([seed * 2 + 1], np.uint64))[0]) % size | 1
        while math.gcd(a, size) != 1:
            a += 2
        c = int(mix(np.array([seed * 3 + 7], np.uint64))[0]) % size
        at = n == size
        out[at] = [(a * int(b) + c) % size for b in block[at]] if size > 1 << 31 else (a % size * block[at] + c) % size
    return out


_trees: dict = {}


def _tree(quota: tuple, shards: int, seed: int) -> np.ndarray:
    key = (quota, shards, seed)
    if key not in _trees:
        _trees.clear()
        _trees[key] = splitting_tree(list(quota), shards, seed)
    return _trees[key]


def _placed(docs: DataFrame, weights, alpha, block_docs, shard_blocks, seed, id_col, text_col, source_col) -> DataFrame:
    """The rows drawn, as struct zr, with shard zs and local order zo."""
    need(docs, id_col, text_col, source_col)
    found = docs.groupBy(F.col(source_col).alias("s")).count().collect()  # one row a source
    sizes = {r.s: r["count"] for r in found}
    names = sorted(sizes, key=lambda s: (s is not None, str(s)))
    block_docs = max(block_docs, math.ceil(sum(sizes.values()) / MOST_BLOCKS))
    blocks = {s: max(1, round(sizes[s] / block_docs)) for s in names}
    quota = quotas(blocks, {s: sizes[s] ** alpha for s in names} if weights is None else blocks if isinstance(weights, str) and weights == WHOLE else weights)
    total = sum(quota.values())
    shards = min(MOST_SHARDS, max(1, math.ceil(total / shard_blocks)))
    q, nb = tuple(quota[s] for s in names), np.array([blocks[s] for s in names] or [1], np.int64)

    @F.pandas_udf("int")
    def shard_of(code: pd.Series, h: pd.Series) -> pd.Series:
        c = code.to_numpy(np.int64)
        n = nb[c]
        u = mix(h.to_numpy(np.int64).astype(np.uint64) + np.uint64(seed)) >> np.uint64(11)
        block = np.minimum((u.astype(np.float64) * (n / 2.0**53)).astype(np.int64), n - 1)
        rank, tree = permuted(block, n, seed), _tree(q, shards, seed)
        out = np.full(len(c), -1, np.int32)
        for s in np.unique(c):
            at = c == s
            k = np.searchsorted(tree[s], rank[at], side="right") - 1
            out[at] = np.where(rank[at] < tree[s, -1], k, -1)
        return pd.Series(out)

    code = F.lit(None).cast("int")
    for k, s in enumerate(names):
        code = F.when(F.col(source_col).eqNullSafe(F.lit(s)), F.lit(k)).otherwise(code) if len(names) <= 64 else code
    if len(names) > 64:  # a lookup map instead of a chain of conditions; null has the first code if there is one
        known = [x for k, s in enumerate(names) if s is not None for x in (F.lit(s), F.lit(k))]
        code = F.when(F.col(source_col).isNull(), F.lit(0)).otherwise(F.element_at(F.create_map(*known), F.col(source_col)))
    h = F.xxhash64(F.col(id_col), row_hash(text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("zr"), code.alias("zc"), h.alias("zh"))
    return rows.select("zr", shard_of("zc", "zh").alias("zs"), F.xxhash64("zh", F.lit(seed)).alias("zo")).where("zs >= 0")


def mix_sources(docs: DataFrame, weights=None, alpha: float = ALPHA, block_docs: int = BLOCK_DOCS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, shard, position) of the drawn documents; text isn't shuffled."""
    rows = _placed(docs, weights, alpha, block_docs, shard_blocks, seed, id_col, text_col, source_col)
    narrow = rows.select(F.col(f"zr.`{id_col}`").alias("doc_id"), F.col(f"zr.`{source_col}`").alias("source"), F.col("zs").alias("shard"), "zo")
    w = Window.partitionBy("shard").orderBy("zo", "doc_id")
    return narrow.select("doc_id", "source", "shard", (F.row_number().over(w) - 1).alias("position"))


def mixed(docs: DataFrame, weights=None, alpha: float = ALPHA, block_docs: int = BLOCK_DOCS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The drawn documents, all columns, a shard after another and shuffled within; one shuffle of the text."""
    rows = _placed(docs, weights, alpha, block_docs, shard_blocks, seed, id_col, text_col, source_col)
    return rows.repartitionByRange("zs").sortWithinPartitions("zs", "zo").select("zr.*")
