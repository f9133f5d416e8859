"""Near-duplicate search by BagMinHash signatures of shingle multisets.

A document is the multiset of its word bigrams. Every bigram carries a Poisson process over the
discretised weight axis, built hierarchically: one process on each dyadic interval (0,1], (1,2],
(2,4], ..., whose points are then split down to unit levels, one hash bit a step; a point counts if
its level is at most the bigram's count. Each point falls on one of `m` components, and a component's
signature is the earliest point on it, so two components agree with a probability that is exactly the
weighted Jaccard similarity of the multisets. Points are drawn up to a horizon that fills all
components; documents left with an open component draw on.

Bands of the signature give candidate pairs. Equal multisets are merged first, so large groups of
copies cost one row each. In a bucket every document is verified against the bucket's least; those
that fail are verified against all others of the bucket that they aren't already connected with, so
the groups are those of all verified candidate pairs, without a cap. Verification is the exact
weighted Jaccard of the texts.

Defined cases
- A row is known by its id and text: rows that repeat both are one document; rows of one id with
  other texts are different documents. Ids are of any type that has an order; they order groups, nulls
  first, ties by a hash of the text.
- A document of one word has that word as its only shingle; one without words (null, empty, only
  punctuation) is never a duplicate.
- near_duplicates gives (doc_id, duplicate_of), a row for each document but the least of its group.
- near_dedup returns the rows of its input, all columns, that stay; of rows that repeat id and text
  one stays, also if no other row is like them. Rows without words all stay.
- Extra columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bags, mix, need, owners, pieces, row_hash, shingles, staged, text_buffer, tidy, words
from .components import components

M, ROWS, SHINGLE, THRESHOLD = 128, 4, 2, 0.55
#: So many node keys, 16 bytes each, are broadcast at most to fetch texts or drop rows.
BROADCAST_NODES = 2_000_000

_LONG = 16.0  # expected points from which a process is drawn as one matrix


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _points(seed, length, lo, weight, horizon):
    """Yield (process, time, hash) of all accepted points up to each process's horizon."""
    expected = length * horizon

    def accepted(proc, x, h):
        level = lo[proc] + 1 + (mix(h + U64(0x51ED27)) & (length[proc] - 1).astype(U64)).astype(np.int64)
        ok = level <= weight[proc]
        return proc[ok], x[ok], h[ok]

    live = np.flatnonzero(expected <= _LONG)
    x, n = np.zeros(len(live)), 0
    while len(live):
        n += 1
        h = mix(seed[live] + U64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(_uniform(h)) / length[live]
        ok = x <= horizon[live]
        live, x, h = live[ok], x[ok], h[ok]
        yield accepted(live, x, mix(h))
    for p in np.flatnonzero(expected > _LONG):  # few: only short documents have such processes
        k = int(expected[p] + 9 * math.sqrt(expected[p]) + 12)
        h = mix(seed[p] + np.arange(1, k + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        x1 = np.cumsum(-np.log(_uniform(h)) / length[p])
        h = h[x1 <= horizon[p]]
        yield accepted(np.full(len(h), p), x1[: len(h)], mix(h))


def signatures(row: np.ndarray, item: np.ndarray, count: np.ndarray, rows: int, m: int = M) -> np.ndarray:
    """BagMinHash signatures [rows, m] of multisets given as (row, item, count); rows without items get zeros."""
    sig = np.zeros((rows, m), U64)
    if not len(row):
        return sig
    steps = 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    first = np.cumsum(steps) - steps
    j = np.arange(int(steps.sum())) - np.repeat(first, steps)
    owner, weight = np.repeat(row, steps), np.repeat(count, steps)
    length = np.where(j == 0, 1, 1 << np.maximum(j - 1, 0)).astype(np.int64)
    lo = np.where(j == 0, 0, length)
    seed = mix(np.repeat(item, steps) + j.astype(U64) * U64(0xD1342543DE82EF95))
    total = np.bincount(row, weights=count, minlength=rows)
    factor = math.log(m) + 5
    open_ = total > 0
    while open_.any():
        sel = open_[owner]
        own = owner[sel]
        horizon = m * factor / total[own]
        best = np.full(rows * m, np.inf)
        hits = [(own[p] * m + (h % U64(m)).astype(np.int64), x, h) for p, x, h in _points(seed[sel], length[sel], lo[sel], weight[sel], horizon) if len(p)]
        if hits:
            key, x, h = (np.concatenate(c) for c in zip(*hits, strict=True))
            np.minimum.at(best, key, x)
            win = x == best[key]
            sig.reshape(-1)[key[win]] = h[win]
        done = open_ & np.isfinite(best.reshape(rows, m)).all(axis=1)
        open_ &= ~done
        factor *= 2
    return sig


def _document_bags(column, size: int):
    """(first row, rows, row, item, count) of the shingle multisets, piece by piece."""
    data, offs = text_buffer(column)
    for i, j in pieces(offs):
        h, _, _, wo = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        g, go = shingles(h, wo, size)
        yield (i, j - i, *bags(g, go))


def _sign(m: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = m // rows
        for batch in batches:
            for i, n, row, item, count in _document_bags(batch.column(2), size):
                sig = signatures(row, item, count, n, m).reshape(n, bands, rows)
                b = mix(np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (n, bands)))
                for k in range(rows):
                    b = mix(b + sig[:, :, k])
                total = np.bincount(row, weights=count, minlength=n).astype(np.int64)
                fp = []
                for salt in (3, 5):
                    f = np.zeros(n, U64)
                    np.add.at(f, row, mix(item + U64(salt)) * count.astype(U64))
                    fp.append(f.view(np.int64))
                some = np.flatnonzero(total > 0)
                ids = batch.column(0).slice(i, n).take(pa.array(some))
                th = batch.column(1).slice(i, n).take(pa.array(some))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * bands + 1, bands, dtype=np.int32)), pa.array(b[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, th, pa.array(fp[0][some]), pa.array(fp[1][some]), lists], ["id", "th", "f1", "f2", "bands"])

    return run


def overlap(left, right, size: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard of the shingle multisets of two text columns, row by row."""
    out = np.zeros(len(left))
    (da, oa), (db, ob) = text_buffer(left), text_buffer(right)
    for i, j in pieces(oa + ob, 1 << 21):
        n, found = j - i, []
        for d, o in ((da, oa), (db, ob)):
            h, _, _, wo = words(d[o[i] : o[j]], o[i : j + 1] - o[i])
            found.append(bags(*shingles(h, wo, size)))
        (ra, ga, ca), (rb, gb, cb) = found
        row, item, count = np.concatenate([ra, rb]), np.concatenate([ga, gb]), np.concatenate([ca, cb])
        order = np.lexsort((item, row))
        row, item, count = row[order], item[order], count[order]
        same = np.flatnonzero((row[1:] == row[:-1]) & (item[1:] == item[:-1]))
        common = np.bincount(row[same], weights=np.minimum(count[same], count[same + 1]), minlength=n)
        both = np.bincount(row, weights=count, minlength=n)
        out[i:j] = common / np.maximum(both - common, 1)
    return out


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, size: int, broadcast_nodes: int) -> DataFrame:
    """Pairs (a, b) of representatives' numbers with whether their texts' overlap reaches the threshold: (a, b, same)."""
    numbers = pairs.select(F.col("a").alias("u")).union(pairs.select("b")).distinct()
    nodes = staged(reps.select("u", F.col("r").alias("n")).join(numbers, "u", "left_semi"), "nodes")
    few = nodes.count() <= broadcast_nodes
    texts = docs.join(F.broadcast(nodes) if few else nodes, "n").select("u", "t").dropDuplicates(["u"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = overlap(batch.column(2), batch.column(3), size) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], ["a", "b", "same"])

    left = texts.select(F.col("u").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("u").alias("b"), F.col("t").alias("tb"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(tidy(check), "a bigint, b bigint, same boolean")


def duplicate_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", m: int = M, rows: int = ROWS, size: int = SHINGLE, threshold: float = THRESHOLD, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(n, least, times): each document that is repeated or in a group, the least of its group, and its number of rows; documents are structs of id and text hash."""
    need(docs, id_col, text_col)
    if m % rows:
        raise ValueError("m must be a multiple of rows")
    base = docs.select(F.col(id_col).alias("id"), row_hash(text_col).alias("th"), F.col(text_col).alias("t"))
    kind = dict(base.dtypes)["id"]
    texts = base.select(F.struct("id", "th").alias("n"), "t")
    signed = staged(base.mapInArrow(tidy(_sign(m, rows, size)), f"id {kind}, th bigint, f1 bigint, f2 bigint, bands array<bigint>").select(F.struct("id", "th").alias("n"), "f1", "f2", "bands"), "signed")
    reps = signed.groupBy("f1", "f2").agg(F.min("n").alias("r"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("k"))
    reps = staged(reps.withColumn("u", F.monotonically_increasing_id()), "reps")  # numbers, so that what follows joins and sorts longs
    exploded = reps.select("u", F.explode("bands").alias("h"))
    shared = exploded.groupBy("h").agg(F.min("u").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").select("h", "hub")
    members = staged(exploded.join(shared, "h").select("h", "u", "hub"), "members")
    stars = members.where("u != hub").select(F.col("u").alias("a"), F.col("hub").alias("b")).distinct()
    star = staged(_verified(staged(stars, "stars"), reps, texts, threshold, size, broadcast_nodes), "verified")
    edges = star.where("same").select("a", "b")
    failed = star.where("not same")
    if not failed.isEmpty():
        labels = components(edges)  # what the stars already connect needs no further look
        open_ = members.join(failed.select(F.col("a").alias("u"), F.col("b").alias("hub")), ["u", "hub"], "left_semi").select("h", "u")
        label = lambda of: labels.select(F.col("a").alias(of), F.col("b").alias(f"{of}_l"))
        pairs = open_.join(members.where("u != hub").select("h", F.col("u").alias("v")), "h").where("u != v")
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        pairs = pairs.join(label("u"), "u", "left").join(label("v"), "v", "left").where(F.coalesce("u_l", "u") != F.coalesce("v_l", "v"))
        pairs = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).join(star.select("a", "b"), ["a", "b"], "left_anti")
        more = _verified(staged(pairs, "pairs"), reps, texts, threshold, size, broadcast_nodes)
        edges = edges.union(more.where("same").select("a", "b"))
    linked = components(edges)
    roots = linked.select(F.col("a").alias("u"), F.col("b").alias("root")).union(linked.select(F.col("b").alias("u"), F.col("b").alias("root")).distinct())
    grouped = reps.select("u", "f1", "f2", "k").join(roots, "u", "left").where("k > 1 or root is not null").select("f1", "f2", F.coalesce("root", "u").alias("root"))
    found = staged(signed.select("n", "f1", "f2").join(grouped, ["f1", "f2"]).groupBy("root", "n").agg(F.count(F.lit(1)).alias("times")), "grouped")
    return found.join(found.groupBy("root").agg(F.min("n").alias("least")), "root").select("n", "least", "times")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, duplicate_of) of the documents that near_dedup drops; options as of duplicate_nodes."""
    found = duplicate_nodes(docs, id_col, text_col, **options).where("n != least")
    return found.select(F.col("n.id").alias("doc_id"), F.col("least.id").alias("duplicate_of"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_nodes: int = BROADCAST_NODES, **options) -> DataFrame:
    """The documents without near copies: the least of each group stays, all columns."""
    found = staged(duplicate_nodes(docs, id_col, text_col, broadcast_nodes=broadcast_nodes, **options), "found")
    hinted = lambda df: F.broadcast(df) if df.count() <= broadcast_nodes else df
    drop = hinted(found.where("n != least").select(F.col("n").alias("zn")))
    often = hinted(found.where("n = least and times > 1").select(F.col("n").alias("zn")))
    node = F.struct(F.col(id_col).alias("id"), row_hash(text_col).alias("th"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("zr"), node.alias("zn")).join(drop, "zn", "left_anti")
    rows = rows.join(often.withColumn("zk", F.lit(True)), "zn", "left")
    once = rows.where("zk").groupBy("zn").agg(F.first("zr").alias("zr")).select("zr")  # a repeated row stays once
    return rows.where("zk is null").select("zr").unionByName(once).select("zr.*")
