"""Near-duplicate classes of embeddings by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale each, and the exact norm of each vector's quantisation
error is kept. Vectors are grouped by the nearest of some pivots, in tiles of at most about TILE_BYTES,
and a tile keeps its centre and its angular radius. Of two tiles whose centres are too far apart for
any of their vectors to reach the threshold nothing is compared. For the other pairs of tiles the int8
products are computed exactly, in strips of STRIP dimensions (float32 sums of integers below 2^24).
From u = s q + e follows |u.v - s t (q.r)| <= |s q| |f| + |e| |v|, so a pair is dropped only if even the
bound can't reach the threshold; the pairs left are recomputed in double precision there and then. No
candidate is capped, and no pair leaves its tile: a pair of tiles returns, for each vector that has a
link in it, how many rows it is linked with and the least vector it is connected with.

Equal vectors are merged first, so a group of copies costs one vector. The result has a row a vector,
with the least id of all that links connect it with, and how many rows it is linked with directly.

Defined cases
- Ids are of any type that has an order. Rows that repeat id and vector are one; rows of one id with
  other vectors are compared like any two. A null id is less than none: it names a class only if the
  class has no other.
- A null or empty vector, one with a null, NaN or infinite entry, or of norm zero, has no link; vectors
  of different lengths have none with each other. Each has a row, with its own id as class.
- Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, need, release, staged, tidy
from .components import components

THRESHOLD, TILE_BYTES = 0.95, 8 << 20
#: Dimensions whose products are summed in float32; rows of one product; pairs recomputed at a time.
STRIP, STEP, PAIRS = 1024, 512, 1 << 15
#: So many tiles at most have their centres sent out for pruning, 8 bytes a dimension each; beyond that all tiles are compared.
PRUNED_TILES = 20_000
#: So many pivots at most, and no more than tiles are needed, so that tiles stay few and full.
PIVOTS = 1024
_SLACK = 1e-5  # covers the float32 arithmetic of scales and norms; the int8 products are exact


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms of the quantised vectors, norms of the errors) of unit vectors."""
    scale = np.abs(v).max(axis=1) / 127
    q = np.rint(v / scale[:, None])
    approx = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(approx, axis=1), np.linalg.norm(v - approx, axis=1)


def products(qa: np.ndarray, qb: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    out = None
    for k in range(0, qa.shape[1], STRIP):
        part = (qa[:, k : k + STRIP].astype(np.float32) @ qb[:, k : k + STRIP].astype(np.float32).T).astype(np.float64)
        out = part if out is None else out + part
    return out


def possible(qa, sa, na, ea, qb, sb, eb, threshold: float):
    """Index pairs whose product may reach the threshold, STEP rows at a time."""
    for i in range(0, len(qa), STEP):
        j = i + STEP
        top = products(qa[i:j], qb) * sa[i:j, None] * sb[None, :] + na[i:j, None] * eb[None, :] + ea[i:j, None]
        x, y = np.nonzero(top >= threshold - _SLACK)
        yield x + i, y


def linked(va: np.ndarray, vb: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose product in double precision reaches the threshold."""
    keep = [np.zeros(0, bool)]
    for k in range(0, len(x), PAIRS):
        keep.append(np.einsum("nd,nd->n", va[x[k : k + PAIRS]], vb[y[k : k + PAIRS]]) >= threshold)
    keep = np.concatenate(keep)
    return x[keep], y[keep]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that edges (a, b) connect the least of their labels, in place."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


_TILE = "tile bigint, dim int, centre array<double>, radius double, keys binary, sizes binary, v binary"


def _pack(table: pa.Table) -> pa.Table:
    """One row with the unit vectors of a tile, its centre and its radius."""
    dim = table.column("dim")[0].as_py()
    v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    keys, sizes = table.column("k").to_numpy(), table.column("m").to_numpy()
    centre = v.mean(axis=0)
    norm = np.linalg.norm(centre)
    centre = centre / norm if norm > 1e-6 else v[0]
    radius = float(np.arccos(np.clip((v @ centre).min(), -1, 1)))
    columns = [pa.array([table.column("tile")[0].as_py()], pa.int64()), pa.array([dim], pa.int32()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])]
    return pa.Table.from_arrays([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in (keys, sizes, v))], ["tile", "dim", "centre", "radius", "keys", "sizes", "v"])


def _compared(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Two tiles, or one with itself: (k, links, root) of each vector that has a link here."""
        rows = {r["tile"]: r for r in table.to_pylist()}
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        load = lambda r: (np.frombuffer(r["keys"], np.int64), np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["v"]).reshape(-1, r["dim"]))
        ka, ma, va = load(rows[i])
        kb, mb, vb = load(rows[j])
        bounds = lambda v: [f(x) for f, x in zip((lambda q: q, *[lambda x: np.nextafter(x.astype(np.float32), np.float32(np.inf))] * 3), quantise(v), strict=True)]
        (qa, sa, na, ea), (qb, sb, _, eb) = bounds(va), bounds(vb)
        keys = ka if i == j else np.concatenate([ka, kb])
        order = np.argsort(keys, kind="stable")  # labels are ranks of keys, so the least label is the least key
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        label, links = np.arange(len(keys)), np.zeros(len(keys), np.int64)
        shift = 0 if i == j else len(ka)
        for x, y in possible(qa, sa, na, ea, qb, sb, eb, threshold):
            if i == j:
                x, y = x[x < y], y[x < y]
            x, y = linked(va, vb, x, y, threshold)
            if len(x):
                np.add.at(links, x, mb[y])
                np.add.at(links, y + shift, ma[x])
                join_labels(label, rank[x], rank[y + shift])
        some = np.flatnonzero(links)
        release()
        return pa.Table.from_arrays([pa.array(keys[some]), pa.array(links[some]), pa.array(keys[order][label[rank[some]]])], ["k", "links", "root"])

    return run


def _nearest(pivots: dict[int, np.ndarray]):
    """Rows (k, m, v): the vector of length 1, its dimension and its nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                v = v / np.abs(v).max(axis=1)[:, None]  # so that the norm neither overflows nor vanishes
                v = v / np.linalg.norm(v, axis=1)[:, None]
                cell = (v @ pivots[dim].T).argmax(axis=1) if dim in pivots else np.zeros(len(v), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(v), dim, np.int32)), pa.array(cell.astype(np.int32)), lists], ["k", "m", "dim", "cell", "v"])

    return run


def _pivots(reps: DataFrame, count: int) -> dict[int, np.ndarray]:
    """By dimension, the unit vectors of the least hashes."""
    rows = reps.orderBy(F.xxhash64("h1"), "k").limit(count).select("v").collect()
    out: dict[int, list] = {}
    for r in rows:
        v = np.array(r.v) / np.abs(r.v).max()
        out.setdefault(len(v), []).append(v / np.linalg.norm(v))
    return {dim: np.stack(vs) for dim, vs in out.items()}


def _links(reps: DataFrame, threshold: float, tile_bytes: int) -> DataFrame:
    """Staged (k, links, root), one row for each pair of tiles in which the vector k has a link."""
    spark = reps.sparkSession
    size = reps.agg(F.sum(F.size("v")) * 8).first()[0] or 0
    celled = staged(reps.select("k", "m", "v").mapInArrow(tidy(_nearest(_pivots(reps, min(PIVOTS, max(1, -(-size // tile_bytes)))))), "k bigint, m bigint, dim int, cell int, v array<double>"), "cells")
    cells = celled.groupBy("dim", "cell").count().collect()  # at most PIVOTS of them a dimension
    first, spans = 0, {}
    for r in sorted(cells, key=lambda r: (r.dim, r.cell)):
        n = max(1, -(-r["count"] * r.dim * 8 // tile_bytes))
        spans[r.dim, r.cell] = first, n
        first += n
    tile = F.lit(None).cast("bigint")
    if spans:
        of = spark.createDataFrame([(*key, *span) for key, span in spans.items()], "dim int, cell int, first bigint, tiles bigint")
        celled_tiles = celled.join(F.broadcast(of), ["dim", "cell"])
        tile = F.col("first") + F.pmod(F.xxhash64("k"), F.col("tiles"))
    else:
        celled_tiles = celled
    packed = staged(celled_tiles.select(tile.alias("tile"), "dim", "k", "m", "v").groupBy("tile").applyInArrow(_pack, _TILE), "tiles")
    discard(celled)
    partners = _partners(packed, first, threshold)
    keyed = partners.join(packed.drop("centre", "radius", "dim"), "tile").select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "dim", "keys", "sizes", "v")
    spread = max(1, min(first * (first + 1) // 2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = staged(keyed.repartition(spread, "i", "j").groupBy("i", "j").applyInArrow(_compared(threshold), "k bigint, links bigint, root bigint"), "links")
    discard(packed)
    return found


def _partners(packed: DataFrame, tiles: int, threshold: float) -> DataFrame:
    """(tile, other, dim): each tile with all that may hold a vector near enough, itself among them."""
    own = packed.select("tile", "dim", "centre", "radius")
    if tiles > PRUNED_TILES:
        dims = own.groupBy("dim").agg(F.min("tile").alias("lo"), F.max("tile").alias("hi"))  # the tiles of a dimension are consecutive
        return own.join(F.broadcast(dims), "dim").select("tile", F.explode(F.sequence("lo", "hi")).alias("other"), "dim")
    known = own.collect()
    by: dict[int, tuple] = {}
    for dim in {r.dim for r in known}:
        mine = [r for r in known if r.dim == dim]
        by[dim] = np.array([r.tile for r in mine]), np.array([r.centre for r in mine]), np.array([r.radius for r in mine])
    shared = packed.sparkSession.sparkContext.broadcast(by)
    widest = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, centres, radii = shared.value[r["dim"]]
                angle = np.arccos(np.clip(centres @ np.array(r["centre"]), -1, 1))
                near = ids[(angle - radii - r["radius"] <= widest) | (ids == r["tile"])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), r["tile"])), pa.array(near), pa.array(np.full(len(near), r["dim"], np.int32))], ["tile", "other", "dim"])

    return own.mapInArrow(tidy(run), "tile bigint, other bigint, dim int")


def near_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(vec_id, class_id, n_links) of every vector: the class is named by its least id; the cases are defined above."""
    need(vectors, id_col, vector_col)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    whole = "v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x != 0)"
    rows = rows.withColumn("ok", F.coalesce(F.expr(whole), F.lit(False))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(5), "v"))
    rows = staged(rows.groupBy("id", "h1", "h2").agg(F.first("v").alias("v"), F.first("ok").alias("ok")), "vectors")
    reps = rows.where("ok").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    reps = staged(reps.select(F.monotonically_increasing_id().alias("k"), "h1", "h2", "m", "v"), "distinct-vectors")
    found = _links(reps, threshold, tile_bytes)
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    roots = components(found.where("k != root").select(F.col("k").alias("a"), F.col("root").alias("b"))).select(F.col("a").alias("k"), F.col("b").alias("root"))
    named = reps.select("k", "h1", "h2", "m").join(links, "k", "left").join(roots, "k", "left").select("h1", "h2", "m", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "k").alias("root"))
    members = rows.where("ok").select("id", "h1", "h2").join(named, ["h1", "h2"])
    least = members.groupBy("root").agg(F.min("id").alias("class_id"))
    joined = members.join(least, "root").select(F.col("id").alias("vec_id"), "class_id", (F.col("links") + F.col("m") - 1).alias("n_links"))
    return joined.unionByName(rows.where("not ok").select(F.col("id").alias("vec_id"), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))


#: The threshold of the registered query: most vectors of the small tables are independent, and few are nearer than this.
QUERY_THRESHOLD = 0.5

EMBEDDING_SQL = f"""
WITH RECURSIVE e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id != b.vec_id WHERE array_cosine_similarity(a.v, b.v) >= {QUERY_THRESHOLD}),
r AS (SELECT vec_id AS id, vec_id AS other FROM e UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.other),
c AS (SELECT id, min(other) AS class_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT c.id AS vec_id, c.class_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links FROM c LEFT JOIN n ON n.a = c.id
"""
