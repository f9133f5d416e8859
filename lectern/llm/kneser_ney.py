"""Quality classifier: interpolated modified Kneser-Ney n-grams of trusted text.

Tokens are characters, 12 bits each (code points up to 2047 as they are, others hashed above), five to
a key, so an n-gram is one integer and the model is a table of counts. The highest order has the counts
of trusted text, lower orders continuation counts; each order has the three discounts of its counts of
counts. Counts, contexts and lower orders are joined by key, sharded over the cluster.

A document's log-probability is a sum over its n-grams of weights that depend on the n-gram alone: a
seen n-gram adds what it changes against backing off, and a context the log of its back-off weight. So
scoring is a join of document n-gram counts with the model, too. While the model has at most
BROADCAST_NGRAMS n-grams (counted first; characters keep it far smaller than the text) its table is
sent to the workers and scoring is one pass over the text; beyond that the document counts are joined
with the sharded table. Both have the same weights in double precision.

A document is kept if its perplexity is at most its language's quantile among trusted documents that
were held out of the counts (a tenth, by a hash of the id), with a margin that keeps clean documents where few
are held out. A language with fewer than
`least` held-out documents takes the quantile over all languages.

Defined cases
- Trusted: documents whose id has the label `good`; an id labelled more than once must have it always.
  Rows of null label or id count for nothing. Without any trusted text everything is kept.
- A document without characters (null, empty) has no perplexity and isn't kept.
- Null language is a language of its own. Every row gets a row, also repeated ones; the filter keeps all
  columns, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, need, pieces, row_hash, staged, text_buffer, tidy

ORDER, BITS, SYMBOLS = 5, 12, 4096
QUANTILE, MARGIN, LEAST = 0.995, 1.1, 50
#: So many n-grams are sent to the workers at most, where a slot of the table takes 24 bytes and a third of the slots are filled at least.
BROADCAST_NGRAMS = 2_000_000
#: So many trusted ids, 8 bytes each, are broadcast at most to pick their documents.
BROADCAST_IDS = 4_000_000
_PAD = ORDER - 1


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the rows, each after ORDER - 1 line feeds, and where the rows begin in them."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(data) and data.max() >= 128:
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
        high = cp >= 2048
        if high.any():
            cp = cp.copy()
            cp[high] = 2048 + (mix(cp[high].astype(np.uint64)) & np.uint64(2047)).astype(np.uint32)
    else:
        chars = offs
    n = len(offs) - 1
    begin = chars + _PAD * np.arange(n + 1)
    out = np.full(len(cp) + _PAD * n, 10, np.int64)
    if n == 1:
        out[_PAD:] = cp
    else:
        real = np.ones(len(out), bool)
        real[(begin[:-1, None] + np.arange(_PAD)).ravel()] = False
        out[real] = cp
    return out, begin


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Keys with summed counts of sorted (keys, counts) parts."""
    g, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], np.add.reduceat(c, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_buffer(batch.column(0))
        parts = []
        for i, j in pieces(offs):
            s, begin = symbols(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            real = np.ones(len(s), bool)
            real[(begin[:-1, None] + np.arange(_PAD)).ravel()] = False
            key = s[_PAD:].copy()
            for k in range(1, ORDER):
                key |= s[_PAD - k : len(s) - k] << (BITS * k)
            key = key[real[_PAD:]]
            if len(key):
                parts.append(np.unique(key, return_counts=True))
        if parts:
            g, c = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c.astype(np.int64))], ["g", "c"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's modified discounts from counts of counts; defaults where those are too few."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    clip = lambda d, k: min(max(d, 0.05), k - 0.05)
    return clip(1 - 2 * y * n2 / n1, 1), clip(2 - 3 * y * n3 / n2, 2), clip(3 - 4 * y * n4 / n3, 3)


def train(text: DataFrame) -> tuple[DataFrame, float]:
    """(model, base): staged rows (k, d, b), the key tagged with its order, what it adds as an n-gram and as a context; the log-probability of an unseen character."""
    counts = {ORDER: staged(text.mapInArrow(tidy(_count), "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c")), "counts")}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = staged(counts[n + 1].groupBy(F.col("g").bitwiseAND((1 << BITS * n) - 1).alias("g")).agg(F.count(F.lit(1)).alias("c")), "counts")
    lower, base, parts = None, math.log(1 / SYMBOLS), []
    for n in range(1, ORDER + 1):
        c = counts[n]
        few = c.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        d = discounts(*few)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = c.withColumn("h", F.shiftright("g", BITS)) if n > 1 else c.withColumn("h", F.lit(0).cast("long"))
        ctx = rows.groupBy("h").agg(F.sum("c").alias("total"), F.sum(cut).alias("mass"))
        rows = rows.join(F.broadcast(ctx) if n == 1 else ctx, "h").withColumn("gamma", F.col("mass") / F.col("total"))
        if n == 1:
            one = ctx.first()
            if one is None:
                return staged(text.sparkSession.createDataFrame([], "k bigint, d double, b double"), "model"), base
            base = math.log(one.mass / one.total / SYMBOLS)
            rows = rows.withColumn("lp", F.log((F.col("c") - cut) / F.col("total") + F.exp(F.lit(base)))).withColumn("d", F.col("lp") - base)
        else:
            below = lower.select(F.col("g").alias("s"), F.col("lp").alias("ls"))
            rows = rows.join(below, rows["g"].bitwiseAND((1 << BITS * (n - 1)) - 1) == below["s"])
            rows = rows.withColumn("lp", F.log((F.col("c") - cut) / F.col("total") + F.col("gamma") * F.exp("ls"))).withColumn("d", F.col("lp") - F.log("gamma") - F.col("ls"))
        lower = staged(rows.select("g", "lp", "d"), "order")
        if n > 1:
            parts.append(ctx.select((F.col("h") + ((n - 1) << 60)).alias("k"), F.lit(0.0).alias("d"), F.log(F.col("mass") / F.col("total")).alias("b")))
        parts.append(lower.select((F.col("g") + (n << 60)).alias("k"), "d", F.lit(0.0).alias("b")))
    model = reduce(DataFrame.unionByName, parts).groupBy("k").agg(F.sum("d").alias("d"), F.sum("b").alias("b"))
    return staged(model, "model"), base


class Table:
    """Open-addressing table of a model that is small enough to broadcast; it is sent as its rows and built where it is used."""

    def __init__(self, k: np.ndarray, d: np.ndarray, b: np.ndarray):
        self.rows, self.bits = (k, d, b), 0

    def __reduce__(self):
        return Table, self.rows

    def _build(self) -> None:
        (k, d, b), self.rows = self.rows, None
        self.bits = max(4, math.ceil(math.log2(max(len(k), 1) * 3)))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros((1 << self.bits, 2))
        left, slot = np.arange(len(k)), self._slot(k)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]] = k[left[put]]
            self.values[slot[put], 0], self.values[slot[put], 1] = d[left[put]], b[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        x = k.view(np.uint64) if k.dtype == np.int64 else k
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, k: np.ndarray) -> np.ndarray:
        if not self.bits:
            self._build()
        slot = self._slot(k)
        found = self.keys[slot]
        out = self.values[slot]
        miss = np.flatnonzero(found != k)
        if len(miss):
            empty = found[miss] < 0
            out[miss] = 0
            todo = miss[~empty]
            slot = slot[todo]
            while len(todo):
                slot = (slot + 1) & ((1 << self.bits) - 1)
                found = self.keys[slot]
                hit = found == k[todo]
                out[todo[hit]] = self.values[slot[hit]]
                go = ~hit & (found >= 0)
                todo, slot = todo[go], slot[go]
        return out


def _grams(data, offs):
    """Per order the tagged keys at every position, which positions are characters, and where rows begin."""
    s, begin = symbols(data, offs)
    real = np.ones(len(s), bool)
    if len(s):
        real[(begin[:-1, None] + np.arange(_PAD)).ravel()] = False
    key, keys = np.zeros(len(s), np.int64), []
    for n in range(1, ORDER + 1):
        key[n - 1 :] |= s[: len(s) - n + 1] << (BITS * (n - 1))
        keys.append(key + (n << 60))
    return keys, real, begin


def log_probabilities(column, table: Table, base: float) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the characters' log-probabilities, characters) of each text."""
    data, offs = text_buffer(column)
    total, size = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1, np.int64)
    for i, j in pieces(offs, 1 << 18):
        keys, real, begin = _grams(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        if not len(real):
            continue
        at = np.zeros(len(real))
        for n in range(ORDER):
            v = table.get(keys[n])
            at += v[:, 0]
            if n < ORDER - 1:
                at[1:] += v[:-1, 1]
        at = np.where(real, at + base, 0.0)
        c = np.concatenate([[0.0], np.cumsum(at)])
        total[i:j] = c[begin[1:]] - c[begin[:-1]]
        size[i:j] = np.diff(begin) - _PAD
    return total, size


def _perplexity(total: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.array(np.exp(-total / np.maximum(size, 1)), mask=size == 0)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, key, times as an n-gram, times as a context) of every document."""
    for batch in batches:
        uid = batch.column(0).to_numpy()
        data, offs = text_buffer(batch.column(1))
        for i, j in pieces(offs):
            keys, real, begin = _grams(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            row = np.repeat(np.arange(i, j), np.diff(begin))
            nxt = np.append(real[1:], False)
            for k in keys:
                order = np.lexsort((k, row))
                kk, rr = k[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (kk[1:] != kk[:-1]) | (rr[1:] != rr[:-1])])) if len(kk) else np.zeros(0, np.int64)
                if not len(new):
                    continue
                nd, nb = np.add.reduceat(real[order].astype(np.int64), new), np.add.reduceat((nxt & True)[order].astype(np.int64), new)
                yield pa.RecordBatch.from_arrays([pa.array(uid[rr[new]]), pa.array(kk[new]), pa.array(nd), pa.array(nb)], ["uid", "k", "nd", "nb"])


class Classifier:
    """A trained model with its thresholds; make it with fit_quality."""

    def __init__(self, model: DataFrame, base: float, broadcast_ngrams: int, trained: bool):
        self.model, self.base, self.trained = model, base, trained
        self.shared = None
        if model.count() <= broadcast_ngrams:
            rows = model.select("k", "d", "b").toArrow()
            self.shared = model.sparkSession.sparkContext.broadcast(Table(*(rows.column(c).to_numpy() for c in "kdb")))
        self.limits: dict = {}
        self.default = math.inf

    def scored(self, docs: DataFrame, columns: list, text_col: str, keep_text: bool = False) -> DataFrame:
        """The given columns, the text as zt if it is to be kept, and zp, the perplexity, of every row."""
        rows = docs.select(*columns, F.col(text_col).alias("zt"))
        names = rows.columns if keep_text else rows.columns[:-1]
        if self.shared is not None:
            shared, base = self.shared, self.base

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    p = _perplexity(*log_probabilities(batch.column(batch.num_columns - 1), shared.value, base))
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], p], [*names, "zp"])

            return rows.mapInArrow(tidy(run), rows.select(*names).schema.add("zp", "double"))
        rows = staged(rows.withColumn("zu", row_hash("zt")), "scored")  # equal texts have equal scores
        texts = rows.select("zu", "zt").where("zt is not null").dropDuplicates(["zu"])
        asked = texts.mapInArrow(tidy(_requests), "uid bigint, k bigint, nd bigint, nb bigint")
        order = F.shiftright("k", 60)
        ctx = F.when(order < ORDER, F.col("nb")).otherwise(0)
        joined = asked.join(self.model, "k", "left")
        weight = F.coalesce(F.col("nd") * F.col("d"), F.lit(0.0)) + F.coalesce(ctx * F.col("b"), F.lit(0.0)) + F.when(order == 1, F.col("nd") * F.lit(self.base)).otherwise(0.0)
        sums = joined.groupBy("uid").agg(F.sum(weight).alias("total"), F.sum(F.when(order == 1, F.col("nd")).otherwise(0)).alias("size"))
        score = F.when(F.col("size") > 0, F.exp(-F.col("total") / F.col("size")))
        return rows.join(sums, rows["zu"] == sums["uid"], "left").select(*names, score.alias("zp"))

    def keep(self, perplexity: F.Column, lang: F.Column) -> F.Column:
        limit = F.lit(self.default)
        for k, v in self.limits.items():
            limit = F.when(lang.eqNullSafe(F.lit(k)), v).otherwise(limit)
        return F.coalesce(perplexity <= limit, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", good: int = 1, quantile: float = QUANTILE, margin: float = MARGIN, least: int = LEAST, broadcast_ngrams: int = BROADCAST_NGRAMS) -> Classifier:
    """Train on all trusted documents and set the thresholds on the held-out ones."""
    need(docs, id_col, text_col, lang_col)
    need(labels, id_col, label_col)
    known = labels.select(F.col(id_col).alias("zi"), (F.col(label_col) == good).alias("zg")).where("zi is not null and zg is not null")
    trusted = known.groupBy("zi").agg(F.min("zg").alias("zg")).where("zg").select("zi")
    trusted = staged(trusted, "trusted")
    trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    rows = docs.select(F.col(id_col).alias("zi"), F.col(text_col).alias("zt"), F.col(lang_col).alias("zl")).join(trusted, "zi", "left_semi")
    held = F.pmod(F.xxhash64("zi"), F.lit(10)) == 0
    model, base = train(rows.where(~held).select("zt"))
    out = Classifier(model, base, broadcast_ngrams, True)
    sample = out.scored(rows.where(held), [F.col("zl")], "zt").where("zp is not null")
    at = F.percentile_approx("zp", quantile, 10000).alias("q")
    by = sample.rollup("zl").agg(at, F.count(F.lit(1)).alias("n"), F.grouping("zl").alias("all")).collect()  # one row a language
    for r in by:
        if r["all"] and r.q is not None:
            out.default = r.q * margin
        elif r.n >= least:
            out.limits[r.zl] = r.q * margin
    return out


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, perplexity, keep) of every row; the cases are defined above."""
    fitted = fit_quality(docs, labels, id_col, text_col, lang_col, **options)
    rows = fitted.scored(docs, [F.col(id_col).alias("doc_id"), F.col(lang_col).alias("zl")], text_col)
    return rows.select("doc_id", F.col("zp").alias("perplexity"), fitted.keep(F.col("zp"), F.col("zl")).alias("keep"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents that quality() keeps, all columns."""
    fitted = fit_quality(docs, labels, id_col, text_col, lang_col, **options)
    rest = [c for c in docs.columns if c != text_col]
    names = [f"z{k}" for k in range(len(rest))]
    rows = fitted.scored(docs, [F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)], text_col, keep_text=True)
    kept = rows.where(fitted.keep(F.col("zp"), F.col(names[rest.index(lang_col)])))
    back = dict(zip(rest, names, strict=True)) | {text_col: "zt"}
    return kept.select(*[F.col(back[c]).alias(c) for c in docs.columns])
