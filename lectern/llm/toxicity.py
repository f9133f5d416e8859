"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The features of a document are densities of lexicon words, how many of them stand near a second-person
word, obfuscated lexicon words (digits or signs for letters, or letters set apart by signs), the rates
of capitals, all-capital words, punctuation, exclamation marks and digits, and its length. They are
computed by numpy on the text's bytes. The trees (logistic loss, histogram splits) are fitted on at
most `max_labelled` labelled documents, those least by a hash of the id; a third of them, by the same
hash, is held out of the trees and used for the isotonic calibration.

There are two lexicons. One is built in and small. The other is learned from the labels, by language:
words, and beginnings of words of PREFIX bytes, that are in at least LEAST_TOXIC toxic documents and
RATIO times as frequent among them as among the others, each with its smoothed log-odds. It is
cross-fitted: the features with which a document enters the fit come from a lexicon of the other folds
only, so its own label doesn't feed them; new documents get the lexicon of all folds. A language with
fewer than LEAST_DOCS labelled documents of either class has no learned lexicon; its documents, and
those without a known language, are scored by trees on the built-in features alone.

Defined cases
- A document's language is that of its row; null is a language of its own; without a language column
  all documents share one.
- Labels: a row without id or label, or whose document doesn't exist, is ignored; an id labelled more
  than once is toxic if any of its labels says so. Without labels of both classes every score is the
  share of toxic labels (0 without any).
- A document without words (null, empty, only signs) scores 0 and isn't toxic.
- Every row gets a row, also repeated ones and such without id; extra columns are ignored; an empty
  table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, folded, mix, need, owners, pieces, staged, text_buffer, tidy, word_hash, words

MAX_LABELLED, THRESHOLD = 20_000, 0.5

#: Public, common insults by language; a parameter of the operator.
LEXICON: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "dumbass", "clown", "clowns", "loser", "losers", "imbecile", "fool", "fools", "jerk", "creep", "freak", "dimwit", "halfwit"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting", "garbage", "filth", "filthy", "vermin", "useless", "repulsive", "despicable", "ugly", "hate", "shit", "crap", "bastard", "bitch", "fuck", "fucking", "asshole"),
    "other": ("idiote", "imbécile", "crétin", "connard", "connasse", "salaud", "salope", "débile", "ordure", "merde", "dummkopf", "arschloch", "trottel", "schwachkopf", "abschaum", "wichser", "hurensohn", "scheiße", "idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "mierda", "cabrón", "pendejo", "gilipollas", "patético"),
}
#: The learned lexicon: folds of the cross-fit, bytes of a word's beginning, and what a word must have.
FOLDS, PREFIX, LEAST_TOXIC, RATIO, LEAST_DOCS = 5, 5, 3, 5.0, 10
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "youre", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "vous", "votre", "tú", "ti", "tus", "usted", "vosotros")
NEAR = 5

FEATURES = (
    "insult", "contempt", "other", "hits", "near_you", "near_share", "second_person", "obfuscated", "obfuscated_hits",
    "capitals", "capital_words", "punctuation", "exclamation", "signs", "digits", "log_words",
)
#: Features of the learned lexicon, of words and then of their beginnings.
LEARNED = tuple(f"{kind}_{x}" for kind in ("word", "begin") for x in ("density", "most", "hits", "near_you"))


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, np.int64)
    for a, b in ranges:
        t[a:b] = 1
    return t


_UPPER, _LOWER, _DIGIT = _class((65, 91)), _class((97, 123)), _class((48, 58))
_PUNCT = _class((33, 48), (58, 65), (91, 97), (123, 127))
_BANG = _class((33, 34), (63, 64))
_SIGN = _class((35, 39), (42, 44), (60, 63), (64, 65), (91, 97), (123, 127))
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip("01345789@$", "oieastbgas", strict=True):
    _LEET[ord(_a)] = ord(_b)
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in ".-_*"]] = True


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(h):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[at] == h


def _by_row(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values)])
    return (c[offs[1:]] - c[offs[:-1]]).astype(np.float64)


def _tables(lexicon, second):
    hashed = lambda ws: np.sort(np.array(sorted({word_hash(w) for w in ws}), np.uint64))
    return [hashed(ws) for ws in lexicon.values()], hashed(second)


def _near(at: np.ndarray, you: np.ndarray, wo: np.ndarray, n: int) -> np.ndarray:
    """Which of the n words are among `at` and at most NEAR words from one of `you` in their row."""
    near = np.zeros(n, bool)
    if len(at) and len(you):
        row_of = lambda x: np.searchsorted(wo, x, side="right")
        k = np.searchsorted(you, at)
        for c in (np.minimum(k, len(you) - 1), np.maximum(k - 1, 0)):
            near[at] |= (np.abs(you[c] - at) <= NEAR) & (row_of(you[c]) == row_of(at))
    return near


def _stems(h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the first PREFIX bytes of each word, of another stream than the words'."""
    b = folded(data)
    key = np.full(len(h), 1 << 60, np.int64)
    for k in range(PREFIX):
        at = start + k
        key += np.where(at < end, b[np.minimum(at, len(b) - 1)].astype(np.int64) + 1, 0) << (9 * k)
    return mix(key.astype(np.uint64))


class Lexicon:
    """Log-odds of words and of their beginnings by language, as sorted keys with their weights."""

    def __init__(self, langs: np.ndarray, keys: list[np.ndarray], weights: list[np.ndarray]):
        self.langs, self.keys, self.weights = langs, keys, weights

    def known(self, lang: np.ndarray) -> np.ndarray:
        return np.isin(lang, self.langs)

    def weigh(self, kind: int, h: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The log-odds of each item in its language; 0 if it isn't in the lexicon."""
        keys = self.keys[kind]
        if not len(keys) or not len(h):
            return np.zeros(len(h))
        k = _in_language(h, lang)
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return np.where(keys[at] == k, self.weights[kind][at], 0.0)


def _in_language(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(lang.astype(np.int64).view(np.uint64)))


def learn(lang: np.ndarray, kind: np.ndarray, h: np.ndarray, toxic: np.ndarray, docs: np.ndarray, totals: dict[int, tuple[int, int]]) -> Lexicon:
    """The lexicon of items (lang, kind, h) in `toxic` of the toxic and `docs` of all documents; totals: (toxic, all) documents by language."""
    langs = np.array(sorted(k for k, (t, n) in totals.items() if t >= LEAST_DOCS and n - t >= LEAST_DOCS), np.int64)
    use = np.isin(lang, langs) & (toxic >= LEAST_TOXIC)
    lang, kind, h, toxic, clean = lang[use], kind[use], h[use], toxic[use], (docs - toxic)[use]
    t, n = (np.array([totals[int(k)][c] for k in langs], float)[np.searchsorted(langs, lang)] if len(lang) else np.zeros(0) for c in (0, 1))
    odds = np.log((toxic + 0.5) / (t + 1)) - np.log((clean + 0.5) / (n - t + 1))
    keys, weights = [], []
    for k in (0, 1):
        at = np.flatnonzero((kind == k) & (odds > np.log(RATIO)))
        key = _in_language(h[at].view(np.uint64), lang[at])
        order = np.argsort(key)
        keys.append(key[order])
        weights.append(odds[at][order])
    return Lexicon(langs, keys, weights)


def _learned(column, lang: np.ndarray, fold: np.ndarray, lexicons: list[Lexicon], second: np.ndarray) -> np.ndarray:
    """The features LEARNED of each text, by the lexicon of its fold."""
    data, offs = text_buffer(column)
    out = np.zeros((len(offs) - 1, len(LEARNED)))
    for i, j in pieces(offs):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        h, start, end, wo = words(d, o)
        if not len(h):
            continue
        row = owners(wo)
        n = np.maximum(np.diff(wo), 1).astype(np.float64)
        you = np.flatnonzero(_member(h, second))
        for kind, items in enumerate((h, _stems(h, d, start, end))):
            w = np.zeros(len(h))
            for f in np.unique(fold[i:j]):
                at = np.flatnonzero(fold[i:j][row] == f)
                w[at] = lexicons[f].weigh(kind, items[at], lang[i:j][row[at]])
            hit = np.flatnonzero(w)
            most = np.zeros(j - i)
            np.maximum.at(most, row[hit], w[hit])
            near = _near(hit, you, wo, len(h))
            out[i:j, 4 * kind : 4 * kind + 4] = np.stack([_by_row(w, wo) / n, most, np.log1p(_by_row(w > 0, wo)), _by_row(near * w, wo) / n], axis=1)
    return out


def _features(column, tables) -> np.ndarray:
    lists, second = tables
    data, offs = text_buffer(column)
    out = np.zeros((len(offs) - 1, len(FEATURES)))
    for i, j in pieces(offs):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        h, start, end, wo = words(d, o)
        n = np.maximum(np.diff(wo), 1).astype(np.float64)
        kinds = [_member(h, t) for t in lists]
        while len(kinds) < 3:
            kinds.append(np.zeros(len(h), bool))
        hit = np.logical_or.reduce(kinds)
        hits = _by_row(hit, wo)
        you = np.flatnonzero(_member(h, second))
        at = np.flatnonzero(hit)
        close = _by_row(_near(at, you, wo, len(h)), wo)
        letters_up, letters = _by_row(_UPPER[d], o), _by_row(_UPPER[d] + _LOWER[d], o)
        caps = np.concatenate([[0], np.cumsum(_UPPER[d])])
        whole = (caps[end] - caps[start] == end - start) & (end - start > 1)
        gap = _GAP[d]
        kept = np.concatenate([[0], np.cumsum(~gap)])
        h2, _, _, wo2 = words(_LEET[d[~gap]], kept[o])
        plain = np.maximum(_by_row(np.logical_or.reduce([_member(h2, t) for t in lists]), wo2) - hits, 0) if lists else 0 * hits
        size = np.maximum(np.diff(o), 1).astype(np.float64)
        out[i:j] = np.stack(
            [
                *(_by_row(k, wo) / n for k in kinds[:3]), np.log1p(hits), close / n, close / np.maximum(hits, 1), _by_row(_member(h, second), wo) / n,
                plain / n, np.log1p(plain), letters_up / np.maximum(letters, 1), _by_row(whole, wo) / n,
                _by_row(_PUNCT[d], o) / size, _by_row(_BANG[d], o) / size, _by_row(_SIGN[d], o) / size, _by_row(_DIGIT[d], o) / size,
                np.where(np.diff(wo) > 0, np.log1p(np.diff(wo)), -1.0),
            ],
            axis=1,
        )
    return out


class Trees:
    """Gradient-boosted trees of a fixed depth for logistic loss, fitted on histograms."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 10, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, f = x.shape
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(f)]
        for k in range(f):  # a rare non-zero tail must have cuts of its own
            tail = x[x[:, k] > x[:, k].min(), k]
            if len(tail):
                self.cuts[k] = np.unique(np.concatenate([self.cuts[k], np.quantile(tail, np.linspace(0, 1, 9)[:-1]) - 1e-12]))
        binned = np.stack([np.searchsorted(self.cuts[k], x[:, k], side="left") for k in range(f)], axis=1)
        p = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(n, self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        wide = max(len(c) for c in self.cuts) + 1
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                base, width = 2**level - 1, 2**level
                local = node - base
                best = np.full(width, 1e-9)
                for k in range(f):
                    if not len(self.cuts[k]):
                        continue
                    key = local * wide + binned[:, k]
                    sums = [np.bincount(key, weights=w, minlength=width * wide).reshape(width, wide).cumsum(axis=1) for w in (g, h, np.ones(n))]
                    (gl, hl, nl), (gt, ht, nt) = [s[:, :-1] for s in sums], [s[:, -1:] for s in sums]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(nl < self.least) | (nt - nl < self.least)] = 0
                    gain = gain[:, : len(self.cuts[k])]
                    top = gain.argmax(axis=1)
                    for w in range(width):
                        if gain[w, top[w]] > best[w]:
                            best[w], feature[base + w], cut[base + w] = gain[w, top[w]], k, self.cuts[k][top[w]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            total = [np.bincount(leaf, weights=w, minlength=2**self.depth) for w in (g, h)]
            value = -self.rate * total[0] / (total[1] + self.ridge)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (score, probability), both rising."""
    order = np.argsort(score, kind="stable")
    xs, first = np.unique(score[order], return_index=True)
    weight = np.diff(np.append(first, len(score))).astype(float)
    value = np.add.reduceat(y[order].astype(float), first) / weight
    blocks: list[list[float]] = []  # value, weight, first knot, last knot
    for k in range(len(xs)):
        blocks.append([value[k], weight[k], k, k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, _, last = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + v * w) / (b[1] + w), b[1] + w, last
    ends = [k for b in blocks for k in ((b[2], b[0]), (b[3], b[0]))]
    return np.array([xs[k] for k, _ in ends]), np.array([v for _, v in ends])


class Scorer:
    """Trees and their calibration on some features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 0.0
        fit, cal = ~held, held
        if len(np.unique(y[cal])) < 2:
            cal = fit = np.ones(len(y), bool)
        self.trees = None
        if len(np.unique(y[fit])) == 2:
            self.trees = Trees().fit(x[fit], y[fit])
            self.knots = isotonic(self.trees.score(x[cal]), y[cal])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.trees is None else np.interp(self.trees.score(x), *self.knots)


class Model:
    """The learned lexicon and two scorers, with and without it; plain numpy, small enough to send to every worker."""

    def __init__(self, lexicon: Lexicon, tables, plain: Scorer, full: Scorer):
        self.lexicon, self.tables, self.plain, self.full = lexicon, tables, plain, full

    def predict(self, column, lang: np.ndarray) -> np.ndarray:
        x = _features(column, self.tables)
        p = self.plain.predict(x)
        known = np.flatnonzero(self.lexicon.known(lang))
        if len(known):
            fold = np.zeros(len(known), np.int64)
            more = _learned(column.take(pa.array(known)), lang[known], fold, [self.lexicon], self.tables[1])
            p[known] = self.full.predict(np.concatenate([x[known], more], axis=1))
        return np.where(x[:, -1] < 0, 0.0, p)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, fold, kind, h, toxic documents, documents) of the words and beginnings of words, counted once a document."""
    for batch in batches:
        data, offs = text_buffer(batch.column(3))
        lang, fold, y = (batch.column(k).to_numpy() for k in (1, 0, 2))
        for i, j in pieces(offs):
            d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            h, start, end, wo = words(d, o)
            row = owners(wo)
            for kind, items in enumerate((h, _stems(h, d, start, end)) if len(h) else ()):
                order = np.lexsort((items, row))
                r, it = row[order] + i, items[order]
                once = np.concatenate([[True], (r[1:] != r[:-1]) | (it[1:] != it[:-1])])
                r, it = r[once], it[once].view(np.int64)
                l, f = lang[r], fold[r]
                order = np.lexsort((l, f, it))
                l, f, it, t = l[order], f[order], it[order], y[r[order]].astype(np.int64)
                new = np.flatnonzero(np.concatenate([[True], (l[1:] != l[:-1]) | (f[1:] != f[:-1]) | (it[1:] != it[:-1])]))
                n = np.diff(np.append(new, len(it)))
                yield pa.RecordBatch.from_arrays([pa.array(l[new]), pa.array(f[new]), pa.array([kind] * len(new), pa.int32()), pa.array(it[new]), pa.array(np.add.reduceat(t, new)), pa.array(n)], ["lang", "fold", "kind", "h", "t", "n"])


def _lexicons(counts: DataFrame, totals: dict[tuple[int, int], tuple[int, int]]) -> list[Lexicon]:
    """The lexicon without each fold, and last the one of all folds."""
    per = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in "tn" for f in range(FOLDS)]
    some = counts.groupBy("lang", "kind", "h").agg(F.sum("t").alias("t"), *per).where(F.col("t") >= LEAST_TOXIC).toArrow()
    at = {c: some.column(c).to_numpy() for c in some.column_names}
    out = []
    for left in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != left]
        t, n = (sum(at[f"{c}{f}"] for f in folds) for c in "tn")
        sums: dict[int, tuple[int, int]] = {}
        for (lang, fold), (a, b) in totals.items():
            if fold != left:
                x = sums.get(lang, (0, 0))
                sums[lang] = x[0] + a, x[1] + b
        out.append(learn(at["lang"], at["kind"], at["h"], t, n, sums))
    return out


def _language(df: DataFrame, lang_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(lang_col).cast("string"), F.lit("\0"))) if lang_col in df.columns else F.lit(0).cast("long")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", max_labelled: int = MAX_LABELLED, lexicon=None, second=SECOND_PERSON) -> Model:
    """The model fitted on a bounded sample of the labelled documents; only counts of its words and its features reach the driver."""
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    tables = _tables(lexicon or LEXICON, second)
    known = labels.select(F.col(id_col).alias("zi"), F.col(label_col).cast("int").alias("zy")).where("zi is not null and zy is not null")
    sample = known.groupBy("zi").agg(F.max("zy").alias("zy")).orderBy(F.xxhash64("zi"), "zi").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("zi"), _language(docs, lang_col).alias("zl"), F.col(text_col).alias("zt")).join(F.broadcast(sample), "zi")
    k = F.xxhash64("zi")
    fold = F.pmod(F.shiftright(k, 7), F.lit(FOLDS)).cast("int")
    texts = staged(texts.select(k.alias("k"), fold.alias("f"), "zl", F.when(F.col("zy") > 0, 1).otherwise(0).alias("zy"), "zt"), "labelled")
    totals = {(r.zl, r.f): (r.t, r.n) for r in texts.groupBy("zl", "f").agg(F.sum("zy").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    lexicons = _lexicons(texts.select("f", "zl", "zy", "zt").mapInArrow(tidy(_occurrences), "lang bigint, fold int, kind int, h bigint, t bigint, n bigint"), totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, lang = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            x = np.concatenate([_features(batch.column(4), tables), _learned(batch.column(4), lang, f, lexicons, tables[1])], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lexicons[-1].known(lang)), batch.column(3), pa.array(list(x), pa.list_(pa.float64()))], ["k", "l", "y", "x"])

    rows = texts.mapInArrow(tidy(run), "k bigint, l boolean, y int, x array<double>").toArrow().sort_by("k")
    discard(texts)
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES) + len(LEARNED))
    y, held = rows.column("y").to_numpy().astype(float), rows.column("k").to_numpy() % 3 == 0
    with_lexicon = rows.column("l").to_numpy(zero_copy_only=False).astype(bool)
    return Model(lexicons[-1], tables, Scorer(x[:, : len(FEATURES)], y, held), Scorer(x[with_lexicon], y[with_lexicon], held[with_lexicon]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", threshold: float = THRESHOLD, lexicon=None, second=SECOND_PERSON, **fit) -> DataFrame:
    """(doc_id, toxicity, toxic) of every row; the cases are defined above."""
    model = fit_toxicity(docs, labels, id_col, text_col, lang_col=lang_col, lexicon=lexicon, second=second, **fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.predict(batch.column(2), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= threshold)], ["doc_id", "toxicity", "toxic"])

    rows = docs.select(F.col(id_col).alias("doc_id"), _language(docs, lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, toxicity double, toxic boolean")
