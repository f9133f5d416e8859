"""Toxicity, quality and language-model scoring."""

import math
import pickle
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import kneser_ney, masked_lm, toxicity

from .helpers import AWKWARD, docs_of, prose, words_of


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def toxic_rows(n=600, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        w = prose(rng, rng.randint(5, 120)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "SCUM", "m0ron", "you trash", "i.d.i.o.t"]))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    got = {r.doc_id: r for r in toxicity.toxicity(docs_of(spark, rows, True), labels_of(spark, labels[:400])).collect()}
    held = [(got[i].toxic, bool(t)) for i, _, t in labels[400:]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.toxicity <= 1 and r.toxic == (r.toxicity >= 0.5) for r in got.values())


def test_toxicity_cases(spark):
    docs = docs_of(spark, AWKWARD, True)
    got = toxicity.toxicity(docs, labels_of(spark, [])).collect()
    assert len(got) == len(AWKWARD) and all(r.toxicity == 0 and not r.toxic for r in got)
    rows, labels = toxic_rows(200)
    many = labels_of(spark, labels + [(None, 1, 1), (3, 1, None), (9999, 0, 1), (1, 1, 0)])
    got = toxicity.toxicity(docs_of(spark, rows + AWKWARD), many).collect()
    assert len(got) == 200 + len(AWKWARD)
    assert toxicity.toxicity(docs_of(spark, []), many).count() == 0
    assert all(r.toxicity == 1 for r in toxicity.toxicity(docs_of(spark, [(1, "a b", "en", "s")]), labels_of(spark, [(1, 1, 1)])).collect())


def test_features_are_counts():
    tables = toxicity._tables(toxicity.LEXICON, toxicity.SECOND_PERSON)
    texts = ["You are an IDIOT, idiot!", "", None, "plain words", "no hit\nidiot", "far " * 50 + "idiot " + "far " * 50 + "you"]
    x = toxicity._features(pa.array(texts), tables)
    name = {n: k for k, n in enumerate(toxicity.FEATURES)}
    assert x[0, name["insult"]] == pytest.approx(2 / 5) and x[0, name["near_share"]] == 1 and x[0, name["second_person"]] == pytest.approx(1 / 5)
    assert x[0, name["capitals"]] == pytest.approx(6 / 18) and x[0, name["exclamation"]] == pytest.approx(1 / 24)
    assert x[1, -1] == x[2, -1] == -1 and x[5, name["near_share"]] == 0
    y = toxicity._features(pa.array(["1d10t and i.d.i.o.t"]), tables)
    assert y[0, name["obfuscated_hits"]] == pytest.approx(math.log(3))


def invented_rows(n=900, seed=21):
    """Documents of an invented language; insults are words of it that no list has."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        w = prose(rng, rng.randint(20, 80)).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgu", "zorgulan", "vekkip", "ÜMLOK"]))
        rows.append((i, " ".join(w), "xx" if i % 4 else None, "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_insults_of_an_unlisted_language_are_learned(spark):
    rows, labels = invented_rows()
    got = {r.doc_id: r for r in toxicity.toxicity(docs_of(spark, rows), labels_of(spark, labels[:600])).collect()}
    held = [(got[i].toxic, bool(t)) for i, _, t in labels[600:]]
    assert np.mean([a for a, b in held if b]) >= 0.9 and np.mean([not a for a, b in held if not b]) >= 0.98
    plain = toxicity.toxicity(docs_of(spark, rows).drop("lang"), labels_of(spark, labels[:600])).collect()
    assert len(plain) == len(rows) and np.mean([r.toxic == (r.doc_id % 6 == 0) for r in plain if r.doc_id >= 600]) >= 0.95


def test_a_language_without_labels_falls_back_on_the_lists(spark):
    rows, labels = toxic_rows(500)
    other = [(1000 + i, t, "yy", "s") for i, t, *_ in rows[:200]]
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(docs_of(spark, rows + other), labels_of(spark, labels)).collect()}
    assert np.mean([got[1000 + i] == bool(t) for i, _, t in labels[:200]]) > 0.95


def test_learned_lexicon_against_dictionaries(spark):
    rows, labels = invented_rows(300)
    model = toxicity.fit_toxicity(docs_of(spark, rows), labels_of(spark, labels))
    for lang, code in (("xx", None), (None, None)):
        code = spark.sql(f"SELECT xxhash64('{lang}') AS h" if lang else "SELECT xxhash64('\\0') AS h").first().h
        own = [(set(words_of(t)), labels[i][2]) for i, t, g, _ in rows if g == lang]
        t, n = sum(y for _, y in own), len(own)
        for kind, cut in ((0, lambda w: w.encode()), (1, lambda w: w.encode()[: toxicity.PREFIX])):
            toxic, every = Counter(), Counter()
            for ws, y in own:
                items = {cut(w) for w in ws}
                every.update(items)
                toxic.update(items if y else ())
            for w in sorted({w for ws, _ in own for w in ws}):
                a, c = toxic[cut(w)], every[cut(w)] - toxic[cut(w)]
                odds = math.log((a + 0.5) / (t + 1)) - math.log((c + 0.5) / (n - t + 1))
                want = odds if a >= toxicity.LEAST_TOXIC and odds > math.log(toxicity.RATIO) else 0
                d = np.frombuffer(w.encode(), np.uint8)
                h, start, end, _ = toxicity.words(d, np.array([0, len(d)]))
                item = h if kind == 0 else toxicity._stems(h, d, start, end)
                assert model.lexicon.weigh(kind, item, np.array([code])).tolist() == pytest.approx([want]), (w, kind)
    # the features of the lexicon, from the words one by one
    text = "You ZORGU, be vekkip " + "an " * 9 + "ümlok"
    code = spark.sql("SELECT xxhash64('xx') AS h").first().h
    got = toxicity._learned(pa.array([text, None, ""]), np.full(3, code), np.zeros(3, np.int64), [model.lexicon], model.tables[1])
    w = []
    for x in words_of(text):
        d = np.frombuffer(x.encode(), np.uint8)
        w.append(model.lexicon.weigh(0, toxicity.words(d, np.array([0, len(d)]))[0], np.array([code]))[0])
    assert sum(x > 0 for x in w) == 3
    near = sum(x for k, x in enumerate(w) if 0 < abs(k) <= toxicity.NEAR)
    assert got[0, :4].tolist() == pytest.approx([sum(w) / len(w), max(w), math.log1p(3), near / len(w)]) and not got[1:].any()


def test_a_document_enters_the_fit_with_the_lexicon_of_the_other_folds(spark):
    """Words that are in toxic documents of one fold only never count for that fold."""
    lang, y = np.zeros(60, np.int64), np.array([1] * 30 + [0] * 30)
    fold = np.array([0] * 15 + [1] * 15 + [0] * 15 + [1] * 15, np.int32)
    texts = ["mark one"] * 15 + ["other two"] * 15 + ["none"] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(fold), pa.array(lang), pa.array(y.astype(np.int32)), pa.array(texts)], ["f", "zl", "zy", "zt"])
    counts = spark.createDataFrame(pa.Table.from_batches(toxicity._occurrences(iter([batch]))).to_pandas())
    lexicons = toxicity._lexicons(counts, {(0, 0): (15, 30), (0, 1): (15, 30)})
    h = toxicity.word_hash("mark")
    weight = lambda k: lexicons[k].weigh(0, np.array([h], np.uint64), np.zeros(1, np.int64))[0]
    assert weight(0) == 0 and weight(1) > 0 and weight(toxicity.FOLDS) > 0


def test_a_boosting_round_against_all_splits():
    rng = np.random.default_rng(4)
    x = np.round(rng.random((400, 3)), 2)
    y = ((x[:, 1] > 0.6) ^ (rng.random(400) < 0.1)).astype(float)
    t = toxicity.Trees(rounds=1, depth=1, rate=1.0).fit(x, y)
    p, best = y.mean(), (-1.0, None, None)
    g, h = p - y, np.full(400, p * (1 - p))
    for k in range(3):
        for c in t.cuts[k]:
            left = x[:, k] <= c
            if min(left.sum(), (~left).sum()) < t.least:
                continue
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + t.ridge) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + t.ridge)
            if gain > best[0] + 1e-9:
                best = gain, k, c
    feature, cut, value = t.trees[0]
    assert (feature[0], cut[0]) == best[1:]
    left = x[:, best[1]] <= best[2]
    want = np.where(left, *(-g[m].sum() / (h[m].sum() + t.ridge) for m in (left, ~left)))
    assert np.allclose(t.score(x) - t.start, want)


def test_isotonic():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500).round(1)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float)
    xs, p = toxicity.isotonic(s, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(p) >= -1e-12).all()
    assert np.interp(s, xs, p).mean() == pytest.approx(y.mean())


# quality


def brute_kn(texts):
    """Log-probability of a text under interpolated modified Kneser-Ney of order 5, from dictionaries."""
    n, pad = kneser_ney.ORDER, "\n" * (kneser_ney.ORDER - 1)
    counts = {n: Counter((pad + t)[i - n + 1 : i + 1] for t in texts for i in range(n - 1, len(pad + t)))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc = {k: kneser_ney.discounts(*[sum(c == j for c in counts[k].values()) for j in (1, 2, 3, 4)]) for k in counts}
    cut = lambda k, c: disc[k][min(c, 3) - 1]
    total, mass = {}, {}
    for k in counts:
        total[k], mass[k] = defaultdict(int), defaultdict(float)
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            mass[k][g[:-1]] += cut(k, c)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / kneser_ney.SYMBOLS
        h = g[:-1]
        if h not in total[k]:
            return p(g[1:])
        c = counts[k].get(g, 0)
        return ((c - cut(k, c)) if c else 0) / total[k][h] + mass[k][h] / total[k][h] * p(g[1:])

    return lambda t: sum(math.log(p((pad + t)[i - n + 1 : i + 1])) for i in range(n - 1, len(pad + t)))


@pytest.mark.parametrize("limit", [0, 10**7])
def test_quality_matches_dictionaries(spark, limit):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 25)) + rng.choice(["", "\né", "."]), "en", "s") for i in range(120)] + [(500, "!!!zz qq", "en", "s"), (501, "", "en", "s"), (502, None, "en", "s"), (503, "日本 😀", "de", "s")]
    labels = labels_of(spark, [(i, 1, 0) for i in range(80)])
    fitted = kneser_ney.fit_quality(docs_of(spark, rows), labels, broadcast_ngrams=limit)
    df = docs_of(spark, rows)
    got = {r.doc_id: r.zp for r in fitted.scored(df, [df.doc_id], "text").collect()}
    held = spark.range(80).selectExpr("id", "pmod(xxhash64(id), 10) = 0 AS h").where("h").collect()
    score = brute_kn([t for i, t, *_ in rows[:80] if i not in {r.id for r in held}])
    for i, t, *_ in rows:
        if t and i != 503:
            assert got[i] == pytest.approx(math.exp(-score(t) / len(t)), rel=1e-4)
    assert got[501] is None and got[502] is None and got[503] > 100


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 60), "en" if i % 2 else None, "s") for i in range(900)]
    rows += [(2000 + i, "".join(rng.choice("%&$#@!XQZ ") for _ in range(200)), "en", "s") for i in range(40)]
    labels = labels_of(spark, [(i, 1, 0) for i in range(600)] + [(600, None, 0), (None, 1, 0), (2000, 0, 0), (2001, 1, 0), (2001, 0, 0)])
    kept = {r.doc_id for r in kneser_ney.quality_filter(docs_of(spark, rows, True), labels).collect()}
    assert not any(k >= 2000 for k in kept) and len(kept) >= 0.97 * 900
    got = kneser_ney.quality(docs_of(spark, rows), labels).collect()
    assert {r.doc_id for r in got if r.keep} == kept and len(got) == len(rows)


@pytest.mark.parametrize("limit", [0, 10**7])
def test_quality_cases(spark, limit):
    none = labels_of(spark, [])
    got = kneser_ney.quality(docs_of(spark, AWKWARD, True), none, broadcast_ngrams=limit).collect()
    assert len(got) == len(AWKWARD) and all(r.keep == (r.perplexity is not None) for r in got)
    some = labels_of(spark, [(i, 1, 0) for i, *_ in AWKWARD])
    out = kneser_ney.quality_filter(docs_of(spark, AWKWARD, True), some, broadcast_ngrams=limit)
    assert out.columns == docs_of(spark, AWKWARD, True).columns and out.count() <= len(AWKWARD) - 3
    assert kneser_ney.quality(docs_of(spark, []), some, broadcast_ngrams=limit).count() == 0


def test_model_table_finds_every_key():
    rng = np.random.default_rng(2)
    k = np.unique(rng.integers(0, 1 << 62, 50_000))
    d, b = rng.random(len(k), np.float32), rng.random(len(k), np.float32)
    t = kneser_ney.Table(k, d, b)
    assert np.array_equal(t.get(k)[:, 0], d) and np.array_equal(t.get(k)[:, 1], b)
    assert not t.get(np.setdiff1d(rng.integers(0, 1 << 62, 1000), k)).any()


# masked language model


def test_gradients():
    net, rng = masked_lm.Network(dim=4, window=2, classes=5), np.random.default_rng(3)
    rows = rng.integers(0, net.vocab + 1, (3, 20))
    start = net.flat().astype(np.float64)
    size = sum(x.size for x in net.p)
    for k, x in enumerate(net.squares):
        net.squares[k] = np.full_like(x, 1e12)  # so the step is the gradient, scaled
    n = net.train(rows, step=1e6)
    grad = (start - net.flat())[:size]
    assert n == (rows[:, 2:-2] < net.vocab).sum()
    at = 0
    for x in net.p:  # the largest gradients of each kind of parameter
        for k in at + np.argsort(-np.abs(grad[at : at + x.size]))[:2]:
            e = np.zeros_like(start)
            e[k] = 1e-2
            up, down = (masked_lm.Network(dim=4, window=2, start=start + s * e, classes=5).log_p(rows).sum() for s in (1, -1))
            assert -(up - down) / 2e-2 / math.sqrt(n) == pytest.approx(grad[k], rel=0.05, abs=2e-4)
        at += x.size


def test_probabilities_sum_to_one():
    net = masked_lm.Network()
    rows = np.tile(np.array([[1, 2, 3, 0, 4, 5, net.vocab]]), (net.vocab, 1))
    rows[:, 3] = np.arange(net.vocab)
    assert np.exp(net.log_p(rows)).sum() == pytest.approx(1, abs=1e-4)


def slow_log_p(net, units, i):
    """The log-probability of one position and the gradients of its negative, from loops over plain arrays."""
    e, pos, b, wc, bc, ww, bw = (x.astype(np.float64) for x in net)
    classes, window = len(bc), len(pos) // 2
    ctx = [units[j] if 0 <= j < len(units) else len(e) - 1 for j in [*range(i - window, i), *range(i + 1, i + window + 1)]]
    z = b + sum(e[u] * pos[k] for k, u in enumerate(ctx))
    h = z / (1 + np.abs(z))
    c, w = divmod(int(units[i]), classes)
    grads, dh, lp = [np.zeros_like(x) for x in (e, pos, b, wc, bc, ww, bw)], np.zeros(len(b)), 0.0
    for weights, bias, target, g, gb in ((wc, bc, c, grads[3], grads[4]), (ww[c], bw[c], w, grads[5][c], grads[6][c])):
        f = np.maximum(1 + (h @ weights + bias) / 256, 0) ** 256
        p = f / f.sum()
        lp += math.log(p[target])
        p[target] -= 1
        g += np.outer(h, p)
        gb += p
        dh += weights @ p
    dz = dh / (1 + np.abs(z)) ** 2
    grads[2] += dz
    for k, u in enumerate(ctx):
        grads[0][u] += dz * pos[k]
        grads[1][k] += dz * e[u]
    return lp, grads


def test_training_against_loops():
    """Two steps of a part, and the scores after them, as loops over positions have them."""
    rng = np.random.default_rng(8)
    net = masked_lm.Network(dim=4, window=2, classes=4)
    docs = [rng.integers(0, net.vocab, n).astype(np.uint16) for n in (300, 1, 260, 90)]
    slow, squares = [x.astype(np.float64) for x in net.p], [x.astype(np.float64) for x in net.squares]
    part = masked_lm.Training(net)
    for d in docs:
        part.add(d.tobytes())
    part.flush()
    # the same positions, in the same segments and order
    units, begin = masked_lm._bounded([d.tobytes() for d in docs], net.vocab, 2)
    where = [(d, i) for d in range(len(docs)) for i in range(len(docs[d]))]
    place = {int(begin[d]) + i - 2: (d, i) for d, i in where}
    segments = np.random.default_rng([net.seed, 0]).permutation(-(-(len(units) - 4) // masked_lm.SEGMENT))
    per = masked_lm.BATCH // masked_lm.SEGMENT
    for a in range(0, len(segments), per):
        own = [place[k] for s in segments[a : a + per] for k in range(s * masked_lm.SEGMENT, (s + 1) * masked_lm.SEGMENT) if k in place]
        total = [np.zeros_like(x) for x in slow]
        for d, i in own:
            for t, g in zip(total, slow_log_p(slow, docs[d].tolist(), i)[1], strict=True):
                t += g / math.sqrt(len(own))
        for k, g in enumerate(total):
            axis = {0: 1, 3: 0, 5: 1}.get(k)
            squares[k] += g * g if axis is None else (g * g).mean(axis=axis, keepdims=True)
            slow[k] -= masked_lm.STEP * g / (np.sqrt(squares[k]) + 1e-5)
    assert part.seen == len(where)
    for a, b in zip(net.p, slow, strict=True):
        assert np.allclose(a, b, atol=5e-3)
    model = masked_lm.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), net)
    want = [sum(slow_log_p(net.p, d.tolist(), i)[0] for i in range(len(d))) for d in docs]
    assert model.totals([d.tobytes() for d in docs]).tolist() == pytest.approx(want, rel=1e-4)


def test_training_beats_unigrams_on_held_out(spark):
    rng = random.Random(9)
    follow = {w: rng.sample(range(40), 3) for w in range(40)}

    def text(n):
        w, out = rng.randrange(40), []
        for _ in range(n):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    train = docs_of(spark, [(i, text(200), "en", "s") for i in range(400)]).repartition(3)
    model = masked_lm.fit(train)
    held = [text(300) for _ in range(20)]
    n, total = model.score(pa.array(held))
    assert list(n) == [300] * 20 and total.sum() / n.sum() > -2.2 > -math.log(40)  # unigrams: about -3.7


def test_masked_lm_brute_force_and_cases(spark):
    docs = docs_of(spark, AWKWARD, True)
    got = masked_lm.pseudo_likelihood(docs).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got if r.doc_id in (1, 2, 3, 7)}
    assert all(r.n_words == 0 and r.log_likelihood == 0 and r.mean_log_likelihood is None for r in by.values())
    model = masked_lm.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), masked_lm.Network())
    text = "One two Three 44 five élan"
    data = np.frombuffer(text.encode(), np.uint8)
    units = masked_lm._units(data, np.array([0, len(data)]), model.table, model.ids)[0].tolist()
    want = sum(slow_log_p(model.net.p, units, i)[0] for i in range(len(units)))
    n, total = model.score(pa.array([text, None]))
    assert n.tolist() == [6, 0] and total[0] == pytest.approx(want, rel=1e-5)
    assert masked_lm.pseudo_likelihood(docs_of(spark, [])).count() == 0


def test_scores_do_not_depend_on_the_partitions(spark):
    rng = random.Random(14)
    rows = [(i if i % 7 else None, prose(rng, rng.randint(1, 60)), "en", "s") for i in range(500)] + [(3, "the same row", "en", "s")] * 300
    one, many = (sorted((r.n_words, r.log_likelihood) for r in masked_lm.pseudo_likelihood(docs_of(spark, rows).repartition(k)).collect()) for k in (1, 7))
    assert len(one) == len(rows) and np.allclose(one, many, rtol=1e-5)


def test_parts_are_averaged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    v, n = rng.random((11, 2, 4)).astype(np.float32), rng.integers(1, 9, 11).astype(float)
    rows = [(p, b, float(n[p]), v[p, b].tobytes()) for p in range(11) for b in (0, 1) if p != 4]  # an empty part has no row
    got = masked_lm._mean(spark.createDataFrame(rows, masked_lm._STATE), 11)
    keep = np.arange(11) != 4
    for b in (0, 1):
        assert np.allclose(got[b], np.average(v[keep, b], axis=0, weights=n[keep]), rtol=1e-5)


def test_every_word_is_predicted_as_itself(spark):
    rng = random.Random(11)
    vocabulary = list({prose(rng, 1) + str(k) for k in range(3000)})
    rows = [(i, " ".join(rng.choices(vocabulary, k=200)), "en", "s") for i in range(150)]
    model = masked_lm.fit(docs_of(spark, rows), rounds=1)

    def units(text):
        return masked_lm._units(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), model.table, model.ids)[0].tolist()

    words = vocabulary + [w[::-1] for w in vocabulary] + ["日本", "日木", "élan", "elan", "x" * 5000, "x" * 5001, "never", "nevre"]
    assert len({tuple(units(w)) for w in words}) == len(set(words))  # not two words alike, also none of the corpus
    some = rng.sample(words, 60)
    assert units(" ".join(some)) == [u for w in some for u in units(w)] and max(map(max, map(units, words))) < model.net.vocab
    got = masked_lm.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), masked_lm.Network())
    assert masked_lm._units(np.frombuffer(b"Ab c", np.uint8), np.array([0, 4]), got.table, got.ids)[0].tolist() == [97, 256 + 98, 99]


def test_units_grow_with_the_corpus(spark):
    rng = random.Random(12)
    vocabulary = [f"{prose(rng, 1)}{k}" for k in range(1500)]
    sizes = [len(masked_lm.fit(docs_of(spark, [(i, " ".join(vocabulary), "en", "s") for i in range(n)]), rounds=1).table) for n in (1, 100)]
    assert 976 <= sizes[0] < 1500 <= sizes[1]


def test_every_position_is_trained_on(spark, monkeypatch):
    """Over rounds and parts each unit of each document once; equal rows count as one."""
    rng, seen = random.Random(13), []
    texts = [prose(rng, n) for n in (1, 2, 3, 50, 2000)] + ["one two"] * 20 + ["", None]
    rows = [(min(i, 6), t, "en", "s") for i, t in enumerate(texts)]
    units, mean = [], masked_lm._mean

    def watched(local, parts):
        seen.append((parts, [(r.part, r.n) for r in local.where("block = 0").select("part", "n").collect()]))
        return mean(local, parts)

    monkeypatch.setattr(masked_lm, "_mean", watched)
    monkeypatch.setattr(masked_lm, "PART_UNITS", 100)
    model = masked_lm.fit(docs_of(spark, rows), id_col="doc_id")
    units = sum(len(masked_lm._units(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), model.table, model.ids)[0]) for _, t in {r[:2] for r in rows if r[1]})
    assert len(seen) == masked_lm.ROUNDS and seen[0][0] > 1 and sum(n for _, of in seen for _, n in of) == units


def test_outputs_are_worked_on_in_blocks(monkeypatch):
    """Blocks change neither steps nor scores, and no array of all positions by all classes is made."""
    rng = np.random.default_rng(5)
    nets, scores = [], []
    rows = rng.integers(0, 30 * 30 + 1, (12, 70)) // rng.integers(1, 40, (12, 70))
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(masked_lm, "CACHED", size)
        nets.append(masked_lm.Network(dim=6, classes=30))
        assert [nets[-1].train(rows) for _ in range(3)] == [int((rows[:, 3:-3] < 900).sum())] * 3
        scores.append(nets[-1].log_p(rows))
    for net, lp in zip(nets, scores, strict=True):
        assert np.allclose(net.flat(), nets[0].flat(), atol=1e-3) and np.allclose(lp, scores[0], atol=1e-2)
    monkeypatch.undo()
    net, rows = masked_lm.Network(classes=200), rng.integers(0, 200 * 200, (256, 70))
    tracemalloc.start()
    net.log_p(rows)
    assert tracemalloc.get_traced_memory()[1] - net.p[5].nbytes * 2 < 256 * 64 * 200 * 4
    tracemalloc.stop()


def test_a_training_step_works_in_place():
    """No copy of the output vectors is made in a step, whatever the classes that occur."""
    net, rng = masked_lm.Network(classes=200), np.random.default_rng(6)
    rows = rng.integers(0, 200 * 200, (8, 70))
    rows[:, ::9] %= 3 * 200
    net.train(rows)
    held = net.p[5]
    tracemalloc.start()
    assert net.train(rows) == 8 * 64
    assert tracemalloc.get_traced_memory()[1] < net.p[5].size * 4 / 2
    tracemalloc.stop()
    assert net.p[5] is held
    # views and what they are of stay one also in a copy on a worker
    other = pickle.loads(pickle.dumps(net))
    assert np.array_equal(net.log_p(rows), other.log_p(rows))
    assert net.train(rows) == other.train(rows) and np.array_equal(net.flat(), other.flat())
    assert np.array_equal(net.log_p(rows), other.log_p(rows))


def test_units_of_hashes_against_a_dictionary():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 5000):
        table = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        table = np.unique(np.concatenate([table, table[:20] ^ np.uint64(1), np.array([0, 2**64 - 1] if n else [], np.uint64)]))  # some with equal upper bits, and the ends
        ids = rng.permutation(len(table))
        h = np.concatenate([table, rng.integers(0, 1 << 64, 300, np.uint64), table[::-1], table + np.uint64(2)])
        units = dict(zip(table.tolist(), ids.tolist(), strict=True))
        assert masked_lm._find(h, table, ids).tolist() == [units.get(x, -1) for x in h.tolist()]
    assert len(masked_lm._find(np.zeros(0, np.uint64), table, ids)) == 0
