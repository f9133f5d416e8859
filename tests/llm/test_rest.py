"""Mixing, URL filters, embeddings, BPE and the pipeline."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, embedding, mixing, url_filter
from lectern.llm.common import PIECE

from .helpers import AWKWARD, CLASH, docs_of, jaccard, prose, shingle_bag


# mixing


def test_quotas():
    assert mixing.quotas({"a": 10, "b": 10}, {"a": 1, "b": 3}) == {"a": 3, "b": 10}
    assert mixing.quotas({"a": 5, "b": 9}, {"b": 1}) == {"a": 0, "b": 9} and mixing.quotas({}, {}) == {}
    for bad in ({"a": -1}, {"a": 0}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            mixing.quotas({"a": 5}, bad)


def test_tree_is_exact_and_hypergeometric():
    q = [7, 40, 0, 113]
    tree = mixing.splitting_tree(q, 9, 5)
    counts = np.diff(tree, axis=1)
    assert counts.sum(axis=1).tolist() == q and (counts >= 0).all()
    assert counts.sum(axis=0).max() - counts.sum(axis=0).min() <= 1
    draws = np.array([np.diff(mixing.splitting_tree([30, 70], 4, s), axis=1)[0] for s in range(800)])
    want = 25 * 0.3 * 0.7 * 75 / 99  # variance of a hypergeometric draw of 25 from 100
    assert abs(draws.mean() - 7.5) < 0.1 and np.allclose(draws.var(axis=0), want, rtol=0.2)


def test_permutation():
    for n in (1, 2, 7, 1000):
        b = np.arange(n)
        assert sorted(mixing.permuted(b, np.full(n, n), 3).tolist()) == b.tolist()


def mix_rows(seed=2):
    rng = random.Random(seed)
    return [(i, prose(rng, 5), "en", rng.choice(["hot"] * 8 + ["b", "c", None])) for i in range(4000)]


def test_mix_against_brute_force(spark):
    rows = mix_rows()
    sizes = Counter(r[3] for r in rows)
    got = mixing.mix_sources(docs_of(spark, rows, True), shard_blocks=64).collect()
    blocks = {s: max(1, round(n / mixing.BLOCK_DOCS)) for s, n in sizes.items()}
    quota = mixing.quotas(blocks, {s: n**mixing.ALPHA for s, n in sizes.items()})
    drawn = Counter(r.source for r in got)
    for s, n in sizes.items():
        assert drawn[s] == pytest.approx(n * quota[s] / blocks[s], rel=0.15)
    assert len({r.doc_id for r in got}) == len(got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in by.values())
    names = sorted(sizes, key=lambda s: (s is not None, str(s)))
    shards = -(-sum(quota.values()) // 64)
    tree = mixing.splitting_tree([quota[s] for s in names], shards, mixing.SEED)
    keys = {r.doc_id: r.h for r in docs_of(spark, rows).select("doc_id", F.xxhash64("doc_id", F.xxhash64("text", F.lit(7))).alias("h")).collect()}
    want = {}
    for i, _, _, s in rows:
        n = blocks[s]
        u = int(mixing.mix(np.array([keys[i] % 2**64], np.uint64) + np.uint64(mixing.SEED))[0]) >> 11
        rank = int(mixing.permuted(np.array([min(int(u * (n / 2.0**53)), n - 1)]), np.array([n]), mixing.SEED)[0])
        t = tree[names.index(s)]
        if rank < t[-1]:
            want[i] = next(k for k in range(shards) if t[k] <= rank < t[k + 1])
    assert {r.doc_id: r.shard for r in got} == want
    whole = mixing.mixed(docs_of(spark, rows, True), shard_blocks=64)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(want) and set(CLASH) <= set(whole.columns)


def test_mix_weights_and_cases(spark):
    got = mixing.mix_sources(docs_of(spark, mix_rows()), weights={"b": 1.0, None: 1.0}).collect()
    n = Counter(r.source for r in got)
    assert set(n) == {"b", None} and abs(n["b"] - n[None]) < 0.2 * n["b"]
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0 and mixing.mixed(docs_of(spark, [])).count() == 0
    assert 0 < mixing.mix_sources(docs_of(spark, AWKWARD, True)).count() <= len(AWKWARD)
    many = docs_of(spark, [(i, "x", "en", None if i % 90 == 0 else f"s{i % 90}") for i in range(900)])
    assert len({r.source for r in mixing.mix_sources(many, block_docs=1).collect()}) == 90


# URL filters

RULES = [("block", "example.com"), ("allow", "good.example.com"), ("block", "good.example.com/bad"), ("allow", "good.example.com/bad/ok"), ("block", "org"), ("allow", "org"), ("block", "[::1]")]
URLS = [
    None, "", "not a url", "http://example.com/x", "https://u:p@GOOD.Example.com.:8080/Bad/x?q=1#f", "https://good.example.com/bad/y", "https://good.example.com//bad//ok/z", "http://notexample.com/",
    "http://a.b.org", "//x.example.com/", "http://[::1]:80/", "http://good.example.com/badly", "http:///path", "http://example.com?x=/good",
]


@pytest.mark.parametrize("limit", [0, 100])
def test_urls(spark, limit):
    def brute(url):
        host, path = url_filter.parse_url(url)
        best = (-1, -1, False, None)
        for action, entry in RULES:
            h, *p = entry.split("/")
            if host and (host == h or host.endswith("." + h)) and path[: len(p)] == p:
                best = max(best, (h.count("."), len(p), action == "allow", entry))
        return best[3] is None or best[2], best[3]

    pages = spark.createDataFrame([(i, u, "html", "x") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, html string, rule string")
    got = url_filter.url_filter(pages, RULES, broadcast_rules=limit).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.allowed, r.matched_rule) == brute(r.url), r.url
    assert url_filter.url_filter(pages.limit(0), RULES, broadcast_rules=limit).count() == 0
    with pytest.raises(ValueError):
        url_filter.build_trie([("block", "/path")])


# embeddings


def test_bounds_are_rigorous():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 64)) * rng.exponential(size=(1, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    q, s, n, e = embedding.quantise(v)
    exact, approx = v @ v.T, (q.astype(float) @ q.T.astype(float)) * np.outer(s, s)
    assert (np.abs(exact - approx) <= n[:, None] * e[None, :] + e[:, None] + 1e-12).all()


def test_products_are_exact_in_many_dimensions():
    for dim in (64, 1536, 4096):
        q = np.random.default_rng(dim).integers(-127, 128, (40, dim)).astype(np.int8)
        q[0], q[1] = 127, -127
        assert np.array_equal(embedding.products(q, q), (q.astype(np.int64) @ q.astype(np.int64).T).astype(float))


def brute_classes(rows, threshold):
    """(id, class, links) of distinct (id, vector), from all pairs."""
    rows = list({(i, tuple(v)) for i, v in rows})
    u = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    near = [[b for b in range(len(rows)) if a != b and len(u[a]) == len(u[b]) and (u[a] @ u[b] >= threshold or rows[a][1] == rows[b][1])] for a in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        new = [min([root[a], *(root[b] for b in near[a])]) for a in range(len(rows))]
        if new == root:
            break
        root = new
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, least[r], len(n)) for (i, _), r, n in zip(rows, root, near, strict=True)), key=str)


def test_embedding_classes_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16))
    v = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * rng.choice([0.05, 0.2, 0.35], (60, 1)), base[:3], np.repeat(base[5:6], 40, axis=0)]).astype(np.float32)
    rows = [(f"v{i}", [float(x) for x in r], 0) for i, r in enumerate(v)] + [(f"w{i}", [float(x) for x in rng.normal(size=1536) + (i % 3) * 3], 0) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("k", "g", "tile", "root", "id", "v")})
    for threshold, size in ((0.95, 1 << 10), (0.95, 1 << 20), (0.6, 1 << 12)):
        got = embedding.near_classes(df, threshold=threshold, tile_bytes=size).collect()
        assert sorted(((r.vec_id, r.class_id, r.n_links) for r in got), key=str) == brute_classes([r[:2] for r in rows], threshold)


def test_far_tiles_are_not_compared(spark, monkeypatch):
    """Vectors in tight bunches: most pairs of tiles are pruned, and the classes are those without pruning."""
    rng = np.random.default_rng(3)
    v = np.repeat(np.eye(12)[:4], 90, axis=0) + rng.normal(size=(360, 12)) * 0.01
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    kept, partners = [], embedding._partners
    monkeypatch.setattr(embedding, "_partners", lambda packed, tiles, t: kept.append((tiles, partners(packed, tiles, t).count())) or partners(packed, tiles, t))
    one = sorted(embedding.near_classes(df, tile_bytes=1 << 10).collect())
    monkeypatch.setattr(embedding, "PRUNED_TILES", 0)
    assert one == sorted(embedding.near_classes(df, tile_bytes=1 << 10).collect()) and {r.class_id for r in one} == set(range(0, 360, 90))
    (tiles, some), (_, every) = kept
    assert every == tiles**2 and some < every / 2


def test_embedding_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.001]), (None, None), (10, [1e-200, -1e-200]), (11, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = Counter((r.vec_id, r.class_id, r.n_links) for r in embedding.near_classes(df).collect())
    assert got == Counter([(1, 1, 3), (2, 1, 3), (None, 1, 3), (1, 1, 3), *((i, i, 0) for i in (3, 4, 5, 6, 7, 8, 9, None)), (10, 10, 1), (11, 10, 1)])
    assert embedding.near_classes(df.limit(0)).count() == 0
    assert embedding.near_classes(df.where("embedding is null")).count() == 2


# BPE

needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")


def test_pretokens_follow_the_pattern():
    import regex

    pattern, rng = regex.compile(bpe.PATTERN), random.Random(1)
    parts = ["a", "B", "é", "ß", "1", "²", "'", " ", "  ", "\n", "\t", " ", "!", "%", "'s", "'re", "'ll", "日", "😀", "'t", "d", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    from lectern.llm.common import text_buffer

    data, offs = text_buffer(pa.array(texts))
    start, rows = bpe.pretokens(data, offs)
    raw, end = data.tobytes(), np.append(start[1:], len(data))
    for i, t in enumerate(texts):
        assert [raw[start[k] : end[k]].decode() for k in range(rows[i], rows[i + 1])] == pattern.findall(t)


@needs_vocabulary
def test_bpe_matches_the_tokenizer_and_round_trips(spark):
    enc, _, _ = bpe.vocabulary(bpe.VOCABULARY)
    rng = random.Random(3)
    rows = AWKWARD + [(100 + i, prose(rng, 50) + rng.choice(["  \n", "<|endoftext|>", "'s", "é" * 9]), "en", "s") for i in range(200)]
    got = bpe.encode_decode(docs_of(spark, rows, True).repartition(3)).collect()
    key = lambda i, t: (str(i), str(t))
    assert sorted(key(r.doc_id, r.text) for r in got) == sorted(key(i, t) for i, t, *_ in rows)
    for r in got:
        assert r.token_ids == (None if r.text is None else enc.encode_ordinary(r.text))
        assert r.n_tokens == (None if r.text is None else len(r.token_ids))
    assert bpe.encode_decode(docs_of(spark, [])).count() == 0
    assert [r.token_ids for r in bpe.encode(docs_of(spark, [(1, "", "en", "s")])).collect()] == [[]]


@needs_vocabulary
def test_bpe_long_texts_string_ids_and_many_shards(spark, monkeypatch):
    """A text longer than a block and a piece, ids that aren't numbers, and shards that take in several batches."""
    enc, _, _ = bpe.vocabulary(bpe.VOCABULARY)
    rng = random.Random(5)
    long = prose(rng, 300_000) + " x" * 800_000
    assert len(long) > PIECE and len(long) > 2_000_000
    texts = [long, "short", long[:100_000], None] + [prose(rng, 40) for _ in range(60)]
    df = spark.createDataFrame([(f"a{i}", t, 1) for i, t in enumerate(texts)], "doc_id string, text string, id int").repartition(5)
    monkeypatch.setattr(bpe, "SHARD_BYTES", 1 << 18)
    got = {r.doc_id: r for r in bpe.encode_decode(df).collect()}
    assert all(got[f"a{i}"].text == t and got[f"a{i}"].token_ids == (None if t is None else enc.encode_ordinary(t)) for i, t in enumerate(texts)) and len(got) == len(texts)


@needs_vocabulary
def test_decode_cases(spark):
    df = spark.createDataFrame([(1, [50000, 3]), (2, []), (3, None)], "text int, token_ids array<int>")
    enc, _, _ = bpe.vocabulary(bpe.VOCABULARY)
    got = bpe.decode(df, out_col="out").collect()
    assert [r.out for r in got] == [enc.decode([50000, 3]), "", None] and bpe.decode(df).columns == ["token_ids", "text"]
    bad = next(i for i in range(300) if enc.decode_single_token_bytes(i) == b"\xc3")
    assert bpe.decode(spark.createDataFrame([([bad],)], "token_ids array<int>")).first().text == "�"
    with pytest.raises(Exception, match="isn't in the table"):
        bpe.decode(spark.createDataFrame([([10**6],)], "token_ids array<int>")).collect()


# the pipeline


@needs_vocabulary
def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for i in range(700):
        rows.append((i, prose(rng, rng.randint(30, 80)), "en", rng.choice(["a", "a", "a", "b"])))
    for i in range(60):  # exact copies, near copies, junk
        rows.append((1000 + i, rows[i][1], "en", "b"))
        w = rows[100 + i][1].split()
        w[3] = "changed"
        rows.append((2000 + i, " ".join(w), "en", "b"))
        rows.append((3000 + i, "".join(rng.choice("%&$#@!XQZ ") for _ in range(200)), "en", "b"))
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(500)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    clean = {i for i, *_ in rows if i < 3000}
    assert not any(i >= 3000 for i in seen["quality"]) and len(set(seen["quality"]) & clean) >= 0.97 * len(clean)
    first = {}
    for i, t in sorted(seen["quality"].items()):
        first.setdefault(t, i)
    assert set(seen["exact dedup"]) == set(first.values())
    bags = {i: shingle_bag(t) for i, t in seen["exact dedup"].items()}
    gone = {b for b in bags for a in ([b - 1900] if b >= 2000 and b - 1900 in bags else []) if jaccard(bags[a], bags[b]) >= 0.55}
    assert set(seen["near dedup"]) == set(bags) - gone
    assert set(seen["source mix"]) <= set(seen["near dedup"]) and len(seen["source mix"]) > 0.5 * len(seen["near dedup"])
    assert seen["tokens"] == seen["source mix"]
    enc, _, _ = bpe.vocabulary(bpe.VOCABULARY)
    assert all(r.token_ids == enc.encode_ordinary(r.text) for r in docs.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.text for r in whole.collect()} == seen["tokens"]


def test_op3_and_the_pipeline_keep_all_sources_whole(spark, tmp_path):
    import corpus_pipeline
    from lectern.llm import queries as llm

    sizes = {"stray": 5, "one": 1, "six": 6, None: 50, "big": 500, "hot": 5000}
    sources = [s for s, n in sizes.items() for _ in range(n)]
    rows = [(i, f"text {i}", "en", s) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = llm.queries()["op3_mix_sources"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.source or "") for r in got) == [(i, s or "") for i, s in enumerate(sources)]
    assert sorted(r.doc_id for r in corpus_pipeline.mix_stage(spark, docs, str(tmp_path)).collect()) == list(range(len(rows)))


@needs_vocabulary
def test_tokens_come_in_the_order_of_the_mix(spark, tmp_path, request):
    import corpus_pipeline

    for key, value in {"spark.sql.execution.arrow.maxRecordsPerBatch": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():  # many blocks and files
        request.addfinalizer(lambda key=key, old=spark.conf.get(key): spark.conf.set(key, old))
        spark.conf.set(key, value)

    rng = random.Random(14)
    rows = [(i, prose(rng, 20), "en", rng.choice(["a", "a", "b"])) for i in range(3000)]
    corpus_pipeline.mix_stage(spark, docs_of(spark, rows), str(tmp_path)).write.parquet(f"{tmp_path}/mix")
    written = [r.doc_id for f in sorted(tmp_path.glob("mix/part-*")) for r in spark.read.parquet(str(f)).collect()]
    assert sorted(written) == list(range(3000)) != written
    corpus_pipeline.tokens_stage(spark, spark.read.parquet(f"{tmp_path}/mix"), str(tmp_path)).write.parquet(f"{tmp_path}/tokens")
    out = [r for f in sorted(tmp_path.glob("tokens/part-*")) for r in spark.read.parquet(str(f)).collect()]
    assert [r.doc_id for r in out] == written
    assert [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.position))] == written
    assert len({r.shard for r in out}) > 1
    texts = {i: t for i, t, *_ in rows}
    assert all(r.text == texts[r.doc_id] and r.n_tokens == len(r.token_ids) for r in out)
    loose = corpus_pipeline.tokens_stage(spark, docs_of(spark, rows[:50] + [(None, None, None, None)]), str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in loose) == sorted([(i or -1, t) for i, t, *_ in rows[:50]] + [(-1, "")])


def test_workers_give_memory_back_every_few_batches(monkeypatch):
    from lectern import session
    from lectern.llm import common

    given, seen = [], []
    monkeypatch.setattr(common, "release", lambda: given.append(len(seen)))
    for x in common.tidy(lambda batches: batches)(iter(range(16))):
        seen.append(x)
    between = np.diff([0, *given]) * session.BATCH_BYTES  # bytes that workers get between two releases
    assert len(seen) == 16 and between.max() <= 16 << 20
