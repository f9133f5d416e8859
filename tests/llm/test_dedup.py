"""Line, exact and near dedup against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bagminhash, components
from lectern.llm.exact_dedup import exact_dedup, exact_duplicates
from lectern.llm.line_dedup import decode_runs, line_dedup

from .helpers import AWKWARD, CLASH, docs_of, jaccard, prose, shingle_bag


def brute_lines(rows):
    """(id, text) -> keep flags, in order of id, then as given among equal ids."""
    seen, out = set(), defaultdict(list)
    uniq = list(dict.fromkeys((i, t) for i, t, *_ in rows))
    for i, t in sorted(uniq, key=lambda r: (r[0] is not None, r[0] or 0)):
        flags = []
        for line in t.split("\n") if t is not None else []:
            flags.append(not line.strip() or line not in seen)
            if line.strip():
                seen.add(line)
        out[i].append(flags)
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_line_dedup_awkward(spark, extra):
    rows = [r for r in AWKWARD if r[0] != 5 or r[1] != "other text of the same id"]
    got = line_dedup(docs_of(spark, rows, extra)).collect()
    want = brute_lines(rows)
    assert sum(map(len, want.values())) == len(got)
    for r in got:
        flags = decode_runs(r.keep_runs)
        assert flags in want[r.doc_id] and r.n_lines == len(flags) and r.n_kept == sum(flags)


def test_line_dedup_hot_line_spans_partitions(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["same boilerplate", f"own {i}", f"shared {i % 7}", ""]) for _ in range(6)), "en", "s") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_dedup(docs_of(spark, rows).repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute_lines(rows)
    assert all([decode_runs(r.keep_runs)] == want[r.doc_id] for r in got) and len(got) == 3000


def test_exact(spark):
    got = {(r.doc_id, r.duplicate_of) for r in exact_duplicates(docs_of(spark, AWKWARD, True)).collect()}
    assert got == {(5, 4)}
    kept = exact_dedup(docs_of(spark, AWKWARD, True))
    assert set(CLASH) <= set(kept.columns)
    ids = sorted(str((r.doc_id, r.text)) for r in kept.collect())
    want = sorted(str((i, t)) for i, t, *_ in AWKWARD if not (i == 5 and t.startswith("One")))
    assert ids == want


@pytest.mark.parametrize("limit", [0, 10**6])
def test_exact_both_ways_and_repeated_rows(spark, limit):
    rows = [(3, "a", "en", "s"), (3, "a", "en", "s"), (1, "a", "en", "s"), (None, "a", "en", "s"), (7, "b", "en", "s"), (8, "", "en", "s"), (9, "", "en", "s"), (10, "prefix" * 20 + "1", "en", "s"), (11, "prefix" * 20 + "2", "en", "s")]
    df = docs_of(spark, rows)
    assert sorted(map(str, ((r.doc_id, r.duplicate_of) for r in exact_duplicates(df, broadcast_keys=limit).collect()))) == sorted(map(str, [(3, 1), (3, 1), (None, 1), (9, 8)]))
    assert sorted(r.doc_id for r in exact_dedup(df, broadcast_keys=limit).collect()) == [1, 7, 8, 10, 11]


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert line_dedup(none).count() == exact_dedup(none).count() == exact_duplicates(none).count() == 0
    assert bagminhash.near_duplicates(none).count() == 0 and bagminhash.near_dedup(none).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    for a, b in (({1: 5, 2: 1, 3: 7, 4: 2}, {1: 3, 2: 2, 3: 7, 5: 1}), ({1: 1}, {1: 3}), ({1: 100, 2: 3}, {1: 64, 2: 30})):
        want = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        est = []
        for _ in range(60):
            salt = rng.integers(1, 1 << 62, 8, dtype=np.uint64)
            row, item, count = zip(*[(r, salt[k], c) for r, bag in enumerate((a, b)) for k, c in bag.items()], strict=True)
            s = bagminhash.signatures(np.array(row), np.array(item), np.array(count), 2)
            est.append((s[0] == s[1]).mean())
        assert abs(np.mean(est) - want) < 0.025


def near_rows(seed=5):
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(40):
        base = prose(rng, rng.choice([8, 40, 120, 300])).split()
        for c in range(rng.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(len(w) * rng.choice([0, 2, 5]) // 100 if c else 0):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((n * 3, " ".join(w), "en", "s"))
            n += 1
    rng.shuffle(rows)
    return rows


def groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent) if find(x) != x}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_near_against_all_pairs(spark, limit):
    rows = near_rows()
    bags = {i: shingle_bag(t) for i, t, *_ in rows}
    ids = sorted(bags)
    want = groups([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(bags[a], bags[b]) >= bagminhash.THRESHOLD])
    found = {(r.doc_id, r.duplicate_of) for r in bagminhash.near_duplicates(docs_of(spark, rows, True), broadcast_nodes=limit).collect()}
    assert len(found & want) >= 0.97 * len(want) and not {a for a, _ in found} - {a for a, _ in want}
    kept = bagminhash.near_dedup(docs_of(spark, rows), broadcast_nodes=limit)
    assert {r.doc_id for r in kept.collect()} == set(ids) - {a for a, _ in found}


def test_near_members_unlike_their_hub(spark):
    """A bucket whose least document is unlike the others: those must still find each other."""
    rng = random.Random(8)
    base = prose(rng, 200).split()
    half = base[:100] + prose(rng, 100).split()
    rows = [(0, " ".join(half), "en", "s"), (1, " ".join(base), "en", "s"), (2, " ".join(base[:-2] + ["zz", "yy"]), "en", "s"), (3, " ".join(base[:-3] + ["xx"]), "en", "s")]
    found = {(r.doc_id, r.duplicate_of) for r in bagminhash.near_duplicates(docs_of(spark, rows), m=128, rows=1).collect()}
    assert {(2, 1), (3, 1)} <= found and not any(a == 0 or b == 0 for a, b in found)


def test_near_awkward(spark):
    found = {(r.doc_id, r.duplicate_of) for r in bagminhash.near_duplicates(docs_of(spark, AWKWARD, True)).collect()}
    assert found == {(5, 4)}
    kept = bagminhash.near_dedup(docs_of(spark, AWKWARD, True))
    assert len(kept.columns) == len(docs_of(spark, AWKWARD, True).columns)
    assert kept.count() == len(AWKWARD) - 2  # both repeated rows of 5
    again = docs_of(spark, [(1, "the same words here", "en", "s"), (1, "the same words here", "en", "s"), (2, "the same words here", "en", "s")])
    assert [r.doc_id for r in bagminhash.near_dedup(again).collect()] == [1]


def test_overlap_kernel():
    import pyarrow as pa

    rng = random.Random(2)
    left = [prose(rng, 30) for _ in range(50)] + ["", None, "one"]
    right = [" ".join(w for w in t.split() if rng.random() > 0.1) for t in left[:50]] + ["", "a b", "one"]
    got = bagminhash.overlap(pa.array(left), pa.array(right))
    want = [jaccard(shingle_bag(a), shingle_bag(b)) for a, b in zip(left, right, strict=True)]
    assert np.allclose(got, want)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1040)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert {(r.a, r.b) for r in components.components(df).collect()} == groups([p for p in pairs if p[0] != p[1]])
    assert components.components(df.where(F.lit(False))).count() == 0


def test_ids_of_any_type_and_lone_repeated_rows(spark):
    rng = random.Random(31)
    same, other = prose(rng, 40), prose(rng, 40)
    rows = [("b", same, 1), ("a", same + " more", 2), ("c", other, 3), ("c", other, 3), (None, prose(rng, 30), 4), ("d", None, 5), ("d", None, 5)]
    df = spark.createDataFrame(rows, "doc_id string, text string, n int")
    assert [(r.doc_id, r.duplicate_of) for r in bagminhash.near_duplicates(df).collect()] == [("b", "a")]
    kept = sorted((str(r.doc_id), r.n) for r in bagminhash.near_dedup(df).collect())
    assert kept == [("None", 4), ("a", 2), ("c", 3), ("d", 5), ("d", 5)]  # rows without words all stay
    lines = {r.doc_id: r.keep_runs for r in line_dedup(spark.createDataFrame([("z", "one\ntwo"), ("y", "two\nthree"), (None, "one")], "doc_id string, text string")).collect()}
    assert lines == {None: "1", "y": "2", "z": "0,2"}
