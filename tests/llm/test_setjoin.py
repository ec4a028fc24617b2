import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelloom.llm import setjoin as J
from panelloom.operators.store import scratch_root

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(rows, n):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        out.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows, rule):
    named = [(i, s) for i, s in sets(rows, rule.n) if i is not None]
    up = {i: i for i, _ in named}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, s) in enumerate(named):
        for j, q in named[:k]:
            if s and q and rule.den * len(s & q) >= rule.num * len(s | q):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets(rows, rule.n)), key=str)


def near_copies(seed, groups=6, copies=12, words=60, edits=3):
    rng = random.Random(seed)
    rows, k = [], 0
    common = [f"c{x}" for x in range(25)]
    for g in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(words + 20 * g)] + common
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            if rng.random() < 0.2:
                w = w[: -rng.randrange(1, 8)]
            rows.append((k, " ".join(w)))
            k += 1
    rng.shuffle(rows)
    return rows


def answer(df, rule):
    return sorted(map(tuple, J.classes(df, rule).collect()), key=str)


@pytest.mark.parametrize("rule,seed", [(J.Rule(3, 9, 10), 1), (J.Rule(5, 4, 5), 2)])
def test_components_agree_with_brute_force(docs, rule, seed):
    rows = near_copies(seed)
    assert answer(docs(rows, "sid m comp"), rule) == brute(rows, rule)


def test_pivot_rounds_lose_no_link(docs, monkeypatch):
    """As long as a round finds a link another one follows, before the rest is compared; blocks are small."""
    monkeypatch.setattr(J, "BLOCK_SETS", 4)
    monkeypatch.setattr(J, "WORTHWHILE", 1_000_000)
    rows = near_copies(7, groups=2, copies=30, edits=4)
    assert answer(docs(rows), J.Rule(3, 9, 10)) == brute(rows, J.Rule(3, 9, 10))


def test_links_at_the_exact_threshold(docs):
    """18 of 20 shingles shared is 0.9; one less is below."""
    a = [f"a{k}" for k in range(21)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:-1])), (3, " ".join(a[:-2])), (4, " ".join(a[:-2] + ["q"]))]
    assert answer(docs(rows), J.Rule(3, 9, 10)) == brute(rows, J.Rule(3, 9, 10))


def test_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b"), (7, "É é x"), (8, "é é x"), (9, "same text here now"), (9, "same text here now"),
            (9, "other words stand here"), (10, "other words stand here"), (11, "w " * 20_000), (12, "w " * 20_001), (-5, "a b")]
    got = dict()
    for i, n, c in answer(docs(rows, "label"), J.Rule()):
        got.setdefault(i, set()).add((n, c))
    assert got[1] == got[2] - {(0, 2)} | {(0, 1)} and got[3] == {(0, 3)}
    assert got[4] == got[5] == got[-5] == {(1, -5)} and got[6] == {(1, 6)} and got[None] == {(1, None)}
    assert got[7] == {(1, 7)} and got[8] == {(1, 8)} and got[11] == got[12] == {(1, 11)}
    assert got[9] == got[10] == {(2, 9)}


def test_bucket_counts_bound_large_sets(spark, monkeypatch):
    """Two sets of 40,000 shingles in one bucket, all but a few shared, still pass the bound; unlike sizes do not."""
    monkeypatch.setattr(J, "BUCKETS", 1)
    n, rule = 40_000, J.Rule(3, 9, 10)
    words = np.arange(n) * 7919
    rows = [words, np.append(words[:-1], 5), words[: n // 2]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 3]), pa.array([w.tolist() for w in rows], pa.list_(pa.int64()))], names=["doc_id", "h", "words"])
    first = next(J.sketch_rows(rule, iter([batch]))).to_pylist()
    assert [r["buckets"] for r in first] == [[n - 2], [n - 2], [n // 2 - 2]]
    sizes = spark.createDataFrame([(r["doc_id"], r["m"], r["buckets"]) for r in first], "sid long, m long, buckets array<int>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [(r.a, r.b, r.bound) for r in J.may_link(pairs, sizes, rule).collect()] == [(1, 2, 0.5)]


def test_keep_one_and_empty(docs):
    rows = near_copies(3, groups=3, copies=5) + [(None, "null id stays"), (None, "null id stays"), (999, None)]
    df = docs(rows, "_gone gone rep")
    kept = J.keep_one(df, J.Rule(5, 4, 5))
    assert kept.columns == df.columns
    want = sorted((i for i, _, c in brute(rows, J.Rule(5, 4, 5)) if i is None or i == c), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want
    assert J.classes(docs([])).collect() == [] and J.keep_one(docs([]), J.Rule()).collect() == []


def test_parity_sketch_never_exceeds_the_difference(spark):
    """Sketches differ in at most as many cells as the sets do in shingles; equal sets not at all."""
    rng = np.random.default_rng(5)
    rows = []
    for n, edits in [(3, 1), (200, 15), (200, 60), (5000, 300), (40_000, 900)]:
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        b = np.unique(np.concatenate([a[edits:], rng.integers(-(2**62), 2**62, edits)]))
        rows.append((J.parity(a).tolist(), J.parity(b).tolist(), len(np.setxor1d(a, b))))
        rows.append((J.parity(a).tolist(), J.parity(a[::-1]).tolist(), 0))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, d long")
    got = [(r.n, r.d) for r in df.select(J.cells_apart("x", "y").alias("n"), "d").collect()]
    assert all(n <= d and (n - d) % 2 == 0 for n, d in got)
    assert got[4][0] > 40  # 120 differing shingles of 400 show in the sketch


def test_units_hold_each_pair_once(docs, spark, monkeypatch):
    """A pivot that a third of all sets turn to is cut into units of bounded size."""
    monkeypatch.setattr(J, "BLOCK_SETS", 8)
    pairs = [(k, 1000 if k % 3 == 0 else 1001 + k % 40) for k in range(600)]
    units = J.pivot_units(spark.createDataFrame(pairs, "x long, y long")).collect()
    assert sorted((r.a, r.b) for r in units) == sorted(pairs)
    sizes = {}
    for r in units:
        sizes[r.unit] = sizes.get(r.unit, 0) + 1
    assert max(sizes.values()) < 30


def test_sets_of_forty_thousand_shingles(docs):
    """Very long texts go through the whole join: two near copies link, a third set is too far away."""
    words = [f"w{k}" for k in range(40_002)]
    edited = list(words)
    for k in range(0, 40_000, 100):
        edited[k] = "x"
    far = list(words)
    for k in range(0, 40_000, 20):
        far[k] = "x"
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(far))]
    assert answer(docs(rows), J.Rule(3, 9, 10)) == brute(rows, J.Rule(3, 9, 10))


def tokens(rng, n):
    return np.unique(rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64))


@pytest.mark.parametrize("rule", [J.Rule(3, 9, 10), J.Rule(5, 4, 5), J.Rule(2, 1, 2)])
def test_sets_that_link_share_a_signature(rule):
    """Sets as far apart as the rule allows, of all small sizes and some large ones, in both directions."""
    rng = np.random.default_rng(11)
    for m in [*range(2, 130), 500, 3000]:
        for _ in range(12):
            a = tokens(rng, m)
            gone = rng.integers(0, m // 2 + 1)
            added = 0
            while gone and rule.den * (m - gone) < rule.num * m:
                gone -= 1
            while rule.den * (m - gone) >= rule.num * (m + added + 1):
                added += 1
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], tokens(rng, added)]))
            shared = len(np.intersect1d(a, b))
            assert rule.den * shared >= rule.num * (len(a) + len(b) - shared)
            if gone or added:
                assert set(J.signatures(a, rule).tolist()) & set(J.signatures(b, rule).tolist())


def test_sets_with_many_empty_parts_share_a_signature():
    """All shingles lie in a narrow range, so nearly all parts are empty."""
    rule, rng = J.Rule(3, 9, 10), np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**40, 300))
    b = np.unique(np.concatenate([a[15:], rng.integers(0, 2**40, 10)]))
    assert set(J.signatures(a, rule).tolist()) & set(J.signatures(b, rule).tolist())


def test_common_passages_alone_give_few_candidates(docs):
    """Texts that share a third of their words hardly meet (a part may hold shared shingles alone); copies of one set are named once."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(40)]
    rows = [(k, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(80)])) for k in range(300)] + [(1000 + k, "one text of some words that is copied") for k in range(50)]
    rule = J.Rule(3, 9, 10)
    words = docs(rows).coalesce(1).select("doc_id", J.F.xxhash64("text").alias("h"), J.word_hashes().alias("words"))
    first = words.mapInArrow(lambda b: J.sketch_rows(rule, b), "doc_id long, h long, sid long, m long, buckets array<int>, parity array<long>, signatures array<long>")
    assert J.shared_signatures(first).count() < 60
    assert first.where("doc_id >= 1000 and size(signatures) > 0").count() <= 1
    assert answer(docs(rows), rule) == brute(rows, rule)


def test_largest_component_of_a_block_is_not_paired_with_itself(spark):
    """Of 60 linked sets and two others in a block only the others ask."""
    rows = [(1, k, 100, 0 if k < 60 else k, [0] * 8) for k in range(62)]
    now = spark.createDataFrame(rows, "token long, sid long, m long, comp long, parity array<long>")
    got = sorted(map(tuple, J._all_pairs(now, J.Rule()).collect()))
    assert got == sorted([(k, x) for x in (60, 61) for k in range(60)] + [(60, 61)])


def test_sketches_are_made_of_few_rows_at_a_time(monkeypatch):
    """A batch is worked off in slices with the same rows as at once; equal sets of different slices are named once."""
    rng = np.random.default_rng(8)
    lists = [rng.integers(0, 2**40, n).tolist() for n in (0, 1, 2, 30, 400, 30, 7)] + [None]
    lists[5] = lists[3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(range(8)), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "h", "words"])
    whole = [r for b in J.sketch_rows(J.Rule(), iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(J, "SLICE", 3)
    parts = list(J.sketch_rows(J.Rule(), iter([batch])))
    assert [b.num_rows for b in parts] == [3, 3, 2] and [r for b in parts for r in b.to_pylist()] == whole
    assert whole[3]["signatures"] and whole[5]["sid"] == whole[3]["sid"] and not whole[5]["signatures"]


def test_only_signatures_that_two_sets_share_are_kept(spark):
    """Whatever pass a signature falls into, of either sign; equal sets share none."""
    rows = [(1, [-7, -6, -5, -4, 0, 1, 2, 3, 99]), (2, [-7, -5, 0, 3, 98]), (2, [-7, 50]), (3, [-6, -4, 1, 2]), (3, [50]), (4, [97, 97])]
    first = spark.createDataFrame(rows, "sid long, signatures array<long>")
    want = {(t, s) for s, ts in rows for t in ts if len({x for x, us in rows if t in us}) > 1}
    assert sorted(map(tuple, J.shared_signatures(first).collect())) == sorted(want)


def test_signatures_do_not_stay_on_disk(docs, spark):
    """They are larger than the texts' shuffles; once the shared ones are known the written table goes."""
    folder = f"{scratch_root(spark)}/panelloom/{spark.sparkContext.applicationId}"
    rows, before = near_copies(5, groups=2, copies=4), set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert answer(docs(rows), J.Rule(5, 4, 5)) == brute(rows, J.Rule(5, 4, 5))
    new = [x for x in os.listdir(folder) if x not in before]
    assert any(x.startswith("join-sizes") for x in new)
    assert not [x for x in new if "signatures" in spark.read.parquet(f"{folder}/{x}").columns]
