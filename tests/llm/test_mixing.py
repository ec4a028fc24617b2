import heapq
import math
from collections import Counter, defaultdict

import pytest

from panelloom.llm import mixing as M


def brute_order(blocks, weight):
    """Earliest deadline first with a heap; ties by source."""
    fluid = lambda v: sum(min(blocks[s], weight[s] * v) for s in blocks)
    by_release, heap, out = defaultdict(list), [], []
    for s in sorted(blocks):
        for i in range(1, blocks[s] + 1):
            by_release[math.floor(fluid((i - 1) / weight[s]) + 1e-6)].append((math.ceil(fluid(i / weight[s]) - 1e-6), s))
    for t in range(sum(blocks.values())):
        for x in by_release[t]:
            heapq.heappush(heap, x)
        deadline, s = heapq.heappop(heap)
        assert deadline > t
        out.append(s)
    return out


def rows(sizes):
    out, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            out.append((k, f"t{k}", s))
            k += 1
    return out


@pytest.mark.parametrize("sizes,weights,max_blocks", [
    ({"a": 30, "b": 7, "c": 3}, {"a": 0.2, "b": 0.5, "c": 0.3}, 8192),
    ({"a": 200, "b": 50, "c": 21, "d": 1}, {"a": 1.0, "b": 1.0, "c": 1.0, "d": 5.0}, 40),
    ({"a": 100}, {"a": 3.0}, 7),
    ({f"s{k:02}": 3 + k for k in range(30)}, {f"s{k:02}": 1.0 + k % 4 for k in range(30)}, 8192),
])
def test_schedule_is_earliest_deadline_first(spark, docs, sizes, weights, max_blocks):
    df = docs(rows(sizes), "key block slot _key")
    w = spark.createDataFrame(list(weights.items()), "source string, weight double")
    got = sorted(M.mix(df, w, max_blocks=max_blocks).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(got)))
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows(sizes))
    per = max(1, -(-sum(sizes.values()) // max_blocks))
    blocks, total = {s: -(-n // per) for s, n in sizes.items()}, sum(weights.values())
    slots = defaultdict(set)
    for r in got:
        slots[r.slot].add(r.source)
    order = brute_order(blocks, {s: weights[s] / total for s in sizes})
    assert [slots[t] for t in range(len(order))] == [{s} for s in order]


def test_every_prefix_is_less_than_a_block_off(docs):
    sizes = {"hot": 300, "b": 60, "c": 40}
    got = sorted(M.mix(docs(rows(sizes))).collect(), key=lambda r: r.position)
    w = {s: n**M.TEMPER for s, n in sizes.items()}
    fluid = lambda v: sum(min(sizes[s], w[s] * v) for s in sizes)
    done, lo = Counter(), 0.0
    for t, r in enumerate(got, 1):
        done[r.source] += 1
        a, b = lo, max(sizes[s] / w[s] for s in sizes)
        for _ in range(60):
            m = (a + b) / 2
            a, b = (m, b) if fluid(m) < t else (a, m)
        lo = a
        assert all(abs(done[s] - min(sizes[s], w[s] * b)) < 1 + 1e-6 for s in sizes)


def test_nulls_repeats_and_empty(spark, docs):
    df = docs([(1, "x", None), (1, "x", None), (None, None, "a"), (None, None, "a"), (2, "", "n:")], "rows start")
    got = M.mix(df).collect()
    assert sorted(r.position for r in got) == [0, 1, 2, 3, 4] and Counter(r.source for r in got) == {None: 2, "a": 2, "n:": 1}
    assert M.mixed(df).columns == df.columns and M.mixed(df).count() == 5
    assert M.mix(docs([])).collect() == []


def test_a_source_without_weight_is_an_error(spark, docs):
    w = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    with pytest.raises(Exception, match="no positive weight for source s:b"):
        M.mix(docs([(1, "x", "a"), (2, "y", "b")]), w).collect()


def test_mixed_rows_are_stored_in_order(spark, docs):
    from panelloom.operators.store import new_path

    df = docs(rows({"a": 500, "b": 100}))
    want = [r.doc_id for r in sorted(M.mix(df).collect(), key=lambda r: r.position)]
    path = new_path(spark, "mixed-test")
    M.mixed(df).write.parquet(path)
    files = sorted({r.f for r in spark.read.parquet(path).selectExpr("input_file_name() f").collect()})
    assert [r.doc_id for f in files for r in spark.read.parquet(f).collect()] == want
