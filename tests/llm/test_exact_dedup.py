import hashlib
from collections import defaultdict

import pytest

from panelloom.llm import exact_dedup as D

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 50_000), (8, "X" * 50_000), (None, "abc"), (None, "null only"), (9, "one"), (9, "one"), (-3, "one")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    out = []
    for i, t in rows:
        n = (t or "").translate(UP)
        ids = [x for x in groups[n] if x is not None]
        top = max(ids, default=None)
        out.append((i, top, len(groups[n]), i == top, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("filter_bytes", [D.FILTER_BYTES, 0])
def test_marks_agree_with_brute_force(docs, filter_bytes):
    got = D.mark(docs(ROWS, "h block bits"), filter_bytes=filter_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_marks_on_given_documents(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert sorted(map(tuple, D.mark(small_docs).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("filter_bytes", [D.FILTER_BYTES, 0])
def test_deduplicate_keeps_one_row_with_all_columns(docs, filter_bytes):
    df = docs(ROWS, "_flag _sha keep_id h")
    got = D.deduplicate(df, filter_bytes=filter_bytes)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, (r.text or "").translate(UP)) for r in got.collect()), key=str)
    assert kept == sorted({(top, (t or "").translate(UP)) for (i, t), (_, top, *_) in ((r, next(b for b in brute(ROWS) if b[0] == r[0] and b[4] == hashlib.sha256((r[1] or "").translate(UP).encode()).hexdigest())) for r in ROWS)}, key=str)


def test_empty_table(docs):
    assert D.mark(docs([])).collect() == [] and D.deduplicate(docs([])).collect() == []


def test_only_candidates_are_shuffled(docs):
    flagged, flag = D.flag_candidates(docs([(k, f"text {k}") for k in range(2000)] + [(-1, "text 5")]))
    n = flagged.where(flag).count()
    assert 2 <= n < 200
    assert "Exchange hashpartitioning" not in flagged._jdf.queryExecution().executedPlan().toString()
