import hashlib
import re

import pytest
from pyspark.sql import functions as F

from panelloom.llm import spotsigs as S


def spots(text):
    """Signatures as word tuples, word by word."""
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    out, last = set(), -1
    for i, x in enumerate(w):
        if x in S.ANCHORS:
            last = i
        if x in S.ANCHORS or i - last >= S.FAR_FROM_ANCHOR or i < S.HEAD_WORDS:
            out.add((x, *[y for y in w[i + 1 :] if y not in S.ANCHORS][: S.CHAIN]))
    return out or ({(text,)} if text else set())


def jaccard(a, b):
    if min(len(a), len(b)) < S.PRUNE_BELOW * max(len(a), len(b)):
        return 0.0  # pruned by the lengths
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(df, rows):
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in S.fingerprints(df).collect()}
    ordered = sorted(set((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        r = got[i, len(t), hashlib.sha256(edited.encode()).hexdigest()]
        assert len(r.fingerprint.split()) == len(spots(t)) and len(r.edited_fingerprint.split()) == len(spots(edited))
        assert r.near_edited == pytest.approx(jaccard(spots(t), spots(edited)))
        assert r.near_next == pytest.approx(jaccard(spots(t), spots(nxt)))
    return got


ROWS = [(5, "The old house on the hill was red and the door of it is green today."), (1, None), (2, ""), (9, "short"), (3, "%%% ---"), (7, "é😀 und der Hund " * 50),
        (8, "no common words anywhere inside such text whatever happens next tomorrow evening again forever " * 4), (None, "null id is first in the order"), (-4, "a" * 5000)]


def test_edits_and_likeness_agree_with_brute_force(docs):
    check(docs(ROWS, "h key n prev"), ROWS)


def test_given_documents(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    got = check(small_docs, rows)
    longer = [r.near_edited for r in got.values() if r.n_chars > 400]
    assert sum(longer) / len(longer) > 0.5


def test_repeated_rows_one_row_and_empty(docs):
    got = S.fingerprints(docs([(1, "same words here"), (1, "same words here"), (2, "b")])).collect()
    assert len(got) == 3 and len({(r.doc_id, r.fingerprint, r.edited_sha256) for r in got}) == 2
    (one,) = S.fingerprints(docs([(1, "only one text here")])).collect()
    assert one.near_next == 1.0
    assert S.fingerprints(docs([])).collect() == []


def test_pruned_likeness_agrees_where_it_is_not_pruned(spark):
    rows = [(list(range(n)), list(range(k, k + m))) for n in (0, 1, 5, 40) for m in (0, 1, 6, 40) for k in (0, 2, 7)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    for r in df.select(S.likeness(a, b).alias("x"), S.likeness(a, b, 0.7).alias("y")).collect():
        assert r.y == (r.x if r.x >= 0.7 else r.y) and (r.y in (0.0, r.x))
