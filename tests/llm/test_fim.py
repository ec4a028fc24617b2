import hashlib
import random

import pytest

from panelloom.llm import fim as M


def expected(d, t):
    """The definition, over Python code points."""
    t = t or ""
    hexed = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    if not n or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", p, m - p, f"<S>{t[m:]}<P>{t[:p]}<M>{t[p:m]}"
    return n, "psm", p, m - p, f"<P>{t[:p]}<S>{t[m:]}<M>{t[p:m]}"


def long_text(seed, size):
    rng = random.Random(seed)
    return "".join(rng.choice(["word ", "é", "😀", "漢字", "\n", "<", "S>", "a" * 50, "<<", "mid>dle "]) for _ in range(size))


def test_every_case_agrees_with_the_definition(docs):
    texts = [None, "", "a", "é", "😀", "<P>", "x<S>y", "<M", "<<S", "<P <S <M", "a" * 200_000, "\x00b", " " * 300]
    texts += [long_text(s, 400) for s in range(8)] + ["z" * 63, "z" * 64, "z" * 65, "long " * 30_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "null id"), (3, "é"), (3, "é"), (-7, "negative"), (2**62, "large")]
    rows += [(100 + k, "the same words for many ids " * 5) for k in range(60)]
    out = M.fill_in_middle(docs(rows, "n form output h1")).withColumn("back", M.restored()).collect()
    assert sorted(map(str, [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out])) == sorted(map(str, [(d, *expected(d, t)) for d, t in rows]))
    by = {(r.doc_id, r.output): r.back for r in out}
    for d, t in rows:
        assert by[d, expected(d, t)[4]] == (t or "")
    assert {r.form for r in out} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("border", range(60, 70))
def test_sentinels_across_chunk_borders(border):
    for s in ("<P>", "<S>", "<M>"):
        t = ("q" * border + s + "r" * 200).encode()
        cut = M.Document(t, M.Summaries())
        assert cut.sentinel and cut.points == len(t)


def test_sentinel_across_a_forced_border(monkeypatch):
    for at in range(M.LARGEST - 4, M.LARGEST + 2):
        assert M.Document(b"a" * at + b"<M>" + b"a" * 500, M.Summaries()).sentinel
    assert not M.Document(b"a" * (M.LARGEST - 1) + b"<" + b"M" + b"a" * 500, M.Summaries()).sentinel


def test_shared_passages_share_chunks():
    shared = long_text(5, 3000).encode()
    a, b = (x + shared for x in (b"one beginning. ", b"another, which is longer than the first one. "))
    parts = lambda t: {t[i:j] for i, j in zip([0, *M.chunk_ends(t)], M.chunk_ends(t))}
    assert len(parts(a) & parts(b)) >= 0.7 * len(parts(a)) > 5
    assert b"".join(a[i:j] for i, j in zip([0, *M.chunk_ends(a)], M.chunk_ends(a))) == a


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(M, "CACHED_BYTES", 500)
    t, cache = long_text(9, 2000), M.Summaries()
    for d in range(20):
        assert M.transform(d, t.encode(), cache)[:4] == expected(d, t)[:4]
        assert M.transform(d, t.encode(), cache)[4].decode() == expected(d, t)[4]


def test_empty_table(docs):
    assert M.digests(M.fill_in_middle(docs([]))).collect() == []
