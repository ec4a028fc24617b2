import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelloom.llm import crosstok as M
from panelloom.llm.queries import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", "The end.", "it's  a\n\n test\t x", "<|endoftext|>", "x<|endoftext|> y<s></s><unk> <0x41>", "漢字 and 😀 😀", "é́ ñ ß Œ “q” … €5 ²",
    "\x1c\x85\xa0  z", "▁word ▁", "   leading and trailing   ", "word " * 3000, "a" * 3000, "𝔘𝔫𝔦 ﬁ ½", "\x00b\r\n", "ab　cd  　 x", "naïve coöperation übergroß",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {v: k for k, v in M.BYTE_LETTER.items()}
    a_bytes = {i: bytes(back[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, b, a_bytes, b_bytes


def tokens(text, libraries):
    a, b, a_bytes, b_bytes = libraries
    if not text:
        return [], [], [], []
    x, y, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    left, right = [a_bytes[i] for i in x], [b_bytes[i] for i in y]
    return (x, y, left, right) if b"".join(left) == raw == b"".join(right) else ([], [], [], [])


def brute(rows, libraries):
    """The definition: every pair of token occurrences, one by one."""
    found, table = [], Counter()
    for d, text in rows:
        x, y, left, right = tokens(text, libraries)
        a_end, b_end = np.cumsum([len(t) for t in left]).tolist(), np.cumsum([len(t) for t in right]).tolist()
        links, j = [], 0
        for i in range(len(x)):
            a0 = a_end[i] - len(left[i])
            while j and b_end[j - 1] > a0:
                j -= 1
            while j < len(y) and b_end[j] - len(right[j]) < a_end[i]:
                if b_end[j] > a0:
                    links.append((x[i], y[j]))
                j += 1
        groups, i, j = [], 0, 0
        for e in sorted(set(a_end) & set(b_end)):
            p, q = a_end.index(e) + 1, b_end.index(e) + 1
            groups.append(f"{','.join(map(str, x[i:p]))}|{','.join(map(str, y[j:q]))}")
            i, j = p, q
        table.update(links)
        found.append((d, len(x), len(y), groups, links))
    highest = defaultdict(int)
    for (_, b), n in table.items():
        highest[b] = max(highest[b], n)
    return [
        (d, n_a, n_b, len(g), len(links), sum(table[p] == highest[p[1]] for p in links), sum(table[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "")
        for d, n_a, n_b, g, links in found
    ]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("looked_up", [1 << 16, 7, 0])
def test_agrees_with_every_pair_of_tokens(docs, libraries, looked_up, monkeypatch):
    monkeypatch.setattr(M, "LOOKED_UP", looked_up)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (4, "a"), (4, "a")]
    out = M.cross_align(docs(rows, "pairs counts row n_a"), A, B).collect()
    assert sorted(map(str, [tuple(r[c] for c in COLUMNS) for r in out])) == sorted(map(str, brute(rows, libraries)))


def test_given_documents(spark, libraries):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    out = M.cross_align(some, A, B).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in out) == sorted(brute(rows, libraries))


def test_ids_are_those_of_the_libraries(libraries):
    left, right = M.byte_side(A), M.piece_side(B)
    for t in filter(None, TEXTS):
        x, y, *_ = tokens(t, libraries)
        if x:
            assert np.frombuffer(left.encode(" " + t), "<u4").tolist() == x, t
            assert np.frombuffer(right.encode(" " + t), "<u4").tolist() == y, t
        else:
            assert None in (left.encode(" " + t), right.encode(" " + t)), t


def test_windows_begin_at_verified_space_marked_tokens_and_are_aligned_once():
    left, right = M.byte_side(A), M.piece_side(B)
    cache = M.Windows(left, right)
    n_a, n_b, found = M.windows_of("same words, same words, same words,", left, right, cache)
    assert len(found) == 6 and len(cache) == 2 and len({id(w) for w in found}) == 2
    assert sum(w[1] for w in found) >= 6 and n_a >= 6 and n_b >= 6


def test_only_new_words_are_tokenized():
    seen = []

    def counted(side):
        return side._replace(encode=lambda t: seen.append(t) or side.encode(t))

    left, right = counted(M.byte_side(A)), counted(M.piece_side(B))
    cache = M.Windows(left, right)
    first = M.align_text("some words and some more words", left, right, cache)
    assert seen == [" some words and more"] * 2
    again = M.align_text("more words and some some words", left, right, cache)
    assert len(seen) == 2 and again[:4] == first[:4]
    M.align_text("more new words", left, right, cache)
    assert seen[2:] == [" new"] * 2


def test_windows_change_nothing():
    """A text in windows gives what it gives as a whole, also next to texts whose windows are known."""
    rng = random.Random(2)
    parts = [*"ab.,'1é漢😀▁\u0301ﬁ½ \t\n\r\xa0\u3000\x1c\x85\u200b\u180e", " ", " ", " ", " the", "'s", "  ", " \xa0 \xa0", "<s>"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    left, right = M.byte_side(A), M.piece_side(B)
    assert left.parts and right.parts
    whole, cache = left._replace(parts=False), M.Windows(left, right)
    for t in texts:
        got, want = M.align_text(t, left, right, cache), M.align_text(t, whole, right, M.Windows(whole, right))
        assert got[:5] == want[:5] and np.array_equal(got.pairs, want.pairs) and np.array_equal(got.counts, want.counts), t
    assert len(cache) > 1000


def test_tokens_across_anchors_keep_texts_whole():
    known = [b"a", b" ", b" \xc2\xa0 \xc2\xa0", b"  ", b"\n "]
    assert M._side(None, known, "|").parts
    for token in (b"a b", b"\xa9 ", b". "):
        assert not M._side(None, [*known, token], "|").parts


def test_both_libraries_give_the_same_ids():
    """Texts within PLAIN take the faster one: the same words, as far as letters and marks can be mixed."""
    rng = random.Random(1)
    letters = [chr(c) for c in (*range(32, 127), *range(0xA1, 0x250))]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    words += ["".join(rng.choice("etaoinshrdlu ETAOIN\n'") for _ in range(rng.randint(4, 30))) for _ in range(20_000)]
    slow, fast = Tokenizer.from_file(A), M.byte_side(A)
    for w, e in zip(words, slow.encode_batch(words, add_special_tokens=False)):
        assert np.frombuffer(fast.encode(w), "<u4").tolist() == e.ids, w


def test_full_caches_change_nothing(monkeypatch):
    text = "some words that differ and some that do not " * 3
    left, right = M.byte_side(A), M.piece_side(B)
    want = M.align_text(text, left, right, M.Windows(left, right))
    monkeypatch.setattr(M, "CACHED_WINDOWS", 2)
    monkeypatch.setattr(M, "LONGEST_CACHED", 3)
    got = M.align_text(text, left, right, M.Windows(left, right))
    assert got[:5] == want[:5] and np.array_equal(got.pairs, want.pairs) and np.array_equal(got.counts, want.counts)


def test_empty_table(docs):
    assert M.cross_align(docs([]), A, B).collect() == []
