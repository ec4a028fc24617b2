import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from panelloom.llm import packing as P
from panelloom.llm.queries import tokenizer_path

PATH = tokenizer_path()
TEXTS = [
    None, "", " ", "a", "The end.", "it's  a\n\n test\t x", "<|endoftext|>", "x<|endoftext|> y", "漢字 and 😀", "é́ ñ ß Œ “q” … €5 ²", "\x1c\x85\xa0  z",
    "word " * 5000, "'s're!'t 12ab34 ½", "a" * 3000,
]


def test_ids_are_those_of_the_library():
    library, encode = Tokenizer.from_file(PATH), P.encoder(PATH)
    for t in TEXTS[1:]:
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_pieces_cover_each_document_once(docs):
    library = Tokenizer.from_file(PATH)
    rows = P.pack(docs([(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id")], "ids length"), PATH).collect()
    by, seen = defaultdict(list), set()
    for r in rows:
        by[r.doc_id].append(r)
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 and r.length == 1 << r.bucket
        assert r.sequence_id not in seen and r.sequence_id >> 57 == r.bucket
        seen.add(r.sequence_id)
    for k, t in [*enumerate(TEXTS), (None, "null id")]:
        parts = sorted(by[k], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist()
        assert ids == (library.encode(t or "", add_special_tokens=False).ids) + [P.END_ID]
        assert [r.start for r in parts] == [sum(q.length for q in parts[:n]) for n in range(len(parts))]
        assert {r.doc_tokens for r in parts} == {len(ids)}


def test_digest_and_empty_table(docs):
    df = docs([(1, "some words here"), (1, "some words here")])
    full, short = P.pack(df, PATH).collect(), P.pack(df, PATH, digest=True).collect()
    assert sorted(zlib.crc32(r.ids) for r in full) == sorted(r.ids_crc32 for r in short)
    assert len({r.sequence_id for r in short}) == len(short)
    assert P.pack(docs([]), PATH).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 10_000])
def test_binary_lengths(n):
    parts = P.binary_lengths(n)
    assert sum(parts) == n and sorted(parts, reverse=True) == parts


def test_length_must_be_a_power_of_two(docs):
    with pytest.raises(ValueError):
        P.pack(docs([]), PATH, max_length=1000)
