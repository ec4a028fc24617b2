"""Language identification with segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, found by a forward recursion; a text's is the
product over its words. Words are runs of letters, lower-cased, with the vocabulary's word mark
in front; a letter the vocabulary lacks is the unknown piece. Piece probabilities are learned by
expectation maximisation on the words of labelled training documents: the expected piece counts
of all segmentations, from a forward and a backward recursion.

The fit reads whole texts of training documents (label not null, not held out). If there are more
than ``max_fit_docs`` of them it takes a hash sample of about that many (a documented bound);
words are counted by Spark, and each round sends one row per language and piece to the driver:
vocabulary size times languages. A prediction reads the text only. Words repeat, so
a task scores distinct words once per batch, position by position over all words of one length.

A null text, or one without a letter, is ``und`` with score 0, also when no language was learned.
Equal posteriors take the language that sorts first. Repeated rows get equal answers; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators.store import written

from .common import held_out

MARK = "▁"
UNKNOWN = 0
ROUNDS = 3
SMOOTHING = 0.1
MAX_FIT_DOCS = 20_000
LONG_WORD = 24  # beyond it, products of piece probabilities could underflow; longer words take a scaled way
CACHED_WORDS = 400_000
LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of letters from a public vocabulary file, found by a hash of their code points."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        letters = lambda p: p and all(c == MARK or LETTERS.fullmatch(c) for c in p)
        pieces = sorted({p for p in map(model.id_to_piece, range(model.get_piece_size())) if letters(p)})
        self.pieces = ["<unknown>", *pieces]
        self.ids = {p: k for k, p in enumerate(self.pieces) if k}
        self.longest = max(map(len, pieces))
        # Nodes of the prefix tree, by the hash of their code points; node 0 is "none".
        prefixes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        self.piece_of_node = np.array([-1, *(self.ids.get(x, -1) for x in prefixes)], np.int32)
        self._hashes = np.zeros(len(prefixes) + 1, np.uint64)
        for k, x in enumerate(prefixes, 1):
            h = np.zeros(1, np.uint64)
            for c in x:
                h = _step(h, np.array([ord(c)], np.uint64))
            self._hashes[k] = h[0]
        if len(set(self._hashes[1:].tolist())) != len(prefixes):
            raise ValueError("two prefixes share a hash")
        # Open addressing with linear probing, filled to a quarter.
        self._bits = np.uint64(64 - (4 * len(prefixes)).bit_length())
        self._slots = np.zeros(1 << (64 - int(self._bits)), np.int32)
        for k in range(1, len(prefixes) + 1):
            at = int(self._hashes[k] >> self._bits)
            while self._slots[at]:
                at = (at + 1) % len(self._slots)
            self._slots[at] = k

    def find(self, h: np.ndarray) -> np.ndarray:
        """Nodes of substring hashes, 0 where no piece starts with the substring."""
        at = (h >> self._bits).astype(np.int64)
        out = self._slots[at]
        open_ = np.nonzero((out > 0) & (self._hashes[out] != h))[0]
        out[open_] = 0
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self._slots)
            ids = self._slots[at[open_]]
            hit = (ids > 0) & (self._hashes[ids] == h[open_])
            out[open_[hit]] = ids[hit]
            open_ = open_[(ids > 0) & ~hit]
        return out


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code) * _BASE
    return h ^ (h >> np.uint64(29))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def lattice(words: list[str], v: Vocabulary) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """For words of one length: (start, end, rows, piece ids) of the words in which that span is a piece.

    A single character that is no piece is the unknown piece, so every word has a segmentation.
    Words leave a start position as soon as no piece begins with what has been read.
    """
    length, n = len(words[0]), len(words)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.uint64)
    spans = []
    for i in range(length):
        rows, h = np.arange(n), np.zeros(n, np.uint64)
        for j in range(i + 1, min(length, i + v.longest) + 1):
            h = _step(h, codes[rows, j - 1])
            node = v.find(h)
            piece = v.piece_of_node[node]
            if j == i + 1:
                spans.append((i, j, rows, np.maximum(piece, UNKNOWN)))
            elif (hit := piece >= 0).any():
                spans.append((i, j, rows[hit], piece[hit]))
            on = node > 0
            rows, h = rows[on], h[on]
            if not len(rows):
                break
    return spans


def forward(spans, length: int, n: int, p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix: (length + 1, n, languages)."""
    a = np.zeros((length + 1, n, p.shape[1]))
    a[0] = 1.0
    for i, j, rows, ids in spans:
        a[j][rows] += a[i][rows] * p[ids]
    return a


def word_log_probabilities(words: list[str], v: Vocabulary, p: np.ndarray) -> np.ndarray:
    """log P(word) by language, summed over all segmentations; the word mark is put in front here."""
    words = [MARK + w for w in words]
    out = np.empty((len(words), p.shape[1]))
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for length, ks in by_length.items():
        if length > LONG_WORD:
            for k in ks:
                out[k] = _long_word(words[k], v, p)
            continue
        for at in range(0, len(ks), 20_000):
            part = ks[at : at + 20_000]
            spans = lattice([words[k] for k in part], v)
            out[part] = np.log(forward(spans, length, len(part), p)[length])
    return out


def _long_word(word: str, v: Vocabulary, p: np.ndarray) -> np.ndarray:
    """The same recursion for one long word, rescaled at every position so that nothing underflows."""
    window = [np.ones(p.shape[1])]  # of the last positions, in units of exp(scale)
    scale = np.zeros(p.shape[1])
    for j in range(1, len(word) + 1):
        total = np.zeros(p.shape[1])
        for back in range(1, min(v.longest, len(window)) + 1):
            k = v.ids.get(word[j - back : j], UNKNOWN)
            if k or back == 1:
                total += window[-back] * p[k]
        window = [x / total for x in window[-v.longest :]] + [np.ones(p.shape[1])]
        scale += np.log(total)
    return scale


def _long_counts(word: str, v: Vocabulary, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of one long word and their expected counts in one language, by logarithms."""
    n = len(word)
    arcs = []  # by end: first position, piece, log probability
    for j in range(1, n + 1):
        found = [(i, v.ids.get(word[i:j], UNKNOWN)) for i in range(max(0, j - v.longest), j)]
        arcs.append([(i, k, np.log(p[k])) for i, k in found if k or i == j - 1])
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0] = b[n] = 0.0
    for j in range(1, n + 1):
        a[j] = np.logaddexp.reduce([a[i] + q for i, _, q in arcs[j - 1]])
    for j in range(n, 0, -1):
        for i, _, q in arcs[j - 1]:
            b[i] = np.logaddexp(b[i], b[j] + q)
    flat = [(k, a[i] + q + b[j + 1] - a[n]) for j, part in enumerate(arcs) for i, k, q in part]
    return np.array([k for k, _ in flat]), np.exp([x for _, x in flat])


def expected_counts(words: list[str], weight: np.ndarray, v: Vocabulary, p: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces, languages) over all segmentations; each word counts for its own language."""
    out, n_lang = np.zeros(p.shape), p.shape[1]
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for length, all_ks in by_length.items():
        if length > LONG_WORD:
            for k in all_ks:
                ids, share = _long_counts(words[k], v, p[:, language[k]])
                np.add.at(out[:, language[k]], ids, weight[k] * share)
            continue
        for at in range(0, len(all_ks), 20_000):
            ks = np.array(all_ks[at : at + 20_000])
            spans = lattice([words[k] for k in ks], v)
            own = language[ks]
            a, b = np.zeros((length + 1, len(ks))), np.zeros((length + 1, len(ks)))
            a[0], b[length] = 1.0, 1.0
            for i, j, rows, ids in spans:
                a[j][rows] += a[i][rows] * p[ids, own[rows]]
            for i, j, rows, ids in sorted(spans, key=lambda s: -s[1]):
                b[i][rows] += b[j][rows] * p[ids, own[rows]]
            for i, j, rows, ids in spans:
                share = weight[ks[rows]] * a[i][rows] * p[ids, own[rows]] * b[j][rows] / a[length][rows]
                out += np.bincount(ids * n_lang + own[rows], share, out.size).reshape(out.shape)
    return out


@dataclass(frozen=True)
class Languages:
    """Learned languages, log prior and piece probabilities (pieces, languages)."""

    names: tuple[str, ...]
    prior: np.ndarray
    p: np.ndarray


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L). The pattern also takes number signs such as ½ or Ⅷ, which then part words."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


def training_words(docs: DataFrame, max_fit_docs: int = MAX_FIT_DOCS) -> DataFrame:
    """(lang, word, n) over whole texts of training documents."""
    learn = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    share = min(1.0, max_fit_docs / max(1, learn.count()))
    sample = learn.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    return sample.select("lang", word.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, vocabulary_path: str, rounds: int = ROUNDS, max_fit_docs: int = MAX_FIT_DOCS) -> Languages:
    counts = written(training_words(docs, max_fit_docs), "langid-words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per language
    names = tuple(sorted(totals))
    v = vocabulary(vocabulary_path)
    if not names:
        return Languages((), np.zeros(0), np.zeros((len(v.pieces), 0)))
    index = {x: k for k, x in enumerate(names)}
    # Start: shorter pieces are likelier, alike in all languages.
    start = np.array([1e-6] + [2.0 ** -len(x) for x in v.pieces[1:]])
    p = np.repeat((start / start.sum())[:, None], len(names), axis=1)
    for _ in range(rounds):
        p_now = p

        def expect(batches: Iterator[pd.DataFrame], p_now=p_now) -> Iterator[pd.DataFrame]:
            voc, total = vocabulary(vocabulary_path), np.zeros(p_now.shape)
            for b in batches:
                total += expected_counts([MARK + w for w in b["word"]], b["n"].to_numpy(float), voc, p_now, b["lang"].map(index).to_numpy())
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        new = np.zeros_like(p)
        summed = counts.mapInPandas(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        for r in summed.toLocalIterator():
            new[r["piece"], r["lang"]] = r["n"]
        new += SMOOTHING
        p = new / new.sum(axis=0)
    words = np.array([totals[x] for x in names], float)
    return Languages(names, np.log(words / words.sum()), p)


def predict(docs: DataFrame, model: Languages, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the likeliest language of each whole text and its posterior."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(vocabulary_path)
        ids: dict[str, int] = {}
        table = np.zeros((0, len(model.names)))
        for batch in batches:
            if len(ids) > CACHED_WORDS:
                ids, table = {}, table[:0]
            docs_words = []
            for t in batch["text"]:
                ws = words_of(t) if isinstance(t, str) else []
                docs_words.append(np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws)))
            if model.names and len(ids) > len(table):
                table = np.vstack([table, word_log_probabilities(list(islice(ids, len(table), None)), v, model.p)])
            langs, scores = [], []
            for ws in docs_words:
                if not len(ws) or not model.names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = table[ws].sum(axis=0) + model.prior
                post = np.exp(total - total.max())
                k = int(np.argmax(total))
                langs.append(model.names[k])
                scores.append(float(1.0 / post.sum()))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": langs, "score": scores})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(label, "doc_id long, lang_pred string, score double")
