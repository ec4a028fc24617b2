"""License scans with a generalised suffix automaton.

The words of all license templates form one automaton. A file is streamed through it word by
word; each position gets its matching statistic, the longest run of words ending there that
occurs in some template. Maximal runs of at least ``MIN_MATCH`` words (or a whole shorter template) are
chained per template, forward in both texts and with gaps of at most ``MAX_GAP`` words; a
chain covers the template words of its runs. A template is found where a chain covers at least
``MIN_COVER`` of it; the score of a file is the best cover of any notice (base phrases left out).

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Base phrases are
found wherever their words stand consecutively; their labels always hold, those of templates
are added. Null and empty texts have no words, no labels and score 0; repeated rows get equal
answers; an empty table gives an empty result; extra columns are ignored. Memory per task is
one Arrow batch of texts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_MATCH = 3
MAX_GAP = 12
MIN_COVER = 0.8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Base phrases and the notices of common licenses, as (label, words).
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


class Place(NamedTuple):
    template: int
    end: int


class Automaton:
    """Generalised suffix automaton over word sequences; states know where their runs end."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set[Place]] = [set()]
        for t, words in enumerate(texts):
            last = 0
            for k, w in enumerate(words):
                last = self._extend(last, w, ends)
                ends[last].add(Place(t, k + 1))
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.ends = [tuple(sorted(e)) for e in ends]

    def _state(self, length: int, nxt: dict, link: int, ends: list) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: bytes, ends: list) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes, ends: list) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, w, ends)
        new, p = self._state(self.len[last] + 1, {}, 0, ends), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, w, ends)
        return new

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of the longest run ending at each word that occurs in a template."""
        nxt, link, lens = self.next, self.link, self.len
        state = length = 0
        known = nxt[0]
        for i, w in enumerate(words):
            if w not in known:
                if length:
                    state = length = 0
                continue
            while w not in nxt[state]:
                state = link[state]
                length = lens[state]
            state = nxt[state][w]
            length += 1
            yield i, state, length


class Span(NamedTuple):
    label: str
    start: int
    end: int
    cover: float


class Scanner:
    """Templates, their automaton and, by state, the base phrases that end there."""

    def __init__(self, base=BASE, templates=TEMPLATES):
        split = lambda rows: [(label, WORD.findall(text.encode().lower())) for label, text in rows]
        self.base = split(base)
        self.all = self.base + split(templates)
        self.auto = Automaton([w for _, w in self.all])
        self.need = [min(MIN_MATCH, len(w)) for _, w in self.all]
        # Base phrases have the first template numbers; a phrase ends where its last word does.
        self.phrases = [tuple(p.template for p in e if p.template < len(self.base) and p.end == len(self.all[p.template][1])) for e in self.auto.ends]

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], list[Span], float]:
        """Start words of base phrases, their labels, template spans that are covered enough, the best cover."""
        starts, labels, spans, best = [], set(), [], 0.0
        open_: dict[int, list[int]] = {}  # template: text start, text end, template end, covered words
        ends, phrases, lens, link = self.auto.ends, self.phrases, self.auto.len, self.auto.link

        def close(t: int) -> None:
            nonlocal best
            chain = open_.pop(t)
            cover = chain[3] / len(self.all[t][1])
            if t >= len(self.base):  # a base phrase is a sign of its own and says nothing about a notice
                best = max(best, cover)
            if cover >= MIN_COVER:
                spans.append(Span(self.all[t][0], chain[0], chain[1], cover))

        def run(i: int, state: int, length: int) -> None:
            """Chain a maximal run that ends at word i."""
            for t, end in ends[state]:
                if length < self.need[t]:
                    continue
                begin = end - length
                chain = open_.get(t)
                if chain and (end <= chain[2] or i + 1 - length - chain[1] > MAX_GAP):
                    close(t)
                    chain = None
                if chain:
                    chain[3] += end - max(begin, chain[2])
                    chain[1], chain[2] = i + 1, end
                else:
                    open_[t] = [i + 1 - length, i + 1, end, length]

        held = None
        for i, state, length in self.auto.statistics(words):
            if held and (i != held[0] + 1 or length != held[2] + 1):
                if held[2] > 1:
                    run(*held)
            held = (i, state, length)
            if length > 1:
                s = state
                while s > 0:
                    for t in phrases[s]:
                        n = len(self.base[t][1])
                        if lens[link[s]] < n <= min(length, lens[s]):
                            starts.append(i + 1 - n)
                            labels.add(self.base[t][0])
                    s = link[s]
        if held and held[2] > 1:
            run(*held)
        for t in list(open_):
            close(t)
        return starts, labels, spans, min(1.0, best)


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: digest of base phrases, labels, score and the template spans in words."""
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label string, start long, end long, cover double>>"
    )

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = scanner()
        for b in batches:
            rows = []
            for raw in b["text"]:
                words = WORD.findall(bytes(raw).lower()) if raw is not None else []
                starts, base, spans, score = find.scan(words)
                labels = base | {s.label for s in spans}
                rows.append((
                    len(words), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), score, [s._asdict() for s in spans],
                ))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            out = out.astype({"first_word": "Int64", "last_word": "Int64"})
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInPandas(of_batches, schema)
