import random
import re

from panelloom.llm import licenses as L

S = L.Scanner()
WORDS = [b"cc", b"by", b"nc", b"general", b"public", b"license", b"all", b"rights", b"reserved", b"the", b"x", b"gnu", b"under", b"licensed", b"4", b"0"]


def places(words):
    out = [(i, label) for label, phrase in S.base for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
    return sorted(i for i, _ in out), {x for _, x in out}


def test_matching_statistics_and_places_agree_with_brute_force():
    rng = random.Random(5)
    runs = {}
    for t, (_, w) in enumerate(S.all):
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                runs.setdefault(tuple(w[i:j]), set()).add((t, j))
    for _ in range(300):
        words = [rng.choice(WORDS) for _ in range(40)]
        got = {i: (s, n) for i, s, n in S.auto.statistics(words)}
        for i in range(40):
            longest = max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in runs), default=0)
            state, n = got.get(i, (0, 0))
            assert n == longest and (not n or set(S.auto.ends[state]) == runs[tuple(words[i + 1 - n : i + 1])])
        starts, labels, _, score = S.scan(words)
        assert (sorted(starts), labels) == places(words) and 0 <= score <= 1


def test_templates_with_small_changes_are_found():
    text = dict((b, a) for a, b in L.TEMPLATES)
    for template, label in text.items():
        words = (b"before it all " + template.encode() + b" and after").split()
        assert label in {s.label for s in S.scan(words)[2]}, template
    mit = [t for t in text if t.startswith("permission is hereby granted free")][0].split()
    changed = mit[:10] + ["newword"] + mit[11:]
    spans = S.scan([w.encode() for w in changed])[2]
    assert [s.label for s in spans] == ["mit"] and spans[0].cover > 0.9 and (spans[0].start, spans[0].end) == (0, len(changed))
    assert S.scan([w.encode() for w in mit[:8]])[2] == []


def test_digest_on_odd_texts(docs):
    rows = [(1, None), (2, ""), (3, "All rights\nreserved. CC-BY, all RIGHTS reserved"), (None, "GNU General Public License"), (5, "x " * 50_000), (6, "É CC BY"), (6, "É CC BY"), (7, "This is released under the MIT license. All rights reserved")]
    got = L.scan(docs(rows, "labels spans")).collect()
    for (i, t), r in zip(rows, got):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
        starts, labels = places(words)
        assert (r.doc_id, r.n_words, r.n_base) == (i, len(words), len(starts))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))
    # Base phrases are labels of their own; only a notice gives a score.
    assert got[0].score == got[2].score == 0 and got[7].score == 1 and got[7].labels == "mit,reserved" and L.scan(docs([])).collect() == []
