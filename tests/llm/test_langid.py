import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import langid as L
from panelloom.llm.common import held_out
from panelloom.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def voc():
    return L.vocabulary(PATH)


def segmentations(word, voc):
    """All segmentations of a word into piece ids."""

    @functools.cache
    def of(i):
        if i == len(word):
            return [()]
        out = []
        for j in range(i + 1, len(word) + 1):
            k = voc.ids.get(word[i:j], L.UNKNOWN)
            if k or j == i + 1:
                out += [(k, *rest) for rest in of(j)]
        return out

    return of(0)


def test_forward_sums_all_segmentations(voc):
    p = np.random.default_rng(1).random((len(voc.pieces), 3))
    p /= p.sum(axis=0)
    words = ["the", "was", "über", "漢字x", "a", "nation"]
    got = L.word_log_probabilities(words, voc, p)
    for k, w in enumerate(words):
        total = sum(np.prod(p[list(s)], axis=0) for s in segmentations(L.MARK + w, voc))
        assert np.allclose(got[k], np.log(total))
        assert np.allclose(L._long_word(L.MARK + w, voc, p), got[k])
    assert np.isfinite(L.word_log_probabilities(["ab" * 3000], voc, p)).all()


def test_expected_counts_are_those_of_all_segmentations(voc):
    p = np.random.default_rng(2).random((len(voc.pieces), 2))
    p /= p.sum(axis=0)
    word = L.MARK + "thing"
    got = L.expected_counts([word], np.array([2.0]), voc, p, np.array([1]))
    segs = segmentations(word, voc)
    weight = np.array([math.prod(p[k, 1] for k in s) for s in segs])
    want = np.zeros_like(got)
    for s, w in zip(segs, weight / weight.sum()):
        for k in s:
            want[k, 1] += 2 * w
    assert np.allclose(got, want)


def test_held_out_accuracy_and_odd_texts(spark, docs):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(df, PATH)
    assert model.names == ("de", "en", "es", "fr")
    found = L.predict(df, model, PATH).join(df.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    odd = docs([(1, None), (2, ""), (3, "12 !? _"), (None, "the house and the hill"), (5, "the " * 40_000), (5, "the " * 40_000), (6, "x" * 20_000)], "lang_pred score")
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.predict(odd, model, PATH).collect()]
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert got[3][:2] == (None, "en") and got[4] == got[5] and got[4][1] == "en" and 0 <= got[6][2] <= 1
    assert L.predict(docs([]), model, PATH).collect() == []


def test_nothing_to_learn(docs):
    model = L.fit(docs([(1, "text", "a", None), (2, None, "a", "en")]), PATH)
    assert model.names == ()
    assert [(r.lang_pred, r.score) for r in L.predict(docs([(1, "text")]), model, PATH).collect()] == [("und", 0.0)]


def test_long_words_count_like_short_ones(voc):
    p = np.random.default_rng(3).random((len(voc.pieces), 2))
    p /= p.sum(axis=0)
    word = L.MARK + "nations"
    ids, share = L._long_counts(word, voc, p[:, 1])
    got = np.zeros(len(voc.pieces))
    np.add.at(got, ids, share)
    assert np.allclose(got, L.expected_counts([word], np.array([1.0]), voc, p, np.array([1]))[:, 1])
    tiny = np.full_like(p, 1e-12)  # every product of a longer word underflows
    out = L.expected_counts([L.MARK + "漢" * 500, word], np.array([1.0, 1.0]), voc, tiny, np.array([0, 1]))
    assert np.isfinite(out).all() and out[:, 0].sum() >= 500 and out[:, 1].sum() > 1


def test_texts_without_a_letter_are_und(docs):
    texts = ["½ ² ① Ⅷ", "1234 !?", "", None, "½cup", "the thing ½ and that", "x"]
    train = [(100 + k, "the thing and that with other words", "a", "en") for k in range(8)] + [(200 + k, "das ding und jenes mit anderen worten", "a", "de") for k in range(8)]
    df = docs(train + [(k, t, "a", None) for k, t in enumerate(texts)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(df, L.fit(df, PATH), PATH).collect()}
    assert [got[k][0] for k in range(4)] == ["und"] * 4 and all(got[k] == ("und", 0.0) for k in range(4))
    assert got[5][0] == "en" and got[4][0] in ("en", "de") and got[6][0] in ("en", "de")
    assert L.words_of("½cup Ⅷth x²y") == ["cup", "th", "x", "y"]


def test_equal_posteriors_take_the_first_name(voc):
    p = np.full((len(voc.pieces), 2), 1.0 / len(voc.pieces))
    model = L.Languages(("aa", "bb"), np.log(np.array([0.5, 0.5])), p)
    total = L.word_log_probabilities(["thing"], voc, p)[0] + model.prior
    assert total[0] == total[1] and model.names[int(np.argmax(total))] == "aa"


def test_prediction_is_the_posterior_of_all_segmentations(docs, voc):
    p = np.random.default_rng(4).random((len(voc.pieces), 3))
    p /= p.sum(axis=0)
    model = L.Languages(("a", "b", "c"), np.log(np.array([0.5, 0.3, 0.2])), p)
    texts = ["The was", "über", "a thing", "漢字x was"]
    got = {r.doc_id: r for r in L.predict(docs(list(enumerate(texts))), model, PATH).collect()}
    for k, t in enumerate(texts):
        joint = np.exp(model.prior)
        for w in L.words_of(t):
            joint = joint * sum(np.prod(p[list(s)], axis=0) for s in segmentations(L.MARK + w, voc))
        post = joint / joint.sum()
        assert got[k].lang_pred == model.names[int(post.argmax())] and got[k].score == pytest.approx(post.max())
