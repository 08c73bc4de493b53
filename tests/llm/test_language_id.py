import zlib

import numpy as np
import pytest

from statefold.llm import language_id as G

from .fixtures import clashing, documents, empty, rows

SF = "/root/testdata/sf0.01"


def slow_marginals(e, a):
    def lse(x, axis):
        top = x.max(axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    n, k = e.shape
    forward, backward = np.zeros((n, k)), np.zeros((n, k))
    forward[0] = e[0]
    for t in range(1, n):
        forward[t] = lse(forward[t - 1][:, None] + a, 0) + e[t]
    for t in range(n - 2, -1, -1):
        backward[t] = lse(a + (e[t + 1] + backward[t + 1])[None], 1)
    z = lse(forward[-1], 0)
    pairs = sum((np.exp(forward[t - 1][:, None] + a + (e[t] + backward[t])[None] - z) for t in range(1, n)), np.zeros((k, k)))
    return np.exp(forward + backward - z), pairs, float(z)


@pytest.mark.parametrize("scale", [0.1, 3.0, 20.0])
def test_blocked_forward_backward_is_exact(scale):
    rng = np.random.default_rng(0)
    lengths = np.array([1, 2, 63, 64, 65, 128, 130, 5, 300])
    e, a = scale * rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    p, pairs, z = G.marginals(e, a, lengths, pairs=True)
    parts = [slow_marginals(e[i - n : i], a) for n, i in zip(lengths, np.cumsum(lengths), strict=True)]
    assert np.allclose(p, np.concatenate([x[0] for x in parts]), atol=1e-9)
    assert np.allclose(pairs, sum(x[1] for x in parts), atol=1e-7)
    assert z == pytest.approx(sum(x[2] for x in parts))


def test_features_are_of_the_core():
    assert G.core("«Wörter,") == "wörter" and G.core("12") == "" and G.core("it's") == "it's"
    owner, feature = G.features(["ab", "", "abc"], frozenset({"ab"}))
    assert 1 not in owner and feature.min() >= 0 and feature.max() < 1 << 16
    assert (owner == 0).sum() == 3 + 2 + 4 + 1  # bigrams, trigrams, affixes of one and two, the lexicon


def test_held_out_accuracy_and_contract(spark):
    from statefold.llm.queries import QUERIES

    got = QUERIES["op4_language_id"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_words_of_switched_text():
    samples = [("en", "the cat and the dog with this that of then " * 8), ("de", "der hund und die katze mit einer nicht das " * 8)]
    model = G.fit(samples)
    text = "the cat and the dog " * 30 + "der hund und die katze " * 30
    labeller = G.Labeller(model)
    emission, _ = labeller._emissions(text.split())
    p, _, _ = G.marginals(emission, model.transitions, np.array([len(text.split())]))
    assert [model.languages[i] for i in p.argmax(1)] == ["en"] * 150 + ["de"] * 150
    assert np.trace(model.transitions) > model.transitions.sum() - np.trace(model.transitions)


def test_odd_rows(spark):
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in G.identify(documents(spark)).collect()}
    by = {k: lang for k, lang, _ in got if k is not None}
    assert by[4] == by[5] == by[6] == "und" and (None, "und", False) in got
    assert len(G.identify(clashing(spark)).collect()) == len(rows())
    assert G.identify(empty(spark)).collect() == []
    unlabelled = documents(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in G.identify(unlabelled).collect()} == {("und", 0.0)}


def test_prediction_does_not_read_the_label_or_key(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = G.fit(G.sample(docs))
    text = docs.first().text
    labeller = G.Labeller(model)
    assert labeller.label([text, None, text])[0] == G.Labeller(model).label([text])[0]
    held = docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1")
    assert G.sample(held) == []


def test_long_texts_and_cache(monkeypatch):
    model = G.fit([("en", "the cat and this that " * 20), ("fr", "le chat et les une des " * 20)])
    text = " ".join(["the cat and this"] * 40_000)
    (whole,) = G.Labeller(model).label([text])
    monkeypatch.setattr(G, "_CACHED_WORDS", 3)
    assert G.Labeller(model).label([text]) == [whole] and whole[0] == "en"
