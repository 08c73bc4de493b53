import random

from statefold.llm import language_id as G


def _row(i, words, n, lang):
    rng = random.Random(i)
    return (i, " ".join(rng.choice(words) for _ in range(n)), lang)


EN, DE = "the cat and the dog with this that of then".split(), "der hund und die katze mit einer nicht das".split()


def test_long_texts_give_spans_of_whole_words(spark):
    docs = [_row(i, EN, 80, "en") for i in range(40)] + [(i, " ".join(f"{w}{k // 100}" for k, w in enumerate(DE * 100)), "de") for i in range(40, 80)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    found = G.sample(docs, chars=1000)
    assert {x for x, _ in found} == {"de", "en"}
    whole = {f"{w}{k // 100}" for k, w in enumerate(DE * 100)}
    for lang, t in found:
        assert len(t) <= 1000 and set(t.split()) <= (whole if lang == "de" else set(EN))
        if lang == "de":  # from the beginning to the end, and between
            places = {int(w.lstrip("abcdefghijklmnopqrstuvwxyz")) for w in t.split()}
            assert {0, 8} <= places and len(places) >= 6


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [_row(i, EN, 200, "en") for i in range(30)] + [_row(i, DE, 28_000, "de") for i in range(30, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert min(len(t) for _, t, lang in rows if lang == "de") > G.SAMPLE_CHARS
    got = {r.doc_id: r.lang_pred for r in G.identify(docs).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_a_word_longer_than_a_span(spark):
    docs = spark.createDataFrame([(i, "x" * 300, "xx") for i in range(6)] + [(i, "the cat", "en") for i in range(6, 12)], "doc_id bigint, text string, lang string")
    assert {t for lang, t in G.sample(docs, chars=80) if lang == "xx"} == {" ".join(["x" * 10] * 8)}
