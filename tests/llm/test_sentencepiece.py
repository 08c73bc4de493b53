import zlib

import numpy as np
import pytest
import sentencepiece

from statefold.llm import sentencepiece_backend as S

from .fixtures import clashing, documents, empty, rows

TEXTS = ["Hello  world", "  a\n\n b\t x", " lead", "naïve ▁x ▁▁ y", "日本語 😀 test\r\n", "é" * 50, "\u0000a​b", "aaaaaaa aaa    bbbbb", "x \n y \n\n  z ", "a.b,c;d 3.14 e-mail it's ...", "A1b2 C3", "<s></s><unk><0x41>", *[r[1] for r in rows() if r[1]]]


@pytest.fixture(scope="module")
def backend():
    with open(S.PIECE_BPE, "rb") as f:
        return S.SpmBackend(f.read())


def test_parity_with_the_library(backend):
    library = sentencepiece.SentencePieceProcessor(model_file=S.PIECE_BPE)
    for t, e in zip(TEXTS, backend.encode(TEXTS), strict=True):
        ids = np.frombuffer(e.ids, "<u4").tolist()
        assert ids == library.encode(t) and e.parity, t[:30]
        assert e.decoded == library.decode(ids) == backend.decode(ids), t[:30]
        assert backend.whole.encode(t, add_special_tokens=False).ids == ids


def test_small_caches_change_nothing(backend, monkeypatch):
    want = [e.ids for e in backend.encode(TEXTS)]
    with open(S.PIECE_BPE, "rb") as f:
        fresh = S.SpmBackend(f.read())
    monkeypatch.setattr(S, "_CACHED_RUNS", 7)
    monkeypatch.setattr(S, "_BATCH_CHARS", 50)
    assert [e.ids for e in fresh.encode(TEXTS)] == want == [e.ids for e in fresh.encode(TEXTS)]


def test_protobuf_is_parsed():
    with open(S.PIECE_BPE, "rb") as f:
        model = S.parse(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=S.PIECE_BPE)
    assert len(model.pieces) == library.vocab_size() and model.kind == S.BPE and model.byte_fallback
    for i in (0, 1, 2, 3, 258, 259, 5000, 31999):
        assert model.pieces[i].text == library.id_to_piece(i) and model.pieces[i].score == pytest.approx(library.get_score(i))


def _field(number, wire, value):
    out, n = bytearray(), number << 3 | wire
    for x in (n, value if wire == 0 else len(value)):
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
        if wire == 0 and x is not n:
            pass
    return bytes(out) + (value if wire == 2 else b"")


def test_unigram_model_scores_and_byte_fallback():
    import struct

    def piece(text, score, kind=1):
        body = _field(1, 2, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind])
        return _field(1, 2, body)

    raw = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    raw += b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    raw += b"".join(piece(t, s) for t, s in (("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -2.2), ("▁a", -2.1), ("▁ab", -6.0), ("ba", -3.1)))
    raw += _field(2, 2, bytes([3 << 3, 1]) + bytes([0x98, 0x02, 1]))  # trainer: unigram, byte fallback (field 35)
    raw += _field(3, 2, bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    model = S.parse(raw)
    assert model.kind == S.UNIGRAM and model.byte_fallback and model.add_dummy_prefix and not model.remove_extra_whitespaces
    library, ours = sentencepiece.SentencePieceProcessor(model_proto=raw), S.SpmBackend(raw)
    texts = ["ab", "abab ba", "a  b", "aé b", "bb a"]
    for t, e in zip(texts, ours.encode(texts), strict=True):
        ids = np.frombuffer(e.ids, "<u4").tolist()
        assert ids == library.encode(t) and e.parity and e.decoded == library.decode(ids) == t


def test_rows_and_decoding(spark):
    got = S.encode(documents(spark), with_ids=True)
    library = sentencepiece.SentencePieceProcessor(model_file=S.PIECE_BPE)
    texts = {r[0]: r[1] or "" for r in rows() if r[0] is not None}
    for r in got.collect():
        if r.doc_id is not None:
            ids = library.encode(texts[r.doc_id])
            assert r.ids == ids and r.n_ids == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            assert r.parity and r.round_trip and r.decoded_crc32 == zlib.crc32(texts[r.doc_id].encode())
    back = S.decode(got.select("doc_id", "ids")).where("doc_id is not null").collect()
    assert all(r.text == texts[r.doc_id] for r in back)
    assert S.encode(clashing(spark)).count() == len(rows()) and S.encode(empty(spark)).collect() == []
    nulls = S.decode(spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>"), out="back").collect()
    assert [(r.k, r.back) for r in sorted(nulls)] == [(1, None), (2, "")]


def test_a_broken_decoder_shows(backend):
    from tokenizers import decoders

    with open(S.PIECE_BPE, "rb") as f:
        broken = S.SpmBackend(f.read())
    broken.whole.decoder = decoders.Replace("▁", "_")
    assert [e.decoded for e in broken.encode(["one two"])] == ["_one_two"] != [e.decoded for e in backend.encode(["one two"])]


def test_whole_texts_are_compared(backend, monkeypatch):
    """What the runs do not show, a checked text does."""

    class Other:
        def encode(self, text):
            return [1]

    monkeypatch.setattr(backend, "library", Other())
    assert [e.parity for e in backend.encode(["one", "two", ""], [True, False, True])] == [False, True, True]


def test_rows_that_are_checked_whole(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in (-100, 0, 1, 99, 100, 250, 300)] + [(None, "x")], "doc_id bigint, text string")
    assert {r.doc_id for r in S.encode(docs).where("whole_checked").collect()} == {-100, 0, 100, 300}
    assert S.encode(docs.selectExpr("cast(doc_id as string) as doc_id", "text")).where("parity and round_trip").count() == 8


def test_the_query_checks_every_whole_text(spark):
    from statefold.llm import queries

    got = queries.QUERIES["op7_sentencepiece"](spark, "/root/testdata/sf0.001")
    assert got.where("not whole_checked").count() == 0 and got.where("parity and round_trip").count() == got.count() > 0


def test_what_is_checked_whole_is_not_checked_by_runs_too(monkeypatch):
    """The library is asked once: for whole texts, or for the runs of texts that are not checked so."""
    with open(S.PIECE_BPE, "rb") as f:
        fresh = S.SpmBackend(f.read())
    asked, library = [], fresh.inner

    class Counting:
        def encode(self, runs, **how):
            asked.extend(runs)
            return library.encode(runs, **how)

    monkeypatch.setattr(fresh, "inner", Counting())
    want = list(fresh.encode(TEXTS, [True] * len(TEXTS)))
    assert not asked and all(e.parity for e in want)
    assert list(fresh.encode(TEXTS)) == want and len(asked) == len(set(asked)) > 0  # runs met unchecked are checked now
    before = len(asked)
    assert list(fresh.encode(TEXTS, [i % 2 == 0 for i in range(len(TEXTS))])) == want and len(asked) == before
