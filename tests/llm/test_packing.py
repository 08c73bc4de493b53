import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statefold.llm import packing as P

from .fixtures import clashing, documents, empty, rows

TOKENIZER = Tokenizer.from_file(P.BYTE_BPE)


def check_packing(got, docs, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for doc_id, text in docs:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [0] if len(ids) <= capacity else [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
        for i, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            assert z - a <= capacity
            want[doc_id, i, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in got)


def test_pieces_and_places(spark):
    for capacity in (64, 2048):
        check_packing(P.pack_documents(documents(spark), capacity=capacity).collect(), [r[:2] for r in rows()], capacity)


def test_query_fills_sequences(spark):
    from statefold.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    n, total = check_packing(QUERIES["op3_best_fit_packing"](spark, "/root/testdata/sf0.001").collect(), docs, 2048)
    assert n <= -(-total // 2048) + 1


def test_sequences_hold_the_ids(spark):
    docs = documents(spark).where("doc_id in (1, 3, 12)")
    packed = P.pack_documents(docs, capacity=100).collect()
    ids = {r.sequence_id: r.ids for r in P.sequences(docs, capacity=100).collect()}
    for r in packed:
        part = ids[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8), st.integers(1, 60))
def test_fullest_is_the_best_sum(counts, room):
    reach = {0}
    for length, n in counts.items():
        reach |= {s + length * k for s in reach for k in range(n + 1)}
    chosen = P.fullest(counts, room)
    assert sum(chosen) == max(s for s in reach if s <= room)
    assert all(n <= counts[x] for x, n in Counter(chosen).items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 200), min_size=1, max_size=20))
def test_plan_uses_every_piece_once(counts):
    used = Counter()
    for times, lengths in P.plan_bins(counts, 40):
        assert sum(lengths) <= 40 and times > 0
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)


def test_word_cache_gives_the_library_ids(monkeypatch):
    texts = [r[1] or "" for r in rows()] + ["<|endoftext|> as text", "it's we'll  x\n\n y\t", "Ünïcödé ƒoo ß 12ab", "a b", "\x1c\x1d x"]
    for size in (400_000, 5):
        monkeypatch.setattr(P, "_CACHED_WORDS", size)
        monkeypatch.setattr(P, "_BATCH_CHARS", size)
        bpe = P.WordCachedBpe(P.BYTE_BPE)
        for _ in range(2):
            for t, ids in zip(texts, bpe.ids(texts), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def test_other_columns_and_empty(spark):
    assert P.pack_documents(clashing(spark)).count() == P.pack_documents(documents(spark)).count()
    assert P.pack_documents(empty(spark)).collect() == []
