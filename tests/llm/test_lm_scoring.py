import math
import zlib
from collections import Counter

import numpy as np
import pytest

from statefold.llm import codes
from statefold.llm import lm_scoring as L

from .fixtures import clashing, documents, empty, lowered, rows, words


def brute(docs, order, mu, modulus=7, remainder=2):
    texts = [(k, words(lowered(t)) + ["</s>"]) for k, t in docs]
    held = [k is not None and zlib.crc32(str(k).encode()) % modulus == remainder for k, _ in texts]
    counts, starts = Counter(), sum(not h for h in held)
    for (_, w), h in zip(texts, held, strict=True):
        s = ["<s>", *w]
        for t in range(1, len(s)) if not h else ():
            for n in range(1, order + 1):
                if t - n + 1 >= 0:
                    counts[tuple(s[t - n + 1 : t + 1])] += 1
    unigrams = {g: c for g, c in counts.items() if len(g) == 1}
    total, types = sum(unigrams.values()), len(unigrams)

    def p(history, w):
        if not history:
            return (counts[(w,)] + 1) / (total + types + 1)
        n = starts if history == ("<s>",) else counts[history]
        return (counts[(*history, w)] + mu * p(history[1:], w)) / (n + mu)

    for (k, w), h in zip(texts, held, strict=True):
        s = ["<s>", *w]
        score = sum(math.log10(p(tuple(s[max(0, t - order + 1) : t]) if order > 1 else (), s[t])) for t in range(1, len(s)))
        base = sum(math.log10((counts[(x,)] + 1) / (total + types + 1)) for x in w)
        yield k, h, len(w), sum(counts[(x,)] > 0 for x in w), total, base, score


def close(got, want):
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, order):
    close(L.score(documents(spark), order=order, chunk_bytes=2000).collect(), brute([r[:2] for r in rows()], order, 8.0))


def test_query_against_brute_force(spark):
    from statefold.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = QUERIES["op2_lm_scoring"](spark, "/root/testdata/sf0.001").collect()
    close(got, brute(docs, 3, 8.0))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_chunks_do_not_matter(spark):
    one, many = (L.score(documents(spark), chunk_bytes=size).collect() for size in (1 << 24, 300))
    close(one, [tuple(r) for r in many])


def test_other_columns_and_empty(spark):
    close(L.score(clashing(spark)).collect(), brute([r[:2] for r in rows()], 3, 8.0))
    assert L.score(empty(spark)).collect() == []
    nothing = spark.createDataFrame([(2, "only held out")], "doc_id bigint, text string")
    held = next(i for i in range(100) if L.is_held_out(i, 7, 2))
    only = nothing.selectExpr(f"cast({held} as bigint) as doc_id", "text")
    (r,) = L.score(only).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 4, 0, 0, 0.0, 0.0)


def test_probabilities_of_a_history_sum_to_one():
    """Over the seen words and one unseen, the automaton's arcs from a state are a distribution."""
    texts = ["a b a c", "a b b", "c a b"]
    vocabulary = ["a", "b", "c", "zzz"]
    probes = [f"{h} {w}" for h in vocabulary for w in vocabulary] + [f"{h}" for h in vocabulary]
    chunk = L.Chunk(texts + probes, 2)
    held = np.array([False] * len(texts) + [True] * len(probes))
    counts = chunk.training_counts(held)
    total, types = int(counts[0].sum()), int((counts[0] > 0).sum())
    model = L.BackoffAutomaton(chunk, counts, total, types, len(texts), 8.0)

    def score(i):
        s = slice(chunk.begins[i], chunk.begins[i + 1])
        at = [a[s] for a in chunk.at]
        return [model.score([model.arc[n][at[n]][: t + 1] for n in range(2)], [model.fail[0][at[0]][: t + 1]]) for t in range(len(at[0]))]

    for j, h in enumerate(vocabulary):
        n = len(texts) + j * len(vocabulary)
        steps = [score(n + i) for i in range(len(vocabulary))]
        ends = score(len(texts) + len(vocabulary) ** 2 + j)
        mass = sum(10 ** (s[1] - s[0]) for s in steps) + 10 ** (ends[1] - ends[0])
        assert mass == pytest.approx(1.0), h


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for x in (np.empty(0, np.uint64), np.array([7], np.uint64), np.array([0, 2**64 - 1], np.uint64), np.array([0, 5, 5], np.uint64), np.sort(rng.integers(0, 2**64, 1000, np.uint64))):
        for y in (x, x & L._KEPT, x >> np.uint64(16)):
            assert (codes.unpack_sorted(codes.pack_sorted(y)) == y).all() and (codes.unpack(codes.pack(y)) == y).all()
    dense = np.sort(rng.integers(0, 2**64, 100_000, np.uint64))
    assert 8 * len(codes.pack_sorted(dense)) / 100_000 < 64 - np.log2(100_000) + 2


@pytest.mark.parametrize("fan", [4, 16])
def test_steps_of_the_exchange_do_not_matter(spark, fan):
    got = L.score(documents(spark), chunk_bytes=300, fan=fan).collect()
    close(got, brute([r[:2] for r in rows()], 3, 8.0))


def test_exchange_is_linear(spark):
    """Rows that an asker sends are bounded by the fan, whatever the number of chunks; steps are its logarithm."""
    for n in (8, 64, 512):
        docs = spark.range(n).selectExpr("id as doc_id", "repeat(concat('a', id, ' b', id % 7, ' c'), 100) as text").repartition(4)
        size = docs.selectExpr("sum(length(text) + 1) as n").first().n
        _, inputs = L._plan(docs, 3, 8.0, 7, 2, "doc_id", "text", -(-size // n), 8)
        steps = L.steps_of(n, 8)
        assert len(inputs) == len(steps) <= max(3, math.ceil(math.log(n, 8)))
        assert all(i.count() <= 2 * n * 9 for i in inputs)
    assert len(L.steps_of(8192, 4096)) == 1 and len(L.steps_of(2**24, 4096)) == 2


def test_equal_rows_are_spread(spark):
    """Copies lie in chunks by place: none holds more than its bytes, and each scan task keeps its own."""
    docs = spark.createDataFrame([(1, "to be or not to be")] * 10_000 + [(2, "that is")] * 100, "doc_id bigint, text string").repartition(4)
    _, (sent,) = L._plan(docs, 3, 8.0, 7, 2, "doc_id", "text", 20_000, 4096)
    chunks = [L.pa.ipc.open_stream(r.docs).read_all().num_rows for r in sent.where("key >= 0").collect()]
    assert sum(chunks) == 10_100 and max(chunks) <= 20_000 // 8 and len(chunks) >= 9
    got = {tuple(r) for r in L.score(docs, chunk_bytes=20_000).collect()}
    want = list(brute([(1, "to be or not to be")] * 10_000 + [(2, "that is")] * 100, 3, 8.0))
    assert len(got) == 2
    close(got, list({w[0]: w for w in want}.values()))


def test_long_text_is_whole(spark):
    docs = spark.createDataFrame([(1, "x y z " * 20_000), (2, "x y"), (3, None)], "doc_id bigint, text string")
    close(L.score(docs, chunk_bytes=500).collect(), brute([tuple(r) for r in docs.collect()], 3, 8.0))
