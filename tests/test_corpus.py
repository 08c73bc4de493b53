import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statefold.operators import corpus as C


def slow_first_fit(lengths, capacity):
    """Longest first, each into the first container with room: the lengths in each container."""
    bins = []
    for x in sorted(lengths, reverse=True):
        for b in bins:
            if sum(b) + x <= capacity:
                b.append(x)
                break
        else:
            bins.append([x])
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80), st.integers(20, 40))
def test_first_fit_decreasing(lengths, capacity):
    counts = Counter(lengths)
    got, taken = {}, Counter()
    for length, first, n, container, each, offset in C.first_fit_decreasing(counts, capacity):
        assert first == taken[length]
        taken[length] += n
        for i in range(n):
            got.setdefault(container + i // each, []).append((offset + i % each * length, length))
    assert taken == Counter({x: n for x, n in counts.items() if x <= capacity})
    want = slow_first_fit([x for x in lengths if x <= capacity], capacity)
    assert [[x for _, x in sorted(got[i])] for i in range(len(got))] == want
    for parts in got.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_packed_whole(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice((3, 3, 3, 5, 8, 13, 21, 40))) for i in range(700)] + [(None, 3), (900, 3), (900, 3)]
    docs = spark.createDataFrame(rows, "id bigint, length bigint")
    got = C.packed_whole(docs, "id", capacity=32).collect()
    assert len(got) == len(rows) and all((r.container is None) == (r.length > 32) for r in got)
    held = {}
    for r in got:
        if r.container is not None:
            held.setdefault(r.container, []).append((r.offset, r.length))
    want = slow_first_fit([n for _, n in rows if n <= 32], 32)
    assert [[x for _, x in sorted(held[i])] for i in range(len(held))] == want
    assert C.packed_whole(docs.limit(0), "id").collect() == []


def test_container_labels(spark):
    docs = spark.createDataFrame([(1, [-100, -100, 7, 8]), (2, [-100, 9]), (3, [5])], "id bigint, labels array<int>").withColumn("length", F.size("labels").cast("bigint") + 1)
    got = {r.container: r.labels for r in C.container_labels(C.packed_whole(docs, "id", capacity=8), 8).collect()}
    assert got == {0: [-100, -100, 7, 8, 0, -100, 9, 0], 1: [5, 0] + [-100] * 6}


def test_contamination(spark):
    items = spark.createDataFrame([(0, "One two three four five six seven eight nine"), (1, "too short"), (2, None)], "item_id int, text string")
    docs = spark.createDataFrame([(1, "x ONE two, three four five six seven eight y"), (2, "one two three four five six seven"), (3, None), (None, "two three four five six seven eight nine " * 2), (4, "")], "doc_id bigint, text string")
    assert {(r.doc_id, r.n_grams) for r in C.contaminated(docs, items, "doc_id").collect()} == {(1, 1), (None, 1)}
    assert {r.doc_id for r in C.decontaminated(docs, items, "doc_id").collect()} == {2, 3, 4}
    assert C.contaminated(docs, items.limit(0), "doc_id").collect() == []


def test_licences(spark):
    said = {
        "Released under the MIT License.": "permissive", "CC BY 4.0": "attribution", "cc-by-sa": "copyleft", "Licensed under CC BY-NC 4.0.": "noncommercial", "MIT License, but no AI training": "training-blocked",
        "Generated by an AI model. CC0": "model-generated", "all rights mine": "unlicensed", None: "unlicensed",
    }
    docs = spark.createDataFrame([(f"s{i % 3}", t) for i, t in enumerate(said)], "source string, text string")
    decisions = spark.createDataFrame([("s0", True), ("s1", False)], "source string, accepted boolean")
    got = C.admitted(docs, decisions).collect()
    assert {r.text: r.tier for r in got} == said
    reasons = {r.text: r.reason for r in got}
    assert [reasons[t] for t in said] == ["used", "used", "used", "never", "never", "undecided", "accepted", "refused"]
    assert sum(r.n for r in C.ledger(C.admitted(docs, decisions)).collect()) == len(said)


def test_mixture_rates():
    counts = {"a": 1000, "b": 500, "c": 10, "d": 40}
    for floors in ({"c": 0.05}, {"c": 0.05, "d": 0.2}, {"a": 0.3}, {"b": 0.6}, {"c": 0.1, "b": 0.5}):
        rates = C.mixture_rates(counts, floors)
        kept = {g: counts[g] * r for g, r in rates.items()}
        assert all(0 <= r <= 1 for r in rates.values())
        assert all(kept[g] >= f * sum(kept.values()) * (1 - 1e-9) for g, f in floors.items())
    assert C.mixture_rates(counts, {"a": 0.3}) == dict.fromkeys(counts, 1.0)
    with pytest.raises(ValueError):
        C.mixture_rates(counts, {"a": 0.5, "b": 0.5})


def test_bm25(spark):
    texts = ["the cat sat", "the dog sat on the mat", "a cat and a cat", "", "fish"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    passages = C.chunks(docs, "doc_id", 4)
    assert [(r.doc_id, r.chunk, len(r.tokens)) for r in sorted(passages.collect())] == [(0, 0, 3), (1, 0, 4), (1, 1, 2), (2, 0, 4), (2, 1, 1), (4, 0, 1)]
    queries = spark.createDataFrame([(7, ["cat", "cat", "sat"]), (8, ["nothing"])], "q int, tokens array<string>")
    got = sorted(C.bm25(queries, passages, "q", ["doc_id", "chunk"], k=4).collect(), key=lambda r: r["rank"])
    tokens = {(r.doc_id, r.chunk): r.tokens for r in passages.collect()}
    mean = sum(map(len, tokens.values())) / len(tokens)

    def score(p):
        total = 0.0
        for t in ("cat", "sat"):
            df = sum(t in x for x in tokens.values())
            tf = tokens[p].count(t)
            total += math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens[p]) / mean))
        return round(total, 6)

    want = sorted(((-score(p), *p) for p in tokens if score(p) > 0))[:4]
    assert [(r.doc_id, r.chunk, r.score) for r in got] == [(d, c, -s) for s, d, c in want]


def test_bm25_shuffles_no_passages(spark):
    """One row a task, query and place is shuffled, whatever the passages; ties over batches go by ids, null ids first."""
    rows = [(None if i == 700 else i % 500, i, ["a", "b", f"w{i}"] if i % 3 else ["b", "c", "c", f"w{i}"]) for i in range(900)]
    passages = spark.createDataFrame(rows, "d bigint, chunk int, tokens array<string>").repartition(4)
    queries = spark.createDataFrame([("x", ["a", "a", "w7"]), ("y", ["c"]), ("z", ["b", None]), (None, ["a"])], "q string, tokens array<string>")
    found = C.bm25(queries, passages, "q", ["d", "chunk"], 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(q") == 1 and plan.count("Exchange hashpartitioning") == 1
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.q, []).append((r.d, r.chunk))
    order = lambda d, c: (d is not None, d or 0, c)
    like = lambda w: sorted(((d, c) for d, c, t in rows if w in t), key=lambda x: order(*x))
    assert got["x"] == [(7, 7), *[p for p in like("a") if p != (7, 7)][:4]]
    assert got[None] == like("a")[:5] and got["y"] == like("c")[:5] and len(got["z"]) == 5
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        key = lambda r: (str(r.q), r["rank"], str(r.d), r.chunk, r.score)
        assert sorted(map(key, C.bm25(queries, passages, "q", ["d", "chunk"], 5).collect())) == sorted(map(key, found.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert C.bm25(queries.limit(0), passages, "q", ["d", "chunk"], 5).count() == 0 == C.bm25(queries, passages.limit(0), "q", ["d", "chunk"], 5).count()


def test_delta_rule(spark):
    import numpy as np

    from statefold.operators.memory import delta_reads

    rng = np.random.default_rng(2)
    rows = [(s, int(t > 5), t, float(-rng.random()), float(rng.random()), *(rng.normal(size=d).tolist() for d in (3, 3, 2))) for s in (1, 2) for t in range(12)]
    df = spark.createDataFrame(rows, "s int, doc bigint, t bigint, la double, beta double, q array<double>, k array<double>, v array<double>").repartition(3)
    got = {(r.s, r.t): r.y for r in delta_reads(df, "s").collect()}
    state, key = None, None
    for s, doc, t, la, beta, q, k, v in rows:
        if (s, doc) != key:
            key, state = (s, doc), np.zeros((3, 2))
        a, k, v = math.exp(la), np.array(k), np.array(v)
        state = a * state + np.outer(k, beta * (v - a * (k @ state)))
        assert np.allclose(got[s, t], np.array(q) @ state)
