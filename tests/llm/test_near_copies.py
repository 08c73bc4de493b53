import random

import corpus_pipeline
from statefold.llm import near_copies as N

from .fixtures import DOCS, clashing, documents, empty, lowered, rows, words


def slow_set(text, width=5):
    w = words(lowered(text))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def slow_components(pairs):
    """pairs: (key, text); key -> smallest key reachable over similarities of 4/5 or more."""
    sets, root = [slow_set(t) for _, t in pairs], list(range(len(pairs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(pairs):
        if k is not None and (least.get(top(i)) is None or k < least[top(i)]):
            least[top(i)] = k
    return [least.get(top(i)) for i in range(len(pairs))]


def planted(seed=3):
    """Texts with copies at similarities around 4/5, a passage that most share, and one large group."""
    rng, out = random.Random(seed), []
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    for g in range(40):
        base = [word() for _ in range(rng.choice((6, 60, 90, 200, 600)))]
        base[3:3] = passage if g % 2 else []
        for _ in range(60 if g == 0 else 5):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


def test_against_brute_force(spark, monkeypatch):
    pairs = planted()
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in pairs], DOCS)
    want = dict(zip([k for k, _ in pairs], slow_components(pairs), strict=True))
    assert 40 < len(set(want.values())) < len(want)
    for group in (8, 512):
        monkeypatch.setattr(N, "GROUP", group)
        assert {r.doc_id: r.component_id for r in N.near_copies(docs).collect()} == want


def test_awkward_texts(spark):
    pairs = [(r[0], r[1]) for r in rows()]
    got = N.near_copies(documents(spark)).collect()
    order = lambda x: [(v is not None, str(v)) for v in x]
    want = [(k, c) for (k, _), c in zip(pairs, slow_components(pairs), strict=True)]
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert N.near_copies(empty(spark)).collect() == []


def test_a_null_key_is_linked(spark):
    base = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(None, " ".join(base)), (7, " ".join([*base[:-1], "x"]))], "doc_id bigint, text string")
    assert [r.component_id for r in N.near_copies(docs).collect()] == [7, 7]


def test_stage_takes_near_copies_beyond_two_bits(spark, tmp_path):
    from statefold.llm.simhash import fingerprint, keep_first

    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    copy = list(base)
    for i in (40, 90, 150, 210, 260):
        copy[i] = "other"
    texts = [" ".join(base), " ".join(copy), " ".join(reversed(base))]
    assert (fingerprint(texts[0]) ^ fingerprint(texts[1])).bit_count() > 2
    assert len(slow_set(texts[0]) & slow_set(texts[1])) >= 0.8 * len(slow_set(texts[0]) | slow_set(texts[1]))
    spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == {0, 2}
    kept = keep_first(clashing(spark), near=N.near_copies)
    assert kept.columns == clashing(spark).columns and kept.count() > 0


def test_dedup_stage_against_brute_force(spark):
    from statefold.llm.quality_rules import keep_good

    docs = keep_good(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    want = set(slow_components([(r.doc_id, r.text) for r in docs.collect()]))
    got = [r.doc_id for r in stage(spark, docs, "").collect()]
    assert sorted(got) == sorted(want)


def test_sketches_and_heads_never_rule_out_a_link():
    rng = random.Random(8)
    for n in (1, 5, 40, 300, 2000):
        a = [rng.getrandbits(63) for _ in range(n)]
        for changed in (0, n // 20, n // 12, n // 10):
            b = a[: n - changed] + [rng.getrandbits(63) for _ in range(changed)]
            x, y = (N.np.array(sorted(s), N.np.int64) for s in (a, b))
            differ = len(set(a) ^ set(b))
            bits = (int.from_bytes(N.sketch(x)) ^ int.from_bytes(N.sketch(y))).bit_count()
            assert bits <= differ
            assert N.most_shared(x.astype("<u2"), y.astype("<u2")) >= len(set(a) & set(b))


def test_copies_around_one_text(spark):
    """Copies that are far from each other and near to one text in their middle, more than a pivot needs."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    texts = [list(base) for _ in range(90)]
    for t in texts[1:]:
        t[(at := rng.randrange(0, 108)) : at + 8] = [f"v{rng.randrange(10_000)}" for _ in range(8)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.component_id for r in N.near_copies(docs).collect()} == dict(zip([k for k, _ in pairs], slow_components(pairs), strict=True))


def test_sketches_of_long_texts_rule_pairs_out():
    """Two long sets at a similarity of 0.7 are no candidates; near copies of other sizes are."""
    rng = random.Random(12)
    for n in (150, 600, 2000):
        a = [rng.getrandbits(63) for _ in range(n)]
        far, near = a[: -n // 5] + [rng.getrandbits(63) for _ in range(n // 5)], a[: -n // 10]
        sets = [N.np.array(sorted(x), N.np.int64) for x in (a, far, near)]
        got = N._fit([N.sketch(x) for x in sets], N.np.array([len(x) for x in sets]), N.np.array([0, 0, 2]), N.np.array([1, 2, 0]))
        assert got.tolist() == [False, True, True]


def test_simhashes_are_candidates(spark):
    """The stage's first round takes what BK-trees over SimHashes link; texts are one class where these are equal."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(10_000)}" for _ in range(4000)]
    texts = [base, [*base[:-1], "x"], [f"v{i}" for i in range(50)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    sets = [N.shingles(" ".join(t)) for t in texts]
    assert (N.fingerprint_of(sets[0][1]) ^ N.fingerprint_of(sets[1][1])).bit_count() <= 2
    heads = N.cut(N._heads(docs, "doc_id", "text", 5, N.np.zeros(0, N.np.int64)))
    assert [(r.u, r.v) for r in N._by_fingerprints(heads, 3).collect()] in ([(a, b)] for a, b in (sorted((sets[0][0], sets[1][0])),))
